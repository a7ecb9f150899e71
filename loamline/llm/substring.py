"""Exact substring dedup by fixed-block anchors.

Every text's words are cut into non-overlapping reference blocks of (window + 1) // 2 words; a repeat of at least
``window`` words then holds a whole reference block of either place. All rolling windows of block length probe the
index of reference blocks, which hash partitions hold. Hits are extended: the windows of full length around them are
compared, by 128-bit hashes, in the same way, and runs of windows that are found elsewhere are the maximal repeats.

No pair is formed anywhere. A task first resolves what repeats inside its own piece of the input and sends a hash that
occurs there many times only as "present", so a passage shared by a third of all documents costs each piece a few
entries. Hashes travel packed (5 or 16 bytes a window, with the places), and what comes back are only places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import gathered, keep, pieces, raw, text_of, word_spans

PACKED = "part int, kind int, piece bigint, pieces binary, docs binary, places binary, hashes binary, dids array<bigint>, keys array<bigint>"
FOUND = "piece bigint, docs binary, places binary, dids array<bigint>, keys array<bigint>"
#: The kinds of packed rows: windows to look up with their places; hashes that are present more than once; places known to
#: repeat; the texts of a piece, which the others name by their number in it.
PROBES, PRESENT, KNOWN, TEXTS = 0, 1, 2, 3
#: Bytes of text for which there is one hash part, what a task gathers before it sends, and the parts that it sends to.
PART, GATHER, FAN = 2 << 20, 2 << 20, 2048
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
SIGN = np.uint32(1 << 31)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which each bit depends on all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of odd numbers modulo 2**64, and of their inverses, kept and prolonged as needed."""

    def __init__(self) -> None:
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __call__(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in self.kept or len(self.kept[base][0]) < n:
            out = []
            for x in (base, pow(base, -1, 1 << 64)):
                a = np.full(n, x, np.uint64)
                a[:1] = 1
                out.append(np.cumprod(a, dtype=np.uint64))
            self.kept[base] = (out[0], out[1])
        return self.kept[base][0][:n], self.kept[base][1][:n]


POWERS = Powers()
LETTERS = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of the ranges [start, end) of values."""
    power, inverse = POWERS(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """Hashes of words, for about most bytes at a time: what is computed for each byte takes tens of bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + most)))
        first = starts[i]
        out[i:j] = rolled(LETTERS[data[first : ends[j - 1]]], starts[i:j] - first, ends[i:j] - first, ODD[0])
        i = j
    return out ^ mixed((ends - starts).astype(np.uint64))


def planes(x: np.ndarray) -> bytes:
    """Numbers as 4 bytes each; bytes of equal weight stand together, so that the constant ones compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def rows_of(part: np.ndarray, kind: int, doc: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> Iterator[tuple]:
    """A packed row for each part; entries come in the order of texts and places."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part, doc, place, hashes = part[order], doc[order], place[order], hashes[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
        own = (b"", b"") if kind == PRESENT else (planes(np.diff(doc[a:b], prepend=0)), planes(place[a:b]))
        yield int(part[a]), kind, b"", *own, np.ascontiguousarray(hashes[a:b].T).tobytes(), [], []


def entries(codes: np.ndarray, more: np.ndarray, doc: np.ndarray, place: np.ndarray, ref: np.ndarray, dids: np.ndarray, keys: np.ndarray, parts: int, n_bytes: int) -> pa.RecordBatch | None:
    """What a piece has to tell the others of its windows. codes, more: the hash's 64 and further 64 bits; ref: whether a
    window is a reference block. Windows repeated inside the piece, a reference among them, are known to repeat.

    A piece is named by a hash of what it holds, so a task that runs again gives the same rows."""
    if not len(codes):
        return None
    order = np.lexsort((more, codes)) if n_bytes > 8 else np.argsort(codes, kind="stable")
    new = np.ones(len(codes), bool)
    new[1:] = codes[order][1:] != codes[order][:-1]
    if n_bytes > 8:
        new[1:] |= more[order][1:] != more[order][:-1]
    group = np.empty(len(codes), np.int64)
    group[order] = np.cumsum(new) - 1
    settled = (np.bincount(group) > 1) & (np.bincount(group, weights=ref) > 0)
    known = settled[group]
    part = ((codes >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
    low = codes.astype("<u8").view(np.uint8).reshape(-1, 8)
    hashes = low[:, :n_bytes] if n_bytes <= 8 else np.concatenate([low, more.astype("<u8").view(np.uint8).reshape(-1, 8)], axis=1)
    marked = place.astype(np.uint32) | np.where(ref, SIGN, np.uint32(0))
    ask = ~known
    tell = order[new][settled]  # one window of each settled group
    piece = int.from_bytes(hashlib.blake2b(dids.tobytes() + keys.tobytes(), digest_size=8).digest(), "little", signed=True)
    rows = [(piece % parts, TEXTS, b"", b"", b"", b"", dids, keys)]
    rows += rows_of(part[ask], PROBES, doc[ask], marked[ask], hashes[ask])
    rows += rows_of(part[tell], PRESENT, doc[tell], marked[tell], hashes[tell])
    rows += rows_of(np.full(known.sum(), piece % parts, np.int32), KNOWN, doc[known], place[known], hashes[known][:, :0])
    return packed(rows, [piece] * len(rows))


def packed(rows: list[tuple], piece: list[int]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64()))
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    columns.insert(2, pa.array(piece, pa.int64()))
    return pa.RecordBatch.from_arrays(columns, names=["part", "kind", "piece", "pieces", "docs", "places", "hashes", "dids", "keys"])


def unpacked(b: pa.RecordBatch, i: int, n_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of windows or of present hashes: pieces, texts, places and hashes, the first three empty for the latter."""
    doc, place = np.cumsum(numbers(b["docs"][i].as_py()), dtype=np.uint32).astype(np.int64), numbers(b["places"][i].as_py())
    own = b["pieces"][i].as_py()
    piece = np.frombuffer(own, "<i8") if own else np.full(len(doc), b["piece"][i].as_py(), np.int64)
    return piece, doc, place, np.frombuffer(b["hashes"][i].as_py(), np.uint8).reshape(max(n_bytes, 1), -1).T


def split(n_bytes: int, fan: int, most: int):
    """Rows of coarse parts, which come sorted by part, as rows of fan times as many parts: a task gathers most windows of
    one coarse part, whatever pieces they are of, before it sends them on, so that rows stay long."""

    def sent(part: int, kind: int, held: list[tuple]) -> pa.RecordBatch | None:
        piece, doc, place, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        low = np.zeros((len(hashes), 8), np.uint8)
        low[:, :5] = hashes[:, :5]
        fine = (low.view("<u8").ravel() % np.uint64(fan)).astype(np.int64) + part * fan
        order, rows = np.argsort(fine, kind="stable"), []
        cuts = np.flatnonzero(np.diff(fine[order], prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            at = order[a:b]
            own = (b"", b"", b"") if kind == PRESENT else (piece[at].astype("<i8").tobytes(), planes(np.diff(doc[at], prepend=0)), planes(place[at]))
            rows.append((int(fine[order[a]]), kind, *own, np.ascontiguousarray(hashes[at].T).tobytes(), [], []))
        return packed(rows, [0] * len(rows)) if rows else None

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {PROBES: [], PRESENT: []}
        last = None
        for b in batches:
            for i, (part, kind) in enumerate(zip(b["part"].to_pylist(), b["kind"].to_pylist(), strict=True)):
                if kind in (KNOWN, TEXTS):  # to any part of its own
                    yield b.slice(i, 1).set_column(0, "part", pa.array([part * fan + b["piece"][i].as_py() % fan], pa.int32()))
                    continue
                for k, own in held.items():
                    if own and (part != last or sum(len(x[3]) for x in own) >= most):
                        yield sent(last, k, own)
                        held[k] = []
                last = part
                held[kind].append(unpacked(b, i, n_bytes))
        for k, own in held.items():
            if own:
                yield sent(last, k, own)

    return f


def met(n_bytes: int):
    """For one part: the places of those windows whose hash is present twice or more, a reference among them."""

    def f(group: pa.Table) -> pa.Table:
        out: list[tuple] = []
        codes, weight, ref, asked = [], [], [], []

        def found(piece: np.ndarray, doc: np.ndarray, place: np.ndarray) -> None:
            order = np.argsort(piece, kind="stable")
            cuts = np.flatnonzero(np.diff(piece[order], prepend=piece[order[:1]] - 1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                at = order[a:b]
                out.append((int(piece[at[0]]), planes(np.diff(doc[at], prepend=0)), planes(place[at]), [], []))

        for b in group.to_batches():
            for i, kind in enumerate(b["kind"].to_pylist()):
                if kind == TEXTS:
                    out.append((b["piece"][i].as_py(), b"", b"", b["dids"][i].as_py(), b["keys"][i].as_py()))
                    continue
                piece, doc, place, h = unpacked(b, i, 0 if kind == KNOWN else n_bytes)
                if kind == KNOWN:
                    found(piece, doc, place)
                    continue
                padded = np.zeros((len(h), -(-n_bytes // 8) * 8), np.uint8)
                padded[:, :n_bytes] = h
                codes.append(padded.view("<u8"))
                if kind == PRESENT:
                    weight.append(np.full(len(h), 2)), ref.append(np.ones(len(h), bool)), asked.append((piece, doc, place, len(h)))
                else:
                    weight.append(np.ones(len(h), np.int64)), ref.append(place >= SIGN), asked.append((piece, doc, place & ~SIGN, len(h)))
        if codes:
            code = np.concatenate(codes)
            order = np.lexsort(code.T) if code.shape[1] > 1 else np.argsort(code[:, 0], kind="stable")
            new = np.concatenate([[True], (code[order][1:] != code[order][:-1]).any(axis=1)])
            group_of = np.empty(len(order), np.int64)
            group_of[order] = np.cumsum(new) - 1
            good = (np.bincount(group_of, weights=np.concatenate(weight)) > 1) & (np.bincount(group_of, weights=np.concatenate(ref)) > 0)
            hit, at = good[group_of], 0
            for piece, doc, place, n in asked:
                h = hit[at : at + n]
                at += n
                if len(doc) and h.any():
                    found(piece[h], doc[h], place[h])
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)]
        return pa.Table.from_arrays(columns, names=["piece", "docs", "places", "dids", "keys"])

    return f


def named(group: pa.Table) -> pa.Table:
    """Of all that was found for one piece: the ids and keys of its texts with a place, and their places."""
    docs, places, dids, keys = [], [], [], []
    for b in group.to_batches():
        for i in range(b.num_rows):
            if own := b["dids"][i].as_py():
                dids, keys = own, b["keys"][i].as_py()
            else:
                docs.append(np.cumsum(numbers(b["docs"][i].as_py()), dtype=np.uint32)), places.append(numbers(b["places"][i].as_py()))
    doc, place = (np.concatenate([*x, np.zeros(0, np.uint32)]).astype(np.int64) for x in (docs, places))
    order = np.lexsort((place, doc))
    own, n = np.unique(doc, return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(place[order].astype(np.int32)))
    ids = [pa.array(np.array(x, np.int64)[own]) for x in (dids, keys)]
    return pa.Table.from_arrays([*ids, lists], names=["did", "key", "places"])


def anchors(window: int, parts: int):
    """The reference blocks and the probes of each piece."""
    block = (window + 1) // 2

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in gathered(batches, "text", GATHER):
            for b in pieces(whole, "text", GATHER):
                data, offsets = raw(b["text"])
                starts, ends, before = word_spans(data, offsets)
                n = np.diff(before)
                if not (n >= window).any():
                    continue
                w = word_hashes(data, starts, ends)
                many = np.where(n >= window, n - block + 1, 0)
                doc = np.repeat(np.arange(len(n)), many)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                first = before[:-1][doc] + place
                codes = rolled(w, first, first + block, ODD[1])
                if (out := entries(codes, codes, doc, place, place % block == 0, np.asarray(b["did"]), np.asarray(b["key"]), parts, 5)) is not None:
                    yield out

    return f


def extensions(window: int, parts: int):
    """The windows of full length around each piece's hits."""
    block = (window + 1) // 2

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in gathered(batches, "text", GATHER):
            for b in pieces(whole, "text", GATHER):
                data, offsets = raw(b["text"])
                starts, ends, before = word_spans(data, offsets)
                n = np.diff(before)
                w = word_hashes(data, starts, ends)
                hits = b["places"]
                owner = np.repeat(np.arange(len(n)), np.diff(np.asarray(hits.offsets)))
                hit = before[:-1][owner] + np.asarray(hits.values)[hits.offsets[0].as_py() : hits.offsets[-1].as_py()]
                edge = np.zeros(len(w) + 1, np.int64)  # a hit at p lies in the windows that start from p - (window - block) to p
                np.add.at(edge, np.maximum(hit - (window - block), before[:-1][owner]), 1)
                np.add.at(edge, hit + 1, -1)
                of = np.repeat(np.arange(len(n)), n)
                first = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                first = first[first + window <= before[1:][of[first]]]
                doc = of[first]
                codes, more = rolled(w, first, first + window, ODD[1]), rolled(w, first, first + window, ODD[2])
                if (out := entries(codes, more, doc, first - before[:-1][doc], np.ones(len(first), bool), np.asarray(b["did"]), np.asarray(b["key"]), parts, 16)) is not None:
                    yield out

    return f


def removal(window: int, texts: bool):
    """Each text's words outside its repeated windows."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                data, offsets = raw(b["text"])
                n_words, n_removed, digests, kept_texts = [], [], [], []
                for i, (found, twice) in enumerate(zip(b["places"], b["twice"].to_pylist(), strict=True)):
                    words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    n_words.append(n := len(words))
                    if twice and n >= window:
                        words = []
                    elif found.is_valid and len(found):
                        edge = np.zeros(n + window + 1, np.int64)
                        p = np.unique(np.asarray(found.values))
                        edge[p] += 1
                        edge[p + window] -= 1
                        words = [words[j] for j in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
                    n_removed.append(n - len(words))
                    kept = b" ".join(words)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if texts:
                        kept_texts.append(kept.decode() if n_removed[-1] else data[offsets[i] : offsets[i + 1]].tobytes().decode())
                out = [b.column(b.schema.get_field_index(c)) for c in b.schema.names if c not in ("text", "places", "twice")] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
                names = [c for c in b.schema.names if c not in ("text", "places", "twice")] + ["n_words", "n_removed", "kept_sha256"]
                yield pa.RecordBatch.from_arrays(out + [pa.array(kept_texts, pa.string())] * texts, names=names + ["kept_text"] * texts)

    return f


def repeated_windows(texts: DataFrame, window: int = 35, part: int = PART, fan: int = FAN) -> DataFrame:
    """(did, key, places): the starts of each text's windows whose words also start at another place.

    texts: did, key, text, without nulls. Hash parts follow the bytes of all texts, part for each, not the session's width:
    a part's windows, some 6 bytes of text each, take about 60 bytes of memory each while it is resolved. Up to fan parts,
    a task sends GATHER bytes of text as 2 * fan packed rows at most; over more, windows travel twice, to fan coarse parts
    first and then on to their own ones, so that rows stay kilobytes long. Each of the two rounds ends with a written
    table: the shuffled hashes of the first are gone from the disks when the second writes its own."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part))
    further = -(-parts // fan) if parts > fan else 1
    coarse = -(-parts // further)

    def resolved(rows: DataFrame, n_bytes: int) -> DataFrame:
        if further > 1:
            rows = rows.repartition("part").sortWithinPartitions("part").mapInArrow(split(n_bytes, further, GATHER // 2), PACKED)
        found = rows.groupBy("part").applyInArrow(met(n_bytes), FOUND)
        owned = found.groupBy("piece").applyInArrow(named, "did bigint, key bigint, places array<int>")
        return keep(owned.groupBy("did", "key").agg(F.flatten(F.collect_list("places")).alias("places")))

    hits = resolved(texts.mapInArrow(anchors(window, coarse), PACKED), 5)
    return resolved(texts.join(hits, ["did", "key"]).mapInArrow(extensions(window, coarse), PACKED), 16)


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 35, with_text: bool = False, carry: list[Column] | None = None, part: int = PART, fan: int = FAN) -> DataFrame:
    """One row per input row: doc_id, columns to carry, n_words, n_removed, kept_sha256 and, with_text, kept_text, which is
    the text itself where nothing goes.

    A word goes if a window of ``window`` consecutive words covers it whose word sequence also starts at another place,
    in any text, the same one included; windows are judged on the input. Kept words are joined by one space.
    Null and empty texts have no words, and the hash of the empty text. Texts shorter than the window lose nothing.
    Rows repeated with the same id and text count as two places each, so they lose all words if a window fits, and are
    looked at once however many they are. A null id stays
    null. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), *(carry or []))
    carried = [c for c in texts.columns if c not in ("doc_id", "text")]
    kinds = dict(texts.dtypes)
    texts = texts.withColumns({"did": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), "key": F.xxhash64("doc_id", "text")})
    # of rows alike in id and text one goes on, as all their windows repeat: its places would be every row's, and theirs its
    twice = keep(texts.groupBy("did", "key").agg(F.count("*").alias("n")).where("n > 1").select("did", "key", F.lit(True).alias("twice")))
    once = texts.select("did", "key", "text")
    if not twice.isEmpty():
        one = once.join(twice, ["did", "key"], "left_semi").dropDuplicates(["did", "key"])
        once = once.join(twice, ["did", "key"], "left_anti").unionByName(one)
    found = repeated_windows(once, window, part, fan)
    schema = "".join(f"{c} {kinds[c]}, " for c in ("doc_id", *carried)) + "n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    known = texts.join(found, ["did", "key"], "left").join(twice, ["did", "key"], "left")
    return known.select("doc_id", *carried, "text", "places", "twice").mapInArrow(removal(window, with_text), schema)
