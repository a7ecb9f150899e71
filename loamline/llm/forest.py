"""Near-duplicates by Jaccard similarity through an LSH forest of MinHash signatures.

Each of 64 trees orders the shingle sets by a label of its own, a row of minimal hashes. Two sets agree in one of those
as often as they are alike, so the first ``depth`` of them are equal, in some tree, for a pair at the threshold with a
chance of all but 1e-8 (and more surely above it). A region is what shares so long a prefix in one tree. The labels go
on: where a region is crowded, the depth at which neighbours in the order meet grows by itself, since neighbours share
the longest prefixes. So links are found from the deep end up:

1. Every set meets its nearest neighbour in the orders, the one that precedes it most often, and the hub of its regions,
   which is the set that shares most places with others. That ties groups of copies, dense ones and those whose copies
   are like one original only, by two pairs a set at most.
2. What then lies in one region but in different components is compared there, whole, with all others: a region's rows
   that aren't of its largest component meet each other and the largest's, in blocks, so no task holds more than two
   blocks. Sketches that bound what two sets have in common decide inside the task; a pair leaves it only if it may be
   a link.

Every pair is confirmed on the whole sets. Trees are sorted by range, so that a third of all rows in one region is dealt
to as many tasks as its size asks for. Equality of shingles, and of regions, is equality of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import keep, mixed, pieces, raw, text_of, width, written
from loamline.llm.components import components

SEED = 42
TREES, FURTHER = 64, 4
#: How many shingles meet all hash functions at a time, rows of a region in a block, and pairs at a time in a block.
STEP, BLOCK, SOME = 512, 512, 1 << 18


def depth_for(num: int, den: int) -> int:
    """The longest prefix that a pair at num/den shares in one tree with a chance of a quarter: of 64 trees, all miss it
    with a chance of 0.75 ** 64 = 1e-8."""
    return max(1, int(math.log(0.25) / math.log(num / den))) if num < den else 8


def lowered_words(column: pa.Array) -> list[list[bytes]]:
    data, offsets = raw(column)
    lowered = data.tobytes().lower()
    return [lowered[x:y].split() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def represented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's hash of its words in lower case."""
    for whole in batches:
        for b in pieces(whole, "text", 1 << 20):
            reps = np.array([xxhash.xxh3_64_intdigest(b" ".join(w), SEED) for w in lowered_words(b["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(reps.view(np.int64)), b["text"]], names=["doc_id", "rep", "text"])


def shingle_sets(texts: list[list[bytes]], size: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, hashed and sorted; fewer words than size are one shingle, no words none."""
    known = {w: xxhash.xxh3_64_intdigest(w, SEED) for w in {w for words in texts for w in words}}
    for words in texts:
        n = len(words)
        own = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        short = min(n, size)
        out = own[: max(n - size, 0) + (n > 0)]
        for k in range(1, short):
            out = mixed(out, own[k : k + len(out)])
        yield np.unique(mixed(out, np.full(len(out), short, np.uint64)))


def signatures(sets: Iterator[np.ndarray], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each set the region it falls into in every tree, and what follows in its label; nothing for an empty set."""
    multipliers = np.random.default_rng(SEED).integers(0, 1 << 32, (TREES * (depth + FURTHER), 1), np.uint32) | np.uint32(1)
    for own in sets:
        if not len(own):
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        x, least = (own >> np.uint64(32)).astype(np.uint32), None
        for at in range(0, len(x), STEP):
            part = (multipliers * x[at : at + STEP]).min(axis=1)
            least = part if least is None else np.minimum(least, part)
        label = least.reshape(TREES, depth + FURTHER).astype(np.uint64)
        region = np.arange(TREES, dtype=np.uint64)
        for k in range(depth):
            region = mixed(region, label[:, k])
        deep = np.zeros(TREES, np.uint64)
        for k in range(depth, depth + FURTHER):
            deep = (deep << np.uint64(16)) | (label[:, k] >> np.uint64(16))
        yield region.view(np.int64), deep.view(np.int64)


def slots(n: int) -> int:
    """How many slots a sketch of n shingles has: a power of two, so that sketches of other lengths fold onto each other."""
    return 1 << max(3, (n // 2).bit_length())


def sketch(own: np.ndarray) -> np.ndarray:
    """How many shingles fall into each slot, a byte each; 255 stands for any count from there."""
    m = slots(len(own))
    return np.minimum(np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m), 255).astype(np.uint8)


def folded(sketches: list[np.ndarray], m: int) -> np.ndarray:
    """Sketches of m slots or more, as rows of m slots."""
    out = np.empty((len(sketches), m), np.int32)
    for k, s in enumerate(sketches):
        s = s.astype(np.int32)
        s[s == 255] = 1 << 24
        out[k] = s if len(s) == m else np.minimum(s.reshape(-1, m).sum(axis=0), 1 << 24)
    return out


def common_at_most(sketches: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of what the sets of each pair of positions have in common: slot by slot the lesser count."""
    lengths = np.array([len(s) for s in sketches], np.int64)
    least, out = np.minimum(lengths[a], lengths[b]), np.zeros(len(a), np.int64)
    for m in np.unique(least).tolist():
        pairs = np.flatnonzero(least == m)
        rows = np.unique(np.concatenate([a[pairs], b[pairs]]))
        step = max(1, (1 << 22) // m)
        if len(rows) <= step:
            flat = folded([sketches[r] for r in rows.tolist()], m)
            for at in range(0, len(pairs), step):
                some = pairs[at : at + step]
                out[some] = np.minimum(flat[np.searchsorted(rows, a[some])], flat[np.searchsorted(rows, b[some])]).sum(axis=1)
        else:  # very long texts: pair by pair
            for p in pairs.tolist():
                x, y = folded([sketches[a[p]], sketches[b[p]]], m)
                out[p] = np.minimum(x, y).sum()
    return out


def signed(size: int, depth: int):
    """rep, n (size of the set), sketch, and the regions and the rest of the labels by tree."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", 1 << 20):
                sets = list(shingle_sets(lowered_words(b["text"]), size))
                regions, deeps = zip(*signatures(iter(sets), depth), strict=True)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in regions])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (regions, deeps)]
                yield pa.RecordBatch.from_arrays([b["rep"], pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s).tobytes() for s in sets], pa.binary()), *lists], names=["rep", "n", "sketch", "regions", "deeps"])

    return f


def in_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows by region and label those that others share the region with, or may share it with beyond the ends of
    these rows, each with the one before it."""
    held = None  # the last row so far, whose next one isn't known
    for b in batches:
        region, rep = np.asarray(b["region"]), np.asarray(b["rep"])
        if held:
            region, rep = np.concatenate([held[0], region]), np.concatenate([held[1], rep])
        if not len(region):
            continue
        like = np.concatenate([[held[2] if held else True], region[1:] == region[:-1]])  # the very first row: not known
        before = np.concatenate([[held[3] if held else 0], rep[:-1]])
        has = like.copy()
        has[0] = bool(held and held[2] and held[4])
        good = (like[:-1] | like[1:]) if len(like) > 1 else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(region[:-1][good]), pa.array(rep[:-1][good]), pa.array(before[:-1][good], mask=~has[:-1][good])], names=["region", "rep", "before"])
        held = region[-1:], rep[-1:], bool(like[-1]), before[-1], bool(has[-1])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array([held[3] if held[4] else None], pa.int64())], names=["region", "rep", "before"])


def possible(num: int, den: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.stack([np.asarray(b["n_a"]), np.asarray(b["n_b"])]).astype(np.int64)
            both = [np.frombuffer(s, np.uint8) for c in ("sketch_a", "sketch_b") for s in b[c].to_pylist()]
            at = np.arange(b.num_rows)
            good = (num + den) * common_at_most(both, at, at + b.num_rows) >= num * n.sum(axis=0)
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return f


def verified(size: int, num: int, den: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text_a", 1 << 20):
                good = []
                x, y = (shingle_sets(lowered_words(b[c]), size) for c in ("text_a", "text_b"))
                for s, t in zip(x, y, strict=True):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    good.append(den * both >= num * (len(s) + len(t) - both))
                yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return f


def compared(num: int, den: int):
    """From rows by block (region, i, j) the pairs that may be links. Each block is held whole: two BLOCKs of rows."""

    def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([np.asarray(t[c]).astype(np.int64) for c in ("region", "i", "j")])
        rep, root, n, main = (np.asarray(t[c]).astype(np.int64) for c in ("rep", "root", "n", "main"))
        sketches = [np.frombuffer(s, np.uint8) for s in t["sketch"].to_pylist()]
        heads = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        end = np.repeat(np.append(heads[1:], len(rep)), np.diff(np.append(heads, len(rep))))
        later = end - np.arange(len(rep)) - 1
        total, at = np.cumsum(later), 0
        while at < len(rep):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SOME, "right")))
            times = later[at:to]
            a = np.repeat(np.arange(at, to), times)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
            at = to
            # blocks of the largest component compare their other rows with each other in the first one only
            own = (main[a] != main[b]) | (main[a] + main[b] == 0) & (key[1, a] <= 0)
            good = (root[a] != root[b]) & own & (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b]))
            a, b = a[good], b[good]
            good = (num + den) * common_at_most(sketches, a, b) >= num * (n[a] + n[b])
            x, y = rep[a[good]], rep[b[good]]
            found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < 4 * BLOCK:
                continue
            t = pa.Table.from_batches(held)
            key = np.stack([np.asarray(t[c]).astype(np.int64) for c in ("region", "i", "j")])
            last = int(np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))[-1])
            if last:  # the last block may go on
                yield from pairs_of(t.slice(0, last))
                held = t.slice(last).combine_chunks().to_batches()
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    return f


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows (region, rep, root, ...) of regions with several roots, by blocks (i, j). main marks those of the region's
    largest root: a block of them meets each block of the others; two blocks of others meet under a negative i."""
    sizes = keep(rows.groupBy("region", "root").agg(F.count("*").alias("c")))
    regions = sizes.groupBy("region").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("all")).where("all > most.c")
    regions = keep(regions.select("region", F.col("most.root").alias("most"), F.ceil(F.col("most.c") / block).cast("int").alias("nm"), F.ceil((F.col("all") - F.col("most.c")) / block).cast("int").alias("no")))
    known = rows.join(regions, "region").withColumn("main", F.col("root") == F.col("most"))
    part = F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("nm")).otherwise(F.col("no"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    of_main = F.transform(upto(F.col("no")), lambda j: F.struct(F.col("part").alias("i"), j.alias("j")))
    with_main = F.transform(upto(F.col("nm")), lambda i: F.struct(i.alias("i"), F.col("part").alias("j")))
    others = F.transform(F.filter(upto(F.col("no")), lambda x: x != F.col("part")), lambda x: F.struct((-1 - F.least(x, "part")).alias("i"), F.greatest(x, "part").alias("j")))
    keys = F.explode(F.when(F.col("main"), of_main).otherwise(F.concat(with_main, others))).alias("key")
    return known.withColumn("part", part).select("region", *(c for c in rows.columns if c != "region"), F.col("main").cast("int").alias("main"), keys).select("*", "key.*").drop("key")


def labels_of(base: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Size, sketch and label of the shingle set of each row of base (rep, text)."""
    return written(base.mapInArrow(signed(size, depth_for(num, den)), "rep bigint, n int, sketch binary, regions array<bigint>, deeps array<bigint>"))


def similar_links(base: DataFrame, labels: DataFrame, size: int, num: int, den: int, more: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that have the components of all pairs of base's reps at num/den or more. base: rep, text, a row for each
    rep; labels: labels_of it. more: further pairs (a, b) to try first. A pair at the threshold is missed with a chance of
    1e-8 (see above)."""
    sketches = labels.select("rep", "n", "sketch")

    def both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        a, b = (table.select(F.col("rep").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns)) for c in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", *(f"{x}_{c}" for x in columns for c in "ab"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        some = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
        return written(both(pairs, base.join(some, "rep", "left_semi"), "text").mapInArrow(verified(size, num, den), "a bigint, b bigint"))

    rows = labels.select("rep", F.inline(F.arrays_zip("regions", "deeps"))).withColumnsRenamed({"regions": "region", "deeps": "deep"})
    order = ["region", "deep", "rep"]
    places = written(rows.repartitionByRange(width(base.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(in_company, "region bigint, rep bigint, before bigint"))
    sizes = keep(places.groupBy("region").agg(F.count("*").alias("size")).where("size > 1"))
    places = written(places.join(sizes, "region"))

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    near = places.where("before IS NOT NULL").groupBy("rep", "before").agg(F.count("*").alias("times")).groupBy("rep").agg(F.max(F.struct("times", "before"))["before"].alias("other"))
    mass = keep(places.groupBy("rep").agg(F.sum("size").alias("mass")))
    hubs = keep(places.join(mass, "rep").groupBy("region").agg(F.max(F.struct("mass", "rep")).alias("hub")))
    hub = places.join(hubs, "region").groupBy("rep").agg(F.max("hub")["rep"].alias("other")).where("rep <> other")
    first = near.unionByName(hub).select(*ordered("rep", "other"))
    if more is not None:
        first = first.unionByName(more.select(*ordered("a", "b")))
    tried = keep(both(keep(first.distinct()), sketches, "n", "sketch").mapInArrow(possible(num, den), "a bigint, b bigint"))
    links = confirmed(tried)

    tied = written(components(links))
    labelled = places.join(tied, places["rep"] == tied["node"], "left").select("region", "rep", F.coalesce("root", "rep").alias("root"))
    several = labelled.groupBy("region").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("region")
    rest = written(labelled.join(several, "region", "left_semi"))
    blocks = dealt(rest, block).join(sketches, "rep")
    keys = ["region", "i", "j"]
    blocks = blocks.repartition(width(base.sparkSession), *keys).sortWithinPartitions(*keys)
    pairs = blocks.select(*keys, "rep", "root", "n", "main", "sketch").mapInArrow(compared(num, den), "a bigint, b bigint").distinct()
    return links.unionByName(confirmed(keep(pairs.join(tried, ["a", "b"], "left_anti"))))


def minhash_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A-Z become lower case, words part at white space; a text's set holds its distinct shingles of ``shingle`` words (fewer
    words: the whole sequence as one). Texts whose sets have num/den of their union in common are linked; component_id is
    the least doc_id that links reach, the row's own included; kept says whether that is the row's own. Null, empty and
    blank texts have the empty set and are linked with nothing, not even each other. A null id takes part without being
    the least; a component of null ids only has the id null and is kept. Repeated rows come out as often as they come in.
    Other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    found = texts.mapInArrow(represented, f"doc_id {kind}, rep bigint, text string")
    prints = keep(found.select("doc_id", "rep"))
    base = written(found.select("rep", "text").dropDuplicates(["rep"]))
    labels = labels_of(base, shingle, num, den)
    tied = written(components(similar_links(base, labels, shingle, num, den)))
    sizes = labels.select("rep", F.col("n").cast("bigint").alias("n"))
    least = prints.groupBy("rep").agg(F.min("doc_id").alias("least")).join(sizes, "rep")
    classes = keep(least.join(tied, least["rep"] == tied["node"], "left").select("rep", F.coalesce("root", "rep").alias("root"), "least", "n"))
    roots = classes.where("n > 0").groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = keep(classes.join(roots, "root", "left").select("rep", "component_id", F.col("n").alias("n_shingles")))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return prints.join(labelled, "rep").select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
