"""Periodic runs of words, found in a grammar of the text.

Re-Pair, in rounds, over all texts of a batch at once: of the pairs of neighbouring symbols that a text holds twice or
more, those that are more frequent than the pairs they overlap become nonterminals, until none is left; the symbols that
remain are tied pairwise into one tree. A run lies inside the least tree node that holds it and crosses the place where
that node's halves meet. So runs are computed once for each nonterminal, across its boundary, and translated to all the
places that derive it; intervals of one period that lie in others are dropped.

At a boundary, a run of period q with four or more periods has two whole periods on one side. Their first K words, with K
the power of four next below q, stand again q words on, so repeated K-grams inside the node are the only periods to try.
A run's ends follow by doubling from hashes of 1, 2, 4, ... words. Equality of words and of K-grams inside one text is
equality of 64-bit hashes.

A run holds four words that stand three times or more, so texts without such go without a grammar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import mixed, pieces, raw, text_of
from loamline.llm.quality import BLANKS, let

MIN_LENGTH, MIN_PERIODS = 6, 4
SOME = 1 << 20
Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


class Words:
    """Hashed words of some texts, one text after the other, and hashes of 2, 4, 8, ... consecutive ones."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.ends = np.cumsum(counts)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        # a text's number goes into its hashes: texts have no words in common
        self.grams = [mixed(hashes, self.doc.astype(np.uint64))]
        while 2 << len(self.grams) - 1 <= max(counts, default=0):
            one, step = self.grams[-1], 1 << len(self.grams) - 1
            self.grams.append(mixed(one[:-step], one[step:]))

    def forward(self, i: np.ndarray, q: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many words from i on equal the ones q further on, those before hi."""
        f = np.zeros(len(i), np.int64)
        for j in range(len(self.grams) - 1, -1, -1):
            at = np.flatnonzero(i + f + q + (1 << j) <= hi)
            x = i[at] + f[at]
            f[at[self.grams[j][x] == self.grams[j][x + q[at]]]] += 1 << j
        return f

    def backward(self, i: np.ndarray, q: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """How many words before i equal the ones q further on, those from lo."""
        g = np.zeros(len(i), np.int64)
        for j in range(len(self.grams) - 1, -1, -1):
            at = np.flatnonzero(i - g - (1 << j) >= lo)
            x = i[at] - g[at] - (1 << j)
            g[at[self.grams[j][x] == self.grams[j][x + q[at]]]] += 1 << j
        return g


def grammar(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All nodes of the trees that derive the texts: symbol, first word, first word of the right half, and end."""
    _, symbol = np.unique(symbols, return_inverse=True)
    start = np.arange(len(symbol))
    end = start + 1
    fresh, known, nodes = len(symbol), {}, []

    def joined(left: np.ndarray, names: np.ndarray) -> None:
        """The symbols at left and right of them become one."""
        nonlocal symbol, start, end, doc
        nodes.append((names, start[left], end[left], end[left + 1]))
        stays = np.ones(len(symbol), bool)
        stays[left + 1] = False
        symbol, end = symbol.copy(), end.copy()
        symbol[left], end[left] = names, end[left + 1]
        symbol, start, end, doc = symbol[stays], start[stays], end[stays], doc[stays]

    while len(symbol) > 1:
        code = (symbol[:-1] << 31) | symbol[1:]
        pairs = np.flatnonzero(doc[1:] == doc[:-1])
        found, which, counts = np.unique(code[pairs], return_inverse=True, return_counts=True)
        if not len(found) or counts.max() < 2:
            break
        # the more frequent pair goes first, of equals any, but the same everywhere
        rank = np.empty(len(found), np.int64)
        rank[np.lexsort((mixed(found.astype(np.uint64), found.astype(np.uint64)), counts))] = np.arange(len(found))
        weight = np.full(len(code), -1, np.int64)
        weight[pairs] = np.where(counts[which] > 1, rank[which], -1)
        # of pairs that overlap themselves, as in "a a a a", every other one
        first = np.flatnonzero(np.concatenate([[True], weight[1:] != weight[:-1]]))
        own = weight[first]
        around = np.maximum(np.concatenate([[-1], own[:-1]]), np.concatenate([own[1:], [-1]]))
        lengths = np.diff(np.append(first, len(weight)))
        within = np.arange(len(weight)) - np.repeat(first, lengths)
        left = np.flatnonzero(np.repeat(own > around, lengths) & (within % 2 == 0))
        chosen, which = np.unique(code[left], return_inverse=True)
        names = np.array([known.setdefault(c, fresh + k) for k, c in enumerate(chosen.tolist())], np.int64)
        fresh += len(chosen)
        joined(left, names[which])
    while len(symbol) > 1:
        heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        within = np.arange(len(doc)) - np.repeat(heads, np.diff(np.append(heads, len(doc))))
        left = np.flatnonzero((within[:-1] % 2 == 0) & (doc[1:] == doc[:-1]))
        if not len(left):
            break
        joined(left, fresh + np.arange(len(left)))
        fresh += len(left)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*nodes, strict=True)) if nodes else (none, none, none, none)


def candidates(words: Words, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, anchor, period) of the runs that may cross boundaries: if there is one, the words before and from the anchor
    on equal those a period further on as far as it reaches."""
    n = len(words.grams[0])
    at, j, longest = np.arange(n), 0, int((hi - lo).max(initial=0))
    while 4 << 2 * j <= longest and 2 * j < len(words.grams):
        k, grams = 1 << 2 * j, words.grams[2 * j]
        at = at[at < len(grams)]
        _, which, counts = np.unique(grams[at], return_inverse=True, return_counts=True)
        more = counts[which] > 1
        at, which = at[more], which[more]
        if not len(at):
            return
        group = np.full(n + 1, -1, np.int64)
        group[at] = which
        key = np.sort(which * (n + 1) + at)
        most = np.minimum(4 * k - 1, (hi - lo) // MIN_PERIODS)
        for right in (True, False):
            anchor = mid if right else mid - k
            side = np.minimum(most, (hi - mid if right else mid - lo) // 2)
            some = np.flatnonzero((side >= k) & (anchor >= 0))
            some = some[group[anchor[some]] >= 0]
            base = group[anchor[some]] * (n + 1) + anchor[some]
            near, far = (base + k, base + side[some]) if right else (base - side[some], base - k)
            a, b = np.searchsorted(key, near, "left"), np.searchsorted(key, far, "right")
            total = np.cumsum(b - a)
            cut = 0
            while cut < len(some):  # so many candidates at a time, or one node's
                to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + SOME, "right")))
                times = (b - a)[cut:to]
                if times.sum():
                    place = np.repeat(a[cut:to] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    q = np.abs(key[place] - np.repeat(base[cut:to], times))
                    node = np.repeat(some[cut:to], times)
                    yield node, (mid[node] if right else mid[node] - q), q
                cut = to
        j += 1


def crossing(words: Words, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, Spans]:
    """Node, and start, end and period, of the runs across boundaries; some periods may be multiples of the least one."""
    parts = []
    for node, anchor, q in candidates(words, lo, mid, hi):
        start = anchor - words.backward(anchor, q, lo[node])
        end = anchor + q + words.forward(anchor, q, hi[node])
        good = end - start >= np.maximum(MIN_LENGTH, MIN_PERIODS * q)
        parts.append(np.stack([node, q, start, end])[:, good])
    found = np.concatenate([np.zeros((4, 0), np.int64), *parts], axis=1)
    node, q, start, end = found[:, np.lexsort(found[1::-1])]
    # most multiples lie in the run of a node's least period
    _, first, which = np.unique(node, return_index=True, return_inverse=True)
    least = first[which]
    good = (q == q[least]) | (start < start[least]) | (end > end[least])
    return node[good], (start[good], end[good], q[good])


def prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] * (n > 1)


def merged(words: Words, spans: Spans) -> Spans:
    """Each maximal run once, by text, start and period, with its least period."""
    start, end, q = spans
    order = np.lexsort((-end, start, q, words.doc[start]))
    start, end, q = start[order], end[order], q[order]
    doc, n = words.doc[start], len(words.doc) + 1
    group = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (q[1:] != q[:-1])])[: len(q)])
    reach = np.maximum.accumulate(end + group * n)
    new = np.concatenate([[True], reach[1:] > reach[:-1]])[: len(q)]
    start, end, q = start[new], end[new], q[new]
    # a period that isn't the least one is a multiple of it, so some prime part of it is a period too
    factors = {k: prime_factors(k) for k in np.unique(q).tolist()}
    run = np.array([i for i, k in enumerate(q.tolist()) for _ in factors[k]], np.int64)
    part = np.array([k // f for k in q.tolist() for f in factors[k]], np.int64)
    smaller = run[words.forward(start[run], part, end[run]) >= end[run] - start[run] - part] if len(run) else run
    least = np.ones(len(q), bool)
    least[smaller] = False
    start, end, q = start[least], end[least], q[least]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def runs_of(words: Words) -> Spans:
    """Start, end and period of all runs, by start and period; words count through all texts."""
    symbol, lo, mid, hi = grammar(words.grams[0], words.doc)
    if not len(symbol):
        none = np.zeros(0, np.int64)
        return none, none, none
    order = np.argsort(symbol, kind="stable")
    names, first, times = np.unique(symbol[order], return_index=True, return_counts=True)
    one = order[first]  # a nonterminal is looked at where it stands first
    node, (start, end, q) = crossing(words, lo[one], mid[one], hi[one])
    # and what was found there holds wherever it is derived
    many = times[node]
    run = np.repeat(np.arange(len(node)), many)
    place = order[np.repeat(first[node] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    move = lo[place] - lo[one][node[run]]
    return merged(words, (start[run] + move, end[run] + move, q[run]))


def found_in(texts: list[list[bytes]]) -> tuple[np.ndarray, Spans]:
    """For words of texts: how many runs each text has, and start (in its text), length and period of all."""
    sizes = np.array([len(w) for w in texts], np.int64)
    hashes = np.fromiter((hash(w) for words in texts for w in words), np.int64, int(sizes.sum())).view(np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    four = mixed(hashes, doc.astype(np.uint64))
    for step in (1, 2):
        four = mixed(four[:-step], four[step:]) if len(four) > step else four[:0]
    _, which, counts = np.unique(four, return_inverse=True, return_counts=True)
    maybe = np.zeros(len(texts), bool)
    maybe[doc[np.flatnonzero(counts[which] > 2)] if len(four) else []] = True
    words = Words(hashes[maybe[doc]], sizes[maybe])
    start, end, q = runs_of(words)
    own = words.doc[start]
    counts = np.zeros(len(texts), np.int64)
    counts[maybe] = np.bincount(own, minlength=int(maybe.sum()))
    return counts, (start - (words.ends - sizes[maybe])[own], end - start, q)


def detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ("start", "length", "period")
    for whole in batches:
        for b in pieces(whole, "text", 1 << 20):
            data, offsets = raw(b["text"])
            blob = data.tobytes()
            texts = [blob[x:y].split() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            counts, spans = found_in(texts)
            kept, at = [], np.concatenate([[0], np.cumsum(counts)])
            for k, words in enumerate(texts):
                if counts[k]:
                    start, length, period = (x[at[k] : at[k + 1]] for x in spans)
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, start + period, 1)
                    np.add.at(change, start + length, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                kept.append(b" ".join(words))
            runs = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in spans], names=list(fields)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(w) for w in texts], pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "kept_text"])


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length and period in words, by start and period), kept_text.

    Words part at white space and are numbered from 0. A run is a stretch of words with least period q (words q apart are
    the same) of at least max(6, 4 q) words that no neighbouring word extends. kept_text: the words that no run holds
    beyond its first q ones, joined by one space. Null, empty and blank texts have no words, no runs and an empty kept_text.
    Repeated rows, null ids and further columns of any name change nothing; an empty table gives an empty result. Texts are
    worked on whole, a megabyte at a time or one longer text; a text with runs takes some 30 times its own size meanwhile.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(detected, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept_text string")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (length / period, ties to the first by start and period; no run:
    nulls) with exponent_milli, the exponent's thousandths, and the SHA-256 of all runs and of the kept text."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    best = F.aggregate("runs", none, lambda a, r: F.when(better(a, r), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) DIV best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


def with_repeats(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the documents (by the checksum of the id) one that becomes periodic from some word on.
    A null id's text stays as it is."""

    def periodic(words: Column) -> Column:
        n, g = F.size(words).cast("bigint"), F.floor(h / 10).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("bigint")
        changed = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.element_at(words, (F.lit(1) + a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(changed, " ")).otherwise("")

    h = F.crc32(doc_id.cast("string").cast("binary"))
    return F.when(h % 10 == 0, let(F.filter(F.split(text, BLANKS), lambda w: w != ""), periodic)).otherwise(text)
