"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints are sorted by Gray rank, in which neighbours differ in few bits, and cut into groups of about equal size.
A group's node holds what its members share: a mask of the bits in which all agree, and their pattern; upper nodes hold
what neighbouring groups share, up to the root. A fingerprint descends from there, differences add up on the way, and it
goes to those groups only from whose pattern it differs in at most ``radius`` masked bits. Inside a group
the same is done again and again: each half's node holds the further bits its members share, differences add up on the
way down, and whole halves are dropped as soon as the sum is above the radius. Pairs are met in leaves only, and a task
hands on no more links than a spanning forest of its fingerprints has.

There are up to three such orders, each of the fingerprints turned so that another block of bits leads. Of a pair's
differing bits one block holds no more than its share (none, at a radius of two), so an order looks for pairs with no more
in its leading block than that. As groups are told apart by their leading bits, a fingerprint goes to about as many groups
however many there are; one order alone would send it to more of them, as the square of the number of bits they share.
A pair belongs to the first order that finds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import keep, pieces, raw, text_of
from loamline.llm.components import components

SEED = 42
LEAF = 24


def bits_over_half(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive runs of counts hashes each: the 64 bits that are set in over half of them; 0 for an empty run."""
    out = np.zeros((len(counts), 64), np.int64)
    if len(hashes):
        owner = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
        heads = np.flatnonzero(within % 255 == 0)  # so many ones fit a byte
        for a in range(0, len(heads), 4096):
            b = heads[a + 4096] if a + 4096 < len(heads) else len(hashes)
            bits = np.unpackbits(hashes[heads[a] : b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            np.add.at(out, owner[heads[a : a + 4096]], np.add.reduceat(bits, heads[a : a + 4096] - heads[a], axis=0, dtype=np.uint8))
    return np.packbits(2 * out > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def shingle_hashes(lowered: bytes, size: int) -> list[int]:
    words = lowered.split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), SEED)]
    return [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))]


def fingerprinted(size: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", 1 << 20):
                data, offsets = raw(b["text"])
                lowered, hashes, counts = data.tobytes().lower(), [], []
                for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    h = shingle_hashes(lowered[x:y], size)
                    hashes += h
                    counts.append(len(h))
                fp = bits_over_half(np.array(hashes, np.uint64), np.array(counts, np.int64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(i) for i, c in enumerate(b.schema.names) if c != "text"] + [pa.array(fp)], names=[c for c in b.schema.names if c != "text"] + ["fp"])

    return f


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the Gray sequence: each bit becomes the parity of the bits from the top to it."""
    x = fp.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def about_rank(fp: Column) -> Column:
    """The same as a double, for quantiles."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.cast("double") + F.when(fp < 0, 2.0**64).otherwise(0.0)


def turned(fp: np.ndarray, by: int) -> np.ndarray:
    """The bits turned to the left, so that those behind the first ``by`` lead."""
    return (fp << np.uint64(by)) | (fp >> np.uint64(64 - by)) if by % 64 else fp


def orders_of(radius: int) -> tuple[list[int], list[np.uint64], int]:
    """The places where the blocks of bits begin, each order's leading block as a mask, and how many bits of one block a pair
    at radius bits differs in at most, in one order at least."""
    blocks = min(radius + 1, 3)
    at = [64 * k // blocks for k in range(blocks + 1)]
    return at[:-1], [np.uint64((1 << 64) - (1 << (64 - (y - x)))) for x, y in zip(at[:-1], at[1:], strict=True)], radius // blocks


def near_in_group(members: np.ndarray, probes: np.ndarray, radius: int, lead: np.uint64 = np.uint64(0), share: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links (as positions of members and probes) at radius bits or fewer, of them at most share in lead. members: distinct, in Gray order."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    none = np.zeros(len(probes), np.uint8)
    stack = [(0, len(members), np.uint64(0), np.arange(len(probes)), none, none)]
    while stack:
        a, b, above, at, differ, first = stack.pop()
        own = members[a:b]
        ones, any_one = np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)
        shared = ~(ones ^ any_one)
        gap = (probes[at] ^ ones) & (shared & ~above)
        differ, first = differ + np.bitwise_count(gap), first + np.bitwise_count(gap & lead)
        within = (differ <= radius) & (first <= share)
        at, differ, first = at[within], differ[within], first[within]
        if not len(at):
            continue
        if b - a <= LEAF:
            gap = (probes[at][:, None] ^ own[None, :]) & (full & ~shared)
            p, m = np.nonzero((np.bitwise_count(gap) + differ[:, None] <= radius) & (np.bitwise_count(gap & lead) + first[:, None] <= share))
            left.append(a + m), right.append(at[p])
        else:
            middle = (a + b) // 2
            stack += [(a, middle, shared, at, differ, first), (middle, b, shared, at, differ, first)]
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


class Tree:
    """Upper nodes over groups in Gray order: halves of halves down to LEAF groups, each with what its groups share."""

    def __init__(self, ones: np.ndarray, any_one: np.ndarray):
        self.ones, self.masks = ones, ~(ones ^ any_one)
        self.nodes: list[tuple[int, int, np.uint64, np.uint64, int]] = []  # first and end, pattern, mask, the second half's place

        def grown(a: int, b: int) -> None:
            own, most = np.bitwise_and.reduce(ones[a:b]), np.bitwise_or.reduce(any_one[a:b])
            at = len(self.nodes)
            self.nodes.append((a, b, own, ~(own ^ most), 0))
            if b - a > LEAF:
                grown(a, (a + b) // 2)
                self.nodes[at] = (*self.nodes[at][:4], len(self.nodes))
                grown((a + b) // 2, b)

        if len(ones):
            grown(0, len(ones))

    def near(self, probes: np.ndarray, radius: int, lead: np.uint64 = np.uint64(0), share: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a probe and a group (as positions) that differ in at most radius of the bits that the group shares, and
        in at most share of those in lead."""
        rows: list[np.ndarray] = [np.zeros(0, np.int64)]
        groups: list[np.ndarray] = [np.zeros(0, np.int64)]
        none = np.zeros(len(probes), np.uint8)
        stack = [(0, np.uint64(0), np.arange(len(probes)), none, none)] if self.nodes else []
        while stack:
            node, above, at, differ, first = stack.pop()
            a, b, own, shared, second = self.nodes[node]
            gap = (probes[at] ^ own) & (shared & ~above)
            differ, first = differ + np.bitwise_count(gap), first + np.bitwise_count(gap & lead)
            within = (differ <= radius) & (first <= share)
            at, differ, first = at[within], differ[within], first[within]
            if not len(at):
                continue
            if b - a <= LEAF:
                gap = (probes[at][:, None] ^ self.ones[None, a:b]) & self.masks[None, a:b]
                p, g = np.nonzero((np.bitwise_count(gap) <= radius) & (np.bitwise_count(gap & lead) <= share))
                rows.append(at[p]), groups.append(a + g)
            else:
                stack += [(node + 1, shared, at, differ, first), (second, shared, at, differ, first)]
        return np.concatenate(rows), np.concatenate(groups)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of these links, stars with the same components: each node tied to one of its component."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = code[: len(a)], code[len(a) :], np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root != root[root]).any():
            root = root[root]
        if (before == root).all():
            break
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


class Order:
    """One order of the turned fingerprints: the ranks where its groups are cut, and what each group's members share."""

    def __init__(self, cuts: np.ndarray, radius: int, lead: np.uint64, share: int):
        self.cuts, self.radius, self.lead, self.share = np.unique(cuts), radius, lead, share

    def group_of(self, fp: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, gray_rank(fp).astype(np.float64), side="right").astype(np.int32)

    def told(self, ids: np.ndarray, ones: np.ndarray, any_one: np.ndarray) -> None:
        """The bits that all members of the groups ids have, and that any has."""
        self.ids, self.upper = ids, Tree(ones, any_one)

    def routed(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints, the groups that each goes to, and whether it is its own. A link between groups is found in the later
        one; one inside a group in that group."""
        g = self.group_of(fp)
        row, node = self.upper.near(fp, self.radius, self.lead, self.share)
        later = self.ids[node] >= g[row]
        row, to = row[later], self.ids[node[later]]
        return fp[row], to, g[row] == to


def index_of(fps: DataFrame, n: int, radius: int, group_size: int) -> list[Order]:
    """The orders of n distinct fingerprints, in groups of about group_size."""
    starts, leads, share = orders_of(radius)
    groups = int(min(65536, max(16, n // group_size)))  # at most as many nodes an order are sent to all tasks: 1.5 MB each

    # cuts at quantiles of the rank; any cuts give right results, even ones give even groups
    ranks = {f"r{k}": about_rank(F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) if s else F.col("fp")) for k, s in enumerate(starts)}
    cuts = fps.select(*(r.alias(c) for c, r in ranks.items())).approxQuantile(list(ranks), [i / groups for i in range(1, groups)], 0.5 / groups)
    orders = [Order(np.array(c, np.float64), radius, lead, share) for c, lead in zip(cuts, leads, strict=True)]

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, o in enumerate(orders):
                fp = turned(np.asarray(b["fp"]).view(np.uint64), starts[k])
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(o.group_of(fp) | np.int32(k << 16))], names=["fp", "g"])

    nodes = fps.select("fp").mapInArrow(grouped, "fp bigint, g int").groupBy("g").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any")).toPandas().sort_values("g")
    g = nodes["g"].to_numpy(np.int32)
    ones, any_one = (nodes[c].to_numpy(np.int64).view(np.uint64) for c in ("ones", "any"))
    for k, o in enumerate(orders):
        o.told(g[g >> 16 == k] & np.int32(0xFFFF), ones[g >> 16 == k], any_one[g >> 16 == k])
    return orders


def links_of(fps: DataFrame, radius: int, group_size: int) -> DataFrame:
    """Links (a, b) that have the components of all pairs of distinct fingerprints at radius bits or fewer."""
    spark = fps.sparkSession
    n = fps.count()
    if n < 2:
        return spark.createDataFrame([], "a bigint, b bigint")
    starts, leads, share = orders_of(radius)
    orders = index_of(fps, n, radius, group_size)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 14):
                fp = np.asarray(whole.slice(at, 1 << 14)["fp"]).view(np.uint64)
                for k, o in enumerate(orders):
                    x, g, member = o.routed(turned(fp, starts[k]))
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(g | np.int32(k << 16)), pa.array(member)], names=["fp", "g", "member"])

    def linked(table: pa.Table) -> pa.Table:
        k = table["g"][0].as_py() >> 16
        fp, member = np.asarray(table["fp"]).view(np.uint64), np.asarray(table["member"])
        members = fp[member]
        members = members[np.argsort(gray_rank(members))]
        out = []
        others = np.concatenate([members, fp[~member]])
        for at in range(0, len(others), 1 << 16):
            probes = others[at : at + (1 << 16)]
            m, p = near_in_group(members, probes, radius, leads[k], share)
            a, b = turned(members[m], 64 - starts[k]), turned(probes[p], 64 - starts[k])
            own = a != b
            for j in range(k):  # pairs that an order before this one finds
                own &= np.bitwise_count(turned(a ^ b, starts[j]) & leads[j]) > share
            out.append(forest(a[own].view(np.int64), b[own].view(np.int64)))
        a, b = forest(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)))
        return pa.table({"a": a, "b": b})

    # one Python operator a stage: workers stay alive, and each holds what it has loaded
    return fps.select("fp").mapInArrow(routed, "fp bigint, g int, member boolean").groupBy("g").applyInArrow(linked, "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, radius: int = 2, group_size: int = 2048) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    A-Z become lower case, words part at white space, shingles of ``shingle`` words count with repeats (fewer words: the
    whole sequence). Null, empty and blank texts have the fingerprint zero, which is linked like any other. Fingerprints
    at ``radius`` differing bits or fewer are linked; component_id is the least doc_id that links reach, the row's own
    included. Equal fingerprints meet as one; a null id takes part without being the least, and a component of null ids
    only has the id null. Repeated rows come out as often as they come in. Other columns are ignored. An empty table
    gives an empty result.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    prints = keep(texts.mapInArrow(fingerprinted(shingle), f"doc_id {kind}, fp bigint"))
    least = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tied = components(links_of(least.select("fp"), radius, group_size))
    classes = least.join(tied, least["fp"] == tied["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = classes.join(roots, "root").select("fp", "component_id")
    return prints.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
