"""Exact top-k inner products by a pivot-distance index.

Inner products become distances when every vector gets one more component that brings all to the same length, and
queries get zero there: the greater the product, the nearer the point. Points are keyed by their nearest pivot and their
distance from it, sorted, and packed into blocks of rows of one ring (a pivot and a range of distances). For a query, the
triangle inequality bounds what any point of a ring can score: its distance is at least the gap between the query's own
distance from that pivot and the ring.

A query first scores its home ring, the one in which it would lie itself; its k-th best score there is a floor. It is then
sent to those rings only whose bound reaches its floor, nearest annuli and further ones alike, and the expansion stops
where the bounds fall below. Rings are a table of bounded length (pivots times annuli). Queries travel in packs, and
meet blocks of rows, never single rows. No ring, however full, is held as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamline.llm.common import keep, width

BLOCK = 1024
PACK = 256
#: Blocks of a ring that one key of the join holds.
PART = 64
#: Stands for all scores below what fits a long.
LEAST = 1 - (1 << 63)


def quantized(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component; vectors that are null or not finite are left out. An empty one is
    the vector 0."""
    v = F.col(vector_column).cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.coalesce(usable, F.lit(False)) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("vec_id"), F.when(F.size(v) > 0, F.transform(v, lambda x: F.floor(x * float(scale)).cast("double"))).otherwise(F.array(F.lit(0.0))).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros, which change no product."""
    sizes, values = np.diff(np.asarray(column.offsets)), np.asarray(column.flatten(), np.float64)
    if (sizes == dim).all():
        return values.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def raised(x: np.ndarray, length2: float) -> np.ndarray:
    """Points of one more dimension, all of the same length."""
    return np.hstack([x, np.sqrt(np.maximum(length2 - (x * x).sum(axis=1), 0))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T, 0))


def far_apart(sample: np.ndarray, n: int, steps: int = 8) -> np.ndarray:
    """Pivots: points of the sample far from each other, then moved to the means of what lies nearest to them."""
    chosen = [0]
    nearest = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(sample, sample[chosen[-1] :][:1])[:, 0])
    pivots = sample[chosen].copy()
    for _ in range(steps):
        home = distances(sample, pivots).argmin(axis=1)
        for k in range(len(pivots)):
            if (home == k).any():
                pivots[k] = sample[home == k].mean(axis=0)
    return pivots


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", query_id: str = "vec_id", scale: int = 256, pivots: int = 32, annuli: int = 8, sample: int = 8192) -> DataFrame:
    """For every query its k best rows by inner product of the quantized vectors: query_id, rank, vec_id, score.

    A row never answers a query of its own id. Ties go to the lesser id. Queries with fewer than k rows get them all.
    Pivots are fitted on ``sample`` rows with the least hashes of their ids; every row is indexed and the results don't
    depend on the pivots. Null and not finite vectors, and null ids, take no part; vectors of unequal lengths meet as if
    zeros filled them up, empty ones too. Repeated rows are rows of their own. Products are taken in doubles where these
    are exact and in 64-bit integers beyond; only one that doesn't fit a long and is too large, or among a block's k best, is
    refused with an error. Other columns are ignored. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    none = "query_id bigint, rank int, vec_id bigint, score bigint"
    points = quantized(vectors, id_column, vector_column, scale)
    # the longest vector, its length and the least hashed rows: the index's only facts about all rows
    facts = points.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("length2"), F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    if facts.dim is None:
        return spark.createDataFrame([], none)
    dim, length2 = facts.dim, facts.length2
    if facts.top >= 1 << 63:
        raise ValueError("a component doesn't fit a long")
    # sums of 64-bit products are right whenever the score itself fits, however far they run over on the way
    wide = dim * facts.top**2 >= 1 << 63
    stored = "<i2" if facts.top < 1 << 15 else "<i4" if facts.top < 1 << 31 else "<i8"
    exact = np.float64 if dim * facts.top**2 < 1 << 53 else np.int64
    fitted = points.orderBy(F.xxhash64("vec_id")).limit(sample).select("v").toArrow()["v"].combine_chunks()
    centres = far_apart(raised(matrix(fitted, dim), length2), pivots)
    sampled = distances(raised(matrix(fitted, dim), length2), centres)
    edges = np.unique(np.quantile(sampled.min(axis=1), np.linspace(0, 1, annuli + 1)[1:-1]))
    per_pivot = len(edges) + 1

    def placed(is_query: bool):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    b = whole.slice(at, 4096)
                    x = matrix(b["v"], dim)
                    d = distances(np.hstack([x, np.zeros((len(x), 1))]) if is_query else raised(x, length2), centres)
                    home = d.argmin(axis=1)
                    own = d[np.arange(len(d)), home]
                    ring = home * per_pivot + np.searchsorted(edges, own, side="right")
                    yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(ring.astype(np.int32)), pa.array(own), pa.array([r.tobytes() for r in x.astype(stored)], pa.binary())], names=["vec_id", "ring", "distance", "x"])

        return f

    shape = "vec_id bigint, ring int, distance double, x binary"
    order = ["ring", "distance", "vec_id"]

    def packed(most: int):
        """Rows of one ring that follow each other, most at a time."""

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ring = np.asarray(b["ring"])
                cuts = np.flatnonzero(np.diff(ring, prepend=-1)) if len(ring) else np.zeros(0, int)
                ids, d, x = np.asarray(b["vec_id"]), np.asarray(b["distance"]), b["x"].to_pylist()
                spans = [(i, min(i + most, z)) for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ring)], strict=True) for i in range(a, z, most)]
                yield pa.RecordBatch.from_arrays([pa.array([int(ring[a]) for a, _ in spans], pa.int32()), pa.array([float(d[a:z].min()) for a, z in spans], pa.float64()), pa.array([float(d[a:z].max()) for a, z in spans], pa.float64()), pa.array([ids[a:z].tolist() for a, z in spans], pa.list_(pa.int64())), pa.array([b"".join(x[a:z]) for a, z in spans], pa.binary())], names=["ring", "low", "high", "ids", "xs"])

        return f

    block = "ring int, low double, high double, ids array<bigint>, xs binary"
    n = width(spark)
    blocks = keep(points.mapInArrow(placed(False), shape).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(packed(BLOCK), block))
    asked = keep(quantized(queries, query_id, vector_column, scale).mapInArrow(placed(True), shape))
    rings = blocks.groupBy("ring").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("blocks")).toPandas().sort_values("ring")  # pivots * annuli rows at most
    ring_ids, low, high = (rings[c].to_numpy() for c in ("ring", "low", "high"))
    ring_pivot = ring_ids // per_pivot

    def bounds(x: np.ndarray) -> np.ndarray:
        """The most that a point of each ring can score, a little widened against rounding."""
        d = distances(np.hstack([x, np.zeros((len(x), 1))]), centres)[:, ring_pivot]
        gap = np.maximum(np.maximum(low - d, d - high), 0)
        return ((x * x).sum(axis=1)[:, None] + length2 - gap * gap) / 2 * (1 + 1e-9) + 1e-3 + 1e-9 * length2

    def best(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of packs of queries and blocks of rows: each query's k best in the block, those at its floor or above."""
        for b in pairs:
            for i in range(b.num_rows):
                q_ids, ids = np.asarray(b["q_ids"][i].values), np.asarray(b["ids"][i].values)
                q = np.frombuffer(b["q_xs"][i].as_py(), stored).reshape(len(q_ids), dim).astype(exact)
                floor = np.asarray(b["floors"][i].values)
                x = np.frombuffer(b["xs"][i].as_py(), stored).reshape(len(ids), dim).astype(exact)
                scores = q @ x.T if exact is np.int64 else np.rint(q @ x.T).astype(np.int64)
                own = q_ids[:, None] == ids[None, :]
                if wide:
                    about, most = np.where(own, 0, q.astype(np.float64) @ x.T.astype(np.float64)), 2.0**63 * (1 - 1e-9)
                    if (about > most).any():
                        raise ValueError("a score doesn't fit a long")
                    scores = np.where(about < -most, LEAST, scores)
                masked = np.where(own, np.iinfo(np.int64).min, scores)
                if len(ids) > k:
                    kth = np.partition(masked, len(ids) - k, axis=1)[:, len(ids) - k]
                    floor = np.maximum(floor, kth)
                row, col = np.nonzero((masked >= floor[:, None]) & ~own)
                # ties at the end: the lesser ids
                order_ = np.lexsort((ids[col], -scores[row, col], row))
                row, col = row[order_], col[order_]
                at = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[at < k], col[at < k]
                if wide and (scores[row, col] == LEAST).any():
                    raise ValueError("a score doesn't fit a long")
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[col]), pa.array(scores[row, col])], names=["query_id", "vec_id", "score"])

    hit = "query_id bigint, vec_id bigint, score bigint"
    pair = ["q_ids", "q_xs", "floors", "ids", "xs"]

    def packs(rows_: DataFrame) -> DataFrame:
        """Queries (vec_id, x, floor) that go to a ring, PACK at a time."""

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ring = np.asarray(b["ring"])
                cuts = np.flatnonzero(np.diff(ring, prepend=-1)) if len(ring) else np.zeros(0, int)
                ids, floors, x = np.asarray(b["vec_id"]), np.asarray(b["floor"]), b["x"].to_pylist()
                spans = [(i, min(i + PACK, z)) for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ring)], strict=True) for i in range(a, z, PACK)]
                yield pa.RecordBatch.from_arrays([pa.array([int(ring[a]) for a, _ in spans], pa.int32()), pa.array([ids[a:z].tolist() for a, z in spans], pa.list_(pa.int64())), pa.array([b"".join(x[a:z]) for a, z in spans], pa.binary()), pa.array([floors[a:z].tolist() for a, z in spans], pa.list_(pa.int64()))], names=["ring", "q_ids", "q_xs", "floors"])

        # a salt keeps the queries of one ring from meeting in one task
        dealt = rows_.repartition(n, "ring", F.pmod(F.xxhash64("vec_id"), F.lit(16))).sortWithinPartitions("ring")
        return dealt.mapInArrow(f, "ring int, q_ids array<bigint>, q_xs binary, floors array<bigint>")

    def kth_best(hits: DataFrame, most: int) -> DataFrame:
        run = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(run)).where(F.col("rank") <= most)

    # one block of each ring stands for it in the first look: any k rows give a right floor
    first = blocks.groupBy("ring").agg(F.min_by(F.struct("ids", "xs"), F.abs(F.size("ids") - BLOCK)).alias("b")).select("ring", "b.ids", "b.xs")
    lowest = F.lit(LEAST).cast("bigint")
    looked = packs(asked.select("ring", "vec_id", "x", lowest.alias("floor"))).join(first, "ring").select(*pair).mapInArrow(best, hit)
    floors = kth_best(looked, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    floored = asked.join(floors, "vec_id", "left").select("vec_id", "x", F.coalesce("floor", lowest).alias("floor"))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                x = np.frombuffer(b"".join(b["x"].to_pylist()), stored).reshape(b.num_rows, dim).astype(np.float64)
                row, ring = np.nonzero(bounds(x) >= np.asarray(b["floor"])[:, None])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(ring_ids[ring].astype(np.int32)), b["vec_id"].take(take), b["x"].take(take), b["floor"].take(take)], names=["ring", "vec_id", "x", "floor"])

    probes = packs(floored.mapInArrow(sent, "ring int, vec_id bigint, x binary, floor bigint"))
    # a ring's blocks are dealt to parts, and packs go to each of them: no ring, however full, is one task's
    parts = F.broadcast(spark.createDataFrame([(int(r), -(-int(m) // PART)) for r, m in zip(ring_ids, rings["blocks"], strict=True)], "ring int, parts int"))
    dealt = blocks.join(parts, "ring").select("ring", "ids", "xs", F.pmod(F.xxhash64("low", "high", F.element_at("ids", 1)), F.col("parts")).cast("int").alias("part"))
    asking = probes.join(parts, "ring").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hits = asking.join(dealt, ["ring", "part"]).select(*pair).mapInArrow(best, hit)
    return kth_best(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
