"""Approximate vector search by product quantization: short codes first, whole vectors for a short list.

A vector is cut into parts, and each part is known by its nearest of 256 centres, one byte. A question's products with
all centres are one small table, so that a chunk's score is a sum of look-ups, one for each byte of its code. Codes are a
table of their own, to be stored beside the chunks; whole vectors are read for the few best codes of a question only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.operators.search import KEY, blocked, matrix_of, ranked_key, top, unit_rows

WORDS = 256


@dataclass(frozen=True)
class Codebooks:
    """For each part of the components the centres, as rows; where the parts begin and end."""

    centres: list[np.ndarray]
    cuts: list[int]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        """Vectors cut to parts; shorter ones are filled with 0, what is beyond the last part is left to the exact scores."""
        x = x[:, : self.cuts[-1]]
        x = np.pad(x, ((0, 0), (0, self.cuts[-1] - x.shape[1])))
        return [x[:, a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def fit_codebooks(chunks: DataFrame, parts: int = 32, sample: int = 8192, steps: int = 8) -> Codebooks | None:
    """Centres by k-means on a sample of fixed size, the rows of the least hashes of their keys; None without vectors."""
    rows = chunks.where("embedding IS NOT NULL").orderBy(F.xxhash64(*KEY)).limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    x = unit_rows(rows) if len(rows) else np.zeros((0, 1))
    x = x[np.isfinite(x).all(axis=1)]
    if not len(x):
        return None
    cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int).tolist()
    centres = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        own, c = x[:, a:b], x[np.linspace(0, len(x) - 1, min(WORDS, len(x))).astype(int), a:b]
        for _ in range(steps):
            home = nearest(own, c)
            sums, n = np.zeros_like(c), np.bincount(home, minlength=len(c))
            np.add.at(sums, home, own)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        centres.append(c)
    return Codebooks(centres, cuts)


def encoded(chunks: DataFrame, books: Codebooks) -> DataFrame:
    """(source, scope, key, code): a byte for each part of each chunk's vector."""
    rows = chunks.where("embedding IS NOT NULL").select("source", "scope", *KEY, "embedding")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.nan_to_num(unit_rows(b["embedding"]))
                codes = np.stack([nearest(p, c) for p, c in zip(books.parts(x), books.centres, strict=True)], axis=1).astype(np.uint8)
                yield b.drop_columns(["embedding"]).append_column("code", pa.array([c.tobytes() for c in codes], pa.binary()))

    return rows.mapInArrow(f, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "embedding") + ", code binary")


def best_codes(books: Codebooks, k: int):
    """Of packs of questions and blocks of codes: each question's k best by look-ups."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                asked, block = b["asked"][i].values, b["block"][i].values
                q = np.nan_to_num(unit_rows(asked.field("embedding")))
                tables = [p @ c.T for p, c in zip(books.parts(q), books.centres, strict=True)]
                codes = np.frombuffer(b"".join(block.field("code").to_pylist()), np.uint8).reshape(-1, len(tables))
                score = np.zeros((len(q), len(codes)))
                for t, column in zip(tables, codes.T, strict=True):
                    score += t[:, column]
                keys = pc.rank(block.field("key"), sort_keys="ascending").to_numpy()
                order = np.lexsort((np.broadcast_to(keys, score.shape), -score), axis=1)[:, :k]
                row, col = np.repeat(np.arange(len(q)), order.shape[1]), order.ravel()
                yield pa.RecordBatch.from_arrays([asked.field("query_id").take(pa.array(row)), pa.repeat(b["source"][i], len(row)), *(block.field(c).take(pa.array(col)) for c in KEY), pa.array(score[row, col])], names=["query_id", "source", *KEY, "about"])

    return f


def exact_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines of pairs, summed as vector_topk sums them."""
    for b in batches:
        q, x = matrix_of(b["asked"]), matrix_of(b["embedding"])
        n = max(q.shape[1], x.shape[1])
        q, x = (np.pad(m, ((0, 0), (0, n - m.shape[1]))) for m in (q, x))
        dot, own, other = (np.zeros(len(q)) for _ in range(3))
        for a, c in zip(q.T, x.T, strict=True):
            dot, own, other = dot + a * c, own + a * a, other + c * c
        with np.errstate(invalid="ignore", divide="ignore"):
            score = dot / (np.sqrt(own) * np.sqrt(other))
        yield b.drop_columns(["asked", "embedding"]).append_column("score", pa.array(score))


def short_list(queries: DataFrame, codes: DataFrame, scopes: DataFrame, books: Codebooks, most: int) -> DataFrame:
    """(query_id, source, key, about, place): the chunks in scope of the best codes, most of each question and source."""
    kinds = dict(queries.dtypes) | dict(codes.dtypes)
    asked = queries.where("embedding IS NOT NULL").select("query_id", "embedding").join(scopes, "query_id")
    by = ["source", "scope"]
    blocks = blocked(codes, by, [ranked_key(), *map(F.col, KEY), F.col("code")], "block", 8192)
    packs = blocked(asked, by, [F.col("query_id"), F.col("embedding")], "asked", 128)
    shape = f"query_id {kinds['query_id']}, source string, resource_id {kinds['resource_id']}, chunk_index {kinds['chunk_index']}, about double"
    found = packs.join(blocks, by).select("source", "asked", "block").mapInArrow(best_codes(books, most), shape)
    return top(found, ["query_id", "source"], [F.desc("about"), *map(F.asc, KEY)], most, "place")


def vector_topk_approx(queries: DataFrame, chunks: DataFrame, scopes: DataFrame, k: int = 16, floor: float = 0.10, most: int = 48, books: Codebooks | None = None, codes: DataFrame | None = None) -> DataFrame:
    """vector_topk among each question's and source's ``most`` best codes: exact scores, ranks and floor. books and codes:
    what fit_codebooks and encoded have made, stored beside the chunks; without them they are made here. A longer list finds
    more, and one as long as the chunks in scope all; on evenly spread vectors 48 of 500 chunks hold over 0.9 of the best 8."""
    books = books or fit_codebooks(chunks)
    if books is None:
        return chunks.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, source string, resource_id string, chunk_index int, score double, rank int")
    few = short_list(queries, encoded(chunks, books) if codes is None else codes, scopes, books, most).select("query_id", "source", *KEY)
    pairs = few.join(chunks.select(*KEY, "embedding"), KEY).join(queries.select("query_id", F.col("embedding").alias("asked")), "query_id")
    kept = [f"`{c}` {t}" for c, t in pairs.dtypes if c not in ("asked", "embedding")]
    scored = pairs.mapInArrow(exact_scores, ", ".join(kept) + ", score double").where((F.col("score") >= floor) & ~F.isnan("score"))
    return top(scored.select("query_id", "source", *KEY, "score"), ["query_id", "source"], [F.desc("score"), *map(F.asc, KEY)], k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, n_exact, n_found): how many of the exact hits an approximate search has."""
    hit = found.select("query_id", *KEY).distinct().withColumn("ok", F.lit(1))
    return exact.select("query_id", *KEY).distinct().join(hit, ["query_id", *KEY], "left").groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("ok").alias("n_found"))
