"""What each of several filters removes, in every order in which they may be applied.

A document is known by the set of filters that it fails, so documents are first counted by part and by that set (a mask).
The rest is small: a matrix over masks and filters holds zero where the mask fails the filter and infinity elsewhere, a
second one over orders and filters holds each filter's place in the order (the inverse permutations). Their min-plus
product is the step at which an order removes a mask's documents. A part's counts, scattered to those steps, are what
each step removes; a filter's failing documents that an earlier step has removed are its redundancies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import keep, text_of

BLANKS = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def removal_steps(masks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """(orders, masks): the step, from 0, at which an order removes a mask's documents; the number of filters if never.

    masks: bit k is set where filter k fails. orders: a row for each order, the filters by their numbers."""
    n = orders.shape[1]
    fails = np.where((masks[:, None] >> np.arange(n)) & 1, 0, n)
    places = np.argsort(orders, axis=1)
    out = np.full((len(orders), len(masks)), n)
    for k in range(n):  # min-plus, a filter at a time: orders x masks numbers are held, not orders x masks x filters
        np.minimum(out, places[:, k, None] + fails[None, :, k], out=out)
    return out


def audited(n_filters: int):
    """From rows of a part's documents, good and toxic ones by mask to one row for each order and step."""
    orders = np.array(list(permutations(range(n_filters))))
    masks = np.arange(1 << n_filters)
    steps = removal_steps(masks, orders)
    at = np.arange(n_filters)
    #: (orders, steps, masks): whether the mask goes at the step, and whether it fails the step's filter but went before
    here = steps[:, None, :] == at[:, None]
    failing = (masks[None, None, :] >> orders[:, :, None]) & 1 == 1
    before = failing & (steps[:, None, :] < at[:, None])
    own = 1 << orders
    letters = np.array([chr(ord("A") + k) for k in range(n_filters)])
    names = ["".join(letters[o]) for o in orders]
    repeat = np.repeat(np.arange(len(orders)), n_filters)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a part has n! * n rows: one at a time
                docs, good, toxic = (np.array(b[c][k].as_py(), np.int64) for c in ("docs", "good", "toxic"))
                removed, redundant = here @ docs, before @ docs
                shapley = np.zeros(n_filters, np.int64)
                np.add.at(shapley, orders, removed)
                columns = [docs.sum() - np.cumsum(removed, axis=1), removed, redundant, docs[own], here @ good, here @ toxic, shapley[orders]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["part"][k].as_py()] * len(repeat)), pa.array([names[i] for i in repeat]), pa.array(np.tile(at + 1, len(orders)).astype(np.int32))] + [pa.array(c.ravel()) for c in columns],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    return f


def audit(rows: DataFrame, filters: int, mask: str = "mask", part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """part, filter_order (letters from A), step from 1, and COUNTS, for every order of so many filters.

    rows: a row for each document with its part (null: the empty string), the mask of the filters it fails, and whether it
    is good or toxic (null: no). Counts are summed by part and mask before the shuffle; what follows is 2^filters numbers
    a part. The result has filters! * filters rows a part; an empty table gives an empty one."""
    if not 1 <= filters <= 7:
        raise ValueError("orders are listed one by one: 1 to 7 filters")
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).cast("bigint")
    masks = rows.select(F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(mask).alias("mask"), F.col(good).alias("good"), F.col(toxic).alias("toxic"))
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("docs"), one("good").alias("good"), one("toxic").alias("toxic"))
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("docs", "good", "toxic").alias("n"))))  # 2^filters entries at most
    vector = lambda c: F.transform(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), lambda m: F.coalesce(F.element_at("n", m)[c], F.lit(0).cast("bigint"))).alias(c)
    parts = counts.groupBy("part").agg(by_mask.alias("n")).select("part", vector("docs"), vector("good"), vector("toxic"))
    return parts.mapInArrow(audited(filters), "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def text_filters(text: Column) -> Column:
    """The mask of the filters A to D that a text fails: under 200 words; under half of the words distinct; capitals over a
    fiftieth of the characters; any of the signs #$%&*|."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.char_length(text), text.rlike(r"[#$%&*|]")]
    out = F.lit(0)
    for k, one in enumerate(fails):
        out = out + F.when(one, 1 << k).otherwise(0)
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """The audit of five filters over documents: A to D look at the text (see text_filters), E fails a text that is
    identical to that of any smaller id, table-wide, whether an order has removed that one or not.

    A null text is empty: no words, so it fails A. Texts are identical if their SHA-256 and length are. A null id is never
    smaller or greater than another, so such rows don't fail E and make none fail; nor do repeated rows of one id. A
    document is good (toxic) if any row of labels with its id says quality = 1 (toxic = 1). A null part is the empty
    string. Further columns, whatever their names, change nothing; an empty table gives an empty result. Hot texts and
    parts are summed before shuffles; joins are plain equi-joins, which skewed partitions may be split in.
    """
    text = text_of(text_column)
    rows = docs.select(F.col(id_column).alias("id"), F.col(part_column).cast("string").alias("part"), text_filters(text).alias("mask"), F.sha2(text, 256).alias("h"), F.char_length(text).alias("n"))
    rows = keep(rows)
    # written before the join, so that a hot text's rows may be split between tasks there
    first = keep(rows.groupBy("h", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("h", "n", "first"))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    whole = rows.join(first, ["h", "n"], "left").join(known.where("id IS NOT NULL AND (good OR toxic)"), "id", "left")
    repeats = F.when(F.col("id") > F.col("first"), 16).otherwise(0)
    return audit(whole.select("part", (F.col("mask") + repeats).alias("mask"), "good", "toxic"), 5)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
known AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
        'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
        'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
        'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)} AS f
    FROM w LEFT JOIN known ON w.doc_id = known.doc_id),
g AS (SELECT part, concat_ws('', CASE WHEN f.A THEN 'A' END, CASE WHEN f.B THEN 'B' END, CASE WHEN f.C THEN 'C' END, CASE WHEN f.D THEN 'D' END, CASE WHEN f.E THEN 'E' END) AS fails,
        count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, o, step, o[step] AS filter, n, good, toxic, fails,
        contains(fails, o[step]) AS failing, len(regexp_extract_all(fails, '[' || o[1:step] || ']')) AS so_far FROM g, orders, (SELECT unnest(range(1, 6)) AS step)),
c AS (SELECT part, o, step, any_value(filter) AS filter, sum(n) FILTER (WHERE so_far = 0) AS kept, sum(n) FILTER (WHERE failing AND so_far = 1) AS removed,
        sum(n) FILTER (WHERE failing AND so_far > 1) AS redundant, sum(n) FILTER (WHERE fails = filter) AS unique_fails,
        sum(good) FILTER (WHERE failing AND so_far = 1) AS good_lost, sum(toxic) FILTER (WHERE failing AND so_far = 1) AS toxic_lost FROM s GROUP BY part, o, step)
SELECT part, o AS filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM c
"""
