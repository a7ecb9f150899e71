"""The audit of filters against brute force, document by document and order by order."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from loamline.llm.filter_audit import COUNTS, filter_audit, removal_steps
from tests.llm.conftest import DOCS

LABELS = "doc_id bigint, quality int, toxic int, extra string"


def failing(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [c for c, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)), ("D", re.search(r"[#$%&*|]", text))) if bad]


def brute(rows, labels):
    texts = [(i, t or "", s or "") for i, t, s in rows]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    fails = [{*failing(t), *("E" for j, u, _ in texts if i is not None and j is not None and j < i and t == u)} for i, t, _ in texts]
    out, shapley = {}, Counter()
    for part in {s for *_, s in texts}:
        own = [k for k, x in enumerate(texts) if x[2] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                here = [k for k in left if f in fails[k]]
                gone = sum(f in fails[k] for k in own) - len(here)
                left = [k for k in left if f not in fails[k]]
                out[part, order, step] = [len(left), len(here), gone, sum(fails[k] == {f} for k in own), sum(texts[k][0] in good for k in here), sum(texts[k][0] in toxic for k in here)]
                shapley[part, f] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in df.collect()}


def test_is_brute_force(spark, docs, rows):
    more = [(100, "A" * 40, "en", "src1", 1), (101, "50 % off " * 90, "en", "", 1), (102, "A" * 40, "en", "src2", 1), (103, "A" * 40, "en", None, 1)]
    labels = [(i, i % 2, i % 5 // 4, "x") for i in range(0, 60, 2)] + [(2, 0, 0, "y"), (102, 1, 1, None), (None, 1, 1, None), (103, None, None, None)]
    table = docs.unionByName(spark.createDataFrame(more, DOCS))
    got = result(filter_audit(table, spark.createDataFrame(labels, LABELS)))
    assert got == brute([(r[0], r[1], r[3]) for r in [*rows, *more]], [x[:3] for x in labels])
    assert len(got) == 600 * 4


def test_edges(spark, none, clashing):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit(none, labels).count() == 0
    got = result(filter_audit(clashing.withColumn("mask", clashing.fp).withColumn("part", clashing.key), labels))
    assert {k[0] for k in got} == {"h", ""} and got["h", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


@given(st.integers(1, 5), st.randoms())
def test_min_plus_gives_the_first_failing_step(n, rng):
    orders = [rng.sample(range(n), n) for _ in range(5)]
    steps = removal_steps(np.arange(1 << n), np.array(orders))
    for o, order in enumerate(orders):
        for mask in range(1 << n):
            assert steps[o, mask] == next((k for k, f in enumerate(order) if mask >> f & 1), n)
