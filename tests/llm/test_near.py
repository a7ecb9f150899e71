"""Near-duplicates by Jaccard similarity against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamline.llm import forest
from loamline.llm.forest import minhash_components
from loamline.llm.jaccard import jaccard_components
from tests.llm.test_dedup import brute_roots


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_least(rows):
    sets = [grams(t) for _, t in rows]
    at = range(len(rows))
    root = brute_roots(at, [(i, j) for i in at for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    least = {}
    for i in at:
        if rows[i][0] is not None:
            least[root[i]] = min(least.get(root[i], rows[i][0]), rows[i][0])
    return [least.get(root[i]) for i in at]


def edited(rng, words, n):
    """A copy with n places changed, dropped or added."""
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(2)
    return out


@pytest.fixture(scope="module")
def near_rows():
    """Near copies about the threshold, chains of them, a dense group, a passage in many texts, exact copies and short texts."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts, passage = [], fresh(50)
    for n in (6, 12, 25, 45, 90, 200, 400):
        for _ in range(4):
            base = fresh(n)
            texts += [base, *(edited(rng, base, k) for k in (1, 1, 2, 3, max(1, n // 45), n // 30, n // 20))]
    dense = fresh(150)
    texts += [edited(rng, dense, 1) for _ in range(60)] + [passage + fresh(k) for k in range(0, 60, 2)]
    chain = fresh(120)
    for _ in range(15):
        texts.append(chain := edited(rng, chain, 2))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a c"), (None, " ".join(dense))]
    return rows + rows[3:6]


def test_components_are_brute_force(spark, near_rows):
    df = spark.createDataFrame(near_rows, "doc_id bigint, text string").repartition(5)
    key = lambda x: tuple(map(str, x))
    expected = sorted(zip((i for i, _ in near_rows), brute_least(near_rows), strict=True), key=key)
    assert sorted(map(tuple, jaccard_components(df).collect()), key=key) == expected
    assert jaccard_components(df.limit(0)).count() == 0


def test_stage_leaves_no_near_copies(spark):
    cp = pytest.importorskip("corpus_pipeline")
    words = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(words[:at] + ["x"] + words[at + 1 :])) for i, at in enumerate((10, 50, 90))] + [(7, " ".join(words)), (8, " ".join(words[::-1]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    assert sorted(r.doc_id for r in cp.one_of_each_group(spark, df, "").collect()) == [0, 8]


@given(st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 3000))
def test_sketches_bound_what_is_common(n, only_a, only_b):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 1 << 64, n + only_a + only_b, np.uint64)
    a, b = np.unique(x[: n + only_a]), np.unique(np.concatenate([x[:n], x[n + only_a :]]))
    full = np.full(8, 255, np.uint8)
    bounds = forest.common_at_most([forest.sketch(a), forest.sketch(b), full], np.array([0, 1, 2]), np.array([1, 0, 1]))
    assert bounds[0] == bounds[1] >= len(np.intersect1d(a, b))
    assert bounds[2] >= len(b)


def brute_near(rows):
    """n_shingles, component and kept of each row, by sets of three words at 85 hundredths."""
    sets = [{tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in ((t or "").encode().lower().split() for _, t in rows)]
    at = range(len(rows))
    root = brute_roots(at, [(i, j) for i in at for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    least = {}
    for i in at:
        if rows[i][0] is not None:
            least[root[i]] = min(least.get(root[i], rows[i][0]), rows[i][0])
    own = [least.get(root[i]) if sets[i] else rows[i][0] for i in at]
    return [(r[0], len(s), c, r[0] == c) for r, s, c in zip(rows, sets, own, strict=True)]


@pytest.mark.parametrize("block", [forest.BLOCK, 3])
def test_minhash_is_brute_force(spark, near_rows, block, monkeypatch):
    """With blocks of three rows, crowded regions are dealt to many."""
    monkeypatch.setattr(forest.similar_links, "__defaults__", (None, block))
    rng = random.Random(3)
    # copies with so many edits that most are like the original only
    star = [f"s{k}" for k in range(400)]
    rows = near_rows + [(2000 + k, " ".join(edited(rng, star, 5 + k % 4) if k else star)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("region", F.lit(1)).repartition(5)
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, minhash_components(df).collect()), key=key) == sorted(brute_near(rows), key=key)


def test_minhash_edges(spark, none, clashing):
    assert minhash_components(none).count() == 0
    assert sorted(map(tuple, minhash_components(clashing).collect())) == [(1, 1, 1, True), (2, 0, 2, True)]


def test_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 64, 1100, np.uint64)
    a, b = np.unique(x[:1000]), np.unique(x[100:])  # 9/11 alike
    (own, _), (other, _) = forest.signatures(iter((a, b)), 4)
    assert abs(np.mean(own == other) - (9 / 11) ** 4) < 0.2


def test_candidates_are_linear_under_common_sentences(spark):
    """Texts of 14 out of 40 sentences, none similar: what leaves the trees is far from all pairs."""
    rng = random.Random(1)
    sentences = [" ".join(f"k{rng.randrange(10**6)}" for _ in range(12)) + "." for _ in range(40)]
    counts = []
    for n in (400, 800):
        rows = [(i, " ".join(rng.sample(sentences, 14))) for i in range(n)]
        base = spark.createDataFrame(rows, "rep bigint, text string")
        labels = forest.labels_of(base, 5, 4, 5)
        shared = labels.select("rep", F.explode("regions").alias("region")).groupBy("region").count().where("count > 1")
        counts.append(shared.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0)
        assert forest.similar_links(base, labels, 5, 4, 5).count() == 0
    assert counts[1] < 0.02 * 800 * 799 / 2


def test_rows_in_company():
    region = np.array([1, 1, 2, 3, 3, 3, 4, 5, 5, 9])
    for cut in (1, 2, 3, 10):
        parts = [pa.RecordBatch.from_arrays([pa.array(region[k : k + cut]), pa.array(np.arange(10)[k : k + cut]), pa.array(region[k : k + cut])], names=["region", "rep", "deep"]) for k in range(0, 10, cut)]
        got = pa.Table.from_batches(forest.in_company(iter(parts))).to_pylist()
        assert [(r["region"], r["rep"], r["before"]) for r in got] == [(1, 0, None), (1, 1, 0), (3, 3, None), (3, 4, 3), (3, 5, 4), (5, 7, None), (5, 8, 7), (9, 9, None)]
