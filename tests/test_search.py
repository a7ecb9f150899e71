"""Retrieval against brute force: recall of the index, phrases, OR, minus, and a language for each question."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamline.operators import keywords, quantized, search
from loamline.operators.contains import containing

CHUNK = "source string, scope string, resource_id string, chunk_index int, title string, text string, embedding array<double>"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x[900:910] = x[900]
    rows = [(f"s{i % 3}", f"k{i % 2}", f"r{i:04d}", 0, None, None, v.tolist()) for i, v in enumerate(x)] + [("s0", "k0", "none", 0, None, None, None), ("s0", "k0", "zero", 0, None, None, [0.0] * 32)]
    asked = [(i, "u", rng.normal(size=32).tolist()) for i in range(30)] + [(90, "u", x[900].tolist()), (91, "u", [0.0] * 32), (92, "u", None)]
    chunks = spark.createDataFrame(rows, CHUNK)
    queries = spark.createDataFrame(asked, "query_id int, user_id string, embedding array<double>")
    scopes = queries.select("query_id").crossJoin(chunks.where("scope = 'k0'").select("source", "scope").distinct())
    return rows, asked, chunks, queries, scopes


def exact(rows, asked, k):
    out = {}
    for q, _, a in asked:
        for source in ("s0", "s1", "s2"):
            found = []
            for s, scope, r, _, _, _, v in rows:
                if s == source and scope == "k0" and v and a and any(v) and any(a):
                    score = np.dot(a, v) / (np.linalg.norm(a) * np.linalg.norm(v))
                    if score >= 0.1:
                        found.append((-round(score, 9), r))
            out |= {(q, source, i + 1): r for i, (_, r) in enumerate(sorted(found)[:k])}
    return out


def test_vector_topk_is_brute_force(vectors):
    rows, asked, chunks, queries, scopes = vectors
    got = {(r.query_id, r.source, r["rank"]): r.resource_id for r in search.vector_topk(queries, chunks, scopes, 5).collect()}
    assert got == exact(rows, asked, 5)


def test_approximate_recall_with_a_tenth_of_the_vectors(vectors):
    """Evenly spread vectors, 250 in scope of each question and source: under a tenth of them are scored exactly."""
    rows, asked, chunks, queries, scopes = vectors
    books = quantized.fit_codebooks(chunks, parts=16)
    codes = quantized.encoded(chunks, books)
    best = {(q, s, r) for (q, s, _), r in exact(rows, asked, 8).items()}
    got = {(r.query_id, r.source, r.resource_id) for r in quantized.vector_topk_approx(queries, chunks, scopes, 8, most=24, books=books, codes=codes).collect()}
    assert len(got & best) >= 0.9 * len(best)
    listed = quantized.short_list(queries, codes, scopes, books, 24)
    in_scope = scopes.join(chunks.where("embedding IS NOT NULL"), ["source", "scope"]).join(queries.where("embedding IS NOT NULL"), "query_id").count()
    assert listed.count() < 0.1 * in_scope
    assert quantized.recall_of(listed, listed).where("n_exact <> n_found").count() == 0


def test_a_long_list_is_exact(vectors):
    rows, asked, chunks, queries, scopes = vectors
    best = {(q, s, r) for (q, s, _), r in exact(rows, asked, 16).items()}
    whole = quantized.vector_topk_approx(queries, chunks, scopes, 16, most=1000)
    assert {(r.query_id, r.source, r.resource_id) for r in whole.collect()} == best
    assert quantized.vector_topk_approx(queries, chunks.limit(0), scopes).count() == 0


def test_cache_bands_are_brute_force(spark):
    """At any floor the answers of all pairs; at a high one few pairs meet."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    point = lambda i: (centres[i % 6] + 0.15 * rng.normal(size=8)).tolist()
    answers = [(i, f"s{i % 2}", point(i), f"a{i}", "2001-01-01 00:30:00" if i % 7 else "2000-12-31 22:00:00") for i in range(300)] + [(900, "s0", [0.0] * 8, "z", "2001-01-01 00:30:00"), (901, "s0", [1.0, 2.0], "short", "2001-01-01 00:30:00"), (902, "s0", None, "n", "2001-01-01 00:30:00")]
    asked = [(i, f"s{i % 2}", point(i)) for i in range(60)] + [(90, "s0", [0.0] * 8), (91, "s0", [2.0, 4.1]), (92, "s0", None)]
    cache = spark.createDataFrame(answers, "answer_id bigint, scope_fingerprint string, embedding array<double>, answer string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    queries = spark.createDataFrame(asked, "query_id int, scope_fingerprint string, embedding array<double>")
    for floor in (0.97, 0.3):
        expected = {}
        for q, s, a in asked:
            for i, t, b, _, at in answers:
                if s == t and a and b and len(a) == len(b) and any(a) and any(b) and at > "2001":
                    score = round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9)
                    if score >= floor and (q not in expected or (-score, i) < expected[q]):
                        expected[q] = (-score, i)
        got = {r.query_id: (-round(r.similarity, 9), r.answer_id) for r in search.cache_lookup(queries, cache, "2001-01-01 01:00:00", floor=floor).collect()}
        assert got == expected
    pivots = search.pivots_of(cache)
    meet = search.banded(queries, pivots, 0.97, True).join(search.banded(cache.select("scope_fingerprint", F.col("embedding")), pivots, 0.97, False), ["scope_fingerprint", "bands"]).count()
    assert meet < 0.5 * queries.join(cache, "scope_fingerprint").count()


def test_containing_is_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abAÉ_.x") for _ in range(n))
    texts = [word(rng.randrange(0, 14)) for _ in range(300)] + [None, "aaaa", "A"]
    needles = [word(rng.randrange(0, 6)) for _ in range(150)] + [None, "", "AA", "aaa", "zzz"]
    df = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} string")
    found = containing(df(needles, "needle"), df(texts, "text"))
    expected = sorted({(n, t) for n in needles for t in texts if n and t and n.lower() in t.lower()})
    assert sorted(map(tuple, found.collect())) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_phrases_or_minus_and_languages(spark):
    texts = ["the cat sat on the mat", "a dog and a cat", "cats running in the fog", "mat the on sat cat", None, "cat cat dog mat"]
    chunks = spark.createDataFrame([("s", "k", f"r{i}", 0, t and t.split()[0], t, [1.0, float(i)]) for i, t in enumerate(texts)], CHUNK)
    asked = [(1, '"cat sat" mat', "simple"), (2, "dog -mat OR fog", None), (3, '"sat on the mat"', "english"), (4, "cat run OR zzz", "english"), (5, "the", "english"), (6, '-cat', "simple"), (7, "cat dog cat", "simple"), (8, " ", "simple")]
    queries = spark.createDataFrame([(i, "u", t, g, [1.0, 0.0]) for i, t, g in asked], "query_id int, user_id string, text string, language string, embedding array<double>")
    scopes = queries.select("query_id").withColumns({"source": F.lit("s"), "scope": F.lit("k")})
    got = {}
    for r in keywords.keyword_leg(queries, scopes, 10, "simple", chunks=chunks).collect():
        got.setdefault(r.query_id, set()).add(r.resource_id)
    assert got == {1: {"r0"}, 2: {"r1", "r2"}, 3: {"r0"}, 4: {"r2"}, 7: {"r1", "r5"}}
    hits = keywords.retrieve(queries, chunks, spark.createDataFrame([("u", "s", "k")], "user_id string, source string, scope string"))
    assert hits.where("query_id = 8").count() == 0 and hits.where("query_id = 1").orderBy("place").first().resource_id == "r0"


def brute_covers(occurrences, branch_of):
    """Shortest stretches that satisfy a branch, by trying all."""
    ends = sorted({(s, e) for s0, _, _ in occurrences for _, e0, _ in occurrences for s, e in [(s0, e0)] if s <= e})
    full = lambda s, e: any(all(any(t == own and s <= x and y <= e for x, y, t in occurrences) for own, b in enumerate(branch_of) if b == branch) for branch in set(branch_of))
    good = [(s, e) for s, e in ends if full(s, e)]
    return sorted((s, e) for s, e in good if not any((x, y) != (s, e) and s <= x and y <= e for x, y in good))


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 2), st.integers(0, 3)), min_size=1, max_size=14), st.lists(st.integers(0, 2), min_size=4, max_size=4))
def test_covers_are_brute_force(found, branch_of):
    occurrences = sorted({(s, s + more, t) for s, more, t in found})
    arrays = (np.array(x, np.int64) for x in zip(*occurrences, strict=True))
    first, last = keywords.covers(*arrays, np.array(branch_of))
    assert sorted(zip(first.tolist(), last.tolist(), strict=True)) == brute_covers(occurrences, branch_of)


def test_density():
    """Two covers of two places: adjacent ones count whole, others by the words between; the title weighs more."""
    one = keywords.density(np.array([1, 10]), np.array([2, 14]), np.array([1, 2, 10, 14]), np.array([1.0, 1.0, 0.4, 0.4]))
    assert one == pytest.approx(1.0 + 0.4 / 4)


def test_stored_index_follows_its_chunks(spark, tmp_path):
    texts = ["red apple pie", "green pie", "blue sky", None, "apple apple"]
    chunks = spark.createDataFrame([("s", "k", f"r{i}", 0, "t", t, [1.0]) for i, t in enumerate(texts)], CHUNK)
    stored = keywords.KeywordIndex(spark, str(tmp_path / "k"), buckets=16)
    stored.update(chunks, 0)
    queries = spark.createDataFrame([(1, "u", "apple", "simple"), (2, "u", "pies", "english"), (3, "u", '"sky" OR violet', None)], "query_id int, user_id string, text string, language string")
    scopes = queries.select("query_id").withColumns({"source": F.lit("s"), "scope": F.lit("k")})
    hits = lambda **by: sorted((r.query_id, r.resource_id, r.score) for r in keywords.keyword_leg(queries, scopes, 9, "simple", **by).collect())
    assert hits(index=stored) == hits(chunks=chunks) and {h[:2] for h in hits(index=stored)} == {(1, "r0"), (1, "r4"), (2, "r0"), (2, "r1"), (3, "r2")}
    before = stored.table.manifest().folders
    changed = spark.createDataFrame([("s", "k", "r2", 0, "t", "violet", [1.0])], CHUNK)
    for _ in range(2):
        stored.update(changed, 1, chunks.where("resource_id IN ('r2', 'r4')"))
    now = chunks.where("resource_id NOT IN ('r2', 'r4')").unionByName(changed)
    assert hits(index=stored) == hits(chunks=now)
    assert 0 < sum(f != before.get(b) for b, f in stored.table.manifest().folders.items()) < len(before)
    plan = stored.of(search.parse_search(queries), "simple")._jdf.queryExecution().toString()
    assert "title" not in plan  # no chunk is read


def test_postings_move_texts_and_no_words(spark):
    """One exchange, of whole chunks; rows of one key are still gathered."""
    rows = [("s", "k", "r", 0, "b a", "a b a", None), ("s", "k", "r", 0, "x y", "a", None), ("s", "k", "r", 1, None, None, None)]
    index = search.postings(spark.createDataFrame(rows, CHUNK))
    assert index._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = sorted((r.token, r.shift, r.a, r.b) for r in index.collect())
    assert got == [("a", 2, [1], [0, 0, 2]), ("b", 2, [0], [1]), ("x", 2, [0], []), ("y", 2, [1], [])]


def test_words_are_shuffled_once_and_packed(spark, tmp_path):
    """Chunks are dealt as texts, their words then go to the buckets in packed rows; looking words up moves no posting."""
    chunks = spark.createDataFrame([("s", "x", f"r{k}", "one two", f"one two\nwords{k} and two, more één") for k in range(40)], "source string, scope string, resource_id string, title string, text string").withColumn("chunk_index", F.lit(0))
    index = keywords.KeywordIndex(spark, str(tmp_path / "index"), ("simple", "english"), 4)
    plan = index.rows(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == len(index.languages) + 1 and "ENSURE_REQUIREMENTS" not in plan
    index.update(chunks, 0)
    told = lambda rows: sorted((r.language, r.token, r.resource_id, r["shift"], tuple(r.a), tuple(r.b)) for r in rows.collect())
    plain = [search.postings(chunks, own).withColumn("language", F.lit(own)) for own in index.languages]
    assert told(index.table.read()) == told(plain[0].unionByName(plain[1]))
    terms = search.parse_search(spark.createDataFrame([(1, "words3 two")], "query_id int, text string"))
    found = index.of(terms, "simple")
    assert found.count() == 41 and "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
