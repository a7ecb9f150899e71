"""Substring dedup and SimHash against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loamline.llm import simhash
from loamline.llm.components import components
from loamline.llm.simhash import simhash_components
from loamline.llm.substring import substring_dedup
from tests.llm.conftest import words


def brute_repeats(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        yield len(w), len(gone), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("window", [35, 4, 2])
def test_substring_dedup_is_brute_force(docs, rows, window):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs, window=window).collect())
    assert got == sorted((str(r[0]), *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], window), strict=True))


def test_many_repeated_rows(spark):
    """Five thousand rows alike in id and text lose all their words, once looked at; a text that holds a part of theirs loses that."""
    rng = random.Random(9)
    text = words(rng, 500)
    part = " ".join(text.split()[100:150])
    rows = [(7, text)] * 5000 + [(8, "a b c " + part + " d e"), (9, "a b"), (9, "a b")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(7, 500, 500, 5000), (8, 55, 50, 1), (9, 2, 0, 2)]


@pytest.mark.parametrize(("part", "fan"), [(4000, 4096), (4000, 3), (1000, 2)])
def test_substring_dedup_whatever_the_parts(docs, rows, part, fan):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs, window=4, part=part, fan=fan).collect())
    assert got == sorted((str(r[0]), *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], 4), strict=True))


@pytest.mark.parametrize("texts", [["a b c d e f g", "h i j k l m n"], ["a b c d e f g"], ["a a a a a a a"], ["a b c d", "a b c d"]])
def test_with_nothing_and_with_everything_repeated(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [(r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, window=4).orderBy("doc_id").collect()]
    assert got == list(brute_repeats(texts, 4))


def test_kept_text_is_left_alone_where_nothing_goes(docs):
    for r in substring_dedup(docs, with_text=True, carry=[F.col("text").alias("original")]).collect():
        assert r.n_removed or r.kept_text == (r.original or "")
        assert r.n_words - r.n_removed == len((r.kept_text or "").encode().split())


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w)] if 0 < len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def test_simhash_is_brute_force(docs, rows):
    fps = [brute_simhash(r[1]) for r in rows]
    linked = [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 2]
    root = brute_roots(set(fps), linked)
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash_components(docs).collect())
    assert got == sorted((str(r[0]), f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps, strict=True))


@pytest.mark.parametrize("near", [False, True])
def test_index_finds_every_pair(spark, near):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 64, 600, np.uint64)
    if near:  # a dense cluster around a few points
        fps = np.concatenate([fps[:5]] + [fps[:5] ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(0, 60, 7) for b in range(1, 64, 9)])
    fps = np.unique(fps)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    pairs = [(int(a), int(b)) for i, a in enumerate(fps.view(np.int64)) for b in fps.view(np.int64)[:i] if (int(a) ^ int(b)).bit_count() <= 2 or ((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() <= 2]
    expected = brute_roots({x for p in pairs for x in p}, pairs)
    got = {r.node: r.root for r in components(simhash.links_of(df, 2, 32)).collect()}
    assert got == expected


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_edges_of_the_input(none, clashing):
    assert substring_dedup(none).count() == simhash_components(none).count() == 0
    assert [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(clashing).orderBy("doc_id").collect()] == [(1, 3, 0), (2, 0, 0)]
    assert [(r.doc_id, r.component_id) for r in simhash_components(clashing).orderBy("doc_id").collect()] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("n", [0, 1, 30, 700])
def test_upper_nodes_lose_no_group(n):
    rng = np.random.default_rng(n)
    base = np.sort(simhash.gray_rank(rng.integers(0, 1 << 64, n, np.uint64)))
    own = base & ~(rng.integers(0, 1 << 64, n, np.uint64) & rng.integers(0, 1 << 64, n, np.uint64))
    ones, any_one = own, own | (rng.integers(0, 1 << 64, n, np.uint64) & rng.integers(0, 1 << 64, n, np.uint64) & rng.integers(0, 1 << 64, n, np.uint64))
    probes = np.concatenate([own[: n // 2] ^ (np.uint64(1) << rng.integers(0, 64, n // 2).astype(np.uint64)), rng.integers(0, 1 << 64, 200, np.uint64)])
    for radius in (0, 2, 12):
        row, group = simhash.Tree(ones, any_one).near(probes, radius)
        expected = np.argwhere(np.bitwise_count((probes[:, None] ^ ones[None, :]) & ~(ones ^ any_one)[None, :]) <= radius)
        assert sorted(zip(row.tolist(), group.tolist(), strict=True)) == [tuple(x) for x in expected.tolist()]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7])
def test_orders_find_every_pair_once(spark, radius):
    """Whatever the radius and however small the groups: all pairs' components, near ones across the blocks of bits included."""
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 64, 60, np.uint64)
    flips = [base]
    for _ in range(radius + 1):
        flips.append(flips[-1] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))
    fps = np.unique(np.concatenate([*flips, [np.uint64(0), np.uint64((1 << 64) - 1)]]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint").repartition(3)
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius, 1))
    signed = fps.view(np.int64).tolist()
    pairs = [(signed[x], signed[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    got = {r.node: r.root for r in components(simhash.links_of(df, radius, 16)).collect()}
    assert got == brute_roots({x for p in pairs for x in p}, pairs)


@pytest.mark.parametrize("biased", [False, True])
def test_fingerprints_go_to_no_more_groups_as_groups_grow_in_number(spark, biased):
    """16 times the fingerprints in 16 times the groups: one order sent each of them to over twice as many groups."""
    rng = np.random.default_rng(3)
    made = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    rows = {}
    for n in (4000, 64000):
        fps = np.unique(made(n) | (made(n) & made(n)) if biased else made(n))
        df = spark.range(0, len(fps), 1, 4).select("id").join(spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps.view(np.int64))], "id bigint, fp bigint"), "id").select("fp")
        orders, (starts, _, _) = simhash.index_of(df, len(fps), 2, 64), simhash.orders_of(2)
        rows[n] = sum(len(o.routed(simhash.turned(fps, s))[0]) for o, s in zip(orders, starts, strict=True)) / len(fps)
    assert rows[64000] < 1.25 * rows[4000] < 10, rows
