"""Periodic runs against brute force over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamline.llm.common import text_of
from loamline.llm.runs import Words, digests, found_in, grammar, periodic_runs, with_repeats
from tests.llm.conftest import DOCS


def brute_runs(w):
    """Every period's maximal stretches, less those that have a smaller period."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            x = w[s : i + q]
            if len(x) >= max(6, 4 * q) and not any(all(x[k] == x[k + p] for k in range(len(x) - p)) for p in range(1, q)):
                out.append((s, len(x), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(kept)))


def runs_by_text(texts):
    counts, spans = found_in(texts)
    ends = np.cumsum(counts)
    return [list(zip(*(x[e - c : e].tolist() for x in spans), strict=True)) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=4))
def test_small_alphabets(texts):
    assert runs_by_text(texts) == [brute_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.randoms())
def test_nested_repeats(rng):
    def word(depth):
        if not depth or rng.random() < 0.2:
            return [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(1, 4))]
        x = word(depth - 1)
        return x * rng.randrange(1, 7) + word(depth - 1)[: rng.randrange(3)] + x[: rng.randrange(len(x) + 1)]

    texts = [word(3)[:400] for _ in range(3)]
    assert runs_by_text(texts) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("text", [b"a " * 3000, b"a b " * 1500, b"a a b " * 900, b"x y z x y z x y z x y z x y w " * 60])
def test_long_runs(text):
    words = text.split()
    got = runs_by_text([words])[0]
    n = len(words)
    for s, m, q in got:
        assert all(words[i] == words[i + q] for i in range(s, s + m - q)) and m >= max(6, 4 * q)
        assert (s == 0 or words[s - 1] != words[s + q - 1]) and (s + m == n or words[s + m] != words[s + m - q])
    assert len(got) == len(set(got)) and max(m / q for _, m, q in got) >= n / 15


def test_long_period():
    rng = random.Random(5)
    base = [b"w%d" % rng.randrange(5000) for _ in range(1700)]
    words = base[:100] + base[100:] * 4 + base[100:250]
    assert (100, 4 * 1600 + 150, 1600) in runs_by_text([words])[0]


@given(st.lists(st.sampled_from(range(5)), min_size=2, max_size=80))
def test_the_grammar_derives_the_text(symbols):
    words = Words(np.array(symbols, np.uint64), np.array([len(symbols)]))
    symbol, lo, mid, hi = grammar(words.grams[0], words.doc)
    seen = {}
    for x, a, m, b in zip(symbol.tolist(), lo.tolist(), mid.tolist(), hi.tolist(), strict=True):
        assert a < m < b
        assert seen.setdefault(x, (symbols[a:b], m - a)) == (symbols[a:b], m - a)
    assert sorted(mid.tolist()) == list(range(1, len(symbols)))  # each boundary belongs to one node


def test_query_is_brute_force(spark, docs, rows):
    line = "the same line again and again . "
    more = [(i, line * (i % 9) + "x y " * (i % 7) + "end", "en", "s", 1) for i in range(200, 240)] + [(i, "one two three four five six seven eight nine ten " * 3 + "z " * 9, "en", "s", 1) for i in range(300, 360)]
    table = docs.unionByName(spark.createDataFrame(more, DOCS)).withColumn("runs", F.lit("clash")).withColumn("start", F.lit(1))
    got = digests(periodic_runs(table.withColumn("text", with_repeats(F.col("doc_id"), text_of())))).collect()
    key = lambda r: (str(r[0]), r[7])
    assert sorted(map(tuple, got), key=key) == sorted((brute_row(r[0], r[1]) for r in [*rows, *more]), key=key)
    assert {r.n_runs for r in got} >= {0, 1, 2}


def test_edges(spark, none, clashing):
    assert digests(periodic_runs(none)).count() == 0
    assert [(r.doc_id, r.n_words, r.runs, r.kept_text) for r in periodic_runs(clashing).orderBy("doc_id").collect()] == [(1, 3, [], "one two three"), (2, 0, [], "")]
