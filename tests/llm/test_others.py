"""Mixing, top-k, licenses, quality rules, HTML and the pipeline against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import html, licenses, mixing, quality, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mix_comes_near_its_targets(docs, rows, none, clashing):
    got = mixing.mix_documents(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    targets = mixing.reshared(sizes, {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}, 3)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len(WORD.findall(next(x[1] or "" for x in rows if x[0] == r.doc_id)))
        assert (r.source_size, r.target) == (sizes[r.source], targets[r.source]) and r.taken == r.repeats * r.size <= 3 * r.size
        taken[r.source] += r.taken
    # whole documents are taken: a source with few of them may miss its target by half of its largest one
    largest = {s: max(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s) for s in sizes}
    assert {s: (taken[s], t) for s, t in targets.items() if abs(taken[s] - t) > max(0.05 * t, largest[s] / 2)} == {}
    assert sorted(map(str, mixing.mix_documents(docs.repartition(2)).collect())) == sorted(map(str, mixing.mix_documents(docs).collect()))
    assert mixing.mix_documents(none).count() == 0 and mixing.mix_documents(clashing).count() == 2
    back = mixing.mixed_rows(docs)
    assert back.columns == docs.columns and back.count() == sum(r.repeats for r in mixing.mix_documents(docs).collect())


def test_targets_and_flow():
    assert mixing.reshared({"a": 10, "b": 1000, "c": 10}, {"a": 1, "b": 2, "c": 3}, 3) == {"a": 30.0, "b": 960.0, "c": 30.0}
    assert mixing.min_cost_flow([100, 50], [[0, 1], [1]], [120, 200], 3) == [[120, 100], [100]]
    flow = mixing.min_cost_flow([100, 100, 100], [[0], [0, 1], [1]], [150, 150], 3)
    assert [sum(f) for f in flow] == [100, 100, 100]  # nothing is repeated where it needn't be


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_a_cheapest_one(seed):
    """Against shortest augmenting paths by Bellman and Ford."""
    rng = np.random.default_rng(seed)
    n_p, n_s, rounds = int(rng.integers(1, 7)), int(rng.integers(1, 5)), 3
    capacity, quota = rng.integers(0, 12, n_p).tolist(), rng.integers(0, 25, n_s).tolist()
    members = [sorted(rng.choice(n_s, rng.integers(1, n_s + 1), replace=False).tolist()) for _ in range(n_p)]
    flow = mixing.min_cost_flow(capacity, members, quota, rounds)
    arcs = [["start", p, c, k] for p, c in enumerate(capacity) for k in range(rounds)] + [[p, ("s", s), 99, 0] for p, own in enumerate(members) for s in own] + [[("s", s), "end", q, 0] for s, q in enumerate(quota)]
    both = [[a, b, c, w, i ^ 1] for i, (a, b, c, w) in enumerate(y for x in arcs for y in (x, [x[1], x[0], 0, -x[3]]))]
    cost = sent = 0
    while True:
        far, came = {"start": 0}, {}
        for _ in range(n_p + n_s + 2):
            for i, (a, b, c, w, _) in enumerate(both):
                if c and a in far and far[a] + w < far.get(b, 1 << 30):
                    far[b], came[b] = far[a] + w, i
        if "end" not in far:
            break
        at = "end"
        while at != "start":
            both[came[at]][2] -= 1
            both[came[at] ^ 1][2] += 1
            at = both[came[at]][0]
        cost, sent = cost + far["end"], sent + 1
    taken = [sum(f) for f in flow]
    assert sum(taken) == sent and all(sum(flow[p][own.index(s)] for p, own in enumerate(members) if s in own) <= q for s, q in enumerate(quota))
    assert sum(k * min(c, max(0, t - k * c)) for t, c in zip(taken, capacity, strict=True) for k in range(rounds)) == cost and all(t <= rounds * c for t, c in zip(taken, capacity, strict=True))


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(1, ["a", "b"], 100), (2, ["a"], 50), (3, ["b", None], 30), (4, [], 9), (5, None, 3), (None, ["a"], None)], "doc_id int, src array<string>, z int")
    got = {r.doc_id: (r.repeats, r.source_size) for r in mixing.mix(df, F.col("src"), F.col("z")).collect()}
    assert got == {1: (2, 150), 2: (1, 150), 3: (3, 130), 4: (0, None), 5: (0, None), None: (0, 150)}


@pytest.mark.parametrize("n", [0, 1, 4, 700])
def test_topk_is_brute_force(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 12)).round(2)
    x[n // 2 :: 3] = x[: 1] if n else x  # many ties
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + ([(n, None), (n + 1, [1.0, None]), (n + 2, [float("nan")]), (n + 3, [float("inf")]), (n + 4, []), (None, [1.0] * 12), (n + 5, [1.0, 2.0])] if n else [])
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash")).repartition(3)
    use = [(i, np.floor(256 * np.pad(np.array(v), (0, 12 - len(v))))) for i, v in data if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    expected = []
    for q, a in use:
        if q % 5 == 0:
            best = sorted((-int(a @ b), i) for i, b in use if i != q)[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_k(df, df.where("vec_id % 5 = 0"), pivots=7, annuli=4, sample=100)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_topk_of_large_components_and_full_rings(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "PART", 2)
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 24), 1 << 24, (300, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), k=3, scale=64, pivots=2, annuli=2, sample=50)
    whole = [[int(v) * 64 for v in row] for row in x]
    expected = [(q, k + 1, i, s) for q in range(0, 300, 50) for k, (s, i) in enumerate(sorted(((sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in enumerate(whole) if i != q), key=lambda t: (-t[0], t[1]))[:3])]
    assert sorted(map(tuple, got.collect())) == expected
    # one huge component: products with itself would not fit, but no score is one
    rows = [(0, [3e9, 1.0])] + [(i, [float(i), -2.0 * i]) for i in range(1, 30)] + [(30, [-3e9, 5.0])]
    big = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ints = [[int(c) * 64 for c in v] for _, v in rows]
    score = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b], strict=True))
    expected = sorted((q, k + 1, i, s) for q in range(31) for k, (s, i) in enumerate(sorted(((score(q, i), i) for i in range(31) if i != q), key=lambda t: (-t[0], t[1]))[:3]))
    assert sorted(map(tuple, topk.top_k(big, big, k=3, scale=64).collect())) == expected
    with pytest.raises(Exception, match="long"):
        two = spark.createDataFrame([(1, [1e12]), (2, [1e12])], "vec_id bigint, embedding array<double>")
        topk.top_k(two, two).collect()


def test_base_phrases_and_labels(spark, docs, rows, none, clashing):
    texts = ["Released UNDER the\nMIT-License. under the mit license", "Licensed under the Apache License, Version 2.0", "CC BY-NC 4.0", "SPDX-License-Identifier: GPL-3.0-or-later", "the permit licensee", None, "", "under the mit", "xcc by nc", "cc/by&nc cc by ncx"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in (got[i] for i in range(10))] == [(2, 1, 5, "mit"), (1, 3, 3, "apache-2"), (1, 0, 0, "cc-by-nc"), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (1, 0, 0, "cc-by-nc")]
    assert [got[i].labels for i in (0, 1, 2, 3, 4)] == ["mit", "apache-2", "cc-by-nc", "gpl-3", ""]
    assert all(0 <= r.score <= 1 for r in got.values())
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert sorted((str(r.doc_id), r.n_words) for r in licenses.license_scan(docs).collect()) == sorted((str(r[0]), len(pattern.findall(r[1] or ""))) for r in rows)
    assert licenses.license_scan(none).count() == 0 and licenses.license_scan(clashing).count() == 2


def test_suppression():
    d = licenses.Detection
    kept = licenses.settled([d(0, 10, "low", 2, 0.5), d(0, 20, "high", 1, 0.9), d(15, 25, "other", 3, 0.5), d(0, 20, "zz", 1, 0.9)])
    assert [x.label for x in kept] == ["high", "other"] and 200 <= len(licenses.RULES)


def test_quality_is_the_sql(spark, docs, rows, none, clashing, tmp_path):
    one = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    more = one.select("doc_id", "text").unionByName(spark.createDataFrame([(900, "a a\nb\na a\n\n \n" * 5), (901, "$ # x | " * 30), (902, "ABC DEF " * 40), (903, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3)], "doc_id bigint, text string"))
    path = str(tmp_path / "documents.parquet")
    more.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(map(tuple, quality.quality(more).collect())) == sorted(con.sql(quality.ORACLE).fetchall())
    assert quality.quality(docs).count() == len(rows) and quality.quality(none).count() == 0 and quality.quality(clashing).count() == 2
    assert quality.kept_rows(docs).columns == docs.columns


def test_ablations(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (8,), (16,)], "failed bigint")
    got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(rows, "web-1").collect()}
    assert got == {"few_words": (3, 2), "repeated_windows": (1, 0), "symbol_heavy": (0, 0), "shouting": (1, 1), "duplicate_lines": (1, 1)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/a>Home, sweet</a></ul></nav>
<!-- <p>hidden</p> --><div class="cookie-notice">We use cookies, as all do.</div><div id=main><h1>The &amp; Title</h1><p>First   paragraph, with <b>bold
text</b>&nbsp;and more.<br>Second line.<p>Tiny.<ul><li>one<li>two</ul><form><input value=x>Name</form><div class="comments"><p>Nice post, I like it, really.</div></div>
<aside>Also read, if you like, this.</aside><footer>&copy; me, 2001.</footer>"""


def test_pages(spark, none):
    assert html.main_text(PAGE) == "The & Title\nFirst paragraph, with bold text and more. Second line.\nTiny.\none\ntwo"
    assert html.main_text("<article><p>A.</p><p>B") == "A.\nB" and html.main_text("just text") == "just text"
    assert html.main_text("<p>a &lt;b&gt; <i>c</i>d") == "a <b> cd"
    for broken in ("", "<", "<<>>", "</div></p>", "<p", "<script>never closed", "<!-- never", "&amp", "\x00", "<div " * 50):
        html.main_text(broken)
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", None)], "page_id int, url string, html string, text string")
    got = {r.page_id: r for r in html.extract_pages(df).collect()}
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[None].text == ""
    assert html.extract_pages(df.limit(0)).count() == 0


def pure_quality(text):
    """The policy web-1 in plain Python."""
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    repeat = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    letters = [c for c in text or "" if c.isalpha()]
    return not (len(words) < 20 or 100 * len(repeat) > 30 * len(words) or 10 * sum(c in "#*$%&|<>" for c in text) > len(words) or 2 * sum(map(str.isupper, letters)) > len(letters) or 2 * (len(lines) - len(set(lines))) > len(lines))


def test_pipeline_is_its_stages_by_brute_force(spark, docs, rows, tmp_path):
    """Every stage on what the one before it kept: null ids, repeated rows, null, empty and very long texts are among them."""
    cp = pytest.importorskip("corpus_pipeline")
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tests.llm.test_dedup import brute_repeats
    from tests.llm.test_near import brute_least

    library = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    docs.withColumns({"_h": F.lit("mine"), "key": F.lit(1), "row": F.col("lang"), "rest": F.lit(None).cast("int")}).write.parquet(str(tmp_path / "documents.parquet"))
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    columns, order = at.columns, lambda x: sorted(x, key=str)
    for k, (name, stage) in enumerate(cp.STAGES[:4]):
        path = str(tmp_path / name)
        stage(spark, at, str(tmp_path)).write.parquet(path)
        at = spark.read.parquet(path)
        assert at.columns == columns
        got = order((r.doc_id, r.text) for r in at.collect())
        if k == 0:
            kept = [r for r in kept if pure_quality(r[1])]
        elif k == 1:
            least = brute_least([(r[0], r[1]) for r in kept])
            kept = list({(r[0], r[1]): r for r, own in zip(kept, least, strict=True) if r[0] == own}.values())
        elif k == 2:
            split = [(r[1] or "").encode().split() for r in kept]
            grams = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
            cut = []
            for r, w, (n, gone, _) in zip(kept, split, brute_repeats([r[1] for r in kept], 35), strict=True):
                lost = {j for i in range(n - 34) if grams[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
                if gone < n or not gone:
                    cut.append((r[0], b" ".join(x for j, x in enumerate(w) if j not in lost).decode() if gone else r[1], *r[2:]))
            kept = cut
        else:
            words = lambda t: len(WORD.findall(t or ""))
            sizes, taken = Counter(), Counter()
            for r in kept:
                sizes[r[3]] += words(r[1])
            names = sorted(sizes, key=lambda s: (s is None, s or ""))
            targets = mixing.reshared(dict(sizes), {s: 1 + i % 3 for i, s in enumerate(names)}, 3)
            source = {(r[0], r[1]): r[3] for r in kept}
            times = Counter(got)
            assert set(times) <= set(source) and max(times.values()) <= 3
            for (i, t), n in times.items():
                taken[source[i, t]] += n * words(t)
            largest = {s: max(words(r[1]) for r in kept if r[3] == s) for s in names}
            assert all(abs(taken[s] - targets[s]) <= max(0.05 * targets[s], largest[s] / 2) for s in names)
            continue
        assert got == order((r[0], r[1]) for r in kept), name
    out = cp.run(spark, str(tmp_path))
    expected = []
    for r in at.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and order(map(tuple, out.collect())) == order(expected)


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
