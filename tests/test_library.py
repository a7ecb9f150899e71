"""Index maintenance, retrieval, reports, usage, sources, ad hoc queries and streams on small literal tables."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from loamline.functions.text import fingerprint, html_to_text, is_tracing
from loamline.operators import index, keywords, search
from loamline.operators.snapshots import SnapshotTable
from loamline.plans import adhoc, retail, usage
from loamline.schemas import CHUNKS
from loamline.sources import landed
from loamline.streaming import ingest


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def resources(spark, *items):
    return spark.createDataFrame([("s", "all", i, "t", text, "u", t, {"k": "v"}) for i, text, t in items], "source string, scope string, resource_id string, title string, text string, url string, last_updated string, metadata map<string,string>").withColumn("last_updated", F.to_timestamp("last_updated"))


# functions


def test_fingerprint_and_text(spark):
    df = spark.createDataFrame([(" A\tb\x00 ",), ("a B",), ("",), (" \n",), (None,)], "t string")
    got = [r.f for r in df.select(fingerprint(F.col("t")).alias("f")).collect()]
    assert got[0] == got[1] is not None and got[2:] == [None] * 3
    html = spark.createDataFrame([("<script>x()</script><p>A &amp; B</p><p>c<br>d</p>",)], "t string")
    assert html.select(html_to_text(F.col("t")).alias("x")).first().x == "A & B\nc\nd"
    q = spark.createDataFrame([("What depends on X?",), ("impactful",), (None,)], "t string")
    assert [r.x for r in q.select(is_tracing(F.col("t")).alias("x")).collect()] == [True, False, False]


# index


def test_recursive_chunks_keep_size_and_words():
    text = "One two three. Four five six.\n\nSeven eight nine ten eleven. Twelve.\n" + "x" * 70
    parts = index.split_recursive(text, 30, 10)
    assert all(0 < len(p) <= 30 for p in parts) and set(text.split()) - {"x" * 70} <= set(" ".join(parts).split())
    assert index.split_recursive("", 10, 2) == [] and index.split_recursive("short", 10, 2) == ["short"]


def test_ingest_twice_is_once_and_prunes(spark):
    empty = spark.createDataFrame([], CHUNKS)
    first, counts = index.incremental_ingest(resources(spark, ("a", "x" * 2000, "2001-01-01"), ("b", "hello", "2001-01-02")), empty, None, "2001-02-01")
    first = first.cache()
    assert rows(first, "resource_id", "chunk_index") == [("a", 0), ("a", 1), ("a", 2), ("b", 0)] and rows(counts, "resource_id", "n") == [("a", 3), ("b", 1)]
    again, _ = index.incremental_ingest(resources(spark, ("a", "x" * 2000, "2001-01-01"), ("b", "hello", "2001-01-02")), first, None, "2001-03-01")
    assert rows(again, *CHUNKS.names) == rows(first, *CHUNKS.names)
    shorter, _ = index.incremental_ingest(resources(spark, ("a", "x" * 900, "2001-01-03"), ("b", "", "2001-01-03")), first, None, "2001-03-01")
    assert rows(shorter, "resource_id", "chunk_index", "created_at", "updated_at")[0][:2] == ("a", 0) and shorter.count() == 1
    late, _ = index.incremental_ingest(resources(spark, ("b", "other", "2001-01-02")), first, "2001-01-03", "2001-03-01")
    assert rows(late, *CHUNKS.names) == rows(first, *CHUNKS.names)


def test_upsert_keeps_keys_unique_and_refreshes_if_asked(spark):
    stored, _ = index.incremental_ingest(resources(spark, ("a", "x", "2001-01-01")), spark.createDataFrame([], CHUNKS), None, "2001-02-01")
    new = index.with_fingerprint(index.chunk_fixed(resources(spark, ("a", "x", "2001-01-05"), ("a", "x", "2001-01-04")).withColumn("title", F.lit("new")))).withColumn("embedding", F.lit(None).cast("array<float>"))
    for refresh, title in ((False, "t"), (True, "new")):
        assert rows(index.upsert_chunks(new, stored, "2001-03-01", refresh), "resource_id", "title") == [("a", title)]


def test_filters_grants_edges_and_log(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "source string, n int")
    assert rows(index.delete_by_filter(df, {"source": ["a"]}), "n") == [(2,), (3,)]
    assert index.delete_by_filter(df, {}, allow_all=True).count() == 0
    with pytest.raises(ValueError):
        index.delete_by_filter(df, {"unknown": 1})
    grants = spark.createDataFrame([("u", "s", "x", None)], "user_id string, source string, scope string, last_synced timestamp")
    more = spark.createDataFrame([("u", "s", "x"), ("u", "s", "y"), ("u", "s", "y")], "user_id string, source string, scope string")
    twice = index.grant_access(index.grant_access(grants, more, "2001-01-01"), more, "2001-01-02")
    assert rows(index.list_accessible(twice, "u"), "scope") == [("x",), ("y",)] and index.revoke_access(twice, more).count() == 0
    log = index.log_row(spark.createDataFrame([("a", 2, "2001-01-01")], "resource_id string, n int, last_updated string").withColumn("last_updated", F.to_timestamp("last_updated")), "u", "s", "x", "full", "2001-02-01", message="m" * 2000)
    assert len(log.first().message) == 1000 and str(index.high_water(log, "u", "s", "x").first()[0])[:10] == "2001-01-01"
    assert index.high_water(log, "v", "s", "x").first()[0] is None
    edge = "source string, source_resource_id string, subject string, predicate string, object string"
    model = spark.createDataFrame([("wiki", "r", f"s{i}", "p", "o" if i else " ", i) for i in range(14)] + [("sql", "q", "a", "b", "c", 0)], edge + ", ordinal int")
    out = index.assemble_edges(spark.createDataFrame([("wiki", "r", "a", "b", "c")], edge), model)
    assert out.groupBy("extraction_method").count().orderBy("extraction_method").collect()[1][1] == 10 and out.where("source = 'sql'").count() == 0


def test_quarantine_and_backfill(spark):
    df = spark.createDataFrame([("a", 0, "x"), (None, 0, "x"), ("b", -1, "x"), ("c", 0, None)], "resource_id string, chunk_index int, text string")
    good, bad = index.quarantine(df)
    assert good.count() == 1 and sorted(r.reject_reason for r in bad.collect()) == ["no chunk index", "no resource id", "no text"]
    urls = spark.createDataFrame([("http://old/1", "n"), ("http://old/2", None), ("http://new", "n")], "url string, made string")
    after, report = index.backfill_urls(urls, ["http://old/%"], F.col("made"))
    assert rows(after, "url") == [("http://new",), ("http://old/2",), ("n",)] and tuple(report.first()) == (2, 1, 1, 1)


# retrieval


def test_search_grammar(spark):
    chunks = spark.createDataFrame([("s", "x", "a", 0, "t", "red apple pie"), ("s", "x", "b", 0, "apple", "green pie apple"), ("s", "x", "c", 0, "t", "blue sky")], "source string, scope string, resource_id string, chunk_index int, title string, text string")
    ask = lambda text: {r.resource_id for r in search.keyword_match(search.parse_search(spark.createDataFrame([(1, text)], "query_id int, text string")), search.postings(chunks), spark.createDataFrame([(1, "s", "x")], "query_id int, source string, scope string")).collect()}
    assert ask("apple pie") == {"a", "b"} and ask('"apple pie"') == {"a"} and ask("apple -red") == {"b"} and ask("sky OR red") == {"a", "c"} and ask('"" -') == set()
    ranked = keywords.keyword_rank(search.keyword_match(search.parse_search(spark.createDataFrame([(1, "apple")], "query_id int, text string")), search.postings(chunks), spark.createDataFrame([(1, "s", "x")], "query_id int, source string, scope string")))
    assert [r.resource_id for r in ranked.orderBy("rank").collect()] == ["b", "a"]


def test_fusion_quota_and_gate(spark):
    leg = "query_id int, source string, resource_id string, chunk_index int, score double"
    v = spark.createDataFrame([(1, "s", f"r{i}", 0, 1 - i / 10) for i in range(6)] + [(1, "t", "z", 0, 0.1)], leg)
    k = spark.createDataFrame([(1, "s", "r5", 0, 9.0)], leg)
    fused = search.rrf(v, k)
    assert fused.orderBy("rank").first().resource_id == "r5" and fused.count() == 7
    for cap, top_k, wanted in ((2, 3, 3), (2, 10, 7), (9, 4, 4)):
        got = search.source_quota(fused, top_k, cap).collect()
        assert len(got) == wanted and sorted(r.place for r in got) == list(range(1, wanted + 1))
    assert {r.resource_id for r in search.source_quota(fused, 3, 2).collect()} >= {"z"}
    hits = v.withColumns({"question": F.lit("red apple"), "text": F.lit("an apple")})
    best = search.rerank(hits, 3)
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    assert rows(search.confidence_gate(queries, best), "query_id", "status") == [(1, "ok"), (2, "no_hits")] and rows(search.confidence_gate(queries, best, 0.9), "status")[0] == ("low_confidence",)


def test_scopes_and_cache(spark):
    grants = spark.createDataFrame([("u", "s", "x"), ("u", "t", "y")], "user_id string, source string, scope string")
    df = spark.createDataFrame([("s", "x", 1), ("t", "z", 2)], "source string, scope string, n int")
    assert rows(search.row_policy(df, grants, "u"), "n") == [(1,)] and search.row_policy(df, grants, None).count() == 0 and search.row_policy(df, grants, "v").count() == 0
    q = spark.createDataFrame([(1, "u", "en"), (2, "u", "en"), (3, "v", "en")], "query_id int, user_id string, language string")
    prints = {r.query_id: r.scope_fingerprint for r in search.scope_fingerprint(search.query_scopes(q, grants), q).collect()}
    assert prints[1] == prints[2] and 3 not in prints


def test_objects_and_dependencies(spark):
    hits = spark.createDataFrame([(1, "sql", "o1", 1, 0.9, "b", 1), (1, "sql", "o1", 0, 0.8, "a", 2), (1, "wiki", "w", 0, 0.5, "w", 3)], "query_id int, source string, resource_id string, chunk_index int, score double, text string, place int")
    chunks = spark.createDataFrame([("o1", i, c) for i, c in enumerate("abc")] + [("w", 0, "w")], "resource_id string, chunk_index int, text string")
    assert rows(search.reassemble_objects(hits, chunks), "resource_id", "text") == [("o1", "a\nb\nc"), ("w", "w")]
    edges = spark.createDataFrame([("n1", "calls", "n2"), ("n3", "calls", "n1"), ("n4", "calls", "n5")], "subject string, predicate string, object string")
    objects = spark.createDataFrame([("o1", "n1"), ("o2", "n2"), ("o3", "n3"), ("o4", "n4")], "resource_id string, name string")
    assert rows(search.include_dependencies(hits, edges, objects), "name", "score") == [("n2", 0.0), ("n3", 0.0)]
    assert [r.block for r in search.numbered_context(hits).orderBy("number").collect()] == ["[1] a\nb", "[2] w"]


# reports, usage and ad hoc queries


def test_fiscal_period_and_net(spark):
    df = spark.createDataFrame([("2024-07-01", 3, "10.05", "33.33"), ("2024-06-30", 1, "0.01", "50.00")], "d string, q int, p string, x string")
    got = df.select(retail.fiscal_period(F.to_date("d")).alias("f"), retail.net_line_amount(F.col("q"), F.col("p").cast("decimal(12,2)"), F.col("x").cast("decimal(5,2)")).alias("n")).collect()
    assert [(r.f, str(r.n)) for r in got] == [("FY2025-07", "20.10"), ("FY2024-06", "0.01")]


def test_costs_and_payloads(spark):
    audit = spark.createDataFrame([("p", "X-Model-mini", 1000, 0), ("p", "x-model", 1000, 1000), (None, None, 1000, None)], "provider string, model string, prompt_tokens int, completion_tokens int")
    rates = spark.createDataFrame([("p", "x-model", 1.0, 2.0), ("p", "x-model-mini", 0.5, 0.5)], "provider string, model_key string, rate_in double, rate_out double")
    assert sorted(round(r.cost, 6) for r in usage.estimate_cost(audit, rates).collect()) == [0.001, 0.5, 3.0]
    raw = spark.createDataFrame([(json.dumps({"usage_metadata": {"input_tokens": 3, "output_tokens": 4}}),), (json.dumps({"response_metadata": {"usage": {"input_tokens": 5}}}),), ("broken",), (None,)], "payload string")
    assert sorted(r.total_tokens for r in usage.usage_from_payload(raw).collect()) == [0, 0, 5, 7]


@pytest.mark.parametrize("bad", ["", "DROP TABLE t", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT * FROM t -- x\n; DELETE FROM t", "SELECT sp_who()", "EXPLAIN SELECT 1", "SET x = 1", "/* SELECT */ UPDATE t SET a = 1"])
def test_refused(bad):
    with pytest.raises(adhoc.Refused):
        adhoc.check_select(bad)


def test_ad_hoc_select_is_capped(spark):
    t = spark.range(500)
    assert adhoc.run_select(spark, "SELECT id FROM t WHERE 'a;b' <> 'drop' -- c", {"t": t}).count() == 50
    assert adhoc.run_select(spark, "WITH a AS (SELECT * FROM t) SELECT * FROM a;", {"t": t}, 1000).count() == 100
    spark.range(3).createOrReplaceTempView("t")
    spark.range(4).createOrReplaceTempView("secret")
    assert adhoc.run_select(spark, "SELECT count(*) AS n FROM t WHERE id IN (SELECT id FROM t)", {"t": t}).first().n == 500 and spark.table("t").count() == 3
    for query in ("SELECT * FROM secret", "SELECT * FROM t WHERE id IN (SELECT id FROM secret)", "SELECT * FROM parquet.`/tmp/x`", "SELECT (SELECT max(id) FROM secret) FROM t"):
        with pytest.raises(adhoc.Refused):
            adhoc.run_select(spark, query, {"t": t})


# sources


def test_issues(spark):
    body = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "Hello "}, {"type": "text", "text": "you"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "Bye"}]}]}
    issue = {"key": "AB-1", "fields": {"summary": "S", "description": body, "updated": "2001-01-01T00:00:00Z", "labels": ["x", "y"], "assignee": {"displayName": "A", "accountId": "id1"}, "comment": {"comments": [{"author": {"displayName": "C"}, "body": "one"}, {"body": " "}, {"body": "three"}]}}}
    raw = spark.createDataFrame([(json.dumps(issue),)], "value string")
    r = landed.issues_to_resources(raw).first()
    assert (r.scope, r.resource_id) == ("AB", "jira:AB-1") and "Hello you\nBye" in r.text and "1. C: one\n3. Unknown: three" in r.text and "Reporter: Unknown" in r.text and "Labels: x, y" in r.text
    assert rows(landed.issue_edges(raw), "predicate", "object") == [("assigned_to", "id1")]


def test_mail_of_three_shapes(spark):
    graph = {"id": "1", "subject": "Hi", "from": {"emailAddress": {"name": "A", "address": "a@x"}}, "toRecipients": [{"emailAddress": {"address": "b@x"}}], "receivedDateTime": "2001-01-01T00:00:00Z", "body": {"contentType": "html", "content": "<p>Yo</p>"}, "hasAttachments": True}
    r = landed.mail_to_resources(spark.createDataFrame([(json.dumps(graph),)], "value string")).first()
    assert r.resource_id == "email:outlook:1" and "From: A <a@x>" in r.text and "[has attachments]" in r.text and r.text.endswith("Yo")
    gmail = {"id": "2", "threadId": "t", "internalDate": "978307200000", "payload": {"headers": [{"name": "Subject", "value": "S"}, {"name": "From", "value": "a@x"}], "parts": [{"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": "SGVsbG8"}}]}, {"filename": "f.pdf", "body": {"data": "AAAA"}}]}}
    r = landed.mail_to_resources(spark.createDataFrame([(json.dumps(gmail),)], "value string"), "gmail").first()
    assert r.text.endswith("Hello") and "[has attachments]" in r.text and str(r.last_updated)[:10] == "2001-01-01"
    raw = b"Subject: Q3 plan\r\nFrom: A <a@x>\r\nTo: b@x\r\nDate: Mon, 01 Jan 2001 00:00:00 +0000\r\n\r\nBody\r\n"
    df = spark.createDataFrame([("in", "7", bytearray(raw)), ("in", "8", bytearray(b"Message-ID: <m@x>\r\n" + raw))], "folder string, uid string, content binary")
    got = {r.resource_id: r for r in landed.mail_bytes_to_resources(df).collect()}
    assert "email:imap:m@x" in got and len(got) == 2 and "%2522Q3%2520plan%2522" in got["email:imap:m@x"].url


def test_catalog_recipe_and_commits(spark):
    cols = spark.createDataFrame([("dbo", "T", 2, "b", "int", True), ("dbo", "T", 1, "a", "int", False)], "schema string, table string, ordinal int, column string, type string, nullable boolean")
    obj = spark.createDataFrame([("dbo.p", "procedure", "CREATE", None), ("dbo.q", "procedure", None, None)], "name string, object_type string, definition string, modified timestamp")
    trig = spark.createDataFrame([("dbo.g", "dbo.T", e, "enabled", "CREATE TRIGGER", None) for e in ("UPDATE", "INSERT")], "name string, table string, event string, status string, definition string, modified timestamp")
    got = {r.title: r.text for r in landed.catalog_to_resources("db", obj, obj.limit(0), trig, cols).collect()}
    assert set(got) == {"dbo.p", "dbo.g", "dbo.T"} and got["dbo.T"].index("a int") < got["dbo.T"].index("b int") and "INSERT, UPDATE" in got["dbo.g"]
    raw = landed.explode_items(spark.createDataFrame([(json.dumps({"d": {"items": [{"n": 1, "u": {"x": "y"}}, {"n": 2}]}}),)], "value string"), "d.items")
    recipe = {"source": "gh", "id": "{n}", "text": "{{{n}}} by {u.x}", "title": "#{n}", "scope": "r"}
    assert rows(landed.recipe_to_resources(raw, recipe), "resource_id", "text") == [("gh:1", "{1} by y"), ("gh:2", "{2} by ")]
    commits = spark.createDataFrame([("r", "main", "abcdef0123", "First line\nmore", "N", None, ["f"] * 40, "u", None)], "repo string, branch string, sha string, message string, author_name string, author_email string, files array<string>, url string, committed_at timestamp")
    r = landed.commits_to_resources(commits).first()
    assert r.title == "First line" and r.text.count("\nf") == 30 and rows(landed.commit_edges(commits), "object") == [("N",)]


def test_windows_of_time(spark):
    df = spark.createDataFrame([("2001-01-31",), ("2001-02-01",), ("2001-02-28",), ("2001-03-01",)], "last_updated string").withColumn("last_updated", F.to_timestamp("last_updated"))
    n = lambda *a, **k: landed.time_window(df, *a, **k).count()
    assert (n("full"), n("month", month="2001-02-10"), n("incremental", as_of="2001-03-05"), n("incremental", since="2001-02-28")) == (4, 2, 2, 2)


# streams


def test_stream_ingest_is_the_batch_one(spark, tmp_path):
    landing, state = (str(tmp_path / x) for x in ("landing", "state"))
    out = SnapshotTable(spark, str(tmp_path / "index"), CHUNKS, buckets=8)
    first = resources(spark, ("a", "x" * 1200, "2001-01-01"), ("a", "old", "2000-01-01"), ("b", "hello", "2001-01-02"))
    first.write.mode("append").parquet(landing)
    for _ in range(2):  # the second run finds nothing new
        ingest.stream_ingest(spark.readStream.schema(first.schema).parquet(landing), out, state, "2001-02-01").awaitTermination()
    resources(spark, ("b", "changed", "2001-01-03"), ("a", "older", "2000-06-01")).write.mode("append").parquet(landing)
    ingest.stream_ingest(spark.readStream.schema(first.schema).parquet(landing), out, state, "2001-02-01").awaitTermination()
    expected, _ = index.incremental_ingest(resources(spark, ("a", "x" * 1200, "2001-01-01"), ("b", "changed", "2001-01-03")), spark.createDataFrame([], CHUNKS), None, "2001-02-01")
    assert rows(out.read(), "resource_id", "chunk_index", "text") == rows(expected, "resource_id", "chunk_index", "text")


def test_stream_usage_and_audit(spark, tmp_path):
    events = spark.createDataFrame([(f"2001-01-01 0{h}:30:00", 1, float(h)) for h in range(8)], "created_at string, user_id int, value double").withColumn("created_at", F.to_timestamp("created_at"))
    events.write.parquet(str(tmp_path / "e"))
    ingest.stream_usage(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "o"))
    assert 0 < closed.count() < 8 and closed.join(ingest.usage_windows(events), closed.columns, "left_anti").count() == 0
    feed = spark.createDataFrame([("t", 1, None, "x", None), ("t", 2, "x", "y", None), ("t", 3, "x", None, None), ("t", 4, "x", "x", None)], "table_name string, record_id int, before string, after string, changed_at timestamp")
    feed.write.parquet(str(tmp_path / "f"))
    ingest.stream_audit(spark.readStream.schema(feed.schema).parquet(str(tmp_path / "f")), str(tmp_path / "ao"), str(tmp_path / "ac")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "ao")), "record_id", "operation") == [(1, "INSERT"), (2, "UPDATE"), (3, "DELETE")]


def test_stream_inventory_moves_each_batch_once(spark, tmp_path):
    """The fullest warehouse of the customer's region serves, down to 0; a second run without new lines changes nothing."""
    t = {
        "employees": spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "employee_id int, region_id int"),
        "orders": spark.createDataFrame([(10, 100)], "order_id int, customer_id int"),
        "customers": spark.createDataFrame([(100, 7)], "customer_id int, region_id int"),
        "stock": spark.createDataFrame([(5, 1, 4), (5, 2, 9), (5, 3, 50)], "product_id int, warehouse_id int, on_hand bigint"),
    }
    landing, state = (str(tmp_path / x) for x in ("lines", "state"))
    out = SnapshotTable(spark, str(tmp_path / "stock"), t["stock"].schema, "product_id", 4)
    out.replace(t["stock"], list(range(4)), -1)
    lines = lambda *own: spark.createDataFrame([(10, no, 5, n) for no, n in own], "order_id int, line_no int, product_id int, quantity bigint")

    def stock():
        landed_lines = spark.readStream.schema(lines((1, 1)).schema).parquet(landing)
        ingest.stream_inventory(landed_lines, lambda: t, out, state).awaitTermination()
        return rows(out.read(), "warehouse_id", "on_hand")

    lines((1, 6)).write.mode("append").parquet(landing)
    assert stock() == stock() == [(1, 4), (2, 3), (3, 50)]
    lines((2, 9)).write.mode("append").parquet(landing)
    assert stock() == [(1, 0), (2, 3), (3, 50)]


def test_vectors_by_hashing_are_sums_of_signs(spark):
    """Also of null; the text is parted once, not for each component."""
    df = spark.createDataFrame([("One two, two. THREE one two",), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(index.hashed_vector(F.col("text"), 8)).collect()]
    signs = spark.sql("SELECT pmod(xxhash64(w), 8) AS i, IF(pmod(xxhash64(w, 1), 2) = 0, 1.0D, -1.0D) AS x FROM VALUES ('one'), ('two'), ('two'), ('three'), ('one'), ('two') AS t(w)").collect()
    assert got == [[sum(r.x for r in signs if r.i == i) for i in range(8)], [0.0] * 8, [None] * 8]
    plan = df.select(index.hashed_vector(F.col("text")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("split(") < plan.index("sequence(") if "sequence(" in plan else plan.count("split(") == 1


def test_mail_is_dealt_to_tasks_by_its_size(spark):
    raw = spark.range(4000).coalesce(1).select(F.lit("INBOX").alias("folder"), F.col("id").cast("string").alias("uid"), F.encode(F.concat(F.lit("Message-ID: <"), F.col("id").cast("string"), F.lit("@x>\r\n\r\n"), F.repeat(F.lit("x"), 800)), "UTF-8").alias("content"))
    assert landed.mail_bytes_to_resources(raw).rdd.getNumPartitions() == 4


def test_a_run_moves_texts_once_to_their_key(spark):
    """Behind the join of stored and new rows nothing is joined or shuffled again."""
    kinds = "source string, scope string, resource_id string, title string, text string, url string, last_updated timestamp, metadata map<string,string>"
    time = datetime.datetime(2001, 2, 3)
    row = lambda k, text, day=0: ("s", "x", f"r{k}", "t", text, "", time + datetime.timedelta(days=day), {})
    empty = spark.createDataFrame([], CHUNKS)
    first, _ = index.incremental_ingest(spark.createDataFrame([row(k, "a" * 2500) for k in range(4)], kinds), empty, None, "2001-03-01")
    stored = first.localCheckpoint()
    new = spark.createDataFrame([row(0, "b" * 900, 1), row(0, "old"), row(1, ""), row(2, "a" * 2500), row(3, "a" * 1700)], kinds)
    after, counts = index.incremental_ingest(new, stored, None, "2001-04-01")
    got = sorted((r.resource_id, r.chunk_index, len(r.text), r.updated_at.month) for r in after.collect())
    assert got == [("r0", 0, 900, 4), ("r2", 0, 1000, 3), ("r2", 1, 1000, 3), ("r2", 2, 900, 3), ("r3", 0, 1000, 3), ("r3", 1, 900, 4)]
    assert sorted((r.resource_id, r.n) for r in counts.collect()) == [("r0", 1), ("r1", 0), ("r2", 3), ("r3", 2)]
    plan = after._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("FullOuter")]
    assert "Join" not in top.replace("SortMergeJoin", "", 1) and "Exchange" not in top
