"""Registered queries over landed sources, index runs and the rest of retrieval and usage, each with its SQL.

Bindings: orders are tracker issues and commits, customers mail, suppliers database tables, parts objects; every value in a
landed record follows from the row's numbers, so the SQL side builds the expected resource from the same numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions.text import html_to_text
from loamline.operators import index, search, snapshots
from loamline.operators.snapshots import SnapshotTable
from loamline.plans import retail, usage
from loamline.queries import AS_OF, CHUNKS, QUOTA, chunks, grants, questions, registered, table
from loamline.schemas import CHUNKS as CHUNK_COLUMNS
from loamline.session import checkpointed, shared_root
from loamline.sources import landed

TIME = "TIMESTAMP '2001-02-03 04:05:06'"


def expr(df: DataFrame, **columns: str) -> DataFrame:
    return df.select(*(F.expr(e).alias(c) for c, e in columns.items()))


# issues


def issues(spark: SparkSession, d: str) -> DataFrame:
    """An issue for each order: two comments with text and a blank one, a description of two paragraphs."""
    paragraph = lambda text: f"named_struct('type', 'paragraph', 'content', array(named_struct('type', 'text', 'text', {text})))"
    comment = lambda who, text: f"named_struct('author', {who}, 'body', {text})"
    person = "named_struct('displayName', concat('Clerk ', o_custkey % 9))"
    fields = f"""named_struct('summary', concat('Order ', o_orderkey), 'status', named_struct('name', o_orderstatus), 'assignee', {person},
        'reporter', named_struct('accountId', concat('u', o_custkey), 'displayName', 'R'), 'labels', array(o_orderstatus, 'x'), 'updated', '2001-02-03T04:05:06Z',
        'description', named_struct('type', 'doc', 'content', array({paragraph("concat('For ', o_custkey)")}, {paragraph("concat('By ', concat('Clerk ', o_custkey % 9))")})),
        'comment', named_struct('comments', array({comment(person, "'first'")}, {comment(person, "'  '")}, {comment("CAST(NULL AS STRUCT<displayName: STRING>)", "concat('third ', o_orderkey)")})))"""
    return table(spark, d, "orders").select(F.to_json(F.expr(f"named_struct('key', concat('P', o_custkey % 7, '-', o_orderkey), 'self', concat('http://x/', o_orderkey), 'fields', {fields})")).alias("value"))


ISSUE = """i AS (SELECT 'P' || (o_custkey % 7) || '-' || o_orderkey AS key, 'P' || (o_custkey % 7) AS project, 'Order ' || o_orderkey AS title, o_orderstatus AS status, 'Clerk ' || (o_custkey % 9) AS clerk, 'u' || o_custkey AS reporter,
    'For ' || o_custkey || chr(10) || 'By Clerk ' || (o_custkey % 9) AS description, '1. Clerk ' || (o_custkey % 9) || ': first' || chr(10) || '3. Unknown: third ' || o_orderkey AS comments, o_orderstatus || ', x' AS labels, 'http://x/' || o_orderkey AS url FROM orders)"""


@registered(f"""WITH {ISSUE} SELECT project AS scope, 'jira:' || key AS resource_id, title, '# ' || key || ': ' || title || chr(10) || 'Status: ' || status || chr(10) || 'Type: Unknown' || chr(10) || 'Assignee: ' || clerk || chr(10) || 'Reporter: R' || chr(10)
    || 'Labels: ' || labels || chr(10) || chr(10) || description || chr(10) || chr(10) || 'Comments:' || chr(10) || comments AS text, url, {TIME} AS last_updated, status FROM i""")
def issues_to_resources(spark, d):
    rows = landed.issues_to_resources(issues(spark, d))
    return rows.select("scope", "resource_id", "title", "text", "url", "last_updated", F.col("metadata")["status"].alias("status"))


@registered(f"WITH {ISSUE} SELECT key, description AS text FROM i")
def flatten_rich_text(spark, d):
    return issues(spark, d).select(landed.at("value", "key").alias("key"), landed.flatten_rich_text(landed.at("value", "fields.description")).alias("text"))


@registered(f"WITH {ISSUE} SELECT key, comments FROM i")
def comments_block(spark, d):
    return landed.comments_block(issues(spark, d))


@registered(f"WITH {ISSUE} SELECT key AS subject, 'assigned_to' AS predicate, clerk AS object FROM i UNION ALL SELECT key, 'reported_by', reporter FROM i")
def issue_edges(spark, d):
    return landed.issue_edges(issues(spark, d))


# pages


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Every page in one version, every second one in a newer one too."""
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    old = expr(pages, base_url="'w'", page_id="page_id", space_key="concat('K', page_id % 3)", title="concat('Old ', page_id)", url="url", html="html", version_when=f"{TIME}")
    new = expr(pages.where("page_id % 2 = 0"), base_url="'w'", page_id="page_id", space_key="concat('K', page_id % 3)", title="concat('New ', page_id)", url="url", html="concat('<p>', page_id, ' &lt;&#62;&eacute;</p>')", version_when=f"{TIME} + INTERVAL 1 DAY")
    return old.unionByName(new)


@registered(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'New ' ELSE 'Old ' END || page_id AS title, CASE WHEN page_id % 2 = 0 THEN {TIME} + INTERVAL 1 DAY ELSE {TIME} END AS version_when FROM pages")
def dedupe_pages(spark, d):
    return landed.dedupe_pages(versions(spark, d)).select("page_id", "title", "version_when")


@registered(f"SELECT 'K' || (page_id % 3) AS scope, 'confluence:' || page_id AS resource_id, 'New ' || page_id AS title, '# New ' || page_id || chr(10) || chr(10) || page_id || ' <>é' AS text, url, {TIME} + INTERVAL 1 DAY AS last_updated FROM pages WHERE page_id % 2 = 0")
def pages_since(spark, d):
    """What changed since a time: of pages with two versions the newer one, as text."""
    return landed.pages_to_resources(versions(spark, d), "2001-02-04").drop("source", "metadata")


# database catalogs


def columns(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return expr(s, schema="'dbo'", table="concat('t', s_suppkey)", ordinal="2", column="concat('c', s_nationkey)", type="'varchar(9)'", nullable="s_suppkey % 2 = 0").unionByName(expr(s, schema="'dbo'", table="concat('t', s_suppkey)", ordinal="1", column="'id'", type="'int'", nullable="false"))


DDL = "t AS (SELECT 'dbo.t' || s_suppkey AS name, 'CREATE TABLE dbo.t' || s_suppkey || ' (' || chr(10) || '    id int NOT NULL,' || chr(10) || '    c' || s_nationkey || ' varchar(9) ' || CASE WHEN s_suppkey % 2 = 0 THEN 'NULL' ELSE 'NOT NULL' END || chr(10) || ');' AS ddl FROM supplier)"


@registered(f"WITH {DDL} SELECT name, ddl FROM t")
def table_ddl(spark, d):
    return landed.table_ddl(columns(spark, d))


def objects(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Parts as procedures, views and triggers; every seventh has no definition, a trigger has a row for each event."""
    p = table(spark, d, "part")
    text = "CASE WHEN p_partkey % 7 > 0 THEN concat('-- ', p_name) END"
    own = lambda k, **more: expr(p.where(f"p_partkey % 3 = {k}"), name="concat('dbo.o', p_partkey)", definition=text, modified=TIME, **more)
    events = own(2, table="concat('t', p_size)", status="'enabled'", event="'UPDATE'").unionByName(own(2, table="concat('t', p_size)", status="'enabled'", event="'INSERT'"))
    return {"routines": own(0, object_type="'procedure'"), "views": own(1), "triggers": events}


@registered(f"""WITH {DDL}, o AS (SELECT 'dbo.o' || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'procedure' WHEN 1 THEN 'view' ELSE 'trigger' END AS object_type,
    CASE WHEN p_partkey % 3 = 2 THEN '-- trigger on t' || p_size || ' for INSERT, UPDATE (enabled)' || chr(10) ELSE '' END || '-- ' || p_name AS text, {TIME} AS last_updated FROM part WHERE p_partkey % 7 > 0
    UNION ALL SELECT name, 'table', ddl, NULL FROM t) SELECT 'shop' AS scope, 'sql:shop.' || name AS resource_id, name AS title, object_type, text, last_updated FROM o""")
def catalog_to_resources(spark, d):
    rows = landed.catalog_to_resources("shop", columns=columns(spark, d), **objects(spark, d))
    return rows.select("scope", "resource_id", "title", F.col("metadata")["object_type"].alias("object_type"), "text", "last_updated")


@registered("""WITH o AS (SELECT 'dbo.o' || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'procedure' WHEN 1 THEN 'view' ELSE 'trigger' END AS object_type FROM part UNION ALL SELECT DISTINCT 'DBO.O' || (3 * (s_suppkey % 5)), 'table' FROM supplier)
SELECT lower(name) AS key, CASE WHEN bool_or(object_type = 'table') THEN upper(min(name)) ELSE min(name) END AS name, CASE WHEN bool_or(object_type = 'table') THEN 'table' ELSE min(object_type) END AS object_type FROM o GROUP BY lower(name)""")
def object_catalog(spark, d):
    """Some tables have a procedure's name in capitals: the later kind counts."""
    o = objects(spark, d)
    tables = expr(table(spark, d, "supplier"), name="concat('DBO.O', 3 * (s_suppkey % 5))").distinct()
    return landed.object_catalog(o["routines"], o["views"], tables, o["triggers"].select("name").distinct())


# repositories


def commits(spark: SparkSession, d: str) -> DataFrame:
    return expr(table(spark, d, "orders"), repo="concat('r', o_custkey % 3)", branch="'main'", sha="md5(cast(o_orderkey AS STRING))", committed_at="to_timestamp(o_orderdate)", author_name="concat('Clerk ', o_custkey % 9)", author_email="CASE WHEN o_orderkey % 2 = 0 THEN concat(o_custkey, '@x') END", message="concat('Fix ', o_orderkey, '\\nmore')", files="transform(sequence(1, 40), i -> concat('f', i))", url="'u'")


@registered("""WITH c AS (SELECT 'r' || (o_custkey % 3) || '@main' AS scope, md5(o_orderkey::VARCHAR) AS sha, o_orderdate::TIMESTAMP AS made, 'Clerk ' || (o_custkey % 9) AS clerk, o_orderkey AS k FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY made DESC, sha) AS rn FROM c)
SELECT scope, 'git:' || scope || ':commit:' || sha AS resource_id, 'Fix ' || k AS title, 'Commit ' || left(sha, 8) || chr(10) || 'Author: ' || clerk || chr(10) || 'Fix ' || k || chr(10) || 'more' || chr(10) || 'Files:' || chr(10) || array_to_string(list_transform(range(1, 31), lambda i: 'f' || i), chr(10)) AS text, made AS last_updated FROM n WHERE rn <= 200""")
def commits_to_resources(spark, d):
    return landed.commits_to_resources(commits(spark, d)).select("scope", "resource_id", "title", "text", "last_updated")


@registered("SELECT DISTINCT 'r' || (o_custkey % 3) || '@main' AS subject, 'modified_by' AS predicate, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || '@x' ELSE 'Clerk ' || (o_custkey % 9) END AS object FROM orders")
def commit_edges(spark, d):
    return landed.commit_edges(commits(spark, d))


@registered("SELECT 'git:s@main:file:' || doc_id || '.md' AS resource_id, doc_id || '.md' AS title, '# File: ' || doc_id || '.md' || chr(10) || chr(10) || text AS text, 's@main' AS scope FROM documents")
def files_to_resources(spark, d):
    files = expr(table(spark, d, "documents"), path="concat(doc_id, '.md')", content="text", modified=TIME)
    return landed.files_to_resources(files, "s@main").select("resource_id", "title", "text", "scope")


# mail


@registered(f"""SELECT 'email:outlook:' || c_custkey AS resource_id, c_name AS title, 'Subject: ' || c_name || chr(10) || 'From: N <a' || c_custkey || '@x>' || chr(10) || 'To: N <b@x>; c@x' || chr(10)
    || CASE WHEN c_custkey % 2 = 0 THEN 'Cc: d@x' || chr(10) ELSE '' END || 'Date: 2001-02-03 04:05:06' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '[has attachments]' || chr(10) ELSE '' END || chr(10) || CASE WHEN c_custkey % 5 = 0 THEN 'Hi' || chr(10) || c_mktsegment ELSE c_mktsegment || ' <b>' END AS text, {TIME} AS last_updated FROM customer""")
def mail_to_resources(spark, d):
    """Messages in plain text, every fifth one in HTML."""
    who = lambda name, address: f"named_struct('emailAddress', named_struct('name', {name}, 'address', {address}))"
    value = f"""named_struct('id', c_custkey, 'subject', c_name, 'from', {who("'N'", "concat('a', c_custkey, '@x')")}, 'toRecipients', array({who("'N'", "'b@x'")}, {who("''", "'c@x'")}),
        'ccRecipients', CASE WHEN c_custkey % 2 = 0 THEN array({who("''", "'d@x'")}) END, 'receivedDateTime', '2001-02-03T04:05:06Z', 'hasAttachments', c_custkey % 3 = 0, 'webLink', 'w',
        'body', named_struct('contentType', CASE WHEN c_custkey % 5 = 0 THEN 'HTML' ELSE 'text' END, 'content', CASE WHEN c_custkey % 5 = 0 THEN concat('<p>Hi</p><p>', c_mktsegment, '</p>') ELSE concat(c_mktsegment, ' <b>') END))"""
    raw = table(spark, d, "customer").select(F.to_json(F.expr(value)).alias("value"))
    return landed.mail_to_resources(raw).select("resource_id", "title", "text", "last_updated")


@registered(f"""SELECT 'email:imap:' || c_custkey || '@x' AS resource_id, 'About ' || c_custkey AS title, 'Subject: About ' || c_custkey || chr(10) || 'From: N <n@x>' || chr(10) || 'To: t@x' || chr(10) || 'Date: 2001-02-03 04:05:06' || chr(10) || chr(10) || 'Hello ' || c_mktsegment || chr(10) AS text, {TIME} AS last_updated FROM customer""")
def mail_bytes_to_resources(spark, d):
    text = "concat('Message-ID: <', c_custkey, '@x>\\r\\nSubject: About ', c_custkey, '\\r\\nFrom: N <n@x>\\r\\nTo: t@x\\r\\nDate: Sat, 03 Feb 2001 04:05:06 +0000\\r\\n\\r\\nHello ', c_mktsegment, '\\n')"
    raw = expr(table(spark, d, "customer"), folder="'INBOX'", uid="cast(c_custkey AS STRING)", content=f"encode({text}, 'UTF-8')")
    return landed.mail_bytes_to_resources(raw).select("resource_id", "title", "text", "last_updated")


@registered("""SELECT c_custkey, 'https://mail.yahoo.com/d/search/keyword=' || url_encode(url_encode('"' || c_name || '" from:a' || c_custkey || '@x after:2001-02-02 before:2001-02-04')) AS url FROM customer""")
def mail_search_url(spark, d):
    sent = F.expr(TIME)
    sender = F.concat(F.lit("N <a"), F.col("c_custkey").cast("string"), F.lit("@x>"))
    return table(spark, d, "customer").select("c_custkey", landed.mail_search_url(F.col("c_name"), sender, sent).alias("url"))


# recipes and runs


@registered(f"""SELECT 'ev' AS source, event_type AS scope, 'ev:' || event_id AS resource_id, event_type || ' of ' || user_id AS title, event_type || ' {{' || user_id || '}}' AS text, 'http://x/' || event_id AS url, {TIME} AS last_updated, 'u' || user_id AS who FROM events""")
def recipe_resources(spark, d):
    """Every column of a recipe's resources."""
    raw = table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", F.struct(F.col("user_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name")).alias("user"), F.lit("2001-02-03T04:05:06Z").alias("at"))).alias("value"))
    recipe = {"source": "ev", "id": "{event_id}", "scope": "{event_type}", "title": "{event_type} of {user.id}", "text": "{event_type} {{{user.id}}}", "url": "http://x/{event_id}{missing}", "last_updated": "at", "metadata": {"who": "user.name"}}
    return landed.recipe_to_resources(raw, recipe).select("source", "scope", "resource_id", "title", "text", "url", "last_updated", F.col("metadata")["who"].alias("who"))


@registered("SELECT o_custkey AS customer, o_orderkey AS item FROM orders")
def explode_items(spark, d):
    """Lists of a customer's orders, bare for odd customers and under a path for even ones."""
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))).alias("items"))
    bare = lists.where("o_custkey % 2 = 1").select(F.to_json("items").alias("value"))
    under = lists.where("o_custkey % 2 = 0").select(F.to_json(F.struct(F.struct("items").alias("page"))).alias("value"))
    every = landed.explode_items(bare).unionByName(landed.explode_items(under, "page.items"))
    return every.select(landed.at("value", "c").cast("bigint").alias("customer"), landed.at("value", "k").cast("bigint").alias("item"))


@registered("SELECT DISTINCT source, lang AS scope FROM documents WHERE source = 'src3' OR (source = 'src5' AND lang = 'en')")
def scope_rows(spark, d):
    c = chunks(spark, d)
    return landed.scope_rows(c, "src3").unionByName(landed.scope_rows(c, "src5", "en"))


@registered("""WITH i AS (SELECT doc_id // 8 AS r, doc_id AS n, strlen(text) AS size FROM documents WHERE strlen(text) <= 4000), f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n) AS rn FROM i),
t AS (SELECT * FROM f WHERE rn <= 5 ORDER BY r, n LIMIT 200)
SELECT r AS resource_id, (100 + row_number() OVER (PARTITION BY r ORDER BY n) - 1)::INTEGER AS chunk_index, 'image of ' || size AS text FROM t WHERE size % 3 > 0""")
def caption_rows(spark, d):
    """Texts stand for images, eight to a resource; a third has no caption. The caps are the feature's."""
    images = expr(table(spark, d, "documents"), resource_id="doc_id DIV 8", image_no="doc_id", content="encode(text, 'UTF-8')", next_index="100")
    caption = lambda c: F.when(F.octet_length(c) % 3 > 0, F.concat(F.lit("image of "), F.octet_length(c).cast("string")))
    return landed.caption_rows(images, caption, max_bytes=4000)


@registered("SELECT doc_id, text, [text, 'x'] AS parts, text AS deep FROM documents")
def strip_nul(spark, d):
    """NULs in a string, in an array and in an array inside of a struct."""
    marked = lambda c: F.concat(F.substring(c, 1, 1), F.lit("\x00"), F.substring(c, 2, 1 << 30))
    text = marked(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", text.alias("text"), F.array(text, F.lit("x\x00")).alias("parts"), F.struct(F.array(F.struct(text.alias("t"))).alias("a")).alias("s"))
    return index.strip_nul(rows).select("doc_id", "text", "parts", F.col("s.a")[0]["t"].alias("deep"))


@registered("SELECT doc_id, [length(text)::FLOAT, 1::FLOAT] AS embedding FROM documents")
def embed_chunks(spark, d):
    return index.embed_chunks(table(spark, d, "documents").select("doc_id", "text"), lambda t: F.array(F.char_length(t).cast("float"), F.lit(1.0).cast("float"))).select("doc_id", "embedding")


@registered("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'no resource id' WHEN doc_id % 7 = 0 THEN 'no chunk index' WHEN doc_id % 11 = 0 THEN 'no text' WHEN length(text) > 3000 THEN 'too long' END AS reject_reason FROM documents")
def quarantine(spark, d):
    rows = expr(table(spark, d, "documents"), doc_id="doc_id", resource_id="CASE WHEN doc_id % 5 > 0 THEN concat('d', doc_id) WHEN doc_id % 2 = 0 THEN '' END", chunk_index="CASE WHEN doc_id % 7 > 0 THEN 0 WHEN doc_id % 2 = 0 THEN -1 END", text="CASE WHEN doc_id % 11 > 0 THEN text END")
    good, bad = index.quarantine(rows, 3000)
    return good.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad).select("doc_id", "reject_reason")


def landed_documents(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """Documents as resources; those with odd numbers changed later, every ninth has become empty, or is whole still."""
    return expr(table(spark, d, "documents"), source="source", scope="lang", resource_id="concat('doc:', doc_id)", title="'t'", text="text" if whole else "CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END", url="''", last_updated=f"CASE WHEN doc_id % 2 = 1 THEN {TIME} ELSE TIMESTAMP '2000-01-01 00:00:00' END", metadata="map('k', 'v')")


@registered(f"""WITH p AS (SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 200, 1) - 1) // 800 + 1)) AS i FROM documents WHERE length(text) > 0),
n AS (SELECT 'doc:' || doc_id AS resource_id, i::INTEGER AS chunk_index, substr(text, i * 800 + 1, 1000) AS text, doc_id % 2 = 1 AS is_new FROM p WHERE doc_id % 9 > 0 OR doc_id % 2 = 0) SELECT * FROM n""")
def incremental_ingest(spark, d):
    """A stored index of all documents, whole; a run over what changed since: odd ones are written anew or have gone."""
    before, _ = index.incremental_ingest(landed_documents(spark, d).withColumn("text", F.lit(None).cast("string")), spark.createDataFrame([], CHUNK_COLUMNS), None, "2000-06-01")
    all_ = landed_documents(spark, d, whole=True)
    stored = checkpointed(index.incremental_ingest(all_, before, None, "2000-06-01")[0].withColumn("fingerprint", F.when(F.regexp_extract("resource_id", r"(\d+)$", 1).cast("bigint") % 2 == 1, F.lit("old")).otherwise(F.col("fingerprint"))))
    after, _ = index.incremental_ingest(landed_documents(spark, d), stored, "2001-01-01", AS_OF)
    return after.select("resource_id", "chunk_index", "text", (F.col("updated_at") == F.to_timestamp(F.lit(AS_OF))).alias("is_new"))


@registered("""WITH p AS (SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 200, 1) - 1) // 800 + 1)) AS i FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, length(substr(text, i * 800 + 1, 1000)) > 900 AS long FROM p)
SELECT 1 AS batch, (SELECT count(*) FROM documents) AS read, count(*) FILTER (WHERE NOT long) AS chunks, count(*) FILTER (WHERE NOT long AND doc_id % 2 = 1) AS written, count(*) FILTER (WHERE NOT long AND doc_id % 2 = 0) AS unchanged, count(*) FILTER (WHERE long) AS rejected FROM c""")
def ingest_run(spark, d):
    """The log of a second run over all documents, of which every second one is in the index; chunks over 900 characters are refused."""
    docs = expr(table(spark, d, "documents"), doc_id="doc_id", source="source", scope="lang", resource_id="concat('doc:', doc_id)", title="'t'", text="text", url="''", last_updated=TIME, metadata="map('k', 'v')")
    folder = f"{shared_root(spark)}/run-{uuid.uuid4().hex}"
    stored = SnapshotTable(spark, f"{folder}/index", CHUNK_COLUMNS, buckets=16)
    for batch, part in enumerate((docs.where("doc_id % 2 = 0"), docs)):
        snapshots.ingest_run(part.drop("doc_id"), stored, f"{folder}/rejects", f"{folder}/log", batch, AS_OF, "u", "s", "all", model=lambda t: F.array(F.char_length(t).cast("float")), max_chars=900)
    return spark.read.parquet(f"{folder}/log").where("batch = 1").select("batch", "read", "chunks", "written", "unchanged", "rejected")


@registered(f"SELECT 'u' AS user_id, 's' AS source, count(*) AS n_resources, sum((length(text) - 1) // 800 + 1)::BIGINT AS n_chunks, {TIME} AS last_item, 'done' AS message FROM documents")
def log_row(spark, d):
    results = expr(table(spark, d, "documents"), resource_id="doc_id", n="(char_length(text) - 1) DIV 800 + 1", last_updated=f"CASE WHEN doc_id % 2 = 1 THEN {TIME} ELSE TIMESTAMP '2000-01-01 00:00:00' END")
    return index.log_row(results, "u", "s", "all", "full", AS_OF, message="done").select("user_id", "source", "n_resources", "n_chunks", "last_item", "message")


@registered("""WITH m AS (SELECT l_orderkey AS k, l_linenumber AS n, 'p' || l_partkey AS subject, 's' || l_suppkey AS object, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'p' || l_partkey, 'uses', 's' || l_suppkey) AS rn FROM lineitem WHERE l_orderkey % 3 > 0 AND l_linenumber <> 2)
SELECT 'o' || k AS source_resource_id, subject, 'uses' AS predicate, object, 'llm' AS extraction_method FROM m WHERE rn <= 3 UNION ALL SELECT 'o' || o_orderkey, 'o', 'has', 'c' || o_custkey, 'deterministic' FROM orders""")
def assemble_edges(spark, d):
    """A model's edges of the lines: blank ones, those of databases and those beyond the third are left out."""
    fixed = expr(table(spark, d, "orders"), source="'jira'", source_resource_id="concat('o', o_orderkey)", subject="'o'", predicate="'has'", object="concat('c', o_custkey)")
    model = expr(table(spark, d, "lineitem"), source="CASE WHEN l_orderkey % 3 = 0 THEN 'sql' ELSE 'jira' END", source_resource_id="concat('o', l_orderkey)", subject="concat('p', l_partkey)", predicate="CASE WHEN l_linenumber = 2 THEN ' ' ELSE 'uses' END", object="concat('s', l_suppkey)", ordinal="l_linenumber")
    return index.assemble_edges(fixed, model, 3).select("source_resource_id", "subject", "predicate", "object", "extraction_method")


# retrieval


@registered(f"WITH {CHUNKS} SELECT doc_id FROM c WHERE source = 'src2' AND (source, scope) IN (SELECT source, scope FROM s)")
def scope_filter_source(spark, d):
    scopes = search.query_scopes(questions(spark, d), grants(spark, d))
    return search.scope_filter_source(chunks(spark, d), scopes, "src2").select("doc_id")


@registered("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'T' END, 'O' || doc_id) AS title, 'own' AS lang, source FROM documents")
def merge_hit_metadata(spark, d):
    """A key that the bag has stays, a column that it lacks comes in; a missing title falls back to the object's name."""
    rows = expr(table(spark, d, "documents"), doc_id="doc_id", title="CASE WHEN doc_id % 3 = 0 THEN 'T' END", lang="lang", source="source", metadata="map('lang', 'own', 'object_name', concat('O', doc_id))")
    out = search.merge_hit_metadata(rows, ["lang", "source"])
    return out.select("doc_id", "title", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


@registered("""WITH b AS (SELECT o_custkey AS c, max(o_totalprice::DOUBLE / 1000000) AS best FROM orders GROUP BY 1) SELECT c_custkey AS query_id, CASE WHEN best IS NULL THEN 'no_hits' WHEN best < 0.3 THEN 'low_confidence' ELSE 'ok' END AS status FROM customer LEFT JOIN b ON c = c_custkey""")
def confidence_gate(spark, d):
    hits = expr(table(spark, d, "orders"), query_id="o_custkey", rerank_score="cast(o_totalprice AS DOUBLE) / 1000000")
    return search.confidence_gate(expr(table(spark, d, "customer"), query_id="c_custkey"), hits)


@registered("""WITH r AS (SELECT conv_id, turn, text, turn AS rank FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 3 = 0 THEN rank END, CASE WHEN conv_id % 3 > 0 THEN length(text) END DESC, turn) AS place FROM r)
SELECT conv_id, turn, place::INTEGER AS place FROM n WHERE place <= 2""")
def rerank_failed_model(spark, d):
    """A model of the length, which fails for a turn of every third conversation: that one's order stays."""
    hits = expr(table(spark, d, "conversations"), query_id="conv_id", resource_id="'r'", chunk_index="turn", question="'q'", text="CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN NULL ELSE text END", rank="turn")
    out = search.rerank(hits, 2, lambda q, t: F.char_length(t) / 1e6)
    return out.select(F.col("query_id").alias("conv_id"), F.col("chunk_index").alias("turn"), "place")


@registered("SELECT vec_id AS answer_id FROM embeddings WHERE vec_id % 2 = 1 OR (vec_id % 4 = 0 AND vec_id % 3 > 0)")
def cache_store(spark, d):
    e = expr(table(spark, d, "embeddings"), answer_id="vec_id", skip_cache="CASE WHEN vec_id % 3 = 0 THEN true WHEN vec_id % 3 = 1 THEN false END", status="CASE WHEN vec_id % 4 = 0 THEN 'ok' ELSE 'no_hits' END")
    return search.cache_store(e.where("answer_id % 2 = 1").select("answer_id"), e.where("answer_id % 2 = 0"))


@registered("""WITH c AS (SELECT o_orderkey AS o, l_linenumber AS i, 'x' || l_partkey AS text FROM orders JOIN lineitem ON l_orderkey = o_orderkey), b AS (SELECT o, count(*) AS n, string_agg(text, chr(10) ORDER BY i, text) AS body FROM c GROUP BY o),
h AS (SELECT o_custkey AS q, o, i, text, n, body, row_number() OVER (PARTITION BY o_custkey ORDER BY o, i) AS place FROM c JOIN b USING (o) JOIN orders ON o_orderkey = o WHERE i % 2 = 1)
SELECT q AS query_id, 'o' || o AS resource_id, CASE WHEN n BETWEEN 2 AND 4 THEN body ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY q, o ORDER BY place, i) AS rn FROM h) WHERE rn = 1 OR NOT n BETWEEN 2 AND 4""")
def reassemble_objects(spark, d):
    """Lines as chunks of their orders; a customer's odd lines are the hits. Orders of two to four lines come whole, once."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = expr(lines, query_id="o_custkey", source="'sql'", resource_id="concat('o', o_orderkey)", o="o_orderkey", chunk_index="l_linenumber", text="concat('x', l_partkey)")
    place = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY o, chunk_index)")
    hits = parts.where("chunk_index % 2 = 1").withColumn("place", place)
    return search.reassemble_objects(hits.drop("o"), parts.select("resource_id", "chunk_index", "text"), 4).select("query_id", "resource_id", "text")


@registered("""WITH k AS (SELECT p_partkey AS k FROM part), e AS (SELECT a.k AS x, b.k AS y FROM k a JOIN k b ON b.k = a.k // 2 WHERE b.k <> a.k), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
h1 AS (SELECT DISTINCT k.k AS q, y AS n, 1 AS hop FROM k JOIN b ON x = k.k), h2 AS (SELECT DISTINCT q, b.y AS n, 2 AS hop FROM h1 JOIN b ON x = h1.n WHERE b.y <> q AND (q, b.y) NOT IN (SELECT q, n FROM h1)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hop, 'v' || n) AS rn FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)) SELECT q AS query_id, 'v' || n AS name FROM r WHERE rn <= 5""")
def include_dependencies(spark, d):
    """Objects within two hops of a part's own object, over edges to the object of half its number."""
    k = expr(table(spark, d, "part"), k="cast(p_partkey AS BIGINT)")
    edges = expr(k, subject="concat('v', k)", object="concat('v', k DIV 2)", h="k DIV 2", k="k").join(k.select(F.col("k").alias("h")), "h").where("h <> k")
    hits = expr(k, query_id="k", source="'sql'", resource_id="concat('r', k)")
    return search.include_dependencies(hits, edges, expr(k, resource_id="concat('r', k)", name="concat('v', k)"), 5, 2).select("query_id", "name")


@registered(f"""{QUOTA}, c2 AS (SELECT query_id, p.resource_id, score, c.text FROM p JOIN c ON c.resource_id = p.resource_id WHERE place <= 8), b AS (SELECT query_id, resource_id, max(score) AS score, any_value(text) AS body FROM c2 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resource_id) AS number FROM b) SELECT query_id, number::INTEGER AS number, '[' || number || '] ' || body AS block FROM n""")
def context_blocks(spark, d):
    from loamline.operators import keywords

    c = chunks(spark, d)
    hits = keywords.retrieve(questions(spark, d), c, grants(spark, d), mode="vector").join(c.select("resource_id", "text"), "resource_id")
    return search.numbered_context(hits).select("query_id", "number", "block")


# reports and usage


@registered(f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN {TIME} WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '{AS_OF}' END AS modified FROM orders")
def touch_modified(spark, d):
    rows = expr(table(spark, d, "orders"), k="o_orderkey", operation="CASE WHEN o_orderkey % 2 = 0 THEN 'UPDATE' ELSE 'INSERT' END", modified=f"CASE WHEN o_orderkey % 3 = 0 THEN {TIME} END")
    return retail.touch_modified(rows, AS_OF).select("k", "modified")


@registered("SELECT event_id, (CASE WHEN event_id % 4 < 3 THEN event_id ELSE 0 END)::BIGINT AS prompt_tokens, (CASE WHEN event_id % 4 < 3 THEN user_id + 1 ELSE 0 END)::BIGINT AS completion_tokens FROM events")
def usage_from_payload(spark, d):
    """Three shapes of answers, the second one beside an empty first, and none."""
    both = lambda a, b: f"named_struct('{a}', event_id, '{b}', user_id + 1)"
    shapes = f"""CASE event_id % 4 WHEN 0 THEN to_json(named_struct('usage_metadata', {both('input_tokens', 'output_tokens')}))
        WHEN 1 THEN to_json(named_struct('usage_metadata', named_struct('input_tokens', 0), 'response_metadata', named_struct('token_usage', {both('prompt_tokens', 'completion_tokens')})))
        WHEN 2 THEN to_json(named_struct('response_metadata', named_struct('usage', {both('input_tokens', 'output_tokens')}))) ELSE 'nothing' END"""
    return usage.usage_from_payload(expr(table(spark, d, "events"), event_id="event_id", payload=shapes)).select("event_id", "prompt_tokens", "completion_tokens")


@registered("SELECT doc_id, left(text, 4000) AS prompt, left(text, 2000) AS error, left(text, 128) AS step_name FROM documents")
def audit_and_step_rows(spark, d):
    rows = expr(table(spark, d, "documents"), doc_id="doc_id", prompt="text", error="text", step_name="text")
    return usage.step_rows(usage.audit_rows(rows))


@registered("SELECT l_linenumber::BIGINT AS ordinal, l_partkey AS part FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)")
def steps_of(spark, d):
    """The steps of one row, as the feature asks: the lines of the first order."""
    steps = expr(table(spark, d, "lineitem"), audit_id="l_orderkey", ordinal="cast(l_linenumber AS BIGINT)", part="l_partkey")
    return usage.steps_of(steps, steps.agg(F.min("audit_id")).first()[0]).select("ordinal", "part")


@registered("SELECT step_name, count(*) AS n_calls, max(value) AS max_ms FROM (SELECT event_type AS step_name, value, ts FROM events) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1")
def slow_steps_of_a_day(spark, d):
    steps = expr(table(spark, d, "events"), step_name="event_type", duration_ms="value", created_at="ts")
    newest = steps.agg(F.max("created_at")).first()[0]
    return usage.slow_steps(steps, F.lit(newest) - F.expr("INTERVAL 24 HOURS")).select("step_name", "n_calls", "max_ms")


@registered("SELECT DISTINCT p_brand AS scope, p_type AS object_name, p_size AS object_type FROM part WHERE p_size % 2 = 0")
def catalog_listing(spark, d):
    return usage.catalog_listing(expr(table(spark, d, "part"), source="CASE WHEN p_size % 2 = 0 THEN 'sql' ELSE 'git' END", scope="p_brand", object_name="p_type", object_type="p_size"))


@registered("SELECT examined, updated, examined - updated AS fell_back, total - examined AS remaining FROM (SELECT count(*) AS total, count(*) FILTER (WHERE url LIKE '%/en/%') AS examined, count(*) FILTER (WHERE url LIKE '%/en/%' AND page_id % 2 = 0) AS updated FROM pages)")
def backfill_report(spark, d):
    return index.backfill_urls(table(spark, d, "pages"), ["%/en/%"], F.when(F.col("page_id") % 2 == 0, F.lit("new")))[1]


@registered("SELECT page_id, 'é < €&x; ' || page_id || ' & b' AS text FROM pages")
def html_character_references(spark, d):
    html = F.concat(F.lit("<p>&eacute;&nbsp;&lt; &#8364;&amp;x;</p><script>x</script> "), F.col("page_id").cast("string"), F.lit(" &#x26; b"))
    return table(spark, d, "pages").select("page_id", F.replace(html_to_text(html), F.lit("\n"), F.lit(" ")).alias("text"))
