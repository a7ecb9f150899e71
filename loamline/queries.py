"""The registered queries over the generated tables, each with the SQL that gives the same rows.

Bindings: documents are chunks (scope: language), embeddings their vectors by id, benchmark and conversation turns the
questions, events audit rows and steps, orders and lines the retail tables. User u may see source i if i % 5 = u % 5.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamline.functions.text import fingerprint, html_to_text
from loamline.operators import index, keywords, lineage, quantized, search
from loamline.plans import adhoc, retail, usage
from loamline.operators.snapshots import SnapshotTable
from loamline.session import checkpointed, shared_root
from loamline.sources import landed
from loamline.streaming.ingest import latest_version, usage_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
AS_OF = "2001-08-01"


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    rows = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    title = F.split("text", "\n")[0]
    return rows.select("source", F.col("lang").alias("scope"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("resource_id"), F.lit(0).alias("chunk_index"), title.alias("title"), "text", fingerprint(F.col("text")).alias("fingerprint"), "embedding", "doc_id")


def grants(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "documents").select("source", F.col("lang").alias("scope")).distinct()
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return sources.where("source IS NOT NULL").select(F.concat(F.lit("u"), (number % 5).cast("string")).alias("user_id"), "source", "scope")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The first vectors' rows ask, each for a user, with a benchmark text."""
    q = table(spark, d, "benchmark").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    return q.select(F.col("item_id").alias("query_id"), F.concat(F.lit("u"), (F.col("item_id") % 5).cast("string")).alias("user_id"), "text", "embedding", F.lit("simple").alias("language"))


CHUNKS = """c AS (SELECT source, lang AS scope, 'doc:' || doc_id AS resource_id, 0 AS chunk_index, string_split(text, chr(10))[1] AS title, text,
    nullif(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '') AS plain, embedding, doc_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
g AS (SELECT DISTINCT 'u' || (regexp_extract(source, '(\\d+)$', 1)::INT % 5) AS user_id, source, lang AS scope FROM documents WHERE source IS NOT NULL),
q AS (SELECT item_id AS query_id, 'u' || (item_id % 5) AS user_id, text, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
s AS (SELECT DISTINCT query_id, g.source, g.scope FROM q JOIN g USING (user_id)),
d AS (SELECT query_id, c.source, c.resource_id, c.chunk_index, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))) AS score
    FROM q JOIN s USING (query_id) JOIN c ON c.source = s.source AND c.scope = s.scope WHERE c.embedding IS NOT NULL),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, resource_id, chunk_index) AS rank FROM d WHERE score >= 0.10) WHERE rank <= 16)"""


# index maintenance


@registered("""SELECT doc_id, i AS chunk_index, substr(text, i * 800 + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 200, 1) - 1) // 800 + 1)) AS i FROM documents WHERE length(text) > 0)""")
def chunk_fixed(spark, d):
    return index.chunk_fixed(table(spark, d, "documents").select("doc_id", "text")).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@registered()
def chunk_recursive(spark, d):
    return index.chunk_recursive(table(spark, d, "documents").select("doc_id", "text"))


@registered(f"WITH {CHUNKS} SELECT doc_id, CASE WHEN plain IS NOT NULL THEN sha256(plain) END AS fingerprint FROM c")
def fingerprint_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


@registered(f"WITH {CHUNKS} SELECT sha256(plain) AS fingerprint, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM c WHERE plain IS NOT NULL GROUP BY plain HAVING count(*) > 1")
def duplicate_report(spark, d):
    return index.duplicate_report(chunks(spark, d))


@registered("SELECT source, count(*) AS n_chunks FROM documents GROUP BY source UNION ALL SELECT '__total__', count(*) FROM documents")
def index_stats(spark, d):
    return index.index_stats(chunks(spark, d))


@registered("SELECT source, 'doc:' || doc_id AS resource_id, (length(text) - 1) // 800 + 1 AS n_chunks FROM documents WHERE length(text) > 0 ORDER BY n_chunks DESC, source, resource_id LIMIT 10")
def chunks_per_resource(spark, d):
    pieces = index.chunk_fixed(chunks(spark, d).drop("chunk_index"), 800, 0)
    return usage.chunks_per_resource(pieces)


@registered(f"WITH {CHUNKS}, o AS (SELECT resource_id, chunk_index, CASE WHEN doc_id % 4 = 0 THEN plain || ' old' ELSE plain END AS plain FROM c WHERE doc_id % 2 = 0) SELECT c.resource_id, c.chunk_index, sha256(c.plain) AS fingerprint FROM c LEFT JOIN o ON o.resource_id = c.resource_id AND o.chunk_index = c.chunk_index AND o.plain = c.plain WHERE o.resource_id IS NULL")
def drop_unchanged(spark, d):
    new = chunks(spark, d)
    return index.drop_unchanged(new, stored_half(new)).select("resource_id", "chunk_index", "fingerprint")


def stored_half(new: DataFrame) -> DataFrame:
    """Every second document, every fourth with another text."""
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    return new.where("doc_id % 2 = 0").withColumn("text", text).withColumn("fingerprint", fingerprint(F.col("text")))


def dated(df: DataFrame) -> DataFrame:
    time = F.to_timestamp(F.lit("2001-01-01 00:00:00"))
    return df.withColumns({"url": F.lit(""), "last_updated": time, "metadata": F.create_map(F.lit("k"), F.lit("v")), "created_at": time, "updated_at": time})


@registered(f"WITH {CHUNKS} SELECT resource_id, chunk_index, sha256(plain) AS fingerprint, doc_id % 2 = 0 AS was_there, doc_id % 4 = 0 OR doc_id % 2 = 1 AS is_new FROM c")
def upsert_chunks(spark, d):
    new = dated(chunks(spark, d))
    after = index.upsert_chunks(new.drop("created_at", "updated_at"), dated(stored_half(new)), AS_OF)
    return after.select("resource_id", "chunk_index", "fingerprint", (F.col("created_at") < F.to_timestamp(F.lit(AS_OF))).alias("was_there"), (F.col("updated_at") == F.to_timestamp(F.lit(AS_OF))).alias("is_new"))


@registered(f"WITH {CHUNKS} SELECT resource_id, chunk_index, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE sha256(plain) END AS fingerprint, doc_id % 2 = 0 AS was_there, 2::BIGINT AS versions FROM c WHERE doc_id % 5 > 0 AND (doc_id % 2 = 0 OR doc_id % 3 = 0)")
def snapshot_upsert(spark, d):
    """Two batches into a bucketed table, the second one twice: every third document is new or changed, every fifth empties."""
    new = dated(chunks(spark, d))
    stored = SnapshotTable(spark, f"{shared_root(spark)}/snapshot-{uuid.uuid4().hex}", StructType([f for f in new.schema if f.name != "doc_id"]), buckets=32)
    half = new.where("doc_id % 2 = 0")
    stale = half.withColumn("fingerprint", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("fingerprint")))
    stored.upsert(stale, "2001-01-01", 0)
    counts = new.where("doc_id % 5 = 0").select("resource_id", F.lit(0).alias("n"))
    for _ in range(2):
        stored.upsert(new.where("doc_id % 3 = 0").drop("created_at", "updated_at"), AS_OF, 1, counts)
    return stored.read().select("resource_id", "chunk_index", "fingerprint", (F.col("created_at") < F.to_timestamp(F.lit(AS_OF))).alias("was_there"), F.lit(len(stored.versions())).cast("bigint").alias("versions"))


@registered("SELECT doc_id, i AS chunk_index FROM (SELECT doc_id, unnest(range(0, (greatest(length(text) - 200, 1) - 1) // 800 + 1)) AS i FROM documents WHERE length(text) > 0) WHERE doc_id % 3 > 0 OR i < doc_id % 2")
def prune_tail(spark, d):
    docs = table(spark, d, "documents")
    stored = index.chunk_fixed(docs.select(F.col("doc_id").alias("resource_id"), "text"))
    counts = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("resource_id"), (F.col("doc_id") % 2).alias("n"))
    return index.prune_tail(stored, counts).select(F.col("resource_id").alias("doc_id"), F.col("chunk_index").cast("bigint").alias("chunk_index"))


@registered("SELECT doc_id, source, lang FROM documents WHERE NOT coalesce(source IN ('src1', 'src2') AND lang = 'en', false)")
def delete_by_filter(spark, d):
    return index.delete_by_filter(table(spark, d, "documents"), {"source": {"$in": ["src1", "src2"]}, "lang": "en", "unknown": 1}).select("doc_id", "source", "lang")


@registered("SELECT doc_id, source FROM documents WHERE source <> 'src3' OR source IS NULL")
def purge_source(spark, d):
    return index.purge_source(table(spark, d, "documents"), "src3").select("doc_id", "source")


@registered("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'c' || o_custkey ELSE 'old' || o_custkey END AS object, o_orderkey AS subject FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def replace_edges(spark, d):
    o = table(spark, d, "orders").withColumn("source_resource_id", F.col("o_orderkey"))
    old = o.where("o_orderkey % 3 = 0").select("source_resource_id", F.col("o_orderkey").alias("subject"), F.concat(F.lit("old"), F.col("o_custkey").cast("string")).alias("object"))
    new = o.where("o_orderkey % 2 = 0").select("source_resource_id", F.col("o_orderkey").alias("subject"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("object"))
    return index.replace_edges(old, new).select("object", "subject")


@registered("SELECT max_by(ts, event_id) AS last_item FROM events WHERE user_id = 7 AND event_type = 'click'")
def high_water(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), F.lit("s").alias("source"), F.col("event_type").alias("scope"), F.lit("success").alias("status"), F.col("event_id").alias("completed_at"), F.col("ts").alias("last_item"))
    return index.high_water(log, "7", "s", "click")


@registered("SELECT 'doc:' || doc_id AS resource_id, text FROM documents WHERE doc_id % 3 = 0")
def full_refresh(spark, d):
    c = chunks(spark, d).select("source", "resource_id", "text", "doc_id")
    return index.full_refresh(c.where("doc_id % 3 = 1"), c.where("doc_id % 3 = 0"), {"source": [f"src{i}" for i in range(100)]}).select("resource_id", "text")


# retrieval


@registered(f"WITH {CHUNKS} SELECT query_id, source, scope FROM s")
def query_scopes(spark, d):
    return search.query_scopes(questions(spark, d), grants(spark, d))


@registered(f"WITH {CHUNKS} SELECT doc_id, source FROM c WHERE (source, scope) IN (SELECT source, scope FROM s)")
def scope_filter(spark, d):
    every = search.query_scopes(questions(spark, d), grants(spark, d))
    return search.scope_filter_all(chunks(spark, d), every).select("doc_id", "source")


@registered(f"WITH {CHUNKS} SELECT doc_id, source FROM c WHERE (source, scope) IN (SELECT source, scope FROM g WHERE user_id = 'u2')")
def row_policy(spark, d):
    return search.row_policy(chunks(spark, d), grants(spark, d), "u2").select("doc_id", "source")


@registered(f"WITH {CHUNKS} SELECT query_id, source, resource_id, round(score, 6) AS score, rank::INTEGER AS rank FROM v")
def vector_topk(spark, d):
    q = questions(spark, d)
    hits = search.vector_topk(q, chunks(spark, d), search.query_scopes(q, grants(spark, d)))
    return hits.select("query_id", "source", "resource_id", F.round("score", 6).alias("score"), "rank")


@registered()
def vector_topk_approx(spark, d):
    q = questions(spark, d)
    hits = quantized.vector_topk_approx(q, chunks(spark, d), search.query_scopes(q, grants(spark, d)))
    return hits.select("query_id", "source", "resource_id", F.round("score", 6).alias("score"), "rank")


@registered(f"WITH {CHUNKS} SELECT query_id, count(*) AS n_exact, true AS over_nine_tenths FROM v WHERE rank <= 8 GROUP BY query_id")
def vector_recall(spark, d):
    """The recall of the approximate search at 8, over all questions, beside what the exact one finds."""
    q, c = questions(spark, d), chunks(spark, d)
    scopes = search.query_scopes(q, grants(spark, d))
    counts = checkpointed(quantized.recall_of(quantized.vector_topk_approx(q, c, scopes, 8), search.vector_topk(q, c, scopes, 8)))
    share = counts.agg(F.sum("n_found") >= 0.9 * F.sum("n_exact")).first()[0]
    return counts.select("query_id", "n_exact", F.lit(share).alias("over_nine_tenths"))


QUOTA = f"""WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resource_id, chunk_index) AS r FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY r) > 4 AS over FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over, r) AS place FROM o)"""


@registered(f"{QUOTA} SELECT query_id, resource_id, source, place::INTEGER AS place FROM p WHERE place <= 8")
def vector_topk_quota(spark, d):
    hits = keywords.retrieve(questions(spark, d), chunks(spark, d), grants(spark, d), mode="vector")
    return hits.select("query_id", "resource_id", "source", "place")


@registered(f"{QUOTA} SELECT query_id, number::INTEGER AS number, resource_id FROM (SELECT query_id, resource_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resource_id) AS number FROM p WHERE place <= 8)")
def numbered_context(spark, d):
    hits = keywords.retrieve(questions(spark, d), chunks(spark, d), grants(spark, d), mode="vector")
    texts = chunks(spark, d).select("resource_id", "chunk_index", "text")
    return search.numbered_context(hits.join(texts, ["resource_id", "chunk_index"])).select("query_id", "number", "resource_id")


@registered(f"{QUOTA}, good AS (SELECT query_id, 'doc:' || doc_id AS resource_id FROM q, labels WHERE quality = 1 AND doc_id % 7 = query_id % 7), t AS (SELECT query_id, resource_id FROM p WHERE place <= 8), f AS (SELECT query_id, count(*) AS taken, count(good.resource_id) AS found FROM t LEFT JOIN good USING (query_id, resource_id) GROUP BY query_id), n AS (SELECT query_id, count(*) AS relevant FROM good GROUP BY query_id) SELECT query_id, round(coalesce(found / taken, 0), 6) AS precision, round(coalesce(found / relevant, 0), 6) AS recall FROM n FULL JOIN f USING (query_id)")
def retrieval_quality(spark, d):
    q = questions(spark, d)
    hits = keywords.retrieve(q, chunks(spark, d), grants(spark, d), mode="vector")
    labels = table(spark, d, "labels").where("quality = 1").withColumn("m", F.col("doc_id") % 7)
    judged = q.select("query_id", (F.col("query_id") % 7).alias("m")).join(labels, "m").select("query_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("resource_id"))
    return search.retrieval_quality(hits, judged).select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@registered("SELECT doc_id, pos::INTEGER AS pos, token FROM (SELECT doc_id, unnest(w) AS token, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents))")
def tokenize_simple(spark, d):
    return search.tokenize(table(spark, d, "documents"), keep=["doc_id"]).select("doc_id", "pos", "token")


#: Words with their published stems.
STEMS = dict(zip("consistency conspiracies knackeries knitting consolatory generously happiness rationally hopping skies agreed luxuriated".split(), "consist conspiraci knackeri knit consolatori generous happi ration hop sky agre luxuri".split(), strict=True))
WORDS = ", ".join(f"'{w}'" for w in STEMS)
STEMMED = ", ".join(f"'{w}'" for w in STEMS.values())


@registered(f"""SELECT p_partkey::BIGINT AS k, x.* FROM part, LATERAL (VALUES (1, [{STEMMED}][1 + p_partkey % {len(STEMS)}]), (2, 'k' || p_partkey)) x(pos, token)""")
def tokenize_english(spark, d):
    """A stop word, a word of each part's number and its name: the second and third are left, stemmed."""
    text = F.concat(F.lit("The "), F.expr(f"get(array({WORDS}), cast(p_partkey % {len(STEMS)} AS INT))"), F.lit(", k"), F.col("p_partkey").cast("string"))
    return search.tokenize(table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("k"), text.alias("text")), "english", keep=["k"]).select("k", "pos", "token")


SPLIT = "list_filter(regexp_split_to_array(lower({}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def searches(spark: SparkSession, d: str) -> DataFrame:
    """Every question with its whole text, and for every hundredth document a search of phrases, OR and minus in its words."""
    docs = table(spark, d, "documents").where("doc_id % 100 = 0").withColumn("w", search.tokens(F.col("text"))).where(F.size("w") >= 9)
    w = lambda k: F.get("w", F.lit(k - 1))
    text = F.concat(F.lit('"'), w(1), F.lit(" "), w(2), F.lit('" '), w(4), F.lit(" OR "), w(6), F.lit(" "), w(7), F.lit(" -"), w(9))
    asked = docs.select((F.col("doc_id") + 1_000_000).alias("query_id"), F.concat(F.lit("u"), F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 5).alias("user_id"), text.alias("text"), F.lit("simple").alias("language"))
    return questions(spark, d).select("query_id", "user_id", "text", "language").unionByName(asked)


#: The searches, their terms, and the chunks that satisfy a branch, with occurrences and span.
SEARCH = f"""sq AS (SELECT item_id AS query_id, 'u' || (item_id % 5) AS user_id, text FROM benchmark JOIN embeddings ON vec_id = item_id UNION ALL
    SELECT doc_id + 1000000, 'u' || (regexp_extract(source, '(\\d+)$', 1)::INT % 5), '"' || w[1] || ' ' || w[2] || '" ' || w[4] || ' OR ' || w[6] || ' ' || w[7] || ' -' || w[9] FROM (SELECT doc_id, source, {SPLIT.format("text")} AS w FROM documents WHERE doc_id % 100 = 0) WHERE len(w) >= 9),
raws AS (SELECT query_id, unnest(r) AS raw, unnest(range(len(r))) AS term FROM (SELECT query_id, regexp_extract_all(text, '-?"[^"]*"|\\S+') AS r FROM sq)),
branched AS (SELECT *, sum(CASE WHEN lower(raw) = 'or' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY term) AS branch FROM raws),
terms AS (SELECT query_id, branch, term, starts_with(raw, '-') AS negated, {SPLIT.format("raw")} AS t FROM branched WHERE lower(raw) <> 'or' AND len({SPLIT.format("raw")}) > 0),
cw AS (SELECT source, scope, resource_id, {SPLIT.format("title")} AS ta, {SPLIT.format("text")} AS tb, ' ' || array_to_string({SPLIT.format("text")}, ' ') || ' ' AS w FROM c),
ss AS (SELECT DISTINCT query_id, g.source, g.scope FROM sq JOIN g USING (user_id)),
met AS (SELECT query_id, branch, cw.source, resource_id, any_value(ta) AS ta, any_value(tb) AS tb FROM terms JOIN ss USING (query_id) JOIN cw ON cw.source = ss.source AND cw.scope = ss.scope
    GROUP BY query_id, branch, cw.source, resource_id HAVING bool_and(negated <> contains(w, ' ' || array_to_string(t, ' ') || ' ')) AND NOT bool_and(negated)),
places AS (SELECT query_id, branch, term, source, resource_id, len(t) AS n, len(ta) AS shift, list_filter(range(1, len(ta) + 1), lambda i: ta[i:i + len(t) - 1] = t) AS a, list_filter(range(1, len(tb) + 1), lambda i: tb[i:i + len(t) - 1] = t) AS b FROM met JOIN terms USING (query_id, branch) WHERE NOT negated),
per AS (SELECT query_id, branch, source, resource_id, sum(len(a)) AS n_a, sum(len(b)) AS n_b, max(list_max(b)) - min(list_min(b)) AS span FROM places GROUP BY ALL),
found AS (SELECT query_id, source, resource_id, max(n_a)::BIGINT AS n_a, max(n_b)::BIGINT AS n_b, min(span)::BIGINT AS span FROM per GROUP BY ALL),
occ AS (SELECT *, s + n - 1 AS e FROM (SELECT query_id, source, resource_id, branch, term, n, shift, unnest(list_concat(a, list_transform(b, lambda i: i + shift))) AS s FROM places)),
ends AS (SELECT DISTINCT query_id, source, resource_id, e FROM occ),
lasts AS (SELECT x.query_id, x.source, x.resource_id, x.e, o.branch, o.term, max(o.s) AS s FROM ends x JOIN occ o ON o.query_id = x.query_id AND o.source = x.source AND o.resource_id = x.resource_id AND o.e <= x.e GROUP BY ALL),
need AS (SELECT query_id, branch, count(*) AS needed FROM terms WHERE NOT negated GROUP BY ALL),
late AS (SELECT query_id, source, resource_id, e, max(p) AS p FROM (SELECT query_id, source, resource_id, e, branch, min(s) AS p, count(*) AS have FROM lasts GROUP BY ALL) JOIN need USING (query_id, branch) WHERE have = needed GROUP BY ALL),
cover AS (SELECT * FROM (SELECT *, max(p) OVER (PARTITION BY query_id, source, resource_id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM late) WHERE earlier IS NULL OR p > earlier),
points AS (SELECT DISTINCT query_id, source, resource_id, q, CASE WHEN q <= shift THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS weight FROM (SELECT query_id, source, resource_id, shift, unnest(range(s, s + n)) AS q FROM occ)),
dense AS (SELECT c.query_id, c.source, c.resource_id, c.p, c.e, count(*) AS n, sum(1.0::DOUBLE / weight) AS inverse FROM cover c JOIN points o ON o.query_id = c.query_id AND o.source = c.source AND o.resource_id = c.resource_id AND o.q BETWEEN c.p AND c.e GROUP BY ALL),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, resource_id) AS rank FROM (SELECT query_id, source, resource_id, round(sum(n / inverse / (1 + greatest((e - p) - (n - 1), 0))), 9) AS score FROM dense GROUP BY ALL))"""


@registered(f"WITH {CHUNKS}, {SEARCH} SELECT query_id, branch::BIGINT AS branch, term::INTEGER AS term, negated, array_to_string(t, ' ') AS tokens FROM terms")
def search_terms(spark, d):
    return search.parse_search(searches(spark, d)).select("query_id", "branch", "term", "negated", F.array_join("tokens", " ").alias("tokens"))


STORED: dict[tuple, keywords.KeywordIndex] = {}


def stored_keywords(spark: SparkSession, d: str) -> keywords.KeywordIndex:
    """The keyword index of the documents, made once in a session for a version of their table."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    made = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(where).getModificationTime()
    key = (spark.sparkContext.applicationId, d, made)
    if key not in STORED:
        new = keywords.KeywordIndex(spark, f"{shared_root(spark)}/keywords-{uuid.uuid4().hex}", ("simple",))
        new.update(chunks(spark, d), 0)
        STORED[key] = new
    return STORED[key]


def matched(spark: SparkSession, d: str) -> DataFrame:
    asked = searches(spark, d)
    terms = search.parse_search(asked)
    found = stored_keywords(spark, d).of(terms, "simple")
    return search.keyword_match(terms, found, search.query_scopes(asked, grants(spark, d)))


@registered(f"WITH {CHUNKS}, {SEARCH} SELECT query_id, source, resource_id, n_a, n_b, span FROM found")
def keyword_match(spark, d):
    return matched(spark, d).select("query_id", "source", "resource_id", "n_a", "n_b", F.col("span").cast("bigint").alias("span"))


@registered(f"WITH {CHUNKS}, {SEARCH} SELECT query_id, source, resource_id, round(score, 6) AS score, rank::INTEGER AS rank FROM kw WHERE rank <= 16")
def keyword_rank(spark, d):
    return keywords.keyword_rank(matched(spark, d)).select("query_id", "source", "resource_id", F.round("score", 6).alias("score"), "rank")


@registered(f"""WITH {CHUNKS}, {SEARCH},
legs AS (SELECT query_id, source, resource_id, 0 AS leg, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resource_id) AS place FROM v
    UNION ALL SELECT query_id, source, resource_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resource_id) FROM kw WHERE rank <= 16 AND query_id < 1000000),
fused AS (SELECT query_id, source, resource_id, sum(1.0::DOUBLE / (60 + place)) AS rrf FROM legs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, resource_id) AS r FROM fused),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY r) > 4 AS over FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over, r) AS place FROM o)
SELECT query_id, resource_id, source, round(rrf, 9) AS rrf, place::INTEGER AS place FROM p WHERE place <= 8""")
def retrieve_hybrid(spark, d):
    hits = keywords.retrieve(questions(spark, d), chunks(spark, d), grants(spark, d), index=stored_keywords(spark, d))
    return hits.select("query_id", "resource_id", "source", F.round("rrf", 9).alias("rrf"), "place")


@registered("SELECT source, scope FROM (SELECT DISTINCT source, lang AS scope FROM documents) WHERE source IN ('src1', 'src2') AND scope = 'en'")
def scopes_revalidated(spark, d):
    scopes = table(spark, d, "documents").select("source", F.col("lang").alias("scope")).distinct()
    verdicts = scopes.where("source IN ('src1', 'src2', 'src3')").withColumns({"allowed": F.col("scope") == "en", "expires_at": F.when(F.col("source") == "src3", F.to_timestamp(F.lit("2001-01-01"))).otherwise(F.to_timestamp(F.lit("2002-01-01")))})
    return search.scopes_revalidated(scopes, verdicts, AS_OF)


@registered("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS answer_id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND b.vec_id % 3 > 0)
SELECT query_id, answer_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, answer_id) AS r FROM p WHERE s >= 0.3) WHERE r = 1""")
def cache_lookup(spark, d):
    e = table(spark, d, "embeddings").withColumn("scope_fingerprint", F.col("label").cast("string"))
    age = F.when(F.col("vec_id") % 3 == 0, "2001-07-30 00:00:00").otherwise("2001-07-31 23:30:00")
    cache = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("answer_id"), "scope_fingerprint", "embedding", F.lit("a").alias("answer"), F.to_timestamp(age).alias("created_at"))
    asked = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), "scope_fingerprint", "embedding")
    return search.cache_lookup(asked, cache, AS_OF, floor=0.3).select("query_id", "answer_id", F.round("similarity", 6).alias("similarity"))


@registered("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: 2 * x + 0.01::DOUBLE) AS w FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS answer_id, list_dot_product(a.v, b.w) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.w, b.w))) AS s FROM e a JOIN e b ON a.label = b.label WHERE b.vec_id % 3 > 0)
SELECT query_id, answer_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, answer_id) AS r FROM p WHERE s >= 0.97) WHERE r = 1""")
def cache_lookup_near(spark, d):
    """At the cache's own floor: answers to nearly the same questions, those of every third too old."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("scope_fingerprint"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    age = F.when(F.col("vec_id") % 3 == 0, "2001-07-30 00:00:00").otherwise("2001-07-31 23:30:00")
    cache = e.select(F.col("vec_id").alias("answer_id"), "scope_fingerprint", F.transform("embedding", lambda x: 2 * x + 0.01).alias("embedding"), F.lit("a").alias("answer"), F.to_timestamp(age).alias("created_at"))
    return search.cache_lookup(e.withColumnRenamed("vec_id", "query_id"), cache, AS_OF).select("query_id", "answer_id", F.round("similarity", 6).alias("similarity"))


# dependency graphs


def edges(spark: SparkSession, d: str) -> DataFrame:
    """supplier and customer to nation to region."""
    part = lambda name, key, to, a, b: table(spark, d, name).select(F.concat(F.lit(a), F.col(key).cast("string")).alias("subject"), F.lit("references").alias("predicate"), F.concat(F.lit(b), F.col(to).cast("string")).alias("object"))
    out = part("customer", "c_custkey", "c_nationkey", "c", "n").unionByName(part("supplier", "s_suppkey", "s_nationkey", "s", "n"))
    return out.unionByName(part("nation", "n_nationkey", "n_regionkey", "n", "r"))


EDGES = "e AS (SELECT 'c' || c_custkey AS subject, 'n' || c_nationkey AS object FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


@registered(f"WITH RECURSIVE {EDGES}, w AS (SELECT subject AS start, 1 AS hop, subject, object FROM e WHERE subject LIKE 's%' UNION SELECT start, hop + 1, e.subject, e.object FROM w JOIN e ON e.subject = w.object WHERE hop < 3) SELECT start, hop, subject, object FROM w")
def walk_upstream(spark, d):
    e = edges(spark, d)
    starts = e.where("subject LIKE 's%'").select(F.col("subject").alias("start"))
    return lineage.walk(e, starts, 3).select("start", "hop", "subject", "object")


@registered(f"WITH RECURSIVE {EDGES}, w AS (SELECT object AS start, 1 AS hop, subject, object FROM e WHERE object LIKE 'r%' UNION SELECT start, hop + 1, e.subject, e.object FROM w JOIN e ON e.object = w.subject WHERE hop < 3) SELECT start, hop, subject, object FROM w")
def walk_downstream(spark, d):
    e = edges(spark, d)
    starts = e.where("object LIKE 'r%'").select(F.col("object").alias("start"))
    return lineage.walk(e, starts, 3, "downstream", cap=None).select("start", "hop", "subject", "object")


@registered(f"WITH {EDGES} SELECT subject, 'references' AS predicate, object FROM e WHERE subject LIKE '%s1%' OR object LIKE '%s1%' ORDER BY 1, 2, 3 LIMIT 20")
def edge_search(spark, d):
    return lineage.edge_search(edges(spark, d), "S1")


SEEN = "x AS (SELECT *, 'graph' AS source, left(subject, 1) AS part FROM e), w AS (SELECT DISTINCT o_custkey % 1000 AS query_id, 'C' || (o_custkey % 1000) AS entity FROM orders)"


@registered(f"""WITH {EDGES}, {SEEN}, found AS (SELECT DISTINCT query_id, subject, 'references' AS predicate, object FROM w JOIN x ON contains(subject, lower(entity)) OR contains(object, lower(entity)) WHERE part = 'c' OR query_id % 2 = 0)
SELECT *, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY subject, predicate, object) AS rank FROM found) WHERE rank <= 20""".replace("SELECT *, rank::INTEGER AS rank FROM (", "SELECT query_id, subject, predicate, object, rank::INTEGER AS rank FROM ("))
def edge_searches(spark, d):
    """Many askers at once: every customer number of the orders asks for what contains it; odd ones see customers' edges only."""
    own = edges(spark, d).withColumns({"source": F.lit("graph"), "resource_identifier": F.substring("subject", 1, 1)})
    wanted = table(spark, d, "orders").select((F.col("o_custkey") % 1000).alias("query_id")).distinct().withColumn("entity", F.concat(F.lit("C"), F.col("query_id").cast("string")))
    every = F.when(F.col("query_id") % 2 == 0, F.array(*map(F.lit, "csn"))).otherwise(F.array(F.lit("c")))
    scopes = wanted.select("query_id", F.lit("graph").alias("source"), F.explode(every).alias("resource_identifier"))
    return lineage.edge_searches(own, wanted, scopes).select("query_id", "subject", "predicate", "object", "rank")


@registered(f"""WITH RECURSIVE {EDGES}, s AS (SELECT DISTINCT n_name AS start, 'n' || (n_nationkey % 10) AS word FROM nation), w AS (SELECT word AS start, 1 AS hop, subject, object FROM (SELECT DISTINCT word FROM s) JOIN e ON contains(subject, word)
    UNION SELECT start, hop + 1, e.subject, e.object FROM w JOIN e ON e.subject = w.object WHERE hop < 2) SELECT start, hop, subject, object FROM w""")
def walk_containing(spark, d):
    """Upstream from every node whose name contains a nation's letter and last digit, two letters."""
    starts = table(spark, d, "nation").select(F.concat(F.lit("n"), (F.col("n_nationkey") % 10).cast("string")).alias("start")).distinct()
    return lineage.walk(edges(spark, d), starts, 2, match="contains", cap=None).select("start", "hop", "subject", "object")


# reports


def t(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return retail.retail_tables(lambda name: table(spark, d, name))


NET = "(l_quantity::INT * l_extendedprice::DECIMAL(12,2) * (100 - (l_discount * 100)::DECIMAL(5,2)))::DECIMAL(26,4) * 0.01::DECIMAL(3,2)"
LINES = f"""lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity::INT AS quantity, ({NET})::DECIMAL(12,2) AS net, o_custkey, o_orderdate::DATE AS order_date, o_orderstatus, c_mktsegment, c_nationkey, c_name, p_name, p_brand, p_retailprice::DECIMAL(12,2) AS unit_cost,
    'FY' || (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END) || '-' || lpad(month(o_orderdate)::VARCHAR, 2, '0') AS period FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey),
done AS (SELECT * FROM lines WHERE o_orderstatus = 'F'),
stock AS (SELECT DISTINCT l_partkey AS product_id, l_suppkey AS warehouse_id, ((l_partkey * 7 + l_suppkey) % 500)::INT AS on_hand, (20 + l_partkey % 131)::INT AS reorder_point FROM lineitem)"""


@registered("SELECT o_orderkey, 'FY' || (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END) || '-' || lpad(month(o_orderdate)::VARCHAR, 2, '0') AS fiscal_period FROM orders")
def fiscal_period(spark, d):
    return table(spark, d, "orders").select("o_orderkey", retail.fiscal_period(F.col("o_orderdate")).alias("fiscal_period"))


@registered(f"WITH {LINES} SELECT l_orderkey AS order_id, l_linenumber AS line_no, o_custkey AS customer_id, p_name AS product_name, net::DOUBLE AS net_amount FROM lines")
def order_line_detail(spark, d):
    return retail.order_line_detail(t(spark, d)).select("order_id", "line_no", "customer_id", "product_name", F.col("net_amount").cast("double").alias("net_amount"))


@registered(f"WITH {LINES} SELECT o_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, count(DISTINCT l_orderkey) AS n_orders, sum(net)::DOUBLE AS total_net, min(order_date) AS first_order, max(order_date) AS last_order FROM lines GROUP BY ALL")
def customer_order_summary(spark, d):
    return retail.customer_order_summary(t(spark, d))


@registered(f"WITH {LINES} SELECT product_id, p_name AS product_name, warehouse_id, s_name AS warehouse_name, n_nationkey::INT AS region_id, n_name AS region_name, on_hand, reorder_point, CASE WHEN on_hand < reorder_point THEN 1 ELSE 0 END AS is_below FROM stock JOIN part ON p_partkey = product_id JOIN supplier ON s_suppkey = warehouse_id JOIN nation ON n_nationkey = s_nationkey")
def inventory_status(spark, d):
    return retail.inventory_status(t(spark, d))


@registered("SELECT s_suppkey AS employee_id, s_name AS employee_name, ['Bronze', 'Silver', 'Gold', 'Platinum'][s_suppkey % 4 + 1] AS tier, n_nationkey::INT AS region_id, n_name AS region_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def employee_region_map(spark, d):
    return retail.employee_region_map(t(spark, d))


@registered("SELECT l_orderkey AS order_id, l_linenumber AS line_no, o_custkey AS customer_id, l_partkey AS product_id, p_name AS product_name, l_quantity::INT AS quantity, o_orderdate::DATE AS order_date, l_shipdate::DATE AS ship_date FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'")
def returns_detail(spark, d):
    return retail.returns_detail(t(spark, d))


@registered(f"""WITH {LINES}, a AS (SELECT c_nationkey, period, sum(net) AS amount, min(order_date) AS first FROM done GROUP BY ALL),
seg AS (SELECT c_nationkey, period, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, period ORDER BY sum(net) DESC, c_mktsegment) AS rn FROM done GROUP BY c_nationkey, period, c_mktsegment),
x AS (SELECT *, lag(amount) OVER (PARTITION BY c_nationkey ORDER BY first) AS prior FROM a)
SELECT x.c_nationkey::INT AS region_id, n_name AS region_name, x.period AS fiscal_period, amount::DOUBLE AS total_net, prior::DOUBLE AS prior_net, CASE WHEN prior <> 0 THEN round((amount::DOUBLE - prior::DOUBLE) / prior::DOUBLE * 100, 2) END AS growth_pct, seg.c_mktsegment AS top_segment
FROM x JOIN nation ON n_nationkey = x.c_nationkey LEFT JOIN seg ON seg.c_nationkey = x.c_nationkey AND seg.period = x.period AND rn = 1""")
def monthly_sales_by_region(spark, d):
    return retail.monthly_sales_by_region(t(spark, d))


@registered(f"WITH {LINES}, a AS (SELECT l_partkey AS product_id, p_name AS product_name, p_brand AS category, sum(quantity)::BIGINT AS quantity, sum(net) AS r, sum(quantity * unit_cost) AS k FROM done GROUP BY ALL) SELECT product_id, product_name, category, quantity, r::DOUBLE AS revenue, k::DOUBLE AS cost, CASE WHEN r <> 0 THEN round((r::DOUBLE - k::DOUBLE) / r::DOUBLE * 100, 2) END AS margin_pct FROM a")
def product_performance(spark, d):
    return retail.product_performance(t(spark, d))


@registered(f"WITH {LINES}, a AS (SELECT l_suppkey, period, sum(net) AS sales FROM done GROUP BY ALL), r AS (SELECT a.*, s_name, ['Bronze', 'Silver', 'Gold', 'Platinum'][l_suppkey % 4 + 1] AS tier, [0.025, 0.040, 0.060, 0.080][l_suppkey % 4 + 1]::DECIMAL(4,3) AS rate FROM a JOIN supplier ON s_suppkey = l_suppkey) SELECT l_suppkey AS employee_id, s_name AS employee_name, period AS fiscal_period, tier, sales::DOUBLE AS sales, (rate * 100)::DOUBLE AS rate_pct, (sales::DECIMAL(22,2) * rate)::DECIMAL(20,2)::DOUBLE AS commission FROM r")
def employee_commission(spark, d):
    return retail.employee_commission(t(spark, d))


@registered(f"WITH {LINES} SELECT l_partkey AS product_id, l_suppkey AS employee_id, o_custkey AS customer_id, period AS fiscal_period, sum(quantity)::BIGINT AS quantity, sum(net)::DOUBLE AS net_amount, min(order_date) AS first FROM done GROUP BY ALL")
def sales_cube(spark, d):
    return retail.sales_cube(t(spark, d)).withColumn("net_amount", F.col("net_amount").cast("double"))


@registered(f"""WITH {LINES} SELECT 'region' AS report, c_nationkey::VARCHAR AS key, sum(net)::DOUBLE AS amount FROM done GROUP BY c_nationkey UNION ALL SELECT 'product', l_partkey::VARCHAR, sum(net)::DOUBLE FROM done GROUP BY l_partkey
UNION ALL SELECT 'employee', l_suppkey::VARCHAR, sum(net)::DOUBLE FROM done GROUP BY l_suppkey""")
def reports_of_one_scan(spark, d):
    """The totals of three reports that share one stored aggregate: lines are scanned once."""
    own = t(spark, d)
    cube = checkpointed(retail.sales_cube(own))
    total = lambda df, report, key, amount: df.groupBy(F.col(key).cast("string").alias("key")).agg(F.round(F.sum(amount), 2).alias("amount")).withColumn("report", F.lit(report))
    out = total(retail.monthly_sales_by_region(own, cube=cube), "region", "region_id", "total_net")
    out = out.unionByName(total(retail.product_performance(own, cube=cube), "product", "product_id", "revenue"))
    return out.unionByName(total(retail.employee_commission(own, cube=cube), "employee", "employee_id", "sales")).select("report", "key", "amount")


@registered(f"""WITH {LINES}, r AS (SELECT o_custkey, max(order_date) AS last_order, count(DISTINCT l_orderkey) AS n, sum(net) AS net FROM done GROUP BY ALL),
e AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, last_order, date_diff('day', last_order, DATE '{AS_OF}')::INT AS days, coalesce(n, 0) AS n, coalesce(net, 0)::DOUBLE AS net FROM customer LEFT JOIN r ON o_custkey = c_custkey WHERE c_acctbal >= 0),
s AS (SELECT *, (CASE WHEN days IS NULL OR days > 365 THEN 100 WHEN days > 180 THEN 70 WHEN days > 90 THEN 40 ELSE 10 END * 6 + CASE WHEN n = 0 THEN 100 WHEN n <= 2 THEN 60 WHEN n <= 5 THEN 30 ELSE 5 END * 4)::DOUBLE / 10 AS score FROM e)
SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, c_nationkey::INT AS region_id, last_order, days AS days_since, n AS n_orders, net AS total_net, round(score, 2) AS churn_score, CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS risk_band FROM s""")
def customer_churn_risk(spark, d):
    return retail.customer_churn_risk(t(spark, d), AS_OF)


@registered(f"WITH {LINES}, r AS (SELECT l_partkey, sum(quantity) AS demand FROM lines WHERE order_date >= DATE '{AS_OF}' - 60 GROUP BY ALL) SELECT product_id, p_name AS product_name, warehouse_id, on_hand, reorder_point, coalesce(demand, 0)::BIGINT AS demand, p_size::INT AS lead_days, greatest(ceil(coalesce(demand, 0) / 60.0::DOUBLE * p_size) + reorder_point - on_hand, 0)::BIGINT AS suggested FROM stock JOIN part ON p_partkey = product_id LEFT JOIN r ON l_partkey = product_id WHERE on_hand <= reorder_point")
def inventory_replenishment(spark, d):
    return retail.inventory_replenishment(t(spark, d), AS_OF)


@registered("SELECT 'orders' AS table_name, CASE WHEN o_orderkey % 5 = 0 THEN 'INSERT' WHEN o_orderkey % 7 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS operation, o_orderkey AS record_id FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0) AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 3 = 0)")
def audit_from_changes(spark, d):
    o = t(spark, d)["orders"].where("NOT (order_id % 5 = 0 AND order_id % 7 = 0)")
    changed = F.when(F.col("order_id") % 3 == 0, "X").otherwise(F.col("status"))
    return retail.audit_from_changes(o.where("order_id % 5 <> 0"), o.where("order_id % 7 <> 0").withColumn("status", changed), "order_id", "orders")


MOVED = f"""WITH {LINES}, k AS (SELECT l.l_orderkey, l.l_linenumber, l.quantity, s.product_id, s.warehouse_id, rank() OVER (PARTITION BY l.l_orderkey, l.l_linenumber, l.l_partkey ORDER BY s.on_hand {{order}}, s.warehouse_id) AS rn FROM lines l JOIN supplier ON s_nationkey = l.c_nationkey JOIN stock s ON s.product_id = l.l_partkey AND s.warehouse_id = s_suppkey WHERE {{what}}),
m AS (SELECT product_id, warehouse_id, sum(quantity) AS moved FROM k WHERE rn = 1 GROUP BY ALL) SELECT product_id, warehouse_id, {{after}}::BIGINT AS on_hand, reorder_point FROM stock LEFT JOIN m USING (product_id, warehouse_id)"""


@registered(MOVED.format(order="DESC", what="l.o_orderstatus = 'P'", after="greatest(on_hand - coalesce(moved, 0), 0)"))
def decrement_inventory(spark, d):
    x = t(spark, d)
    return retail.decrement_inventory(x, x["lines"].join(x["orders"].where("status = 'P'").select("order_id"), "order_id", "left_semi"))


@registered(MOVED.format(order="ASC", what="l.l_returnflag = 'R'", after="(on_hand + coalesce(moved, 0))"))
def restock_inventory(spark, d):
    x = t(spark, d)
    return retail.restock_inventory(x, x["lines"].where("return_flag = 'R'"))


@registered(f"WITH {LINES} SELECT l_orderkey AS order_id, sum(net)::DOUBLE AS amount FROM lines WHERE o_orderstatus <> 'P' GROUP BY l_orderkey")
def payments_by_order(spark, d):
    return retail.payments_by_order(t(spark, d))


# usage


def audit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("audit_id"), F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("step_name"), F.col("value").alias("duration_ms"), (F.col("event_id") % 11 != 0).alias("success"), F.col("event_id").alias("total_tokens"), F.col("event_id").alias("prompt_tokens"), (F.col("event_id") % 100).alias("completion_tokens"), F.lit("p").alias("provider"), F.concat(F.lit("m-"), "event_type", F.lit("-large")).alias("model"))


@registered("SELECT event_type AS step_name, count(*) AS n_calls, round(avg(value), 6) AS mean_ms, max(value) AS max_ms FROM events GROUP BY event_type")
def slow_steps(spark, d):
    return usage.slow_steps(audit(spark, d)).select("step_name", "n_calls", F.round("mean_ms", 6).alias("mean_ms"), "max_ms")


@registered("SELECT event_id AS audit_id, user_id::VARCHAR AS user_id, 'u' || user_id || '@x' AS email FROM events ORDER BY ts DESC, event_id LIMIT 50")
def audit_page(spark, d):
    a = audit(spark, d)
    users = a.select("user_id").distinct().withColumn("email", F.concat(F.lit("u"), "user_id", F.lit("@x")))
    return usage.audit_page(a, users).select("audit_id", "user_id", "email")


RATES = [("p", "m-", 0.5, 1.0), ("p", "m-click", 0.25, 2.0), ("p", "view", 1.0, 1.5), ("q", "m-click-large", 9.0, 9.0)]


@registered("SELECT event_id AS audit_id, round(CASE WHEN event_type = 'click' THEN event_id / 1000 * 0.25 + (event_id % 100) / 1000 * 2.0 WHEN event_type LIKE '%view%' THEN event_id / 1000 * 1.0 + (event_id % 100) / 1000 * 1.5 ELSE event_id / 1000 * 0.5 + (event_id % 100) / 1000 * 1.0 END, 6) AS cost FROM events")
def estimate_cost(spark, d):
    rates = spark.createDataFrame(RATES, "provider string, model_key string, rate_in double, rate_out double")
    return usage.estimate_cost(audit(spark, d), rates).select("audit_id", F.round("cost", 6).alias("cost"))


@registered("SELECT user_id::VARCHAR AS user_id, count(*) AS n_prompts, sum(event_id)::BIGINT AS tokens FROM events WHERE date_trunc('month', ts) = (SELECT min(date_trunc('month', ts)) FROM events) GROUP BY user_id")
def spend_by_user(spark, d):
    a = audit(spark, d).withColumn("cost", F.lit(0.0))
    month = str(a.agg(F.date_format(F.min(F.date_trunc("month", "created_at")), "yyyy-MM-dd")).first()[0])
    return usage.spend_by_user(a, a.select("user_id").distinct(), month).select("user_id", "n_prompts", "tokens")


@registered("SELECT event_id AS audit_id, CAST(sum(event_id) OVER w AS BIGINT) AS run_tokens, round(avg(value) OVER w, 10) AS run_mean_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def session_totals(spark, d):
    return usage.session_totals(audit(spark, d).withColumn("cost", F.lit(0.0))).select("audit_id", "run_tokens", F.round("run_mean_ms", 10).alias("run_mean_ms"))


@registered(f"WITH {CHUNKS} SELECT source, scope, count(*) AS n_chunks FROM c WHERE (source, scope) NOT IN (SELECT source, scope FROM g WHERE user_id <> 'u3') GROUP BY ALL")
def orphan_scopes(spark, d):
    return usage.orphan_scopes(chunks(spark, d), grants(spark, d).where("user_id <> 'u3'"))


@registered("SELECT count(*) AS n_prompts, count(*) FILTER (event_id % 11 = 0) AS n_failed, sum(event_id)::BIGINT AS tokens, round(avg(value), 6) AS mean_ms FROM events")
def audit_summary(spark, d):
    return usage.audit_summary(audit(spark, d).withColumn("cost", F.lit(0.0))).select("n_prompts", "n_failed", "tokens", F.round("mean_ms", 6).alias("mean_ms"))


@registered("SELECT date_trunc('hour', ts) AS start, user_id, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY ALL")
def usage_by_window(spark, d):
    events = table(spark, d, "events").withColumn("created_at", F.col("ts"))
    return usage_windows(events).withColumn("total", F.round("total", 4))


@registered("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag")
def adhoc_select(spark, d):
    return adhoc.run_select(spark, "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag;", {"lineitem": table(spark, d, "lineitem")})


# sources


@registered()
def pages_to_resources(spark, d):
    pages = table(spark, d, "pages").withColumns({"base_url": F.lit("w"), "title": F.lit("t"), "space_key": F.lit("K"), "version_when": F.to_timestamp(F.lit("2001-01-01"))})
    return landed.pages_to_resources(pages).drop("metadata")


@registered()
def html_to_text_pages(spark, d):
    return table(spark, d, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


@registered("SELECT 'ev:' || event_id AS resource_id, event_type || ' of ' || user_id AS title FROM events")
def recipe_to_resources(spark, d):
    raw = table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", F.struct(F.col("user_id").alias("id")).alias("user"), "ts")).alias("value"))
    recipe = {"source": "ev", "id": "{event_id}", "title": "{event_type} of {user.id}", "text": "{event_type}", "last_updated": "ts"}
    return landed.recipe_to_resources(raw, recipe).select("resource_id", "title")


@registered("SELECT max_by(event_id, (ts, event_id)) AS event_id, user_id FROM events GROUP BY user_id")
def latest_versions(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("v"))
    return latest_version(events, "user_id", "v").select("event_id", "user_id")


@registered("SELECT event_id FROM events WHERE ts >= date_trunc('month', (SELECT min(ts) FROM events)) AND ts < date_trunc('month', (SELECT min(ts) FROM events)) + INTERVAL 1 MONTH")
def month_window(spark, d):
    events = table(spark, d, "events")
    month = str(events.agg(F.date_format(F.min("ts"), "yyyy-MM-dd")).first()[0])
    return landed.time_window(events, "month", "ts", month=month).select("event_id")


# further operators on the same bindings


@registered("SELECT DISTINCT 'u' || (user_id % 4) AS user_id, 's' AS source, event_type AS scope, max(event_id % 2 = 0) AS again FROM events GROUP BY ALL")
def grant_access(spark, d):
    """Grants from odd events, granted again from even ones."""
    e = table(spark, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("user_id"), F.lit("s").alias("source"), F.col("event_type").alias("scope"), (F.col("event_id") % 2).alias("odd"))
    before = index.grant_access(e.where("odd = 1").limit(0).withColumn("last_synced", F.lit(None).cast("timestamp")), e.where("odd = 1"), "2001-01-01")
    return index.grant_access(before, e.where("odd = 0"), "2001-02-01").select("user_id", "source", "scope", (F.col("last_synced") > F.to_timestamp(F.lit("2001-01-15"))).alias("again"))


@registered("SELECT doc_id, text FROM documents WHERE doc_id % 5 > 0")
def delete_resources(spark, d):
    docs = table(spark, d, "documents").withColumn("resource_id", F.col("doc_id"))
    return index.delete_resources(docs, docs.where("doc_id % 5 = 0")).select("doc_id", "text")


@registered("SELECT vec_id AS resource_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)")
def resource_exists(spark, d):
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("resource_id"))
    return index.resource_exists(ids, table(spark, d, "documents").select(F.col("doc_id").alias("resource_id")))


@registered("SELECT doc_id, source AS db_name, lang AS title, 'x' AS kept, 1 AS n_left FROM documents")
def promote_metadata(spark, d):
    bag = F.create_map(F.lit("db_name"), "source", F.lit("title"), "lang", F.lit("other"), F.lit("x"))
    rows = index.promote_metadata(table(spark, d, "documents").select("doc_id", bag.alias("metadata")))
    return rows.select("doc_id", "db_name", "title", F.col("metadata")["other"].alias("kept"), F.size("metadata").alias("n_left"))


@registered("SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'new:' || page_id ELSE url END AS url FROM pages")
def backfill_urls(spark, d):
    after, _ = index.backfill_urls(table(spark, d, "pages"), ["%/en/%"], F.concat(F.lit("new:"), F.col("page_id").cast("string")))
    return after.select("page_id", "url")


@registered(f"{QUOTA} SELECT query_id, source, resource_id, chunk_index, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, resource_id ORDER BY score DESC, chunk_index) AS best FROM p) WHERE best = 1")
def best_per_resource(spark, d):
    q = questions(spark, d)
    hits = search.vector_topk(q, chunks(spark, d), search.query_scopes(q, grants(spark, d)))
    return search.best_per_resource(hits).select("query_id", "source", "resource_id", "chunk_index", F.round("score", 6).alias("score"))


@registered(f"WITH {CHUNKS}, o AS (SELECT query_id // 4 AS question_id, source, resource_id, chunk_index, max(score) AS score FROM v GROUP BY ALL) SELECT question_id, resource_id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, resource_id, chunk_index)::INTEGER AS rank FROM o")
def pool_subqueries(spark, d):
    q = questions(spark, d)
    hits = search.vector_topk(q, chunks(spark, d), search.query_scopes(q, grants(spark, d)))
    pooled = search.pool_subqueries(hits, q.select("query_id", F.floor(F.col("query_id") / 4).alias("question_id")))
    return pooled.select("question_id", "resource_id", F.round("score", 6).alias("score"), "rank")


LEGS = f"""WITH {CHUNKS}, k AS (SELECT query_id, source, resource_id, chunk_index, 1 - score AS score FROM v WHERE rank % 2 = 0),
l AS (SELECT *, 0 AS leg, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resource_id, chunk_index) AS place FROM (SELECT query_id, source, resource_id, chunk_index, score FROM v) UNION ALL SELECT *, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resource_id, chunk_index) FROM k)"""


@registered(f"{LEGS} SELECT query_id, source, resource_id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS rrf FROM l GROUP BY ALL")
def rank_fusion(spark, d):
    """The vector leg fused with its own even ranks turned round."""
    q = questions(spark, d)
    hits = search.vector_topk(q, chunks(spark, d), search.query_scopes(q, grants(spark, d)))
    other = hits.where("rank % 2 = 0").withColumn("score", 1 - F.col("score"))
    return search.rrf(hits, other).select("query_id", "source", "resource_id", F.round("rrf", 9).alias("rrf"))


@registered(f"WITH {CHUNKS} SELECT query_id, sha256(string_agg(source || chr(31) || scope, chr(30) ORDER BY source || chr(31) || scope) || chr(30) || 'simple') AS scope_fingerprint FROM s GROUP BY query_id")
def scope_fingerprints(spark, d):
    q = questions(spark, d)
    return search.scope_fingerprint(search.query_scopes(q, grants(spark, d)), q)


@registered("""WITH w AS (SELECT conv_id, turn, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM conversations),
p AS (SELECT q.conv_id, a.turn, coalesce(len(list_intersect(q.t, a.t)) / nullif(len(q.t), 0), 0) AS s FROM w q JOIN w a ON a.conv_id = q.conv_id AND a.turn > q.turn WHERE q.turn = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) AS place FROM p) SELECT conv_id, turn, round(s, 6) AS rerank_score, place::INTEGER AS place FROM r WHERE place <= 3""")
def rerank_turns(spark, d):
    """Later turns of a conversation by how much they have of the first one."""
    c = table(spark, d, "conversations")
    first = c.where("turn = 0").select("conv_id", F.col("text").alias("question"))
    hits = c.where("turn > 0").join(first, "conv_id").select(F.col("conv_id").alias("query_id"), F.lit("r").alias("resource_id"), F.col("turn").alias("chunk_index"), "question", "text")
    return search.rerank(hits, 3).select(F.col("query_id").alias("conv_id"), F.col("chunk_index").alias("turn"), F.round("rerank_score", 6).alias("rerank_score"), "place")


@registered("SELECT DISTINCT user_id::VARCHAR AS user_id, 'u' || user_id || '@x' AS email, 's' AS source, event_type AS scope FROM events")
def access_list(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), F.lit("s").alias("source"), F.col("event_type").alias("scope")).distinct()
    return usage.access_list(e, e.select("user_id").distinct().withColumn("email", F.concat(F.lit("u"), "user_id", F.lit("@x"))))


@registered("SELECT event_id AS completed_at, event_type AS source FROM events WHERE user_id = 3 ORDER BY event_id DESC LIMIT 5")
def recent_runs(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_id").alias("completed_at"), F.col("event_type").alias("source"), F.lit("x").alias("scope"))
    return usage.recent_runs(log, "3").select("completed_at", "source")


@registered("SELECT user_id AS question_id, count(*) AS n_calls, sum(event_id)::BIGINT AS prompt_tokens, round(sum(value), 4) AS duration_ms FROM events GROUP BY user_id")
def accumulate_usage(spark, d):
    a = audit(spark, d).withColumn("cost", F.lit(0.0)).withColumn("question_id", F.col("user_id").cast("bigint"))
    return usage.accumulate_usage(a).select("question_id", "n_calls", "prompt_tokens", F.round("duration_ms", 4).alias("duration_ms"))


@registered(f"WITH {LINES} SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, period AS fiscal_period FROM done WHERE order_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'")
def stage_completed_lines(spark, d):
    return retail.stage_completed_lines(t(spark, d), "1996-01-01", "1998-06-30").select("order_id", "line_no", "product_id", "fiscal_period")


@registered("SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, c_nationkey::INT AS region_id FROM customer")
def customer_segment_snapshot(spark, d):
    return retail.customer_segment_snapshot(t(spark, d))


@registered("SELECT c_custkey::VARCHAR AS name, n FROM (SELECT 'n' || c_nationkey AS o, count(*) AS n FROM customer GROUP BY ALL) JOIN customer ON o = 'n' || c_nationkey")
def shared_nation(spark, d):
    """How many customers share a customer's nation: a downstream walk of one hop from what an upstream hop finds."""
    e = edges(spark, d).where("subject LIKE 'c%'")
    up = lineage.walk(e, e.select(F.col("subject").alias("start")), 1)
    down = lineage.walk(e, up.select(F.col("object").alias("start")), 1, "downstream", cap=None).groupBy("start").count()
    return up.join(down, up["object"] == down["start"]).select(F.substring("subject", 2, 20).alias("name"), F.col("count").alias("n"))
