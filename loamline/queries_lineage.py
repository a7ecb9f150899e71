"""Registered queries over dependency graphs, each with the SQL that gives the same rows.

Bindings: every part k is an object dbo.v<k> whose definition (DEFINITION) reads a base table and the object of half its
number, and fills a report table; the SQL side tells what must be found from the number alone. Every document i is two
source files that import those of i DIV 2 and i DIV 3. Every part is also a question whose best hit is its own object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions.text import is_tracing
from loamline.operators import lineage
from loamline.queries import registered, table
from loamline.session import checkpointed

DEFINITION = """CREATE PROCEDURE dbo.v{k} AS BEGIN{c}
SELECT s.name, o.total AS total INTO #t{k} FROM dbo.b{b} s {j}JOIN dbo.v{h} o ON o.id = s.id AND s.x = 'a, -- b' WHERE s.y > 1;{d}
INSERT INTO dbo.r{r} (name, total) SELECT name, SUM(total) FROM #t{k} GROUP BY name; END"""
COMMENTS = {"c": " -- once read dbo.v{m}", "d": " /* and dbo.b{n}\n, of old */"}
#: What stands for each mark, as SQL over the number k.
MARKS = {"k": "k", "h": "k // 2", "b": "k % 10", "r": "k % 7", "m": "k + 5", "n": "(k + 3) % 10"}
KINDS = ("", "LEFT ", "RIGHT OUTER ", "FULL ")


def filled(text: str) -> str:
    """A template as an SQL expression that both engines read."""
    out = "'" + text.replace("'", "''") + "'"
    for mark, value in MARKS.items():
        out = f"replace({out}, '{{{mark}}}', CAST({value} AS VARCHAR))"
    kind = "CASE k % 4 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(KINDS) if x) + " ELSE left('x', 0) END"
    return f"replace({out}, '{{j}}', {kind})"


WITH_COMMENTS = filled(DEFINITION.replace("{c}", COMMENTS["c"]).replace("{d}", COMMENTS["d"]))
WITHOUT = filled(DEFINITION.replace("{c}", " ").replace("{d}", " "))
K = "k AS (SELECT p_partkey AS k FROM part)"
TYPE = "CASE WHEN {} % 3 = 0 THEN 'procedure' ELSE 'view' END"
#: The edges that the definitions have: what each refers to, by number.
REFERENCES = f"""{K}, refs AS (SELECT 'dbo.v' || k AS subject, 'references' AS predicate, 'dbo.b' || (k % 10) AS object, k, 1 AS kind FROM k
    UNION ALL SELECT 'dbo.v' || k, 'writes_to', 'dbo.r' || (k % 7), k, 2 FROM k
    UNION ALL SELECT 'dbo.v' || k, CASE WHEN (k // 2) % 3 = 0 THEN 'calls' ELSE 'references' END, 'dbo.v' || (k // 2), k, 3 FROM k WHERE k > 0)"""


def spark_sql(text: str) -> Column:
    return F.expr(text.replace("//", "DIV").replace("AS VARCHAR", "AS STRING").replace("\n", "\\n").replace("''", "\\'"))


def numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("k"))


def name(letter: str, number: str) -> Column:
    return F.concat(F.lit(f"dbo.{letter}"), F.expr(number).cast("string"))


def definitions(spark: SparkSession, d: str) -> DataFrame:
    return numbers(spark, d).select(name("v", "k").alias("name"), spark_sql(WITH_COMMENTS).alias("definition"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    k = numbers(spark, d)
    own = k.select(name("v", "k").alias("name"), F.expr(TYPE.format("k")).alias("object_type"))
    tables = k.select(name("b", "k % 10").alias("name")).union(k.select(name("r", "k % 7"))).distinct()
    return own.unionByName(tables.withColumn("object_type", F.lit("table")))


def references(spark: SparkSession, d: str) -> DataFrame:
    return lineage.sql_references(definitions(spark, d), catalog(spark, d))


def stored(spark: SparkSession, d: str) -> DataFrame:
    return references(spark, d).withColumns({"source": F.lit("sql"), "extraction_method": F.lit("deterministic")})


def procedures(spark: SparkSession, d: str) -> DataFrame:
    return numbers(spark, d).where("k % 3 = 0").select(name("v", "k").alias("start"))


@registered(f"WITH {K} SELECT 'dbo.v' || k AS name, {WITHOUT} AS text FROM k")
def strip_sql_comments(spark, d):
    return definitions(spark, d).select("name", lineage.strip_sql_comments(F.col("definition")).alias("text"))


@registered(f"WITH {K} SELECT 'dbo.v' || k AS name, 'dbo.r' || (k % 7) AS target FROM k")
def write_targets(spark, d):
    return lineage.write_targets(definitions(spark, d))


@registered(f"WITH {REFERENCES} SELECT subject, predicate, object FROM refs")
def sql_references(spark, d):
    return references(spark, d)


@registered(f"WITH {REFERENCES} SELECT 'shop.' || subject AS subject, predicate, 'shop.' || object AS object FROM refs")
def qualify_edges(spark, d):
    return lineage.qualify_edges(references(spark, d), "shop.")


GRAPH = f"""WITH RECURSIVE {REFERENCES}, up AS (SELECT subject AS start, 1 AS hop, subject, predicate, object FROM refs WHERE k % 3 = 0
    UNION SELECT start, hop + 1, r.subject, r.predicate, r.object FROM up JOIN refs r ON r.subject = up.object WHERE hop < 3),
down AS (SELECT object AS start, 1 AS hop, subject, predicate, object FROM refs WHERE kind = 3 AND (k // 2) % 3 = 0
    UNION SELECT start, hop + 1, r.subject, r.predicate, r.object FROM down JOIN refs r ON r.object = down.subject WHERE hop < 3)"""
BOTH = "SELECT *, 'upstream' AS direction FROM up UNION ALL SELECT *, 'downstream' FROM down"


@registered(f"{GRAPH} {BOTH}")
def sql_dependency_graph(spark, d):
    return lineage.sql_dependency_graph(stored(spark, d), procedures(spark, d))


@registered(f"{GRAPH} SELECT *, 'dmv' AS evidence FROM ({BOTH})")
def catalog_dependencies(spark, d):
    return lineage.catalog_dependencies(references(spark, d), procedures(spark, d))


@registered(f"""WITH {REFERENCES}, first AS (SELECT subject AS start, 1 AS hop, subject, predicate, object, k, kind, k % 5 = 0 AS lost FROM refs WHERE k % 3 = 0)
SELECT start, hop, subject, predicate, object, 'upstream' AS direction, CASE WHEN lost AND kind = 1 THEN 'text-fallback' ELSE 'dmv' END AS evidence FROM first""")
def supplement_from_text(spark, d):
    """What the catalog reports has lost the base tables of every fifth object; their texts have them."""
    text = references(spark, d)
    number = F.regexp_extract("subject", r"(\d+)$", 1).cast("bigint")
    reported = text.where(~((number % 5 == 0) & F.col("object").startswith("dbo.b")))
    found = lineage.sql_dependency_graph(reported.withColumns({"source": F.lit("sql"), "extraction_method": F.lit("deterministic")}), procedures(spark, d), 1, "upstream").withColumn("evidence", F.lit("dmv"))
    return lineage.supplement_from_text(found, text, catalog(spark, d))


@registered(f"""WITH {K} SELECT w.wanted, 'dbo.v' || k AS name, {WITH_COMMENTS} AS text FROM k, LATERAL (SELECT CASE k % 3 WHEN 0 THEN 'v' || k WHEN 1 THEN '[DBO].[v' || k || ']' ELSE 'shop.dbo.V' || k END AS wanted) w""")
def object_definitions(spark, d):
    wanted = numbers(spark, d).select(F.expr("CASE k % 3 WHEN 0 THEN concat('v', k) WHEN 1 THEN concat('[DBO].[v', k, ']') ELSE concat('shop.dbo.V', k) END").alias("wanted"))
    return lineage.object_definitions(wanted, definitions(spark, d).withColumnRenamed("definition", "text"))


@registered(f"WITH {K} SELECT 'dbo.v' || k AS name, 'dbo.b' || (k % 10) AS prior, 'dbo.v' || (k // 2) AS joined, CASE k % 4 WHEN 0 THEN 'INNER' WHEN 1 THEN 'LEFT' WHEN 2 THEN 'RIGHT' ELSE 'FULL' END AS kind, '#t' || k AS target FROM k")
def join_edges(spark, d):
    return lineage.join_edges(definitions(spark, d)).select("name", "prior", "joined", "kind", "target")


@registered(f"""WITH {K} SELECT 'dbo.v' || k AS name, x.* FROM k, LATERAL (VALUES ('#t' || k, 0, 'name', 's.name', 'dbo.b' || (k % 10), 'name'), ('#t' || k, 1, 'total', 'o.total', 'dbo.v' || (k // 2), 'total'),
    ('dbo.r' || (k % 7), 0, 'name', 'name', '#t' || k, 'name'), ('dbo.r' || (k % 7), 1, 'total', 'SUM(total)', '#t' || k, 'total')) x(stage, ordinal, column_name, expression, leaf_table, leaf_column)""")
def column_edges(spark, d):
    return lineage.column_edges(definitions(spark, d)).select("name", "stage", "ordinal", F.col("column").alias("column_name"), "expression", "leaf_table", "leaf_column")


@registered(f"WITH {K} SELECT 'dbo.v' || k AS name, 'dbo.r' || (k % 7) AS stage, 'total' AS column_name, '`dbo.r' || (k % 7) || '.total` (SUM(total)) ← `#t' || k || '.total` ← `dbo.v' || (k // 2) || '.total`' AS path FROM k")
def lineage_paths(spark, d):
    wanted = numbers(spark, d).select(name("v", "k").alias("name"), name("r", "k % 7").alias("stage"), F.lit("total").alias("column"))
    # paths read the edges twice
    return lineage.lineage_paths(checkpointed(lineage.column_edges(definitions(spark, d))), wanted).withColumnRenamed("column", "column_name")


#: Shapes beyond one template, by the number modulo 4: chained common table expressions with EXISTS, a union, a derived
#: table behind APPLY, and statements of an IF without semicolons.
SHAPES = (
    "WITH a{k} AS (SELECT s.x, s.y FROM dbo.b{b} s), c{k} AS (SELECT x, y * 2 AS z FROM a{k} WHERE EXISTS (SELECT 1 FROM dbo.b{n} q JOIN dbo.r{r} w ON w.i = q.i)) INSERT INTO dbo.r{r} (p, q) SELECT x, z FROM c{k}",
    "SELECT t.x AS u INTO #t{k} FROM dbo.b{b} t LEFT JOIN dbo.v{h} v ON v.i = t.i UNION ALL SELECT w.y FROM dbo.r{r} w JOIN dbo.b{n} z ON z.i = w.i",
    "SELECT d.x, m.best INTO #t{k} FROM dbo.b{b} m JOIN dbo.v{h} AS j ON j.i = m.i CROSS APPLY dbo.fn_x(m.i) f JOIN (SELECT x FROM dbo.r{r}) d ON 1 = 1",
    "IF 1 = 1 BEGIN UPDATE u SET u.x = 1 FROM dbo.r{r} u JOIN dbo.b{b} z ON z.i = u.i END ELSE SELECT CASE WHEN o.x > 0 THEN o.y ELSE p.y END AS yy INTO #t{k} FROM dbo.b{b} o FULL JOIN dbo.b{n} p ON p.i = o.i",
)
SHAPE = "CASE k % 4 " + " ".join(f"WHEN {i} THEN {filled(x)}" for i, x in enumerate(SHAPES)) + " END"


def shapes(spark: SparkSession, d: str) -> DataFrame:
    return numbers(spark, d).select(name("v", "k").alias("name"), spark_sql(SHAPE).alias("definition"))


@registered(f"""WITH {K}, t AS (SELECT k, 'dbo.v' || k AS name, '#t' || k AS target, 'dbo.b' || (k % 10) AS b, 'dbo.v' || (k // 2) AS v, 'dbo.r' || (k % 7) AS r, 'dbo.b' || ((k + 3) % 10) AS n FROM k)
SELECT name, b AS prior, v AS joined, 'LEFT' AS kind, target FROM t WHERE k % 4 = 1 UNION ALL SELECT name, r, n, 'INNER', target FROM t WHERE k % 4 = 1
UNION ALL SELECT name, b, v, 'INNER', target FROM t WHERE k % 4 = 2 UNION ALL SELECT name, b, n, 'FULL', target FROM t WHERE k % 4 = 3""")
def join_shapes(spark, d):
    return lineage.join_edges(shapes(spark, d)).select("name", "prior", "joined", "kind", "target")


@registered(f"""WITH {K}, t AS (SELECT k, 'dbo.v' || k AS name, '#t' || k AS t, 'dbo.b' || (k % 10) AS b, 'dbo.r' || (k % 7) AS r, 'dbo.b' || ((k + 3) % 10) AS n FROM k)
SELECT name, x.* FROM t, LATERAL (VALUES (0, 'a' || k, 0, 'x', 's.x', b, 'x'), (0, 'a' || k, 1, 'y', 's.y', b, 'y'), (0, 'c' || k, 0, 'x', 'x', 'a' || k, 'x'), (0, 'c' || k, 1, 'z', 'y * 2', 'a' || k, 'y'),
    (0, r, 0, 'p', 'x', 'c' || k, 'x'), (0, r, 1, 'q', 'z', 'c' || k, 'z'), (1, t.t, 0, 'u', 't.x', b, 'x'), (1, t.t, 0, 'u', 'w.y', r, 'y'), (2, t.t, 1, 'best', 'm.best', b, 'best'),
    (3, t.t, 0, 'yy', 'CASE WHEN o.x > 0 THEN o.y ELSE p.y END', b, 'x'), (3, t.t, 0, 'yy', 'CASE WHEN o.x > 0 THEN o.y ELSE p.y END', b, 'y'), (3, t.t, 0, 'yy', 'CASE WHEN o.x > 0 THEN o.y ELSE p.y END', n, 'y')
    ) x(shape, stage, ordinal, column_name, expression, leaf_table, leaf_column) WHERE k % 4 = shape""".replace("SELECT name, x.* FROM", "SELECT name, stage, ordinal, column_name, expression, leaf_table, leaf_column FROM"))
def column_shapes(spark, d):
    return lineage.column_edges(shapes(spark, d)).select("name", "stage", "ordinal", F.col("column").alias("column_name"), "expression", "leaf_table", "leaf_column")


# source files


def files(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of each file; the older one imports nothing, and every eleventh module is too large to be read."""
    i = table(spark, d, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("i"))
    module = lambda n: f"concat('pkg', ({n}) % 5, '/m', {n}, '.py')"
    py = i.select(F.expr(module("i")).alias("path"), F.expr("concat('import os, pkg', (i DIV 2) % 5, '.m', i DIV 2, '\\nfrom ..pkg', (i DIV 3) % 5, ' import m', i DIV 3, '  # from pkg1 import m1\\n', repeat('x', CASE WHEN i % 11 = 0 THEN 500 ELSE 0 END))").alias("content"))
    ts = i.select(F.expr("concat('web/f', i, '.ts')").alias("path"), F.expr("concat('import a from \\'./f', i DIV 2, '\\'\\nconst r = require(\"react\")\\n')").alias("content"))
    now = py.unionByName(ts).withColumns({"taken_at": F.lit(2), "is_dir": F.lit(False)})
    old = now.withColumns({"taken_at": F.lit(1), "content": F.lit("old")})
    folders = i.select(F.expr("concat('pkg', i % 5)").alias("path")).distinct().withColumns({"content": F.lit(""), "taken_at": F.lit(3), "is_dir": F.lit(True)})
    return now.unionByName(old).unionByName(folders).withColumn("git_scope", F.lit("shop@main"))


#: What imports what: modules that are not too large to be read, as long as what they mean is there.
FILES = """i AS (SELECT doc_id AS i FROM documents WHERE doc_id IS NOT NULL), m AS (SELECT i, 'pkg' || (i % 5) || '/m' || i || '.py' AS path FROM i WHERE i % 11 <> 0),
imports AS (SELECT DISTINCT a.path AS subject, b.path AS object FROM m a JOIN m b ON b.i = a.i // 2 OR b.i = a.i // 3 WHERE a.i <> b.i
    UNION ALL SELECT 'web/f' || a.i || '.ts', 'web/f' || b.i || '.ts' FROM i a JOIN i b ON b.i = a.i // 2 WHERE a.i <> b.i)"""


@registered(f"WITH {FILES} SELECT path, 2 AS taken_at FROM m UNION ALL SELECT 'web/f' || i || '.ts', 2 FROM i")
def current_files(spark, d):
    return lineage.current_files(files(spark, d), 400).select("path", "taken_at")


@registered("""WITH i AS (SELECT doc_id AS i, 'pkg' || (doc_id % 5) || '/m' || doc_id || '.py' AS path FROM documents WHERE doc_id IS NOT NULL)
SELECT path, 'py' AS kind, 0 AS level, 'os' AS module, '' AS name FROM i WHERE i % 11 <> 0 UNION ALL SELECT path, 'py', 0, 'pkg' || ((i // 2) % 5) || '.m' || (i // 2), '' FROM i WHERE i % 11 <> 0
UNION ALL SELECT path, 'py', 2, 'pkg' || ((i // 3) % 5), 'm' || (i // 3) FROM i WHERE i % 11 <> 0
UNION ALL SELECT 'web/f' || i || '.ts', 'js', 0, x.module, '' FROM i, LATERAL (VALUES ('./f' || (i // 2)), ('react')) x(module)""")
def import_specifiers(spark, d):
    return lineage.import_specifiers(lineage.current_files(files(spark, d), 400)).select("path", "kind", "level", "module", "name")


@registered(f"WITH {FILES} SELECT subject, 'imports' AS predicate, object FROM imports")
def git_imports(spark, d):
    return lineage.git_imports(lineage.current_files(files(spark, d), 400)).select("subject", "predicate", "object")


@registered(f"""WITH RECURSIVE {FILES}, up AS (SELECT subject AS start, 1 AS hop, subject, object FROM imports WHERE subject LIKE 'web/%' UNION SELECT start, hop + 1, n.subject, n.object FROM up JOIN imports n ON n.subject = up.object WHERE hop < 2),
down AS (SELECT object AS start, 1 AS hop, subject, object FROM imports WHERE object LIKE 'web/%' UNION SELECT start, hop + 1, n.subject, n.object FROM down JOIN imports n ON n.object = down.subject WHERE hop < 2)
SELECT *, 'upstream' AS direction, 'live-scan' AS evidence FROM up UNION ALL SELECT *, 'downstream', 'static-graph' FROM down""")
def import_rescan(spark, d):
    now = lineage.current_files(files(spark, d), 400)
    starts = now.where("path LIKE 'web/%'").select(F.col("path").alias("start"))
    return lineage.import_rescan(now, lineage.git_imports(now), starts, 2).select("start", "hop", "subject", "object", "direction", "evidence")


@registered(f"""WITH RECURSIVE {FILES}, s AS (SELECT 'shop@main:' || subject AS subject, 'shop@main:' || object AS object FROM imports),
down AS (SELECT 1 AS hop, subject, object FROM s WHERE object = 'shop@main:web/f1.ts' UNION SELECT hop + 1, s.subject, s.object FROM down JOIN s ON s.object = down.subject WHERE hop < 3),
up AS (SELECT 1 AS hop, subject, object FROM s WHERE subject = 'shop@main:web/f1.ts' UNION SELECT hop + 1, s.subject, s.object FROM up JOIN s ON s.subject = up.object WHERE hop < 3)
SELECT *, 'downstream' AS direction FROM down UNION ALL SELECT *, 'upstream' FROM up""")
def git_dependency_graph(spark, d):
    """One file's surroundings, as the reference's tool gives them."""
    edges = lineage.qualify_edges(lineage.git_imports(lineage.current_files(files(spark, d), 400)), "shop@main:")
    return lineage.git_dependency_graph(edges, "shop@main", "web/f1.ts").select("hop", "subject", "object", "direction")


# questions and their hits


def asked(spark: SparkSession, d: str) -> DataFrame:
    return numbers(spark, d).select(F.col("k").alias("question_id"), F.expr("CASE k % 4 WHEN 0 THEN concat('Where does v', k, ' come from?') WHEN 1 THEN 'How many are there?' WHEN 2 THEN concat('What is v', k, ' DERIVED of?') ELSE 'Impacted by rain' END").alias("text"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    """For each question its own object, that of half its number, and a table that the text doesn't name; a live hit above."""
    k = numbers(spark, d).withColumns({"t": spark_sql(WITH_COMMENTS), "is_live": F.lit(False)})
    row = lambda score, object_, kind, text, live=False: k.select(F.col("k").alias("question_id"), F.lit("sql").alias("source"), object_.alias("resource_id"), F.lit(0).alias("chunk_index"), F.lit(score).alias("score"), text.alias("text"), object_.alias("object_name"), F.expr(kind).alias("object_type"), F.lit(live).alias("is_live"))
    out = row(0.9, name("v", "k"), TYPE.format("k"), F.col("t")).unionByName(row(0.5, name("v", "k DIV 2"), TYPE.format("(k DIV 2)"), F.lit("...")))
    return out.unionByName(row(0.4, name("b", "(k + 1) % 10"), "'table'", F.lit("..."))).unionByName(row(0.95, name("live", "k"), "'view'", F.lit("#live"), True))


NAMES = f"{K}, names AS (SELECT k AS question_id, '#t' || k AS name, k FROM k UNION ALL SELECT k, 'dbo.v' || (k // 2), k FROM k WHERE k > 0)"


@registered("SELECT p_partkey::BIGINT AS question_id, p_partkey % 2 = 0 AS tracing FROM part")
def tracing_questions(spark, d):
    return asked(spark, d).select("question_id", is_tracing(F.col("text")).alias("tracing"))


@registered(f"WITH {K} SELECT k::BIGINT AS question_id, 'dbo.v' || k AS object_name FROM k")
def anchors(spark, d):
    return lineage.anchors(hits(spark, d)).select("question_id", "object_name")


@registered(f"WITH {NAMES} SELECT question_id::BIGINT AS question_id, name FROM names")
def candidate_names(spark, d):
    return lineage.candidate_names(hits(spark, d))


@registered(f"WITH {NAMES} SELECT question_id::BIGINT AS question_id, name FROM names WHERE name NOT LIKE '#%' AND (k // 2) % 3 = 0")
def candidate_callables(spark, d):
    return lineage.candidate_callables(hits(spark, d))


@registered(f"WITH {NAMES} SELECT question_id::BIGINT AS question_id, name FROM names WHERE name NOT LIKE '#%' AND (k // 2) % 3 = 0 AND k % 2 = 1")
def missing_calls(spark, d):
    opened = numbers(spark, d).where("k % 2 = 0").select(F.col("k").alias("question_id"), F.concat(F.lit("SHOP."), F.upper(name("v", "k DIV 2"))).alias("name"))
    return lineage.missing_calls(hits(spark, d), opened)


@registered(f"WITH {NAMES} SELECT question_id::BIGINT AS question_id, name FROM names WHERE k % 2 = 0 AND NOT (k % 4 = 0 AND name LIKE 'dbo%')")
def trace_gaps(spark, d):
    answers = asked(spark, d).select("question_id", F.when(F.col("question_id") % 4 == 0, F.concat(F.lit("It reads DBO.V"), F.expr("question_id DIV 2").cast("string"))).otherwise("It reads a table.").alias("answer"))
    return lineage.trace_gaps(asked(spark, d), hits(spark, d), answers)


@registered(f"""WITH {K} SELECT k::BIGINT AS question_id, 1 AS i, CASE k % 4 WHEN 0 THEN '`dbo.v' || (k // 2) || '` is INNER-joined to `dbo.b' || (k % 10) || '` when building `#t' || k || '` — a row in either table with no matching join key is silently excluded (dropped, not nulled) from what continues downstream'
    ELSE '`dbo.v' || (k // 2) || '` RIGHT-joins `dbo.b' || (k % 10) || '` when building `#t' || k || '` — every `dbo.v' || (k // 2) || '` row is kept even without a match, but a `dbo.b' || (k % 10) || '` row with no matching key in `dbo.v' || (k // 2) || '` is silently excluded from the result' END AS finding FROM k WHERE k % 2 = 0 AND k > 0""")
def join_risk_findings(spark, d):
    return lineage.join_risk_findings(asked(spark, d), hits(spark, d))


@registered(f"""WITH {K} SELECT k::BIGINT AS question_id, x.* FROM k, LATERAL (VALUES (1, '`dbo.r' || (k % 7) || '.name` ← `#t' || k || '.name` ← `dbo.b' || (k % 10) || '.name`'),
    (2, '`dbo.r' || (k % 7) || '.total` (SUM(total)) ← `#t' || k || '.total` ← `dbo.v' || (k // 2) || '.total`')) x(i, finding) WHERE k % 2 = 0""")
def column_lineage_findings(spark, d):
    return lineage.column_lineage_findings(asked(spark, d), hits(spark, d))


def file_hits(spark: SparkSession, d: str) -> DataFrame:
    """For each module a question: its own text first, then the modules of a half, of a third and of the next number."""
    now = lineage.current_files(files(spark, d), 400).where("path LIKE 'pkg%'").withColumn("i", F.regexp_extract("path", r"m(\d+)\.py$", 1).cast("bigint"))
    other = lambda score, n: now.select(F.col("i").alias("question_id"), F.lit(score).alias("score"), F.expr(f"concat('pkg', ({n}) % 5, '/m', {n}, '.py')").alias("file_path"), F.lit("...").alias("text"))
    rows = now.select(F.col("i").alias("question_id"), F.lit(0.9).alias("score"), F.col("path").alias("file_path"), F.col("content").alias("text"))
    for score, n in ((0.5, "i DIV 2"), (0.4, "i DIV 3"), (0.3, "i + 100000")):
        rows = rows.unionByName(other(score, n))
    return rows.withColumns({"source": F.lit("git"), "git_type": F.lit("file"), "resource_id": F.col("file_path"), "chunk_index": F.lit(0)})


NAMED = """WITH i AS (SELECT doc_id AS i FROM documents WHERE doc_id IS NOT NULL AND doc_id % 11 <> 0), n AS (SELECT DISTINCT i AS question_id, j FROM i, LATERAL (VALUES (i // 2), (i // 3)) x(j) WHERE i <> j)
SELECT question_id, 'pkg' || (j % 5) || '/m' || j || '.py' AS name FROM n"""


@registered(NAMED)
def candidate_files(spark, d):
    return lineage.candidate_files(file_hits(spark, d))


@registered(f"{NAMED} WHERE question_id % 2 = 1 OR j <> question_id // 2")
def missing_opens(spark, d):
    opened = file_hits(spark, d).where("question_id % 2 = 0 AND score = 0.9").select("question_id", F.expr("concat('else/M', question_id DIV 2, '.PY')").alias("name"))
    return lineage.missing_opens(file_hits(spark, d), opened)
