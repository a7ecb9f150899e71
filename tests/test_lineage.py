"""Exact edges, findings and paths of one procedure and of small source trees."""

from loamline.operators import lineage as L

PROC = """
CREATE OR ALTER PROCEDURE dbo.usp_Risk AS BEGIN
    -- mentions dbo.Regions only in a comment
    SELECT c.CustomerID, o.OrderDate, dbo.fn_Net(l.Quantity, l.UnitPrice) AS NetAmount
    INTO #Active
    FROM dbo.Customers c
    JOIN dbo.Orders o ON o.CustomerID = c.CustomerID AND o.Status = 'Done, or so'
    JOIN dbo.OrderLines l ON l.OrderID = o.OrderID
    WHERE c.IsActive = 1;
    SELECT CustomerID, MAX(OrderDate) AS LastOrder, SUM(NetAmount) AS Total
    INTO #Rfm
    FROM #Active
    GROUP BY CustomerID;
    EXEC dbo.usp_Snapshot;
    SELECT s.CustomerID, ISNULL(r.Total, 0) AS Total
    INTO #Enriched
    FROM dbo.Segments s
    LEFT JOIN #Rfm r ON r.CustomerID = s.CustomerID
    WHERE EXISTS (SELECT 1 FROM dbo.Customers x WHERE x.CustomerID = s.CustomerID);
    TRUNCATE TABLE dbo.Report_Risk;
    ;WITH Scored AS (
        SELECT CustomerID, (CASE WHEN Total > 5 THEN 1 ELSE 0 END) AS Score FROM #Enriched
    )
    INSERT INTO dbo.Report_Risk (CustomerID, RiskScore)
    SELECT CustomerID, ROUND(Score, 2) FROM Scored;
END;
"""
OBJECTS = [("dbo.Customers", "table"), ("dbo.Orders", "table"), ("dbo.OrderLines", "table"), ("dbo.fn_Net", "function"), ("dbo.usp_Snapshot", "procedure"), ("dbo.Segments", "table"), ("dbo.Report_Risk", "table"), ("dbo.usp_Risk", "procedure"), ("dbo.Regions", "table"), ("dbo.Returns", "table")]


def tables(spark):
    return spark.createDataFrame([("dbo.usp_Risk", PROC)], "name string, definition string"), spark.createDataFrame(OBJECTS, "name string, object_type string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_references_are_exactly_these(spark):
    defs, catalog = tables(spark)
    got = rows(L.sql_references(defs, catalog), "predicate", "object")
    assert got == sorted([("references", "dbo.Customers"), ("references", "dbo.Orders"), ("references", "dbo.OrderLines"), ("calls", "dbo.fn_Net"), ("calls", "dbo.usp_Snapshot"), ("references", "dbo.Segments"), ("writes_to", "dbo.Report_Risk")])


def test_bare_names_need_a_referencing_word(spark):
    defs = spark.createDataFrame([("dbo.f", "CREATE FUNCTION dbo.f() RETURNS INT AS SELECT 1 FROM Orders")], "name string, definition string")
    catalog = spark.createDataFrame([("dbo.f", "function"), ("dbo.Returns", "table"), ("dbo.Orders", "table")], "name string, object_type string")
    assert rows(L.sql_references(defs, catalog), "object") == [("dbo.Orders",)]


def test_joins_of_each_statement(spark):
    defs, _ = tables(spark)
    assert rows(L.join_edges(defs), "target", "prior", "joined", "kind") == [("#Active", "dbo.Customers", "dbo.Orders", "INNER"), ("#Active", "dbo.Orders", "dbo.OrderLines", "INNER"), ("#Enriched", "dbo.Segments", "#Rfm", "LEFT")]


def hits(spark):
    return spark.createDataFrame(
        [(1, "sql", "r1", 0, 0.9, PROC, "dbo.usp_Risk", "procedure", False), (1, "sql", "r2", 0, 0.5, "...", "dbo.usp_Snapshot", "procedure", False)],
        "question_id int, source string, resource_id string, chunk_index int, score double, text string, object_name string, object_type string, is_live boolean",
    )


def test_findings_and_gaps(spark):
    questions = spark.createDataFrame([(1, "Where is this derived from?"), (2, "How many are there?")], "question_id int, text string")
    got = [r.finding for r in L.join_risk_findings(questions, hits(spark)).collect()]
    assert got == ["`dbo.Segments` LEFT-joins `#Rfm` when building `#Enriched` — every `dbo.Segments` row is kept even without a match, but a `#Rfm` row with no matching key in `dbo.Segments` is silently excluded from the result"]
    answers = spark.createDataFrame([(1, "It comes from #rfm and #Active.")], "question_id int, answer string")
    assert rows(L.trace_gaps(questions, hits(spark), answers), "name") == [("#Enriched",), ("dbo.usp_Snapshot",)]
    opened = spark.createDataFrame([(1, "x.dbo.USP_SNAPSHOT")], "question_id int, name string")
    assert L.missing_calls(hits(spark), opened).count() == 0


def test_paths_through_a_cte_and_three_stages(spark):
    defs, _ = tables(spark)
    edges = L.column_edges(defs)
    wanted = spark.createDataFrame([("dbo.usp_Risk", "dbo.Report_Risk", "RiskScore")], "name string, stage string, column string")
    assert rows(L.lineage_paths(edges, wanted), "path") == [("`dbo.Report_Risk.RiskScore` (ROUND(Score, 2)) ← `Scored.Score` ((CASE WHEN Total > 5 THEN 1 ELSE 0 END)) ← `#Enriched.Total` (ISNULL(r.Total, 0)) ← `#Rfm.Total` (SUM(NetAmount)) ← `#Active.NetAmount` (dbo.fn_Net(l.Quantity, l.UnitPrice)) ← `dbo.OrderLines.Quantity`, `dbo.OrderLines.UnitPrice`",)]


def test_imports(spark):
    files = spark.createDataFrame(
        [("s", "shared/utils.py", "x = 1\n"), ("s", "shared/__init__.py", ""), ("s", "a.py", "from shared.utils import x\nimport os\n"), ("s", "b.py", "from shared import utils  # from nowhere import y\n"), ("s", "sub/__init__.py", ""), ("s", "sub/sibling.py", ""), ("s", "sub/d.py", "from . import sibling\nfrom ..shared.utils import (x,\n y)\n"), ("s", "web/u.js", ""), ("s", "web/f.js", "import u from './u'\nconst r = require('react')\n"), ("s", "web/deep/g.ts", "import { u } from '../u.js'\n")],
        "git_scope string, path string, content string",
    )
    assert rows(L.git_imports(files), "subject", "object") == [("a.py", "shared/utils.py"), ("b.py", "shared/utils.py"), ("sub/d.py", "shared/utils.py"), ("sub/d.py", "sub/sibling.py"), ("web/deep/g.ts", "web/u.js"), ("web/f.js", "web/u.js")]


def test_walk_ends_in_a_cycle_and_counts_hops(spark):
    edges = spark.createDataFrame([("a", "calls", "b"), ("b", "calls", "c"), ("c", "calls", "a"), ("x", "calls", "b")], "subject string, predicate string, object string")
    starts = spark.createDataFrame([("a",)], "start string")
    assert rows(L.walk(edges, starts, 5), "hop", "subject", "object") == [(1, "a", "b"), (2, "b", "c"), (3, "c", "a")]
    assert rows(L.walk(edges, starts, 5, "downstream"), "hop", "subject") == [(1, "c"), (2, "b"), (3, "a"), (3, "x")]


def test_names_that_very_many_mention_give_the_same_edges(spark, monkeypatch):
    defs, catalog = tables(spark)
    usual = rows(L.sql_references(defs, catalog), "subject", "predicate", "object")
    monkeypatch.setattr(L, "FREQUENT", 0)
    assert rows(L.sql_references(defs, catalog), "subject", "predicate", "object") == usual


def test_edges_are_made_once_for_all_hops(spark):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    from pyspark.sql import functions as F

    edges = spark.createDataFrame([(f"n{i}", "reads", f"n{i + 1}") for i in range(4)], "subject string, predicate string, object string").coalesce(1)
    counted = edges.withColumn("object", F.udf(count, "string").asNondeterministic()("object")).withColumns({"source": F.lit("sql"), "extraction_method": F.lit("deterministic")})
    out = L.sql_dependency_graph(counted, spark.createDataFrame([("n0",)], "start string"), 3)
    assert out.count() == 3 and made.value == 4


def test_walks_of_the_graphs_follow_every_edge(spark):
    """Over 500 objects that refer to one start, each with an own one behind it."""
    edges = [(f"u{k}", "calls", "hub") for k in range(620)] + [(f"w{k}", "calls", f"u{k}") for k in range(620)]
    frame = spark.createDataFrame(edges, "subject string, predicate string, object string")
    starts = spark.createDataFrame([("hub",)], "start string")
    for found in (L.catalog_dependencies(frame, starts, 2), L.sql_dependency_graph(frame.selectExpr("*", "'sql' AS source", "'deterministic' AS extraction_method"), starts, 2)):
        assert sorted((r.subject, r.object) for r in found.where("direction = 'downstream'").collect()) == sorted((s, o) for s, _, o in edges)
