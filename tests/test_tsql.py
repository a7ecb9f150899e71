"""Statements, joins and column sources of T-SQL shapes beyond one template."""

from loamline.operators import lineage, tsql

ASKED = "Where does Total come from? Trace it back to its source tables."


def defs(spark, *texts):
    return spark.createDataFrame([(f"dbo.p{i}", t) for i, t in enumerate(texts)], "name string, definition string")


def chains(spark, *texts):
    return sorted((r.name, r.prior, r.joined, r.kind, r.target) for r in lineage.join_edges(defs(spark, *texts)).collect())


def sources(spark, text):
    return sorted({(r.stage, r.column, r.expression, r.leaf_table, r.leaf_column) for r in lineage.column_edges(defs(spark, text)).collect()})


def hit(text, score=0.9, name="dbo.usp_P", kind="procedure"):
    return ("sql", name, 0, score, text, name, kind, False)


def findings(spark, of, *cases):
    """What is found for each case: a question, and its hits."""
    hits = spark.createDataFrame([(k, *h) for k, (_, *own) in enumerate(cases) for h in own], "question_id int, source string, resource_id string, chunk_index int, score double, text string, object_name string, object_type string, is_live boolean")
    found = of(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "question_id int, text string"), hits).orderBy("question_id", "i").collect()
    return [[r.finding for r in found if r.question_id == k] for k in range(len(cases))]


PROC = """CREATE OR ALTER PROCEDURE dbo.usp_P @From DATE = NULL AS
BEGIN
    SET NOCOUNT ON
    IF @From IS NULL SET @From = DATEADD(MONTH, -24, CAST(GETDATE() AS DATE));
    -- JOIN dbo.Hidden h ON 1 = 1
    IF OBJECT_ID('tempdb..#Lines') IS NOT NULL DROP TABLE #Lines
    SELECT c.Id, o.Placed, dbo.fn_Net(l.Qty, l.Price, l.Off) AS Net,
        CASE WHEN l.Off > 0 THEN 'a, (b' ELSE 'SELECT x FROM y' END AS Kind
    INTO #Lines
    FROM dbo.Clients c
    JOIN dbo.Sales o ON o.ClientId = c.Id AND o.State = 'Done, FROM here'
    INNER JOIN [dbo].[Sale Lines] AS l ON l.SaleId = o.Id
    WHERE c.Active = 1
    SELECT Id, MAX(Placed) LastPlaced, COUNT(DISTINCT Kind) AS Kinds, SUM(Net) AS Total,
        ROW_NUMBER() OVER (PARTITION BY Id ORDER BY SUM(Net) DESC) AS rn
    INTO #Sums
    FROM #Lines
    GROUP BY Id;
    EXEC dbo.usp_Other @From = @From;
    SELECT s.Id, s.Name, ISNULL(r.Total, 0) AS Total
    INTO #Rich
    FROM dbo.Snapshot s
    LEFT OUTER JOIN #Sums r ON r.Id = s.Id
    WHERE EXISTS (SELECT 1 FROM dbo.Clients x JOIN dbo.Deep y ON y.Id = x.Id WHERE x.Id = s.Id);
    TRUNCATE TABLE dbo.Report;
    ;WITH Scored AS (
        SELECT Id, Name, Total, (CASE WHEN Total > 10 THEN 2 ELSE 1 END) * 0.5 AS Score FROM #Rich
    ), Best AS (SELECT Id, Name, Total, Score FROM Scored WHERE Score > 1)
    INSERT INTO dbo.Report (Id, Name, Total, Score)
    SELECT Id, Name, Total, ROUND(Score, 2) FROM Best;
END;
"""


def test_joins_of_a_procedure(spark):
    assert chains(spark, PROC) == [
        ("dbo.p0", "dbo.Clients", "dbo.Sales", "INNER", "#Lines"),
        ("dbo.p0", "dbo.Sales", "dbo.Sale Lines", "INNER", "#Lines"),
        ("dbo.p0", "dbo.Snapshot", "#Sums", "LEFT", "#Rich"),
    ]


def test_columns_through_common_table_expressions(spark):
    got = sources(spark, PROC)
    assert ("#Lines", "Net", "dbo.fn_Net(l.Qty, l.Price, l.Off)", "dbo.Sale Lines", "Off") in got
    assert ("#Lines", "Kind", "CASE WHEN l.Off > 0 THEN 'a, (b' ELSE 'SELECT x FROM y' END", "dbo.Sale Lines", "Off") in got
    assert ("#Sums", "LastPlaced", "MAX(Placed)", "#Lines", "Placed") in got
    assert ("Scored", "Score", "(CASE WHEN Total > 10 THEN 2 ELSE 1 END) * 0.5", "#Rich", "Total") in got
    assert {g[:2] for g in got if g[3] == "Best"} == {("dbo.Report", c) for c in ("Id", "Name", "Total", "Score")}
    assert not [g for g in got if "Hidden" in g[3] or g[4] in ("DATE", "State", "Deep", "Id2")]


def test_lineage_findings(spark):
    path = "`dbo.Report.Total` ← `Best.Total` ← `Scored.Total` ← `#Rich.Total` (ISNULL(r.Total, 0)) ← `#Sums.Total` (SUM(Net)) ← `#Lines.Net` (dbo.fn_Net(l.Qty, l.Price, l.Off)) ← `dbo.Sale Lines.Off`, `dbo.Sale Lines.Price`, `dbo.Sale Lines.Qty`"
    none = ("CREATE PROCEDURE dbo.t AS BEGIN SELECT 1 AS X; END", "no SQL at all {{{ ] ) ( ' \"", "", None)
    named, first, other, *rest = findings(spark, lineage.column_lineage_findings, (ASKED, hit(PROC)), ("Trace this report to its sources.", hit(PROC)), ("What does it do?", hit(PROC)), *((ASKED, hit(t)) for t in none))
    assert named == [path]
    assert [f.split(" ← ")[0] for f in first] == ["`dbo.Report.Id`", "`dbo.Report.Name`", "`dbo.Report.Total`"]
    assert other == [] and rest == [[]] * len(none)


def chain(source):
    return hit(f"CREATE PROCEDURE dbo.x AS BEGIN SELECT a.Id INTO #R {source}; END")


def test_join_findings(spark):
    many = "FROM #A a " + " ".join(f"JOIN #T{k} t{k} ON t{k}.Id = a.Id" for k in range(8))
    silent = ("FROM dbo.A a, dbo.B b WHERE a.Id = b.Id", "FROM dbo.Gone1 a JOIN dbo.Gone2 b ON b.Id = a.Id", "FROM (SELECT Id FROM #A x JOIN #B y ON y.Id = x.Id) d JOIN #C c ON c.Id = d.Id", "FROM #A a CROSS JOIN #B b", "FROM #A a CROSS APPLY dbo.fn_Rows(a.Id) f LEFT JOIN #B b ON b.Id = f.Id")
    said, more, unasked, right, full, capped, *rest = findings(
        spark,
        lineage.join_risk_findings,
        (ASKED, hit(PROC)),
        (ASKED, hit(PROC), hit("...", 0.5, "dbo.Clients", "table")),
        ("What is it?", hit(PROC)),
        (ASKED, chain("FROM #A a RIGHT JOIN #B b ON b.Id = a.Id")),
        (ASKED, chain("FROM #A a FULL OUTER JOIN #B b ON b.Id = a.Id")),
        (ASKED, chain(many)),
        *((ASKED, chain(s)) for s in silent),
    )
    # the first statement's tables are no candidates until another hit names one
    assert said == ["`dbo.Snapshot` LEFT-joins `#Sums` when building `#Rich` — every `dbo.Snapshot` row is kept even without a match, but a `#Sums` row with no matching key in `dbo.Snapshot` is silently excluded from the result"]
    assert len(more) == 3 and more[0].startswith("`dbo.Sales` is INNER-joined to `dbo.Clients` when building `#Lines` — a row in either table")
    assert unasked == []
    assert right == ["`#B` RIGHT-joins `#A` when building `#R` — every `#B` row is kept even without a match, but a `#A` row with no matching key in `#B` is silently excluded from the result"]
    assert full == ["`#B` is FULL-joined to `#A` when building `#R` — a row from either side with no match on the other is kept but arrives with the other side's columns NULLed, not excluded — a downstream filter without NULL-handling can still drop it later"]
    assert len(capped) == 5 and rest == [[]] * len(silent)


def test_chains_end_and_expressions_are_left_out(spark):
    assert chains(
        spark,
        "SELECT a.x FROM dbo.A a JOIN dbo.B AS b ON b.i = a.i OUTER APPLY (SELECT TOP 1 y FROM dbo.C c JOIN dbo.D d ON d.i = c.i) z JOIN dbo.E e ON 1 = 1",
        "WITH q AS (SELECT i FROM dbo.S s JOIN dbo.T t ON t.i = s.i) SELECT q.i INTO #r FROM q LEFT JOIN #s s ON s.i = q.i",
        "SELECT q.i INTO #r FROM q LEFT JOIN #s s ON s.i = q.i",
        "CREATE VIEW dbo.v WITH SCHEMABINDING AS SELECT a.x FROM dbo.A a WITH (NOLOCK) JOIN dbo.B b WITH (NOLOCK) ON b.i = a.i UNION ALL SELECT c.x FROM dbo.C c LEFT JOIN dbo.D d ON d.i = c.i",
        "UPDATE t SET t.x = 1 FROM dbo.T t JOIN dbo.U u ON u.i = t.i SELECT a.i FROM dbo.A a JOIN dbo.B b ON a.i = b.i IF 1 = 1 BEGIN SELECT c.i FROM dbo.C c FULL JOIN dbo.D d ON c.i = d.i END ELSE SELECT 1",
    ) == [
        ("dbo.p0", "dbo.A", "dbo.B", "INNER", "dbo.p0"),
        ("dbo.p2", "q", "#s", "LEFT", "#r"),
        ("dbo.p3", "dbo.A", "dbo.B", "INNER", "dbo.p3"),
        ("dbo.p3", "dbo.C", "dbo.D", "LEFT", "dbo.p3"),
        ("dbo.p4", "dbo.A", "dbo.B", "INNER", "dbo.p4"),
        ("dbo.p4", "dbo.C", "dbo.D", "FULL", "dbo.p4"),
    ]


def test_columns_of_unions_and_aliases(spark):
    text = """INSERT dbo.Out (a, b, c)
        SELECT DISTINCT TOP (10) t.x, u = t.y + 1, (SELECT MAX(q.z) FROM dbo.Q q) FROM dbo.T t
        UNION ALL SELECT s.x2, s.y2 AS other, 3 FROM dbo.S s
        MERGE INTO dbo.M AS m USING dbo.N n ON n.i = m.i WHEN MATCHED THEN UPDATE SET m.x = n.x WHEN NOT MATCHED THEN INSERT (x) VALUES (n.x);
        SELECT TOP 5 [d].[First Name], d.y total, COUNT(*) AS n INTO #o FROM (SELECT y FROM dbo.Inner1) d"""
    assert sources(spark, text) == [
        ("dbo.Out", "a", "s.x2", "dbo.S", "x2"),
        ("dbo.Out", "a", "t.x", "dbo.T", "x"),
        ("dbo.Out", "b", "s.y2", "dbo.S", "y2"),
        ("dbo.Out", "b", "t.y + 1", "dbo.T", "y"),
    ]


def test_tokens(spark):
    text = "SELECT [a b].c, 'it''s -- no', 1.5 /* x, y */ FROM dbo . T -- end"
    got = [r.tok for r in tsql.tokens(defs(spark, text)).orderBy("i").collect()]
    assert got == ["SELECT", "[a b].c", ",", "'it''s -- no'", ",", "1.5", "FROM", "dbo.T"]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_dealt_once_and_never_broadcast(spark):
    """Definitions are moved before they are cut into tokens; joins of tokens don't trust the size of the definitions."""
    text = "SELECT s.a INTO #t FROM dbo.b s JOIN dbo.c c ON c.i = s.i; INSERT INTO dbo.r (a) SELECT a FROM #t"
    joins = plan_of(tsql.join_chains(defs(spark, text)))
    assert joins.count("Exchange") == 1 and "Join" not in joins
    columns = plan_of(tsql.column_sources(defs(spark, text)))
    assert "Broadcast" not in columns and columns.count("SortMergeJoin") == 4


def test_definitions_are_dealt_by_their_size(spark):
    many = defs(spark, *("SELECT a FROM b " * 10 for _ in range(20)))
    assert tsql.spread(many, 1000).rdd.getNumPartitions() == 4
    assert tsql.spread(many.limit(0), 1000).rdd.getNumPartitions() == 1


def test_places_are_told_without_windows_over_tokens(spark):
    """Joins of statements need neither a window nor a sort of tokens, and the tokens are read once."""
    joins = plan_of(tsql.join_chains(defs(spark, PROC)))
    assert "Window" not in joins and "Sort" not in joins and joins.count("ArrowEvalPython") == 1
    assert "Window" not in plan_of(tsql.placed(defs(spark, PROC)))


def test_places_of_many_definitions_are_those_of_each_alone(spark):
    text = "WITH q AS (SELECT a.x FROM dbo.A a) INSERT INTO dbo.R (k) SELECT x FROM q; SELECT r.k AS v INTO #t FROM dbo.R r LEFT JOIN dbo.S s ON s.i = r.i"
    alone = [[r[1:] for r in lineage.column_edges(defs(spark, t)).orderBy("stage", "column", "leaf_ordinal").collect()] for t in (PROC, text)]
    both = lineage.column_edges(defs(spark, PROC, "", None, text, ") ) BEGIN (")).orderBy("stage", "column", "leaf_ordinal").collect()
    assert [[r[1:] for r in both if r.name == n] for n in ("dbo.p0", "dbo.p3")] == alone and {r.name for r in both} == {"dbo.p0", "dbo.p3"}
