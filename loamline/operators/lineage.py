"""Dependency edges between SQL objects and source files, walks over them, and what they tell about a question.

Text never meets a catalog by a product of both: names are taken out of the texts first and joined on equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.text import is_tracing
from loamline.operators.contains import containing
from loamline.operators.tsql import column_sources, join_chains, joined, spread
from loamline.session import checkpointed

NAME = r"(?:\[[^\]]+\]|[#\w]+)(?:\.(?:\[[^\]]+\]|\w+)){0,2}"
#: Words after which a bare name is a reference, words after which a name is written to, file suffixes.
REFERENCES = "from|join|into|update|table|exec|execute"
WRITES = r"insert\s+into|update|merge(?:\s+into)?|truncate\s+table"
JS_SUFFIXES = ("", ".js", ".jsx", ".ts", ".tsx", ".mjs", "/index.js", "/index.ts", "/index.tsx")
CALLED = ("procedure", "function")
#: So many mentions of a name are too many for one task.
FREQUENT = 50_000


def strip_sql_comments(text: Column) -> Column:
    """Without line and block comments; quoted text keeps what looks like one."""
    return F.regexp_replace(text, r"('(?:[^']|'')*')|--[^\n]*|(?s:/\*.*?\*/)", "$1")


def bare(name: Column) -> Column:
    """The last part of a name, without brackets, in lower case."""
    return F.lower(F.element_at(F.split(F.regexp_replace(name, r"[\[\]]", ""), r"\."), -1))


def plain(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[\[\]]", ""))


def write_targets(defs: DataFrame) -> DataFrame:
    """(name, target): what INSERT INTO, UPDATE, MERGE and TRUNCATE TABLE write to."""
    text = strip_sql_comments(F.col("definition"))
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{WRITES})\s+({NAME})"), 1)
    return defs.select("name", F.explode(found).alias("raw")).select("name", plain(F.col("raw")).alias("target")).distinct()


def sql_references(defs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(subject, predicate, object): known objects that each definition mentions, by qualified name anywhere or, in dbo, by
    bare name after a referencing word. defs: name, definition; catalog: name, object_type."""
    defs = spread(defs)  # names are taken out and told apart in many small tasks
    text = strip_sql_comments(F.col("definition"))
    known = catalog.select(F.col("name").alias("object"), "object_type", F.lower("name").alias("key"))
    qualified = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\w)((?:\[[^\]]+\]|\w+)\.(?:\[[^\]]+\]|\w+))(?!\w)"), 1), plain)
    after = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{REFERENCES})\s+\[?(\w+)\]?(?![\w.])"), 1), lambda x: F.concat(F.lit("dbo."), F.lower(x)))
    targets = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{WRITES})\s+({NAME})"), 1), plain))
    mentioned = defs.select(F.lower("name").alias("_k"), F.explode(F.array_union(qualified, after)).alias("key"), targets.alias("targets"))
    pairs = mentioned.select("_k", "key", (F.array_contains("targets", F.col("key")) | F.array_contains("targets", bare(F.col("key")))).alias("written")).where("_k <> key")
    pairs = checkpointed(joined(pairs, catalog.select(F.lower("name").alias("_k"), F.col("name").alias("subject")), ["_k"]).select("subject", "key", "written"))
    # what very many definitions mention is looked up where they are, and doesn't gather in one task; few names can be so
    frequent = F.broadcast(checkpointed(pairs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT).select("key")))
    common = pairs.join(F.broadcast(known.join(frequent, "key", "left_semi")), "key")
    hits = common.unionByName(joined(pairs.join(frequent, "key", "left_anti"), known, ["key"]))
    predicate = F.when(F.col("object_type").isin(*CALLED), "calls").when(F.max("written"), "writes_to").otherwise("references")
    return hits.groupBy("subject", "object", "object_type").agg(predicate.alias("predicate")).select("subject", "predicate", "object").distinct()


def qualify_edges(edges: DataFrame, prefix: str) -> DataFrame:
    """Both ends under a database name ("db.") or a repository scope ("repo@branch:")."""
    return edges.withColumns({c: F.concat(F.lit(prefix), c) for c in ("subject", "object")})


def import_specifiers(files: DataFrame) -> DataFrame:
    """(git_scope, path, kind, level, module, name): imports of Python and JavaScript or TypeScript files."""
    code = F.regexp_replace(F.col("content"), r"(?m)(?<!['\":])(?:#|//)[^\n]*$|(?s:/\*.*?\*/)", "")
    py = files.where(F.col("path").rlike(r"\.pyi?$")).withColumn("code", F.regexp_replace(F.regexp_replace(code, r"\\\n", " "), r"\(([^()]*)\)", "($1)"))
    js = files.where(F.col("path").rlike(r"\.(?:jsx?|tsx?|mjs|cjs)$")).withColumn("code", code)
    keys = ["git_scope", "path"]
    plain_ = py.select(*keys, F.explode(F.regexp_extract_all("code", F.lit(r"(?m)^\s*import\s+([\w., \t]+)"), 1)).alias("names")).select(*keys, F.explode(F.split("names", ",")).alias("n")).select(*keys, F.lit("py").alias("kind"), F.lit(0).alias("level"), F.regexp_extract("n", r"^\s*([\w.]+)", 1).alias("module"), F.lit("").alias("name"))
    lines = py.select(*keys, F.explode(F.regexp_extract_all("code", F.lit(r"(?m)^\s*(from\s+\.*[\w.]*\s+import\s+(?:\([^)]*\)|[^\n]+))"), 1)).alias("x"))
    from_ = lines.select(*keys, F.char_length(F.regexp_extract("x", r"^from\s+(\.*)", 1)).alias("level"), F.regexp_extract("x", r"^from\s+\.*([\w.]*)", 1).alias("module"), F.explode(F.split(F.regexp_replace(F.regexp_extract("x", r"(?s)\simport\s+(.*)$", 1), r"[()]", ""), ",")).alias("n"))
    from_ = from_.select(*keys, F.lit("py").alias("kind"), "level", "module", F.regexp_extract("n", r"^\s*([\w*]+)", 1).alias("name")).where("name <> ''")
    found = F.regexp_extract_all("code", F.lit(r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)['"]([^'"\n]+)['"]"""), 1)
    js_ = js.select(*keys, F.explode(found).alias("module")).select(*keys, F.lit("js").alias("kind"), F.lit(0).alias("level"), "module", F.lit("").alias("name"))
    return plain_.unionByName(from_).unionByName(js_).distinct()


def _joined(base: Column, path: Column) -> Column:
    """base/path with "." and ".." resolved, by array steps over at most what the path has of them."""
    parts = F.filter(F.split(F.concat_ws("/", base, path), "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolve_imports(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(git_scope, path, target): the file that each specifier means, submodules before packages, first match first.

    An absolute module is one file's unique path suffix; relative ones are exact; bare names of packages are dropped."""
    here = F.regexp_replace("path", r"/?[^/]*$", "")
    up = F.array_join(F.slice(F.split(here, "/"), 1, F.greatest(F.size(F.split(here, "/")) - (F.col("level") - 1), F.lit(0))), "/")
    dotted = F.replace("module", F.lit("."), F.lit("/"))
    py = specs.where("kind = 'py'").withColumn("stem", F.when(F.col("level") > 0, F.concat_ws("/", F.nullif(up, F.lit("")), F.nullif(dotted, F.lit("")))).otherwise(dotted))
    sub = F.when(F.col("name") != "", F.concat_ws("/", F.nullif("stem", F.lit("")), "name"))
    cands = F.array(F.struct(F.lit(0).alias("p"), F.concat(sub, F.lit(".py")).alias("c")), F.struct(F.lit(1).alias("p"), F.concat(sub, F.lit("/__init__.py")).alias("c")), F.struct(F.lit(2).alias("p"), F.concat("stem", F.lit(".py")).alias("c")), F.struct(F.lit(3).alias("p"), F.concat("stem", F.lit("/__init__.py")).alias("c")))
    py = py.select("git_scope", "path", "module", "name", "level", (F.col("level") > 0).alias("exact"), F.explode(cands).alias("x"))
    js = specs.where("kind = 'js' AND module LIKE '.%'").select("git_scope", "path", "module", "name", "level", F.lit(True).alias("exact"), _joined(here, F.col("module")).alias("stem"))
    js = js.select("git_scope", "path", "module", "name", "level", "exact", F.explode(F.array(*(F.struct(F.lit(k).alias("p"), F.concat("stem", F.lit(s)).alias("c")) for k, s in enumerate(JS_SUFFIXES)))).alias("x"))
    wanted = py.unionByName(js).select("git_scope", "path", "module", "name", "level", "exact", "x.*").where("c IS NOT NULL")
    parts = F.split("path", "/")
    suffixes = files.select("git_scope", F.col("path").alias("target"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("c"))
    hits = wanted.join(suffixes, ["git_scope", "c"]).where("NOT exact OR c = target")
    alone = hits.withColumn("n", F.count("*").over(Window.partitionBy("git_scope", "path", "module", "name", "level", "p"))).where("n = 1")
    best = alone.groupBy("git_scope", "path", "module", "name", "level").agg(F.min_by("target", "p").alias("target"))
    return best.select("git_scope", "path", "target").distinct()


def git_imports(files: DataFrame) -> DataFrame:
    """(git_scope, subject, predicate, object) of a repository's files; no file imports itself."""
    found = resolve_imports(import_specifiers(files), files).where("path <> target")
    return found.select("git_scope", F.col("path").alias("subject"), F.lit("imports").alias("predicate"), F.col("target").alias("object")).distinct()


def edge_search(edges: DataFrame, entity: str, cap: int = 20, scopes: DataFrame | None = None) -> DataFrame:
    """Distinct triples that have the text in their subject or object, the first cap (1 to 100) in order. scopes (source,
    resource_identifier): what the asker may see; other edges take no part."""
    if scopes is not None:
        edges = edges.join(scopes.select("source", "resource_identifier").distinct(), ["source", "resource_identifier"], "left_semi")
    has = lambda c: F.contains(F.lower(c), F.lit(entity.lower()))
    return edges.where(has("subject") | has("object")).select("subject", "predicate", "object").distinct().orderBy("subject", "predicate", "object").limit(max(1, min(cap, 100)))


def edge_searches(edges: DataFrame, wanted: DataFrame, scopes: DataFrame, cap: int = 20) -> DataFrame:
    """(query_id, subject, predicate, object, rank): edge_search for many askers at once. wanted: query_id, entity; scopes:
    query_id, source, resource_identifier. Names are looked up by trigrams (see contains.py); the empty name finds nothing."""
    ends = edges.select(F.col("subject").alias("text")).unionByName(edges.select(F.col("object").alias("text")))
    names = containing(wanted, ends, "entity").select(F.col("needle").alias("entity"), "text")
    own = edges.select("source", "resource_identifier", "subject", "predicate", "object")
    hits = [wanted.join(names, "entity").join(own, F.col("text") == F.col(c)).select("query_id", "source", "resource_identifier", "subject", "predicate", "object") for c in ("subject", "object")]
    seen = hits[0].unionByName(hits[1]).join(scopes.distinct(), ["query_id", "source", "resource_identifier"], "left_semi").select("query_id", "subject", "predicate", "object").distinct()
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("subject", "predicate", "object"))
    return seen.withColumn("rank", order).where(F.col("rank") <= max(1, min(cap, 100)))


def walk(edges: DataFrame, starts: DataFrame, hops: int = 3, direction: str = "upstream", match: str = "exact", cap: int | None = None) -> DataFrame:
    """(start, hop, subject, predicate, object): breadth first, each hop an equi-join, five hops at most.

    upstream goes from subject to object, downstream back. A node is entered once for each start; an edge may be listed
    at more than one hop. The edges are made once, not for each hop. contains: starts are first resolved to the nodes that
    contain them, in any case, by trigrams. All edges of a start and hop are followed; a caller may ask for the first cap of
    them, in order."""
    own, other = ("subject", "object") if direction == "upstream" else ("object", "subject")
    e = checkpointed(edges.select("subject", "predicate", "object").distinct())
    nodes = e.select(F.col(own).alias("node")).distinct()
    s = starts.select("start").distinct()
    frontier = s.withColumn("node", F.col("start")) if match == "exact" else containing(s, nodes, "start", "node").toDF("start", "node")
    visited, out = frontier, None
    for hop in range(1, min(hops, 5) + 1):
        step = frontier.join(e.hint("merge"), F.col("node") == F.col(own)).select("start", F.lit(hop).alias("hop"), "subject", "predicate", "object").distinct()
        if cap is not None:
            step = step.withColumn("_rn", F.row_number().over(Window.partitionBy("start").orderBy("subject", "predicate", "object"))).where(F.col("_rn") <= cap).drop("_rn")
        step = checkpointed(step)
        out = step if out is None else out.unionByName(step)
        frontier = checkpointed(step.select("start", F.col(other).alias("node")).distinct().join(visited.hint("merge"), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return out


def sql_dependency_graph(edges: DataFrame, starts: DataFrame, hops: int = 3, direction: str = "both", methods: str = "deterministic", match: str = "exact") -> DataFrame:
    """walk over SQL edges in one or both directions, with the direction as a column."""
    own = edges.where("source = 'sql'")
    if methods != "all":
        own = own.where(F.col("extraction_method") == methods)
    if direction == "both":
        own = checkpointed(own.select("subject", "predicate", "object"))  # both walks read it
    ways = ("upstream", "downstream") if direction == "both" else (direction,)
    parts = [walk(own, starts, hops, w, match).withColumn("direction", F.lit(w)) for w in ways]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def git_dependency_graph(edges: DataFrame, scope: str, path: str, hops: int = 3, direction: str = "both") -> DataFrame:
    own = edges.where("predicate = 'imports'").withColumns({"source": F.lit("sql"), "extraction_method": F.lit("deterministic")})
    starts = edges.sparkSession.createDataFrame([(f"{scope}:{path}",)], "start string")
    return sql_dependency_graph(own, starts, hops, direction)


def catalog_dependencies(references: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """The walk over references that the database itself reports."""
    edges = references.withColumns({"source": F.lit("sql"), "extraction_method": F.lit("deterministic")})
    return sql_dependency_graph(edges, starts, hops).withColumn("evidence", F.lit("dmv"))


def supplement_from_text(found: DataFrame, text_edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """found with the first-hop upstream edges that only the text shows, tables as starts excepted."""
    starts = found.select("start").distinct().join(catalog.where("object_type <> 'table'").select(F.lower("name").alias("_k")), F.lower("start") == F.col("_k"), "left_semi")
    extra = text_edges.join(starts, F.lower("subject") == F.lower("start")).select("start", F.lit(1).alias("hop"), "subject", "predicate", "object", F.lit("upstream").alias("direction"), F.lit("text-fallback").alias("evidence"))
    seen = found.where("hop = 1 AND direction = 'upstream'").select(F.col("start").alias("_s"), F.lower("object").alias("_o")).distinct()
    return found.unionByName(extra.join(seen, (F.col("start") == F.col("_s")) & (F.lower("object") == F.col("_o")), "left_anti"))


def current_files(snapshots: DataFrame, max_bytes: int = 150_000) -> DataFrame:
    """The newest content of each path, directories and large files left out."""
    newest = F.row_number().over(Window.partitionBy("git_scope", "path").orderBy(F.desc("taken_at"), F.desc("content")))
    return snapshots.where("NOT coalesce(is_dir, false)").withColumn("_rn", newest).where((F.col("_rn") == 1) & (F.octet_length("content") <= max_bytes)).drop("_rn", "is_dir")


def import_rescan(files: DataFrame, stored: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """Upstream from what the files hold now, downstream from the stored edges."""
    live = walk(git_imports(files), starts, hops, "upstream").withColumns({"direction": F.lit("upstream"), "evidence": F.lit("live-scan")})
    return live.unionByName(walk(stored, starts, hops, "downstream").withColumns({"direction": F.lit("downstream"), "evidence": F.lit("static-graph")}))


def object_definitions(names: DataFrame, resources: DataFrame) -> DataFrame:
    """(wanted, name, text): whole definitions by "db.schema.object", "schema.object" or "object" (of dbo)."""
    parts = F.split(plain(F.col("wanted")), r"\.")
    key = F.when(F.size(parts) == 1, F.concat(F.lit("dbo."), parts[0])).otherwise(F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1)))
    return names.withColumn("_k", key).join(resources.select("name", "text", F.lower("name").alias("_k")), "_k").drop("_k")


def _first(hits: DataFrame, what: Column) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("resource_id"), F.asc("chunk_index"))
    return hits.where(what).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def anchors(hits: DataFrame, kind: str = "sql") -> DataFrame:
    """Each question's best SQL hit that isn't live, or its best repository file."""
    return _first(hits, (F.col("source") == "sql") & ~F.coalesce(F.col("is_live"), F.lit(False)) if kind == "sql" else (F.col("source") == "git") & (F.col("git_type") == "file"))


def candidate_names(hits: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(question_id, name): temporary tables of the anchor, and other objects that its text names. types: only such objects,
    and no temporary tables."""
    a = anchors(hits).select("question_id", F.col("text").alias("_text"), F.col("object_name").alias("_own"))
    temp = a.select("question_id", F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(r"(#\w+)"), 1))).alias("name"))
    others = hits.where("source = 'sql' AND object_name IS NOT NULL")
    if types:
        others = others.where(F.col("object_type").isin(*types))
    named = joined(others.select("question_id", "object_name").distinct(), a, ["question_id"]).where("object_name <> coalesce(_own, '')")
    found = named.where(F.contains(F.lower("_text"), bare(F.col("object_name")))).select("question_id", F.col("object_name").alias("name"))
    return (found if types else temp.unionByName(found)).distinct()


def candidate_callables(hits: DataFrame) -> DataFrame:
    return candidate_names(hits, CALLED)


def missing_calls(hits: DataFrame, opened: DataFrame) -> DataFrame:
    """Callables that the anchor names and nobody has opened, by bare lower-case name."""
    seen = opened.select("question_id", bare(F.col("name")).alias("_b"))
    return candidate_callables(hits).withColumn("_b", bare(F.col("name"))).join(seen, ["question_id", "_b"], "left_anti").drop("_b")


def candidate_files(hits: DataFrame) -> DataFrame:
    """(question_id, name): other files that the anchor file's text names by base name, stem or dotted form."""
    a = anchors(hits, "git").select("question_id", F.col("text").alias("_text"), F.col("file_path").alias("_own"))
    others = hits.where("source = 'git' AND git_type = 'file'").select("question_id", "file_path").distinct().join(a, "question_id").where("file_path <> _own")
    base, path = F.element_at(F.split("file_path", "/"), -1), F.regexp_replace("file_path", r"\.\w+$", "")
    stem = F.regexp_replace(base, r"\.\w+$", "")
    word = lambda x: F.expr("true") & F.regexp_like("_text", F.concat(F.lit(r"(?<!\w)\Q"), x, F.lit(r"\E(?!\w)")))
    return others.where(word(base) | word(stem) | word(F.replace(path, F.lit("/"), F.lit(".")))).select("question_id", F.col("file_path").alias("name")).distinct()


def missing_opens(hits: DataFrame, opened: DataFrame) -> DataFrame:
    base = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    return candidate_files(hits).withColumn("_b", base(F.col("name"))).join(opened.select("question_id", base(F.col("name")).alias("_b")), ["question_id", "_b"], "left_anti").drop("_b")


def trace_gaps(questions: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates of tracing questions that the answer doesn't mention."""
    asked = questions.where(is_tracing(F.col("text"))).select("question_id")
    rows = candidate_names(hits).join(asked, "question_id", "left_semi").join(answers.select("question_id", "answer"), "question_id")
    return rows.where(~F.contains(F.lower("answer"), F.lower("name"))).select("question_id", "name")


def join_edges(defs: DataFrame) -> DataFrame:
    """(name, n, i, prior, joined, kind, target): see tsql.join_chains."""
    return join_chains(defs).select("name", "n", "i", "prior", "joined", "kind", "target")


#: What is said of a join by its kind; {p}, {j} and {t} stand for the tables and the target.
WORDING = {
    "INNER": "`{j}` is INNER-joined to `{p}` when building `{t}` — a row in either table with no matching join key is silently excluded (dropped, not nulled) from what continues downstream",
    "LEFT": "`{p}` LEFT-joins `{j}` when building `{t}` — every `{p}` row is kept even without a match, but a `{j}` row with no matching key in `{p}` is silently excluded from the result",
    "RIGHT": "`{j}` RIGHT-joins `{p}` when building `{t}` — every `{j}` row is kept even without a match, but a `{p}` row with no matching key in `{j}` is silently excluded from the result",
    "FULL": "`{j}` is FULL-joined to `{p}` when building `{t}` — a row from either side with no match on the other is kept but arrives with the other side's columns NULLed, not excluded — a downstream filter without NULL-handling can still drop it later",
}


def join_risk_findings(questions: DataFrame, hits: DataFrame, most: int = 5) -> DataFrame:
    """(question_id, i, finding): what the joins of a tracing question's anchor may drop, for chains that touch a candidate."""
    asked = questions.where(is_tracing(F.col("text"))).select("question_id")
    a = joined(anchors(hits), asked, ["question_id"], "left_semi")
    edges = join_edges(a.select(F.col("question_id").cast("string").alias("name"), F.col("text").alias("definition")))
    own = a.select("question_id", F.col("question_id").cast("string").alias("name"), "object_name")
    edges = joined(edges, own, ["name"]).withColumn("target", F.when(F.col("target") == F.col("name"), F.col("object_name")).otherwise(F.col("target")))
    names = candidate_names(hits).select(F.col("question_id").cast("string").alias("name"), plain(F.col("name")).alias("_c"))
    touched = edges.select("name", "n", F.explode(F.array("prior", "joined")).alias("t")).withColumn("_c", plain(F.col("t")))
    chains = joined(touched, names, ["name", "_c"], "left_semi").select("name", "n").distinct()
    text = F.lit(None).cast("string")
    for kind, words in WORDING.items():
        said: Column = F.lit(words)
        for mark, c in (("{p}", "prior"), ("{j}", "joined"), ("{t}", "target")):
            said = F.replace(said, F.lit(mark), F.col(c))
        text = F.when(F.col("kind") == kind, said).otherwise(text)
    rows = joined(edges, chains, ["name", "n"], "left_semi").withColumn("finding", text)
    order = F.row_number().over(Window.partitionBy("name").orderBy("n", "i"))
    return rows.withColumn("_rn", order).where(F.col("_rn") <= most).select("question_id", F.col("_rn").alias("i"), "finding")


def column_edges(defs: DataFrame) -> DataFrame:
    """(name, stage, ordinal, column, expression, leaf_table, leaf_column, leaf_ordinal): see tsql.column_sources."""
    return column_sources(defs).drop("n", "final")


def column_lineage_findings(questions: DataFrame, hits: DataFrame, most: int = 3) -> DataFrame:
    """(question_id, i, finding): paths of the columns of the anchor's last INSERT that a tracing question names, or of its
    first ``most`` ones where it names none. A column without a path is passed over."""
    asked = questions.where(is_tracing(F.col("text"))).select("question_id", F.lower("text").alias("_asked"))
    a = joined(anchors(hits), asked, ["question_id"]).withColumn("name", F.col("question_id").cast("string"))
    edges = checkpointed(column_sources(a.select("name", F.col("text").alias("definition"))))
    filled = edges.where("final").withColumn("_last", F.max("n").over(Window.partitionBy("name"))).where("n = _last").select("name", "stage", "column", "ordinal").distinct()
    word = F.regexp_like("_asked", F.concat(F.lit(r"(?<!\w)\Q"), F.lower("column"), F.lit(r"\E(?!\w)")))
    known = joined(filled, a.select("name", "question_id", "_asked"), ["name"]).withColumn("_named", word)
    per = Window.partitionBy("name")
    rank = F.row_number().over(per.orderBy("ordinal"))
    wanted = known.withColumns({"_any": F.max("_named").over(per), "_rank": rank}).where(F.when(F.col("_any"), F.col("_named")).otherwise(F.col("_rank") <= most))
    found = joined(lineage_paths(edges, wanted), wanted.select("name", "stage", "column", "ordinal", "question_id"), ["name", "stage", "column"])
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("ordinal"))
    return found.select("question_id", order.alias("i"), F.col("path").alias("finding")).where(F.col("i") <= most)


def lineage_paths(edges: DataFrame, wanted: DataFrame, depth: int = 6, longest: int = 70) -> DataFrame:
    """(name, stage, column, path): chains of labels from a column to base tables, for (name, stage, column).

    A chain follows the first leaf that is a stage itself; the other leaves of an expression are listed with it, sorted.
    Chains that meet themselves or don't end within depth are left out. A table of joins, one for each step."""
    low = lambda c: F.lower(F.col(c))
    stages = edges.select("name", low("stage").alias("_s")).distinct().withColumn("is_stage", F.lit(True))
    e = joined(edges.withColumn("_s", low("leaf_table")), stages, ["name", "_s"], "left").withColumn("is_stage", F.coalesce("is_stage", F.lit(False)))
    short = F.when(F.char_length("expression") > longest, F.concat(F.substring("expression", 1, longest - 3), F.lit("..."))).otherwise(F.col("expression"))
    passed = F.lower(F.element_at(F.split("expression", r"\."), -1)) == low("column")
    by = e.groupBy("name", low("stage").alias("k_stage"), low("column").alias("k_column")).agg(
        F.min_by("stage", "leaf_ordinal").alias("stage"), F.min_by("column", "leaf_ordinal").alias("column"), F.min_by(F.when(passed & F.col("expression").rlike(r"^[\w.]+$"), "").otherwise(F.concat(F.lit(" ("), short, F.lit(")"))), "leaf_ordinal").alias("note"),
        F.min_by(F.struct("leaf_table", "leaf_column"), F.when(F.col("is_stage"), F.col("leaf_ordinal"))).alias("next"), F.min(F.when(F.col("is_stage"), F.col("leaf_ordinal"))).alias("at"),
        F.array_sort(F.collect_set(F.struct("leaf_ordinal", "leaf_table", "leaf_column"))).alias("leaves"))
    rest = F.array_sort(F.array_distinct(F.transform(F.filter("leaves", lambda x: F.coalesce(x["leaf_ordinal"] != F.col("at"), F.lit(True))), lambda x: F.concat(F.lit("`"), x["leaf_table"], F.lit("."), x["leaf_column"], F.lit("`")))))
    # each step below joins them again
    steps = by.select("name", "k_stage", "k_column", F.concat(F.lit("`"), "stage", F.lit("."), "column", F.lit("`"), "note").alias("label"), F.when(F.col("at").isNotNull(), F.col("next")).alias("next"), rest.alias("rest"))
    steps = checkpointed(steps)
    live = wanted.select("name", "stage", "column", low("stage").alias("k_stage"), low("column").alias("k_column"), F.array().cast("array<string>").alias("hops"), F.array().cast("array<array<string>>").alias("tails"), F.array().cast("array<string>").alias("seen"))
    out = None
    for _ in range(depth + 1):
        key = F.concat_ws("\x1f", "k_stage", "k_column")
        moved = joined(live.where(~F.array_contains("seen", key)).withColumn("seen", F.concat("seen", F.array(key))), steps, ["name", "k_stage", "k_column"])
        moved = moved.withColumns({"hops": F.concat("hops", F.array("label")), "tails": F.concat("tails", F.array("rest"))}).drop("label", "rest")
        ended = moved.where("next IS NULL").select("name", "stage", "column", "hops", "tails")
        out = ended if out is None else out.unionByName(ended)
        live = checkpointed(moved.where("next IS NOT NULL").withColumns({"k_stage": F.lower("next.leaf_table"), "k_column": F.lower("next.leaf_column")}).drop("next"))
        if live.isEmpty():
            break
    tail = F.transform(F.filter(F.reverse("tails"), lambda x: F.size(x) > 0), lambda x: F.array_join(x, ", "))
    return out.select("name", "stage", "column", F.array_join(F.concat("hops", tail), " ← ").alias("path"))
