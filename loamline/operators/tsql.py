"""T-SQL definitions as rows of tokens, and what running sums over them tell about statements, queries and their parts.

A definition is cut into tokens by one expression. Depths of brackets and of BEGIN and CASE are running sums. A closing
token belongs to the last opening one of its depth, so the bracket or query around a token is the last one opened at its
depth. A query is a statement's own level or a bracket that begins with SELECT; its clauses and select items follow from the
keywords and commas that stand at its own level, so what is inside functions, subqueries or quotes never counts as such.
Places are told by array operations over the tokens of many definitions at once; what follows from them are joins of select
items, of what queries read and of stages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.session import checkpointed

PART = r'(?:\[[^\]]*\]|"[^"]*"|[#@]{0,2}[A-Za-z_][\w$#@]*)'
TOKEN = rf"\s*(?:'(?:[^']|'')*'|{PART}(?:\s*\.\s*(?:{PART}|\*))*|\d+(?:\.\d+)?|<>|<=|>=|!=|\S)"
COMMENT = r"('(?:[^']|'')*')|--[^\n]*|(?s:/\*.*?\*/)"
#: Words that begin a statement, words that part a query, words of the language that name no column or alias.
STARTS = ("select", "insert", "update", "delete", "merge", "truncate", "exec", "execute", "declare", "set", "drop", "create", "alter", "if", "while", "return", "print", "else", "with")
CLAUSES = ("select", "into", "from", "where", "group", "having", "order", "union", "except", "intersect", "insert", "option", "values")
JOINS = ("join", "left", "right", "full", "inner", "outer", "cross", "apply", "on")
RESERVED = (*STARTS, *CLAUSES, *JOINS, "case", "when", "then", "end", "and", "or", "not", "null", "is", "in", "like", "between", "as", "distinct", "top", "percent", "all", "any", "exists", "over", "partition", "by", "asc", "desc", "begin", "go", "for", "rows", "range", "preceding", "following", "unbounded", "current", "row", "escape", "collate", "pivot", "unpivot")
#: Parts of dates and names of types, which look like columns.
UNITS = ("day", "month", "year", "quarter", "week", "hour", "minute", "second", "dd", "mm", "yy", "yyyy", "int", "bigint", "bit", "date", "datetime", "datetime2", "decimal", "numeric", "float", "money", "varchar", "nvarchar", "char", "nchar")


def spread(defs: DataFrame, chars: int = 1 << 18) -> DataFrame:
    """Definitions dealt by name, about ``chars`` characters to a task however many there are. Their tokens stay there: all
    windows over them begin with the name, and a task's tokens can be sorted in memory."""
    total = defs.agg(F.sum(F.char_length("definition"))).first()[0] or 0
    return defs.select("name", "definition").repartition(total // chars + 1, "name")


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join by sorting: what tokens grow to can't be told from the sizes of definitions, so neither side may be
    gathered for a broadcast."""
    return left.join(right.hint("merge"), on, how)


def raw_tokens() -> Column:
    """The tokens of a definition in order, with the white space before each; comments left out."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce("definition", F.lit("")), COMMENT, "$1 "), F.lit(TOKEN), 0)


def tokens(defs: DataFrame) -> DataFrame:
    """(name, i, tok, low, spaced): the tokens of each definition in order, comments left out; a qualified name is one."""
    found = spread(defs).select("name", F.posexplode(raw_tokens()).alias("i", "raw"))
    tok = F.regexp_replace("raw", r"^\s+", "")
    one = F.when(tok.startswith("'"), tok).otherwise(F.regexp_replace(tok, r"\s*\.\s*", "."))
    return found.select("name", "i", one.alias("tok"), F.lower(one).alias("low"), F.col("raw").rlike(r"^\s").alias("spaced"))


class Groups:
    """Running sums and looks back over rows that lie in groups of equal keys, each in the rows' own order."""

    def __init__(self, *keys: np.ndarray):
        n = len(keys[0])
        self.order = np.lexsort(keys[::-1])
        new = np.zeros(n, bool)
        new[:1] = True
        for key in keys:
            own = key[self.order]
            new[1:] |= own[1:] != own[:-1]
        self.group = np.cumsum(new) - 1
        self.start = np.flatnonzero(new)[self.group] if n else np.zeros(0, np.int64)

    def _back(self, ordered: np.ndarray) -> np.ndarray:
        out = np.empty_like(ordered)
        out[self.order] = ordered
        return out

    def summed(self, condition: np.ndarray) -> np.ndarray:
        """How many rows up to each, itself included, meet the condition."""
        own = condition[self.order].astype(np.int64)
        total = np.cumsum(own)
        return self._back(total - (total - own)[self.start])

    def last(self, condition: np.ndarray) -> np.ndarray:
        """The last row up to each, itself included, that meets the condition; -1 if none does."""
        at = np.maximum.accumulate(np.where(condition[self.order], np.arange(len(condition)), -1))
        return self._back(np.where(at >= self.start, self.order[at], -1))

    def first(self, condition: np.ndarray) -> np.ndarray:
        """The first row of each row's whole group that meets the condition; -1 if none does."""
        ordered = condition[self.order]
        hits = np.flatnonzero(ordered)
        out = np.full(self.group[-1] + 1 if len(ordered) else 0, -1)
        out[self.group[hits][::-1]] = self.order[hits[::-1]]
        return self._back(out[self.group])

    def before(self, value: np.ndarray, none: int | bool, k: int = 1) -> np.ndarray:
        """The value k rows before; k < 0: behind."""
        n, at = len(value), np.arange(len(value)) - k
        inside = (at >= 0) & (at < n)
        at = np.clip(at, 0, max(n - 1, 0))
        inside &= self.group[at] == self.group if n else inside
        return self._back(np.where(inside, value[self.order][at], none))


#: A number for each word that places depend on; other words and no word are 0.
WORDS = {w: k for k, w in enumerate(dict.fromkeys((*RESERVED, "(", ")", ",", ";", "=", "tran", "transaction", "distributed", "after", "of")), 1)}
PLACES = "struct<items:array<struct<stmt:bigint,query:int,branch:bigint,item:bigint,alias:string,pieces:array<struct<tok:string,spaced:boolean,prev:string,next:string>>>>,heads:array<struct<stmt:bigint,query:int,branch:bigint,cte:string,outer:int,target:string,insert:boolean>>,reads:array<struct<stmt:bigint,query:int,branch:bigint,j:int,table:string,alias:string,kind:string,prior:string,broken:boolean,reads:bigint,starts:string,target:string>>,listed:array<struct<stmt:bigint,ordinal:bigint,column:string>>>"
NAMED = re.compile(r"[\[\"#@]*[a-z_]")
VALUE = re.compile(r"(?:\)|end|null|[0-9].*|'[^\n\r\u0085\u2028\u2029]*)$")


def places_of(raw: pa.Array) -> pa.Array:
    """Select items, heads of queries, what queries read, and column lists of INSERT, of each definition's tokens (see placed).

    Every step is a running sum or a look back over the tokens of all definitions at once, so the time is in proportion to
    them; distinct tokens are read once."""
    size = np.diff(np.asarray(raw.offsets))
    coded = raw.flatten().dictionary_encode()
    at, found = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    trimmed = [x.lstrip(" \t\n\v\f\r") for x in found]
    toks = [x if x.startswith("'") else re.sub(r"\s*\.\s*", ".", x, flags=re.ASCII) for x in trimmed]
    lows, bares = [x.lower() for x in toks], [re.sub(r'[\[\]"]', "", x) for x in toks]
    tok, lower, bare, end = (pa.array(v, pa.string()) for v in (toks, lows, bares, [x.split(".")[-1] for x in bares]))
    spaced = np.array([x != y for x, y in zip(trimmed, found, strict=True)], bool)[at]
    low = np.array([WORDS.get(x, 0) for x in lows], np.int64)[at]
    names = np.array([NAMED.match(x) is not None and x not in RESERVED for x in lows], bool)[at]
    values = np.array([VALUE.match(x) is not None for x in lows], bool)[at]
    digits = np.array([x[:1] in "0123456789" and x != "" for x in lows], bool)[at]
    n = len(at)
    here, name = np.arange(n), np.repeat(np.arange(len(size)), size)
    i = here - np.repeat(np.cumsum(size) - size, size)
    rows = Groups(name)

    def is_(code: np.ndarray, *words: str) -> np.ndarray:
        return np.isin(code, [WORDS[w] for w in words]) if len(words) > 1 else code == WORDS[words[0]]

    def of(value: np.ndarray, row: np.ndarray, none: int | bool) -> np.ndarray:
        return np.where(row >= 0, value[row], none) if len(value) else np.full(len(row), none)

    def text(strings: pa.Array, row: np.ndarray) -> pa.Array:
        return strings.take(pa.array(at[row] if n else row, mask=row < 0))

    prev, prev2, next_, next2, next3 = (rows.before(low, 0, k) for k in (1, 2, -1, -2, -3))

    def opened(opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """The opening row around each, -1 outside of all; an opening or a closing row has its own pair's. Pairs are matched
        by depth, a running sum, so one look back is enough for any nesting."""
        deep = rows.summed(opens) - rows.summed(rows.before(closes, False))
        return np.where(deep > 0, Groups(name, deep).last(opens), -1)

    depth = rows.summed(is_(low, "(")) - rows.summed(is_(prev, ")"))
    # an END belongs to the last CASE or BEGIN of its depth
    block = of(low, opened(is_(low, "case") | (is_(low, "begin") & ~is_(next_, "tran", "transaction", "distributed")), is_(low, "end")), 0)
    top = depth == 0
    fence = top & (is_(low, ";") | (is_(low, "begin", "end") & is_(block, "begin")))
    # WITH begins a statement where common table expressions follow, not hints or options; ELSE doesn't inside of CASE
    expressions = (is_(next2, "(") | (is_(next2, "as") & is_(next3, "("))) & ~is_(next_, "(")
    start = top & is_(low, *STARTS) & (~is_(low, "with") | expressions) & ~is_(block, "case")
    major = of(low, rows.before(rows.last(fence | (start & ~is_(low, "set"))), -1), WORDS[";"])
    goes_on = (
        (is_(low, "select") & (is_(major, "insert", "with") | is_(prev, "union", "all", "except", "intersect", "as", "for")))
        | (is_(low, "insert", "update", "delete", "merge") & ((is_(major, "with") & is_(prev, ")")) | is_(prev, "then", "for", "after", "of", ",")))
        | (is_(low, "set") & is_(major, "update", "merge"))
    )
    stmt = rows.summed(fence | (start & ~goes_on))
    whole = Groups(name, stmt)
    starts = whole.first(~is_(low, ";"))
    # brackets that are queries, and those of common table expressions
    is_query = is_(low, "(") & is_(next_, "select", "with")
    named = is_(low, "(") & is_(prev, "as") & is_(of(low, starts, 0), "with") & (depth == 1) & (i >= 2)
    query_end = is_(low, ")") & of(is_query, opened(is_(low, "("), is_(low, ")")), False)
    inner = opened(is_query, query_end)
    inside = of(i, inner, 0)
    # a query's own brackets stand at the level around it, which is that of the token before them
    edge = is_query | query_end
    query = np.where(edge, of(rows.before(inside, 0), inner, 0), inside)
    own = edge | (depth == of(depth, inner, 0))
    first = rows.last(is_(low, "(") & (depth == 1))
    cte = np.where((depth > 0) & of(named, first, False), first - 2, -1)
    # which SELECT of its query a token follows, the last word at the query's own level, and the select item's number
    branch = Groups(name, stmt, query).summed(own & is_(low, "select"))
    level = Groups(name, stmt, query, branch)
    clause = level.last(own & is_(low, *CLAUSES) & ~edge)
    said = of(low, clause, 0)
    selected = is_(said, "select")
    item = level.summed(own & is_(low, ",") & selected)
    # the table that SELECT INTO makes, or that INSERT fills, of each token's statement
    outside = (query == 0) & own & (cte < 0)
    inserts = outside & ((is_(prev, "into") & is_(prev2, "insert")) | (is_(prev, "insert") & ~is_(low, "into")))
    makes = outside & is_(prev, "into") & is_(said, "into") & ~is_(prev2, "insert", "merge")
    into = whole.first(inserts | makes)
    target, insert = text(bare, into), of(inserts, into, False)

    def by_definition(at_rows: np.ndarray, **columns: pa.Array) -> pa.Array:
        ends = np.append(0, np.cumsum(np.bincount(name[at_rows], minlength=len(size)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    def where(at_rows: np.ndarray) -> dict[str, pa.Array]:
        return {"stmt": pa.array(stmt[at_rows]), "query": pa.array(query[at_rows], pa.int32()), "branch": pa.array(branch[at_rows])}

    # heads: the SELECT of each branch, with the outermost query of its common table expression
    at_ = np.flatnonzero(selected & is_(low, "select") & own)
    known = {x: k for k, x in enumerate(toks)}
    expression = of(np.array([known[x] for x in toks], np.int64)[at], cte[at_], -1)
    outer = query[at_].copy()
    for_each = Groups(name[at_], stmt[at_], expression)
    if len(at_):
        outer[for_each.order] = np.minimum.reduceat(outer[for_each.order], np.unique(for_each.start))[for_each.group]
    heads = by_definition(at_, **where(at_), cte=text(tok, cte[at_]), outer=pa.array(outer, pa.int32()), target=target.take(pa.array(at_)), insert=pa.array(insert[at_]))

    # column lists behind the table of an INSERT, up to the first closing bracket
    at_ = np.flatnonzero((query == 0) & (cte < 0) & insert & (i > of(i, into, 0)))
    in_stmt = Groups(name[at_], stmt[at_])
    open_ = of(is_(low[at_], "("), in_stmt.first(np.ones(len(at_), bool)), False)
    at_ = at_[open_ & (in_stmt.summed(is_(low[at_], ")")) == 0) & ~is_(low[at_], "(", ",")]
    ordinal = Groups(name[at_], stmt[at_]).summed(np.ones(len(at_), bool)) - 1
    listed = by_definition(at_, stmt=pa.array(stmt[at_]), ordinal=pa.array(ordinal), column=text(bare, at_))

    # what each query reads: what follows FROM, JOIN, APPLY and commas; a derived table is its two brackets at this level
    at_ = np.flatnonzero(is_(said, "from") & own)
    level = Groups(*(x[at_] for x in (name, stmt, query, branch)))
    p1, p2, p3, n1, n2, n3 = (of(at_, level.before(np.arange(len(at_)), -1, k), -1) for k in (1, 2, 3, -1, -2, -3))
    refs = is_(of(low, p1, 0), "from", "join", "apply", ",")
    at_, p1, p2, p3, n1, n2, n3 = (x[refs] for x in (at_, p1, p2, p3, n1, n2, n3))
    derived, function = is_(low[at_], "("), is_(next_[at_], "(")
    # after the name; after a derived table's second bracket
    a1, a2 = np.where(derived, n2, n1), np.where(derived, n3, n2)
    alias = np.where(is_(of(low, a1, 0), "as"), a2, np.where(of(names, a1, False) & ~function, a1, -1))
    table = np.where(~derived & ~function & names[at_], at_, -1)
    side = of(low, p2, 0)
    kinds = pa.array([x.upper() for x in lows] + ["INNER", "APPLY"], pa.string())
    side = np.where(is_(side, "left", "right", "full", "inner", "cross"), of(at, p2, -1), np.where(is_(side, "outer"), of(at, p3, -1), len(lows)))
    joins, applies = is_(of(low, p1, 0), "join"), is_(of(low, p1, 0), "apply")
    kind = np.where(joins, side, np.where(applies, len(lows) + 1, -1))
    of_branch = Groups(*(x[at_] for x in (name, stmt, query, branch)))
    every = np.ones(len(at_), bool)
    crossed = joins & (side >= 0) & np.isin(side, [k for k, x in enumerate(lows) if x == "cross"])
    broken = of_branch.summed((table < 0) | crossed | applies | is_(of(low, p1, 0), ",")) > 0
    counted = np.bincount(of_branch.group, minlength=1)[of_branch.group] if len(at_) else np.zeros(0, np.int64)
    total = np.empty_like(counted)
    total[of_branch.order] = counted
    reads = by_definition(
        at_, **where(at_), j=pa.array(of_branch.summed(every) - 1, pa.int32()), table=text(bare, table), alias=pc.coalesce(text(bare, alias), text(end, table)), kind=kinds.take(pa.array(kind, mask=kind < 0)),
        prior=text(bare, of_branch.before(table, -1)), broken=pa.array(broken), reads=pa.array(total), starts=text(lower, starts[at_]), target=target.take(pa.array(at_)),
    )

    # select items without what leads in to the first one, DISTINCT and TOP, and without their aliases
    lead_in = (is_(low, "distinct", "all") & is_(prev, "select")) | (is_(low, "top") & is_(prev, "select", "distinct")) | (is_(prev, "top") & digits)
    at_ = np.flatnonzero(selected & ~is_(low, "select") & (~is_(low, ",") | ~own) & ~lead_in)
    keys = (name, stmt, query, branch, item)
    each = Groups(*(x[at_] for x in keys))
    # TOP (n) is a bracket right behind TOP: its last one in the item
    top_ = np.full(len(at_), -1)
    np.maximum.at(top_, each.group, np.where(is_(prev[at_], "top") & is_(low[at_], "("), i[at_], -1)[each.order])
    behind = np.empty_like(top_)
    behind[each.order] = top_[each.group]
    at_ = at_[(behind < 0) | (i[at_] > behind + 2)]
    each, every = Groups(*(x[at_] for x in keys)), np.ones(len(at_), bool)
    k = each.summed(every)
    after, back = (of(at_, each.before(np.arange(len(at_)), -1, d), -1) for d in (-1, 1))
    ends = after < 0
    is_as = ends & is_(of(low, back, 0), "as")
    named = ends & own[at_] & names[at_] & (is_as | ((of(values, back, False) | of(names, back, False)) & (k > 1)))
    equal = (k == 1) & is_(of(low, after, 0), "=") & names[at_]
    with_equal, with_as, with_name, last = (each.first(x) for x in (equal, is_as, named, ends))
    n_ = of(k, last, 0)
    kept = np.where(with_equal >= 0, k > 2, np.where(with_as >= 0, k <= n_ - 2, np.where(with_name >= 0, k < n_, True)))
    alias = of(at_, np.where(with_equal >= 0, with_equal, with_name), -1)
    at_, alias = at_[kept], alias[kept]
    each = Groups(*(x[at_] for x in keys))
    at_, alias = at_[each.order], alias[each.order]
    beside = [np.where(rows.before(np.ones(n, bool), False, d), here - d, -1)[at_] for d in (1, -1)]
    piece = pa.StructArray.from_arrays([text(tok, at_), pa.array(spaced[at_]), *(text(lower, x).fill_null("") for x in beside)], ["tok", "spaced", "prev", "next"])
    heads_at = np.unique(each.start)
    pieces = pa.ListArray.from_arrays(pa.array(np.append(heads_at, len(at_)).astype(np.int32)), piece)
    at_, alias = at_[heads_at], alias[heads_at]
    items = by_definition(at_, **where(at_), item=pa.array(item[at_]), alias=text(bare, alias), pieces=pieces)
    return pa.StructArray.from_arrays([items, heads, reads, listed], ["items", "heads", "reads", "listed"])


def placed(defs: DataFrame) -> DataFrame:
    """A row for each definition: name, and what its queries are made of. All has stmt (a statement's number) and most has query
    (the bracket, by its place, of a query; 0: the statement's own) and branch (which SELECT of the query, from 1).

    items: item (number), alias and pieces, the tokens of its expression with those beside them. heads: the SELECT of each
    branch, with cte (the name of the common table expression around it), outer (that one's outermost query), target (what
    the statement fills or makes) and insert. reads: in order j, table (null for a derived table or a function), alias, kind of
    join (INNER, LEFT, RIGHT, FULL, CROSS, APPLY, or null), prior (the table before), broken (whether a chain of joins has
    ended up to here), reads (how many the branch has), starts (the statement's first word) and target. listed: the column
    list behind the table of an INSERT."""
    # not to be made again for each use of it in a plan
    once = F.arrow_udf(places_of, PLACES).asNondeterministic()
    return spread(defs, 1 << 20).select("name", once(raw_tokens()).alias("p"))


def is_name(low: Column) -> Column:
    return low.rlike(r"^[\[\"#@]*[a-z_]") & ~low.isin(*RESERVED)


def unquoted(name: Column) -> Column:
    return F.regexp_replace(name, r'[\[\]"]', "")


def join_chains(defs: DataFrame) -> DataFrame:
    """(name, n, i, prior, joined, kind, target): a row for each join at a statement's own level, prior being the table
    before it in the text. Statements with common table expressions are left out; a comma, a derived table, a function, APPLY
    and CROSS JOIN end a chain. Subqueries, of EXISTS and others, are not looked into."""
    own = placed(defs).select("name", F.inline("p.reads")).where("query = 0 AND branch > 0 AND starts <> 'with'")
    good = own.where("NOT broken AND j > 0")
    return good.select("name", F.col("stmt").alias("n"), (F.col("j") - 1).alias("i"), "prior", F.col("table").alias("joined"), "kind", F.coalesce("target", "name").alias("target"), "branch")


def written(pieces: Column) -> Column:
    """The expression that tokens make, as in the text with single spaces."""
    text = F.array_join(F.transform(pieces, lambda p: F.concat(F.when(p["spaced"], " ").otherwise(""), p["tok"])), "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), r"\( ", "("), r" \)", ")")


def column_sources(defs: DataFrame) -> DataFrame:
    """(name, stage, ordinal, column, expression, leaf_table, leaf_column, leaf_ordinal): for each output column of SELECT
    INTO, of a common table expression (nested ones too) and of INSERT ... SELECT, the columns that it is made of.

    Each branch of a UNION has rows of its own, under the first one's column names. A column without a qualifier counts
    where its query reads one table only; what derived tables, functions or outer queries give is left out, as are columns
    inside subqueries."""
    # what follows reads it several times
    rows = checkpointed(placed(defs))
    listed = rows.select("name", F.inline("p.listed"))
    # a stage is a statement's own query that fills something, or the bracket of a common table expression
    heads = rows.select("name", F.inline("p.heads"))
    stage = F.when(F.col("cte").isNotNull(), F.when(F.col("query") == F.col("outer"), unquoted(F.col("cte")))).when(F.col("query") == 0, F.col("target"))
    stages = heads.select("name", "stmt", "query", "branch", stage.alias("stage"), (F.col("insert") & F.col("cte").isNull()).alias("insert")).where("stage IS NOT NULL")
    by = ["name", "stmt", "query", "branch", "item"]
    items = rows.select("name", F.inline("p.items"))
    # subqueries' tokens have queries of their own: they are not among an item's pieces
    only = F.col("pieces")[0]["tok"]
    names = F.coalesce("alias", F.when((F.size("pieces") == 1) & is_name(F.lower(only)), F.element_at(F.split(unquoted(only), r"\."), -1)))
    cols = items.select(*by, written(F.col("pieces")).alias("expression"), names.alias("own_name"))
    cols = joined(cols, stages, ["name", "stmt", "query", "branch"])
    cols = joined(cols, listed.withColumnsRenamed({"ordinal": "item", "column": "listed"}), ["name", "stmt", "item"], "left")
    one = Window.partitionBy("name", "stmt", "query", "item").orderBy("branch")
    cols = cols.withColumn("column", F.coalesce(F.when(F.col("insert"), F.col("listed")), F.first("own_name").over(one))).where("column IS NOT NULL")

    def is_leaf(x: Column) -> Column:
        low = F.lower(x["tok"])
        return is_name(low) & (x["next"] != "(") & ~low.isin(*UNITS) & ~low.startswith("@") & ~low.endswith("*") & (x["prev"] != "as")

    leaves = items.select(*by, F.posexplode(F.transform(F.filter("pieces", is_leaf), lambda x: F.split(unquoted(x["tok"]), r"\."))).alias("leaf_ordinal", "parts"))
    leaves = leaves.select(*by, "leaf_ordinal", F.element_at("parts", -1).alias("leaf_column"), F.when(F.size("parts") > 1, F.lower(F.element_at("parts", -2))).alias("_q"))
    reads = rows.select("name", F.inline("p.reads")).where("table IS NOT NULL").select("name", "stmt", "query", "branch", "table", F.lower("alias").alias("_alias"), F.col("reads").alias("_reads"))
    found = joined(leaves, reads, ["name", "stmt", "query", "branch"]).where("_q IS NULL AND _reads = 1 OR _q = _alias")
    over = F.row_number().over(Window.partitionBy("name", "stmt", "query", "item").orderBy("branch", "leaf_ordinal")) - 1
    every = joined(found, cols, by).withColumn("_leaf", over)
    return every.select("name", F.col("stmt").alias("n"), "stage", F.col("item").cast("int").alias("ordinal"), "column", "expression", F.col("table").alias("leaf_table"), "leaf_column", F.col("_leaf").cast("int").alias("leaf_ordinal"), F.col("insert").alias("final"))
