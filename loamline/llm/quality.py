"""Quality rules as a ledger of failure bits, with DataFrame functions only.

``ledger`` evaluates every rule once and keeps, beside the measurements, one number with a bit for each rule that fails.
Versioned policies are masks over those bits, so a new policy, or the question what a policy would do without one of its
rules, needs no second look at the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import text_of

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Rules by bit: a name, and when a row fails it.
RULES: list[tuple[str, Callable[[], Column]]] = [
    ("few_words", lambda: F.col("n_words") < 20),
    ("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    ("symbol_heavy", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    ("shouting", lambda: 2 * F.col("n_upper") > F.col("n_letters")),
    ("duplicate_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: The policies; a version never changes once it is in use.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbol_heavy", "shouting", "duplicate_lines"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once however often body uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows that are found twice or more. Windows are compared by 64-bit hashes inside one
    text; only a text that has an equal pair sorts them."""

    def cover(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        like = lambda e, k: F.coalesce(F.get(ordered, k)["h"] == e["h"], F.lit(False))
        marked = F.transform(ordered, lambda e, k: F.when(like(e, k - 1) | like(e, k + 1), e["i"]))
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    hashes = F.when(F.size(words) >= window, F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))).otherwise(F.array().cast("array<bigint>"))
    ordered = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered(h), lambda s: let(places(s), cover))))


def measures(text: Column) -> Column:
    """All measurements of a text as one struct of longs."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeat")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    only = lambda kind: F.char_length(F.regexp_replace(text, kind, ""))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), only(r"[^#*$%&|<>]+").alias("symbols"), only(r"[^\p{L}]+").alias("letters"), only(r"[^\p{Lu}]+").alias("upper"))


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, the measurements (see MEASURES) as longs, failed, the bits of the rules it fails, and
    the columns to carry.

    Words part at white space; null is a text without words. word_chars: code points in words. n_symbols: characters of
    #*$%&|<>. n_lines: lines that hold a word; n_dup_lines: those equal to an earlier one. n_repeat_words: words in
    windows of 8 that are found twice or more in the text. n_letters, n_upper: letters, and capital ones. Repeated rows,
    null ids and further columns of any name change nothing; an empty table gives an empty result.
    """
    carry = carry or []
    rows = docs.select(F.col(id_column).alias("doc_id"), measures(text_of(text_column)).alias("m"), *carry)
    names = [c for c in rows.columns if c not in ("doc_id", "m")]
    named = {"n_words": "w.n", "word_chars": "w.chars", "n_symbols": "symbols", "n_dup_lines": "l.dup", "n_repeat_words": "w.repeat", "n_lines": "l.n", "n_letters": "letters", "n_upper": "upper"}
    measured = rows.select("doc_id", *(F.col(f"m.{named[c]}").cast("bigint").alias(c) for c in MEASURES), *names)
    bits = [F.when(fails(), F.lit(BIT[name])).otherwise(F.lit(0)) for name, fails in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed.cast("bigint"))


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with kept: whether a row fails none of the policy's rules."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rule, n_failed (rows that fail it) and n_only (rows that it alone rejects).

    Rows are first counted by their bits, which are as many as there are rules at most to the power of two."""
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).count()
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("bigint").alias("bit")) for name in POLICIES[policy])))
    each = counts.select("bits", "count", rules.alias("r")).select("bits", "count", "r.*")
    failing = F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)
    alone = F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)
    return each.groupBy("rule").agg(F.sum(failing).cast("bigint").alias("n_failed"), F.sum(alone).cast("bigint").alias("n_only"))


def kept_rows(docs: DataFrame, policy: str = "web-1", text_column: str = "text") -> DataFrame:
    """The rows that a policy keeps, with their own columns."""
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    return apply_policy(ledger(docs, docs.columns[0], text_column, [whole]), policy).where("kept").select("row.*")


def quality(docs: DataFrame, policy: str = "web-1", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The ledger's rows with base_failed and kept under a policy; see ledger for the edge cases."""
    rows = ledger(docs, id_column, text_column)
    base = F.col("failed").bitwiseAND(F.lit(mask("base-1"))) != 0
    return apply_policy(rows, policy).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failed")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n - lines.d, 0)::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0)::BIGINT AS n_lines,
        length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper
    FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_upper > n_letters THEN 8 ELSE 0 END
        + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
