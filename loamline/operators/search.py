"""Access-scoped hybrid retrieval for batches of questions.

A ``queries`` table (query_id, user_id, text, embedding, language) is answered in one job. Ties in every ranking end with
the key columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.stemming import STOP_WORDS, stem
from loamline.functions.text import cosine, tokens
from loamline.session import checkpointed

KEY = ["resource_id", "chunk_index"]
#: Weights of a match in the title and in the text, and the constant of reciprocal-rank fusion.
TITLE_WEIGHT, TEXT_WEIGHT, RRF_K = 1.0, 0.4, 60


def query_scopes(queries: DataFrame, grants: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """(query_id, source, scope): what each question's user may see of the selected sources."""
    allowed = grants if sources is None else grants.where(F.col("source").isin(*sources))
    return queries.select("query_id", "user_id").join(allowed.select("user_id", "source", "scope"), "user_id").select("query_id", "source", "scope").distinct()


def scope_filter_all(chunks: DataFrame, scopes: DataFrame) -> DataFrame:
    """Chunks in any of the scopes."""
    return chunks.join(scopes.select("source", "scope"), ["source", "scope"], "left_semi")


def scope_filter_source(chunks: DataFrame, scopes: DataFrame, source: str) -> DataFrame:
    return scope_filter_all(chunks.where(F.col("source") == source), scopes.where(F.col("source") == source))


def row_policy(df: DataFrame, grants: DataFrame, user: str | None) -> DataFrame:
    """Rows that a grant of the user covers; nothing without a user."""
    if not user:
        return df.where(F.lit(False))
    return df.join(grants.where(F.col("user_id") == user).select("source", "scope"), ["source", "scope"], "left_semi")


def scopes_revalidated(scopes: DataFrame, verdicts: DataFrame, as_of: str) -> DataFrame:
    """Scopes that a verdict (source, scope, allowed, expires_at) confirms and that hasn't expired; no verdict denies."""
    good = verdicts.where(F.col("allowed") & (F.col("expires_at") > F.to_timestamp(F.lit(as_of))))
    return scopes.join(good.select("source", "scope"), ["source", "scope"], "left_semi")


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def matrix_of(values: pa.Array) -> np.ndarray:
    """Vectors as the rows of a matrix."""
    sizes = np.diff(np.asarray(values.offsets))
    x = np.zeros((len(sizes), int(sizes.max(initial=0))))
    flat = np.asarray(values.flatten(), np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    x[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return x


def unit_rows(values: pa.Array) -> np.ndarray:
    """The same, each of length 1; those of no length become rows of nan."""
    x = matrix_of(values)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of all rows of both, summed component by component, so that equal vectors have equal scores in any block;
    nan for vectors of no length, which no floor lets through."""
    dot, length_q, length_x = np.zeros((len(q), len(x))), np.zeros(len(q)), np.zeros(len(x))
    for a, b in zip(q.T, x.T, strict=True):
        dot += np.multiply.outer(a, b)
        length_q += a * a
        length_x += b * b
    with np.errstate(invalid="ignore", divide="ignore"):
        return dot / np.multiply.outer(np.sqrt(length_q), np.sqrt(length_x))


def best_of_blocks(k: int, floor: float):
    """Of packs of questions and blocks of chunks of one source: each question's k best in the block."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                asked, block = b["asked"][i].values, b["block"][i].values
                q, x = matrix_of(asked.field("embedding")), matrix_of(block.field("embedding"))
                width = max(q.shape[1], x.shape[1])
                q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
                score = cosines(q, x)
                row, col = np.nonzero(score >= floor)
                keys = pc.rank(block.field("key"), sort_keys="ascending").to_numpy()
                order = np.lexsort((keys[col], -score[row, col], row))
                row, col = row[order], col[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[first], col[first]
                source = pa.repeat(b["source"][i], len(row))
                yield pa.RecordBatch.from_arrays([asked.field("query_id").take(pa.array(row)), source, *(block.field(c).take(pa.array(col)) for c in KEY), pa.array(score[row, col])], names=["query_id", "source", *KEY, "score"])

    return f


def blocked(df: DataFrame, by: list[str], rows: list[Column], name: str, most: int) -> DataFrame:
    """Rows gathered by these columns, about most in each row of the result, however many there are of one kind."""
    sizes = df.groupBy(*by).agg(F.ceil(F.count("*") / most).alias("_parts"))
    dealt = df.join(sizes, by).withColumn("_part", F.pmod(F.xxhash64(*rows), F.col("_parts")))
    return dealt.groupBy(*by, "_part").agg(F.collect_list(F.struct(*rows)).alias(name)).drop("_part")


def ranked_key() -> Column:
    """The key as a string in the key's order."""
    return F.concat_ws("\x1f", "resource_id", F.lpad(F.col("chunk_index").cast("string"), 12, "0")).alias("key")


def scored(asked: DataFrame, chunks: DataFrame, by: list[str], k: int, floor: float, key: Column | None = None) -> DataFrame:
    """The k best chunks of each question (query_id, embedding) and source, among those with equal columns by. key: a string
    in whose order equal scores stand; that of resource and chunk if None."""
    kinds = dict(asked.dtypes) | dict(chunks.dtypes)
    blocks = blocked(chunks, by, [ranked_key() if key is None else key.alias("key"), *map(F.col, KEY), F.col("embedding")], "block", 1024)
    packs = blocked(asked, by, [F.col("query_id"), F.col("embedding")], "asked", 128)
    pairs = packs.join(blocks, by).select("source", "asked", "block")
    shape = f"query_id {kinds['query_id']}, source string, resource_id {kinds['resource_id']}, chunk_index {kinds['chunk_index']}, score double"
    return top(pairs.mapInArrow(best_of_blocks(k, floor), shape), ["query_id", "source"], [F.desc("score"), *map(F.asc, KEY)], k)


def vector_topk(queries: DataFrame, chunks: DataFrame, scopes: DataFrame, k: int = 16, floor: float = 0.10) -> DataFrame:
    """Per question and source, the k chunks in scope of highest cosine, none under the floor. Null vectors and those of no
    length take no part. Questions and chunks meet in blocks, as products of matrices; a scope of any size is many blocks."""
    asked = queries.where("embedding IS NOT NULL").select("query_id", "embedding").join(scopes, "query_id")
    return scored(asked, chunks.where("embedding IS NOT NULL").select("source", "scope", *KEY, "embedding"), ["source", "scope"], k, floor)


def tokenize(df: DataFrame, language: str = "simple", text: str = "text", field: str = "B", keep: list[str] | None = None) -> DataFrame:
    """Postings: the columns to keep, token, field, pos. simple: verbatim in lower case; english: stop words go, stems stay."""
    out = df.select(*(keep or ["source", "scope", *KEY]), F.posexplode(tokens(F.col(text))).alias("pos", "token"))
    if language == "english":
        out = out.where(~F.col("token").isin(*STOP_WORDS)).withColumn("token", stem(F.col("token")))
    return out.withColumn("field", F.lit(field))


def dealt_postings(chunks: DataFrame, language: str = "simple", tokens_of: DataFrame | None = None) -> DataFrame:
    """postings with the column _deal, a number of the chunk by which they lie in tasks."""
    kept = ["_deal", "source", "scope", *KEY, "shift"]
    # chunks are dealt as texts, some MB to a task, and their words are gathered where they are: none of them is moved. They
    # are dealt by a column of its own, as a part of the key that is one value for all would not count as dealt by
    size = chunks.agg(F.sum(F.char_length("text"))).first()[0] or 0
    dealt = chunks.withColumns({"shift": F.size(tokens(F.col("title"))), "_deal": F.xxhash64(*KEY)}).select(*kept, "title", "text").repartition(size // (1 << 22) + 1, "_deal")
    marked = lambda text, field: F.transform(tokens(F.col(text)), lambda w, i: F.struct(w.alias("token"), F.lit(field).alias("field"), i.alias("pos")))
    every = dealt.select(*kept, F.explode(F.concat(marked("title", "A"), marked("text", "B"))).alias("x")).select(*kept, "x.*")
    if language == "english":
        every = every.where(~F.col("token").isin(*STOP_WORDS)).withColumn("token", stem(F.col("token")))
    if tokens_of is not None:
        every = every.join(tokens_of.select(F.explode("tokens").alias("token")).where("token IS NOT NULL").distinct(), "token", "left_semi")
    places = lambda field: F.array_sort(F.collect_list(F.when(F.col("field") == field, F.col("pos"))))
    return every.groupBy(*kept, "token").agg(places("A").alias("a"), places("B").alias("b"))


def postings(chunks: DataFrame, language: str = "simple", tokens_of: DataFrame | None = None) -> DataFrame:
    """The inverted index: a row for each chunk and token, with the token's places in the title (a) and in the text (b), and
    how many words the title has (shift).

    It is meant to be stored, by token (see keywords.py), and used for many questions. tokens_of: terms (see parse_search) whose tokens are
    all that is wanted; then nothing else is gathered."""
    return dealt_postings(chunks, language, tokens_of).drop("_deal")


def parse_search(queries: DataFrame, language: str = "simple") -> DataFrame:
    """(query_id, branch, term, negated, tokens): quoted phrases, OR between branches, a leading minus; else all terms.
    Stop words of a phrase leave their places empty (null)."""
    found = F.regexp_extract_all("text", F.lit(r'(-?"[^"]*"|\S+)'), 1)
    items = queries.select("query_id", F.posexplode(F.coalesce(found, F.array())).alias("term", "raw"))
    branch = F.sum(F.when(F.lower("raw") == "or", 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("term"))
    rows = items.withColumn("branch", branch).where(F.lower("raw") != "or")
    words = tokens(F.col("raw"))
    if language == "english":
        words = F.transform(words, lambda w: F.when(~w.isin(*STOP_WORDS), stem(w)))
    return rows.select("query_id", "branch", "term", F.startswith("raw", F.lit("-")).alias("negated"), words.alias("tokens")).where(F.exists("tokens", lambda w: w.isNotNull()))


def small(rows: DataFrame, most: int = 1 << 18) -> DataFrame:
    """Checkpointed rows, to be broadcast in a join if they are so few: what they meet is then read where it lies, and not
    shuffled. More rows are joined by sorting."""
    return rows.hint("broadcast" if rows.count() <= most else "merge")


def keyword_match(terms: DataFrame, index: DataFrame, scopes: DataFrame) -> DataFrame:
    """(query_id, source, key, n_a, n_b, span, terms): chunks in scope that satisfy a branch, with occurrences of its terms,
    and the places where each term of its satisfied branches begins.

    A branch looks up its rarest token first, in its question's scopes; those chunks are asked for its other tokens by chunk
    and token, and only where all are there are places compared. So no common token is ever looked up for its own sake."""
    at, chunk = ["query_id", "branch"], ["source", *KEY]
    parts = terms.select(*at, "term", "negated", F.size(F.filter("tokens", lambda w: w.isNotNull())).alias("n_tokens"), F.posexplode("tokens").alias("i", "token")).where("token IS NOT NULL")
    wanted = parts.where("NOT negated").select(*at, "token").distinct()
    counted = wanted.join(index.groupBy("token").agg(F.count("*").alias("n")), "token", "left")
    rarest = counted.groupBy(*at).agg(F.count("*").alias("needed"), F.count("n").alias("known"), F.min_by("token", F.struct("n", "token")).alias("token")).where("known = needed")
    asked = checkpointed(rarest.join(scopes, "query_id"))
    first = index.select("source", "scope", *KEY, "token").join(small(asked), ["source", "scope", "token"])
    there = first.select(*at, "needed", *chunk).join(wanted, at).join(index.select(*KEY, "token"), [*KEY, "token"])
    full = there.groupBy(*at, "needed", *chunk).agg(F.count("*").alias("have")).where("have = needed").select(*at, *chunk)
    # few chunks are left, and only their places are read
    full = checkpointed(full.join(parts, at))
    places = index.select(*KEY, "token", "shift", "a", "b").join(small(full), [*KEY, "token"])
    by_term = places.groupBy(*at, *chunk, "term", "negated", "n_tokens").agg(F.collect_list(F.struct("i", "a", "b")).alias("p"), F.min("shift").alias("shift"), (F.max("i") + 1).alias("length"))

    def starts(field: str) -> Column:
        """Where all tokens of a term stand in a row."""
        own = F.transform("p", lambda x: F.transform(x[field], lambda pos: pos - x["i"]))
        met = F.aggregate(F.slice(own, 2, F.size(own)), F.get(own, F.lit(0)), F.array_intersect)
        return F.when(F.size("p") == F.col("n_tokens"), met).otherwise(F.array().cast("array<int>"))

    met = by_term.select(*at, *chunk, "term", "negated", "shift", "length", starts("a").alias("a"), starts("b").alias("b")).withColumn("ok", F.size("a") + F.size("b") > 0)
    good = F.col("ok") & ~F.col("negated")
    sums = met.groupBy(*at, *chunk).agg(F.count_if(good).alias("have"), F.count_if(F.col("ok") & F.col("negated")).alias("bad"), F.sum(F.when(good, F.size("a"))).alias("n_a"), F.sum(F.when(good, F.size("b"))).alias("n_b"), (F.max(F.when(good, F.array_max("b"))) - F.min(F.when(good, F.array_min("b")))).alias("span"), F.collect_list(F.when(good, F.struct("branch", "term", "length", "shift", "a", "b"))).alias("terms"))
    needed = terms.where("NOT negated").groupBy(*at).agg(F.count("*").alias("needed"))
    whole = sums.join(needed, at).where("have = needed AND bad = 0")
    return whole.groupBy("query_id", *chunk).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.min("span").alias("span"), F.array_sort(F.flatten(F.collect_list("terms"))).alias("terms"))


def rrf(vector: DataFrame, keyword: DataFrame, k: int = RRF_K) -> DataFrame:
    """Both lists ranked anew per question and fused by the sum of 1 / (k + rank); the vector's row is the one that stays."""
    order = [F.desc("score"), *map(F.asc, KEY)]
    legs = [df.select("query_id", "source", *KEY, "score", F.lit(leg).alias("leg"), F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("place")) for leg, df in ((0, vector), (1, keyword))]
    both = legs[0].unionByName(legs[1])
    fused = both.groupBy("query_id", "source", *KEY).agg(F.sum(1.0 / (k + F.col("place"))).alias("rrf"), F.min_by("score", "leg").alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), *map(F.asc, KEY))))


def source_quota(ranked: DataFrame, top_k: int = 8, cap: int = 4) -> DataFrame:
    """At most cap rows of a source among the top_k, filled up from the overflow in order; off if cap >= top_k."""
    flagged = ranked if cap >= top_k else ranked.withColumn("_over", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank")) > cap)
    order = ["rank"] if cap >= top_k else ["_over", "rank"]
    return flagged.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= top_k).drop("_over")


def merge_hit_metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns folded into the bag without overwriting its keys; the title falls back to the object's name."""
    extra = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("string") for c in columns))), lambda _, v: v.isNotNull())
    bag = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(bag, F.map_filter(extra, lambda key, _: ~F.map_contains_key(bag, key)))
    return df.withColumn("metadata", merged).withColumn("title", F.coalesce("title", F.try_element_at("metadata", F.lit("object_name"))))


def best_per_resource(hits: DataFrame) -> DataFrame:
    return top(hits, ["query_id", "resource_id"], [F.desc("score"), F.asc("chunk_index")], 1, "_rn").drop("_rn")


def pool_subqueries(hits: DataFrame, subqueries: DataFrame) -> DataFrame:
    """Hits of sub-queries (query_id, question_id) pooled by question: the greatest score of each chunk, in order."""
    own = hits.join(subqueries.select("query_id", "question_id"), "query_id")
    best = own.groupBy("question_id", "source", *KEY).agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), *map(F.asc, KEY))))


def subqueries_of(questions: DataFrame, rewritten: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(question_id, query_id, text): rewritten questions, blanks dropped, at most three; else the question itself."""
    if rewritten is None:
        return questions.select("question_id", F.concat(F.col("question_id").cast("string"), F.lit("/0")).alias("query_id"), "text")
    parts = rewritten.where(F.trim("text") != "").withColumn("i", F.row_number().over(Window.partitionBy("question_id").orderBy("ordinal"))).where(F.col("i") <= most)
    missing = questions.join(parts, "question_id", "left_anti").select("question_id", F.lit(1).alias("i"), "text")
    return parts.select("question_id", "i", "text").unionByName(missing).select("question_id", F.concat(F.col("question_id").cast("string"), F.lit("/"), (F.col("i") - 1).cast("string")).alias("query_id"), "text")


def token_overlap(question: Column, text: Column) -> Column:
    """The share of a question's tokens that a text has: a stand-in for a model's score."""
    q, t = F.array_distinct(tokens(question)), F.array_distinct(tokens(text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def rerank(hits: DataFrame, top_n: int = 8, model: Callable[[Column, Column], Column] | None = None, enabled: bool = True, order: str = "rank") -> DataFrame:
    """Hits (with question and text) scored anew and cut. A model gives a logit, which becomes a probability. Where it is not
    enabled, or gives null for any hit of a question, that question's hits stay in their order, by the column order."""
    if not enabled:
        kept = hits.withColumn("rerank_score", F.lit(None).cast("double"))
        return top(kept, ["query_id"], [F.asc(order), *map(F.asc, KEY)], top_n, "place")
    score = F.lit(1.0) / (1.0 + F.exp(-model(F.col("question"), F.col("text")))) if model else token_overlap(F.col("question"), F.col("text"))
    scored_ = hits.withColumn("rerank_score", score)
    if model is None or order not in hits.columns:
        return top(scored_, ["query_id"], [F.desc("rerank_score"), *map(F.asc, KEY)], top_n, "place")
    failed = F.max(F.col("rerank_score").isNull()).over(Window.partitionBy("query_id"))
    whole = scored_.withColumn("_failed", failed).withColumn("rerank_score", F.when(~F.col("_failed"), F.col("rerank_score")))
    return top(whole, ["query_id"], [F.asc(F.when(F.col("_failed"), F.col(order))), F.desc("rerank_score"), *map(F.asc, KEY)], top_n, "place").drop("_failed")


def confidence_gate(queries: DataFrame, hits: DataFrame, floor: float = 0.3) -> DataFrame:
    """(query_id, status): no_hits, low_confidence or ok."""
    best = hits.groupBy("query_id").agg(F.max("rerank_score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.when(F.col("best").isNull(), "no_hits").when(F.col("best") < floor, "low_confidence").otherwise("ok").alias("status"))


def scope_fingerprint(scopes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, scope_fingerprint): a hash of the sorted scopes and the language."""
    by = scopes.groupBy("query_id").agg(F.array_sort(F.collect_set(F.concat_ws("\x1f", "source", "scope"))).alias("s"))
    return by.join(queries.select("query_id", "language"), "query_id").select("query_id", F.sha2(F.concat_ws("\x1e", "s", F.coalesce("language", F.lit(""))), 256).alias("scope_fingerprint"))


def pivots_of(rows: DataFrame, n: int = 3, sample: int = 1024) -> list[list[float]]:
    """Vectors that lie far from each other, of a sample of fixed size by the hash of the rows; of one length, the commonest."""
    taken = [r[0] for r in rows.where("embedding IS NOT NULL").orderBy(F.xxhash64("embedding")).limit(sample).select("embedding").collect()]
    sizes = Counter(map(len, taken))
    x = np.array([v for v in taken if len(v) == sizes.most_common(1)[0][0]], np.float64) if taken else np.zeros((0, 1))
    x = x[np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)]
    out: list[int] = [0] if len(x) else []
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None] if len(x) else x
    while 0 < len(out) < min(n, len(x)):
        out.append(int((unit @ unit[out].T).max(axis=1).argmin()))
    return x[out].tolist()


def banded(rows: DataFrame, pivots: list[list[float]], floor: float, around: bool) -> DataFrame:
    """rows with the column bands: by angles to the pivots. Two vectors at an angle of t or less have angles to any third one
    that differ by t at most, so where one has its band (of width t) only, the other has up to three: around. Vectors that
    have no angle to a pivot, by their length, share a band of their own."""
    reach = float(np.arccos(np.clip(floor, -1.0, 1.0)))
    wide = max(reach, 0.01)
    out, names = rows, []
    for k, pivot in enumerate(pivots):
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("embedding"), F.array(*map(F.lit, pivot))))))
        at = lambda x: F.floor(x / wide).cast("int")
        own = F.sequence(at(angle - reach - 1e-6), at(angle + reach + 1e-6)) if around else F.array(at(angle))
        out = out.withColumn(f"_band{k}", F.explode(F.coalesce(F.when(angle.isNotNull() & ~F.isnan(angle), own), F.array(F.lit(-1000)))))
        names.append(f"_band{k}")
    return out.withColumn("bands", F.concat_ws(",", F.lit(""), *names)).drop(*names)


def cache_lookup(queries: DataFrame, cache: DataFrame, as_of: str, ttl: int = 3600, floor: float = 0.97) -> DataFrame:
    """The nearest answer of equal scope that is young enough, for questions (query_id, scope_fingerprint, embedding).

    Questions and answers meet by scope and bands of angles (see banded), so the higher the floor the fewer are compared;
    what meets is scored in blocks."""
    now = F.to_timestamp(F.lit(as_of))
    young = cache.where((F.col("created_at") <= now) & (F.unix_timestamp(now) - F.unix_timestamp("created_at") <= ttl) & F.col("embedding").isNotNull())
    pivots = pivots_of(young)
    kind = dict(cache.dtypes)["answer_id"]
    key = F.col("resource_id") if kind == "string" else F.lpad(F.col("resource_id").cast("string"), 20, "0")
    answers = banded(young.select(F.col("scope_fingerprint").alias("source"), F.col("answer_id").alias("resource_id"), F.lit(0).alias("chunk_index"), "embedding"), pivots, floor, False)
    asked = banded(queries.where("embedding IS NOT NULL").select("query_id", F.col("scope_fingerprint").alias("source"), "embedding"), pivots, floor, True)
    best = top(scored(asked, answers, ["source", "bands"], 1, floor, key), ["query_id"], [F.desc("score"), F.asc("resource_id")], 1, "_rn")
    text = young.select(F.col("answer_id"), "answer").dropDuplicates(["answer_id"])
    return best.select("query_id", F.col("resource_id").alias("answer_id"), F.col("score").alias("similarity")).join(text, "answer_id").select("query_id", "answer_id", "answer", "similarity")


def cache_store(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with plain answers added; not those that skip it."""
    return cache.unionByName(answers.where("NOT coalesce(skip_cache, false) AND status = 'ok'").select(*cache.columns))


def reassemble_objects(hits: DataFrame, chunks: DataFrame, most: int = 15) -> DataFrame:
    """SQL fragments replaced by their object's whole text, once per question; objects of 1 or over most chunks stay."""
    wanted = hits.where("source = 'sql'").select("resource_id").distinct()
    bodies = chunks.join(wanted, "resource_id", "left_semi").groupBy("resource_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("body")).where((F.col("n") > 1) & (F.col("n") <= most))
    joined = hits.join(bodies, "resource_id", "left").withColumn("text", F.coalesce("body", "text")).withColumn("_whole", F.col("body").isNotNull())
    first = F.row_number().over(Window.partitionBy("query_id", "resource_id", "_whole").orderBy("place", "chunk_index"))
    return joined.withColumn("_rn", first).where("NOT _whole OR _rn = 1").drop("_rn", "_whole", "body", "n")


def include_dependencies(hits: DataFrame, edges: DataFrame, objects: DataFrame, extra: int = 5, hops: int = 1) -> DataFrame:
    """Objects within some hops of a question's SQL hits on any edges, either way, by exact name: (query_id, resource_id, name,
    score 0), 5 at most, nearer ones first."""
    own = hits.where("source = 'sql'").select("query_id", "resource_id").distinct()
    ends = edges.select(F.col("subject").alias("name"), F.col("object").alias("other")).unionByName(edges.select(F.col("object").alias("name"), F.col("subject").alias("other"))).distinct()
    seen = own.join(objects.select("resource_id", "name"), "resource_id").select("query_id", "name", F.lit(0).alias("hop"))
    live = seen
    for hop in range(1, hops + 1):
        step = live.drop("hop").join(ends, "name").select("query_id", F.col("other").alias("name")).distinct()
        live = step.join(seen, ["query_id", "name"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(live)
    new = seen.where("hop > 0").join(objects.select("resource_id", "name"), "name").join(own, ["query_id", "resource_id"], "left_anti")
    return top(new, ["query_id"], [F.asc("hop"), F.asc("name"), F.asc("resource_id")], extra, "_rn").select("query_id", "resource_id", "name", F.lit(0.0).alias("score"))


def numbered_context(hits: DataFrame) -> DataFrame:
    """(query_id, number, resource_id, block): a block for each resource in order of its best score, its chunks joined."""
    by = hits.groupBy("query_id", "resource_id").agg(F.max("score").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("body"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("resource_id")))
    return by.withColumn("number", number).select("query_id", "number", "resource_id", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("body")).alias("block"))


def retrieval_quality(hits: DataFrame, judged: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, precision, recall) at k against (query_id, resource_id) of what is relevant."""
    taken = hits.where(F.col("place") <= k).select("query_id", "resource_id").distinct()
    good = judged.select("query_id", "resource_id").distinct()
    n_good = good.groupBy("query_id").agg(F.count("*").alias("relevant"))
    found = taken.join(good.withColumn("ok", F.lit(1)), ["query_id", "resource_id"], "left").groupBy("query_id").agg(F.count("*").alias("taken"), F.count("ok").alias("found"))
    both = n_good.join(found, "query_id", "full_outer")
    share = lambda n: F.coalesce(F.try_divide(F.col("found").cast("double"), F.col(n)), F.lit(0.0))
    return both.select("query_id", share("taken").alias("precision"), share("relevant").alias("recall"))
