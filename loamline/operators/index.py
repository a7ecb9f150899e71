"""Index maintenance: resources to chunks, edges and grants.

Tables in, tables out. Parquet has no row updates, so an upsert is a join of the stored and the new rows, written by
touched partitions of ``source``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.functions.text import fingerprint, without_nul
from loamline.schemas import POPPED, PROMOTED, SCOPE_KEY

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
KEY = ["resource_id", "chunk_index"]


def chunk_fixed(df: DataFrame, size: int = 1000, overlap: int = 200, text: str = "text") -> DataFrame:
    """Windows of size characters, each overlapping the one before; the last ends with the text. Empty texts have none."""
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - overlap, F.lit(1)), F.lit(step))
    parts = F.when(F.char_length(text) > 0, F.transform(starts, lambda s: F.substr(F.col(text), s, F.lit(size))))
    return df.select(*(c for c in df.columns if c != text), F.posexplode(parts).alias("chunk_index", text))


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces between the coarsest separators that keep them at size or less, merged up to size with an overlap."""

    def cut(s: str, left: tuple[str, ...]) -> list[str]:
        if len(s) <= size:
            return [s]
        sep = left[0]
        if not sep:
            return [s[i : i + size] for i in range(0, len(s), size)]
        if sep not in s:
            return cut(s, left[1:])
        parts = s.split(sep)
        return [x for k, p in enumerate(parts) for x in cut(p + sep * (k < len(parts) - 1), left[1:]) if x]

    out: list[str] = []
    held: list[str] = []
    for piece in cut(text, separators):
        if held and sum(map(len, held)) + len(piece) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                held.pop(0)
        held.append(piece)
    if held:
        out.append("".join(held))
    return [x for x in (s.strip() for s in out) if x]


def chunk_recursive(df: DataFrame, size: int = 1000, overlap: int = 200, text: str = "text") -> DataFrame:
    """Chunks along paragraphs, lines, sentences and words; see split_recursive."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursive(t or "", size, overlap))

    return df.select(*(c for c in df.columns if c != text), F.posexplode(pieces(F.col(text))).alias("chunk_index", text))


def cleaned(value: Column, kind: T.DataType) -> Column:
    """A value of any type without NUL in its strings, however deep they lie."""
    if isinstance(kind, T.StringType):
        return without_nul(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: cleaned(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: cleaned(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(cleaned(value[f.name], f.dataType).alias(f.name) for f in kind)))
    return value


def strip_nul(df: DataFrame) -> DataFrame:
    """Without NUL in strings, nested ones included; keys of maps stay as they are."""
    return df.select(*(cleaned(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def promote_metadata(df: DataFrame, bag: str = "metadata") -> DataFrame:
    """Known keys of the bag become columns; the bag keeps the rest."""
    moved = (*PROMOTED, *POPPED)
    own = {k: F.coalesce(F.col(k), F.try_element_at(bag, F.lit(k))) if k in df.columns and dict(df.dtypes)[k] == "string" else F.try_element_at(bag, F.lit(k)) for k in moved if k not in df.columns or dict(df.dtypes)[k] == "string"}
    return df.withColumns(own).withColumn(bag, F.map_filter(bag, lambda k, _: ~k.isin(*moved)))


def scope_of(source: Column, bag: Column) -> Column:
    """The scope that a row's source keeps under a key of its own."""
    out = F.lit(None).cast("string")
    for name, key in SCOPE_KEY.items():
        out = F.when(source == name, F.try_element_at(bag, F.lit(key))).otherwise(out)
    return out


def with_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("fingerprint", fingerprint(F.col(text)))


def drop_unchanged(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New chunks whose key and fingerprint aren't stored."""
    return new.join(stored.select(*KEY, "fingerprint"), [*KEY, "fingerprint"], "left_anti")


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for a model: a component for each token's hash, signed."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    # twice the component's number, and one more where the token counts as negative
    marks = F.transform(words, lambda w: (2 * F.pmod(F.xxhash64(w), F.lit(dim)) + F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2))).cast("int"))
    others = lambda own, mark: F.size(F.array_remove(own, mark))
    sums = lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(own.isNotNull(), others(own, 2 * i + 1) - others(own, 2 * i)).cast("float"))
    # the marks are an argument here, made once; inside the lambda they would be made again for each component
    return F.transform(F.array(marks), sums)[0]


def embed_chunks(df: DataFrame, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """Vectors by a pandas UDF, or by hashing; to be called on what drop_unchanged has left."""
    return df.withColumn("embedding", (model or hashed_vector)(F.col("text")))


def upsert_chunks(new: DataFrame, stored: DataFrame, as_of: str, refresh_metadata: bool = False, newest: bool = False) -> DataFrame:
    """The stored table after new rows replace those of their key. created_at stays, updated_at is as_of where text changed.

    An equal fingerprint leaves the stored row alone, but for title, url, last_updated and metadata with
    refresh_metadata. newest: a new row that is older than the stored one is ignored."""
    columns = stored.columns
    last = Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("last_updated"), F.desc("fingerprint"))
    one = new.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
    n, s = one.select(F.struct(*one.columns).alias("n"), *KEY), stored.select(F.struct(*columns).alias("s"), *KEY)
    both = s.join(n, KEY, "full_outer")
    fresh = F.col("n").isNotNull() & (F.col("s").isNull() | ~F.col("n.fingerprint").eqNullSafe(F.col("s.fingerprint")))
    if newest:
        fresh &= F.col("s").isNull() | F.coalesce(F.col("n.last_updated") >= F.col("s.last_updated"), F.lit(True))
    time, refreshed = F.to_timestamp(F.lit(as_of)), ("title", "url", "last_updated", "metadata") if refresh_metadata else ()

    def column(c: str) -> Column:
        if c in KEY:
            return F.col(c)
        if c == "created_at":
            return F.coalesce(F.col("s.created_at"), time).alias(c)
        if c == "updated_at":
            return F.when(fresh, time).otherwise(F.col("s.updated_at")).alias(c)
        mine = F.col(f"n.{c}") if c in one.columns else F.lit(None)
        use = F.col("n").isNotNull() if c in refreshed else fresh
        return F.when(use, mine).otherwise(F.col(f"s.{c}")).alias(c)

    return both.select(*(column(c) for c in columns))


def write_index(df: DataFrame, path: str) -> None:
    """Overwrite the partitions of the sources in df, and no others."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy("source").mode("overwrite").parquet(path)


def quarantine(df: DataFrame, max_chars: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and those that can't with the reason."""
    reason = F.when(F.col("resource_id").isNull() | (F.col("resource_id") == ""), "no resource id").when(F.col("chunk_index").isNull() | (F.col("chunk_index") < 0), "no chunk index").when(F.col("text").isNull(), "no text").when(F.char_length("text") > max_chars, "too long")
    judged = df.withColumn("reject_reason", reason)
    return judged.where("reject_reason IS NULL").drop("reject_reason"), judged.where("reject_reason IS NOT NULL")


def prune_tail(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """Without chunks at or behind a resource's new count (resource_id, n); a count of 0 removes all of them."""
    return stored.join(counts, "resource_id", "left").where("n IS NULL OR chunk_index < n").drop("n")


def delete_resources(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("resource_id"), "resource_id", "left_anti")


def matches(df: DataFrame, wanted: dict) -> Column:
    """Equality with each known key's value, a list meaning any of it; unknown keys are ignored."""
    out = F.lit(True)
    for key, value in wanted.items():
        if key in df.columns:
            values = value.get("$in", []) if isinstance(value, dict) else value
            out &= F.col(key).isin(*values) if isinstance(values, (list, tuple, set)) else F.col(key) == values
    return F.coalesce(out, F.lit(False))


def delete_by_filter(stored: DataFrame, wanted: dict, allow_all: bool = False) -> DataFrame:
    """Without the matching rows. An empty filter matches all, which has to be allowed."""
    if not any(k in stored.columns for k in wanted) and not allow_all:
        raise ValueError("the filter names no column and would delete every row")
    return stored.where(~matches(stored, wanted))


def full_refresh(stored: DataFrame, new: DataFrame, wanted: dict) -> DataFrame:
    """The scope's rows replaced as a whole."""
    return delete_by_filter(stored, wanted).unionByName(new, allowMissingColumns=True)


def high_water(log: DataFrame, user: str, source: str, scope: str) -> DataFrame:
    """The last successful run's newest item; a row with null if there is none."""
    rows = log.where((F.col("user_id") == user) & (F.col("source") == source) & (F.col("scope") == scope) & (F.col("status") == "success"))
    return rows.agg(F.max_by("last_item", "completed_at").alias("last_item"))


def log_row(results: DataFrame, user: str, source: str, scope: str, mode: str, as_of: str, status: str = "success", message: str = "") -> DataFrame:
    """A log row with what a run has read (resource_id, n, last_updated); messages are cut at 1000 characters."""
    sums = results.agg(F.count("*").alias("n_resources"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_chunks"), F.max("last_updated").alias("last_item"))
    return sums.select(F.lit(user).alias("user_id"), F.lit(source).alias("source"), F.lit(scope).alias("scope"), F.lit(mode).alias("mode"), F.lit(status).alias("status"), F.to_timestamp(F.lit(as_of)).alias("completed_at"), "last_item", "n_resources", "n_chunks", F.substring(F.lit(message), 1, 1000).alias("message"))


def grant_access(grants: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """Grants with (user_id, source, scope) added; one that is there gets a new last_synced."""
    keys = ["user_id", "source", "scope"]
    fresh = new.select(*keys).distinct().withColumn("_synced", F.to_timestamp(F.lit(as_of)))
    return grants.join(fresh, keys, "full_outer").withColumn("last_synced", F.coalesce("_synced", "last_synced")).select(*keys, "last_synced")


def revoke_access(grants: DataFrame, gone: DataFrame) -> DataFrame:
    return grants.join(gone, ["user_id", "source", "scope"], "left_anti")


def list_accessible(grants: DataFrame, user: str) -> DataFrame:
    return grants.where(F.col("user_id") == user).select("source", "scope", "last_synced")


def replace_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """All edges of the resources in new are replaced."""
    return stored.join(new.select("source_resource_id").distinct(), "source_resource_id", "left_anti").unionByName(new.distinct())


def assemble_edges(deterministic: DataFrame, model: DataFrame | None = None, most: int = 10) -> DataFrame:
    """Edges tagged by how they were found. Model edges are not taken for SQL objects and repository files, blank ones
    are dropped, and a resource has at most ``most`` of them, the first by their order column."""
    out = deterministic.withColumn("extraction_method", F.lit("deterministic"))
    if model is None:
        return out
    full = [F.trim(c) != "" for c in ("subject", "predicate", "object")]
    taken = model.where((F.col("source") != "sql") & ~((F.col("source") == "git") & F.col("source_resource_id").contains(":file:")) & full[0] & full[1] & full[2])
    rank = F.row_number().over(Window.partitionBy("source_resource_id").orderBy("ordinal", "subject", "predicate", "object"))
    return out.unionByName(taken.withColumn("_rn", rank).where(F.col("_rn") <= most).drop("_rn", "ordinal").withColumn("extraction_method", F.lit("llm")))


def resource_exists(ids: DataFrame, stored: DataFrame) -> DataFrame:
    return ids.join(stored.select("resource_id"), "resource_id", "left_semi")


def index_stats(chunks: DataFrame) -> DataFrame:
    """Chunks by source, and their total."""
    counts = chunks.rollup("source").agg(F.count("*").alias("n_chunks"), F.grouping("source").alias("g"))
    return counts.select(F.when(F.col("g") == 1, "__total__").otherwise(F.col("source")).alias("source"), "n_chunks")


def purge_source(chunks: DataFrame, source: str) -> DataFrame:
    return chunks.where(~F.col("source").eqNullSafe(F.lit(source)))


def backfill_urls(chunks: DataFrame, legacy: list[str], url: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose url is like a legacy pattern get a new one where it can be made; and a report of counts."""
    old = F.lit(False)
    for pattern in legacy:
        old |= F.col("url").like(pattern)
    marked = chunks.withColumn("_old", F.coalesce(old, F.lit(False))).withColumn("_new", url)
    report = marked.agg(F.count_if("_old").alias("examined"), F.count_if(F.col("_old") & F.col("_new").isNotNull()).alias("updated"), F.count_if(F.col("_old") & F.col("_new").isNull()).alias("fell_back"), F.count_if(~F.col("_old")).alias("remaining"))
    return marked.withColumn("url", F.when(F.col("_old"), F.coalesce("_new", "url")).otherwise(F.col("url"))).drop("_old", "_new"), report


def duplicate_report(chunks: DataFrame) -> DataFrame:
    """Fingerprints of more than one chunk, with their sources."""
    by = chunks.where("fingerprint IS NOT NULL").groupBy("fingerprint")
    return by.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).where("n > 1")


def incremental_ingest(resources: DataFrame, stored: DataFrame, since: str | None, as_of: str, size: int = 1000, overlap: int = 200, model: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The index after a run over resources that changed since a time, and (resource_id, n, last_updated) of what it read.

    Resources are chunked, unchanged chunks are left alone before any vector is made, the others replace their keys, and
    chunks behind a resource's new end go, all of them if it has become empty."""
    if since is not None:
        resources = resources.where(F.col("last_updated") >= F.to_timestamp(F.lit(since)))
    # lengths are told before rows are compared, so that what needs the counts alone moves no text; both see the same of ties
    whole = F.coalesce(F.char_length("text"), F.lit(0))
    length = F.when(whole == 0, 0).otherwise(F.greatest(F.ceil((whole - overlap) / F.lit(size - overlap)), F.lit(1))).cast("int")
    last = Window.partitionBy("resource_id").orderBy(F.desc_nulls_last("last_updated"), F.desc("_n"))
    current = resources.withColumn("_n", length).withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
    pieces = with_fingerprint(strip_nul(chunk_fixed(current.drop("_n"), size, overlap)))
    counts = current.select("resource_id", "last_updated", F.col("_n").alias("n"))
    # texts are moved once to their key: known fingerprints, the last row of a key and the stored row are then met there
    known = stored.groupBy(*KEY).agg(F.collect_set("fingerprint").alias("_known"))
    met = pieces.join(known.hint("merge"), KEY, "left").where(~F.coalesce(F.array_contains("_known", F.col("fingerprint")), F.lit(False))).drop("_known")
    gone = stored.select(*KEY).join(counts, "resource_id").where("chunk_index >= n").select(*KEY)
    kept = stored.join(gone.hint("merge"), KEY, "left_anti")
    return upsert_chunks(embed_chunks(met, model), kept, as_of), counts
