"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With it, Spark removes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space that parts words: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Odd multipliers that mix hashes.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of 64-bit hashes, in this order."""
    x = a * MIX[0] + (b ^ (b >> np.uint64(29))) * MIX[1]
    x = (x ^ (x >> np.uint64(32))) * MIX[2]
    return x ^ (x >> np.uint64(29))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, by which the operators size their own divisions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder that the cluster names, and let go of the shuffle
    files that led to it: else they stay until the driver happens to collect its garbage. The session's own setting for
    that holds for what other queries leave.

    Only where the session names none (a bare test session) a local one is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        import tempfile

        if named := df.sparkSession.conf.get("spark.checkpoint.dir", ""):
            context.setCheckpointDir(named)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        else:
            raise ValueError("spark.checkpoint.dir names no shared folder")
    with light(df.sparkSession):
        return df.select("*").checkpoint()  # planned under the setting


@contextlib.contextmanager
def light(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile removes its shuffle files at its end; the session's own setting is put back."""
    settings, before = spark.conf, spark.conf.get(CLEANUP)
    settings.set(CLEANUP, "true")
    try:
        yield
    finally:
        settings.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """The same rows from Parquet in the shared folder, compressed, and read by columns. Checkpoints carry on the sizes
    that Spark guesses, which joins multiply: after some rounds their digits alone take minutes."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with light(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names for checkpoints."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        import tempfile

        root = tempfile.mkdtemp(prefix="spark-shards-")
    root = root if "://" in root else "file://" + os.path.abspath(root.removeprefix("file:"))
    return f"{root}/shards-{uuid.uuid4().hex}"


def prepared(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """The session, set to hand Python this many rows at a time at most: ten thousand long texts, the default, take tens of
    megabytes in Spark and several times as much in Python. The registered queries and the pipeline's stages, which are
    applications, call this; the operators change no setting of their caller's."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    return spark


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most limit bytes of text each, or a single longer row."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held + size > limit and i > begin:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if len(sizes) > begin:
        yield batch.slice(begin)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold limit bytes of text: what a task works on at once doesn't depend on how rows come."""
    held, size = [], 0
    for b in batches:
        own = pc.sum(pc.binary_length(b[column])).as_py() or 0
        if held and size + own > 2 * limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += own
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and the offsets of the texts; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words stand before each text (one more than the texts)."""
    inside = ~blank[data]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def text_of(name: str = "text"):
    """A text column as string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
