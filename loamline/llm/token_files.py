"""Token ids in binary shard files with a minimal perfect hash index.

A shard file holds, in this order: the id payload (2 or 4 bytes an id, little-endian, one document after the other), the
index and a footer. The index is a minimal perfect hash of the shard's document keys: at each level a key that is alone in
its slot of a bit array has found its place, the others go on to the next, smaller level; a key's number is the count of
set bits before its own. By that number the index keeps the key's fingerprint, its first id and its count, so a key is
looked up in a few steps, whatever the shard's size, and an unknown one is told by its fingerprint. The keys follow as
text, in payload order, for listings.

Shards are ranges of ids, so that shard after shard the documents stand in ascending order. A task streams its payload to
a file of its own attempt and renames it when it is whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamline.llm.bpe import REMEMBERED, Remembered
from loamline.llm.common import pieces, shared_folder, text_of, width
from loamline.llm.substring import mixed

MAGIC = b"loamtok1"
#: A space and what neither starts nor ends with white space.
JOINABLE = re.compile(r" \S(?:.*\S)?\Z", re.S)
#: Bytes of text for a shard: what a task encodes, and whose keys and counts it holds.
SHARD = 128 << 20
ROOMS = 2  # slots for each key that is left at a level


def key_hashes(keys: list[str], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), np.uint64, len(keys))


def slots(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers from 0 to n - 1 for n distinct keys."""

    def __init__(self, seed: int, levels: list[np.ndarray]) -> None:
        self.seed, self.levels = seed, levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) - x for x in (level.astype(np.int64) for level in levels)]

    @classmethod
    def build(cls, keys: list[str]) -> PerfectHash:
        for seed in range(64):
            left = key_hashes(keys, seed)
            if len(np.unique(left)) == len(left):
                break
        else:
            raise ValueError("the keys are not distinct")
        levels: list[np.ndarray] = []
        while len(left):
            at = slots(left, len(levels), ROOMS * len(left))
            levels.append(np.bincount(at, minlength=ROOMS * len(left)) == 1)
            left = left[~levels[-1][at]]
        return cls(seed, levels)

    def lookup(self, keys: list[str]) -> np.ndarray:
        """The number of each key; for a key that isn't in the set any number, or -1."""
        hashes = key_hashes(keys, self.seed)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, level in enumerate(self.levels):
            at = slots(hashes[left], k, len(level))
            here = level[at]
            out[left[here]] = self.before[k] + self.ranks[k][at[here]]
            left = left[~here]
        return out


def fingerprints(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(k, 7) for k in keys), np.uint32, len(keys))


def distinct_keys(ids: list) -> list[str]:
    """A key for each document: its id, and for further documents of that id a count."""
    seen: Counter = Counter()
    out = []
    for x in ids:
        seen[x] += 1
        out.append(("n" if x is None else f"={x}") + f"#{seen[x] - 1}" * (seen[x] > 1))
    return out


class Shard:
    """A shard file opened for reading."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no shard file")
        start = int.from_bytes(tail[:8], "little")
        data = self.file.read_at(size - 16 - start, start)
        head_size = int.from_bytes(data[:8], "little")
        self.head = json.loads(data[8 : 8 + head_size])
        at, parts = 8 + head_size, {}
        for name, n in self.head["parts"]:
            parts[name] = data[at : at + n]
            at += n
        self.dtype = np.dtype(self.head["dtype"])
        bits = np.unpackbits(np.frombuffer(parts["bits"], np.uint8)).astype(bool)
        cuts = np.cumsum([0, *self.head["levels"]])
        self.hash = PerfectHash(self.head["seed"], [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        self.fingerprint, self.first, self.count = (np.frombuffer(parts[n], t) for n, t in (("fingerprint", "<u4"), ("first", "<u8"), ("count", "<u8")))
        self.keys = parts["keys"].decode().split("\n") if self.head["docs"] else []

    def ids(self, key: str) -> np.ndarray | None:
        """The ids of one document; None if the shard hasn't got it."""
        return next(self.many([key]))

    def many(self, keys: list[str]) -> Iterator[np.ndarray | None]:
        numbers = self.hash.lookup(keys)
        good = numbers >= 0
        good[good] = self.fingerprint[numbers[good]] == fingerprints([k for k, g in zip(keys, good.tolist(), strict=True) if g])
        for n, known in zip(numbers.tolist(), good.tolist(), strict=True):
            if known:
                size = self.dtype.itemsize
                yield np.frombuffer(self.file.read_at(int(self.count[n]) * size, int(self.first[n]) * size), self.dtype)
            else:
                yield None


def write_shard(uri: str, part: str, dtype: str, docs: Iterator[tuple[object, np.ndarray]]) -> tuple[int, int]:
    """Documents and ids written."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    ids, counts = [], []
    with fs.open_output_stream(temporary := f"{path}.{part}") as out:
        for doc_id, tokens in docs:
            ids.append(doc_id), counts.append(len(tokens))
            out.write(tokens.astype(dtype, copy=False).tobytes())
        keys = distinct_keys(ids)
        index = PerfectHash.build(keys)
        order = index.lookup(keys)
        count = np.array(counts, np.uint64)
        columns = {"fingerprint": fingerprints(keys), "first": np.cumsum(count, dtype=np.uint64) - count, "count": count}
        parts = {"bits": np.packbits(np.concatenate(index.levels)).tobytes() if index.levels else b""}
        for name, values in columns.items():
            placed = np.empty_like(values)
            placed[order] = values
            parts[name] = placed.tobytes()
        parts["keys"] = "\n".join(keys).encode()
        head = json.dumps({"docs": len(keys), "dtype": dtype, "seed": index.seed, "levels": [len(x) for x in index.levels], "parts": [[k, len(v)] for k, v in parts.items()]}).encode()
        out.write(len(head).to_bytes(8, "little") + head + b"".join(parts.values()))
        out.write((int(count.sum()) * np.dtype(dtype).itemsize).to_bytes(8, "little") + MAGIC)
    if fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
        fs.delete_file(path)  # of an attempt whose end Spark didn't see, with the same bytes
    fs.move(temporary, path)
    return len(keys), int(count.sum())


@lru_cache(maxsize=1)
def library_encoder(path: str, dtype: str):
    """Encodes lists of texts with the tokenizers library, which gets each unit (see bpe.Remembered) once as long as it is
    remembered. Units that start with a space and a character and end with one reach it many at a time, one after the
    other, as they might in a text; which ids are whose is told by the tokens' lengths in bytes. A Python worker keeps its encoder from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation(), tokenizer.no_padding()
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    lengths = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True) + 1, np.int64)
    lengths[list(vocab.values())] = [len(t) for t in vocab]  # in a byte-level vocabulary a character stands for a byte
    size = np.dtype(dtype).itemsize

    def encoded(texts: list[str]) -> list[list[int]]:
        """Ids of each text; places of tokens, which nobody asks for, aren't told."""
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def alone(units: list[str]) -> list[bytes]:
        return [np.array(ids, dtype).tobytes() for ids in encoded(units)]

    def learn(units: list[str]) -> list[bytes]:
        whole = "\0".join(units)
        clean = not any(c in whole for c in specials)
        joinable = [JOINABLE.match(u) is not None and (clean or not any(c in u for c in specials)) for u in units]
        many = [u for u, j in zip(units, joinable, strict=True) if j]
        ids = np.fromiter(chain.from_iterable(encoded(["".join(many[i : i + 32]) for i in range(0, len(many), 32)])), dtype)
        ends = np.cumsum([len(u.encode()) for u in many])
        upto = np.cumsum(lengths[ids])
        cuts = np.searchsorted(upto, ends)
        if len(many) and (cuts[-1] >= len(upto) or not (upto[cuts] == ends).all()):
            return alone(units)  # a token across units: not in a vocabulary like this
        data, at = ids.tobytes(), (size * (cuts + 1)).tolist()
        joined = iter([data[x:y] for x, y in zip([0, *at], at, strict=False)])
        others = iter(alone([u for u, j in zip(units, joinable, strict=True) if not j]))
        return [next(joined) if j else next(others) for j in joinable]

    return Remembered(learn, dtype, 4 * REMEMBERED).encode


def write_token_files(docs: DataFrame, path: str, folder: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 0) -> list[tuple[int, int, int]]:
    """Encode and write all documents; (shard, documents, ids) for each shard, in order. There is a shard for each SHARD
    bytes of text, and as many as the session has shuffle partitions at least."""
    tokenizer = Tokenizer.from_file(path)
    dtype = "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    texts = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    # equal ids are dealt by their text as well, so that no number of them fills one shard
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(path, dtype)
        task = TaskContext.get()
        end = np.array([end_id], dtype)

        def rows() -> Iterator[tuple[object, np.ndarray]]:
            for whole in batches:
                for b in pieces(whole, "text", 1 << 20):
                    for doc_id, ids in zip(b["doc_id"].to_pylist(), encode(b["text"].to_pylist()), strict=True):
                        yield doc_id, np.concatenate([ids, end])

        shard = task.partitionId()
        n_docs, n_ids = write_shard(f"{folder}/shard-{shard:06d}", f"{task.taskAttemptId()}", dtype, rows())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "docs": pa.array([n_docs], pa.int64()), "ids": pa.array([n_ids], pa.int64())})

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    done = texts.repartitionByRange(max(width(docs.sparkSession), -(-size // SHARD)), *order).sortWithinPartitions(*order).mapInArrow(write, "shard int, docs bigint, ids bigint").collect()
    return sorted((r.shard, r.docs, r.ids) for r in done)


def read_token_files(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]], kind: str = "bigint", outputs: bool = False) -> DataFrame:
    """One row per document in the files: doc_id, start, n_tokens, ids_crc32 and, with outputs, ids. Every document is
    looked up by its key."""
    starts = np.cumsum([0, *(ids for _, _, ids in shards)]).tolist()
    known = [(shard, start) for (shard, docs, _), start in zip(shards, starts, strict=False) if docs]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, start in zip(b["shard"].to_pylist(), b["base"].to_pylist(), strict=True):
                shard = Shard(f"{folder}/shard-{number:06d}")
                for k in range(0, len(shard.keys), 512):
                    keys = shard.keys[k : k + 512]
                    found = list(shard.many(keys))
                    counts = np.array([len(x) for x in found], np.int64)
                    crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in found]
                    columns = {"doc_id": pa.array([None if x[0] == "n" else x[1:].partition("#")[0] for x in keys], pa.string()), "start": pa.array(start + np.cumsum(counts) - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crcs, pa.int64())}
                    if outputs:
                        columns["ids"] = pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))
                    start += int(counts.sum())
                    yield pa.RecordBatch.from_pydict(columns)

    table = spark.createDataFrame(known, "shard int, base bigint")
    out = table.repartition(max(1, len(known)), "shard").mapInArrow(read, "doc_id string, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * outputs)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def token_files(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 0, folder: str | None = None, outputs: bool = False) -> DataFrame:
    """Write the documents' token ids to shard files in ascending order of their ids, and read the files back.

    One row per input row: doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 (of all
    its ids as unsigned 32-bit little-endian numbers). Null is an empty text: its only id is the end id. Null ids come
    first; documents of equal id stand in the order of a hash of their texts. folder: where the files go, a new folder
    beside the checkpoints by default; any file system that pyarrow opens. Ids are whole numbers or strings without line
    ends or "#". Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    shards = write_token_files(docs, path, folder, id_column, text_column, end_id)
    return read_token_files(spark, folder, shards, dict(docs.dtypes)[id_column], outputs)
