"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

A leaf holds the rank of the pair that starts at its symbol, made greater by its place, so that the root is the leftmost
pair of lowest rank. A merge changes three leaves (its own pair's, the one before and the swallowed symbol's), whose
paths to the root are updated: log(n) steps a merge, until the root holds no pair. Words of like length are encoded as
the rows of one matrix of trees, with one merge in each row at a time; one very long word is a matrix with one row.

Texts are cut into units before a space; what stands on either side of such a cut never shares a token (Remembered tells
the cases in which that isn't so). Each unit is split by the tokenizer's own pattern. Encoded units are remembered up to
a fixed number.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamline.llm.common import pieces, text_of

#: The pattern by which byte-level BPE parts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(1 << 62)
REMEMBERED = 250_000
#: A space between two other white spaces, or one and the end: no cut may stand there.
NO_CUT = re.compile(r"\s (?:\s|\Z)")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in such vocabularies: printable ones for themselves, others from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairMerges:
    """The merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {i: bytes(symbols[c] for c in t) for t, i in vocab.items() if t not in self.specials}
        self.token_bytes |= {i: t.encode() for t, i in self.specials.items()}
        self.of_byte = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.of_byte[b] = vocab[c]
        self.base = max(self.token_bytes) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first_ranks = self.find(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)).reshape(256, 256)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it doesn't merge."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def encode_matrix(self, words: list[bytes], leaves: int) -> tuple[bytes, np.ndarray]:
        """Ids of words of at most ``leaves`` bytes, a power of two: as 4 bytes each, word after word, and their counts."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        letters = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), sizes)
        column = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = np.full((n, leaves + 1), -1, np.int64)  # the last column stands for what is beyond an end
        ids[row, column] = self.of_byte[letters]
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        rank = self.first_ranks[letters[:-1], letters[1:]]
        inner = (row[:-1] == row[1:]) & (rank < NONE)
        tree[row[:-1][inner], leaves + column[:-1][inner]] = rank[inner] * leaves + column[:-1][inner]
        level = leaves
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        ahead = np.empty((n, leaves + 1), np.int32)
        ahead[:] = np.arange(1, leaves + 2)
        behind = ahead - 2
        rows = np.flatnonzero(tree[:, 1] < NONE) if leaves > 1 else np.zeros(0, np.int64)
        while len(rows):
            at = tree[rows, 1] % leaves
            gone = ahead[rows, at]
            made = self.made[tree[rows, 1] // leaves]
            after = np.minimum(ahead[rows, gone], leaves)
            before = behind[rows, at]
            ids[rows, at], ids[rows, gone] = made, -1
            ahead[rows, at], behind[rows, after] = after, at
            first = before < 0
            before = np.where(first, at, before)
            next_rank = self.find(made, ids[rows, after])
            last_rank = np.where(first, next_rank, self.find(ids[rows, before], made))
            tree[rows, leaves + gone] = NONE
            tree[rows, leaves + before] = np.where(last_rank < NONE, last_rank * leaves + before, NONE)
            tree[rows, leaves + at] = np.where(next_rank < NONE, next_rank * leaves + at, NONE)
            a, b, c = leaves + at, leaves + gone, leaves + before
            span = leaves
            while span > 1:
                span //= 2
                a, b, c = a >> 1, b >> 1, c >> 1
                for node in (a, b, c):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            rows = rows[tree[rows, 1] < NONE]
        left = ids >= 0
        return ids[left].astype("<u4").tobytes(), left.sum(axis=1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, a word being what the pattern finds; 4 bytes each."""
        out: list[bytes] = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(1 << max(0, len(w) - 1).bit_length(), []).append(i)
        for leaves, at in by.items():
            step = max(1, (1 << 17) // leaves)
            for k in range(0, len(at), step):
                own = at[k : k + step]
                data, counts = self.encode_matrix([words[i] for i in own], leaves)
                ends = (4 * np.cumsum(counts)).tolist()
                for i, x, y in zip(own, [0, *ends], ends, strict=False):
                    out[i] = data[x:y]
        return out


class Remembered:
    """Ids of whole texts, put together from the ids of their units, which are remembered.

    Texts are cut before spaces. A run of white space decides as a whole how it is parted, so a space inside of one starts
    no unit if white space or the end follows it and white space stands before it; a text with such a space stays whole.
    learn: the ids of units, as bytes. Units of over 256 characters are not remembered, and all are forgotten when there
    are more than ``most``."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], dtype: str = "<u4", most: int = REMEMBERED) -> None:
        self.learn, self.dtype, self.most = learn, dtype, most
        self.heads: dict[str, bytes] = {"": b""}
        self.spaced: dict[str, bytes] = {}  # by what follows the space

    def values(self, known: dict[str, bytes], keys: list[str], lead: str) -> list[bytes]:
        found = list(map(known.get, keys))
        if None in found:
            missing = [i for i, v in enumerate(found) if v is None]
            new = list({keys[i] for i in missing})
            known.update(zip(new, self.learn([lead + k for k in new] if lead else new), strict=True))
            for i in missing:
                found[i] = known[keys[i]]
            for k in new:
                if len(k) > 256:
                    del known[k]
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.spaced) > self.most:
            self.spaced = {}
        if len(self.heads) > self.most:
            self.heads = {"": b""}
        heads, rests = [], []
        for text in texts:
            parts = [text] if NO_CUT.search(text) else text.split(" ")
            heads.append(parts[0])
            rests.append(parts[1:])
        first = self.values(self.heads, heads, "")
        found = self.values(self.spaced, list(chain.from_iterable(rests)), " ")
        out, at = [], 0
        for head, rest in zip(first, rests, strict=True):
            out.append(np.frombuffer(head + b"".join(found[at : at + len(rest)]), self.dtype))
            at += len(rest)
        return out


class Codec:
    """Encodes and decodes texts."""

    def __init__(self, path: str) -> None:
        self.merges = PairMerges(path)
        self.pattern = regex.compile(PATTERN)
        self.library_split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.merges.specials)) + ")") if self.merges.specials else None
        self.units = Remembered(self.learn)
        self.words: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The words of a text. Versions of Unicode differ in the classes of characters that this Python doesn't know
        yet; there the library's own split decides."""
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text):
            return [text[a:b] for _, (a, b) in self.library_split(text)]
        return self.pattern.findall(text)

    def learn(self, units: list[str]) -> list[bytes]:
        """The ids of units, whose words are encoded all in one go."""
        if len(self.words) > REMEMBERED:
            self.words = {}
        known, plan = self.words, []
        for u in units:
            if self.special and self.special.search(u):
                parts: list[str | int] = []
                for k, text in enumerate(self.special.split(u)):
                    parts += [self.merges.specials[text]] if k % 2 else self.split(text)
                plan.append(parts)
            else:
                plan.append(self.split(u))
        if new := list({w for parts in plan for w in parts if isinstance(w, str) and w not in known}):
            known.update(zip(new, self.merges.encode([w.encode() for w in new]), strict=True))
        out = [known[parts[0]] if len(parts) == 1 and isinstance(parts[0], str) else b"".join([known[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in parts]) for parts in plan]
        for w in new:
            if len(w) > 256:
                del known[w]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return self.units.encode(texts)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.merges.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def kept_codec(path: str) -> Codec:
    """A Python worker keeps its codec from task to task."""
    return Codec(path)


def digests(path: str, outputs: bool):
    """n_tokens and hashes of the ids and of the decoded text; outputs: the ids and the text too."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_codec(path)
        decimal = [str(i) for i in range(codec.merges.base)]
        for whole in batches:
            for b in pieces(whole, "text", 1 << 20):
                encoded = codec.encode(b["text"].to_pylist())
                counts, id_hashes, text_hashes, texts = [], [], [], []
                for ids in encoded:
                    text = codec.decode(ids)
                    counts.append(len(ids))
                    id_hashes.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                    text_hashes.append(hashlib.sha256(text.encode()).hexdigest())
                    texts.append(text)
                carried = [c for c in b.schema.names if c != "text"]
                columns = [b.column(b.schema.get_field_index(c)) for c in carried] + [pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
                names = [*carried, "n_tokens", "ids_sha256", "decoded_sha256"]
                if outputs:
                    columns += [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]).astype(np.int32)), pa.array(np.concatenate(encoded).astype(np.int32) if encoded else [], pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return f


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", outputs: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with outputs, ids and decoded.

    path: a byte-level BPE file of the tokenizers library, which every executor must be able to read. No special tokens
    are added; the strings of special tokens inside a text become those tokens. Null is an empty text, with no ids. Texts
    of any length are encoded whole: a single unbroken word of n bytes takes about n log(n) steps. Repeated rows, null
    ids and further columns of any name change nothing; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    return texts.mapInArrow(digests(path, outputs), f"doc_id {dict(texts.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * outputs)
