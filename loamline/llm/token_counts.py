"""Token counts of texts of any length by overlapping chunks that are spliced where they agree.

A huge text is encoded in chunks that overlap. Neighbouring chunks are spliced at a place inside the overlap at which both
have a token boundary and which is proven stable: no piece of the vocabulary holds the two characters beside it next to
each other, so no merge, in any context, joins them, and what stands left of it can't change what stands right of it. If
an overlap has no such place it is widened, up to the whole rest of the text. Other texts are encoded in one call.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from loamline.llm.common import pieces, text_of

SPACE = "▁"


class PieceCounter:
    """Counts tokens as the sentencepiece library does, without begin and end."""

    def __init__(self, path: str, chunk: int = 16384, overlap: int = 512) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        spec = model.normalizer_spec
        #: the proof holds for merges of the text's own characters: a model that rewrites them gets whole texts
        self.divisible = model.trainer_spec.model_type == 2 and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        held = [p.piece for p in model.pieces if p.type in (1, 4)]  # ordinary pieces, and those that users have added
        self.pairs = {p[i : i + 2] for p in held for i in range(len(p) - 1)}
        self.single = {p for p in held if len(p) == 1}
        self.fallback = model.trainer_spec.byte_fallback

    def stable(self, text: str, at: int) -> bool:
        a, b = text[at - 1].replace(" ", SPACE), text[at].replace(" ", SPACE)
        return a + b not in self.pairs and (self.fallback or a in self.single or b in self.single)

    def boundaries(self, text: str, begin: int, end: int) -> np.ndarray:
        """Where the tokens of text[begin:end] begin, by the text's characters; the tokens of one character all do there."""
        found = self.library.encode(text[begin:end], return_type="proto")
        starts = (np.frombuffer(text[begin:end].encode(), np.uint8) & 0xC0) != 0x80  # the library's places are bytes
        return (np.cumsum(starts) - 1)[np.fromiter((p.begin for p in found.pieces), np.int64)] + begin

    def count(self, text: str) -> int:
        if len(text) <= 2 * self.chunk or not self.divisible:
            return len(self.library.encode(text))
        total, left, begin = 0, 0, 0  # tokens from left on, up to the next splice, are those of the chunk at begin
        while True:
            if begin + self.chunk + self.overlap >= len(text):
                return total + int((self.boundaries(text, begin, len(text)) >= left).sum())
            after, overlap = begin + self.chunk, self.overlap
            while True:
                end = min(len(text), after + overlap)
                own = self.boundaries(text, begin, end)
                if end == len(text):
                    return total + int((own >= left).sum())
                other = self.boundaries(text, after, end)
                common = np.intersect1d(own[own > after], other)
                splice = next((x for x in common.tolist() if self.stable(text, x)), None)
                if splice is not None:
                    break
                overlap *= 4
            total += int(((own >= left) & (own < splice)).sum())
            left, begin = splice, after


@lru_cache(maxsize=1)
def kept_counter(path: str, chunk: int, overlap: int) -> PieceCounter:
    """A Python worker keeps its model from task to task."""
    return PieceCounter(path, chunk, overlap)


def counted(path: str, limit: int, chunk: int, overlap: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_counter(path, chunk, overlap)
        for whole in batches:
            for b in pieces(whole, "text", 1 << 20):
                texts = b["text"].to_pylist()
                small = [t for t in texts if len(t) <= 2 * chunk]
                quick = iter(counter.library.encode(small, num_threads=1) if small else [])
                n = [len(next(quick)) if len(t) <= 2 * chunk else counter.count(t) for t in texts]
                carried = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in carried] + [pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[*carried, "n_tokens", "over_limit"])

    return f


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 4096, chunk: int = 16384, overlap: int = 512) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: a sentencepiece model, which every executor must be able to read. Null counts as an empty text: no bytes, no
    tokens. Texts of over 2 * chunk characters are encoded in overlapping chunks, whose memory is bounded by the chunk as
    long as overlaps have stable places. Repeated rows, null ids and further columns of any name change nothing; an empty
    table gives an empty result.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    return texts.mapInArrow(counted(path, limit, chunk, overlap), f"doc_id {dict(texts.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, over_limit boolean")
