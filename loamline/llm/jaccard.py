"""Near-duplicates by word shingles: SimHash's index first, then an LSH forest's completion at a Jaccard similarity of 0.8.

Texts of the same words meet as one. The Gray-order index of SimHash links fingerprints at few differing bits, and such
pairs are confirmed on their shingle sets. That finds most copies, but no small radius reaches all pairs at 0.8, so the
rest is found by the forest of ``forest.py``, which compares what is left between different components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import keep, text_of, written
from loamline.llm.components import components
from loamline.llm.forest import labels_of, represented, similar_links
from loamline.llm.simhash import fingerprinted
from loamline.llm.simhash import links_of as simhash_links


def index_links(base: DataFrame, size: int, radius: int) -> DataFrame:
    """Pairs (a, b) of base's reps that SimHash's index links, each fingerprint standing for one of its reps."""
    prints = keep(base.select("rep", "text").mapInArrow(fingerprinted(size), "rep bigint, fp bigint"))
    heads = keep(prints.groupBy("fp").agg(F.min("rep").alias("head")))
    own = prints.join(heads, "fp").where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b"))
    near = simhash_links(heads.select("fp"), radius, 2048)
    a, b = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab")
    return own.unionByName(near.join(a, "a").join(b, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, component_id.

    A-Z become lower case, words part at white space; a text's set holds its shingles of ``shingle`` words (fewer words:
    the whole sequence). Texts of the same words, and those whose sets' Jaccard similarity is 0.8 or more, are linked;
    component_id is the least doc_id that links reach, the row's own included. Null, empty and blank texts are the same.
    radius is the index's, and changes no result. A null id takes part without being the least. Repeated rows come out as
    often as they come in. Other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    found = texts.mapInArrow(represented, f"doc_id {kind}, rep bigint, text string")
    prints = keep(found.select("doc_id", "rep"))
    base = written(found.select("rep", "text").dropDuplicates(["rep"]))
    labels = labels_of(base, shingle, 4, 5)
    tied = written(components(similar_links(base, labels, shingle, 4, 5, index_links(base, shingle, radius))))
    least = prints.groupBy("rep").agg(F.min("doc_id").alias("least"))
    classes = keep(least.join(tied, least["rep"] == tied["node"], "left").select("rep", F.coalesce("root", "rep").alias("root"), "least"))
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = keep(classes.join(roots, "root").select("rep", "component_id"))
    return prints.join(labelled, "rep").select("doc_id", "component_id")
