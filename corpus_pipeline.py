"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each one of the operators of ``tillroll.llm``; every stage reads
what the one before it has written:

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join: one document of each group of near duplicates stays;
3. suffix-array dedup: byte strings that also start earlier are cut out;
4. PII: spans are replaced by their kind;
5. best-fit packing: what is left is tokenized and packed.

All but the last return the columns of documents; ``n_chars`` follows the
text where a stage changes it. Nulls, empty texts and repeated rows are
treated as the operators say; rows with a null id pass every filter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import jaccard, packing, pii, quality, repeats
from tillroll.llm.common import Scratch, split_by_ids, table
from tillroll.llm.queries import KEEP_SCORE, WORD_BPE


# What a stage carries beside id and text: all other columns of documents, as one.
_ROW = "__row"


def _carried(docs: DataFrame) -> DataFrame:
    """(doc_id, text, and one struct of the other columns), so that no column can be taken for an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*others).alias(_ROW))


def _restored(carried: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again, with their ``text`` and (if there) ``n_chars`` as ``text`` now is."""
    columns = {c: F.col("text") if c == "text" else F.col(f"{_ROW}.`{c}`") for c in docs.columns}
    if text is not None:
        columns["text"] = F.when(F.col("text").isNotNull(), text)
        if "n_chars" in columns:
            length = F.length(text).cast(docs.schema["n_chars"].dataType)
            columns["n_chars"] = F.when(F.col("text").isNull(), columns["n_chars"]).otherwise(length)
    return carried.select(*[c.alias(name) for name, c in columns.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = quality.score(_carried(docs), model, out="score")
    return _restored(scored.filter(F.col("score") >= KEEP_SCORE), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = jaccard.near_duplicates(docs.select("doc_id", "text"))
    gone = Scratch(spark, "gone").keep(
        placed.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct()
    )
    touched, rest = split_by_ids(_carried(docs), "doc_id", gone)
    kept = touched.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    return _restored(kept.unionByName(rest), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _restored(repeats.remove_repeats(_carried(docs), as_text=True), docs, F.col("kept"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask(pii.find(_carried(docs), out="spans"), spans="spans")
    return _restored(masked, docs, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# The classifier and the tokenizer are no SQL; tests hold the rows against brute force.
ORACLE_SQL = None
