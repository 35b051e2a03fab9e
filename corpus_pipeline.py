"""The corpus pipeline: documents through quality, duplicates, contamination and encoding.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``docs``.

Defined results, for all stages: null texts count as empty; rows with equal ids
are judged one by one where a stage reads one text at a time, and stay or go
together where it joins decisions by id; rows without an id are treated as rows
of one id; an empty table gives an empty result; columns other than ``doc_id``
and ``text`` are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tiergraph.llm.decontaminate import decontaminate
from tiergraph.llm.line_dedup import line_dedup
from tiergraph.llm.ngram_jaccard import ngram_jaccard
from tiergraph.llm.quality_classifier import keep_good, train
from tiergraph.llm.sentencepiece_nbest import encode_nbest
from tiergraph.plans.shared import written


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good stay."""
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines one stays, where it comes first; a document that loses all its text goes."""
    return line_dedup(docs)


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word sequences the one with the least id stays."""
    groups = ngram_jaccard(docs, n=5, percent=80)
    first = groups.where("doc_id <=> component_id").select(groups["doc_id"].alias("_first")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["_first"]), "left_semi")


def contamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.select(found["doc_id"].alias("_found")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_found"]), "left_anti")


def encoding(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's best segmentation, and the scores of the three best."""
    return encode_nbest(docs, n=3)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_copies),
    ("decontamination", contamination),
    ("sentencepiece", encoding),
]
#: SQL can't express the classifier and the segmentation.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
