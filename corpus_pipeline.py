"""A training-data pipeline of five operators over ``documents``; counted as part of ``geofeat.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofeat.llm import decontaminate as decon
from geofeat.llm import jaccard, langid, mixing, token_output
from geofeat.llm.common import materialize
from geofeat.llm.queries import tokenizer_path


#: Before the names of columns that stages add for their own use; a document table must not use it.
_NEW = "__stage_"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no text or no letter go; an unknown lang is filled with the prediction ('und' where no language can be learned).

    Columns of any other name come out as they went in. An empty table gives no rows.
    """
    known = langid.identify(docs, docs, prefix=_NEW).filter((F.col(f"{_NEW}lang_pred") != "und") | F.col("text").rlike(r"\p{L}"))
    return known.select(*[F.coalesce("lang", f"{_NEW}lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at 0.8: of each group the document with the least id stays, one without an id last. A document is an id and a text.

    Documents without words are no near copies of others; of equal rows one stays. Other columns are kept. An empty table gives no rows.
    """
    name = F.xxhash64(docs["doc_id"], docs["text"])
    groups = jaccard.jaccard_join(docs.select(name.alias("doc_id"), "text"), n=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("name"), "component_id").distinct()
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("name"))
    least = docs.select(docs["doc_id"], name.alias("name")).join(groups, "name").groupBy("component_id").agg(F.min(rank)["name"].alias("__stays"))
    stay = materialize(least.select("__stays"), "stay")
    mine, nth = f"{_NEW}name", f"{_NEW}nth"
    kept = docs.withColumn(mine, name).join(stay, F.col(mine) == F.col("__stays"), "left_semi")
    first = Window.partitionBy(mine).orderBy(F.xxhash64(*[F.col(c).cast("string") for c in docs.columns]))
    return kept.withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts, and n_chars follows; a document of nothing else goes. A null text has no passage and stays.

    Columns of any other name come out as they went in. An empty table or benchmark gives no hits.
    """
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = decon.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=keep, prefix=_NEW)
    spans = f"{_NEW}spans"
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    cut = decon.cut_spans(found.filter((F.size(spans) == 0) | (hit < F.col(f"{_NEW}n_words"))), spans)
    length = F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The exponent that reads no source more than twice while each is read once, as in op1; a document used twice is two rows. An empty table gives no rows."""
    return mixing.mixed_documents(docs, repetition=2.0)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, read back as doc_id, start, n_tokens, ids_crc32."""
    return token_output.token_output(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_files),
]

#: Model inference, FM-index search and tokenisation can't be put in SQL; tests/llm hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
