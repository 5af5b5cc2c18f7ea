"""One query per operator over its whole table, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofeat.llm import decontaminate as decon
from geofeat.llm import ann, conversation_trie, html_text, jaccard, langid, line_dedup, lm_score, merkle, mixing, pieces, pii, token_output
from geofeat.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), repetition=2.0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    n = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    base = ("email", "ip", "card", "phone")
    return found.select("doc_id", *[n(k) for k in (*base, "iban")], F.sha2(pii.joined(*base), 256).alias("base_sha256"), pii.joined(*base, "iban").alias("spans"), pii.scores(*base, "iban").alias("scores"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))


def op5_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decon.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"]), F.lit(0)).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), 3, 1)
    out = langid.identify(docs.select("doc_id", "text", held.alias("held_out")), docs.filter(~held))
    return out.select("doc_id", "held_out", "lang_pred", "score", "langs")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(_table(spark, sf_dir, "documents"), piece_model_path(), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    altered = {"n_chars": F.when(chosen, F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))}
    made = merkle.manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), "lang", "doc_id", altered)
    return merkle.verified(made).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda c: F.crc32(c.cast("string").cast("binary")) % 6
    return conversation_trie.trie(_table(spark, sf_dir, "conversations"), base=lambda c: c - c % 100, keep=first)


def queries() -> dict:
    every = (
        op1_source_mixing,
        op2_line_dedup,
        op3_html_extraction,
        op4_lm_scoring,
        op5_additive_quantisation,
        op6_token_output,
        op7_benchmark_decontamination,
        op8_ngram_jaccard_join,
        op9_pii,
        op10_language_id,
        op11_sentencepiece,
        op12_merkle_manifest,
        op13_conversation_trie,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_conversation_trie": conversation_trie.ORACLE}
