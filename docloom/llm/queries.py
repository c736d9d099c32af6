"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import alignment, crf, hilbert, hmm, langid, licenses, multiprobe, packing, partenum, periods, secrets, urlglob, winnow
from docloom.llm.base import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(_table(spark, sf_dir, "documents"), Scratch(spark))


def op2_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_links(_table(spark, sf_dir, "documents"), Scratch(spark)).select("doc_id", "n_shingles", "component_id", "n_links")


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER_FILE))


def op4_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.nearest(_table(spark, sf_dir, "embeddings"), Scratch(spark))


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs), F.col("doc_id").cast("long").alias("doc_id"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.curve_shards(_table(spark, sf_dir, "documents"), Scratch(spark)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Scratch(spark))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), F.col("doc_id").cast("long").alias("doc_id"))


def op10_glob_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlglob.judge_urls(_table(spark, sf_dir, "pages"))


def op11_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = crf.train(crf.examples(spark))
    return crf.scan(_table(spark, sf_dir, "documents"), model, F.col("doc_id").cast("long").alias("doc_id"))


def op12_interval_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(f) for f in (alignment.A_FILE, alignment.B_FILE, alignment.RANKS_FILE)]
    return alignment.align_documents(_table(spark, sf_dir, "documents"), Scratch(spark), *paths)


def op13_square_catching(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(_table(spark, sf_dir, "documents"), F.col("doc_id").cast("long").alias("doc_id"), prepare=periods.periodic_tail)
    lines = F.transform("runs", lambda r: F.concat(F.array_join(r.cast("array<string>"), ","), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_hidden_markov": op1_hidden_markov,
    "op2_partenum_join": op2_partenum_join,
    "op3_vector_packing": op3_vector_packing,
    "op4_multiprobe_lsh": op4_multiprobe_lsh,
    "op5_markov_secrets": op5_markov_secrets,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_winnowing": op7_winnowing,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_glob_automaton": op10_glob_automaton,
    "op11_crf_personal_data": op11_crf_personal_data,
    "op12_interval_coalescing": op12_interval_coalescing,
    "op13_square_catching": op13_square_catching,
}
ORACLES = {
    "op7_winnowing": winnow.WINNOW_SQL,
    "op10_glob_automaton": urlglob.URL_SQL,
}
