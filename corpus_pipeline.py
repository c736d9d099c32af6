"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs; all but the last return the columns of ``documents``.
Intermediate tables of a stage are dropped when a later stage of the same session starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import langid, packing, partenum, secrets, winnow
from docloom.llm.base import Scratch, id_remainder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR_PERCENT, NEAR_WORDS = 80, 5  # near duplicates: least Jaccard similarity, and words of a shingle

_HELD: list[Scratch] = []


def _scratch(spark: SparkSession) -> Scratch:
    """A new folder for a stage; those of earlier stages, whose results are stored, go."""
    while _HELD:
        _HELD.pop().drop()
    _HELD.append(Scratch(spark))
    return _HELD[-1]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those scored below the model's calibrated floor; learned as in op8, from the rows that
    are not held out.  With no language to learn every document with letters stays."""
    model = langid.fit(docs.where(id_remainder(F.col("doc_id"), 4) != 2))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    judged = langid.identify(docs, model, *[F.col(c) for c in COLUMNS])
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= model.floor)).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join the document with the smallest id stays, once."""
    links = partenum.jaccard_links(docs, _scratch(spark), NEAR_PERCENT, NEAR_WORDS)
    chosen = links.where("keeper").select("doc_id", "text_key").distinct()
    key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = docs.select(*COLUMNS, key.alias("text_key"))
    same = rows["doc_id"].eqNullSafe(chosen["doc_id"]) & (rows["text_key"] == chosen["text_key"])
    kept = rows.join(chosen, same, "left_semi")
    once = Window.partitionBy("doc_id", "text_key").orderBy("lang", "source", "n_chars")
    return kept.withColumn("_i", F.row_number().over(once)).where("_i = 1").select(*COLUMNS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a whole window of a benchmark item go."""
    _, found = winnow.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _scratch(spark))
    key = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(*COLUMNS, key.alias("text_key")).join(found.select("text_key"), "text_key", "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; no document goes."""
    _scratch(spark)
    return secrets.masked(docs.select(*COLUMNS), secrets.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts as pieces of sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER_FILE))


STAGES = [
    ("language_id", keep_known_language),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_benchmark_passages),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: Learned models and a tokenizer take part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    between = Scratch(spark)
    for _, stage in STAGES:
        docs = between.store(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
