"""Run-log analytics over trace events (one row per event)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.plans.scale import running_sum

# Decisions that stand for an attempt without execution, states without result.
ATTEMPT_WITHOUT_RUN = ["llm_fallo", "sin_script", "script_repetido"]
NOT_ACHIEVED = ["fallida", "omitida", "pendiente"]
WRITER = "redactor"
SEQ_BUCKET = 65536


def calls() -> Column:
    return F.col("tipo") == "llamada"


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")


def agent_totals(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens, latency and errors per agent; NULL counts as zero."""
    return trace.where(calls()).groupBy(*keys, "agente").agg(
        F.count("*").alias("llamadas"),
        F.sum(zero("tokens_entrada")).cast("bigint").alias("tokens_entrada"),
        F.sum(zero("tokens_salida")).cast("bigint").alias("tokens_salida"),
        F.round(F.round(F.sum(zero("latencia_s")), 6), 1).alias("latencia_s"),
        count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errores"),
    )


def code_attempts() -> Column:
    ran = (F.col("tipo") == "ejecucion") & (F.col("agente") == "ejecutor") & (F.col("subtarea") != "notebook")
    skipped = (F.col("tipo") == "decision") & F.col("decision").isin(*ATTEMPT_WITHOUT_RUN)
    return count_if(F.coalesce(ran, F.lit(False))) + count_if(F.coalesce(skipped, F.lit(False)))


def rejections(source: str) -> Column:
    return count_if(
        F.coalesce((F.col("tipo") == "decision") & (F.col("decision") == "rechazado") & (F.col("por") == source), F.lit(False))
    )


def run_summary(trace: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run, in a single aggregation pass."""
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return trace.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.when(F.col("tipo") == "fin", F.col("status")), F.when(F.col("tipo") == "fin", F.col("seq"))),
                   F.lit("sin_fin")).alias("status"),
        code_attempts().alias("intentos_codigo"),
        rejections("codigo").alias("rechazos_codigo"),
        rejections("llm").alias("rechazos_llm"),
        F.sum(F.when(calls(), zero("tokens_entrada")).otherwise(0)).cast("bigint").alias("tokens_entrada"),
        F.sum(F.when(calls(), zero("tokens_salida")).otherwise(0)).cast("bigint").alias("tokens_salida"),
        F.round(F.round(F.max(epoch) - F.min(epoch), 6), 1).alias("duracion_s"),
        F.coalesce(F.bool_or(F.col("decision") == "presupuesto_agotado"), F.lit(False)).cast("int").alias("presupuesto_agotado"),
        F.coalesce(F.min_by(F.when(calls(), F.col("modelo")), F.when(calls(), F.col("seq"))), F.lit("")).alias("modelo"),
    )


def running_tokens(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens used up to and including each call, hot runs included."""
    c = trace.where(calls()).withColumn("tokens", (zero("tokens_entrada") + zero("tokens_salida")).cast("bigint"))
    return running_sum(c, keys, ["seq"], F.floor(F.col("seq") / SEQ_BUCKET), {"consumido": "tokens"})


def budget_audit(trace: DataFrame, keys: list[str], budget: int, reserve: int) -> DataFrame:
    """What was available before each call; only the writer may use the reserve."""
    limit = F.lit(budget) - F.when(F.col("agente") == WRITER, 0).otherwise(reserve)
    left = limit - (F.col("consumido") - F.col("tokens"))
    return running_tokens(trace, keys).withColumn("disponible", left.cast("bigint")).withColumn(
        "bloqueada", (left <= 0).cast("int"))


def attempt_numbers(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Number of each execution within its subtask, by prefix counts."""
    e = trace.where(F.col("tipo") == "ejecucion").withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(e, [*keys, "subtarea"], ["seq"], F.floor(F.col("seq") / SEQ_BUCKET), {"intento": "_one"})


def final_subtask_status(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Last decided state of each subtask."""
    state = (
        F.when(F.col("decision") == "aprobado", "aprobada")
        .when(F.col("decision") == "omitida", "omitida")
        .when(F.col("decision").isin("rechazado", "llm_fallo", "script_repetido"), "fallida")
        .otherwise("pendiente")
    )
    d = trace.where(F.col("tipo") == "decision")
    return d.groupBy(*keys, "subtarea").agg(F.max_by(state, "seq").alias("status"))


def subtask_panorama(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Per subtask: executions, rejections by source, programmer calls and tokens, final state."""
    prog = calls() & (F.col("agente") == "programador")
    work = trace.where(F.col("subtarea").isNotNull()).groupBy(*keys, "subtarea").agg(
        count_if(F.col("tipo") == "ejecucion").alias("ejecuciones"),
        rejections("codigo").alias("rechazos_codigo"),
        rejections("llm").alias("rechazos_llm"),
        count_if(prog).alias("llamadas_programador"),
        F.sum(F.when(prog, zero("tokens_entrada")).otherwise(0)).cast("bigint").alias("prog_entrada"),
        F.sum(F.when(prog, zero("tokens_salida")).otherwise(0)).cast("bigint").alias("prog_salida"),
    )
    return final_subtask_status(trace, keys).join(work, [*keys, "subtarea"], "left")


def run_status(subtasks: DataFrame, keys: list[str]) -> DataFrame:
    """``completado`` when every subtask is approved, ``parcial`` when some is, else ``fallido``."""
    ok = count_if(F.col("status") == "aprobada")
    return subtasks.groupBy(*keys).agg(ok.alias("aprobadas"), F.count("*").alias("total")).withColumn(
        "estado",
        F.when(F.col("aprobadas") == 0, "fallido").when(F.col("aprobadas") == F.col("total"), "completado").otherwise("parcial"),
    )
