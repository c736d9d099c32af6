"""Registered streaming plans: drained with ``availableNow`` and then read as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.plans import runlog_plans as rp
from docloom.streaming import events as ev
from docloom.streaming import guard as gd


def stream_events_daily(spark, sf):
    u = ev.drain(ev.daily_totals(ev.event_stream(spark, sf)), "update")
    r = ev.latest(u, ["day", "event_type"], ["n", "total"])
    return r.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_spend(spark, sf):
    u = ev.drain(ev.spend_by_run(ev.event_stream(spark, sf), 500.0), "update")
    return ev.latest(u, ["user_id"], ["n", "spent", "over"]).select("user_id", "n", F.round("spent", 2).alias("spent"), "over")


def guard_rows(trace):
    """Trace rows with the tokens of a call and the fingerprint of a script."""
    return trace.withColumn("tokens", (F.coalesce("tokens_entrada", F.lit(0)) + F.coalesce("tokens_salida", F.lit(0))).cast("bigint")).withColumn(
        "huella", F.md5((F.floor("value") % 40).cast("string")))


def stream_guard(spark, sf):
    """Budget with the writer's reserve, attempts and repeated scripts, kept as state while the trace streams in."""
    with gd.rocks_state(spark):
        out = ev.drain(gd.guarded(guard_rows(rp.trace_of(ev.event_stream(spark, sf))), rp.RUN, rp.BUDGET, rp.RESERVE), "append")
    return out.drop("epoch")


QUERIES = {f.__name__: f for f in (stream_events_daily, stream_spend, stream_guard)}

ORACLES = {
    "stream_guard": f"""WITH {rp.TRACE}, x AS (SELECT variante, repeticion, tarea, seq, tipo, agente, subtarea, coalesce(tokens_entrada, 0) + coalesce(tokens_salida, 0) AS tokens, md5((floor(value)::BIGINT % 40)::VARCHAR) AS huella FROM tr WHERE tipo IN ('llamada', 'ejecucion')),
        b AS (SELECT *, {rp.BUDGET} - CASE WHEN agente = 'redactor' THEN 0 ELSE {rp.RESERVE} END - (sum(CASE WHEN tipo = 'llamada' THEN tokens ELSE 0 END) OVER (PARTITION BY variante, repeticion, tarea ORDER BY seq) - tokens) AS d,
          row_number() OVER (PARTITION BY variante, repeticion, tarea, tipo, subtarea ORDER BY seq) AS n, row_number() OVER (PARTITION BY variante, repeticion, tarea, tipo, subtarea, huella ORDER BY seq) AS r FROM x)
        SELECT variante, repeticion, tarea, seq, tipo, agente, subtarea, CASE WHEN tipo = 'llamada' THEN d::BIGINT END AS disponible, CASE WHEN tipo = 'llamada' THEN (d <= 0)::INT END AS bloqueada,
          CASE WHEN tipo = 'ejecucion' THEN n END AS intento, CASE WHEN tipo = 'ejecucion' THEN (r > 1)::INT END AS repetida FROM b""",
    "stream_events_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "stream_spend": "SELECT user_id, count(*) AS n, round(sum(value), 2) AS spent, (sum(value) > 500)::INT AS over FROM events GROUP BY user_id",
}
