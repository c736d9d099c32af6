"""Registered plans over the event log, read as the trace of many runs, and over rater labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.figures import mean_range, short_number
from docloom.functions.text import clip, table_row
from docloom.operators import agreement as agr
from docloom.operators import runlog as rl
from docloom.plans.scale import top_k
from docloom.session import table
from docloom.sources import readers

RUN = ["variante", "repeticion", "tarea"]
BUDGET, RESERVE = 20000, 2000


def trace(spark, sf):
    """Events as trace rows: user → run, event type → kind, properties → agent, subtask, tokens."""
    return trace_of(table(spark, sf, "events"))


def trace_of(events):
    """The trace rows of a table or stream of events."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = events.withColumn("k", k)
    t = F.col("event_type")
    tipo = F.when(t.isin("view", "click"), "llamada").when(t == "purchase", "ejecucion").when(t == "signup", "decision").otherwise("fin")
    agents = ["planificador", "programador", "critico", "redactor", "indexador"]
    decisions = ["rechazado", "aprobado", "llm_fallo", "script_repetido", "presupuesto_agotado", "omitida"]
    pick = lambda names, m: F.get(F.array(*map(F.lit, names)), (F.col("k") % m).cast("int"))
    e = e.withColumn("tipo", tipo).withColumn("decision", F.when(F.col("tipo") == "decision", pick(decisions, 6)))
    call = F.col("tipo") == "llamada"
    return e.select(
        F.when(F.col("user_id") % 2 == 0, "completo").otherwise("sin_grafo").alias("variante"),
        (F.floor(F.col("user_id") / 2) % 2 + 1).cast("bigint").alias("repeticion"),
        F.concat(F.lit("t"), F.floor(F.col("user_id") / 4).cast("string")).alias("tarea"),
        F.col("event_id").alias("seq"), "ts", "tipo",
        F.when(F.col("tipo") == "ejecucion", "ejecutor").otherwise(pick(agents, 5)).alias("agente"),
        F.concat(F.lit("T"), (F.col("k") % 7 + 1).cast("string")).alias("subtarea"),
        F.when(call, F.concat(F.lit("m"), (F.col("k") % 3).cast("string"))).alias("modelo"),
        F.when(call, F.col("k") * 10).alias("tokens_entrada"),
        F.when(call, F.floor("value")).alias("tokens_salida"),
        F.when(call, F.col("value")).alias("latencia_s"),
        F.when(F.col("value") > 100, "timeout").alias("error"),
        F.when(F.col("tipo") == "ejecucion", F.when(F.col("value") < 60, 0).otherwise(1)).alias("returncode"),
        "decision",
        F.when(F.col("decision") == "rechazado", F.when(F.col("value") < 40, "codigo").otherwise("llm")).alias("por"),
        F.when(F.col("tipo") == "fin", F.when(F.col("value") < 50, "completado").otherwise("parcial")).alias("status"),
        "value",
    )


TRACE = """t0 AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k,
   CASE WHEN event_type IN ('view','click') THEN 'llamada' WHEN event_type = 'purchase' THEN 'ejecucion' WHEN event_type = 'signup' THEN 'decision' ELSE 'fin' END AS tipo FROM events),
 t1 AS (SELECT *, CASE WHEN tipo = 'decision' THEN (['rechazado','aprobado','llm_fallo','script_repetido','presupuesto_agotado','omitida'])[(k % 6)::INT + 1] END AS decision FROM t0),
 tr AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'completo' ELSE 'sin_grafo' END AS variante, ((user_id // 2) % 2 + 1)::BIGINT AS repeticion, 't' || (user_id // 4)::VARCHAR AS tarea,
   event_id AS seq, ts, tipo, CASE WHEN tipo = 'ejecucion' THEN 'ejecutor' ELSE (['planificador','programador','critico','redactor','indexador'])[(k % 5)::INT + 1] END AS agente,
   'T' || (k % 7 + 1)::VARCHAR AS subtarea, CASE WHEN tipo = 'llamada' THEN 'm' || (k % 3)::VARCHAR END AS modelo,
   CASE WHEN tipo = 'llamada' THEN k * 10 END AS tokens_entrada, CASE WHEN tipo = 'llamada' THEN floor(value)::BIGINT END AS tokens_salida, CASE WHEN tipo = 'llamada' THEN value END AS latencia_s,
   CASE WHEN value > 100 THEN 'timeout' END AS error, CASE WHEN tipo = 'ejecucion' THEN CASE WHEN value < 60 THEN 0 ELSE 1 END END AS returncode,
   decision, CASE WHEN decision = 'rechazado' THEN CASE WHEN value < 40 THEN 'codigo' ELSE 'llm' END END AS por,
   CASE WHEN tipo = 'fin' THEN CASE WHEN value < 50 THEN 'completado' ELSE 'parcial' END END AS status, value FROM t1)"""


def agent_totals(spark, sf):
    return rl.agent_totals(trace(spark, sf), RUN)


def run_summary(spark, sf):
    return rl.run_summary(trace(spark, sf), RUN)


def code_attempts(spark, sf):
    return trace(spark, sf).groupBy(*RUN, "subtarea").agg(rl.code_attempts().alias("intentos"))


def rejections_by_source(spark, sf):
    return trace(spark, sf).groupBy("variante", "repeticion").agg(
        rl.rejections("codigo").alias("codigo"), rl.rejections("llm").alias("llm"))


def status_histogram(spark, sf):
    return rl.final_subtask_status(trace(spark, sf), RUN).groupBy("variante", "status").agg(F.count("*").alias("n"))


def mean_range_by_task(spark, sf):
    s = rl.run_summary(trace(spark, sf), RUN)
    return s.groupBy("tarea", "variante").agg(
        mean_range(F.avg("tokens_entrada"), F.min("tokens_entrada"), F.max("tokens_entrada")).alias("tokens_entrada"),
        mean_range(F.avg("intentos_codigo"), F.min("intentos_codigo"), F.max("intentos_codigo")).alias("intentos"),
    )


def variant_totals(spark, sf):
    """Sum over tasks inside each repetition, then mean and range over repetitions."""
    s = rl.run_summary(trace(spark, sf), RUN)
    per_rep = s.groupBy("variante", "repeticion").agg(
        F.sum("tokens_entrada").alias("te"), F.sum("tokens_salida").alias("tsal"), F.sum("intentos_codigo").alias("ic"))
    return per_rep.groupBy("variante").agg(
        F.count("*").alias("repeticiones"),
        *[mean_range(F.avg(c), F.min(c), F.max(c)).alias(n) for c, n in (("te", "tokens_entrada"), ("tsal", "tokens_salida"), ("ic", "intentos"))])


def share_of_total(spark, sf):
    """Share of tokens per agent: mean over repetitions against the variant's mean."""
    a = rl.agent_totals(trace(spark, sf), ["variante", "repeticion"])
    t = F.sum(F.col("tokens_entrada") + F.col("tokens_salida"))
    reps = a.groupBy("variante").agg(t.alias("total"))
    ag = a.groupBy("variante", "agente").agg(t.alias("tokens"), F.sum("llamadas").alias("llamadas"))
    return ag.join(reps, "variante").select(
        "variante", "agente", "llamadas", F.round(100.0 * F.col("tokens") / F.col("total"), 4).alias("pct"))


def failing_groups(spark, sf):
    """Failures per decision with one detail per repetition, joined in repetition order."""
    d = trace(spark, sf).where((F.col("tipo") == "decision") & (F.col("decision") != "aprobado"))
    per_rep = d.groupBy("variante", "decision", "repeticion").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("repeticion", "n")))
    return per_rep.groupBy("variante", "decision").agg(
        F.array_join(F.transform(parts, lambda p: F.concat(
            F.lit("r"), p["repeticion"].cast("string"), F.lit(": "), p["n"].cast("string"))), " / ").alias("detalle"))


def running_tokens(spark, sf):
    return rl.running_tokens(trace(spark, sf), RUN).select(*RUN, "seq", "consumido")


def running_tokens_by_agent(spark, sf):
    return rl.running_tokens(trace(spark, sf), ["agente"]).select("agente", "seq", "consumido")


def budget_audit(spark, sf):
    return rl.budget_audit(trace(spark, sf), RUN, BUDGET, RESERVE).select(*RUN, "seq", "agente", "disponible", "bloqueada")


def attempt_numbers(spark, sf):
    return rl.attempt_numbers(trace(spark, sf), RUN).select(*RUN, "subtarea", "seq", "intento")


def attempt_cap(spark, sf):
    n = trace(spark, sf).groupBy(*RUN, "subtarea").agg(rl.rejections("codigo").alias("c"), rl.rejections("llm").alias("l"))
    return n.select(*RUN, "subtarea", ((F.col("c") + F.col("l")) >= 3).cast("int").alias("tope"))


def first_last_event(spark, sf):
    return trace(spark, sf).groupBy(*RUN).agg(
        F.min("seq").alias("primera"), F.max("seq").alias("ultima"),
        F.min_by("tipo", "seq").alias("tipo_primera"), F.max_by("tipo", "seq").alias("tipo_ultima"))


def decision_histogram(spark, sf):
    return trace(spark, sf).where(F.col("tipo") == "decision").groupBy("tarea", "decision").agg(F.count("*").alias("n"))


def subtask_panorama(spark, sf):
    return rl.subtask_panorama(trace(spark, sf), RUN)


def run_status(spark, sf):
    return rl.run_status(rl.final_subtask_status(trace(spark, sf), RUN), RUN)


def missing_result_notes(spark, sf):
    """One note per subtask without result, plus one per run that ran out of budget."""
    t = trace(spark, sf)
    s = rl.final_subtask_status(t, RUN).where(F.col("status").isin(*rl.NOT_ACHIEVED))
    notes = s.select(*RUN, F.concat(F.lit("La subtarea "), "subtarea", F.lit(" no tiene resultado ("), "status", F.lit(")")).alias("nota"))
    out = t.where(F.col("decision") == "presupuesto_agotado").select(*RUN).distinct().withColumn(
        "nota", F.lit("El presupuesto de tokens se agotó: se entrega lo que se alcanzó a medir."))
    return notes.unionByName(out)


def evidence_lines(spark, sf):
    """Readable lines of the events that show a brake at work."""
    t = trace(spark, sf)
    dec = t.where((F.col("tipo") == "decision") & F.col("decision").isin("rechazado", "presupuesto_agotado"))
    run = t.where((F.col("tipo") == "ejecucion") & F.col("error").isNotNull())
    writer = t.where(rl.calls() & (F.col("agente") == rl.WRITER))
    num = F.concat(F.lit("- `#"), F.col("seq").cast("string"), F.lit("` "))
    return (
        dec.select("seq", F.concat(num, "agente", F.lit(" → **"), "decision", F.lit("** ["), "subtarea", F.lit("]")).alias("linea"))
        .unionByName(run.select("seq", F.concat(num, F.lit("ejecutor ["), "subtarea", F.lit("]: returncode="),
                                                F.col("returncode").cast("string"), F.lit(", error: "), "error").alias("linea")))
        .unionByName(writer.select("seq", F.concat(num, F.lit("redactor redacta ("), F.col("tokens_entrada").cast("string"), F.lit("+"),
                                                   F.col("tokens_salida").cast("string"), F.lit(" tokens)")).alias("linea")))
    )


def summary_with_checks(spark, sf):
    """Run summaries joined with evaluated checks; runs without an evaluation stay, with NULLs."""
    s = rl.run_summary(trace(spark, sf), RUN).select(*RUN, "status", "tokens_entrada")
    lab = table(spark, sf, "labels").select(
        F.concat(F.lit("t"), (F.col("doc_id")).cast("string")).alias("tarea"), "quality")
    checks = lab.groupBy("tarea").agg(F.sum("quality").cast("bigint").alias("aprobadas"), F.count("*").alias("total"))
    return s.join(checks, "tarea", "left")


def published_files(spark, sf):
    """For each expected file the producer to publish: exact path first, then latest in the plan."""
    t = trace(spark, sf)
    made = t.where((F.col("tipo") == "ejecucion") & (F.col("returncode") == 0)).select(
        *RUN, F.concat(F.lit("output/"), "subtarea", F.lit(".csv")).alias("rel"),
        F.struct((F.col("error").isNull()).cast("int").alias("exacto"), "seq").alias("orden"))
    best = made.groupBy(*RUN, "rel").agg(F.max("orden").alias("o"))
    expected = t.select(*RUN, F.concat(F.lit("output/"), "subtarea", F.lit(".csv")).alias("rel")).distinct()
    return expected.join(best, [*RUN, "rel"], "left").select(
        *RUN, "rel", F.col("o.seq").alias("productor"), F.col("o.seq").isNull().cast("int").alias("falta"))


def markdown_table(spark, sf):
    """Rows of a Markdown report table, one line per variant and agent."""
    a = rl.agent_totals(trace(spark, sf), ["variante"])
    return a.select(table_row(F.col("variante"), F.col("agente"), F.col("llamadas").cast("string"),
                              short_number(F.col("tokens_entrada").cast("double"))).alias("linea"))


def latest_calls(spark, sf):
    """The three latest calls of each run, clipped for display."""
    c = trace(spark, sf).where(rl.calls())
    out = top_k(c, RUN, [F.col("seq").desc()], 3)
    return out.select(*RUN, F.col("rank").cast("bigint").alias("rank"), "seq",
                      clip(F.concat_ws(" ", "agente", "modelo"), 12, " … [{n} car. más]").alias("linea"))


def _verdicts(spark, sf):
    """Labels as (golden, judge reply): quality is the golden value, toxicity shapes the reply."""
    good = F.col("toxic") == 0
    word = F.when(good, "true").otherwise("false")
    m = F.col("doc_id") % 5
    raw = (F.when(m == 0, word).when(m == 1, F.concat(F.lit('"'), F.initcap(word), F.lit('"')))
           .when(m == 2, F.lit('{"ok": "quizá"}'))
           .otherwise(F.concat(F.lit('{"ok": '), word, F.lit(', "razon": "r'), F.col("doc_id").cast("string"), F.lit('"}'))))
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("golden"), agr.verdict(raw).alias("v")).select(
        "doc_id", "golden", F.col("v.ok").alias("juez"), "v.razon", "v.formato")


def verdict_formats(spark, sf):
    return _verdicts(spark, sf).groupBy("formato").agg(F.count("*").alias("n"))


def judge_agreement(spark, sf):
    return agr.agreement(_verdicts(spark, sf), "golden", "juez")


def judge_false_positives(spark, sf):
    return _verdicts(spark, sf).where((F.col("golden") == 0) & (F.col("juez") == 1)).select("doc_id", "razon", "formato")


def kappa_by_language(spark, sf):
    lab = table(spark, sf, "labels").withColumn("juez", 1 - F.col("toxic"))
    return agr.agreement(lab.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id"), "quality", "juez", ["lang"])


def judge_by_run(spark, sf):
    """Judge verdicts joined to the golden results on variant, repetition, task and check; unanswered checks are counted."""
    key = [F.col("lang").alias("variante"), (F.col("doc_id") % 3).alias("repeticion"), F.col("source").alias("tarea"), F.concat(F.lit("K"), F.col("doc_id").cast("string")).alias("check")]
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    golden = d.join(table(spark, sf, "labels"), "doc_id").select(*key, F.col("quality").alias("golden"))
    judge = d.where(F.col("doc_id") % 4 != 0).select(*key, (F.col("n_chars") % 2 == 0).cast("int").alias("juez"))
    j = golden.join(judge, ["variante", "repeticion", "tarea", "check"], "left")
    return agr.agreement(j, "golden", "juez", ["variante", "repeticion"])


def approved_outputs(spark, sf):
    """Files that an approved subtask hands on: data and figures, never its script or console output."""
    name = F.element_at(F.array(*map(F.lit, ["script.py", "r.json", "t.csv", "f.png", "stdout.txt", "stderr.txt", "d.npy", "nota.txt"])), (F.col("page_id") % 8 + 1).cast("int"))
    t = F.concat(F.lit("T"), (F.col("page_id") % 50).cast("string"))
    files = table(spark, sf, "pages").select("page_id", t.alias("subtarea"), F.concat(F.lit("subtareas/"), t, F.lit("/"), name).alias("path"))
    approved = table(spark, sf, "events").where("event_type <> 'error'").groupBy(F.concat(F.lit("T"), (F.col("user_id") % 70).cast("string")).alias("subtarea")).agg(
        F.count("*").alias("v")).where(F.col("v") % 3 != 0)
    return readers.approved_outputs(files, approved, "subtarea").select("page_id", "path")


QUERIES = {f.__name__: f for f in (
    agent_totals, run_summary, code_attempts, rejections_by_source, status_histogram, mean_range_by_task, variant_totals,
    share_of_total, failing_groups, running_tokens, running_tokens_by_agent, budget_audit, attempt_numbers, attempt_cap,
    first_last_event, decision_histogram, subtask_panorama, run_status, missing_result_notes, evidence_lines,
    summary_with_checks, published_files, markdown_table, latest_calls, verdict_formats, judge_agreement,
    judge_false_positives, kappa_by_language, judge_by_run, approved_outputs)}

_R = "variante, repeticion, tarea"
_ATT = """(count(*) FILTER (WHERE tipo = 'ejecucion' AND agente = 'ejecutor' AND subtarea <> 'notebook') + count(*) FILTER (WHERE tipo = 'decision' AND decision IN ('llm_fallo','sin_script','script_repetido')))"""
_REJ = "count(*) FILTER (WHERE decision = 'rechazado' AND por = '{}')"
_SUM = f"""sm AS (SELECT {_R}, coalesce(arg_max(status, seq) FILTER (WHERE tipo = 'fin'), 'sin_fin') AS status, {_ATT} AS intentos_codigo,
  {_REJ.format('codigo')} AS rechazos_codigo, {_REJ.format('llm')} AS rechazos_llm,
  coalesce(sum(tokens_entrada),0)::BIGINT AS tokens_entrada, coalesce(sum(tokens_salida),0)::BIGINT AS tokens_salida,
  round(round((epoch_us(max(ts)) - epoch_us(min(ts)))/1e6, 6), 1) AS duracion_s, coalesce(bool_or(decision = 'presupuesto_agotado'), false)::INT AS presupuesto_agotado,
  coalesce(arg_min(modelo, seq) FILTER (WHERE tipo = 'llamada'), '') AS modelo FROM tr GROUP BY ALL)"""
_FIN = f"""fs AS (SELECT {_R}, subtarea, arg_max(CASE WHEN decision = 'aprobado' THEN 'aprobada' WHEN decision = 'omitida' THEN 'omitida'
  WHEN decision IN ('rechazado','llm_fallo','script_repetido') THEN 'fallida' ELSE 'pendiente' END, seq) AS status FROM tr WHERE tipo = 'decision' GROUP BY ALL)"""


def _num(x: str) -> str:
    return f"(CASE WHEN abs({x} - round_even({x}, 0)) < 1e-9 OR abs({x}) >= 100 THEN round_even({x}, 0)::BIGINT::VARCHAR ELSE printf('%.1f', round_even({x} * 10, 0) / 10) END)"


def _rng(c: str) -> str:
    m = f"avg({c})::DOUBLE"
    return f"(CASE WHEN min({c}) = max({c}) THEN {_num(f'min({c})::DOUBLE')} ELSE {_num(m)} || ' (' || {_num(f'min({c})::DOUBLE')} || '–' || {_num(f'max({c})::DOUBLE')} || ')' END)"


_AG = """count(*) AS llamadas, sum(coalesce(tokens_entrada,0))::BIGINT AS tokens_entrada, sum(coalesce(tokens_salida,0))::BIGINT AS tokens_salida"""
_VER = """vd AS (SELECT doc_id, quality AS golden, CASE WHEN doc_id % 5 = 2 THEN NULL WHEN toxic = 0 THEN 1 ELSE 0 END::INT AS juez,
  CASE WHEN doc_id % 5 IN (3,4) THEN 'r' || doc_id::VARCHAR ELSE '' END AS razon,
  CASE doc_id % 5 WHEN 0 THEN 'sin_razon' WHEN 1 THEN 'sin_razon' WHEN 2 THEN 'faltante' ELSE 'completo' END AS formato FROM labels)"""


def _agree(src: str, keys: str = "") -> str:
    g = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""c AS (SELECT {g}count(*) FILTER (WHERE golden=1 AND juez=1) AS vp, count(*) FILTER (WHERE golden=1 AND juez=0) AS fn,
      count(*) FILTER (WHERE golden=0 AND juez=1) AS fp, count(*) FILTER (WHERE golden=0 AND juez=0) AS vn, count(*) FILTER (WHERE juez IS NULL) AS sin_veredicto FROM {src} {by}),
      m AS (SELECT *, vp+fn+fp+vn AS juzgadas, ((vp+vn)/nullif(vp+fn+fp+vn,0)::DOUBLE) AS po, ((vp+fn)/nullif(vp+fn+fp+vn,0)::DOUBLE) AS pa, ((vp+fp)/nullif(vp+fn+fp+vn,0)::DOUBLE) AS pb FROM c)
      SELECT {g}vp, fn, fp, vn, sin_veredicto, juzgadas, round((vp+vn)/greatest(juzgadas,1)::DOUBLE, 6) AS acuerdo,
      CASE WHEN pa*pb+(1-pa)*(1-pb) <> 1 THEN round((po-(pa*pb+(1-pa)*(1-pb)))/(1-(pa*pb+(1-pa)*(1-pb))), 6) END AS kappa FROM m"""


ORACLES = {k: f"WITH {TRACE}, {v}" if not v.startswith("SELECT") else f"WITH {TRACE} {v}" for k, v in {
    "agent_totals": f"SELECT {_R}, agente, {_AG}, round(round(sum(coalesce(latencia_s,0)), 6), 1) AS latencia_s, count(*) FILTER (WHERE coalesce(error,'') <> '') AS errores FROM tr WHERE tipo = 'llamada' GROUP BY {_R}, agente",
    "run_summary": f"{_SUM} SELECT * FROM sm",
    "code_attempts": f"SELECT {_R}, subtarea, {_ATT} AS intentos FROM tr GROUP BY {_R}, subtarea",
    "rejections_by_source": f"SELECT variante, repeticion, {_REJ.format('codigo')} AS codigo, {_REJ.format('llm')} AS llm FROM tr GROUP BY variante, repeticion",
    "status_histogram": f"{_FIN} SELECT variante, status, count(*) AS n FROM fs GROUP BY ALL",
    "mean_range_by_task": f"{_SUM} SELECT tarea, variante, {_rng('tokens_entrada')} AS tokens_entrada, {_rng('intentos_codigo')} AS intentos FROM sm GROUP BY tarea, variante",
    "variant_totals": f"{_SUM}, pr AS (SELECT variante, repeticion, sum(tokens_entrada)::BIGINT AS te, sum(tokens_salida)::BIGINT AS tsal, sum(intentos_codigo)::BIGINT AS ic FROM sm GROUP BY ALL) SELECT variante, count(*) AS repeticiones, {_rng('te')} AS tokens_entrada, {_rng('tsal')} AS tokens_salida, {_rng('ic')} AS intentos FROM pr GROUP BY variante",
    "share_of_total": "ag AS (SELECT variante, agente, count(*) AS llamadas, sum(coalesce(tokens_entrada,0)+coalesce(tokens_salida,0))::BIGINT AS tk FROM tr WHERE tipo = 'llamada' GROUP BY ALL) SELECT variante, agente, llamadas, round(100.0::DOUBLE * tk / (sum(tk) OVER (PARTITION BY variante))::DOUBLE, 4) AS pct FROM ag",
    "failing_groups": "pr AS (SELECT variante, decision, repeticion, count(*) AS n FROM tr WHERE tipo = 'decision' AND decision <> 'aprobado' GROUP BY ALL) SELECT variante, decision, string_agg('r' || repeticion::VARCHAR || ': ' || n::VARCHAR, ' / ' ORDER BY repeticion) AS detalle FROM pr GROUP BY ALL",
    "running_tokens": f"SELECT {_R}, seq, sum(tokens_entrada + tokens_salida) OVER (PARTITION BY {_R} ORDER BY seq)::BIGINT AS consumido FROM tr WHERE tipo = 'llamada'",
    "running_tokens_by_agent": "SELECT agente, seq, sum(tokens_entrada + tokens_salida) OVER (PARTITION BY agente ORDER BY seq)::BIGINT AS consumido FROM tr WHERE tipo = 'llamada'",
    "budget_audit": f"b AS (SELECT *, sum(tokens_entrada + tokens_salida) OVER (PARTITION BY {_R} ORDER BY seq) - (tokens_entrada + tokens_salida) AS antes FROM tr WHERE tipo = 'llamada') SELECT {_R}, seq, agente, ({BUDGET} - CASE WHEN agente = 'redactor' THEN 0 ELSE {RESERVE} END - antes)::BIGINT AS disponible, (({BUDGET} - CASE WHEN agente = 'redactor' THEN 0 ELSE {RESERVE} END - antes) <= 0)::INT AS bloqueada FROM b",
    "attempt_numbers": f"SELECT {_R}, subtarea, seq, row_number() OVER (PARTITION BY {_R}, subtarea ORDER BY seq) AS intento FROM tr WHERE tipo = 'ejecucion'",
    "attempt_cap": f"SELECT {_R}, subtarea, (count(*) FILTER (WHERE decision = 'rechazado') >= 3)::INT AS tope FROM tr GROUP BY {_R}, subtarea",
    "first_last_event": f"SELECT {_R}, min(seq) AS primera, max(seq) AS ultima, arg_min(tipo, seq) AS tipo_primera, arg_max(tipo, seq) AS tipo_ultima FROM tr GROUP BY {_R}",
    "decision_histogram": "SELECT tarea, decision, count(*) AS n FROM tr WHERE tipo = 'decision' GROUP BY ALL",
    "subtask_panorama": f"""{_FIN}, w AS (SELECT {_R}, subtarea, count(*) FILTER (WHERE tipo='ejecucion') AS ejecuciones, {_REJ.format('codigo')} AS rechazos_codigo, {_REJ.format('llm')} AS rechazos_llm,
      count(*) FILTER (WHERE tipo='llamada' AND agente='programador') AS llamadas_programador, coalesce(sum(tokens_entrada) FILTER (WHERE tipo='llamada' AND agente='programador'),0)::BIGINT AS prog_entrada,
      coalesce(sum(tokens_salida) FILTER (WHERE tipo='llamada' AND agente='programador'),0)::BIGINT AS prog_salida FROM tr GROUP BY ALL) SELECT * FROM fs LEFT JOIN w USING ({_R}, subtarea)""",
    "run_status": f"{_FIN}, g AS (SELECT {_R}, count(*) FILTER (WHERE status='aprobada') AS aprobadas, count(*) AS total FROM fs GROUP BY {_R}) SELECT *, CASE WHEN aprobadas = 0 THEN 'fallido' WHEN aprobadas = total THEN 'completado' ELSE 'parcial' END AS estado FROM g",
    "missing_result_notes": f"{_FIN} SELECT {_R}, 'La subtarea ' || subtarea || ' no tiene resultado (' || status || ')' AS nota FROM fs WHERE status IN ('fallida','omitida','pendiente') UNION ALL SELECT DISTINCT {_R}, 'El presupuesto de tokens se agotó: se entrega lo que se alcanzó a medir.' FROM tr WHERE decision = 'presupuesto_agotado'",
    "evidence_lines": "SELECT seq, '- `#' || seq::VARCHAR || '` ' || agente || ' → **' || decision || '** [' || subtarea || ']' AS linea FROM tr WHERE decision IN ('rechazado','presupuesto_agotado') UNION ALL SELECT seq, '- `#' || seq::VARCHAR || '` ejecutor [' || subtarea || ']: returncode=' || returncode::VARCHAR || ', error: ' || error FROM tr WHERE tipo = 'ejecucion' AND error IS NOT NULL UNION ALL SELECT seq, '- `#' || seq::VARCHAR || '` redactor redacta (' || tokens_entrada::VARCHAR || '+' || tokens_salida::VARCHAR || ' tokens)' FROM tr WHERE tipo = 'llamada' AND agente = 'redactor'",
    "summary_with_checks": f"{_SUM}, ck AS (SELECT 't' || doc_id::VARCHAR AS tarea, sum(quality)::BIGINT AS aprobadas, count(*) AS total FROM labels GROUP BY ALL) SELECT {_R}, status, tokens_entrada, aprobadas, total FROM sm LEFT JOIN ck USING (tarea)",
    "published_files": f"""md AS (SELECT {_R}, 'output/' || subtarea || '.csv' AS rel, arg_max(seq, (CASE WHEN error IS NULL THEN 1 ELSE 0 END, seq)) AS productor FROM tr WHERE tipo='ejecucion' AND returncode = 0 GROUP BY ALL),
      ex AS (SELECT DISTINCT {_R}, 'output/' || subtarea || '.csv' AS rel FROM tr) SELECT {_R}, rel, productor, (productor IS NULL)::INT AS falta FROM ex LEFT JOIN md USING ({_R}, rel)""",
    "markdown_table": f"a AS (SELECT variante, agente, {_AG} FROM tr WHERE tipo='llamada' GROUP BY variante, agente) SELECT '| ' || variante || ' | ' || agente || ' | ' || llamadas::VARCHAR || ' | ' || {_num('tokens_entrada::DOUBLE')} || ' |' AS linea FROM a",
    "latest_calls": f"""r AS (SELECT {_R}, seq, agente || ' ' || modelo AS l, row_number() OVER (PARTITION BY {_R} ORDER BY seq DESC) AS rank FROM tr WHERE tipo='llamada')
      SELECT {_R}, rank, seq, CASE WHEN length(l) > 12 THEN left(l,12) || ' … [' || (length(l)-12)::VARCHAR || ' car. más]' ELSE l END AS linea FROM r WHERE rank <= 3""",
    "verdict_formats": f"{_VER} SELECT formato, count(*) AS n FROM vd GROUP BY formato",
    "judge_agreement": f"{_VER}, {_agree('vd')}",
    "judge_false_positives": f"{_VER} SELECT doc_id, razon, formato FROM vd WHERE golden = 0 AND juez = 1",
    "judge_by_run": """lb AS (SELECT d.lang AS variante, d.doc_id % 3 AS repeticion, quality AS golden, CASE WHEN d.doc_id % 4 <> 0 THEN (d.n_chars % 2 = 0)::INT END AS juez FROM labels JOIN documents d USING (doc_id)), """ + _agree("lb", "variante, repeticion"),
    "approved_outputs": """f AS (SELECT page_id, 'T' || (page_id % 50)::VARCHAR AS st, ['script.py', 'r.json', 't.csv', 'f.png', 'stdout.txt', 'stderr.txt', 'd.npy', 'nota.txt'][page_id % 8 + 1] AS n FROM pages),
        a AS (SELECT 'T' || (user_id % 70)::VARCHAR AS st FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING count(*) % 3 <> 0)
        SELECT page_id, 'subtareas/' || st || '/' || n AS path FROM f WHERE st IN (SELECT st FROM a) AND n NOT IN ('script.py', 'stdout.txt', 'stderr.txt')""",
    "kappa_by_language": "lb AS (SELECT lang, quality AS golden, 1 - toxic AS juez FROM labels JOIN documents USING (doc_id)), " + _agree("lb", "lang"),
}.items()}
