"""Registered plans for scores, paired tests, quantiles, sampling distributions, classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from docloom.operators import experiments as ex
from docloom.operators import sampling as sp
from docloom.operators.critic import PERFECT, is_metric
from docloom.plans.scale import exact_quantiles
from docloom.session import table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _scored(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_tax", *FEATURES)
    return ex.weighted_score(li, FEATURES).withColumn(
        "requires_review", ex.needs_review(F.col("load_score"), F.col("l_tax") * 1000))


def zscore_review(spark, sf):
    return _scored(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round("load_score", 6).alias("load_score"),
        F.col("requires_review").cast("int").alias("requires_review"))


def group_summary(spark, sf):
    return _scored(spark, sf).groupBy("l_suppkey").agg(
        F.count("*").alias("observations"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"),
        F.max("l_tax").alias("max_tax"), F.round(F.avg("load_score"), 6).alias("mean_load"),
        F.sum(F.col("requires_review").cast("int")).cast("bigint").alias("review_count"))


def _pairs(spark, sf):
    """Per customer: mean price of finished minus mean price of open orders."""
    o = table(spark, sf, "orders")
    side = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    d = o.groupBy("o_custkey").agg(side("F").alias("a"), side("O").alias("b"))
    return d.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("o_custkey", (F.col("a") - F.col("b")).alias("d"))


def paired_t(spark, sf):
    r = ex.paired_test(_pairs(spark, sf), "d")
    return r.select("n", *[F.round(c, 4).alias(c) for c in ("media", "sd", "se", "t")])


def paired_t_inference(spark, sf):
    r = ex.paired_test(_pairs(spark, sf), "d")
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("p", "ic_bajo", "ic_alto")])


def sign_counts(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return ex.paired_test(_pairs(spark, sf).join(c, "o_custkey"), "d", ["c_mktsegment"]).select(
        "c_mktsegment", "n", "favorecen_a", "favorecen_b")


def _monthly(spark, sf):
    """Twelve paired differences: month by month, finished against open orders."""
    o = table(spark, sf, "orders")
    side = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    return o.groupBy(F.month("o_orderdate").alias("m")).agg(F.round(side("F") - side("O"), 2).alias("d"))


def sign_flip_exact(spark, sf):
    return ex.sign_flip_test(_monthly(spark, sf), "d", "m")


def poisson_bootstrap_ci(spark, sf):
    r = ex.poisson_bootstrap(table(spark, sf, "orders"), "o_totalprice", "o_orderkey")
    return r.select("remuestras", F.round("bajo", 2).alias("bajo"), F.round("alto", 2).alias("alto"))


def percentile_ci(spark, sf):
    q = exact_quantiles(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"],
                        "l_extendedprice", [0.025, 0.5, 0.975], F.floor(F.col("l_extendedprice") / 64))
    return q.select("l_returnflag", *[F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("p025", "p50", "p975"))])


def _type_logits(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.sum("value").alias("total")).withColumn("logit", F.col("total") / 100)


def softmax_entropy(spark, sf):
    base = _type_logits(spark, sf)
    out = None
    for t in (0.5, 1.0, 2.0):
        p = ex.softmax(base, ["user_id"], "logit", t)
        h = p.groupBy("user_id").agg(F.round(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0)), 6).alias("bits"))
        h = h.withColumn("temperatura", F.lit(t))
        out = h if out is None else out.unionByName(h)
    return out


def top_p(spark, sf):
    p = ex.softmax(_type_logits(spark, sf), ["user_id"], "logit", 1.0)
    return ex.top_p(p, ["user_id"], "p", "event_type").select("user_id", "event_type", F.round("p_top", 6).alias("p_top"))


def kl_bits(spark, sf):
    """KL divergence of each user's event mix from the global mix."""
    e = table(spark, sf, "events")
    g = e.groupBy("event_type").agg(F.count("*").alias("g"))
    n = g.agg(F.sum("g").alias("total"))
    q = g.join(F.broadcast(n)).select("event_type", (F.col("g") / F.col("total")).alias("q"))
    u = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    un = u.groupBy("user_id").agg(F.sum("n").alias("t"))
    d = u.join(un, "user_id").join(q, "event_type").withColumn("p", F.col("n") / F.col("t"))
    return d.groupBy("user_id").agg(F.round(F.sum(F.col("p") * F.log2(F.col("p") / F.col("q"))), 6).alias("kl_bits"))


def class_counts(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


def _split(spark, sf):
    """70/30 split: rows whose id hash lies below 70 % of its range train.

    A hash doesn't know the class, so every class is split in these shares up to chance, without a count or a shuffle.
    """
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", *FEATURES, "l_tax")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    h = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint")
    d = li.withColumn("id", key).withColumn("h", h)
    cut = F.lit(int(0.7 * (1 << 48)))
    return d.where(F.col("h") <= cut), d.where(F.col("h") > cut)


NB_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def naive_bayes(spark, sf):
    train, test = _split(spark, sf)
    return ex.class_report(ex.gaussian_nb(train, test, "l_returnflag", NB_FEATURES, "id"), "l_returnflag").select(
        "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def logistic_regression(spark, sf):
    """Standardised logistic regression of quality from document shape, with a learning curve."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    d = d.select("doc_id", F.col("quality").cast("double").alias("label"), F.log1p("n_chars").alias("f1"),
                 F.size(F.split("text", "\n")).cast("double").alias("f2"),
                 (F.length(F.regexp_replace("text", r"[\p{L}\s]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("f3"),
                 F.pmod(F.xxhash64("doc_id"), F.lit(100)).alias("h"))
    d = VectorAssembler(inputCols=["f1", "f2", "f3"], outputCol="raw").transform(d)
    train, test = d.where("h < 70"), d.where("h >= 70")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    train, test = scaler.transform(train), scaler.transform(test)
    out = None
    for share in (25, 50, 100):
        model = LogisticRegression(maxIter=50, regParam=0.01).fit(train.where(F.col("h") < 70 * share / 100))
        acc = model.transform(test).agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 6).alias("accuracy"))
        acc = acc.withColumn("pct_train", F.lit(share))
        out = acc if out is None else out.unionByName(acc)
    return out


def _labelled_shape(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "quality", (F.log1p("n_chars") - 6).alias("tamano"), (F.length("source") / 10).alias("fuente"))


def stratified_split(spark, sf):
    """A third of each quality class for testing, exactly, by the least hashes."""
    return sp.stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 1 / 3).select("doc_id", "quality", "prueba")


def logistic_newton(spark, sf):
    """Eight Newton steps on the training part: the coefficients, and how many of the test part they get right."""
    d = sp.stratified_split(_labelled_shape(spark, sf), "doc_id", "quality", 1 / 3)
    beta = sp.logistic_fit(d.where("prueba = 0"), "quality", ["tamano"])
    right = (sp.logistic_scores(d, ["tamano"], beta) >= 0.5).cast("int") == F.col("quality")
    return d.where("prueba = 1").agg(
        F.lit(round(float(beta[0]), 6)).alias("b0"), F.lit(round(float(beta[1]), 6)).alias("b1"), F.count(F.lit(1)).alias("n"), F.sum(right.cast("int")).cast("bigint").alias("aciertos"))


def categorical_draws(spark, sf):
    """Fifty event types per user, drawn from the softmax of their totals."""
    p = ex.softmax(_type_logits(spark, sf).withColumn("logit", F.col("logit") / 20), ["user_id"], "logit", 1.0)
    return sp.categorical_draws(p, ["user_id"], "event_type", "p", 50).select("user_id", F.col("draw").cast("bigint").alias("draw"), "event_type")


def implausible_metrics(spark, sf):
    """Flattened event metrics at or above 0.999, the sign of a leak."""
    e = table(spark, sf, "events").select(
        "event_id", F.explode(F.array(
            F.struct(F.lit("modelo.accuracy").alias("path"), (F.col("value") / 100).alias("v")),
            F.struct(F.lit("modelo.loss[0]").alias("path"), F.col("value").alias("v")),
            F.struct(F.lit("F1[2]").alias("path"), F.when(F.col("value") < 300, F.col("value") / 300).alias("v")))).alias("x"))
    return e.where(is_metric(F.col("x.path")) & (F.col("x.v") >= PERFECT)).select(
        "event_id", "x.path", F.round("x.v", 6).alias("v"))


def numeric_leaves(spark, sf):
    """Numeric leaves of a nested result object, booleans left out."""
    e = table(spark, sf, "events")
    j = F.to_json(F.struct(F.struct(F.col("value").alias("v"), F.lit(True).alias("ok")).alias("r"),
                           F.array(F.col("user_id").cast("double"), F.col("event_id").cast("double")).alias("ids")))
    from docloom.functions.nested import numeric_leaves as leaves

    return e.select("event_id", F.explode(leaves(j)).alias("x")).select("event_id", "x.path", F.round("x.value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (
    zscore_review, group_summary, paired_t, paired_t_inference, sign_counts, sign_flip_exact,
    poisson_bootstrap_ci, percentile_ci, softmax_entropy, top_p, kl_bits, class_counts, naive_bayes,
    logistic_regression, implausible_metrics, numeric_leaves, stratified_split, logistic_newton, categorical_draws)}

_Z = """s AS (SELECT avg(l_quantity) m1, stddev_pop(l_quantity) s1, avg(l_extendedprice) m2, stddev_pop(l_extendedprice) s2, avg(l_discount) m3, stddev_pop(l_discount) s3 FROM lineitem),
 z AS (SELECT l.*, 0.5*(l_quantity-m1)/s1 + 0.3*(l_extendedprice-m2)/s2 + 0.2*(l_discount-m3)/s3 AS load_score FROM lineitem l, s),
 r AS (SELECT *, (load_score > 1.5 OR l_tax * 1000 > 80) AS rr FROM z)"""
_P = """p AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE o_orderstatus='F') - avg(o_totalprice) FILTER (WHERE o_orderstatus='O') AS d FROM orders GROUP BY o_custkey), q AS (SELECT * FROM p WHERE d IS NOT NULL)"""
_L = "b AS (SELECT user_id, event_type, sum(value)/100 AS logit FROM events GROUP BY ALL)"


_POISSON_CUTS = [float(c) for c in np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])]


def _TMASS(x: str) -> str:
    """Simpson's rule for the mass of Student's t between 0 and x, with the constant c and v degrees of freedom."""
    weight = "CASE WHEN j = 0 OR j = 4000 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
    return f"(c * {x} / 12000 * list_sum(list_transform(range(0, 4001), lambda j: ({weight}) * pow(1 + pow({x} * j / 4000.0, 2) / v, -(v + 1) / 2.0))))"


def _soft(t: str) -> str:
    return f"SELECT user_id, event_type, {t}::DOUBLE AS temperatura, exp((logit - max(logit) OVER (PARTITION BY user_id)) / {t}) AS e FROM b"


_NB = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in NB_FEATURES)
_NBV = "greatest(" + ", ".join(f"var_pop({f})" for f in NB_FEATURES) + ") * 1e-9"
_NBS = " ".join(f"- ln((v_{f} + fl) * 2 * pi()) / 2 - (({f} - m_{f}) ** 2) / ((v_{f} + fl) * 2)" for f in NB_FEATURES)

_SPLIT = """sh AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('split:' || doc_id::VARCHAR) || ':' || doc_id::VARCHAR) AS pos, count(*) OVER (PARTITION BY quality) AS n FROM labels),
 sl AS (SELECT doc_id, quality, (pos <= floor(n * (1.0::DOUBLE / 3) + 0.5))::INT AS prueba FROM sh)"""

ORACLES = {
    "zscore_review": f"WITH {_Z} SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(load_score, 6) AS load_score, rr::INT AS requires_review FROM r",
    "group_summary": f"WITH {_Z} SELECT l_suppkey, count(*) AS observations, round(avg(l_extendedprice),4) AS mean_price, max(l_tax) AS max_tax, round(avg(load_score),6) AS mean_load, sum(rr::INT)::BIGINT AS review_count FROM r GROUP BY l_suppkey",
    "paired_t": f"WITH {_P} SELECT count(*) AS n, round(avg(d),4) AS media, round(stddev_samp(d),4) AS sd, round(stddev_samp(d)/sqrt(count(*)),4) AS se, round(avg(d)/(stddev_samp(d)/sqrt(count(*))),4) AS t FROM q",
    "sign_counts": f"WITH {_P} SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE d < 0) AS favorecen_a, count(*) FILTER (WHERE d > 0) AS favorecen_b FROM q JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "sign_flip_exact": """WITH m AS (SELECT month(o_orderdate) AS m, round(avg(o_totalprice) FILTER (WHERE o_orderstatus='F') - avg(o_totalprice) FILTER (WHERE o_orderstatus='O'), 2) AS d FROM orders GROUP BY 1),
        k AS (SELECT row_number() OVER (ORDER BY m) - 1 AS i, d FROM m), s AS (SELECT unnest(range(1::BIGINT << (SELECT count(*) FROM k)::BIGINT)) AS s),
        t AS (SELECT s, abs(sum(CASE WHEN (s >> i) & 1 = 0 THEN d ELSE -d END) / count(*)) AS a FROM s, k GROUP BY s), o AS (SELECT abs(avg(d)) AS o FROM k)
        SELECT count(*) AS configuraciones, count(*) FILTER (WHERE a >= o - 1e-12) AS extremas, count(*) FILTER (WHERE a >= o - 1e-12) / count(*)::DOUBLE AS p_signos FROM t, o""",
    "percentile_ci": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025),6) AS p025, round(quantile_cont(l_extendedprice, 0.5),6) AS p50, round(quantile_cont(l_extendedprice, 0.975),6) AS p975 FROM lineitem GROUP BY l_returnflag",
    "stratified_split": f"WITH {_SPLIT} SELECT doc_id, quality, prueba FROM sl",
    "logistic_newton": f"""WITH RECURSIVE {_SPLIT}, d AS (SELECT sl.*, ln(1 + n_chars) - 6 AS x FROM sl JOIN documents USING (doc_id)), tr AS (SELECT quality::DOUBLE AS y, x FROM d WHERE prueba = 0),
        it AS (SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 UNION ALL
          SELECT k + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
            SELECT any_value(k) AS k, any_value(b0) AS b0, any_value(b1) AS b1, sum(y - p) - 0.01 * any_value(b0) AS g0, sum((y - p) * x) - 0.01 * any_value(b1) AS g1,
              sum(p * (1 - p)) + 0.01 AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + 0.01 AS h11 FROM (SELECT it.k, it.b0, it.b1, y, x, 1 / (1 + exp(-(it.b0 + it.b1 * x))) AS p FROM it, tr WHERE it.k < 8) GROUP BY k) q),
        la AS (SELECT b0, b1 FROM it WHERE k = 8)
        SELECT round(any_value(b0), 6) AS b0, round(any_value(b1), 6) AS b1, count(*) AS n, count(*) FILTER (WHERE (1 / (1 + exp(-(b0 + b1 * x))) >= 0.5)::INT = quality) AS aciertos FROM d, la WHERE prueba = 1""",
    "categorical_draws": f"""WITH {_L}, lx AS (SELECT user_id, event_type, exp(logit / 20 - max(logit / 20) OVER (PARTITION BY user_id)) AS e FROM b), pp AS (SELECT user_id, event_type, e / sum(e) OVER (PARTITION BY user_id) AS p FROM lx),
        c AS (SELECT user_id, event_type, coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, lead(1) OVER (PARTITION BY user_id ORDER BY event_type) IS NULL AS tail, p FROM pp),
        dr AS (SELECT user_id, draw, ('0x' || substr(md5(user_id::VARCHAR || ':' || draw::VARCHAR || ':draw'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM (SELECT DISTINCT user_id FROM pp), range(50) r(draw))
        SELECT dr.user_id, draw, event_type FROM dr JOIN c ON c.user_id = dr.user_id AND u >= lo AND (tail OR u < lo + p)""",
    "softmax_entropy": f"WITH {_L}, e AS ({_soft('0.5')} UNION ALL {_soft('1.0')} UNION ALL {_soft('2.0')}), p AS (SELECT user_id, temperatura, e / sum(e) OVER (PARTITION BY user_id, temperatura) AS p FROM e) SELECT user_id, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS bits, temperatura FROM p GROUP BY user_id, temperatura",
    "top_p": f"WITH {_L}, e AS ({_soft('1.0')}), p AS (SELECT user_id, event_type, e / sum(e) OVER (PARTITION BY user_id) AS p FROM e), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT user_id, event_type, round(p / sum(p) OVER (PARTITION BY user_id), 6) AS p_top FROM c WHERE before < 0.9",
    "kl_bits": "WITH q AS (SELECT event_type, count(*) / (SELECT count(*) FROM events)::DOUBLE AS q FROM events GROUP BY 1), u AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS p FROM u) SELECT user_id, round(sum(p * log2(p / q)), 6) AS kl_bits FROM p JOIN q USING (event_type) GROUP BY user_id",
    "class_counts": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "poisson_bootstrap_ci": f"""WITH a AS (SELECT o_totalprice AS v, r, ((o_orderkey::UHUGEINT * {0xBF58476D1CE4E5B9} + r::UHUGEINT * {0x9E3779B97F4A7C15}) % {1 << 64}::UHUGEINT)::UBIGINT AS z FROM orders, (SELECT unnest(range(1, 201)) AS r)),
        b AS (SELECT v, r, (xor(z, z >> 30)::UHUGEINT * {0xBF58476D1CE4E5B9} % {1 << 64}::UHUGEINT)::UBIGINT AS z FROM a),
        c AS (SELECT v, r, (xor(z, z >> 27)::UHUGEINT * {0x94D049BB133111EB} % {1 << 64}::UHUGEINT)::UBIGINT AS z FROM b),
        u AS (SELECT v, r, (xor(z, z >> 31) >> 11)::DOUBLE / {1 << 53}::DOUBLE AS u FROM c),
        m AS (SELECT r, sum(v * n) / sum(n) AS m FROM (SELECT v, r, {" + ".join(f"({c!r}::DOUBLE < u)::INT" for c in _POISSON_CUTS)} AS n FROM u) GROUP BY r), l AS (SELECT list_sort(list(m)) AS l FROM m)
        SELECT 200 AS remuestras, round(l[6], 2) AS bajo, round(l[195], 2) AS alto FROM l""",
    "paired_t_inference": f"""WITH RECURSIVE {_P}, st AS (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) / sqrt(count(*)) AS se FROM q),
        k AS (SELECT *, n - 1 AS v, exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt((n - 1) * pi()) AS c FROM st),
        it AS (SELECT 0 AS i, 1.96::DOUBLE AS x FROM k UNION ALL SELECT i + 1, x - ({_TMASS('x')} - 0.475) / (c * pow(1 + x * x / v, -(v + 1) / 2.0)) FROM it, k WHERE i < 12),
        z AS (SELECT arg_max(x, i) AS z FROM it)
        SELECT n, round(1 - 2 * {_TMASS('abs(m / se)')}, 6) AS p, round(m - z * se, 6) AS ic_bajo, round(m + z * se, 6) AS ic_alto FROM k, z""",
    "naive_bayes": f"""WITH d AS (SELECT *, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, ('0x' || left(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 12))::BIGINT AS h FROM lineitem),
        x AS (SELECT d.*, h <= {int(0.7 * (1 << 48))} AS tr FROM d),
        f AS (SELECT {_NBV} AS fl, count(*) AS total FROM x WHERE tr), m AS (SELECT l_returnflag AS c, count(*) AS n, {_NB} FROM x WHERE tr GROUP BY 1),
        t AS (SELECT row_number() OVER () AS rid, * FROM x WHERE NOT tr), s AS (SELECT rid, l_returnflag, c, ln(n / total::DOUBLE) {_NBS} AS s FROM t, m, f),
        p AS (SELECT rid, min(l_returnflag) AS y, arg_max(c, (s, c)) AS pred FROM s GROUP BY rid),
        a AS (SELECT y AS c, count(*) AS t, count(*) FILTER (WHERE y = pred) AS tp FROM p GROUP BY 1), g AS (SELECT pred AS c, count(*) AS g FROM p GROUP BY 1)
        SELECT sum(t)::BIGINT AS n, round(sum(tp) / sum(t)::DOUBLE, 6) AS accuracy, round(avg(2.0::DOUBLE * coalesce(tp,0) / (coalesce(t,0) + coalesce(g,0))), 6) AS macro_f1 FROM a FULL JOIN g USING (c)""",
    "implausible_metrics": "WITH x AS (SELECT event_id, 'modelo.accuracy' AS path, value / 100 AS v FROM events UNION ALL SELECT event_id, 'F1[2]', value / 300 FROM events WHERE value < 300) SELECT event_id, path, round(v, 6) AS v FROM x WHERE v >= 0.999",
    "numeric_leaves": "SELECT event_id, 'r.v' AS path, round(value, 6) AS value FROM events UNION ALL SELECT event_id, 'ids[0]', user_id::DOUBLE FROM events UNION ALL SELECT event_id, 'ids[1]', event_id::DOUBLE FROM events",
}
