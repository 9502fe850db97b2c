"""Registered queries of scoring, drift, feature choice, holdouts, depth fills and behaviour frames, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import session
from ..operators import evaluation, execution, frames, models, tape
from ..sources import mbo as source
from . import folds
from .relational_queries import _LABELED, _LABELS, _STORY, CUT, ORDER, _bars, _labeled, _story
from .sql import MBO, bars, rounded
from .tape_queries import H1, _ET, _M, tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):  # noqa: ANN202
    def put(f: Callable[[SparkSession, str], DataFrame]):  # noqa: ANN202
        QUERIES[name] = lambda s, d: tidy(f(s, d))
        if sql is not None:
            SQL[name] = sql
        return f

    return put


# ---- scored outcomes: both labels of each document with a forecast that its number decides

_SCORED = """scored AS (SELECT doc_id, 'quality' AS outcome_name, CAST(quality AS DOUBLE) AS y, (doc_id * 37 % 97) / 96.0::DOUBLE AS p_hat, 0.6::DOUBLE AS baseline_p FROM labels
  UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE), (doc_id * 53 % 89) / 88.0::DOUBLE, 0.1::DOUBLE FROM labels)"""


def _scored(s: SparkSession, d: str) -> DataFrame:
    t = s.read.parquet(f"{d}/labels.parquet")
    one = lambda name, y, p, base: t.select("doc_id", F.lit(name).alias("outcome_name"), F.col(y).cast("double").alias("y"), p.alias("p_hat"), F.lit(base).alias("baseline_p"))
    return one("quality", "quality", F.col("doc_id") * 37 % 97 / F.lit(96.0), 0.6).unionByName(one("toxic", "toxic", F.col("doc_id") * 53 % 89 / F.lit(88.0), 0.1))


@_add("metrics_by_outcome", rounded(f"""WITH {_SCORED}, s AS (SELECT * FROM scored WHERE y IS NOT NULL), n AS (SELECT outcome_name, count(*) AS n, greatest(1, least(10, count(*) // 5)) AS bins FROM s GROUP BY 1),
w AS (SELECT outcome_name, avg((y - p_hat)^2) AS brier, avg(abs(y - p_hat)) AS mae, avg(y) AS base_rate, 1 - avg((y - p_hat)^2) / avg((y - baseline_p)^2) AS brier_skill, -avg(y * ln(greatest(p_hat, 1e-12)) + (1 - y) * ln(greatest(1 - p_hat, 1e-12))) AS log_loss FROM s GROUP BY 1),
b AS (SELECT outcome_name, n, least(bins - 1, floor(p_hat * bins)) AS bin, count(*) AS k, avg(p_hat) AS conf, avg(y) AS acc FROM s JOIN n USING (outcome_name) GROUP BY ALL),
e AS (SELECT outcome_name, sum(k / n::DOUBLE * abs(acc - conf)) AS ece FROM b GROUP BY 1),
r AS (SELECT outcome_name, y, (rank() OVER (PARTITION BY outcome_name ORDER BY p_hat) + (count(*) OVER (PARTITION BY outcome_name, p_hat) - 1) / 2.0::DOUBLE) AS r FROM s),
a AS (SELECT outcome_name, (sum(r) FILTER (y >= 0.5) - count(*) FILTER (y >= 0.5) * (count(*) FILTER (y >= 0.5) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y >= 0.5) * count(*) FILTER (y < 0.5)) AS auc FROM r GROUP BY 1)
SELECT n.outcome_name, n.n, brier, ece, mae, base_rate, brier_skill, log_loss, auc FROM n JOIN w USING (outcome_name) JOIN e USING (outcome_name) JOIN a USING (outcome_name)""", "brier", "ece", "mae", "base_rate", "brier_skill", "log_loss", "auc"))
def _(s: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics_by_outcome(_scored(s, d))


LINES = {"quality": (0.8, -0.25), "toxic": (1.3, 0.4)}
_LINE = "1 / (1 + exp(-(ln(q / (1 - q)) * CASE outcome_name WHEN 'quality' THEN 0.8 ELSE 1.3 END + CASE outcome_name WHEN 'quality' THEN -0.25 ELSE 0.4 END)))"


@_add("apply_calibrators", rounded(f"WITH {_SCORED} SELECT doc_id, outcome_name, {_LINE} AS p_cal FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, p_hat)) AS q FROM scored)", "p_cal"))
def _(s: SparkSession, d: str) -> DataFrame:
    return evaluation.apply_calibrators(_scored(s, d), LINES).select("doc_id", "outcome_name", "p_cal")


@_add("calibrators_to_states", rounded(f"WITH {_SCORED}, c AS (SELECT doc_id, outcome_name, {_LINE} AS p FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, p_hat)) AS q FROM scored)) SELECT doc_id, max(p) FILTER (outcome_name = 'quality') AS p_quality, max(p) FILTER (outcome_name = 'toxic') AS p_toxic FROM c GROUP BY 1", "p_quality", "p_toxic"))
def _(s: SparkSession, d: str) -> DataFrame:
    of = lambda n: F.max(F.when(F.col("outcome_name") == n, F.col("p_hat"))).alias(f"p_{n}")
    return evaluation.apply_to_states(_scored(s, d).groupBy("doc_id").agg(of("quality"), of("toxic")), LINES)


@_add("calibrators_by_outcome")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = _scored(s, d)
    lines = evaluation.fit_calibrators(rows.where("doc_id % 2 = 0"))
    return evaluation.metrics_by_outcome(evaluation.apply_calibrators(rows.where("doc_id % 2 = 1"), lines), p="p_cal")


_CLASSED = """classed AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'a' WHEN quality = 1 THEN 'b' ELSE 'c' END AS first_transition_class, (1 + doc_id % 7) / t AS p_first_a, (1 + doc_id % 5) / t AS p_first_b, (1 + doc_id % 3) / t AS p_first_c
  FROM (SELECT *, CAST(3 + doc_id % 7 + doc_id % 5 + doc_id % 3 AS DOUBLE) AS t FROM labels))"""


@_add("competing_scores", rounded(f"""WITH {_CLASSED} SELECT count(*) AS n, avg((p_first_a - CAST(first_transition_class = 'a' AS INT))^2 + (p_first_b - CAST(first_transition_class = 'b' AS INT))^2 + (p_first_c - CAST(first_transition_class = 'c' AS INT))^2) AS brier,
  avg(-ln(CASE first_transition_class WHEN 'a' THEN p_first_a WHEN 'b' THEN p_first_b ELSE p_first_c END)) AS log_loss,
  avg(CAST(CASE WHEN p_first_a >= p_first_b AND p_first_a >= p_first_c THEN 'a' WHEN p_first_b >= p_first_c THEN 'b' ELSE 'c' END = first_transition_class AS DOUBLE)) AS accuracy FROM classed""", "brier", "log_loss", "accuracy"))
def _(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    t = (3 + i % 7 + i % 5 + i % 3).cast("double")
    label = F.when(F.col("toxic") == 1, "a").when(F.col("quality") == 1, "b").otherwise("c")
    rows = s.read.parquet(f"{d}/labels.parquet").select(label.alias("first_transition_class"), *[((1 + i % k) / t).alias(f"p_first_{c}") for c, k in (("a", 7), ("b", 5), ("c", 3))])
    return evaluation.competing_scores(rows, ["a", "b", "c"])


@_add("outcome_rates", rounded(f"WITH {_SCORED} SELECT outcome_name, avg(y) AS rate FROM scored GROUP BY 1", "rate"))
def _(s: SparkSession, d: str) -> DataFrame:
    return evaluation.outcome_rates(_scored(s, d))


_SIDE = "SELECT coalesce(c_acctbal, 0) AS x, coalesce(CAST(c_nationkey AS DOUBLE), 0) AS k FROM customer WHERE c_custkey % 2 ="


def _psi(column: str, name: str) -> str:
    return f"""{name}c AS (SELECT list_distinct(quantile_cont({column}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM a),
{name}h AS (SELECT 0 AS side, len(list_filter(cuts, lambda v: v <= {column})) AS bin FROM a, {name}c UNION ALL SELECT 1, len(list_filter(cuts, lambda v: v <= {column})) FROM b, {name}c),
{name}n AS (SELECT bin, greatest(count(*) FILTER (side = 0) / (SELECT count(*) FROM a)::DOUBLE, 1e-6) AS r, greatest(count(*) FILTER (side = 1) / (SELECT count(*) FROM b)::DOUBLE, 1e-6) AS c FROM {name}h GROUP BY 1),
{name}e AS (SELECT unnest(range(0, (SELECT len(cuts) + 1 FROM {name}c))) AS bin), {name}f AS (SELECT coalesce(r, 1e-6) AS r, coalesce(c, 1e-6) AS c FROM {name}e LEFT JOIN {name}n USING (bin)),
{name} AS (SELECT sum((c / cs - r / rs) * ln((c / cs) / (r / rs))) AS psi FROM {name}f, (SELECT sum(r) AS rs, sum(c) AS cs FROM {name}f))"""


@_add("drift", rounded(f"""WITH a AS ({_SIDE} 0), b AS (SELECT x * 1.2 + 30 AS x, k FROM ({_SIDE} 1)), {_psi("x", "px")}, {_psi("k", "pk")}, {_SCORED},
l AS (SELECT outcome_name, avg(y) FILTER (doc_id % 2 = 0) AS r, avg(y) FILTER (doc_id % 2 = 1) AS c FROM scored GROUP BY 1)
SELECT (SELECT count(*) FROM a) AS n_ref, (SELECT count(*) FROM b) AS n_cmp, (abs((SELECT avg(x) FROM a) - (SELECT avg(x) FROM b)) + abs((SELECT avg(k) FROM a) - (SELECT avg(k) FROM b))) / 2 AS feature_mean_l1,
  (px.psi + pk.psi) / 2 AS mean_psi, greatest(px.psi, pk.psi) AS max_psi, (SELECT avg(abs(coalesce(r, 0) - coalesce(c, 0))) FROM l) AS outcome_rate_l1, 0.03::DOUBLE AS calibration_delta FROM px, pk""", "feature_mean_l1", "mean_psi", "max_psi", "outcome_rate_l1", "calibration_delta"))
def _(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("k"))
    labels = _scored(s, d)
    return evaluation.drift(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1").withColumn("x", F.col("x") * 1.2 + 30), ["x", "k"], labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1"), 0.05, 0.02)


@_add("fold_stability", rounded("WITH f AS (SELECT o_custkey % 6 AS fold, avg(o_totalprice) AS ece FROM orders GROUP BY 1) SELECT count(*) AS n, avg(ece) AS mean, stddev_pop(ece) AS std, stddev_pop(ece) / avg(ece) AS cv FROM f", "mean", "std", "cv", digits=4))
def _(s: SparkSession, d: str) -> DataFrame:
    f = s.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_custkey") % 6).alias("fold")).agg(F.avg("o_totalprice").alias("ece"))
    return evaluation.stability(f).withColumns({c: F.round(c, 4) for c in ("mean", "std", "cv")})


@_add("selection_stability", rounded("WITH f AS (SELECT o_custkey % 6 AS fold, avg(o_totalprice) / 150000 - 1 AS test_ic FROM orders GROUP BY 1) SELECT CAST(count(*) AS INT) AS n_folds, avg(test_ic) AS mean_ic, stddev_samp(test_ic) AS std_ic, avg(CAST(test_ic > 0 AS DOUBLE)) AS positive_fold_rate FROM f", "mean_ic", "std_ic", "positive_fold_rate"))
def _(s: SparkSession, d: str) -> DataFrame:
    return evaluation.selection_stability(s.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_custkey") % 6).alias("fold")).agg((F.avg("o_totalprice") / 150000 - 1).alias("test_ic")))


_RANKS = "(rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0::DOUBLE)"


@_add("sign_stability", rounded(f"""WITH r AS (SELECT o_custkey % 5 AS fold, o_totalprice AS v, CAST(o_orderkey % 1000 AS DOUBLE) AS f FROM orders), k AS (SELECT fold, {_RANKS.format(k="fold", c="v")} AS a, {_RANKS.format(k="fold", c="f")} AS b FROM r), c AS (SELECT fold, corr(a, b) AS ic FROM k GROUP BY 1)
SELECT count(*) AS n_folds, avg(CAST(sign(ic) = CASE WHEN (SELECT avg(ic) FROM c) >= 0 THEN 1 ELSE -1 END AS DOUBLE)) AS consistency, avg(CAST(sign(ic) = CASE WHEN (SELECT avg(ic) FROM c) >= 0 THEN 1 ELSE -1 END AS DOUBLE)) >= 2 / 3.0::DOUBLE AS stable FROM c""", "consistency"))
def _(s: SparkSession, d: str) -> DataFrame:
    r = s.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 5).alias("fold"), F.lit("test").alias("role"), F.col("o_totalprice").alias("v"), (F.col("o_orderkey") % 1000).cast("double").alias("f"))
    return evaluation.sign_stability(r, "v", "f")


@_add("regime_ics", rounded(f"WITH r AS (SELECT o_orderpriority AS phase, o_totalprice AS v, CAST(o_custkey AS DOUBLE) AS f FROM orders), k AS (SELECT phase, {_RANKS.format(k='phase', c='v')} AS a, {_RANKS.format(k='phase', c='f')} AS b FROM r) SELECT phase, count(*) AS n, corr(a, b) AS ic FROM k GROUP BY 1 HAVING count(*) >= 20", "ic"))
def _(s: SparkSession, d: str) -> DataFrame:
    return evaluation.regime_ics(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("phase"), F.col("o_totalprice").alias("v"), F.col("o_custkey").cast("double").alias("f")), "v", "f", "phase")


@_add("gate_attribution", rounded(f"""WITH r AS (SELECT 1 AS one, abs(b * g) AS a, abs(b) AS b FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE l_quantity - 25 END AS b, CAST(l_partkey % 2 AS DOUBLE) AS g FROM lineitem)), k AS (SELECT {_RANKS.format(k="one", c="a")} AS x, {_RANKS.format(k="one", c="b")} AS y FROM r)
SELECT (SELECT count(*) FROM r) AS n, (SELECT corr(x, y) FROM k) AS abs_spearman, (SELECT avg(CAST(a <> 0 AS DOUBLE)) FROM r WHERE b <> 0) AS pass_rate""", "abs_spearman", "pass_rate"))
def _(s: SparkSession, d: str) -> DataFrame:
    r = s.read.parquet(f"{d}/lineitem.parquet").select(F.when(F.col("l_orderkey") % 3 == 0, 0.0).otherwise(F.col("l_quantity") - 25).alias("sig"), (F.col("l_partkey") % 2).cast("double").alias("g"))
    return evaluation.attribution(r.withColumn("sig__gate", F.col("sig") * F.col("g")), "sig__gate", "sig")


@_add("regime_difference")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v")).orderBy("h").collect()
    return evaluation.regime_difference(s, [r.v for r in rows], [r.h.hour // 8 for r in rows])


# ---- features

_FEATURES = "f AS (SELECT o_orderkey, o_totalprice AS vp_total, 1.0::DOUBLE AS vp_constant, CAST(o_custkey AS DOUBLE) AS proj_customer, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 END AS path_half, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS lf_seven, NULL::DOUBLE AS rel_none FROM orders)"


def _features(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return s.read.parquet(f"{d}/orders.parquet").select(
        k, F.col("o_totalprice").alias("vp_total"), F.lit(1.0).alias("vp_constant"), F.col("o_custkey").cast("double").alias("proj_customer"), F.when(k % 2 == 0, 1.0).alias("path_half"),
        F.when(k % 50 != 0, (k % 7).cast("double")).alias("lf_seven"), F.lit(None).cast("double").alias("rel_none"),
    )


@_add("feature_choice", f"""WITH {_FEATURES}, s AS (SELECT stddev_pop(vp_total) AS a, stddev_pop(vp_constant) AS b, stddev_pop(proj_customer) AS c, stddev_pop(coalesce(path_half, 0)) AS d, stddev_pop(coalesce(lf_seven, 0)) AS e, stddev_pop(coalesce(rel_none, 0)) AS g, avg(CAST(path_half IS NULL AS DOUBLE)) AS h, avg(CAST(lf_seven IS NULL AS DOUBLE)) AS i FROM f),
v AS (SELECT [x.n FOR x IN [{{'n': 'proj_customer', 'v': c}}, {{'n': 'path_half', 'v': d}}, {{'n': 'lf_seven', 'v': e}}, {{'n': 'rel_none', 'v': g}}, {{'n': 'vp_total', 'v': a}}, {{'n': 'vp_constant', 'v': b}}] IF x.v > 1e-12] AS by_family, [x.n FOR x IN [{{'n': 'vp_constant', 'v': b}}, {{'n': 'vp_total', 'v': a}}, {{'n': 'lf_seven', 'v': e}}] IF x.v > 1e-12][:1] AS preferred,
  [x.n FOR x IN [{{'n': 'o_orderkey', 'v': 0.0}}, {{'n': 'vp_total', 'v': 0.0}}, {{'n': 'vp_constant', 'v': 0.0}}, {{'n': 'proj_customer', 'v': 0.0}}, {{'n': 'path_half', 'v': h}}, {{'n': 'lf_seven', 'v': i}}, {{'n': 'rel_none', 'v': 1.0}}] IF x.v <= 0.05] AS dense FROM s)
SELECT array_to_string(by_family, ',') AS by_family, array_to_string(preferred, ',') AS preferred, array_to_string(dense, ',') AS dense FROM v""")
def _(s: SparkSession, d: str) -> DataFrame:
    f = _features(s, d)
    return s.createDataFrame([(",".join(evaluation.features_by_family(f)), ",".join(evaluation.preferred_features(f, ["vp_constant", "vp_total", "lf_seven"], 1)), ",".join(evaluation.dense_columns(f)))], "by_family string, preferred string, dense string")


@_add("feature_rows", f"WITH {_FEATURES} SELECT o_orderkey, array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN [coalesce(path_half, 0), coalesce(lf_seven, 0), coalesce(rel_none, 0)]], ',') AS x FROM f")
def _(s: SparkSession, d: str) -> DataFrame:
    m = evaluation.matrix_of(_features(s, d), ["path_half", "lf_seven", "absent", "rel_none"], ["o_orderkey"])
    return m.withColumn("x", F.array_join(F.transform("x", lambda v: v.cast("bigint").cast("string")), ","))


@_add("signal_hits", "SELECT count(*) FILTER (l_linenumber = 3 OR l_quantity > 45) AS hits, count(*) FILTER (l_linenumber = 3 OR l_quantity > 45) = 0 AS all_zero FROM lineitem")
def _(s: SparkSession, d: str) -> DataFrame:
    r = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_linenumber") == 3).cast("double").alias("a"), F.when(F.col("l_quantity") > 45, -1.0).alias("b"))
    return evaluation.signal_hits(r, ["a", "b", "absent"])


@_add("descriptive_rates", rounded("SELECT avg(CAST(l_quantity / 50 > 0.5 AS DOUBLE)) AS p_large, avg(CAST(l_discount * 10 > 0.5 AS DOUBLE)) AS p_cheap, 0.0::DOUBLE AS p_absent, 0.0::DOUBLE AS confidence, count(*) AS n_samples FROM lineitem", "p_large", "p_cheap", "p_absent", "confidence"))
def _(s: SparkSession, d: str) -> DataFrame:
    r = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"))
    return evaluation.descriptive_rates(r, {"large": "a", "cheap": "b", "absent": "c"})


@_add("fold_rates", rounded("""WITH r AS (SELECT o_custkey % 4 AS fold, o_orderkey % 3 = 0 AS test, CAST(o_totalprice > 140000 AS DOUBLE) AS y FROM orders), g AS (SELECT fold, avg(y) FILTER (NOT test) AS p, avg(y) FILTER (test) AS q, count(*) FILTER (test) AS n FROM r GROUP BY 1),
b AS (SELECT avg((y - p)^2) AS pooled_brier FROM r JOIN g USING (fold) WHERE test) SELECT sum(q * n) / sum(n) AS weighted_rate, avg(abs(p - q)) AS mean_absolute_calibration, (SELECT pooled_brier FROM b) AS pooled_brier FROM g""", "weighted_rate", "mean_absolute_calibration", "pooled_brier"))
def _(s: SparkSession, d: str) -> DataFrame:
    r = s.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 4).alias("fold"), (F.col("o_orderkey") % 3 == 0).alias("test"), (F.col("o_totalprice") > 140000).cast("double").alias("y"))
    g = r.where("NOT test").groupBy("fold").agg(evaluation.rate("y").alias("p")).join(r.where("test").groupBy("fold").agg(evaluation.rate("y").alias("q"), F.count(F.lit(1)).alias("n")), "fold")
    pooled = r.where("test").join(g.select("fold", "p"), "fold").agg(evaluation.constant_brier("y", F.col("p")).alias("pooled_brier"))
    return g.agg(evaluation.weighted_mean("q", "n").alias("weighted_rate")).crossJoin(evaluation.absolute_calibration(g, "p", "q")).crossJoin(pooled)  # one row each


# ---- labelled setups: scope, holdouts, folds, guards


@_add("resolved_outcome", _LABELED + f" SELECT * FROM l WHERE label_status = 'resolved' AND y IS NOT NULL AND setup_availability_ts <= {CUT}")
def _(s: SparkSession, d: str) -> DataFrame:
    return evaluation.developed(evaluation.by_outcome(_labeled(s, d), "y_accept"), CUT)


@_add("scope_slice", _LABELED + ", o AS (SELECT DISTINCT availability_ts FROM story WHERE event_id % 3 = 0) SELECT l.*, 'oof_develop' AS scope FROM l WHERE setup_availability_ts IN (SELECT availability_ts FROM o)")
def _(s: SparkSession, d: str) -> DataFrame:
    return evaluation.scoped(_labeled(s, d), _story(s, d).where("event_id % 3 = 0"))


_KEYED = _LABELED + ", k AS (SELECT l.*, row_number() OVER (PARTITION BY user_id ORDER BY setup_availability_ts, outcome_available_ts, horizon_bars) AS r FROM l WHERE y > 0.5) "
_KEEP = "user_id, setup_availability_ts, outcome_available_ts, outcome_name, y, horizon_bars, label_status"


@_add("first_success", _KEYED + f"SELECT {_KEEP} FROM k WHERE r = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return evaluation.first_success(_labeled(s, d), ["user_id"], ["setup_availability_ts", "outcome_available_ts", "horizon_bars"])


@_add("first_model", rounded(_LABELED + f", p AS (SELECT availability_ts AS setup_availability_ts, min(value / 100) AS model_p FROM story GROUP BY 1), k AS (SELECT l.*, model_p, row_number() OVER (PARTITION BY user_id ORDER BY setup_availability_ts, outcome_available_ts, horizon_bars) AS r FROM l JOIN p USING (setup_availability_ts) WHERE model_p >= 0.3) SELECT {_KEEP}, model_p FROM k WHERE r = 1", "model_p"))
def _(s: SparkSession, d: str) -> DataFrame:
    scores = _story(s, d).select(F.col("availability_ts").alias("setup_availability_ts"), (F.col("value") / 100).alias("p"))
    return evaluation.first_model(_labeled(s, d), scores, "p", ["user_id"], 0.3, ["setup_availability_ts", "outcome_available_ts", "horizon_bars"])


@_add("means_by_label", rounded(_LABELED + ", j AS (SELECT y, value FROM l JOIN story ON l.user_id = story.user_id AND l.setup_availability_ts = story.availability_ts WHERE y IS NOT NULL) SELECT y, count(*) AS n, avg(value) AS value FROM j GROUP BY 1", "value"))
def _(s: SparkSession, d: str) -> DataFrame:
    own = _story(s, d).select("user_id", F.col("availability_ts").alias("setup_availability_ts"), "value")
    return evaluation.means_by_label(_labeled(s, d).join(own, ["user_id", "setup_availability_ts"]).where("y IS NOT NULL"), ["value", "absent"])


_DATE = lambda c: f"CAST(timezone('America/New_York', timezone('UTC', make_timestamp({c} // 1000))) + INTERVAL 6 HOUR AS DATE)"


@_add("label_guards", _LABELED + f", w AS (SELECT availability_ts, CASE WHEN min(event_id) % 2 = 0 THEN 'd0' ELSE 'd1' END AS day FROM story GROUP BY 1) SELECT count(*) FILTER (outcome_available_ts < setup_availability_ts) AS known_before_setup, count(*) FILTER ({_DATE('setup_availability_ts')} <> {_DATE('outcome_available_ts')}) AS crossed_dates, count(*) FILTER (a.day <> b.day) AS crossed_days, count(*) FILTER (a.day IS NULL OR b.day IS NULL) AS outside_days FROM l LEFT JOIN w a ON a.availability_ts = setup_availability_ts LEFT JOIN w b ON b.availability_ts = outcome_available_ts")
def _(s: SparkSession, d: str) -> DataFrame:
    days = _story(s, d).groupBy("availability_ts").agg(F.when(F.min("event_id") % 2 == 0, "d0").otherwise("d1").alias("period_day_id"))
    return frames.label_guards(_labeled(s, d), days)


_DATED = "o AS (SELECT o_orderkey, o_custkey % 3 AS instrument_id, epoch_us(o_orderdate) * 1000 AS ts FROM orders)"


def _dated(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 3).alias("instrument_id"), F.expr("unix_micros(CAST(o_orderdate AS TIMESTAMP)) * 1000").alias("ts"))


@_add("segment_keys", f"WITH {_DATED} SELECT o_orderkey, strftime(make_timestamp(ts // 1000), '%Y-%m') AS segment_month, CAST(instrument_id AS VARCHAR) AS segment_contract FROM o")
def _(s: SparkSession, d: str) -> DataFrame:
    return folds.segment_keys(_dated(s, d), "ts").select("o_orderkey", "segment_month", "segment_contract")


@_add("month_holdout", f"WITH {_DATED}, m AS (SELECT *, strftime(make_timestamp(ts // 1000), '%Y-%m') AS m FROM o), k AS (SELECT m, dense_rank() OVER (ORDER BY m DESC) AS k FROM (SELECT DISTINCT m FROM m)), c AS (SELECT max(ts) AS cut_ts FROM m JOIN k USING (m) WHERE k > 5) SELECT o_orderkey, cut_ts, ts > cut_ts AS is_holdout FROM m, c")
def _(s: SparkSession, d: str) -> DataFrame:
    return folds.holdout_by_months(_dated(s, d), "ts", 5).select("o_orderkey", "cut_ts", "is_holdout")


_SETUPS = """u AS (SELECT DISTINCT ts FROM o), i AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM u), h AS (SELECT k AS fold, k * (n // 4) AS a, CASE WHEN k = 3 THEN n ELSE (k + 1) * (n // 4) END AS b FROM (SELECT DISTINCT n FROM i), (SELECT unnest([1, 2, 3]) AS k)),
t AS (SELECT fold, i.ts, CASE WHEN i >= a AND i < b THEN 'test' WHEN i < a - 2 THEN 'train' END AS role FROM i, h)"""


@_add("contract_folds", f"WITH {_DATED}, {_SETUPS} SELECT o_orderkey, CAST(fold AS INT) AS fold, role, 'time_multi_instrument(3)' AS segment FROM o JOIN t USING (ts) WHERE role IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    return folds.contract_aware(_dated(s, d), "ts", n_splits=3, purge=2).select("o_orderkey", F.col("fold").cast("int").alias("fold"), "role", "segment")


@_add("fold_table", f"WITH {_DATED}, {_SETUPS} SELECT CAST(fold AS INT) AS fold, count(*) FILTER (role = 'train') AS train_n, count(*) FILTER (role = 'test') AS test_n, max(ts) FILTER (role = 'train') AS train_end_ts, min(ts) FILTER (role = 'test') AS test_start_ts, max(ts) FILTER (role = 'test') AS test_end_ts FROM o JOIN t USING (ts) WHERE role IS NOT NULL GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return folds.fold_table(folds.setup_folds(_dated(s, d), "ts", 3, purge=2), "ts").withColumn("fold", F.col("fold").cast("int"))


@_add("calibration_tail", f"WITH {_DATED}, u AS (SELECT DISTINCT ts FROM o), i AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM u) SELECT o_orderkey, CASE WHEN i > n - least(greatest(1, round(n * 0.2)), n // 3) THEN 'cal' ELSE 'fit' END AS part FROM o JOIN i USING (ts)")
def _(s: SparkSession, d: str) -> DataFrame:
    return folds.calibration_tail(_dated(s, d), "ts").select("o_orderkey", "part")


# ---- depth fills: a ladder of three levels that an order's number decides

_LADDER = """d AS (SELECT o_orderkey, o_custkey % 4 AS instrument_id, o_orderdate, 100.0 + o_orderkey % 50 - k * 0.25 AS m, """ + ", ".join(f"CAST(99.75 + o_orderkey % 50 - {k} * 0.25 AS DOUBLE) AS b{k}, CAST(100.25 + o_orderkey % 50 + {k} * 0.25 AS DOUBLE) AS a{k}, CAST((o_orderkey * {k + 3}) % 5 AS DOUBLE) AS u{k}, CAST((o_orderkey * {k + 5}) % 4 AS DOUBLE) AS v{k}" for k in (1, 2, 3)) + ", CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(99.5 + o_orderkey % 50 AS DOUBLE) END AS top_bid, CAST(100.5 + o_orderkey % 50 AS DOUBLE) AS top_ask FROM (SELECT *, 0 AS k FROM orders))"


def _ladder(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    made = {f"depth_bid_px_{i}": 99.75 + k % 50 - i * 0.25 for i in (1, 2, 3)} | {f"depth_ask_px_{i}": 100.25 + k % 50 + i * 0.25 for i in (1, 2, 3)}
    made |= {f"depth_bid_sz_{i}": k * (i + 3) % 5 for i in (1, 2, 3)} | {f"depth_ask_sz_{i}": k * (i + 5) % 4 for i in (1, 2, 3)}
    rows = s.read.parquet(f"{d}/orders.parquet").withColumns({c: v.cast("double") for c, v in made.items()})
    return rows.withColumns({"instrument_id": F.col("o_custkey") % 4, "top_bid": F.when(k % 11 != 0, 99.5 + k % 50), "top_ask": 100.5 + k % 50})


def _swept(px: str, sz: str) -> str:
    """SQL of the average price of taking 4 from three levels; null where they hold less."""
    take = [f"least({sz}1, 4)", f"least({sz}2, greatest(0, 4 - {sz}1))", f"least({sz}3, greatest(0, 4 - {sz}1 - {sz}2))"]
    return f"CASE WHEN {sz}1 + {sz}2 + {sz}3 >= 4 THEN (" + " + ".join(f"{px}{i} * {t}" for i, t in enumerate(take, 1)) + ") / 4 END"


_FILLED = f"WITH {_LADDER}, p AS (SELECT *, coalesce({_swept('a', 'v')}, top_ask + 0.125) AS buy, coalesce({_swept('b', 'u')}, top_bid - 0.125) AS sell FROM d)"


@_add("depth_returns", rounded(_FILLED + ", q AS (SELECT *, lead(buy, 2) OVER w AS buy2, lead(sell, 2) OVER w AS sell2 FROM p WINDOW w AS (PARTITION BY instrument_id ORDER BY o_orderdate, o_orderkey)) SELECT o_orderkey, (sell2 - buy) / buy - 0.0001 AS long_return, (sell - buy2) / sell - 0.0001 AS short_return FROM q", "long_return", "short_return"))
def _(s: SparkSession, d: str) -> DataFrame:
    r = execution.depth_returns(_ladder(s, d), 2, 4, ["instrument_id"], ["o_orderdate", "o_orderkey"], 3, "top_bid", "top_ask", commission_bps=1.0)
    return r.select("o_orderkey", "long_return", "short_return")


@_add("ladder_sizes", f"WITH {_LADDER} SELECT o_orderkey, CAST(CASE WHEN v2 > 0 THEN v2 ELSE 0 END AS BIGINT) AS ask_second, 0::BIGINT AS nowhere, CAST((u1 > 0)::INT + (u2 > 0)::INT + (u3 > 0)::INT AS INT) AS bid_levels FROM d")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = _ladder(s, d)
    m = execution.matrices(rows, 3)
    asks = execution.levels(m["ask_px"], m["ask_sz"])
    return rows.select("o_orderkey", execution.size_at(asks, F.col("depth_ask_px_2")).alias("ask_second"), execution.size_at(asks, F.lit(1.0)).alias("nowhere"), F.size(execution.levels(m["bid_px"], m["bid_sz"])).alias("bid_levels"))


# ---- behaviour frames over bars: a bar's own range stands for its value area

_STATES = f"WITH {MBO}, {bars('bars', H1, 'mbo')}, x AS (SELECT *, make_timestamp(availability_ts // 1000) AS ts FROM bars), v AS (SELECT *, {_M.replace('event_ts', 'availability_ts')} AS m FROM x), states AS (SELECT instrument_id, availability_ts, o AS open, h AS high, l AS low, c AS close, c AS poc, o + 0.5 * (h - o) AS vah, o - 0.5 * (o - l) AS val, CASE WHEN m >= 1080 OR m < 180 THEN 0 WHEN m < 570 THEN 1 ELSE 2 END AS s, volume AS signal_quality, delta FROM v)"
_RUN = ", c AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER w AND lag(availability_ts) OVER w IS NOT NULL THEN 1 ELSE 0 END AS c FROM states WINDOW w AS (PARTITION BY instrument_id ORDER BY availability_ts)), r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY instrument_id ORDER BY availability_ts) AS BIGINT) AS session_run FROM c)"
_SIXTH = lambda *c: [f"round({x}, 6) + 0.0 AS {x}" for x in c]


def _states(s: SparkSession, d: str) -> DataFrame:
    b = _bars(s, d)
    return b.select(
        "instrument_id", "availability_ts", F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("c").alias("poc"), (F.col("o") + 0.5 * (F.col("h") - F.col("o"))).alias("vah"), (F.col("o") - 0.5 * (F.col("o") - F.col("l"))).alias("val"),
        session.liquidity_session(F.col("availability_ts")).alias("vp_liquidity_session"), F.col("volume").alias("signal_quality"), "delta",
    )


@_add("session_profiles", rounded(_STATES + _RUN + ", g AS (SELECT instrument_id, session_run, CAST(min(s) AS BIGINT) AS liquidity_session, min(availability_ts) AS session_start_ts, max(availability_ts) AS session_end_ts, count(*) AS n_bars, NULL::DOUBLE AS decision_poc, NULL::DOUBLE AS decision_vah, NULL::DOUBLE AS decision_val, arg_max(poc, availability_ts) AS completed_poc, arg_max(vah, availability_ts) AS completed_vah, arg_max(val, availability_ts) AS completed_val FROM r GROUP BY 1, 2) SELECT *, CASE liquidity_session WHEN 0 THEN 'asia' WHEN 1 THEN 'london' ELSE 'new_york' END AS session_name, completed_vah - completed_val AS va_width FROM g", "completed_poc", "completed_vah", "completed_val", "va_width"))
def _(s: SparkSession, d: str) -> DataFrame:
    return frames.session_profiles(_states(s, d), ["instrument_id"])


@_add("london_scenarios", rounded(_STATES + _RUN + """, g AS (SELECT instrument_id, session_run, min(s) AS s, min(availability_ts) AS a, max(availability_ts) AS b, arg_min(open, availability_ts) AS op, max(high) AS hi, min(low) AS lo, arg_max(poc, availability_ts) AS poc, arg_max(vah, availability_ts) AS vah, arg_max(val, availability_ts) AS val FROM r GROUP BY 1, 2),
p AS (SELECT *, lag(s) OVER w AS s0, lag(b) OVER w AS b0, lag(poc) OVER w AS poc0, lag(vah) OVER w AS vah0, lag(val) OVER w AS val0 FROM g WINDOW w AS (PARTITION BY instrument_id ORDER BY session_run))
SELECT instrument_id, b0 AS asia_end_ts, a AS london_open_ts, b AS outcome_available_ts, CASE WHEN op > vah0 THEN 'open_above_asia_vah' WHEN op < val0 THEN 'open_below_asia_val' ELSE 'inside_asia_va' END AS scenario, op AS london_open, poc0 AS asia_completed_poc, vah0 AS asia_completed_vah, val0 AS asia_completed_val, op BETWEEN val0 AND vah0 AS open_inside_asia_va, hi > vah0 AS london_broke_asia_vah, lo < val0 AS london_broke_asia_val FROM p WHERE s = 1 AND s0 = 0""", "london_open", "asia_completed_poc", "asia_completed_vah", "asia_completed_val"))
def _(s: SparkSession, d: str) -> DataFrame:
    return frames.london_scenarios(_states(s, d), ["instrument_id"])


@_add("latest_state", rounded(_STATES + " SELECT instrument_id, max(availability_ts) AS availability_ts, CAST(arg_max(s, availability_ts) AS DOUBLE) AS vp_liquidity_session, arg_max(signal_quality, availability_ts) AS signal_quality, 0.0::DOUBLE AS vp_balance FROM states GROUP BY 1", "signal_quality", "vp_balance"))
def _(s: SparkSession, d: str) -> DataFrame:
    return frames.latest_state(_states(s, d), ["instrument_id"], ("vp_liquidity_session", "signal_quality", "vp_balance"))


@_add("state_frame", rounded(_STATES + " SELECT instrument_id, availability_ts, signal_quality, delta AS proj_delta FROM states", "signal_quality", "proj_delta"))
def _(s: SparkSession, d: str) -> DataFrame:
    return frames.state_frame(_states(s, d).withColumnRenamed("delta", "proj_delta"), ["instrument_id"])


@_add("rate_summary", rounded(_STATES + """, f AS (SELECT * FROM (VALUES ('a', 0.25, 4), ('a', 0.5, 12), ('b', 0.75, 2)) t(target, train_rate, test_n)), b AS (SELECT max(availability_ts) AS available_after_ts, avg(signal_quality) AS confidence, count(*) AS n_samples FROM states)
SELECT b.*, 0.4375::DOUBLE AS p_a, 0.75::DOUBLE AS p_b, false AS confidence_is_calibrated_probability, 'train_only_walk_forward_base_rates' AS probability_source, false AS probabilities_are_joint_distribution FROM b""", "confidence", "p_a", "p_b"))
def _(s: SparkSession, d: str) -> DataFrame:
    rates = s.createDataFrame([("a", 0.25, 4), ("a", 0.5, 12), ("b", 0.75, 2)], "target string, train_rate double, test_n int")
    return frames.rate_summary(rates, _states(s, d)).withColumns({"p_a": F.col("p")["a"], "p_b": F.col("p")["b"]}).drop("p")


@_add("behavior_validation", _STATES + " SELECT count(*) AS n_rows, true AS causal_ok, 0::BIGINT AS repeated_times, 0 AS n_folds, true AS decision_bounds_present, true AS no_trade_outputs, true AS ok FROM states")
def _(s: SparkSession, d: str) -> DataFrame:
    return frames.validate(_states(s, d).withColumnsRenamed({"vah": "vp_upper", "val": "vp_lower", "poc": "vp_mid"}), ["instrument_id"])


@_add("clipped_zones", f"WITH {MBO}, m AS (SELECT *, {_M} AS m, epoch_us(date_trunc('day', {_ET})) * 1000 + 18000000000000 AS day, min(event_ts) OVER () AS lo, max(event_ts) OVER () AS hi FROM mbo) SELECT sequence, greatest(CASE WHEN m < 180 THEN day - 21600000000000 WHEN m < 570 THEN day + 10800000000000 WHEN m < 1080 THEN day + 34200000000000 ELSE day + 64800000000000 END, lo) AS zone_start, least(CASE WHEN m < 180 THEN day + 10800000000000 WHEN m < 570 THEN day + 34200000000000 WHEN m < 1080 THEN day + 64800000000000 ELSE day + 97200000000000 END, hi) AS zone_end FROM m")
def _(s: SparkSession, d: str) -> DataFrame:
    m = source.events_as_mbo(s, d)
    span = m.agg(F.min("event_ts").alias("lo"), F.max("event_ts").alias("hi"))
    start, end = session.clipped_zone(F.col("event_ts"), F.col("lo"), F.col("hi"))
    return m.crossJoin(F.broadcast(span)).select("sequence", start.alias("zone_start"), end.alias("zone_end"))  # one row


# ---- selection on test folds only

_EMPLOYED = f"WITH {MBO}, {bars('bars', H1, 'mbo')}, k AS (SELECT instrument_id, availability_ts, delta, volume, epoch_us(date_trunc('day', make_timestamp(availability_ts // 1000))) * 1000 AS day FROM bars WHERE instrument_id = 1), f AS (SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS INT) AS fold, day, max(availability_ts) AS b, min(availability_ts) AS a FROM k GROUP BY day)"


@_add("employed_signal", rounded(_EMPLOYED + ", e AS (SELECT * FROM f WHERE fold % 3 > 0) SELECT k.availability_ts, CASE fold % 3 WHEN 1 THEN delta WHEN 2 THEN -volume ELSE 0.0::DOUBLE END AS employed, coalesce(fold, -1) AS employed_fold, CASE fold % 3 WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS employed_sign, coalesce(CASE fold % 3 WHEN 1 THEN 'delta' WHEN 2 THEN 'volume' END, '') AS employed_signal FROM k LEFT JOIN e ON k.availability_ts BETWEEN e.a AND e.b", "employed", "employed_sign"))
def _(s: SparkSession, d: str) -> DataFrame:
    from . import strategies

    k = _bars(s, d).where("instrument_id = 1").select("availability_ts", "delta", "volume", F.date_trunc("day", F.timestamp_seconds(F.expr("availability_ts div 1000000000"))).alias("day"))
    from pyspark.sql import Window

    f = k.groupBy("day").agg(F.min("availability_ts").alias("test_start_ts"), F.max("availability_ts").alias("test_end_ts")).withColumn("fold", (F.row_number().over(Window.orderBy("day")) - 1).cast("int"))  # one row a day
    f = f.where("fold % 3 > 0").withColumns({"selected": F.when(F.col("fold") % 3 == 1, "delta").otherwise("volume"), "employed_sign": F.when(F.col("fold") % 3 == 1, 1.0).otherwise(-1.0)})
    return strategies.employed_signal(k.drop("day"), f, ["delta", "volume"]).select("availability_ts", "employed", "employed_fold", "employed_sign", "employed_signal")


# ---- days side by side

_DAYBARS = f"""WITH {MBO}, k AS (SELECT *, strftime(CAST({_ET} + INTERVAL 6 HOUR AS DATE), '%Y-%m-%d') AS day_id FROM mbo WHERE action = 'T'),
b AS (SELECT instrument_id, day_id, event_ts - event_ts % {H1} AS bucket_start, arg_max(price * 1e-9::DOUBLE, (event_ts, sequence)) AS c, CAST(sum(size) AS DOUBLE) AS volume, CAST(sum(CASE WHEN side = 'B' THEN size WHEN side = 'A' THEN -size ELSE 0 END) AS DOUBLE) AS delta FROM k GROUP BY ALL),
r AS (SELECT *, bucket_start + {H1} AS availability_ts, (lead(c) OVER w - c) / c AS forward_return FROM b WINDOW w AS (PARTITION BY instrument_id, day_id ORDER BY bucket_start))"""


def _day_rows(s: SparkSession, d: str) -> DataFrame:
    from . import strategies

    return strategies.day_signals(source.events_as_mbo(s, d), H1)


@_add("day_signals", rounded(_DAYBARS + " SELECT instrument_id, day_id, bucket_start, availability_ts, c, volume, delta, forward_return FROM r", "c", "volume", "delta", "forward_return"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _day_rows(s, d).select("instrument_id", "day_id", "bucket_start", "availability_ts", "c", "volume", "delta", "forward_return")


_RESULTS = _DAYBARS + f""", h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY instrument_id, day_id ORDER BY availability_ts) * 2 <= count(*) OVER (PARTITION BY instrument_id, day_id) THEN 'train' ELSE 'test' END AS half FROM r),
l AS (SELECT instrument_id, day_id, half, forward_return, s.n AS signal, s.v AS value FROM (SELECT *, unnest([{{'n': 'delta', 'v': delta}}, {{'n': 'volume', 'v': volume}}]) AS s FROM h WHERE forward_return IS NOT NULL)),
q AS (SELECT instrument_id, day_id, half, signal, {_RANKS.format(k="instrument_id, day_id, half, signal", c="value")} AS x, {_RANKS.format(k="instrument_id, day_id, half, signal", c="forward_return")} AS y FROM l),
i AS (SELECT instrument_id, day_id, half, signal, count(*) AS n, CASE WHEN count(*) < 2 OR stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0.0 ELSE corr(x, y) END AS ic FROM q GROUP BY ALL),
w AS (SELECT instrument_id, day_id, signal, max(CASE WHEN n >= 3 THEN ic ELSE 0.0 END) FILTER (half = 'train') AS train_ic, max(CASE WHEN n >= 3 THEN ic ELSE 0.0 END) FILTER (half = 'test') AS test_ic, max(n) FILTER (half = 'test') AS oos_n FROM i GROUP BY ALL),
d AS (SELECT instrument_id, day_id, signal AS best_signal, coalesce(train_ic, 0.0) AS train_ic, CASE WHEN train_ic < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS employed_sign, coalesce(test_ic, 0.0) * CASE WHEN train_ic < 0 THEN -1.0 ELSE 1.0 END AS oos_ic, coalesce(oos_n, 0) AS oos_n FROM w QUALIFY row_number() OVER (PARTITION BY instrument_id, day_id ORDER BY round(coalesce(abs(train_ic), 0), 9) DESC, signal DESC) = 1)"""


def _day_results(s: SparkSession, d: str) -> DataFrame:
    from . import strategies

    return strategies.day_results(_day_rows(s, d), ["delta", "volume"], least=3)


@_add("day_results", rounded(_RESULTS + " SELECT * FROM d", "train_ic", "employed_sign", "oos_ic"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _day_results(s, d)


@_add("period_aggregate", rounded(_RESULTS + " SELECT count(DISTINCT day_id) AS n_days, avg(oos_ic) AS mean_oos_ic, avg(CAST(oos_ic > 1e-12 AS DOUBLE)) AS positive_days, (SELECT best_signal FROM (SELECT best_signal, count(*) AS k FROM d GROUP BY 1) ORDER BY k DESC, best_signal DESC LIMIT 1) AS mode_signal, 0::BIGINT AS n_trades, 0.0::DOUBLE AS expectancy, 0.0::DOUBLE AS win_rate, 'INSUFFICIENT_POOLED_TRADES' AS verdict FROM d", "mean_oos_ic", "positive_days", "expectancy", "win_rate"))
def _(s: SparkSession, d: str) -> DataFrame:
    from . import strategies

    return strategies.period_aggregate(_day_results(s, d))


# ---- behaviour runs (state machines and fits: no SQL)


def _analysis(s: SparkSession, d: str):  # noqa: ANN202
    from . import behavior_run
    from .behavior_queries import RULES
    from .tape_queries import H4

    return behavior_run.analyse(source.events_as_mbo(s, d), behavior_run.BehaviorConfig(interval_ns=H1, profile_interval_ns=H4, projection=RULES))


@_add("behavior_states")
def _(s: SparkSession, d: str) -> DataFrame:
    return _analysis(s, d).states()


@_add("behavior_summary")
def _(s: SparkSession, d: str) -> DataFrame:
    a = _analysis(s, d)
    return frames.rate_summary(a.rates, a.blended).withColumn("p", F.to_json("p"))


@_add("grouped_logistic")
def _(s: SparkSession, d: str) -> DataFrame:
    """Both labels of every document, fitted at once; compared with separate fits in the tests."""
    from .model_queries import FEATURES, _labelled

    rows = _labelled(s, d)
    long = rows.select("doc_id", *FEATURES, F.lit("quality").alias("outcome_name"), F.col("quality").alias("y")).unionByName(rows.select("doc_id", *FEATURES, F.lit("toxic").alias("outcome_name"), F.col("toxic").alias("y")))
    model = models.fit_logistic_groups(long.where("doc_id % 4 <> 0"), "outcome_name", FEATURES, "y")
    return model.transform(long.where("doc_id % 4 = 0")).select("doc_id", "outcome_name", "y", "p_hat")


@_add("streaming_frame")
def _(s: SparkSession, d: str) -> DataFrame:
    from ..streaming.research import research_frame

    f = research_frame(source.events_as_mbo(s, d), 1, 2, H1)
    return f.select("availability_ts", "session_date", "a_mid", "b_mid", "a_return", "b_return", "a_delta", "b_delta", "trap_setup", "phase_balance", "phase_expansion")


@_add("ssl_tick_folds")
def _(s: SparkSession, d: str) -> DataFrame:
    from ..operators import regimes, ticks
    from .relational_queries import sequences

    t = ticks.tick_stream(source.events_as_mbo(s, d), 1, 2, H1).withColumn("pair", F.lit(1))
    w = sequences(t, list(ticks.FEATURES), 4, 2, ["pair"], ["availability_ts"])
    at = {n: i for i, n in enumerate(ticks.FEATURES)}
    last = lambda n: F.get(F.get("window", F.lit(3)), F.lit(at[n]))
    phase = regimes.heuristic_phase(last("in_value"), last("trail_bid"), last("trail_ask"))
    return regimes.tick_folds(w.withColumns({"trap": last("trap_setup") > 0, "phase": phase}).drop("pair"), splits=2, purge=2)
