"""Registered queries of joins, rolling windows, folds, statistics, labels and memory, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.asof import asof_backward, pulse_join
from ..functions.windows import past_mean, past_median, past_quantile_nearest, run_ids
from ..operators import book, labels, store, tape
from ..sources import mbo as source
from . import folds
from .sql import MBO, bars, rounded
from .tape_queries import H1, H4, tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = 24 * H1


def _add(name: str, sql: str | None = None):  # noqa: ANN202
    def put(f: Callable[[SparkSession, str], DataFrame]):  # noqa: ANN202
        QUERIES[name] = lambda s, d: tidy(f(s, d))
        if sql is not None:
            SQL[name] = sql
        return f

    return put


_BARS = f"WITH {MBO}, {bars('bars', H1, 'mbo')}, {bars('slow', H4, 'mbo')}"


def _bars(s: SparkSession, d: str, interval: int = H1) -> DataFrame:
    return tape.ohlcv_bars(source.events_as_mbo(s, d), interval)


# ---- state sampling, as-of and pulse joins


@_add("last_state_sample", f"WITH {MBO} SELECT instrument_id, event_ts - event_ts % {H1} AS bucket_start, event_ts - event_ts % {H1} + {H1} AS availability_ts, arg_max(price, (event_ts, sequence)) AS price, arg_max(size, (event_ts, sequence)) AS size, arg_max(action, (event_ts, sequence)) AS action FROM mbo GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    return store.sample_last(source.events_as_mbo(s, d), H1, ["price", "size", "action"])


@_add("session_signed_delta", f"""WITH {MBO}, t AS (SELECT *, event_ts - event_ts % {DAY} AS day, CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END AS signed FROM mbo WHERE action = 'T'),
c AS (SELECT instrument_id, sequence, event_ts, day, CAST(sum(signed) OVER (PARTITION BY instrument_id, day ORDER BY event_ts, sequence) AS BIGINT) AS signed_volume FROM t)
SELECT instrument_id, sequence, signed_volume, signed_volume - coalesce(lag(signed_volume) OVER (PARTITION BY instrument_id, day ORDER BY event_ts, sequence), 0) AS step FROM c""")
def _(s: SparkSession, d: str) -> DataFrame:
    t = tape.extract_trades(source.events_as_mbo(s, d)).withColumn("day", F.col("event_ts") - F.pmod(F.col("event_ts"), F.lit(DAY)))
    w = Window.partitionBy("instrument_id", "day").orderBy("event_ts", "sequence")
    t = t.withColumn("signed_volume", F.sum("signed_volume").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return store.differences(t, "signed_volume", ["instrument_id", "day"], ["event_ts", "sequence"], "step").select("instrument_id", "sequence", "signed_volume", "step")


@_add("asof_backward", rounded(_BARS + ", a AS (SELECT * FROM bars WHERE instrument_id = 1), b AS (SELECT availability_ts AS t, c AS other_close FROM bars WHERE instrument_id = 2) SELECT a.bucket_start, a.availability_ts, a.c AS close, b.other_close FROM a ASOF LEFT JOIN b ON a.availability_ts >= b.t", "close", "other_close"))
def _(s: SparkSession, d: str) -> DataFrame:
    b = _bars(s, d)
    left = b.where("instrument_id = 1").select("bucket_start", "availability_ts", F.col("c").alias("close"))
    right = b.where("instrument_id = 2").select(F.col("availability_ts").alias("t"), F.col("c").alias("other_close"))
    return asof_backward(left, right, "availability_ts", "t", columns=["other_close"], slice_ns=7 * DAY)


@_add("asof_by_key", rounded(_BARS + " SELECT bars.instrument_id, bars.bucket_start, bars.c AS close, slow.c AS slow_close, slow.volume AS slow_volume FROM bars ASOF LEFT JOIN slow ON bars.instrument_id = slow.instrument_id AND bars.availability_ts >= slow.availability_ts", "close", "slow_close", "slow_volume"))
def _(s: SparkSession, d: str) -> DataFrame:
    left = _bars(s, d).select("instrument_id", "bucket_start", "availability_ts", F.col("c").alias("close"))
    right = _bars(s, d, H4).select("instrument_id", F.col("availability_ts").alias("t"), F.col("c").alias("slow_close"), F.col("volume").alias("slow_volume"))
    return asof_backward(left, right, "availability_ts", "t", by=["instrument_id"], slice_ns=7 * DAY).drop("availability_ts")


_GAPS = "g AS (SELECT instrument_id, availability_ts, CAST(sum(CASE WHEN l > h2 THEN 1.0 ELSE 0 END - CASE WHEN h < l2 THEN 1.0 ELSE 0 END) AS DOUBLE) AS gap_pulse, max(least(h, l2)) AS gap_edge FROM (SELECT *, lag(h, 2) OVER w AS h2, lag(l, 2) OVER w AS l2 FROM slow WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket_start)) WHERE l > h2 OR h < l2 GROUP BY ALL)"


def _gaps(s: SparkSession, d: str) -> DataFrame:
    g = tape.fair_value_gaps(_bars(s, d, H4))
    return g.groupBy("instrument_id", "availability_ts").agg(F.sum(F.when(F.col("fvg_type") == "Bull", 1.0).otherwise(-1.0)).alias("gap_pulse"))


@_add("pulse_join", _BARS + f", {_GAPS} SELECT bars.instrument_id, bars.bucket_start, coalesce(g.gap_pulse, 0.0) AS gap_pulse FROM bars LEFT JOIN g USING (instrument_id, availability_ts)")
def _(s: SparkSession, d: str) -> DataFrame:
    return pulse_join(_bars(s, d).select("instrument_id", "bucket_start", "availability_ts"), _gaps(s, d), ["instrument_id", "availability_ts"], ["gap_pulse"]).drop("availability_ts")


@_add("state_join", _BARS + f", {_GAPS} SELECT bars.instrument_id, bars.bucket_start, g.gap_pulse AS last_gap FROM bars ASOF LEFT JOIN g ON bars.instrument_id = g.instrument_id AND bars.availability_ts >= g.availability_ts")
def _(s: SparkSession, d: str) -> DataFrame:
    right = _gaps(s, d).select("instrument_id", F.col("availability_ts").alias("t"), F.col("gap_pulse").alias("last_gap"))
    return asof_backward(_bars(s, d).select("instrument_id", "bucket_start", "availability_ts"), right, "availability_ts", "t", by=["instrument_id"], columns=["last_gap"]).drop("availability_ts")


# ---- feature store

_LONG = _BARS + """, long AS (SELECT feature, instrument_id, CAST(value AS DOUBLE) AS value, bucket_start AS event_ts, availability_ts, 'v1' AS version FROM (
  SELECT instrument_id, bucket_start, availability_ts, 'close' AS feature, c AS value FROM bars UNION ALL SELECT instrument_id, bucket_start, availability_ts, 'delta', delta FROM bars WHERE delta <> 0 UNION ALL SELECT instrument_id, bucket_start, availability_ts, 'volume', volume FROM slow))"""
CUT = 1_705_000_000_000_000_000


def _long(s: SparkSession, d: str) -> DataFrame:
    fast = store.to_long(_bars(s, d).withColumnRenamed("c", "close"), ["close", "delta"], "v1", event="bucket_start").where("feature <> 'delta' OR value <> 0")
    return fast.unionByName(store.to_long(_bars(s, d, H4), ["volume"], "v1", event="bucket_start"))


@_add("feature_unpivot", rounded(_LONG + " SELECT * FROM long", "value"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _long(s, d)


@_add("feature_as_of", rounded(_LONG + f" SELECT feature, instrument_id, value, event_ts, availability_ts, version FROM long WHERE availability_ts <= {CUT} QUALIFY row_number() OVER (PARTITION BY feature, instrument_id ORDER BY availability_ts DESC, event_ts DESC, value DESC) = 1", "value"))
def _(s: SparkSession, d: str) -> DataFrame:
    return store.as_of(_long(s, d), CUT)


_SNAP = """, wide AS (SELECT instrument_id, availability_ts, arg_max(value, event_ts) FILTER (feature = 'close') AS close, arg_max(value, event_ts) FILTER (feature = 'delta') AS delta, arg_max(value, event_ts) FILTER (feature = 'volume') AS volume FROM long GROUP BY ALL),
snap AS (SELECT instrument_id, availability_ts, last_value(close IGNORE NULLS) OVER w AS close, last_value(delta IGNORE NULLS) OVER w AS delta, last_value(volume IGNORE NULLS) OVER w AS volume FROM wide WINDOW w AS (PARTITION BY instrument_id ORDER BY availability_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@_add("feature_snapshot_ffill", rounded(_LONG + _SNAP + " SELECT * FROM snap", "close", "delta", "volume"))
def _(s: SparkSession, d: str) -> DataFrame:
    return store.snapshots(_long(s, d), ["close", "delta", "volume"])


@_add("feature_pit_join", rounded(_LONG + _SNAP + ", q AS (SELECT instrument_id, sequence, event_ts AS ts FROM mbo WHERE action = 'T') SELECT q.instrument_id, q.sequence, q.ts, snap.close, snap.delta, snap.volume FROM q ASOF LEFT JOIN snap ON q.instrument_id = snap.instrument_id AND q.ts >= snap.availability_ts", "close", "delta", "volume"))
def _(s: SparkSession, d: str) -> DataFrame:
    query = source.events_as_mbo(s, d).where("action = 'T'").select("instrument_id", "sequence", F.col("event_ts").alias("ts"))
    return store.point_in_time_join(query, _long(s, d), ["close", "delta", "volume"])


# ---- rolling statistics by customer

_ORDERS = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"


def _orders(s: SparkSession, d: str):  # noqa: ANN202
    return s.read.parquet(f"{d}/orders.parquet"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@_add("rolling_mean_past", rounded(f"SELECT o_orderkey, CASE WHEN count(o_totalprice) OVER {_ORDERS} >= 3 THEN avg(o_totalprice) OVER {_ORDERS} END AS past_mean FROM orders", "past_mean"))
def _(s: SparkSession, d: str) -> DataFrame:
    o, w = _orders(s, d)
    return o.select("o_orderkey", past_mean("o_totalprice", w, 6, 3).alias("past_mean"))


@_add("rolling_median_past", rounded(f"SELECT o_orderkey, quantile_cont(o_totalprice, 0.5) OVER {_ORDERS} AS past_median FROM orders", "past_median"))
def _(s: SparkSession, d: str) -> DataFrame:
    o, w = _orders(s, d)
    return o.select("o_orderkey", past_median("o_totalprice", w, 6).alias("past_median"))


@_add("rolling_quantile_nearest", rounded(f"SELECT o_orderkey, CASE WHEN len(x) >= 2 THEN list_sort(x)[CAST(floor(0.7 * (len(x) - 1) + 0.5) AS INT) + 1] END AS past_quantile FROM (SELECT o_orderkey, list(o_totalprice) OVER {_ORDERS} AS x FROM orders)", "past_quantile"))
def _(s: SparkSession, d: str) -> DataFrame:
    o, w = _orders(s, d)
    return o.select("o_orderkey", past_quantile_nearest("o_totalprice", 0.7, w, 6, 2).alias("past_quantile"))


# ---- returns


@_add("forward_returns", rounded(_BARS + " SELECT instrument_id, bucket_start, (lead(c, 4) OVER w - c) / c AS forward_return FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket_start)", "forward_return"))
def _(s: SparkSession, d: str) -> DataFrame:
    return labels.forward_returns(_bars(s, d), "c", 4, ["instrument_id"], ["bucket_start"]).select("instrument_id", "bucket_start", "forward_return")


_EXEC = _BARS + """, e AS (SELECT *, l AS bid, h AS ask, sign(delta) AS signal, lead(l, 3) OVER w AS bid3, lead(h, 3) OVER w AS ask3 FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket_start)),
r AS (SELECT instrument_id, bucket_start, signal, (bid3 - 0.25 - (ask + 0.25)) / (ask + 0.25) - 0.0001 AS long_return, (bid - 0.25 - (ask3 + 0.25)) / (bid - 0.25) - 0.0001 AS short_return FROM e)"""


def _executed(s: SparkSession, d: str) -> DataFrame:
    b = _bars(s, d).withColumns({"bid": F.col("l"), "ask": F.col("h"), "signal": F.signum("delta")})
    return labels.execution_returns(b, "bid", "ask", 3, ["instrument_id"], ["bucket_start"], 1, 0.25, 1.0)


@_add("execution_returns", rounded(_EXEC + " SELECT instrument_id, bucket_start, long_return, short_return FROM r", "long_return", "short_return"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _executed(s, d).select("instrument_id", "bucket_start", "long_return", "short_return")


@_add("directional_returns", rounded(_EXEC + " SELECT instrument_id, bucket_start, CASE WHEN signal > 0 THEN long_return WHEN signal < 0 THEN short_return END AS directional_return FROM r", "directional_return"))
def _(s: SparkSession, d: str) -> DataFrame:
    return labels.directional_returns(_executed(s, d), "signal").select("instrument_id", "bucket_start", "directional_return")


# ---- folds

_DAY2 = 2 * DAY


@_add("walk_forward_folds", f"""WITH t AS (SELECT o_orderkey, epoch_us(o_orderdate) * 1000 AS ts, row_number() OVER (ORDER BY epoch_us(o_orderdate), o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
f AS (SELECT CAST(k AS INT) AS fold, n // 5 AS size, n FROM range(1, 5) r(k), (SELECT DISTINCT n FROM t)), h AS (SELECT fold, fold * size AS a, CASE WHEN fold = 4 THEN f.n ELSE (fold + 1) * size END AS b, t.ts AS first FROM f JOIN t ON t.i = fold * size)
SELECT o_orderkey, ts, fold, CASE WHEN i >= a AND i < b THEN 'test' ELSE 'train' END AS role FROM t, h WHERE (i >= a AND i < b) OR (i < a - 3 AND ts < first AND ts <= first - {_DAY2})""")
def _(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr("unix_micros(CAST(o_orderdate AS TIMESTAMP)) * 1000").alias("ts"))
    return folds.purged_walk_forward(o, "ts", 4, embargo=_DAY2, purge=3, order=["o_orderkey"])


_LI = "li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) * 1000 AS ts, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem)"


@_add("month_folds", f"""WITH {_LI}, m AS (SELECT month, min(ts) AS first, row_number() OVER (ORDER BY month) AS k FROM li GROUP BY month),
r AS (SELECT CAST(k - 8 AS INT) AS fold, m.month AS test_month, CASE WHEN li.month = m.month THEN 'test' ELSE 'train' END AS role, l_suppkey FROM li, m WHERE k > 8 AND (li.month = m.month OR (li.month < m.month AND ts <= first - {DAY})))
SELECT fold, test_month, role, count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS keys FROM r GROUP BY ALL""")
def _(s: SparkSession, d: str) -> DataFrame:
    li = s.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", F.expr("unix_micros(CAST(l_shipdate AS TIMESTAMP)) * 1000").alias("ts"))
    return folds.month_folds(li, "ts", 8, DAY).groupBy("fold", "test_month", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("l_suppkey").alias("keys"))


@_add("holdout_cut", """WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) * 1000 AS ts FROM orders), k AS (SELECT least(greatest(CAST(floor(count(*) * (1 - 0.2)) AS BIGINT), 1), count(*) - 1) AS cut FROM o),
u AS (SELECT ts, sum(count(*)) OVER (ORDER BY ts) AS until FROM o GROUP BY ts), c AS (SELECT min(ts) AS cut_ts FROM u, k WHERE until >= cut)
SELECT o_orderkey, cut_ts, ts > cut_ts AS is_holdout FROM o, c""")
def _(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr("unix_micros(CAST(o_orderdate AS TIMESTAMP)) * 1000").alias("ts"))
    return folds.frozen_holdout(o, "ts").select("o_orderkey", "cut_ts", "is_holdout")


# ---- statistics

_RET = _BARS + ", r AS (SELECT instrument_id, bucket_start, delta, (lead(c, 2) OVER w - c) / c AS ret FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket_start))"


def _ret(s: SparkSession, d: str) -> DataFrame:
    return labels.forward_returns(_bars(s, d), "c", 2, ["instrument_id"], ["bucket_start"]).select("instrument_id", "bucket_start", "delta", F.col("forward_return").alias("ret"))


@_add("spearman_ic", rounded(_RET + ", k AS (SELECT instrument_id, rank() OVER (PARTITION BY instrument_id ORDER BY delta) + (count(*) OVER (PARTITION BY instrument_id, delta) - 1) / 2.0 AS x, rank() OVER (PARTITION BY instrument_id ORDER BY ret) + (count(*) OVER (PARTITION BY instrument_id, ret) - 1) / 2.0 AS y FROM r WHERE ret IS NOT NULL) SELECT instrument_id, count(*) AS n, corr(CAST(x AS DOUBLE), CAST(y AS DOUBLE)) AS ic FROM k GROUP BY 1", "ic"))
def _(s: SparkSession, d: str) -> DataFrame:
    return stats.spearman(_ret(s, d), "delta", "ret", ["instrument_id"])


@_add("sharpe", rounded(_RET + " SELECT instrument_id, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM r GROUP BY 1", "sharpe"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _ret(s, d).groupBy("instrument_id").agg(stats.sharpe("ret", 252).alias("sharpe"))


@_add("t_stat", rounded(_RET + " SELECT instrument_id, avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) AS t_stat FROM r GROUP BY 1", "t_stat"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _ret(s, d).groupBy("instrument_id").agg(stats.t_statistic("ret").alias("t_stat"))


@_add("anova_f", rounded("WITH g AS (SELECT c_mktsegment, count(*) n, sum(c_acctbal) s, sum(c_acctbal * c_acctbal) q FROM customer GROUP BY 1), a AS (SELECT count(*) k, sum(n) n, sum(s) s, sum(q) q, sum(s * s / n) b FROM g) SELECT k AS groups, CAST(n AS BIGINT) AS n, ((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)) AS f_stat FROM a", "f_stat"))
def _(s: SparkSession, d: str) -> DataFrame:
    return stats.anova_f(s.read.parquet(f"{d}/customer.parquet"), "c_acctbal", "c_mktsegment")


_P = "p AS (SELECT c_custkey, ((c_custkey * 7919) % 1000 + 1) / 1000.0::DOUBLE AS p FROM customer)"


def _pvalues(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", ((F.col("c_custkey") * 7919 % 1000 + 1) / F.lit(1000.0)).alias("p"))


for _name, _sql in {
    "bonferroni": "SELECT c_custkey, p, least(1.0, p * count(*) OVER ()) AS adjusted FROM p",
    "holm": "SELECT c_custkey, p, least(1.0, max(v) OVER (ORDER BY k)) AS adjusted FROM (SELECT *, p * (count(*) OVER () - k + 1) AS v FROM (SELECT *, row_number() OVER (ORDER BY p, c_custkey) AS k FROM p))",
    "bh": "SELECT c_custkey, p, least(1.0, min(v) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted FROM (SELECT *, p * count(*) OVER () / k AS v FROM (SELECT *, row_number() OVER (ORDER BY p, c_custkey) AS k FROM p))",
}.items():
    QUERIES[_name] = lambda s, d, m=_name: tidy(stats.adjust(_pvalues(s, d), method=m, alpha=0.6))
    SQL[_name] = rounded(f"WITH {_P}, x AS ({_sql}) SELECT *, adjusted <= 0.6 AS reject FROM x", "p", "adjusted")

_S = "s AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y, CAST(least(0.99, greatest(0.01, n_chars / 5000.0)) AS DOUBLE) AS p FROM labels JOIN documents USING (doc_id))"


def _scores(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    both = s.read.parquet(f"{d}/labels.parquet").join(docs, "doc_id")
    return stats.scored(both.select("doc_id", "quality", F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / 5000.0)).alias("score")), "quality", "score")


@_add("brier", rounded(f"WITH {_S} SELECT avg((y - p) ** 2) AS brier, 1 - avg((y - p) ** 2) / avg((y - 0.5) ** 2) AS brier_skill FROM s", "brier", "brier_skill"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).agg(stats.brier().alias("brier"), stats.brier_skill(0.5).alias("brier_skill"))


@_add("log_loss", rounded(f"WITH {_S} SELECT -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS log_loss FROM s", "log_loss"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).agg(stats.log_loss().alias("log_loss"))


@_add("auc", rounded(f"WITH {_S}, r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS k FROM s) SELECT (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r", "auc"))
def _(s: SparkSession, d: str) -> DataFrame:
    return stats.roc_auc(_scores(s, d))


_BIN = "least(9, CAST(floor(p * 10) AS INT))"


@_add("ece", rounded(f"WITH {_S}, b AS (SELECT {_BIN} AS bin, count(*) n, avg(p) conf, avg(y) acc FROM s GROUP BY 1) SELECT sum(n * abs(acc - conf)) / sum(n) AS ece FROM b", "ece"))
def _(s: SparkSession, d: str) -> DataFrame:
    return stats.calibration_error(_scores(s, d))


@_add("reliability", rounded(f"WITH {_S}, b AS (SELECT {_BIN} AS bin, avg(p) p_mean, avg(y) y_mean, count(*) AS \"count\" FROM s GROUP BY 1) SELECT CAST(k AS INT) AS bin, coalesce(p_mean, 0.0) AS p_mean, coalesce(y_mean, 0.0) AS y_mean, coalesce(\"count\", 0) AS \"count\" FROM range(10) r(k) LEFT JOIN b ON bin = k", "p_mean", "y_mean"))
def _(s: SparkSession, d: str) -> DataFrame:
    return stats.reliability(_scores(s, d))


@_add("psi", rounded("""WITH r AS (SELECT c_acctbal x FROM customer WHERE c_custkey % 2 = 0), o AS (SELECT c_acctbal * 1.1 + 50 AS x FROM customer WHERE c_custkey % 2 = 1),
q AS (SELECT list_distinct(quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS c FROM r), a AS (SELECT len(list_filter(c, lambda z: z <= x)) AS bin, count(*) n FROM r, q GROUP BY 1), b AS (SELECT len(list_filter(c, lambda z: z <= x)) AS bin, count(*) n FROM o, q GROUP BY 1),
j AS (SELECT greatest(coalesce(a.n, 0) / (SELECT sum(n) FROM a), 1e-6) AS r, greatest(coalesce(b.n, 0) / (SELECT sum(n) FROM b), 1e-6) AS c FROM range(10) k(bin) LEFT JOIN a USING (bin) LEFT JOIN b USING (bin)),
z AS (SELECT r / sum(r) OVER () AS r, c / sum(c) OVER () AS c FROM j) SELECT sum((c - r) * ln(c / r)) AS psi FROM z""", "psi"))
def _(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/customer.parquet")
    return stats.psi(c.where("c_custkey % 2 = 0").select(F.col("c_acctbal").alias("x")), c.where("c_custkey % 2 = 1").select((F.col("c_acctbal") * 1.1 + 50).alias("x")), "x")


@_add("transition_matrix", rounded("WITH t AS (SELECT label AS from_state, lead(label) OVER (ORDER BY vec_id) AS to_state FROM embeddings), n AS (SELECT from_state, to_state, count(*) AS n FROM t WHERE to_state IS NOT NULL GROUP BY ALL) SELECT *, n / CAST(sum(n) OVER (PARTITION BY from_state) AS DOUBLE) AS share FROM n", "share"))
def _(s: SparkSession, d: str) -> DataFrame:
    return stats.transition_matrix(s.read.parquet(f"{d}/embeddings.parquet"), "label", ["vec_id"])


@_add("dwell_times", rounded("WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations), k AS (SELECT conv_id, role, g, count(*) AS n FROM r GROUP BY ALL) SELECT role, count(*) AS runs, avg(n) AS mean_run, max(n) AS longest FROM k GROUP BY 1", "mean_run"))
def _(s: SparkSession, d: str) -> DataFrame:
    c = run_ids(s.read.parquet(f"{d}/conversations.parquet"), ["conv_id"], ["turn"], "role")
    return c.groupBy("conv_id", "run_id", "role").agg(F.count(F.lit(1)).alias("n")).groupBy("role").agg(F.count(F.lit(1)).alias("runs"), F.avg("n").alias("mean_run"), F.max("n").alias("longest"))


@_add("regime_summary", rounded("SELECT label, count(*) AS n, avg(embedding[1]) AS f0, avg(embedding[2]) AS f1, avg(embedding[64]) AS f63 FROM embeddings GROUP BY 1", "f0", "f1", "f63"))
def _(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.get("embedding", F.lit(k))).alias(f"f{k}") for k in (0, 1, 63)])


@_add("session_runs", "WITH r AS (SELECT conv_id, turn, role, CASE WHEN lag(turn) OVER w IS NOT NULL AND role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, CAST(sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run_id FROM r")
def _(s: SparkSession, d: str) -> DataFrame:
    return run_ids(s.read.parquet(f"{d}/conversations.parquet"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "run_id")


# ---- memory and labels over stories (a user's events in time order)

_STORY = """story AS (SELECT user_id, event_id, epoch_us(ts) * 1000 AS availability_ts, value, CAST(event_type = 'click' AS DOUBLE) AS tested, CAST(event_type = 'purchase' AS DOUBLE) AS accepted, CAST(event_type = 'error' AS DOUBLE) AS rejected, event_type FROM events)"""
_O = "(PARTITION BY user_id ORDER BY availability_ts, event_id"
ORDER = ["availability_ts", "event_id"]


def _story(s: SparkSession, d: str) -> DataFrame:
    flag = lambda t: (F.col("event_type") == t).cast("double")
    return s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) * 1000").alias("availability_ts"), "value", flag("click").alias("tested"), flag("purchase").alias("accepted"), flag("error").alias("rejected"), "event_type")


@_add("causal_lags", rounded(f"WITH {_STORY} SELECT event_id, lag(value, 1) OVER {_O}) AS value__lag1, lag(value, 3) OVER {_O}) AS value__lag3 FROM story", "value__lag1", "value__lag3"))
def _(s: SparkSession, d: str) -> DataFrame:
    return labels.causal_lags(_story(s, d), ["value"], ["user_id"], (1, 3), ORDER).select("event_id", "value__lag1", "value__lag3")


_R = lambda n: f"{_O} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@_add("market_memory", rounded(f"WITH {_STORY} SELECT event_id, avg(value) OVER {_R(3)} AS value__rmean3, sum(value) OVER {_R(3)} AS value__rsum3, sum(tested) OVER {_R(3)} AS tested__ecount3, avg(value) OVER {_R(8)} AS value__rmean8, sum(value) OVER {_R(8)} AS value__rsum8, sum(tested) OVER {_R(8)} AS tested__ecount8 FROM story", "value__rmean3", "value__rsum3", "tested__ecount3", "value__rmean8", "value__rsum8", "tested__ecount8"))
def _(s: SparkSession, d: str) -> DataFrame:
    m = labels.market_memory(_story(s, d), ["value"], ["user_id"], events=["tested"], order=ORDER)
    return m.select("event_id", *[c for c in m.columns if "__" in c])


@_add("sequence_memory", f"""WITH {_STORY}, i AS (SELECT *, row_number() OVER {_O}) - 1 AS i, row_number() OVER {_O}) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY availability_ts, event_id) AS g FROM story)
SELECT event_id, CAST(i - coalesce(max(CASE WHEN tested > 0.5 THEN i END) OVER {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS since_test, CAST(coalesce(sum(tested) OVER {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS since_test_count,
  row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY availability_ts, event_id) - 1 AS dwell FROM i""")
def _(s: SparkSession, d: str) -> DataFrame:
    m = labels.time_since(_story(s, d), "tested", ["user_id"], "since_test", ORDER)
    return labels.dwell(m, "event_type", ["user_id"], "dwell", ORDER).select("event_id", "since_test", "since_test_count", "dwell")


_LABELS = f"""WITH {_STORY}, b AS (SELECT *, tested > 0.5 AND NOT coalesce(lag(tested) OVER {_O}) > 0.5, false) AS onset, row_number() OVER {_O}) AS i,
  min(CASE WHEN accepted + rejected > 0 THEN {{{{'i': rn, 'ts': availability_ts, 's': accepted > 0.5, 'f': rejected > 0.5}}}} END) OVER {_O} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS hit,
  count(*) OVER {_O} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS seen, last_value(availability_ts) OVER {_O} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS last FROM (SELECT *, row_number() OVER {_O}) AS rn FROM story))""".replace("{{", "{").replace("}}", "}")
_LABELS = _LABELS.replace("{{", "{").replace("}}", "}")


def _labeled(s: SparkSession, d: str) -> DataFrame:
    return labels.labeled_outcomes(_story(s, d), [labels.Outcome("y_accept", ("tested",), ("accepted",), ("rejected",), 5)], ["user_id"], ORDER)


_LABELED = _LABELS + """, l AS (SELECT user_id, availability_ts AS setup_availability_ts, coalesce(hit.ts, last) AS outcome_available_ts, 'y_accept' AS outcome_name,
  CASE WHEN hit IS NOT NULL AND NOT (hit.s AND hit.f) THEN CAST(hit.s AS DOUBLE) WHEN hit IS NULL AND seen >= 5 THEN 0.0 END AS y, coalesce(hit.i - i, seen) AS horizon_bars,
  CASE WHEN hit.s AND hit.f THEN 'ambiguous' WHEN hit IS NOT NULL OR seen >= 5 THEN 'resolved' ELSE 'censored' END AS label_status FROM b WHERE onset)"""


@_add("labeled_outcomes", _LABELED + " SELECT * FROM l")
def _(s: SparkSession, d: str) -> DataFrame:
    return _labeled(s, d)


@_add("known_by_filter", _LABELED + f" SELECT * FROM l WHERE outcome_available_ts <= {CUT}")
def _(s: SparkSession, d: str) -> DataFrame:
    return labels.known_by(_labeled(s, d), CUT)


@_add("first_transition", _LABELS + """ SELECT user_id, availability_ts AS setup_availability_ts, coalesce(hit.ts, last) AS outcome_available_ts, CASE WHEN hit.s AND NOT hit.f THEN 'accepting' WHEN hit.f AND NOT hit.s THEN 'rejection' WHEN hit IS NULL AND seen >= 5 THEN 'no_transition' END AS first_transition_class,
  coalesce(hit.i - i, seen) AS horizon_bars, CASE WHEN hit.s AND hit.f THEN 'ambiguous' WHEN hit IS NOT NULL OR seen >= 5 THEN 'resolved' ELSE 'censored' END AS label_status FROM b WHERE onset""")
def _(s: SparkSession, d: str) -> DataFrame:
    return labels.first_transition(_story(s, d), "tested", {"accepting": "accepted", "rejection": "rejected"}, 5, ["user_id"], ORDER)


_WAVE = f"""WITH {_STORY}, o AS (SELECT *, min(CASE WHEN tested > 0.5 THEN availability_ts END) OVER (PARTITION BY user_id) AS onset FROM story), a AS (SELECT * FROM o WHERE availability_ts >= onset),
w AS (SELECT user_id, min(onset) AS wave_onset_ts, arg_max(availability_ts, {{'v': value, 't': -availability_ts}}) AS wave_peak_ts, max(availability_ts) AS wave_end_ts, arg_min(value, availability_ts) AS onset_extent, max(value) AS wave_peak,
  min(availability_ts) FILTER (value >= 60) AS expansion_start_ts, arg_min(value, availability_ts) FILTER (value >= 60) AS expansion_start_extent, count(*) AS n_bars_after_onset FROM a GROUP BY 1),
g AS (SELECT w.*, n_bars, greatest(0.0, wave_peak - coalesce(expansion_start_extent, 0.0)) AS expansion_run FROM w JOIN (SELECT user_id, count(*) AS n_bars FROM story GROUP BY 1) USING (user_id))"""


def _waves(s: SparkSession, d: str) -> DataFrame:
    return labels.wave_geometry(_story(s, d), "user_id", "value", F.col("tested") > 0.5, 60.0)


@_add("wave_geometry", rounded(_WAVE + " SELECT * FROM g", "onset_extent", "wave_peak", "expansion_start_extent", "expansion_run"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _waves(s, d)


@_add("wave_bins", rounded(_WAVE + """, f AS (SELECT story.user_id, CASE WHEN wave_peak > 0 THEN value / wave_peak END AS fraction FROM story JOIN g USING (user_id) WHERE tested > 0.5), c AS (SELECT *, CASE WHEN fraction < 0.2 THEN 'early_prediction' WHEN fraction < 0.4 THEN 'early_continuation' WHEN fraction < 0.6 THEN 'mid_wave' WHEN fraction IS NOT NULL THEN 'late_prediction' END AS wave_bin FROM f)
SELECT wave_bin, count(*) AS n, avg(fraction) AS mean_fraction, quantile_cont(fraction, 0.5) AS median_fraction FROM c GROUP BY 1""", "mean_fraction", "median_fraction"))
def _(s: SparkSession, d: str) -> DataFrame:
    f = _story(s, d).where("tested > 0.5").join(_waves(s, d).select("user_id", "wave_peak"), "user_id").withColumn("fraction", F.when(F.col("wave_peak") > 0, F.col("value") / F.col("wave_peak")))
    return f.withColumn("wave_bin", labels.wave_bin(F.col("fraction"))).groupBy("wave_bin").agg(F.count(F.lit(1)).alias("n"), F.avg("fraction").alias("mean_fraction"), F.percentile("fraction", 0.5).alias("median_fraction"))


@_add("first_per_story", rounded(f"WITH {_STORY} SELECT user_id, event_id, availability_ts, value FROM story WHERE value > 50 QUALIFY row_number() OVER {_O}) = 1", "value"))
def _(s: SparkSession, d: str) -> DataFrame:
    return labels.first_per_group(_story(s, d).where("value > 50").select("user_id", "event_id", "availability_ts", "value"), ["user_id"], ORDER)


# ---- descriptors and sequences


@_add("mbo_descriptors", rounded(f"WITH {MBO} SELECT instrument_id, event_ts - event_ts % {H1} AS bucket_start, count(*) FILTER (action='A') AS add_count, count(*) FILTER (action='C') AS cancel_count, count(*) FILTER (action='F') AS fill_count, count(*) FILTER (action='T') AS trade_count, CAST(coalesce(sum(size) FILTER (action='T'), 0) AS BIGINT) AS trade_volume, count(*) FILTER (action='C') / CAST(count(*) FILTER (action='A') + 1 AS DOUBLE) AS cancel_ratio FROM mbo GROUP BY ALL", "cancel_ratio"))
def _(s: SparkSession, d: str) -> DataFrame:
    return descriptors(source.events_as_mbo(s, d), H1)


def descriptors(m: DataFrame, interval_ns: int) -> DataFrame:
    """Counts by action, traded volume and cancel ratio of each bucket."""
    n = lambda a: F.count_if(F.col("action") == a)
    b = tape.add_time_bucket(m, interval_ns).groupBy("instrument_id", "bucket_start").agg(n("A").alias("add_count"), n("C").alias("cancel_count"), n("F").alias("fill_count"), n("T").alias("trade_count"), F.coalesce(F.sum(F.when(F.col("action") == "T", F.col("size"))), F.lit(0)).alias("trade_volume"))
    return b.withColumn("cancel_ratio", F.col("cancel_count") / (F.col("add_count") + 1))


def book_descriptors(m: DataFrame, interval_ns: int) -> DataFrame:
    """descriptors with last mid and spread, and the change of resting size at the top, of each bucket."""
    tob = tape.add_time_bucket(book.top_of_book(m), interval_ns)
    at, size = F.struct("event_ts", "sequence"), F.coalesce("bid_size", F.lit(0)) + F.coalesce("ask_size", F.lit(0))
    b = tob.groupBy("instrument_id", "bucket_start").agg(F.max_by((F.col("best_bid") + F.col("best_ask")) / 2, at).alias("mid"), F.max_by(F.col("best_ask") - F.col("best_bid"), at).alias("spread"), F.abs(F.max_by(size, at) - F.min_by(size, at)).alias("depth_change"))
    return descriptors(m, interval_ns).join(b, ["instrument_id", "bucket_start"], "left").withColumns({"spread": F.coalesce("spread", F.lit(0)), "depth_change": F.coalesce("depth_change", F.lit(0))})


@_add("book_descriptors")
def _(s: SparkSession, d: str) -> DataFrame:
    return book_descriptors(source.events_as_mbo(s, d), H1)


def sequences(df: DataFrame, columns: list[str], window: int, stride: int, group: list[str], order: list[str]) -> DataFrame:
    """Full sliding windows of feature rows, every `stride` rows, at their last row."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = df.withColumns({"window": F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w.rowsBetween(-(window - 1), 0)), "_i": F.row_number().over(w)})
    return rows.where((F.col("_i") >= window) & ((F.col("_i") - window) % stride == 0)).select(*group, *order, "window")


@_add("sequences", _BARS + ", w AS (SELECT instrument_id, bucket_start, list([round(volume, 6), round(delta, 6)]) OVER (PARTITION BY instrument_id ORDER BY bucket_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x, row_number() OVER (PARTITION BY instrument_id ORDER BY bucket_start) AS i FROM bars) SELECT instrument_id, bucket_start, array_to_string(list_transform(flatten(x), lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS \"window\" FROM w WHERE i >= 4 AND (i - 4) % 2 = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    q = sequences(_bars(s, d), ["volume", "delta"], 4, 2, ["instrument_id"], ["bucket_start"])
    return q.withColumn("window", F.array_join(F.transform(F.flatten("window"), lambda v: v.cast("bigint").cast("string")), ","))


def _book_sql() -> None:
    """SQL of book_descriptors, from the book's SQL."""
    from .book_queries import TOB

    b = f"event_ts - event_ts % {H1}"
    SQL["book_descriptors"] = rounded(
        f"""WITH RECURSIVE {TOB}, d AS (SELECT instrument_id, {b} AS bucket_start, count(*) FILTER (action='A') AS add_count, count(*) FILTER (action='C') AS cancel_count, count(*) FILTER (action='F') AS fill_count, count(*) FILTER (action='T') AS trade_count, CAST(coalesce(sum(size) FILTER (action='T'), 0) AS BIGINT) AS trade_volume FROM mbo GROUP BY 1, 2),
k AS (SELECT instrument_id, {b} AS bucket_start, arg_max((best_bid + best_ask) / 2.0::DOUBLE, (event_ts, sequence)) AS mid_, arg_max({{'m': (best_bid + best_ask) / 2.0::DOUBLE, 's': best_ask - best_bid}}, (event_ts, sequence)) AS x,
  abs(arg_max(coalesce(bid_size, 0) + coalesce(ask_size, 0), (event_ts, sequence)) - arg_min(coalesce(bid_size, 0) + coalesce(ask_size, 0), (event_ts, sequence))) AS depth_change FROM tob GROUP BY 1, 2)
SELECT d.*, cancel_count / CAST(add_count + 1 AS DOUBLE) AS cancel_ratio, x.m AS mid, coalesce(x.s, 0) AS spread, depth_change FROM d JOIN k USING (instrument_id, bucket_start)""",
        "cancel_ratio",
        "mid",
    )


_book_sql()
