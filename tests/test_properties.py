"""Properties that hold for any input."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.functions import stats
from marketloom.operators import auction, book, models, tape

HOUR = tape.HOUR
LEVELS = st.dictionaries(st.integers(1, 60), st.integers(1, 20), min_size=1, max_size=25)
EVENTS = st.lists(st.tuples(st.sampled_from("AACMRTFN"), st.sampled_from("BA"), st.integers(90, 110), st.integers(0, 9), st.integers(0, 8)), max_size=60)


@given(LEVELS, st.floats(0.1, 1.0))
def test_value_area_bounds_and_coverage(levels, fraction):
    poc, vah, val, total = auction.value_area_of(levels, fraction)
    inside = sum(v for p, v in levels.items() if val <= p <= vah)
    assert val <= poc <= vah and levels[poc] == max(levels.values()) and total == sum(levels.values())
    assert inside >= fraction * total - 1e-9 and {poc, vah, val} <= set(levels)


@given(EVENTS)
def test_book_conserves_volume(events):
    b = book.Book()
    for e in events:
        b.apply(*e)
        for bid, side in ((True, b.bids), (False, b.asks)):
            own: dict[int, int] = {}
            for s, p, z in b.orders.values():
                if s == bid and z:
                    own[p] = own.get(p, 0) + z
            assert {p: z for p, z in side.sizes.items() if z} == own and side.total == sum(own.values())
            assert side.order == sorted(side.order) and len(side.order) == len(side.sizes)


@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=80), st.integers(0, 99))
def test_block_permutation_keeps_values(x, seed):
    assert sorted(models.block_permutation(np.array(x), np.random.default_rng(seed)).tolist()) == sorted(x)


@given(st.lists(st.floats(-100, 100), min_size=5, max_size=60))
@settings(deadline=None)
def test_distance_correlation_is_within_bounds(x):
    v = np.array(x)
    d = models.distance_correlation(v, v[::-1])
    assert 0 <= d <= 1 + 1e-9 and (np.ptp(v) < 1e-6 or abs(models.distance_correlation(v, v) - 1) < 1e-6)


def _tape(spark, seed, n=200):
    rng = random.Random(seed)
    rows = [(rng.randrange(0, 40) * HOUR // 4, i, "T", rng.choice("BAN"), rng.randrange(90, 110) * 250_000_000, rng.randrange(1, 20), i, 1) for i in range(n)]
    return spark.createDataFrame(rows, "event_ts bigint, sequence bigint, action string, side string, price bigint, size bigint, order_id bigint, instrument_id bigint")


def test_flow_properties(spark):
    for seed in (1, 2):
        t = _tape(spark, seed)
        a = tape.footprint_summary(t, HOUR).orderBy("bucket_start").toPandas()
        assert (a.delta == a.buy_volume - a.sell_volume).all() and (a.cumulative_delta == a.delta.cumsum()).all()
        flipped = t.withColumn("side", F.translate("side", "AB", "BA"))
        b = tape.footprint_summary(flipped, HOUR).orderBy("bucket_start").toPandas()
        assert (a.delta == -b.delta).all() and (a.total_volume == b.total_volume).all()
        shifted = tape.footprint_summary(t.withColumn("event_ts", F.col("event_ts") + 7 * HOUR), HOUR).orderBy("bucket_start").toPandas()
        assert (shifted.bucket_start == a.bucket_start + 7 * HOUR).all() and (shifted.delta == a.delta).all()
        cells = tape.footprint_cells(t, HOUR).groupBy("bucket_start").agg(F.sum("delta").alias("d")).orderBy("bucket_start").toPandas()
        assert (cells.d == a.delta).all()


def test_adjusted_p_values_are_ordered(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"k": range(80), "p": rng.random(80) ** 2}))
    for method in ("bonferroni", "holm", "bh"):
        r = stats.adjust(df, "p", method).orderBy("p").toPandas()
        assert (r.adjusted >= r.p - 1e-12).all() and (r.adjusted <= 1).all() and r.adjusted.is_monotonic_increasing


def test_scaler_centres_and_full_rank_pca_is_exact(spark):
    x = np.random.default_rng(6).normal(size=(60, 3)) * [1, 5, 9] + 4
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    scaled = models.fit_scaler(df, list("abc")).transform(df).toPandas()
    assert np.allclose(scaled.mean(), 0) and np.allclose(scaled.std(ddof=0), 1)
    pca = models.fit_pca(df, list("abc"), 3)
    back = pca.reconstruct(pca.transform(df)).toPandas()
    assert np.allclose(back[["r_a", "r_b", "r_c"]].to_numpy(), back[["a", "b", "c"]].to_numpy())


def test_adjusted_p_values_with_ties_keys_and_no_look_back_over_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), str(g), float(p)) for k, (g, p) in enumerate(zip(rng.integers(0, 3, 90), rng.integers(0, 12, 90) / 11, strict=True))] + [(90, None, 0.25), (91, None, 0.5)]
    df = spark.createDataFrame(rows, "k bigint, g string, p double")
    for method in ("bonferroni", "holm", "bh"):
        made = stats.adjust(df, "p", method, keys=["g"])
        want = {}
        for g in {r[1] for r in rows}:
            own = sorted((p, k) for k, h, p in rows if h == g)
            m, v = len(own), [p for p, _ in own]
            scaled = {"bonferroni": [p * m for p in v], "holm": list(np.maximum.accumulate([p * (m - i) for i, p in enumerate(v)])), "bh": list(np.minimum.accumulate([p * m / (i + 1) for i, p in enumerate(v)][::-1])[::-1])}[method]
            want |= {k: min(1.0, x) for (_, k), x in zip(own, scaled, strict=True)}
        got = {r.k: r.adjusted for r in made.collect()}
        assert got == {k: pytest.approx(x) for k, x in want.items()} and made.columns == ["k", "g", "p", "adjusted", "reject"]
        plan = made._jdf.queryExecution().executedPlan().toString()
        # a frame to the end of a window is evaluated anew at each row
        assert "currentrow$(), unboundedfollowing$()" not in plan and "row_number" not in plan
