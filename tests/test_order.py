"""Running aggregates, prefix sums, quantiles, top shares and metrics against brute force."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripen.operators import calibration, metrics, numerics, ranking
from ripen.operators.running import Measure, find_hot_keys, running_by_key

START = dt.datetime(2024, 1, 1)


def skewed(spark, n=3000):
    """One user holds half of the rows; some of its rows share a moment."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < 0.5 else f"u{rng.randrange(200)}"
        rows.append((i, user, START + dt.timedelta(seconds=rng.randrange(2000)),
                     rng.randrange(3), rng.choice([None, rng.random()])))
    return spark.createDataFrame(rows, "i int, u string, t timestamp, v int, x double")


MEASURES = [
    Measure("before", "v", "sum"), Measure("upto", "v", "sum", inclusive=True),
    Measure("highest", "x", "max"), Measure("later", "x", "min", descending=True, inclusive=True),
    Measure("last", "t", "max"),
]


def test_sliced_running_aggregates_equal_plain_windows(spark):
    df = skewed(spark)
    hot = find_hot_keys(df, "u", max_rows=60)
    assert [r["u"] for r in hot.places.collect()] == ["hot"] and hot.n == 1 and hot.n_rows > 1200
    plain = running_by_key(df, "u", ["t", "i"], MEASURES)
    sliced = running_by_key(df, "u", ["t", "i"], MEASURES, hot=hot)
    assert sliced.columns == plain.columns
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, sliced.collect()), key=str)


def test_a_user_whose_rows_share_one_second_is_sliced(spark):
    """Slices are ranges of (time, id), so no slice is larger than the bound, however many rows share a moment."""
    from ripen.operators import running

    moment = dt.datetime(2024, 1, 1, 7)
    rows = [(i, "one" if i % 3 else f"u{i % 9}", moment, i % 5, None if i % 7 == 0 else i / 10) for i in range(2400)]
    rows += [(3000 + i, None, moment, 1, 0.5) for i in range(700)]  # rows without a user are a group as well
    df = spark.createDataFrame(rows, "i int, u string, t timestamp, v int, x double")
    hot = find_hot_keys(df, "u", max_rows=500)
    assert hot.n == 2 and hot.n_rows == 2300
    ranged, totals, _ = running.slices(df.filter("u = 'one'"), "u", ["t", "i"], MEASURES, hot)
    assert 1600 / 500 <= totals.count() and totals.agg(F.max("_rows")).first()[0] <= 500
    sliced = running_by_key(df, "u", ["t", "i"], MEASURES, hot=hot)
    plain = running_by_key(df, "u", ["t", "i"], MEASURES)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, sliced.collect()), key=str)


def test_no_hot_keys_keeps_the_plain_plan(spark):
    assert find_hot_keys(skewed(spark), "u").places is None


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("max_rows", [10, 1_000_000])
def test_prefix_sums(spark, descending, max_rows):
    rng = random.Random(1)
    values = sorted({rng.random() for _ in range(500)})
    rows = [(g, v, rng.randrange(5)) for g in ("a", "b") for v in values]
    df = spark.createDataFrame(rows, "g string, x double, n long")
    out = ranking.prefix_sums(df, "x", ["n"], by=["g"], descending=descending, max_rows=max_rows)
    got = {(r.g, r.x): r.n_before for r in out.collect()}
    for g in ("a", "b"):
        total = 0
        for _, v, n in sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending):
            assert got[g, v] == total
            total += n


@pytest.mark.parametrize("max_rows", [20, 1_000_000])
def test_exact_quantiles_equal_numpy(spark, max_rows):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(997), 2)
    df = spark.createDataFrame([(float(v), 0) for v in p], "p double, y int")
    shares = [i / 10 for i in range(11)]
    got = ranking.exact_quantiles(df.withColumn("g", F.lit(1)), shares, by=["g"], max_rows=max_rows).first()
    assert np.allclose(got["quantiles"], np.quantile(p, shares), atol=1e-12)


def brute(rows):
    """Metrics of (id, y, p) by their definitions."""
    n, pos = len(rows), sum(y for _, y, _ in rows)
    clip = [min(max(p, 1e-15), 1 - 1e-15) for _, _, p in rows]
    nll = -sum(math.log(q) if y else math.log(1 - q) for (_, y, _), q in zip(rows, clip)) / n
    base = pos / n
    q0 = min(max(base, 1e-15), 1 - 1e-15)
    nll0 = -(base * math.log(q0) + (1 - base) * math.log(1 - q0))
    out = {"nll_mean": nll, "rce": (1 - nll / max(nll0, 1e-15)) * 100, "base_rate": base}
    ap = area = 0.0
    recall, precision = 0.0, 1.0
    for score in sorted({p for _, _, p in rows}, reverse=True):
        chosen = [y for _, y, p in rows if p >= score]
        r = sum(chosen) / pos if pos else 1.0
        pr = sum(chosen) / len(chosen)
        ap += (r - recall) * pr
        area += (r - recall) * (pr + precision) / 2
        recall, precision = r, pr
    out |= {"ap": ap, "pr_auc": area}
    ordered = sorted(rows, key=lambda r: (-r[2], hashlib.md5(str(r[0]).encode()).hexdigest()))
    for f in (0.05, 0.1, 0.2):
        k = max(1, round(f * n))
        tp = sum(y for _, y, _ in ordered[:k])
        s = int(round(f * 100))
        out |= {f"prec_{s}": tp / k, f"recall_{s}": tp / pos if pos else 0.0,
                f"lift_{s}": tp / k / base if base else 0.0}
    return out


@pytest.mark.parametrize("digits,max_rows", [(1, 1_000_000), (2, 10), (6, 50)])
def test_metrics_equal_their_definitions(spark, digits, max_rows):
    rng = random.Random(digits)
    rows = []
    for i in range(450):
        p = round(rng.random(), digits)
        rows.append((i, int(rng.random() < p), p))
    df = spark.createDataFrame(rows, "impression_id long, y int, p double")
    got = metrics.evaluate(df, max_rows=max_rows).first().asDict()
    want = brute([(i, y, min(max(p, 1e-15), 1 - 1e-15)) for i, y, p in rows])
    assert set(got) == set(metrics.METRICS)
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-9), name


def test_grouped_metrics_equal_single_ones(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), int(rng.random() < 0.3), round(rng.random(), 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "impression_id long, g string, y int, p double")
    grouped = {r.g: r.asDict() for r in metrics.evaluate(df, by=["g"]).collect()}
    for g in "ab":
        single = metrics.evaluate(df.filter(F.col("g") == g).drop("g")).first().asDict()
        assert {k: v for k, v in grouped[g].items() if k != "g"} == pytest.approx(single)


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(i, 0, 0.1 * i) for i in range(5)], "impression_id long, y int, p double")
    got = metrics.evaluate(df).first()
    assert got.ap == 0.0 and got.pr_auc == 0.5 and got.lift_20 == 0.0 and got.recall_20 == 0.0


def test_share_rounds_half_to_even_and_takes_at_least_one(spark):
    df = spark.createDataFrame([(i, 1, 0.5) for i in range(50)], "impression_id long, y int, p double")
    hits = metrics.top_hits(df, ranking.score_table(df), shares=(0.05, 0.001)).collect()
    assert {(r["share"], r.k) for r in hits} == {(5, 2), (0, 1)}


def test_reliability_with_one_score(spark):
    df = spark.createDataFrame([(i, i % 2, 0.3) for i in range(10)], "impression_id long, y int, p double")
    bins = metrics.reliability(df).collect()
    assert len(bins) == 1 and bins[0].n == 10 and bins[0].mean_y == 0.5
    assert metrics.calibration_error(df).first().ece == pytest.approx(0.2)


def test_reliability_equals_digitize(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(500), 2)
    y = (rng.random(500) < p).astype(int)
    edges = np.unique(np.quantile(p, np.linspace(0, 1, 11)))
    ids = np.digitize(p, edges[1:-1], right=True)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                               "impression_id long, y int, p double")
    for row in metrics.reliability(df, max_rows=15).collect():
        inside = ids == row.bin
        assert row.n == inside.sum()
        assert row.mean_p == pytest.approx(p[inside].mean()) and row.mean_y == pytest.approx(y[inside].mean())


def test_box_stats(spark):
    values = [0.1, 0.2, 0.3, 0.4, 0.95]
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(values)], "impression_id long, y int, p double")
    row = metrics.box_stats(df).first()
    assert (row.q1, row.median, row.q3) == pytest.approx((0.2, 0.3, 0.4))
    assert (row.whisker_low, row.whisker_high) == pytest.approx((0.1, 0.4))


def test_average_row_skips_nan(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan")), (2, 3.0, 4.0)], "fold_id int, rce double, ap double")
    rows = {r.fold_id: r for r in metrics.average_folds(df).collect()}
    assert rows["AVG"].rce == 2.0 and rows["AVG"].ap == 4.0 and set(rows) == {"1", "2", "AVG"}


def test_platt_intercept_matches_the_base_rate(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(-1, 1.5, 800)
    y = (rng.random(800) < 1 / (1 + np.exp(-(0.5 * x + 1.0)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    platt = calibration.fit_platt(df, "x", "y")
    mean = df.agg(F.avg(calibration.apply_platt(F.col("x"), platt))).first()[0]
    assert platt.slope == 1.0 and mean == pytest.approx(y.mean(), abs=1e-8)
    both = calibration.fit_platt(df, "x", "y", slope=True)
    assert both.slope == pytest.approx(0.5, abs=0.12) and both.intercept == pytest.approx(1.0, abs=0.25)


@pytest.mark.parametrize("labels", [[], [0, 0, 0], [1, 1]])
def test_platt_without_both_classes_is_the_identity(spark, labels):
    df = spark.createDataFrame([(0.3, y) for y in labels], "x double, y int")
    assert calibration.fit_platt(df, "x", "y", slope=True) == calibration.Platt(1.0, 0.0)


def test_scales_of_degenerate_columns(spark):
    df = spark.createDataFrame([(5.0, None, -3.0), (5.0, None, 8.0)], "same double, gone double, mixed double")
    scales = numerics.fit_scales(df, ["same", "gone", "mixed"], kind="auto")
    assert scales["same"].kind == "log" and scales["same"].deviation == 1.0
    assert scales["gone"] == numerics.Scale("log1p", 0.0, 1.0)
    assert scales["mixed"].kind == "log1p" and scales["mixed"].mean == pytest.approx(math.log(9) / 2)
    out = numerics.add_scaled(df, scales).first()
    assert out.gone_z == 0.0 and out.gone_miss == 1 and out.same_z == 0.0
    odd = spark.createDataFrame([(0.0,)], "same double")
    assert numerics.add_scaled(odd, {"same": scales["same"]}).first().same_z == 0.0


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("part_rows", [1, 250_000])
def test_prefix_sums_of_texts_cut_pieces_again(spark, monkeypatch, descending, part_rows):
    """Texts and nulls are ordered, groups too, and pieces of more than 40 rows are cut until none is left."""
    monkeypatch.setattr(ranking, "PART_ROWS", part_rows)
    rng = random.Random(3)
    texts = sorted({"".join(rng.choices("abé", k=rng.randint(0, 7))) for _ in range(600)})
    rows = [(g, v, 1) for g in ("a", None) for v in [*texts, None]]
    df = spark.createDataFrame(rows, "g string, x string, n long")
    out = ranking.prefix_sums(df, "x", ["n"], by=["g"], descending=descending, max_rows=40, totals=True).collect()
    order = [None, *sorted(texts, key=str.encode)]
    place = {v: i for i, v in enumerate(order[::-1] if descending else order)}
    assert {(r.g, r.x): r.n_before for r in out} == {(g, v): place[v] for g, v, _ in rows}
    assert {r.n_total for r in out} == {len(order)} and len(out) == len(rows)


def test_a_large_piece_is_cut_again(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PART_ROWS", 1)
    df = spark.range(5000).select(F.col("id").alias("x"), F.lit(1).alias("n"))
    _, totals, n = ranking.range_pieces(df, [], [F.col("x").asc()], [F.sum("n").alias("n")], 40, 100)
    rows = totals.orderBy("_piece").collect()
    assert n == len(rows) and max(r["_rows"] for r in rows) <= 100 and sum(r["n"] for r in rows) == 5000
    assert {len(r["_piece"]) for r in rows} == {2}  # 8 pieces for 40 expected rows, all of them cut again
    same = spark.range(500).select(F.lit(1).alias("x"), F.lit(1).alias("n"))
    with pytest.raises(ValueError, match="equal"):
        ranking.range_pieces(same, [], [F.col("x").asc()], [F.sum("n").alias("n")], 40, 100)


def test_groups_are_calibrated_as_alone(spark):
    """Folds side by side, one of them with a single class, one with a null name."""
    rng = random.Random(9)
    rows = []
    for i in range(900):
        g = (None, "a", "b")[i % 3]
        x = rng.gauss(0, 2)
        chance = 1 / (1 + math.exp(-(0.5 * x + (1 if g == "a" else -1))))
        rows.append((g, x, 0 if g == "b" else int(rng.random() < chance)))
    df = spark.createDataFrame(rows, "g string, x double, y int")
    for slope in (False, True):
        found = calibration.fit_platt_groups(df, "x", "y", ["g"], slope=slope)
        assert found["b",] == calibration.Platt() and len(found) == 3
        for g in (None, "a"):
            alone = calibration.fit_platt(df.filter(F.col("g").eqNullSafe(F.lit(g))), "x", "y", slope=slope)
            assert (found[g,].slope, found[g,].intercept) == pytest.approx((alone.slope, alone.intercept), abs=1e-9)
    test = df.withColumn("id", F.monotonically_increasing_id())
    out = calibration.calibrate_groups(df.filter("g <> 'a' OR g IS NULL"), test, "x", "y", ["g"], slope=True)
    assert out.count() == 900
    far = out.filter("g = 'a' OR g = 'b'").agg(F.max(F.abs(F.col("p") - 1 / (1 + F.exp(-F.col("x")))))).first()[0]
    assert far < 1e-12


def test_a_newton_step_of_all_groups_is_one_aggregate(spark):
    from ripen.session import cut

    def jobs_of(n):
        df = cut(spark.range(400).select((F.col("id") % n).alias("g"), (F.col("id") / 100 - 2).alias("x"), (F.hash("id") % 2 == 0).cast("int").alias("y")))
        spark.sparkContext.setJobGroup(f"newton-{n}", "")
        calibration.fit_platt_groups(df, "x", "y", ["g"], max_steps=3)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"newton-{n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    assert jobs_of(14) < 3 * jobs_of(1)
