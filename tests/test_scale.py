"""Forms of the operators that hold at any size, against the plain forms: stable cells, blocks of time, long series."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridregimes.functions import grouped
from gridregimes.operators import climatology, composites, fields, kriging, patterns, percentiles, series, spectra
from gridregimes.sources import indices, places, tables

FIELD = "variable string, time date, cell_id long, lat double, lon double, value double"


def test_a_place_has_one_cell_whatever_is_read(spark, tmp_path):
    """Latitude 10 is in both files, at another rank."""
    for name, lats in (("a", (0.0, 10.0, 20.0)), ("b", (10.0, 20.0, 15.0))):
        spark.createDataFrame([("2000-01-01", lat, lon, lat + lon) for lat in lats for lon in (5.0, 7.5)], "time string, lat double, lon double, v double").write.parquet(f"file://{tmp_path}/{name}")
    paths = {x: [f"file://{tmp_path}/{y}" for y in x] for x in ("a", "b", "ab")}
    known = f"file://{tmp_path}/places"
    for kept in (None, known):
        found = {}
        for x in ("b", "a", "ab"):
            rows = tables.read_field(spark, paths[x], "v", places=kept).select("cell_id", "lat", "lon").collect()
            assert len({r.cell_id for r in rows}) == len({(r.lat, r.lon) for r in rows}) == len(rows)
            for r in rows:
                assert found.setdefault((r.lat, r.lon), r.cell_id) == r.cell_id
        assert len(found) == 8 and len(set(found.values())) == 8
    codes = {(r.axis, r.place): r.code for r in spark.read.parquet(known).collect()}
    assert codes == {("lat", 10.0): 0, ("lat", 15.0): 1, ("lat", 20.0): 2, ("lat", 0.0): 3, ("lon", 5.0): 0, ("lon", 7.5): 1}


def test_cells_of_odd_coordinates(spark):
    rows = [(-0.0, 0.0), (0.0, 0.0), (90.0, 360.0), (-90.0, -360.0), (10.0001, 5.0), (10.0002, 5.0), (5e6, 3e5), (5e6, 3e5 + 1), (None, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "lat double, lon double").select(places.coordinate_cell(F.col("lat"), F.col("lon"))).collect()]
    assert got[0] == got[1] and len(set(got[:8])) == 7 and all(x >= 0 for x in got[:6]) and all(x < 0 for x in got[6:8])


def made_field(spark, seed, cells=3):
    """Months with many days, with few, with none, and missing values."""
    rng, rows = random.Random(seed), []
    for c in range(cells):
        for month in range(30):
            for day in sorted(rng.sample(range(1, 29), rng.choice([0, 0, 1, 2, 3, 6, 28]))):
                rows.append(("v", dt.date(2000 + month // 12, month % 12 + 1, day), c, 1.0 * c, 2.0, None if rng.random() < 0.05 else rng.randint(-99, 99) / 4))
    return spark.createDataFrame(rows, FIELD)


@pytest.mark.parametrize("width", [1, 2, 3, 10, 40])
def test_low_pass_by_blocks(spark, width):
    df = made_field(spark, width).cache()
    plain = lambda x: sorted(((r.cell_id, r.time, r.value) for r in x.collect()), key=str)
    want = plain(fields.low_pass(df, width))
    assert plain(fields.low_pass_blocks(df, width)) == want
    assert plain(fields.low_pass_blocks(df, width, (6, 7, 8))) == [x for x in want if x[1].month in (6, 7, 8)]
    assert plain(fields.low_pass_blocks(df, width, block=F.floor(F.unix_date("time") / 11))) == want
    assert fields.low_pass_blocks(spark.createDataFrame([], FIELD), width).count() == 0
    df.unpersist()


def test_anomaly_by_means(spark):
    df = made_field(spark, 77)
    a, b = ({(r.cell_id, r.time): r.value for r in f(df).collect()} for f in (fields.monthly_anomaly, fields.anomaly_from_means))
    assert a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-9) for k in a)


@pytest.mark.parametrize("inside", [False, True])
def test_bucketed_field_needs_no_exchange(spark, tmp_path, inside):
    df = made_field(spark, 5, cells=9)
    places.write_cells(df, "cells_of_test", 4, f"file://{tmp_path}/cells" if inside else None)
    try:
        found = fields.low_pass(fields.monthly_anomaly(spark.table("cells_of_test")))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        want = {(r.cell_id, r.time): r.value for r in fields.low_pass(fields.monthly_anomaly(df)).collect()}
        got = {(r.cell_id, r.time): r.value for r in found.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    finally:
        spark.sql("DROP TABLE cells_of_test")


def sign_sum_by_hand(t, v):
    t, v = np.asarray(t), np.asarray(v)
    return int((np.sign(t[None] - t[:, None]).clip(0) * np.sign(v[None] - v[:, None])).sum())


def test_sign_sums_of_many_series():
    rng = np.random.default_rng(1)
    sizes = [0 + k for k in (1, 2, 3, 40, 1, 200, 7)]
    sides = [[rng.integers(0, m, n) for n in sizes] for m in (9, 6)]
    order = [np.lexsort((v, t)) for t, v in zip(*sides)]
    t, v = (np.concatenate([x[o] for x, o in zip(s, order)]).astype(float) for s in sides)
    got = grouped.sign_sums(t, v, np.r_[0, np.cumsum(sizes)])
    assert got.tolist() == [sign_sum_by_hand(a, b) for a, b in zip(*sides)]


@pytest.mark.parametrize("long", [1 << 18, 15])
def test_mann_kendall_of_any_length(spark, monkeypatch, long):
    """Ties of time and value, nulls, a value that a third of all rows share; with and without cuts."""
    monkeypatch.setattr(series, "LONG", long)
    monkeypatch.setattr(series, "PARTS", 8)
    rng = random.Random(6)
    rows = {k: [(rng.randint(0, m), rng.choice([None, 3.0, 3.0, rng.randint(0, 9) / 2, rng.random()])) for _ in range(n)] for k, n, m in (("a", 150, 10_000), ("b", 80, 12), ("c", 10, 20), ("d", 1, 1), (None, 40, 99))}
    df = spark.createDataFrame([(k, t, v) for k, x in rows.items() for t, v in x], "k string, year int, value double").repartition(3)
    got = {r.k: r.S for r in series.sign_sum(df.where("value IS NOT NULL").withColumnRenamed("year", "t"), ["k"]).collect()}
    want = {k: sign_sum_by_hand(*zip(*[x for x in own if x[1] is not None])) for k, own in rows.items() if any(v is not None for _, v in own)}
    assert got == want


def test_mann_kendall_of_a_million_rows(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("year"), ((F.col("id") * 7919) % 1009 + F.col("id") / 5e5).alias("value")).repartition(4)
    began = time.time()
    found = series.mann_kendall(df, ["k"]).first()
    took = time.time() - began
    v = np.arange(n) * 7919 % 1009 + np.arange(n) / 5e5
    assert found.S == grouped.sign_sums(np.arange(n, dtype=float), v, np.array([0, n]))[0]
    assert found.S == 2 * int(n * (n - 1) / 2 - inversions(v)) - n * (n - 1) // 2
    assert took < 90


def inversions(v):
    """By merging halves."""
    if len(v) < 2:
        return 0
    a, b = v[: len(v) // 2], v[len(v) // 2 :]
    return inversions(a) + inversions(b) + int((len(a) - np.searchsorted(np.sort(a), b, "right")).sum()) if len(v) > 64 else int((np.triu(v[:, None] > v[None], 1)).sum())


def test_spectrum_of_12000_days(spark):
    n = 12_000
    x = np.sin(2 * np.pi * np.arange(n) / 365.25) + np.arange(n) * 7919 % 101 / 50
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)] + [("b", t, float(t % 3)) for t in range(7)] + [("c", 1, 2.0)] + [("d", t, None) for t in range(4)], "s string, year int, value double")
    got = {(r.s, r.k): r.power for r in spectra.ordinates(df.repartition(3), ["s"]).collect()}
    want = np.abs(np.fft.fft(x - x.mean()))[: n // 2 + 1] ** 2 / n
    assert [got["a", k] for k in range(n // 2 + 1)] == pytest.approx(want.tolist(), abs=1e-6)
    assert sorted(k for s, k in got if s == "b") == [0, 1, 2, 3] and sorted(k for s, k in got if s == "c") == [0, 1]
    assert got["c", 0] == got["c", 1] == 0 and [got["d", k] for k in range(3)] == [None] * 3


def test_cross_correlation_of_long_and_broken_series(spark):
    n = 3_000
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=n), rng.normal(size=n)
    a = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "a string, year int, value double")
    b = spark.createDataFrame([("b", t, float(v)) for t, v in enumerate(y)] + [("gaps", t, None if t % 3 == 0 else float(t % 5)) for t in range(8)] + [("flat", t, 0.1) for t in range(9)], "b string, year int, value double")
    got = {(r.b, r.lag): r.correlation for r in spectra.cross_correlation(a, b, ["a"], ["b"]).collect()}
    want = np.correlate(x - x.mean(), y - y.mean(), "full") / (n * x.std() * y.std())
    assert [got["b", k] for k in range(1 - n, n)] == pytest.approx(want.tolist(), abs=1e-9)
    there = np.array([t % 3 != 0 for t in range(8)])
    u, w = x[:8] - x[:8].mean(), np.where(there, np.arange(8) % 5 - (np.arange(8) % 5)[there].mean(), 0)
    s = x[:8].std() * (np.arange(8) % 5)[there].std()
    for lag in range(-7, 8):
        met = [t for t in range(8) if there[t] and 0 <= t + lag < 8]
        assert got["gaps", lag] == (pytest.approx(sum(u[t + lag] * w[t] for t in met) / (8 * s)) if met else None)
    assert {got["flat", k] for k in range(-8, 9)} == {None}


def test_merged_climatology_is_that_of_all_years(spark, tmp_path):
    df = made_field(spark, 9).cache()
    path, parts = f"file://{tmp_path}/climatology", [fields.years(df, y, y) for y in (2000, 2001, 2002)]
    for k in (0, 1, 1, 2):  # a year that is given again counts once
        state = climatology.update_climatology(parts[k], path)
    plain = lambda x: {(r.cell_id, r.month): r for r in x.collect()}
    got, want, state_of = plain(climatology.climatology_of(state)), plain(fields.monthly_climatology(df)), plain(climatology.state_of(df))
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k].value == (None if r.value is None else pytest.approx(r.value)) and (got[k].lat, got[k].lon) == (r.lat, r.lon)
    for k, r in plain(state).items():
        assert (r.n, r["last"]) == (state_of[k].n, state_of[k]["last"]) and r.m2 == (None if state_of[k].m2 is None else pytest.approx(state_of[k].m2))
    for standardise in (False, True):
        a, b = ({(r.cell_id, r.time): r.value for r in x.collect()} for x in (climatology.anomaly_by_state(df, state, standardise), fields.monthly_anomaly(df, standardise)))
        assert a.keys() == b.keys() and all(a[k] == (None if b[k] is None else pytest.approx(b[k], abs=1e-9)) for k in a)
    plan = climatology.merge_states(*(climatology.state_of(x) for x in parts[:2]))
    assert plan.columns == state.columns
    assert climatology.update_climatology(df.limit(0), path).count() == state.count()
    df.unpersist()


def test_regridding_scans_the_field_once(spark, tmp_path):
    made_field(spark, 3).write.parquet(f"file://{tmp_path}/f")
    df = spark.read.parquet(f"file://{tmp_path}/f")
    lats, lons = (spark.createDataFrame([(x,) for x in (-3.0, 0.5, 1.0, 1.7, 90.0)], f"{name} double") for name in ("lat", "lon"))
    found = fields.nearest_regrid(df, lats, lons)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in x and f"{tmp_path}/f" in x for x in plan.split("\n")) == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.lat, r.cell_id // 1_000_000) for r in found.collect()}
    assert got == {(-3.0, 0), (0.5, 1), (1.0, 2), (1.7, 3), (90.0, 4)}
    by_lat = {(r.lat, r.time): r.value for r in found.where("lon = 1.0").collect()}
    own = {(r.lat, r.time): r.value for r in df.collect()}
    for (lat, when), value in by_lat.items():
        assert value == own[{-3.0: 0.0, 0.5: 0.0, 1.0: 1.0, 1.7: 2.0, 90.0: 2.0}[lat], when]


def test_days_with_several_labels_count_once_for_the_mean(spark):
    rows = [("v", dt.date(2000, 1, d), 0, 0.0, 0.0, float(d * d)) for d in range(1, 9)]
    df = spark.createDataFrame(rows, FIELD)
    labels = spark.createDataFrame([(dt.date(2000, 1, d), n) for d, n in ((1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, None))], "time date, node_id int")
    got = {r.node_id: r for r in composites.composite_against_own_mean(df, labels).collect()}
    assert {k: (r.n, r["mean"]) for k, r in got.items()} == {1: (2, 2.5), 2: (2, 6.5)}
    assert all(r.climatology == pytest.approx(sum(d * d for d in range(1, 9)) / 8) for r in got.values())


def test_index_files_that_are_not_there(spark, tmp_path):
    (tmp_path / "a.txt").write_text("note\n2000 1 1.5\n2000 2 -99.9\n")
    files = {name: (f"file://{tmp_path}/{name}.txt", indices.read_long) for name in ("a", "b", "c")}
    rows, missing = indices.read_present(spark, files)
    assert [tuple(r) for r in rows.collect()] == [("a", dt.date(2000, 1, 1), 1.5)] and missing == ["b", "c"]
    none, missing = indices.read_present(spark, {"b": files["b"]})
    assert none.columns == ["index_name", "date", "value"] and none.count() == 0 and missing == ["b"]


@pytest.mark.parametrize("steps, few", [(1024, 10_000), (4, 3), (2, 1)])
def test_percentiles_by_narrowing(spark, monkeypatch, steps, few):
    monkeypatch.setattr(percentiles, "STEPS", steps)
    monkeypatch.setattr(percentiles, "FEW", few)
    rng = random.Random(2)
    groups = {"a": [rng.random() ** 3 for _ in range(101)], "b": [5.0] * 40 + [rng.randint(0, 9) for _ in range(60)], "c": [1.25], "d": [None, None], "e": [1.0, 2.0, None], "f": [7.5] * 30, None: [rng.gauss(0, 1e6) for _ in range(50)]}
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, x in groups.items() for v in x], "k string, v double").repartition(3).cache()
    for q in (0.0, 0.5, 0.95, 1.0) if steps == 1024 else (0.95,):
        want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", F.lit(q)).alias("p")).collect()}
        assert {r.k: r.p for r in percentiles.exact_percentile(df, ["k"], "v", q, "p").collect()} == want
    df.unpersist()


def test_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(kriging, "BLOCK", 8)
    rng = random.Random(4)
    sizes = {1: 50, 2: 8, 3: 1, None: 9}
    rows = [(g, p, rng.uniform(-60, 60), rng.uniform(0, 180), rng.random()) for g, n in sizes.items() for p in range(n)]
    df = spark.createDataFrame(rows, "k int, pid long, lat double, lon double, value double")
    found = kriging.pairs(df, ["k"])
    assert {r.k: r["count"] for r in found.groupBy("k").count().collect()} == {g: n * (n - 1) // 2 for g, n in sizes.items() if n > 1}
    a, b = (df.select([F.col(c).alias(f"{c}{x}") for c in df.columns]) for x in "ab")
    d = F.col("valuea") - F.col("valueb")
    plain = a.join(b, F.col("ka").eqNullSafe(F.col("kb")) & (F.col("pida") < F.col("pidb"))).select(F.col("ka").alias("k"), kriging.haversine(F.col("lata"), F.col("lona"), F.col("latb"), F.col("lonb")).alias("h"), (d * d / 2).alias("g"))
    rounded = lambda x: sorted((r[0] or 0, round(r[1], 6), round(r[2], 9)) for r in x.collect())
    assert rounded(found) == rounded(plain)
    spread = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in spread}
    for k, v in spread.items():
        spark.conf.set(k, v)
    try:
        parts = [r.n for r in kriging.pairs(df.where("k = 1"), ["k"]).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(parts) > 2 and sum(parts) == 50 * 49 // 2  # one group in several tasks


def blob_rows(spark, k=9, n=30, dim=5, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, dim)) * 4
    return spark.createDataFrame([(i, [float(v) for v in centres[i % k] + rng.normal(size=dim) * 0.4]) for i in range(k * n)], "id long, features array<double>")


def test_kmeans_in_shared_passes(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = blob_rows(spark).cache()
    v = rows.select(array_to_vector("features").alias("features")).cache()
    want = min(KMeans(k=9, seed=42 + i).fit(v).summary.trainingCost for i in range(10))
    passes = []
    sums = patterns._cluster_sums
    monkeypatch.setattr(patterns, "_cluster_sums", lambda *x: passes.append(len(x[1])) or sums(*x))
    centres, cost = patterns.kmeans_centres(rows, 9)
    assert cost <= want * (1 + 1e-6) and centres.shape == (9, 5)
    assert len(passes) <= 2 + 1 + 100 + 1 and set(passes) == {10}
    again, _ = patterns.kmeans_centres(rows.repartition(5), 9)
    assert np.allclose(again, centres)
    found = {r.id: r.cluster for r in patterns.kmeans(rows, 9).collect()}
    assert len({(i % 9, c) for i, c in found.items()}) == 9
    assert tuple(patterns.misplaced(rows, patterns.kmeans(rows, 9)).first()) == (270, 9, 0)
    wrong = spark.createDataFrame([(i, 1 + (found[i] - 1 + (i == 0)) % 9) for i in found], "id long, cluster int")
    assert tuple(patterns.misplaced(rows, wrong).first()) == (270, 9, 1)
    one = patterns.kmeans(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "id long, features array<double>"), 3)
    assert sorted(map(tuple, one.collect())) == [(1, 1), (2, 1)]
    rows.unpersist()
    v.unpersist()


def test_kmeans_goes_on_until_every_run_rests(spark, monkeypatch):
    """Points on a line, whose centres take some hundreds of small steps to come to rest; the passes are counted in memory."""
    x = (np.arange(20000)[:, None] / 20000) ** 3
    rows = spark.createDataFrame([(i, [float(v)]) for i, (v,) in enumerate(x)], "id long, features array<double>")
    asked = []

    def sums(samples, books, live=None):
        asked.append(list(range(len(books))) if live is None else list(live))
        node = [patterns.nearest_nodes(x, w) for w in books]
        total = [np.array([x[n == k].sum(axis=0) for k in range(len(w))]) for (n, _), w in zip(node, books)]
        return total, [np.bincount(n, minlength=len(w)).astype(float) for (n, _), w in zip(node, books)], [float((d * d).sum()) for _, d in node]

    monkeypatch.setattr(patterns, "_cluster_sums", sums)
    centres, _ = patterns.kmeans_centres(rows, 20, restarts=3)
    assert len(asked) > 2 + 1 + 100 + 1 and asked[-2] != [0, 1, 2]
    total, count, _ = sums(rows, [centres])
    assert np.allclose(total[0] / count[0][:, None], centres, rtol=0, atol=1e-9)
    # a tolerance below what rounding moves does not keep it going for ever
    again, _ = patterns.kmeans_centres(rows, 20, restarts=1, tolerance=0.0)
    assert len(again) == 20


def test_batch_map_of_a_table_without_samples(spark, tmp_path):
    """No rows, as the query's SQL has it of an empty table."""
    from gridregimes.plans import catalog

    schema = "vec_id long, embedding array<float>, label int"
    vectors = np.random.default_rng(3).normal(size=(40, 64)).tolist()
    for name, rows in (("none", []), ("nulls", [(1, None, 2)]), ("some", [(i, v, i % 3) for i, v in enumerate(vectors)])):
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{name}/embeddings.parquet")
    for name, n in (("none", 0), ("nulls", 0), ("some", 40)):
        found = catalog.QUERIES["c2_som_batch"](spark, f"file://{tmp_path}/{name}")
        assert found.dtypes == [("id", "bigint"), ("node_id", "int")] and found.count() == n


def stress(x, y):
    d, e = (np.sqrt(((a[:, None] - a[None]) ** 2).sum(2)) for a in (x, y))
    return float(((d - e) ** 2).sum())


@pytest.mark.parametrize("landmarks", [40, 1000])
def test_landmark_scaling_beats_components(spark, landmarks):
    rows = blob_rows(spark, k=6, n=20, dim=8)
    x = np.array([r.features for r in rows.orderBy("id").collect()])
    plane, components = (np.array([[r.x, r.y] for r in f.orderBy("id").collect()]) for f in (patterns.landmark_scaling(rows, landmarks=landmarks), patterns.pca2(rows)))
    assert stress(x, plane) < 0.9 * stress(x, components)
    again = np.array([[r.x, r.y] for r in patterns.landmark_scaling(rows.repartition(7), landmarks=landmarks).orderBy("id").collect()])
    assert np.allclose(again, plane, atol=1e-6)
    none = patterns.landmark_scaling(rows.limit(0))
    assert none.columns == ["id", "x", "y"] and none.count() == 0
    assert len(patterns.landmark_scaling(spark.createDataFrame([("a", [1.0]), ("b", None), ("c", [1.0])], "id string, features array<double>")).collect()) == 2
