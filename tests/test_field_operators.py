"""Operators on hand-made frames: one case per rule that is easy to get wrong."""

import datetime as dt
import json
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldscope.functions.scalar import bearing_class, normalise_city, zoom_radius
from fieldscope.operators import conform, filters, joins, layers, metrics, ordering, spatial, trends
from fieldscope.operators.components import connected_components
from fieldscope.operators.ordering import quantile_bounds, range_bucket
from fieldscope.sources import readers, sinks

ORDER = "latitud double, longitud double, barrio string, nom_ruta string, pedido_a_tiempo int"


def orders(spark, rows):
    return spark.createDataFrame(rows, ORDER)


def test_null_keys_leave_the_map_but_not_the_total(spark):
    df = orders(spark, [(1.0, 1.0, "a", "r", 1), (1.0, 1.0, "a", "r", 0), (None, None, "b", "r", 1)])
    assert [r["cantidad"] for r in metrics.points(df).collect()] == [2]
    row = metrics.order_kpis(df, "2024-01-01", "2024-01-02").first()
    assert (row["total"], row["barrios"], row["a_tiempo"], row["por_dia"]) == (3, 2, 2, 1.5)


def test_zero_denominators(spark):
    row = metrics.order_kpis(orders(spark, []), "2024-02-01", "2024-01-01").first()
    assert (row["por_dia"], row["por_barrio"], row["pct_a_tiempo"], row["a_tiempo"]) == (0.0, 0.0, 0.0, 0)


def test_ties_in_top_values(spark):
    df = spark.createDataFrame([(f"b{i:02d}",) for i in range(12)], "barrio string")
    assert [r["value"] for r in metrics.top_values(df, "barrio", 10).orderBy("value").collect()] == [f"b{i:02d}" for i in range(10)]


def hidden(spark):
    return orders(spark, [(1.0, 1.0, "a", "EMPLEADOS", 1), (2.0, 2.0, "b", "R", 1), (3.0, 3.0, "c", "R", 1)])


def test_hidden_routes_stay_in_the_heat(spark):
    at = metrics.points(hidden(spark))
    assert layers.marker_layer(at, "cantidad").count() == 2
    assert layers.heat_layer(at, "cantidad").count() == 3
    assert {r["total_ruta"] for r in layers.marker_layer(at, "cantidad").collect()} == {2}


@pytest.mark.parametrize(("span", "interval"), [(30, 2), (31, 7), (180, 7), (181, 15), (365, 15), (366, 30)])
def test_trend_steps(spark, span, interval):
    start = dt.date(2023, 1, 1)
    daily = spark.createDataFrame([(start, 20), (start + dt.timedelta(span), 30), (start + dt.timedelta(1), 3)], "fecha date, cantidad long")
    rows = trends.trend(daily, 15).collect()
    assert {r["intervalo"] for r in rows} == {interval} and sum(r["cantidad"] for r in rows) == 50


def test_trend_matches_positional_pandas(spark):
    rng = np.random.default_rng(0)
    days = pd.date_range("2022-01-01", periods=300).date
    counts = rng.integers(0, 60, 300)
    daily = spark.createDataFrame(list(zip(days, counts.tolist(), strict=True)), "fecha date, cantidad long")
    kept = pd.DataFrame({"f": days, "n": counts}).query("n > 15").reset_index(drop=True)
    want = kept.groupby(kept.index // 15).agg(f=("f", "min"), n=("n", "sum"))
    got = trends.trend(daily, 15).orderBy("grupo").collect()
    assert [(r["fecha"], r["cantidad"]) for r in got] == list(zip(want.f, want.n, strict=True))
    assert [r["incompleto"] for r in got][:-1] == [0] * (len(got) - 1)


def test_trend_without_a_busy_day(spark):
    assert trends.trend(spark.createDataFrame([(dt.date(2024, 1, 1), 15)], "fecha date, cantidad long"), 15).collect() == []


def test_growth(spark):
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(i), 10 if i < 30 else 15) for i in range(60)]
    schema = "fecha date, cantidad long"
    assert trends.growth(spark.createDataFrame(rows, schema)).first()["crecimiento"] == 50.0
    assert trends.growth(spark.createDataFrame(rows[:30], schema)).first()["crecimiento"] is None


def test_equal_values_have_no_scale(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r["peso"] for r in metrics.scale(df, "v").collect()] == [None, None]
    rows = metrics.breaks(df, "v").collect()
    assert {r["posicion"] for r in rows} == {None} and metrics.stops(metrics.breaks(df, "v")).count() == 1


def test_breaks_are_linear_percentiles(spark):
    v = np.random.default_rng(1).normal(size=101)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = [r["valor"] for r in metrics.breaks(df, "v").orderBy("prob").collect()]
    assert np.allclose(got, np.quantile(v, metrics.BREAKS))
    ties = spark.createDataFrame([(1.0,)] * 50 + [(2.0,), (float("nan"),), (None,)], "v double")
    assert ordering.exact_quantiles(ties, "v", [0.5, 1.0]) == [1.0, 2.0]
    assert ordering.exact_quantiles(df.limit(0), "v", [0.5]) == [None]


def test_percentiles_of_heavy_ties_end(spark):
    two = spark.range(500_000).select((F.col("id") % 2).alias("v"))
    assert ordering.exact_quantiles(two, "v", [0.25, 0.5, 0.75]) == [0.0, 0.5, 1.0]
    fifty = spark.range(6_000_000).select((F.col("id") % 50 + 1).alias("v"))
    got = ordering.exact_quantiles(fifty, "v", metrics.CUTS)
    assert got == np.quantile(np.repeat(np.arange(1.0, 51), 120_000), metrics.CUTS).tolist()


HARD_DOUBLES = [
    0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, np.nextafter(1, 2), np.nextafter(1, 0), -1.0, 0.1, 1e300,
    1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 3.0, 4.0, np.nextafter(4, 0), 1e-310, 123456.789, 2.0**-1022, 2.0**1023,
]


def test_order_preserving_bits(spark):
    powers = [s * np.nextafter(2.0**e, to) for e in range(-1074, 1024) for s in (1.0, -1.0) for to in (-np.inf, 2.0**e, np.inf)]
    values = np.unique(np.array(HARD_DOUBLES + powers) + 0.0)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    keys = sorted(r["key"] for r in ordering.ordered_bits(df, "v").collect())
    want = values.view(np.int64)
    assert keys == np.where(want < 0, -(want & (2**63 - 1)), want).tolist()
    n = len(values)
    assert ordering.ranked(df, "v", lambda m: [0, 1, m // 2, m - 1]) == {i: values[i] for i in (0, 1, n // 2, n - 1)}


def test_a_percentile_takes_few_scans(spark, monkeypatch):
    rows = spark.createDataFrame([(float(x),) for x in np.random.default_rng(2).normal(size=2000) * 10.0 ** np.arange(-200, 200).repeat(5)], "v double")
    passes = []
    kind = type(rows)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (passes.append(1), collect(self))[1])
    ordering.exact_quantiles(rows, "v", metrics.BREAKS)
    assert len(passes) <= 8


def test_segments_in_many_ranges(spark):
    rows = [(g, i, i * 0.5, -i * 0.25) for i in range(200) for g in [("a", "b", None)[i % 3]] if g != "b" or i > 150]
    df = spark.createDataFrame(rows, "g string, id long, lat double, lon double")
    got = spatial.segments(df, "g", "id", "lat", "lon", rows_per_range=7).collect()
    for g in ("a", "b", None):
        ids = sorted(r[1] for r in rows if r[0] == g)
        of = sorted((r for r in got if r["g"] == g), key=lambda r: r["id"])
        assert [(r["id"], r["orden"]) for r in of] == [(i, n + 1) for n, i in enumerate(ids)]
        assert [r["lat_sig"] for r in of] == [i * 0.5 for i in ids[1:]] + [None]


def test_power_scale_only_below_one(spark):
    low = metrics.scale(spark.createDataFrame([(0.25,), (0.5,)], "v double"), "v", "power").orderBy("v").collect()
    assert [round(r["peso"], 6) for r in low] == [round(0.5**0.3, 6), 1.0]
    high = metrics.scale(spark.createDataFrame([(0.25,), (5.0,)], "v double"), "v", "power").orderBy("v").collect()
    assert [r["peso"] for r in high] == [0.25, 5.0]


def test_cluster_average_skips_null_and_zero(spark):
    df = spark.createDataFrame([(3.0, -76.0, v) for v in (0.0, None, 2.0, 4.0)], "latitud double, longitud double, v double")
    rows = layers.cluster(df, "v", [10], by=None, how="avg").collect()
    assert [(r["puntos"], r["valor"]) for r in rows] == [(4, 3.0)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(3, 4), st.floats(-77, -76), st.integers(1, 9)), min_size=1, max_size=30))
def test_cluster_pyramid_keeps_totals(spark, rows):
    df = spark.createDataFrame([(a, b, "r", n) for a, b, n in rows], "latitud double, longitud double, nom_ruta string, n long")
    sums = layers.cluster(df, "n", range(8, 18)).groupBy("zoom").agg(F.sum("valor").alias("s")).collect()
    assert {r["s"] for r in sums} == {sum(r[2] for r in rows)} and len(sums) == 10


def test_period_ends(spark):
    times = ["2024-01-02 08:00:00", "2024-01-02 23:59:59", "2024-01-02 23:59:59.5", "2024-01-02 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert filters.between_dates(df, "t", "2024-01-01", "2024-01-02").count() == 3
    assert filters.between_dates(df, "t", "2024-01-01", "2024-01-02", "midnight").count() == 1


def test_optional_filters(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert [filters.optional_filter(df, "c", w).count() for w in (None, "", [], "a", ["a", "b"])] == [3, 3, 3, 1, 2]


def test_positions(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, None), (float("nan"), 1.0), (float("inf"), 1.0), (1.0, 1.0)], "y double, x double")
    assert [filters.with_position(df, "y", "x", m).count() for m in ("notnull", "finite")] == [4, 2]


def test_city_names(spark):
    df = spark.createDataFrame([("Bogotá",), ("Medellín",), ("BOGOTA",), ("Peñón",)], "c string")
    assert [r[0] for r in df.select(normalise_city(F.col("c"))).collect()] == ["BOGOTA", "MEDELLIN", "BOGOTA", "PENON"]


def test_bearing_classes(spark):
    df = spark.createDataFrame([(44.9,), (45.0,), (135.0,), (225.0,), (315.0,), (-90.0,)], "a double")
    assert [r[0] for r in df.select(bearing_class(F.col("a"))).collect()] == ["right", "up", "left", "down", "right", "down"]


def test_zoom_radius(spark):
    assert [r[0] for r in spark.range(11, 16).select(zoom_radius(F.col("id"))).collect()] == [120, 80, 60, 40, 30]


def slow_dbscan(points, eps, least):
    """Sequential reference: points in order, label -1 for noise."""
    near = [[j for j, q in enumerate(points) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for p in points]
    label, k = [-1] * len(points), 0
    for i in range(len(points)):
        if label[i] != -1 or len(near[i]) < least:
            continue
        label[i], todo = k, list(near[i])
        while todo:
            j = todo.pop()
            if label[j] == -1:
                label[j] = k
                if len(near[j]) >= least:
                    todo += near[j]
        k += 1
    return label


def test_dbscan_matches_sequential(spark):
    rng = np.random.default_rng(4)
    points = np.round(rng.uniform(0, 0.02, (160, 2)), 5)
    points[:20] = points[0]
    rows = [(i, "g", float(a), float(b)) for i, (a, b) in enumerate(points)] + [(900, None, 0.0, 0.0), (901, "h", 0.0, 0.0), (902, "h", 0.0005, 0.0)]
    df = spark.createDataFrame(rows, "id long, g string, y double, x double").repartition(3)
    got = {r["id"]: r["cluster"] for r in spatial.dbscan(df, "g", "id", "y", "x").collect()}
    assert [got[i] for i in range(160)] == slow_dbscan(points.tolist(), 0.001, 3)
    assert got[900] == got[901] == got[902] == -1


def test_border_point_takes_the_first_cluster(spark):
    y = [0.0, 0.0004, 0.0008, 0.0017, 0.0026, 0.0030, 0.0034]
    df = spark.createDataFrame([(i, "g", v, 0.0) for i, v in enumerate(y)], "id long, g string, y double, x double")
    got = {r["id"]: r["cluster"] for r in spatial.dbscan(df, "g", "id", "y", "x", min_points=3).collect()}
    assert [got[i] for i in range(7)] == slow_dbscan([(v, 0.0) for v in y], 0.001, 3)


def test_no_cluster_falls_back_to_first_rows(spark):
    df = spark.createDataFrame([(i, "g", float(i), 0.0, -1) for i in range(15)], "id long, g string, y double, x double, cluster long")
    assert sorted(r["id"] for r in spatial.densest(df, "g", "id").collect()) == list(range(10))


def test_route_trace(spark):
    rows = [(i, "g", 0.0001 * i, 0.0) for i in range(12)] + [(50, "z", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "id long, g string, y double, x double")
    got = spatial.trace(df, "g", "id", "y", "x", k=1).orderBy("orden").collect()
    assert len(got) == 10 and [r["clase"] for r in got] == ["up"] * 9 + [None]


def test_row_ids_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = conform.add_row_id(df, ["k"], "id_muestra").collect()
    assert all(r["id_muestra"] == r["k"] for r in got) and len(got) == 1000


def test_first_per_and_collisions(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 9, None)], "k long, o long, v string")
    assert sorted(conform.first_per(df, "k", ["o"]).collect()) == [(1, 2, "b"), (2, 9, None)]
    other = spark.createDataFrame([(1, None), (2, "x")], "k long, v string")
    assert sorted((r["o"], r["v"]) for r in conform.prefer(df, other, "k", "v").collect()) == [(2, None), (3, None), (9, "x")]
    assert conform.project_existing(df, ["v", "nope", "k"]).columns == ["v", "k"]


def test_bad_times_become_null(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("soon",), (None,)], "t string")
    assert [r["t"] for r in conform.coerce_timestamp(df, "t").collect()] == [dt.datetime(2024, 1, 1, 10), None, None]


def test_debt_map_total_and_full_total(spark):
    rows = [(1.0, 1.0, "a", "r", 10.0, dt.date(2024, 1, 1)), (None, None, "b", None, 5.0, dt.date(2024, 1, 3))]
    df = spark.createDataFrame(rows, "latitud double, longitud double, barrio string, nom_ruta string, v double, fecha_venta date")
    row = metrics.debt_kpis(df.withColumn("valor_mora", F.col("v").cast("decimal(18,2)"))).first()
    assert (float(row["total_mora"]), float(row["total_mora_all"]), row["barrios"], row["dias"], row["por_dia"]) == (10, 15, 2, 3, 10 / 3)
    assert metrics.debt_kpis(df.limit(0).withColumn("valor_mora", F.col("v").cast("decimal(18,2)"))).first()["dias"] == 0


def test_unknown_city_gives_nothing(spark):
    cities = spark.createDataFrame([("BOGOTÁ", 4)], "ciudad string, id_centroope int")
    df = spark.createDataFrame([(1, 4), (2, 5)], "id long, id_centroope int")
    assert [r["id"] for r in joins.for_city(df, cities, "bogota").collect()] == [1]
    assert joins.for_city(df, cities, "Quito").count() == 0


def test_components_match_union_find(spark):
    rng = np.random.default_rng(2)
    edges = rng.integers(0, 300, (260, 2)).tolist() + [[i, i + 1] for i in range(1000, 1100)] + [[2000, i] for i in range(2000, 2200)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {x: top(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_range_buckets(spark):
    df = spark.range(-500, 500)
    bounds = quantile_bounds(df, "id", 7)
    got = {r["id"]: r["b"] for r in df.select("id", range_bucket(F.col("id"), bounds).alias("b")).collect()}
    assert len(bounds) == 6 and all(got[i] == sum(b <= i for b in bounds) for i in range(-500, 500))
    assert quantile_bounds(df.limit(0), "id", 7) == []


def test_readers_and_sinks(spark, tmp_path):
    ring = [[-76.5, 3.4], [-76.4, 3.4], [-76.4, 3.5]]
    zone = {"type": "Feature", "properties": {"nombre": "R1", "barrios": ["a", "b"], "ciudad": "CALI"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring]]}}
    (tmp_path / "zones.json").write_text(json.dumps({"type": "FeatureCollection", "features": [zone]}, indent=1))
    single = {"type": "Feature", "properties": {"nombre": "S", "barrios": 7}, "geometry": {"type": "Polygon", "coordinates": [[[3.4, -76.5]]]}}
    (tmp_path / "one.json").write_text(json.dumps(single, indent=1))
    points = readers.read_features(spark, str(tmp_path / "zones.json")).orderBy("position").collect()
    assert [(r["name"], r["latitud"], r["longitud"]) for r in points] == [("R1", y, x) for x, y in ring]
    assert [(r["latitud"], r["longitud"]) for r in readers.read_features(spark, str(tmp_path / "one.json"), "latlon").collect()] == [(3.4, -76.5)]
    assert sorted(readers.route_zone_barrios(spark, str(tmp_path / "zones.json")).collect()) == [("a", "R1"), ("b", "R1")]
    (tmp_path / "barrios.csv").write_text("barrio\nx\ny\n")
    (tmp_path / "rutas_cobro.csv").write_text("")
    menus = readers.read_menus(spark, str(tmp_path))
    assert [menus[k].count() for k in ("barrios", "rutas_cobro", "rutas_logistica")] == [2, 0, 0]
    layer = spark.createDataFrame([(1.0, 2.0, "a")], "latitud double, longitud double, barrio string")
    where = str(tmp_path / "layer")
    sinks.write_layer(layer, where)
    sinks.write_layer(layer.union(layer), where)
    assert spark.read.parquet(where).count() == 1
    copy = sinks.write_layer(layer.union(layer), where, if_exists="copy")
    assert copy != where and spark.read.parquet(copy).count() == 2
    line = json.loads(spark.read.text(sinks.write_layer(layer, str(tmp_path / "g"), "geojsonl", "overwrite")).first()[0])
    assert line["geometry"]["coordinates"] == [2.0, 1.0] and line["properties"] == {"barrio": "a"}


def test_jdbc_in_parallel(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).withColumn("v", F.col("id") % 3).write.format("jdbc").options(url=url, dbtable="t", **driver).save()
    df = readers.read_jdbc(spark, url, "t", "id", 0, 100, 4, **driver)
    assert df.rdd.getNumPartitions() == 4 and df.where("v = 1").count() == 33


def test_entry(spark):
    import __spark_entry__ as entry

    assert {"kpi_orders", "layer_markers"} <= set(entry.queries()) and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_package(tmp_path):
    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top / "fieldscope", tmp_path / "fieldscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    (tmp_path / "fieldscope/llm/__pycache__").mkdir(parents=True, exist_ok=True)  # what a deleted package may leave
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k[:2] == 'op' or k == 'pipeline' for k in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 100 and said[1] == "False"
