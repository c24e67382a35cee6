"""Splittable GeoJSON, JDBC ranges, pyramids, states, components, closest pairs, nearest sites, agents' days and loads."""

import datetime as dt
import json
import math
import statistics
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscope import durable
from fieldscope.operators import layers, metrics, sessions, spatial, trends
from fieldscope.operators.components import connected_components
from fieldscope.plans import maps
from fieldscope.plans.bases import Filter
from fieldscope.sources import readers
from fieldscope.sources.tables import Tables

# --- GeoJSON --------------------------------------------------------------------------------------------------------


def zone(i, **more):
    ring = [[float(i), 0.5], [i + 0.25, 0.5], [i + 0.25, 1.5]]
    return {"type": "Feature", "properties": {"nombre": f'Z{i} {{[",', "barrios": [f"b{i}", f'c"{i}'], **more}, "geometry": {"type": "Polygon", "coordinates": [ring]}}


@pytest.mark.parametrize("indent", [None, 2])
def test_many_tasks_read_one_collection(spark, tmp_path, indent):
    n = 3_000
    path = tmp_path / "zones.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "name": "x", "features": [zone(i) for i in range(n)], "bbox": [0, 1]}, indent=indent))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        found = readers.features(spark, str(path))
        assert found.rdd.getNumPartitions() > 4
        rows = readers.read_features(spark, str(path)).collect()
        assert sorted((r["name"], r["position"], r["longitud"]) for r in rows) == sorted((f'Z{i} {{[",', p, x) for i in range(n) for p, x in enumerate((float(i), i + 0.25, i + 0.25)))
        pairs = readers.route_zone_barrios(spark, str(path)).collect()
        assert sorted(map(tuple, pairs)) == sorted((b, f'Z{i} {{[",') for i in range(n) for b in (f"b{i}", f'c"{i}'))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_kinds_of_geometry_and_features_line_by_line(spark, tmp_path):
    shapes = {
        "Point": [1.0, 2.0], "MultiPoint": [[1.0, 2.0], [3.0, 4.0]], "LineString": [[1.0, 2.0], [3.0, 4.0]], "MultiLineString": [[[1.0, 2.0]], [[3.0, 4.0]]],
        "Polygon": [[[1.0, 2.0], [3.0, 4.0]]], "MultiPolygon": [[[[1.0, 2.0]]], [[[3.0, 4.0]], [[5.0, 6.0]]]],
    }
    lines = [json.dumps({"type": "Feature", "properties": {"NOMBRE": k}, "geometry": {"type": k, "coordinates": v}}) for k, v in shapes.items()]
    lines.append(json.dumps({"type": "Feature", "properties": {"barrios": 3}, "geometry": None}))
    (tmp_path / "all.geojsonl").write_text("\n".join(lines) + "\n")
    got = {}
    for r in readers.read_features(spark, str(tmp_path / "all.geojsonl")).orderBy("name", "ring", "position").collect():
        got.setdefault(r["name"], []).append((r["ring"], r["longitud"], r["latitud"]))
    assert got["Point"] == [(0, 1.0, 2.0)] and got["LineString"] == got["MultiPoint"] == got["Polygon"] == [(0, 1.0, 2.0), (0, 3.0, 4.0)]
    assert got["MultiLineString"] == [(0, 1.0, 2.0), (1, 3.0, 4.0)] and got["MultiPolygon"] == [(0, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 6.0)]
    assert None not in got and readers.features(spark, str(tmp_path / "all.geojsonl")).count() == 7
    assert readers.route_zone_barrios(spark, str(tmp_path / "all.geojsonl")).collect() == []


@pytest.mark.parametrize("text", ['{"features": [{"properties": {}, "type": "Feature"}]}', '{"properties": {}, "type": "Feature"}\n{"properties": {}, "type": "Feature"}'])
def test_features_are_not_lost_in_silence(spark, tmp_path, text):
    (tmp_path / "odd.json").write_text(text)
    with pytest.raises(Exception, match="first member"):
        readers.features(spark, str(tmp_path / "odd.json")).collect()


def test_jdbc_ranges_follow_the_rows(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    gaps = spark.range(400).select(F.when(F.col("id") < 390, F.col("id")).when(F.col("id") < 399, F.col("id") * 10**9).alias("id"), "id")
    gaps.toDF("id", "v").coalesce(1).write.format("jdbc").options(url=url, dbtable="t", **driver).save()
    df = readers.read_jdbc(spark, url, "t", "id", partitions=4, **driver)
    sizes = [len(p) for p in df.rdd.glom().collect()]
    assert sum(sizes) == 400 and df.where("id is null").count() == 1 and len(sizes) >= 4 and max(sizes) < 200


# --- pyramid and states ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("how", "by", "until", "points_from", "radius"), [("sum", "r", 12, 15, 80), ("avg", None, None, 15, 80), ("sum", None, 12, None, 7), ("avg", "r", 9, 14, 2000)])
def test_pyramid_equals_each_zoom_alone(spark, how, by, until, points_from, radius):
    rng = np.random.default_rng(7)
    rows = [(float(a), float(b), int(v) if v else None, f"r{i % 3}") for i, (a, b, v) in enumerate(zip(rng.uniform(-80, 80, 400), rng.uniform(-180, 180, 400), rng.integers(0, 4, 400), strict=True))]
    df = spark.createDataFrame(rows, "latitud double, longitud double, v long, r string")
    zooms = range(8, 17)
    whole = layers.cluster(df, "v", zooms, radius, by, how, until, points_from).collect()
    alone = [r for z in zooms for r in layers.cluster(df, "v", [z], radius, by, how, until, points_from).collect()]
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, alone), key=str)


def test_a_map_reads_its_facts_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    for built in (maps.orders_map(t, Filter()), maps.visits_map(t, Filter()), maps.debt_map(t, Filter(age_min=0, age_max=9999)), maps.density_map(t, "cobertura")):
        assert all("parquet" not in df._jdf.queryExecution().optimizedPlan().toString().lower() for df in built.values())


# --- components and closest pairs -----------------------------------------------------------------------------------


@pytest.mark.parametrize("at_once", [1 << 20, 5])
def test_components_by_contraction(spark, at_once):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (2000, 2000), (-5, 3)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    df = spark.createDataFrame([*edges, (None, 4), (9, None)], "a long, b long").repartition(3)
    got = connected_components(df, "a", "b", at_once).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == {x: top(x) for x in root}


def test_closest_pairs_of_cells(spark):
    rng = np.random.default_rng(9)
    cells = {i: rng.uniform(0, 1, (60, 2)) + [0, 1.2 * i] for i in range(6)}
    rows = [(c, float(y), float(x)) for c, at in cells.items() for y, x in np.unique(at, axis=0)]
    positions = spark.createDataFrame(rows, "cell long, y double, x double")
    pairs = spark.createDataFrame([(i, j) for i in cells for j in cells if i < j], "cell long, other long")
    for eps in (0.21, 0.25, 0.3, 1.3):
        want = {(i, j) for i in cells for j in cells if i < j and np.hypot(*(cells[i][:, None] - cells[j][None]).transpose(2, 0, 1)).min() <= eps}
        assert {tuple(r) for r in spatial.touching(pairs, positions, eps, few=0).collect()} == want
        assert {tuple(r) for r in spatial.touching(pairs, positions, eps).collect()} == want


def test_two_dense_cells_just_out_of_reach(spark):
    n = 100_000
    at = spark.range(2 * n).select((F.col("id") % 2).alias("cell"), (F.rand(1) * 0.7).alias("y"), F.rand(2).alias("u"))
    at = at.select("cell", "y", F.when(F.col("cell") == 0, F.col("u") * 0.5).otherwise(1.5000001 + F.col("u") * 0.5).alias("x"))
    at = at.union(spark.range(400).select(F.lit(0).alias("cell"), (F.col("id") * 0.7 / 400).alias("y"), F.lit(0.5).alias("x")))
    at = at.union(spark.range(400).select(F.lit(1).alias("cell"), (F.col("id") * 0.7 / 400).alias("y"), F.lit(1.5000001).alias("x")))
    at = at.select(F.col("cell").cast("long").alias("cell"), "y", "x").dropDuplicates()
    pair = spark.createDataFrame([(0, 1)], "cell long, other long")
    assert spatial.touching(pair, at, 1.0).collect() == []
    assert spatial.touching(pair, at, 1.000001).count() == 1


# --- nearest sites --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["spread", "cluster", "one", "line"])
def test_nearest_site_by_brute_force(spark, shape):
    rng = np.random.default_rng(10)
    sites = {"spread": rng.uniform(0, 10, (200, 2)), "cluster": rng.normal(0, 0.01, (300, 2)), "one": np.array([[3.0, 4.0]]), "line": np.c_[np.zeros(50), np.arange(50.0)]}[shape]
    sites = np.concatenate([sites, sites[:1]])  # a tie
    points = np.concatenate([rng.uniform(-5, 15, (150, 2)), sites[:5], [[1000.0, -1000.0]]])
    p = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(points)] + [(900, None, 1.0), (901, float("nan"), 1.0)], "id long, latitud double, longitud double")
    s = spark.createDataFrame([(f"s{i:03}", float(y), float(x)) for i, (y, x) in enumerate(sites)] + [("no", None, 0.0)], "site string, latitud double, longitud double")
    got = {r["id"]: (r["site"], r["distancia"]) for r in spatial.nearest_site(p, s, "id", "site").collect()}
    want = {}
    for i, (y, x) in enumerate(points):
        d = [(math.hypot(y - b, x - a), f"s{j:03}") for j, (b, a) in enumerate(sites)]
        want[i] = min(d)[1], min(d)[0]
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert spatial.nearest_site(p, s.limit(0), "id", "site").collect() == [] and spatial.nearest_site(p.limit(0), s, "id", "site").collect() == []


def test_misassigned(spark):
    places = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "a", 0.0, 9.0), (3, "b", 0.0, 5.0), (4, "none", 0.0, 0.0), (5, None, 0.0, 0.0)], "id long, ruta string, latitud double, longitud double")
    centres = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 10.0)], "ruta string, latitud double, longitud double")
    assert [tuple(r) for r in spatial.misassigned(places, centres, "id", "ruta").collect()] == [(2, "a", "b", 9.0, 1.0)]  # 3 is as near to both


# --- agents' days and loads -----------------------------------------------------------------------------------------


def test_a_pause_splits_the_day(spark):
    day = dt.datetime(2024, 1, 5)
    at = lambda m: day + dt.timedelta(minutes=m)
    rows = [
        (1, 7, at(540), 0.0, 0.0), (2, 7, at(569.99), 0.0, 1.0), (3, 7, at(599.99), 1.0, 1.0), (4, 7, at(600), 0.0, 0.0), (5, 7, at(600), 2.0, 2.0),
        (6, 8, at(541), 0.0, 0.0), (7, 7, at(1439), 0.0, 0.0), (8, 7, at(1441), 0.0, 0.0), (9, None, at(1), 0.0, 0.0), (10, 7, None, 0.0, 0.0), (11, 7, at(545), None, 0.0),
    ]
    df = spark.createDataFrame(rows, "id long, agente long, ts timestamp_ntz, lat double, lon double")
    stops = sessions.day_routes(df, "agente", "ts", "id", "lat", "lon")
    got = [(r["agente"], r["dia"].day, r["tramo"], r["orden"], r["id"], r["clase"]) for r in stops.orderBy("agente", "dia", "tramo", "orden").collect()]
    assert got == [
        (7, 5, 1, 1, 1, "right"), (7, 5, 1, 2, 2, None), (7, 5, 2, 1, 3, "down"), (7, 5, 2, 2, 4, "up"), (7, 5, 2, 3, 5, None),
        (7, 5, 3, 1, 7, None), (7, 6, 1, 1, 8, None), (8, 5, 1, 1, 6, None),
    ]
    legs = {(r["agente"], r["dia"].day, r["tramo"]): (r["paradas"], round(r["segundos"], 3), round(r["recorrido"], 6)) for r in sessions.day_legs(stops, "agente", "ts").collect()}
    assert legs[7, 5, 1] == (2, 1799.4, 1.0) and legs[7, 5, 2] == (3, 0.6, round(math.sqrt(2) + math.sqrt(8), 6)) and legs[8, 5, 1] == (1, 0.0, 0.0)


def test_overloaded_days(spark):
    loads = {"a": [10, 12, 11, 9, 10, 30, 11, 14], "b": [5, 5, 5, 5, 5, 5, 6, 5], "c": [3, 100]}
    rows = [(z, dt.date(2024, 1, 1) + dt.timedelta(days=2 * i), v) for z, of in loads.items() for i, v in enumerate(of)]
    df = spark.createDataFrame([*rows, (None, dt.date(2024, 1, 1), 5)], "barrio string, fecha date, cantidad long")
    got = {}
    for r in trends.overloaded(df, "barrio", back=6).orderBy("fecha").collect():
        got.setdefault(r["barrio"], []).append(r)
    assert [r["sobrecarga"] for r in got["a"]] == [0, 0, 0, 0, 0, 1, 0, 0] and [r["sobrecarga"] for r in got["b"]] == [0, 0, 0, 0, 0, 0, 1, 0]
    assert [r["sobrecarga"] for r in got["c"]] == [0, 0] and got["c"][0]["mediana"] is None and set(got) == {"a", "b", "c"}
    for z, of in loads.items():
        for i, r in enumerate(got[z]):
            past = of[max(0, i - 6) : i]
            assert r["dias"] == len(past)
            if past:
                mid = statistics.median(past)
                assert r["mediana"] == mid and r["mad"] == statistics.median(abs(x - mid) for x in past)


def test_states_keep_what_the_layers_need(spark):
    rows = [(1.0, 1.0, "a", "r", 1), (1.0, 1.0, "a", "r", 0), (None, None, "b", None, 1), (2.0, 1.0, None, "r", 1)]
    df = spark.createDataFrame(rows, "latitud double, longitud double, barrio string, nom_ruta string, pedido_a_tiempo int")
    state = metrics.point_state(df, pedido_a_tiempo=F.sum("pedido_a_tiempo"))
    assert sorted(map(tuple, metrics.on_map(state, "cantidad").collect())) == sorted(map(tuple, metrics.points(df).collect()))
    assert metrics.order_kpis(state, "2024-01-01", "2024-01-02", rows="cantidad").first() == metrics.order_kpis(df, "2024-01-01", "2024-01-02").first()
    assert metrics.order_kpis(state.limit(0), "2024-01-01", "2024-01-02", rows="cantidad").first()["total"] == 0


def test_intermediate_tables_can_be_cleared(spark):
    durable.clear(spark)
    table = durable.stored(spark.range(5).toDF("v"))
    with durable.scratch(table) as held:
        assert held.count() == 5
        inside = held.inputFiles()[0]
    assert not Path(inside.removeprefix("file://")).exists()
    assert table.count() == 5 and durable.clear(spark) == 1
    assert not Path(table.inputFiles()[0].removeprefix("file://")).exists() and durable.clear(spark) == 0
