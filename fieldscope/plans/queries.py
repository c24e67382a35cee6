"""Registered queries of the field-operations operators, each with its SQL twin over the same logical tables.

Doubles are rounded to six digits on both sides; ``{name}`` in a twin stands for a logical table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.durable import folder
from fieldscope.functions.scalar import bearing, bearing_class, day_span, normalise_city, zoom_radius
from fieldscope.operators import conform, filters, joins, layers, metrics, spatial, trends
from fieldscope.plans import bases, maps
from fieldscope.plans.bases import Filter
from fieldscope.sources import readers, sinks
from fieldscope.sources.tables import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ORDERS = Filter(start="1996-01-01", end="1998-12-31")
EVENTS = Filter(start="2024-01-05", end="2024-01-25")
DEBTS = Filter(age_min=700, age_max=1500)
LAT, LON = "coordenada_latitud", "coordenada_longitud"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None, build: Callable[[Tables], DataFrame]) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(build(Tables(spark, folder)))

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = with_tables(sql)


# --- SQL pieces -------------------------------------------------------------------------------------------------

VALID = "estado_pedido = 1 and anulada = 0 and autorizar in (1, 2) and autorizacion_descuento = 0 and tipo_documento < 2"
ORDER_COLUMNS = (
    "id", "id_contacto", "id_barrio", "id_centroope", "fecha_pedido", "fecha_hora_pedido", "barrio", "id_estrato", "ciudad",
    "latitud", "longitud", "ruta_cobro", "nom_ruta", "pedido_a_tiempo",
)
ORDERS_SQL = f"""select o.id, o.id_contacto, o.id_barrio, o.id_centroope, o.fecha_pedido, o.fecha_hora_pedido, b.barrio,
 b.id_estrato, c.ciudad, k.latitud, k.longitud, k.ruta_cobro, k.nom_ruta,
 case when o.fecha_hora_entrega <= o.promesa_entrega then 1 else 0 end pedido_a_tiempo
 from {{pedidos}} o left join {{barrios}} b on b.id = o.id_barrio left join {{ciudades}} c on c.id = b.id_ciudad
 left join {{coords}} k on k.id_barrio = o.id_barrio where {VALID}
 and fecha_hora_pedido between timestamp '{ORDERS.start} 00:00:00' and timestamp '{ORDERS.end} 23:59:59'"""
EVENT_COLUMNS = (
    "idEvento", "id_contacto", "id_autor", "fecha_evento", "hora_evento", "tipo_evento", "id_evento_tipo", LAT, LON,
    "id_barrio", "barrio", "id_estrato", "ciudad", "id_centroope", "latitud", "longitud", "ruta_cobro", "nom_ruta",
)


def events_sql(types: tuple[int, ...]) -> str:
    return f"""select e.idEvento, e.id_contacto, e.id_autor, e.fecha_evento, cast(hour(e.fecha_evento) as int) hora_evento,
 e.tipo_evento, e.id_evento_tipo, e.{LAT}, e.{LON}, n.id_barrio, b.barrio, b.id_estrato, c.ciudad, c.id_centroope,
 k.latitud, k.longitud, k.ruta_cobro, k.nom_ruta from {{eventos}} e left join {{contactos}} n on n.id = e.id_contacto
 left join {{barrios}} b on b.id = n.id_barrio left join {{ciudades}} c on c.id = n.id_ciudad
 left join {{coords}} k on k.id_barrio = n.id_barrio where e.id_evento_tipo in ({", ".join(map(str, types))})
 and e.{LAT} <> 0 and e.{LON} <> 0
 and e.fecha_evento between timestamp '{EVENTS.start} 00:00:00' and timestamp '{EVENTS.end} 23:59:59'"""


SAMPLES_SQL, VISITS_SQL = events_sql(filters.SAMPLE_EVENTS), events_sql(filters.VISIT_EVENTS)
BALANCE_SQL = f"""select s.num_factura, s.id_contacto, s.id_barrio, b.barrio, c.ciudad, c.id_centroope, r.ruta ruta_cobro,
 z.id_ruta_cobro, s.anulada, s.saldo, s.edad_factura, s.fecha_factura from {{saldos}} s
 left join {{barrios}} b on b.id = s.id_barrio left join {{rutas_cobro_zonas}} z on z.id_barrio = s.id_barrio
 left join {{rutas_cobro}} r on r.id = z.id_ruta_cobro left join {{ciudades}} c on c.id = b.id_ciudad
 where s.saldo > 0 and s.anulada = 0 and s.edad_factura between {DEBTS.age_min} and {DEBTS.age_max}"""
INVOICE_SQL = f"""select num_factura, id_contacto, id_barrio, barrio, ciudad, id_centroope, ruta_cobro, id_ruta_cobro, anulada,
 cast(sum(saldo) as decimal(28,2)) valor_mora, max(edad_factura) edad, max(fecha_factura) fecha_venta from ({BALANCE_SQL}) x
 group by num_factura, id_contacto, id_barrio, barrio, ciudad, id_centroope, ruta_cobro, id_ruta_cobro, anulada"""
DEBT_COLUMNS = (
    "num_factura", "id_contacto", "id_barrio", "barrio", "ciudad", "valor_mora", "edad", "fecha_venta", "latitud", "longitud",
    "ruta_cobro", "nom_ruta",
)


def debt_sql(key: str) -> str:
    return f"""select i.num_factura, i.id_contacto, i.id_barrio, i.barrio, i.ciudad, i.valor_mora, i.edad, i.fecha_venta,
 k.latitud, k.longitud, k.ruta_cobro, k.ruta_cobro nom_ruta from (select *, row_number() over (partition by {key}
 order by num_factura, id_ruta_cobro) rn from ({INVOICE_SQL}) y) i left join {{coords}} k on k.id_barrio = i.id_barrio
 where i.rn = 1"""


DEBT_SQL = debt_sql("id_contacto")


def points_sql(base: str, keys: str = "latitud, longitud, barrio, nom_ruta", value: str = "count(*) cantidad") -> str:
    given = " and ".join(f"{k} is not null" for k in keys.split(", "))
    return f"select {keys}, {value} from ({base}) p where {given} group by {keys}"


ORDER_POINTS = points_sql(ORDERS_SQL)
VISIT_POINTS = points_sql(VISITS_SQL, "latitud, longitud, barrio")
DEBT_POINTS = points_sql(DEBT_SQL, value="cast(sum(valor_mora) as decimal(38,2)) valor_mora")


def markers_sql(at: str, value: str, kind: str) -> str:
    return f"""select latitud, longitud, barrio, nom_ruta, {value} valor, total_ruta from (select *,
 cast(sum({value}) over (partition by nom_ruta) as {kind}) total_ruta from ({at}) q) w
 where nom_ruta not in ('EMPLEADOS', 'TRANSPORTADORA')"""


def heat_sql(at: str, value: str) -> str:
    return f"select latitud, longitud, round(ln(1 + cast({value} as double)), 6) peso from ({at}) q"


def cluster_sql(at: str, value: str, by: str, how: str, radius: int, route_until: int | None, points_from: int) -> str:
    whole = f"case when zoom <= {route_until} then -1 else" if route_until else "(case when false then -1 else"
    close = "end" if route_until else "end)"
    size = f"(case when zoom >= {points_from} then 1 else {radius} end)"
    return f"""select zoom, grupo, {whole} cast(floor(x / {size}) as bigint) {close} cx,
 {whole} cast(floor(y / {size}) as bigint) {close} cy, count(*) puntos, {how} valor from (select zoom, {by} grupo, {value} v,
 round((longitud + 180.0e0) / 360.0e0 * (pow(2.0e0, zoom) * 256), 6) x,
 round((0.5e0 - ln((1 + sin(radians(latitud))) / (1 - sin(radians(latitud)))) / (4 * 3.141592653589793e0))
 * (pow(2.0e0, zoom) * 256), 6) y
 from ({at}) q, (select cast(unnest(range(10, 16)) as int) zoom) zz) m group by 1, 2, 3, 4"""


def trend_sql(daily: str, least: int) -> str:
    return f"""select grupo, min(fecha) fecha, cast(sum(cantidad) as bigint) cantidad, intervalo,
 case when count(*) < intervalo then 1 else 0 end incompleto from (select *, (row_number() over (order by fecha) - 1) // intervalo grupo
 from (select *, case when span <= 30 then 2 when span <= 180 then 7 when span <= 365 then 15 else 30 end intervalo from
 (select *, max(fecha) over () - min(fecha) over () span from ({daily}) d where cantidad > {least}) a) b) c group by grupo, intervalo"""


def daily_sql(base: str, ts: str) -> str:
    return f"select cast({ts} as date) fecha, count(*) cantidad from ({base}) t where {ts} is not null group by 1"


def top_sql(base: str, column: str, k: int) -> str:
    return f"select {column} as value, count(*) n from ({base}) t where {column} is not null group by 1 order by n desc, 1 limit {k}"


def shares_sql(base: str, column: str, but: str) -> str:
    return f"""select value, n, round(n / sum(n) over (), 6) share from (select {column} as value, count(*) n from ({base}) t
 where {column} is not null and {column} not in ({but}) group by 1) f"""


def frequency_sql(base: str, column: str, but: str = "") -> str:
    more = f" and {column} not in ({but})" if but else ""
    return f"select {column} as value, count(*) n from ({base}) t where {column} is not null{more} group by 1"


def kpi_sql(base: str, f: Filter, on_time: bool) -> str:
    days = f"(date '{f.end}' - date '{f.start}' + 1)"
    ratio = lambda a, b: f"round(case when {b} > 0 then {a} * 1e0 / {b} else 0e0 end, 6)"
    more = ""
    if on_time:
        more = f""", a_tiempo, {ratio("a_tiempo", "dias")} a_tiempo_por_dia, {ratio("a_tiempo", "barrios")} a_tiempo_por_barrio,
 round(case when total > 0 then a_tiempo * 1e0 / total else 0e0 end * 100, 6) pct_a_tiempo"""
    good = ", cast(coalesce(sum(pedido_a_tiempo), 0) as bigint) a_tiempo" if on_time else ""
    return f"""select cast(dias as int) dias, barrios, total, {ratio("total", "dias")} por_dia, {ratio("total", "barrios")} por_barrio{more}
 from (select {days} dias, count(distinct barrio) barrios, count(*) total{good} from ({base}) t) k"""


BREAK_SQL = """with v as (select {value} v from {table}), q as (select unnest([{probs}]) prob,
 unnest(quantile_cont(v, [{probs}])) valor from v), e as (select min(v) lo, max(v) hi from v)
 select prob, round(valor, 6) valor, round((valor - lo) / nullif(hi - lo, 0), 6) posicion from q, e"""


def breaks_sql(table: str, value: str, probs: tuple[float, ...]) -> str:
    text = BREAK_SQL.replace("{value}", value).replace("{table}", "{" + table + "}")
    return text.replace("{probs}", ", ".join(f"{p:.2f}::double" for p in probs))


#: Values below 1 as the root of their share of the largest; others as they are.
POWER_SQL = "case when (select max({v}) from {table}) < 1 then pow({v} / (select max({v}) from {table}), 0.3) else {v} end"

DBSCAN_EVENTS = f"select e.* from ({SAMPLES_SQL}) e where e.barrio is not null"
DBSCAN_SQL = f"""with recursive s as materialized ({DBSCAN_EVENTS}),
 nb as materialized (select a.idEvento p, b.idEvento q, a.barrio from s a join s b on a.barrio = b.barrio and
 (a.{LAT} - b.{LAT}) * (a.{LAT} - b.{LAT}) + (a.{LON} - b.{LON}) * (a.{LON} - b.{LON}) <= 0.001e0 * 0.001e0),
 core as materialized (select p from nb group by p having count(*) >= 3),
 ce as materialized (select p, q from nb where p in (select p from core) and q in (select p from core)),
 reach as (select p, p root from core union select ce.q, r.root from reach r join ce on ce.p = r.p),
 lab as materialized (select p, min(root) label from reach group by p),
 got as materialized (select nb.p, nb.barrio, min(lab.label) label from nb join lab on lab.p = nb.q group by nb.p, nb.barrio),
 num as materialized (select p, barrio, dense_rank() over (partition by barrio order by label) - 1 cluster from got),
 d as materialized (select s.idEvento, s.barrio, s.{LAT}, s.{LON}, coalesce(num.cluster, -1) cluster from s left join num on num.p = s.idEvento)"""
DENSEST_SQL = f"""{DBSCAN_SQL}, sz as (select barrio, cluster, count(*) n from d where cluster >= 0 group by 1, 2),
 best as (select barrio, cluster from (select *, row_number() over (partition by barrio order by n desc, cluster) rn from sz) x where rn = 1),
 dense as materialized (select d.* from d join best using (barrio, cluster) union all select idEvento, barrio, {LAT}, {LON}, cluster from
 (select *, row_number() over (partition by barrio order by idEvento) rn from d where barrio not in (select barrio from best)) y where rn <= 10)"""
NEAREST_SQL = f"""{DENSEST_SQL}, ce2 as (select barrio, avg({LAT}) la, avg({LON}) lo from dense group by barrio),
 nr as materialized (select * from (select dense.*, round(sqrt(({LAT} - la) * ({LAT} - la) + ({LON} - lo) * ({LON} - lo)), 9) distancia,
 row_number() over (partition by barrio order by round(sqrt(({LAT} - la) * ({LAT} - la) + ({LON} - lo) * ({LON} - lo)), 9), idEvento) rn
 from dense join ce2 using (barrio)) z where rn <= 10)"""


def segments_sql(rows: str) -> str:
    return f"""select barrio, idEvento, cast(row_number() over w as int) orden, round({LAT}, 6) lat, round({LON}, 6) lon,
 round(lead({LAT}) over w, 6) lat_sig, round(lead({LON}) over w, 6) lon_sig from ({rows}) g window w as (partition by barrio order by idEvento)"""


CLASS_SQL = """case when lat_sig is null then null when a >= 45 and a < 135 then 'up' when a >= 135 and a < 225 then 'left'
 when a >= 225 and a < 315 then 'down' else 'right' end"""
ANGLE_SQL = "degrees(atan2(lat_sig - lat, lon_sig - lon))"


def _columns(names: tuple[str, ...]) -> str:
    return ", ".join(f"round({c}, 6) {c}" if c in (LAT, LON, "latitud", "longitud") else c for c in names)


# --- building blocks on Spark -------------------------------------------------------------------------------------


def _orders(t: Tables) -> DataFrame:
    return bases.orders_base(t, ORDERS)


def _samples(t: Tables) -> DataFrame:
    return bases.samples_base(t, EVENTS)


def _visits(t: Tables) -> DataFrame:
    return bases.visits_base(t, EVENTS)


def _debts(t: Tables) -> DataFrame:
    return bases.debt_base(t, DEBTS)


def _invoices(t: Tables) -> DataFrame:
    opened = filters.open_balances(t.saldos, DEBTS.age_min, DEBTS.age_max)
    rows = joins.balances_with_routes(opened, t.barrios, t.rutas_cobro_zonas, t.rutas_cobro, t.ciudades)
    return metrics.invoices(rows)


def _place(t: Tables, name: str) -> str:
    return folder(t.spark, name)


def _csv(t: Tables, df: DataFrame, name: str) -> str:
    df.write.csv(path := _place(t, name), header=True)
    return path


def _placed(t: Tables) -> DataFrame:
    return joins.with_coords(t.pedidos, t.coords)


def _clustered(t: Tables) -> DataFrame:
    rows = _samples(t).where("barrio is not null").select("idEvento", "barrio", LAT, LON)
    return spatial.dbscan(rows, "barrio", "idEvento", LAT, LON)


def _written(t: Tables) -> DataFrame:
    layer = layers.marker_layer(metrics.points(_orders(t)), "cantidad")
    return t.spark.read.parquet(sinks.write_layer(layer, _place(t, "layer"), "parquet", "overwrite"))


ROUND_POINT = "round(latitud, 6) latitud, round(longitud, 6) longitud"


def _contact_places(t: Tables) -> DataFrame:
    places = t.contactos.select("id_barrio").join(t.coords, "id_barrio")
    return places.select("id_barrio", "barrio", "latitud", "longitud", "ruta_cobro", "nom_ruta")


def _menus(t: Tables) -> DataFrame:
    """The pick lists, written as the three files of a city and read back as one table."""
    folder, places = _place(t, "menus"), _contact_places(t)
    for (name, column), source in zip(readers.MENUS.items(), ("nom_ruta", "ruta_cobro", "barrio"), strict=True):
        metrics.menu(places, source).toDF(column).write.csv(f"{folder}/{name}.csv", header=True)
    found = readers.read_menus(t.spark, folder)
    return conform.stack([df.select(F.lit(name).alias("menu"), F.col(df.columns[0]).alias("value")) for name, df in found.items()])


def _lines(t: Tables, features: DataFrame, name: str) -> str:
    """Features of a column ``f``, one a line."""
    features.select(F.to_json("f")).write.text(path := _place(t, name))
    return path


#: Every JDBC source of a run is a database of its own in the driver's memory.
DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def _jdbc(t: Tables) -> DataFrame:
    """Orders written to a database and read back in ranges of their ids' quantiles."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    t.pedidos.select("id", "id_contacto", "id_barrio").coalesce(1).write.format("jdbc").options(url=url, dbtable="pedidos", batchsize=10_000, **DERBY).save()
    return readers.read_jdbc(t.spark, url, "pedidos", "id", **DERBY)


def _features(t: Tables) -> DataFrame:
    """The box of each neighbourhood's samples as a polygon, written as GeoJSON and read back."""
    box = _samples(t).groupBy("barrio").agg(*[of(c).alias(f"{of.__name__}_{c}") for of in (F.min, F.max) for c in (LAT, LON)])
    corner = lambda lon, lat: F.array(f"{lon}_{LON}", f"{lat}_{LAT}")
    ring = F.array(corner("min", "min"), corner("max", "min"), corner("max", "max"), corner("min", "max"), corner("min", "min"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("barrio").alias("NOMBRE")).alias("properties"), geometry.alias("geometry"))
    found = readers.read_features(t.spark, _lines(t, box.select(f.alias("f")), "features"))
    return found.select("name", F.col("position").alias("ring_position"), "latitud", "longitud")


def _zones(t: Tables) -> DataFrame:
    """Route zones with their neighbourhoods' names, written as GeoJSON and read back."""
    zones = _contact_places(t).where("nom_ruta is not null").groupBy("nom_ruta").agg(F.collect_set("barrio").alias("barrios"))
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("nom_ruta").alias("nombre"), "barrios").alias("properties"))
    return readers.route_zone_barrios(t.spark, _lines(t, zones.select(f.alias("f")), "zones"))


# --- sources, sinks, projections ------------------------------------------------------------------------------------

query("src_jdbc", "select id, id_contacto, id_barrio from {pedidos}", _jdbc)
query("src_coords", f"select id_barrio, barrio, {ROUND_POINT}, ruta_cobro, nom_ruta from {{contactos}} n join {{coords}} k using (id_barrio)",
      lambda t: readers.read_coords(t.spark, _csv(t, _contact_places(t), "coords")))
query("src_menus", " union all ".join(f"select distinct '{menu}' menu, {column} as value from {{contactos}} n join {{coords}} k using (id_barrio) where {column} is not null"
      for menu, column in (("rutas_logistica", "nom_ruta"), ("rutas_cobro", "ruta_cobro"), ("barrios", "barrio"))), _menus)
query("src_features", f"select n.barrio name, v.i ring_position, round(case when v.i in (0, 1, 4) then la0 else la1 end, 6) latitud, "
      f"round(case when v.i in (0, 3, 4) then lo0 else lo1 end, 6) longitud from (select barrio, min({LAT}) la0, max({LAT}) la1, min({LON}) lo0, max({LON}) lo1 "
      f"from ({SAMPLES_SQL}) s group by barrio) n, (select cast(unnest(range(5)) as int) i) v", _features)  # fmt: skip
query("src_route_zones", "select distinct k.barrio, k.nom_ruta ruta from {contactos} n join {coords} k using (id_barrio) where k.nom_ruta is not null", _zones)
query("src_density", "select barrio, round(latitud, 6) latitud, round(longitud, 6) longitud, round(cobertura, 6) cobertura, "
      "round(contactabilidad, 6) contactabilidad, round(efectividad, 6) efectividad from {densidades}",
      lambda t: readers.read_density(t.spark, _csv(t, t.densidades, "density")))
query("sink_layer", f"select round(latitud, 6) latitud, round(longitud, 6) longitud, barrio, nom_ruta, valor, total_ruta from "
      f"({markers_sql(ORDER_POINTS, 'cantidad', 'bigint')}) x", _written)  # fmt: skip
query("proj_subset", "select id, id_contacto, fecha_pedido, id_barrio from {pedidos}",
      lambda t: conform.project(t.pedidos, ["id", "id_contacto", "fecha_pedido", "id_barrio"]))
query("proj_existing", "select idEvento, tipo_evento, fecha_evento from {eventos}",
      lambda t: conform.project_existing(t.eventos, ["idEvento", "nom_ruta", "tipo_evento", "barrio", "fecha_evento"]))
query("proj_collision", "select s.num_factura, s.id_barrio, k.ruta_cobro from {saldos} s left join {coords} k on k.id_barrio = s.id_barrio",
      lambda t: conform.prefer(t.saldos.select("num_factura", "id_barrio", F.lit("DB").alias("ruta_cobro")), t.coords, "id_barrio", "ruta_cobro"))
query("flag_on_time", "select id, case when fecha_hora_entrega <= promesa_entrega then 1 else 0 end pedido_a_tiempo from {pedidos}",
      lambda t: conform.flag_on_time(t.pedidos, "fecha_hora_entrega", "promesa_entrega").select("id", "pedido_a_tiempo"))
query("event_hour", "select idEvento, cast(hour(fecha_evento) as int) hora_evento from {eventos}",
      lambda t: conform.event_hour(t.eventos, "fecha_evento").select("idEvento", "hora_evento"))
query("surrogate_id", "select row_number() over (order by fecha_evento, idEvento) - 1 id_muestra, idEvento, fecha_evento from {eventos}",
      lambda t: conform.add_row_id(t.eventos.select("idEvento", "fecha_evento"), ["fecha_evento", "idEvento"], "id_muestra"))
query("copy_route", "select num_factura, ruta_cobro, ruta_cobro nom_ruta from ({saldos_x}) z".replace(
      "{saldos_x}", "select s.num_factura, k.ruta_cobro from {saldos} s left join {coords} k on k.id_barrio = s.id_barrio"),
      lambda t: conform.copy_column(joins.with_coords(t.saldos, t.coords), "ruta_cobro", "nom_ruta").select("num_factura", "ruta_cobro", "nom_ruta"))
query("cast_coords", f"select cast(idEvento as varchar) idEvento, round(cast(cast({LAT} as varchar) as double), 6) {LAT} from {{eventos}}",
      lambda t: conform.cast_columns(t.eventos.select("idEvento", F.col(LAT).cast("string").alias(LAT)), {"idEvento": "string", LAT: "double"}))
query("ts_coerce", "select idEvento, case when idEvento % 7 = 0 then null else fecha_evento end fecha_evento from {eventos}",
      lambda t: conform.coerce_timestamp(t.eventos.select("idEvento", F.when(F.col("idEvento") % 7 == 0, "sin fecha").otherwise(F.col("fecha_evento").cast("string")).alias("fecha_evento")), "fecha_evento"))

# --- filters --------------------------------------------------------------------------------------------------------

query("flt_order_valid", f"select id from {{pedidos}} where {VALID}", lambda t: filters.valid_orders(t.pedidos).select("id"))
query("flt_center", "select id from {pedidos} where id_centroope = 4", lambda t: filters.in_center(t.pedidos, 4).select("id"))
query("flt_center_city", "select idEvento from {eventos} e join {contactos} n on n.id = e.id_contacto join {ciudades} c on c.id = n.id_ciudad where c.id_centroope = 4",
      lambda t: filters.in_center(joins.events_with_dims(t.eventos, t.contactos, t.barrios, t.ciudades), 4).select("idEvento"))
query("flt_time_closed", "select idEvento from {eventos} where fecha_evento between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 23:59:59'",
      lambda t: filters.between_dates(t.eventos, "fecha_evento", "2024-01-05", "2024-01-20").select("idEvento"))
query("flt_time_midnight", "select idEvento from {eventos} where fecha_evento between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 00:00:00'",
      lambda t: filters.between_dates(t.eventos, "fecha_evento", "2024-01-05", "2024-01-20", "midnight").select("idEvento"))
query("flt_sale_range", "select num_factura from {saldos} where fecha_factura >= date '1997-01-01' and fecha_factura <= date '1997-12-31'",
      lambda t: filters.between_values(t.saldos, "fecha_factura", "1997-01-01", "1997-12-31").select("num_factura"))
query("flt_balance", f"select num_factura from {{saldos}} where saldo > 0 and anulada = 0 and edad_factura between {DEBTS.age_min} and {DEBTS.age_max}",
      lambda t: filters.open_balances(t.saldos, DEBTS.age_min, DEBTS.age_max).select("num_factura"))
query("flt_event_types", "select idEvento from {eventos} where id_evento_tipo in (10, 12, 14, 53, 63, 46)",
      lambda t: filters.of_types(t.eventos, filters.VISIT_EVENTS).select("idEvento"))
query("flt_geo_nonzero", f"select idEvento from {{eventos}} where {LAT} <> 0 and {LON} <> 0",
      lambda t: filters.with_position(t.eventos, LAT, LON, "nonzero").select("idEvento"))
query("flt_geo_notnull", "select id from ({x}) y where latitud is not null and longitud is not null".replace("{x}", "select p.id, k.latitud, k.longitud from {pedidos} p left join {coords} k on k.id_barrio = p.id_barrio"),
      lambda t: filters.with_position(_placed(t), "latitud", "longitud", "notnull").select("id"))
query("flt_geo_finite", f"select idEvento from {{eventos}} where idEvento % 50 <> 0 and {LAT} is not null and {LON} is not null",
      lambda t: filters.with_position(t.eventos.withColumn(LAT, F.when(F.col("idEvento") % 50 == 0, F.lit(float("nan"))).otherwise(F.col(LAT))), LAT, LON, "finite").select("idEvento"))
query("flt_route_opt", "select p.id from {pedidos} p join {coords} k on k.id_barrio = p.id_barrio where k.nom_ruta = 'RL_3'",
      lambda t: filters.optional_filter(_placed(t), "nom_ruta", "RL_3").select("id"))
query("flt_barrio_in", "select p.id from {pedidos} p join {barrios} b on b.id = p.id_barrio where b.barrio in ('BRAZIL', 'CANADA', 'NATION_3', 'NATION_7')",
      lambda t: filters.optional_filter(joins.orders_with_dims(t.pedidos, t.barrios, t.ciudades), "barrio", ["BRAZIL", "CANADA", "NATION_3", "NATION_7"]).select("id"))
query("flt_exclude_routes", "select p.id from {pedidos} p join {coords} k on k.id_barrio = p.id_barrio where k.nom_ruta not in ('EMPLEADOS', 'TRANSPORTADORA')",
      lambda t: filters.exclude_routes(_placed(t)).select("id"))
query("flt_having_day", f"select * from ({daily_sql('select * from {eventos}', 'fecha_evento')}) d where cantidad > 15",
      lambda t: filters.busy_days(trends.daily_counts(t.eventos, "fecha_evento"), 15))
query("flt_estrato", "select p.id, b.id_estrato from {pedidos} p join {barrios} b on b.id = p.id_barrio where b.id_estrato <> 0",
      lambda t: filters.known_estrato(joins.orders_with_dims(t.pedidos, t.barrios, t.ciudades)).select("id", "id_estrato"))

# --- joins ----------------------------------------------------------------------------------------------------------

query("join_orders_dims", "select p.id, b.barrio, b.id_estrato, c.ciudad from {pedidos} p left join {barrios} b on b.id = p.id_barrio left join {ciudades} c on c.id = b.id_ciudad",
      lambda t: joins.orders_with_dims(t.pedidos, t.barrios, t.ciudades).select("id", "barrio", "id_estrato", "ciudad"))
query("join_events_dims", "select e.idEvento, b.barrio, b.id_estrato, c.ciudad, c.id_centroope from {eventos} e left join {contactos} n on n.id = e.id_contacto left join {barrios} b on b.id = n.id_barrio left join {ciudades} c on c.id = n.id_ciudad",
      lambda t: joins.events_with_dims(t.eventos, t.contactos, t.barrios, t.ciudades).select("idEvento", "barrio", "id_estrato", "ciudad", "id_centroope"))
query("join_balance_routes", f"select num_factura, barrio, ciudad, ruta_cobro, id_ruta_cobro, saldo from ({BALANCE_SQL}) x",
      lambda t: joins.balances_with_routes(filters.open_balances(t.saldos, DEBTS.age_min, DEBTS.age_max), t.barrios, t.rutas_cobro_zonas, t.rutas_cobro, t.ciudades).select("num_factura", "barrio", "ciudad", "ruta_cobro", "id_ruta_cobro", "saldo"))
query("join_coords", "select p.id, round(k.latitud, 6) latitud, round(k.longitud, 6) longitud, k.ruta_cobro, k.nom_ruta from {pedidos} p left join {coords} k on k.id_barrio = p.id_barrio",
      lambda t: _placed(t).select("id", "latitud", "longitud", "ruta_cobro", "nom_ruta"))
query("join_city_dim", "select p.id, p.id_centroope from {pedidos} p join {ciudades} c on c.id_centroope = p.id_centroope where c.ciudad = 'ASIA'",
      lambda t: joins.for_city(t.pedidos, t.ciudades, "Ásia").select("id", "id_centroope"))
query("join_route_total", f"select *, cast(sum(cantidad) over (partition by nom_ruta) as bigint) total_ruta from (select round(latitud, 6) latitud, round(longitud, 6) longitud, barrio, nom_ruta, cantidad from ({ORDER_POINTS}) p0) q",
      lambda t: joins.with_route_total(metrics.points(_orders(t)), "cantidad"))
query("semi_top_barrios", f"select idEvento, barrio from ({SAMPLES_SQL}) s where barrio in (select value from ({top_sql(SAMPLES_SQL, 'barrio', 3)}) z)",
      lambda t: joins.keep_top(_samples(t), "barrio", 3).select("idEvento", "barrio"))

# --- aggregates -----------------------------------------------------------------------------------------------------

query("agg_points_route", f"select round(latitud, 6) latitud, round(longitud, 6) longitud, barrio, nom_ruta, cantidad from ({ORDER_POINTS}) q", lambda t: metrics.points(_orders(t)))
query("agg_points", f"select round(latitud, 6) latitud, round(longitud, 6) longitud, barrio, cantidad from ({VISIT_POINTS}) q", lambda t: metrics.points(_visits(t), metrics.POINT))
query("agg_debt_points", f"select round(latitud, 6) latitud, round(longitud, 6) longitud, barrio, nom_ruta, valor_mora from ({DEBT_POINTS}) q", lambda t: metrics.debt_points(_debts(t)))
query("agg_invoice", INVOICE_SQL, _invoices)
query("agg_route_totals", f"select nom_ruta, cast(sum(cantidad) as bigint) total from ({ORDER_POINTS}) q group by 1", lambda t: metrics.route_totals(metrics.points(_orders(t)), "cantidad"))
query("agg_max_point", f"select max(cantidad) maximo from ({VISIT_POINTS}) q", lambda t: metrics.max_value(metrics.points(_visits(t), metrics.POINT), "cantidad"))
query("freq_barrio_top10", top_sql(ORDERS_SQL, "barrio", 10), lambda t: metrics.top_values(_orders(t), "barrio", 10))
query("freq_estrato_share", shares_sql(ORDERS_SQL, "id_estrato", "0"), lambda t: metrics.shares(_orders(t), "id_estrato", (0,)))
query("win_share", shares_sql(VISITS_SQL, "tipo_evento", "'none'"), lambda t: metrics.shares(_visits(t), "tipo_evento"))
query("freq_event_type", frequency_sql(VISITS_SQL, "tipo_evento"), lambda t: metrics.frequencies(_visits(t), "tipo_evento"))
query("freq_route", frequency_sql(ORDERS_SQL, "nom_ruta", "'EMPLEADOS', 'TRANSPORTADORA'"), lambda t: metrics.frequencies(_orders(t), "nom_ruta", filters.HIDDEN_ROUTES))
query("daily_counts", daily_sql("select * from {eventos}", "fecha_evento"), lambda t: trends.daily_counts(t.eventos, "fecha_evento"))
query("trend_buckets", trend_sql(daily_sql("select * from {eventos}", "fecha_evento"), 15), lambda t: trends.trend(trends.daily_counts(t.eventos, "fecha_evento"), 15))
query("trend_incomplete", trend_sql(daily_sql("select * from {pedidos}", "fecha_pedido"), 3), lambda t: trends.trend(trends.daily_counts(t.pedidos, "fecha_pedido"), 3))
query("kpi_orders", kpi_sql(ORDERS_SQL, ORDERS, True), lambda t: metrics.order_kpis(_orders(t), ORDERS.start, ORDERS.end))
query("kpi_orders_basic", kpi_sql(ORDERS_SQL, ORDERS, False), lambda t: metrics.order_kpis(_orders(t), ORDERS.start, ORDERS.end, on_time=False))
query("kpi_visits", kpi_sql(VISITS_SQL, EVENTS, False), lambda t: metrics.event_kpis(_visits(t), EVENTS.start, EVENTS.end))
query("kpi_samples", kpi_sql(SAMPLES_SQL, EVENTS, False), lambda t: metrics.event_kpis(_samples(t), EVENTS.start, EVENTS.end))
KPI_DEBT_SQL = f"""select total_mora, total_mora_all, barrios, filas, dias,
 round(case when barrios > 0 then cast(total_mora as double) / barrios else 0e0 end, 6) por_barrio,
 round(case when dias > 0 then cast(total_mora as double) / dias else 0e0 end, 6) por_dia from (select
 cast(coalesce(sum(case when latitud is not null and longitud is not null and barrio is not null and nom_ruta is not null then valor_mora end), 0) as decimal(38,2)) total_mora,
 cast(coalesce(sum(valor_mora), 0) as decimal(38,2)) total_mora_all, count(distinct barrio) barrios, count(*) filas,
 cast(coalesce(max(fecha_venta) - min(fecha_venta) + 1, 0) as int) dias from ({DEBT_SQL}) d0) k"""
query("kpi_debt", KPI_DEBT_SQL, lambda t: metrics.debt_kpis(_debts(t)))
query("kpi_growth", f"""select cast(sum(cantidad) as bigint) total, round(avg(cantidad), 6) promedio, round((sum(case when rn <= 30 then cantidad end)
 - sum(case when rn > 30 and rn <= 60 then cantidad end)) * 1e0 / nullif(sum(case when rn > 30 and rn <= 60 then cantidad end), 0) * 100, 6) crecimiento
 from (select *, row_number() over (order by fecha desc) rn from ({daily_sql("select * from {pedidos}", "fecha_pedido")}) d) r""",
      lambda t: trends.growth(trends.daily_counts(t.pedidos, "fecha_pedido")))
query("kpi_density", "select count(distinct barrio) barrios, round(avg(cobertura), 6) promedio from {densidades}", lambda t: metrics.density_kpis(t.densidades, "cobertura"))
query("quantile_breaks", breaks_sql("lineitem", "l_extendedprice", metrics.BREAKS), lambda t: metrics.breaks(t.lineitem, "l_extendedprice"))
query("quantile_breaks_density", breaks_sql("densidades", "contactabilidad", metrics.BREAKS), lambda t: metrics.breaks(t.densidades, "contactabilidad"))
query("quantile_cuts", breaks_sql("lineitem", POWER_SQL.format(v="l_discount", table="{lineitem}"), metrics.CUTS), lambda t: metrics.cuts(t.lineitem, "l_discount"))
query("quantile_cuts_raw", breaks_sql("lineitem", POWER_SQL.format(v="l_quantity", table="{lineitem}"), metrics.CUTS), lambda t: metrics.cuts(t.lineitem, "l_quantity"))
query("minmax_scale", "select l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) over ()) / nullif(max(l_quantity) over () - min(l_quantity) over (), 0), 6) peso from {lineitem}",
      lambda t: metrics.scale(t.lineitem, "l_quantity").select("l_orderkey", "l_linenumber", "peso"))
query("power_scale", "select l_orderkey, l_linenumber, round(case when max(l_discount) over () < 1 then pow(l_discount / nullif(max(l_discount) over (), 0), 0.3) else l_discount end, 6) peso from {lineitem}",
      lambda t: metrics.scale(t.lineitem, "l_discount", "power").select("l_orderkey", "l_linenumber", "peso"))
query("agg_center_median", f"select round(median({LAT}), 6) latitud, round(median({LON}), 6) longitud from ({SAMPLES_SQL}) s", lambda t: metrics.center(_samples(t), LAT, LON))
query("distinct_agents", f"select distinct id_autor from ({VISITS_SQL}) v where id_autor is not null", lambda t: metrics.agents(_visits(t)))
query("distinct_menu", "select distinct k.nom_ruta as value from {pedidos} p join {coords} k on k.id_barrio = p.id_barrio where k.nom_ruta is not null", lambda t: metrics.menu(_placed(t), "nom_ruta"))
query("dedupe_order", "select id, id_contacto from (select *, row_number() over (partition by id order by fecha_hora_pedido, id_contacto) rn from (select * from {pedidos} union all select * from {pedidos} where id % 2 = 0) u) r where rn = 1",
      lambda t: conform.first_per(conform.stack([t.pedidos, t.pedidos.where("id % 2 = 0")]), "id", ["fecha_hora_pedido", "id_contacto"]).select("id", "id_contacto"))
query("dedupe_contact", f"select id_contacto, num_factura, id_ruta_cobro, valor_mora from (select *, row_number() over (partition by id_contacto order by num_factura, id_ruta_cobro) rn from ({INVOICE_SQL}) y) z where rn = 1",
      lambda t: conform.first_per(_invoices(t), "id_contacto", ["num_factura", "id_ruta_cobro"]).select("id_contacto", "num_factura", "id_ruta_cobro", "valor_mora"))
query("on_time_by_barrio", f"select barrio, count(*) pedidos, cast(sum(pedido_a_tiempo) as bigint) a_tiempo, round(sum(pedido_a_tiempo) * 1e0 / count(*) * 100, 6) pct from ({ORDERS_SQL}) o where barrio is not null group by barrio",
      lambda t: metrics.on_time_by_barrio(_orders(t)))

# --- windows, sorts, top-k ------------------------------------------------------------------------------------------

query("win_nearest_n", f"select idEvento, barrio, round(distancia, 6) distancia from (select *, row_number() over (partition by barrio order by distancia, idEvento) rn from (select s.*, round(sqrt(({LAT} - la) * ({LAT} - la) + ({LON} - lo) * ({LON} - lo)), 9) distancia from ({SAMPLES_SQL}) s join (select barrio, avg({LAT}) la, avg({LON}) lo from ({SAMPLES_SQL}) s2 group by barrio) m using (barrio)) d) r where rn <= 10",
      lambda t: spatial.nearest_to_centroid(_samples(t), "barrio", "idEvento", LAT, LON).select("idEvento", "barrio", "distancia"))
query("win_segments", segments_sql(SAMPLES_SQL), lambda t: spatial.segments(_samples(t), "barrio", "idEvento", LAT, LON))
query("win_stop_order", f"select barrio, idEvento, cast(row_number() over (partition by barrio order by idEvento) as int) orden from ({SAMPLES_SQL}) s",
      lambda t: spatial.segments(_samples(t), "barrio", "idEvento", LAT, LON).select("barrio", "idEvento", "orden"))
query("topk_barrios", top_sql(SAMPLES_SQL, "barrio", 3), lambda t: metrics.top_values(_samples(t), "barrio", 3))
query("sort_route_event", f"select barrio, idEvento, tipo_evento from ({VISITS_SQL}) v order by barrio, idEvento",
      lambda t: _visits(t).select("barrio", "idEvento", "tipo_evento").orderBy("barrio", "idEvento"))
query("head_fallback", f"select barrio, idEvento from (select *, row_number() over (partition by barrio order by idEvento) rn from ({SAMPLES_SQL}) s) r where rn <= 10",
      lambda t: conform.first_n(_samples(t), "barrio", ["idEvento"], 10).select("barrio", "idEvento"))
query("concat_groups", "select idEvento, tipo_evento from {eventos} where tipo_evento in ('click', 'view') union all select idEvento, tipo_evento from {eventos} where tipo_evento = 'signup'",
      lambda t: conform.stack([t.eventos.where(F.col("tipo_evento") == k).select("idEvento", "tipo_evento") for k in ("click", "view", "signup")]))

# --- scalar functions -----------------------------------------------------------------------------------------------

query("norm_city", "select p.id, c.ciudad normal from {pedidos} p left join {barrios} b on b.id = p.id_barrio left join {ciudades} c on c.id = b.id_ciudad",
      lambda t: joins.orders_with_dims(t.pedidos, t.barrios, t.ciudades).select("id", normalise_city(F.translate(F.lower("ciudad"), "aeiou", "áéíóú")).alias("normal")))
query("date_of", "select idEvento, cast(fecha_evento as date) fecha from {eventos}", lambda t: t.eventos.select("idEvento", F.to_date("fecha_evento").alias("fecha")))
query("day_span", "select id, cast(cast(fecha_hora_entrega as date) - fecha_pedido + 1 as int) dias from {pedidos}",
      lambda t: t.pedidos.select("id", day_span(F.col("fecha_pedido"), F.to_date("fecha_hora_entrega")).alias("dias")))
query("heat_log", "select l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) v from {lineitem}", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.log1p("l_quantity").alias("v")))
query("power", "select l_orderkey, l_linenumber, round(pow(l_tax, 0.3), 6) v from {lineitem}", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.pow("l_tax", F.lit(0.3)).alias("v")))
query("euclid_dist", "select l_orderkey, l_linenumber, round(sqrt(l_tax * l_tax + l_discount * l_discount), 6) v from {lineitem}", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.hypot("l_tax", "l_discount").alias("v")))
query("bearing", f"select barrio, idEvento, round({ANGLE_SQL}, 6) angulo, round(case when {ANGLE_SQL} < 0 then {ANGLE_SQL} + 360 else {ANGLE_SQL} end, 6) vuelta from ({segments_sql(SAMPLES_SQL)}) s",
      lambda t: rounded(spatial.segments(_samples(t), "barrio", "idEvento", LAT, LON)).select("barrio", "idEvento", bearing(F.col("lat"), F.col("lon"), F.col("lat_sig"), F.col("lon_sig")).alias("angulo"), bearing(F.col("lat"), F.col("lon"), F.col("lat_sig"), F.col("lon_sig"), wrap=True).alias("vuelta")))
query("bearing_class", f"select barrio, idEvento, {CLASS_SQL} clase from (select *, case when {ANGLE_SQL} < 0 then {ANGLE_SQL} + 360 else {ANGLE_SQL} end a from ({segments_sql(SAMPLES_SQL)}) s) b",
      lambda t: rounded(spatial.segments(_samples(t), "barrio", "idEvento", LAT, LON)).select("barrio", "idEvento", F.when(F.col("lat_sig").isNotNull(), bearing_class(bearing(F.col("lat"), F.col("lon"), F.col("lat_sig"), F.col("lon_sig")))).alias("clase")))
query("zoom_radius", "select idEvento, case when z <= 11 then 120 when z <= 12 then 80 when z <= 13 then 60 when z <= 14 then 40 else 30 end radio from (select idEvento, idEvento % 8 + 9 z from {eventos}) q",
      lambda t: t.eventos.select("idEvento", zoom_radius(F.col("idEvento") % 8 + 9).alias("radio")))

# --- layers ---------------------------------------------------------------------------------------------------------

def layer_sql(sql: str, rest: str) -> str:
    return f"select {ROUND_POINT}, {rest} from ({sql}) x"


MARKERS = "barrio, nom_ruta, valor, total_ruta"
query("layer_markers", layer_sql(markers_sql(ORDER_POINTS, "cantidad", "bigint"), MARKERS), lambda t: layers.marker_layer(metrics.points(_orders(t)), "cantidad"))
query("layer_debt_markers", layer_sql(markers_sql(DEBT_POINTS, "valor_mora", "decimal(38,2)"), MARKERS), lambda t: layers.marker_layer(metrics.debt_points(_debts(t)), "valor_mora"))
EVENT_LAYER_SQL = "select round(" + LAT + ", 6) latitud, round(" + LON + ", 6) longitud, barrio, idEvento, id_autor, tipo_evento, fecha_evento, hora_evento from ({base}) e"
query("layer_event_points", EVENT_LAYER_SQL.replace("{base}", VISITS_SQL), lambda t: layers.event_layer(_visits(t), maps.EVENT_ATTRIBUTES))
query("layer_heat", layer_sql(heat_sql(ORDER_POINTS, "cantidad"), "peso"), lambda t: layers.heat_layer(metrics.points(_orders(t)), "cantidad"))
DENSITY_HEAT = {
    "power": "select latitud, longitud, round(case when max({v}) over () < 1 then pow({v} / nullif(max({v}) over (), 0), 0.3) else {v} end, 6) peso from (select * from {{densidades}}) d",
    "minmax": "select latitud, longitud, round(({v} - min({v}) over ()) / nullif(max({v}) over () - min({v}) over (), 0), 6) peso from (select * from {{densidades}}) d",
}
query("layer_density_heat", layer_sql(DENSITY_HEAT["minmax"].format(v="contactabilidad"), "peso"), lambda t: layers.heat_layer(t.densidades, "contactabilidad", "minmax"))
query("layer_density_points", "select " + ROUND_POINT + ", barrio, round(cobertura, 6) valor from {densidades} where latitud is not null and longitud is not null", lambda t: layers.density_layer(t.densidades, "cobertura"))
SUM_COUNT, SUM_DEBT = "cast(sum(v) as bigint)", "cast(sum(v) as decimal(38,2))"
AVG_SEEN = "round(coalesce(avg(case when v <> 0 then v end), 0e0), 6)"
query("cluster_sum_zoom", cluster_sql(ORDER_POINTS, "cantidad", "nom_ruta", SUM_COUNT, 80, 12, 15), lambda t: layers.cluster(metrics.points(_orders(t)), "cantidad", maps.ZOOMS))
query("cluster_avg_zoom", cluster_sql("select * from {densidades}", "efectividad", "''", AVG_SEEN, 80, None, 15), lambda t: layers.cluster(t.densidades, "efectividad", maps.ZOOMS, by=None, how="avg"))

# --- density clusters and routes ------------------------------------------------------------------------------------

query("dbscan_barrio", f"{DBSCAN_SQL} select idEvento, barrio, cluster from d", lambda t: _clustered(t).select("idEvento", "barrio", "cluster"))
query("densest_cluster", f"{DENSEST_SQL} select idEvento, barrio, cluster from dense", lambda t: spatial.densest(_clustered(t), "barrio", "idEvento").select("idEvento", "barrio", "cluster"))
query("centroid_nearest", f"{NEAREST_SQL} select idEvento, barrio, round(distancia, 6) distancia from nr",
      lambda t: spatial.nearest_to_centroid(spatial.densest(_clustered(t), "barrio", "idEvento"), "barrio", "idEvento", LAT, LON).select("idEvento", "barrio", "distancia"))
query("route_trace", f"{NEAREST_SQL}, top3 as (select barrio from s group by barrio order by count(*) desc, barrio limit 3), seg as (select barrio, idEvento, cast(row_number() over w as int) orden, {LAT} lat, {LON} lon, lead({LAT}) over w lat_sig, lead({LON}) over w lon_sig from nr where barrio in (select barrio from top3) window w as (partition by barrio order by idEvento)) "
      f"select barrio, idEvento, orden, round(lat, 6) lat, round(lon, 6) lon, round(lat_sig, 6) lat_sig, round(lon_sig, 6) lon_sig, {CLASS_SQL} clase from (select *, case when {ANGLE_SQL} < 0 then {ANGLE_SQL} + 360 else {ANGLE_SQL} end a from seg) b",
      lambda t: spatial.trace(_samples(t).select("idEvento", "barrio", LAT, LON), "barrio", "idEvento", LAT, LON))

# --- pipelines ------------------------------------------------------------------------------------------------------

query("orders_base", f"select {_columns(ORDER_COLUMNS)} from ({ORDERS_SQL} and o.id_centroope = 4) o",
      lambda t: bases.orders_base(t, Filter(centre=4, start=ORDERS.start, end=ORDERS.end)).select(*ORDER_COLUMNS))
query("samples_base", f"select {_columns(EVENT_COLUMNS)} from ({SAMPLES_SQL}) e", lambda t: _samples(t).select(*EVENT_COLUMNS))
query("visits_base", f"select {_columns(EVENT_COLUMNS)} from ({VISITS_SQL}) e", lambda t: _visits(t).select(*EVENT_COLUMNS))
query("debt_base", f"select {_columns(DEBT_COLUMNS)} from ({DEBT_SQL}) d", lambda t: _debts(t).select(*DEBT_COLUMNS))
query("debt_base_invoice", f"select {_columns(DEBT_COLUMNS)} from ({debt_sql('num_factura')}) d", lambda t: bases.debt_base(t, DEBTS, "invoice").select(*DEBT_COLUMNS))
query("agents_by_city", f"select distinct id_autor from {{eventos}} e join {{contactos}} n on n.id = e.id_contacto join {{ciudades}} c on c.id = n.id_ciudad where c.id_centroope = 4 and id_evento_tipo in (15, 10, 12, 14, 53, 63, 46) and {LAT} <> 0 and {LON} <> 0 and fecha_evento between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-06 00:00:00' and id_autor is not null",
      lambda t: maps.agents_by_city(t, 4, "2024-01-05", "2024-01-06"))


def _parts(name: str, twins: dict[str, str], build: Callable[[Tables], dict[str, DataFrame]]) -> None:
    for part, sql in twins.items():
        query(f"{name}_{part}", sql, lambda t, part=part: build(t)[part])


ORDER_TWINS = {"markers": layer_sql(markers_sql(ORDER_POINTS, "cantidad", "bigint"), MARKERS), "heat": layer_sql(heat_sql(ORDER_POINTS, "cantidad"), "peso")}
_parts("orders_map", ORDER_TWINS | {"clusters": cluster_sql(ORDER_POINTS, "cantidad", "nom_ruta", SUM_COUNT, 2000, 12, 14), "kpi": kpi_sql(ORDERS_SQL, ORDERS, True)}, lambda t: maps.orders_map(t, ORDERS))
_parts("orders_map_alt", ORDER_TWINS | {"clusters": cluster_sql(ORDER_POINTS, "cantidad", "nom_ruta", SUM_COUNT, 80, 12, 15), "kpi": kpi_sql(ORDERS_SQL, ORDERS, False)}, lambda t: maps.orders_map(t, ORDERS, alternative=True))
_parts("visits_map", {"markers": layer_sql(VISIT_POINTS, "barrio, cantidad"), "heat": layer_sql(heat_sql(VISIT_POINTS, "cantidad"), "peso"), "clusters": cluster_sql(VISIT_POINTS, "cantidad", "''", SUM_COUNT, 80, None, 15), "kpi": kpi_sql(VISITS_SQL, EVENTS, False)}, lambda t: maps.visits_map(t, EVENTS))
_parts("visits_map", {"events": EVENT_LAYER_SQL.replace("{base}", VISITS_SQL)}, lambda t: maps.visits_map(t, EVENTS, grouped=False))
_parts("samples_map", {"events": EVENT_LAYER_SQL.replace("{base}", SAMPLES_SQL), "kpi": kpi_sql(SAMPLES_SQL, EVENTS, False)}, lambda t: maps.samples_map(t, EVENTS))
_parts("debt_map", {"markers": layer_sql(markers_sql(DEBT_POINTS, "valor_mora", "decimal(38,2)"), MARKERS), "heat": layer_sql(heat_sql(DEBT_POINTS, "valor_mora"), "peso"), "clusters": cluster_sql(DEBT_POINTS, "valor_mora", "nom_ruta", SUM_DEBT, 2000, 12, 14), "kpi": KPI_DEBT_SQL}, lambda t: maps.debt_map(t, DEBTS))
# The same with a route or neighbourhoods picked: orders and their statistics by logistic route, visits and debts by collection route.
ROUTED = {"orders": "RL_3", "visits": "RC_1", "debts": "RC_2"}
PICKED = ("NATION_3", "NATION_8", "BRAZIL", "CANADA", "PERU")
ROUTE_POINTS = points_sql(f"{ORDERS_SQL} and k.nom_ruta = '{ROUTED['orders']}'")
_parts("orders_map_route", {"markers": layer_sql(markers_sql(ROUTE_POINTS, "cantidad", "bigint"), MARKERS), "kpi": kpi_sql(f"{ORDERS_SQL} and k.nom_ruta = '{ROUTED['orders']}'", ORDERS, True)}, lambda t: maps.orders_map(t, replace(ORDERS, route=ROUTED["orders"])))
ROUTE_VISITS = f"{VISITS_SQL} and k.ruta_cobro = '{ROUTED['visits']}'"
_parts("visits_map_route", {"markers": layer_sql(points_sql(ROUTE_VISITS, "latitud, longitud, barrio"), "barrio, cantidad"), "kpi": kpi_sql(ROUTE_VISITS, EVENTS, False)}, lambda t: maps.visits_map(t, replace(EVENTS, route=ROUTED["visits"])))
PICKED_SAMPLES = f"{SAMPLES_SQL} and b.barrio in {PICKED}"
_parts("samples_map_barrios", {"events": EVENT_LAYER_SQL.replace("{base}", PICKED_SAMPLES), "kpi": kpi_sql(PICKED_SAMPLES, EVENTS, False)}, lambda t: maps.samples_map(t, replace(EVENTS, barrios=PICKED)))
ROUTE_DEBTS = f"{DEBT_SQL} and k.ruta_cobro = '{ROUTED['debts']}'"
_parts("debt_map_route", {"markers": layer_sql(markers_sql(points_sql(ROUTE_DEBTS, value="cast(sum(valor_mora) as decimal(38,2)) valor_mora"), "valor_mora", "decimal(38,2)"), MARKERS), "kpi": KPI_DEBT_SQL.replace(DEBT_SQL, ROUTE_DEBTS)}, lambda t: maps.debt_map(t, replace(DEBTS, route=ROUTED["debts"])))
for _name, _v in (("coverage_map", "cobertura"), ("contactability_map", "contactabilidad"), ("effectiveness_map", "efectividad")):
    _parts(_name, {
        "points": f"select {ROUND_POINT}, barrio, round({_v}, 6) valor from {{densidades}} where latitud is not null and longitud is not null",
        "heat": layer_sql(DENSITY_HEAT["power" if _v == "cobertura" else "minmax"].format(v=_v), "peso"),
        "clusters": cluster_sql("select * from {densidades}", _v, "''", AVG_SEEN, 80, None, 15),
        "breaks": breaks_sql("densidades", POWER_SQL.format(v=_v, table="{densidades}") if _v == "cobertura" else _v, metrics.CUTS if _v == "cobertura" else metrics.BREAKS),
        "kpi": f"select count(distinct barrio) barrios, round(avg({_v}), 6) promedio from {{densidades}}",
    }, lambda t, v=_v: maps.density_map(t, v))

# The density maps of one city, and the key figures of all cities at once.
CITY_DENSITIES = "select * from {densidades} where barrio in (select b.barrio from {barrios} b join {ciudades} c on c.id = b.id_ciudad where c.id_centroope = 4)"
for _name, _v in (("coverage_map", "cobertura"), ("contactability_map", "contactabilidad"), ("effectiveness_map", "efectividad")):
    _parts(f"{_name}_city", {
        "points": f"select {ROUND_POINT}, barrio, round({_v}, 6) valor from ({CITY_DENSITIES}) d where latitud is not null and longitud is not null",
        "heat": layer_sql(DENSITY_HEAT["power" if _v == "cobertura" else "minmax"].format(v=_v).replace("select * from {densidades}", CITY_DENSITIES), "peso"),
        "kpi": f"select count(distinct barrio) barrios, round(avg({_v}), 6) promedio from ({CITY_DENSITIES}) d",
    }, lambda t, v=_v: maps.density_map(t, v, centre=4))
query("density_batch", "select ciudad, indicador, count(distinct barrio) barrios, round(avg(v), 6) promedio from ("
      + " union all ".join(f"select c.ciudad, d.barrio, '{v}' indicador, d.{v} v from {{densidades}} d join {{barrios}} b on b.barrio = d.barrio join {{ciudades}} c on c.id = b.id_ciudad" for v in maps.INDICATORS)
      + ") u group by ciudad, indicador", maps.density_batch)

# --- agents' days, zones' loads, contacts nearer to another route ---------------------------------------------------

#: Minutes: the agents at hand make a stop every hour or two.
EVENT_PAUSE = 90
STOPS_SQL = f"""with s as (select id_autor, cast(fecha_evento as date) dia, idEvento, fecha_evento, epoch_us(fecha_evento) us, {LAT} lat, {LON} lon from {{eventos}}
 where id_evento_tipo in (15, 10, 12, 14, 53, 63, 46) and {LAT} <> 0 and {LON} <> 0 and id_autor is not null
 and fecha_evento between timestamp '{EVENTS.start} 00:00:00' and timestamp '{EVENTS.end} 23:59:59'),
 g as (select *, case when us - lag(us) over (partition by id_autor, dia order by fecha_evento, idEvento) >= {EVENT_PAUSE * 60_000_000} then 1 else 0 end nuevo from s),
 h as (select *, cast(sum(nuevo) over (partition by id_autor, dia order by fecha_evento, idEvento rows unbounded preceding) + 1 as int) tramo from g),
 r as (select *, cast(row_number() over w as int) orden, lead(lat) over w lat_sig, lead(lon) over w lon_sig, (lead(us) over w - us) / 1e6 segundos
 from h window w as (partition by id_autor, dia, tramo order by fecha_evento, idEvento))"""
query("agent_routes", f"{STOPS_SQL} select id_autor, dia, tramo, orden, idEvento, fecha_evento, round(lat, 6) lat, round(lon, 6) lon, round(lat_sig, 6) lat_sig, round(lon_sig, 6) lon_sig, round(segundos, 6) segundos, {CLASS_SQL} clase "
      f"from (select *, case when {ANGLE_SQL} < 0 then {ANGLE_SQL} + 360 else {ANGLE_SQL} end a from r) b", lambda t: maps.agent_routes(t, EVENTS, EVENT_PAUSE))  # fmt: skip
query("agent_legs", f"{STOPS_SQL} select id_autor, dia, tramo, count(*) paradas, min(fecha_evento) inicio, max(fecha_evento) fin, round(coalesce(sum(segundos), 0), 6) segundos, "
      "round(coalesce(sum(sqrt((lat_sig - lat) * (lat_sig - lat) + (lon_sig - lon) * (lon_sig - lon))), 0), 6) recorrido from r group by id_autor, dia, tramo", lambda t: maps.agent_legs(t, EVENTS, EVENT_PAUSE))  # fmt: skip


def overload_sql(base: str, ts: str) -> str:
    return f"""with d as (select barrio, cast({ts} as date) fecha, cast(count(*) as double) carga from ({base}) f where barrio is not null and {ts} is not null group by 1, 2),
 p as (select *, list(carga) over (partition by barrio order by fecha rows between 30 preceding and 1 preceding) past from d),
 m as (select *, cast(coalesce(len(past), 0) as int) dias, list_median(past) mediana from p),
 q as (select *, list_median(list_transform(past, lambda x: abs(x - mediana))) mad from m)
 select barrio, fecha, carga, dias, mediana, mad, round((carga - mediana) / nullif(mad * 1.4826e0, 0), 6) desvio,
 case when dias >= 5 and carga - mediana > 3.0e0 * 1.4826e0 * mad then 1 else 0 end sobrecarga from q"""


_parts("zone_loads", {"visits": overload_sql(VISITS_SQL, "fecha_evento"), "orders": overload_sql(ORDERS_SQL, "fecha_pedido")},
       lambda t: {"visits": maps.zone_loads(t, EVENTS)["visits"], "orders": maps.zone_loads(t, ORDERS)["orders"]})
query("misassigned_contacts", f"""with e as (select id_contacto, sum(cast(round({LAT} * 100000) as bigint)) y, sum(cast(round({LON} * 100000) as bigint)) x, count(*) n
 from {{eventos}} where {LAT} <> 0 and {LON} <> 0 and fecha_evento between timestamp '{EVENTS.start} 00:00:00' and timestamp '{EVENTS.end} 23:59:59' group by id_contacto),
 r as (select e.*, k.nom_ruta from e join {{contactos}} c on c.id = e.id_contacto join {{coords}} k on k.id_barrio = c.id_barrio where k.nom_ruta is not null),
 p as (select id_contacto, nom_ruta, round(cast(y as double) / n / 100000, 9) la, round(cast(x as double) / n / 100000, 9) lo from r),
 z as (select nom_ruta, round(cast(sum(y) as double) / sum(n) / 100000, 9) la, round(cast(sum(x) as double) / sum(n) / 100000, 9) lo from r group by nom_ruta),
 v as (select p.id_contacto, p.nom_ruta, z.nom_ruta cercana, sqrt((p.la - z.la) * (p.la - z.la) + (p.lo - z.lo) * (p.lo - z.lo)) d from p, z),
 b as (select *, row_number() over (partition by id_contacto order by d, cercana) rn from v)
 select b.id_contacto, b.nom_ruta, b.cercana, round(o.d, 6) distancia, round(b.d, 6) distancia_cercana from b join v o on o.id_contacto = b.id_contacto and o.cercana = b.nom_ruta
 where b.rn = 1 and round(b.d, 9) < round(o.d, 9)""", lambda t: maps.misassigned_contacts(t, EVENTS))  # fmt: skip


def _stats_twins(base: str, ts: str, least: int) -> dict[str, str]:
    return {"barrios": top_sql(base, "barrio", 10), "trend": trend_sql(daily_sql(base, ts), least), "estratos": shares_sql(base, "id_estrato", "0")}


_parts("stats_orders", _stats_twins(ORDERS_SQL, "fecha_pedido", 1) | {"rutas": frequency_sql(ORDERS_SQL, "nom_ruta", "'EMPLEADOS', 'TRANSPORTADORA'")}, lambda t: maps.stats_orders(t, ORDERS, 1))
_parts("stats_samples", _stats_twins(SAMPLES_SQL, "fecha_evento", 15), lambda t: maps.stats_samples(t, EVENTS))
_parts("stats_visits", _stats_twins(VISITS_SQL, "fecha_evento", 15) | {"tipos": frequency_sql(VISITS_SQL, "tipo_evento"), "rutas": frequency_sql(VISITS_SQL, "ruta_cobro")}, lambda t: maps.stats_visits(t, EVENTS))
_parts("stats_orders_route", _stats_twins(f"{ORDERS_SQL} and k.nom_ruta = '{ROUTED['orders']}'", "fecha_pedido", 1), lambda t: maps.stats_orders(t, replace(ORDERS, route=ROUTED["orders"]), 1))
_parts("stats_visits_route", _stats_twins(ROUTE_VISITS, "fecha_evento", 15) | {"tipos": frequency_sql(ROUTE_VISITS, "tipo_evento")}, lambda t: maps.stats_visits(t, replace(EVENTS, route=ROUTED["visits"])))
