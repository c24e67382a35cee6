"""Logical tables of a field organisation as views over the star-schema tables at hand.

The texts below run in Spark SQL and in DuckDB alike: ``{name}`` stands for another logical or stored table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

STORED = ("region", "nation", "customer", "orders", "lineitem", "events")

LOGICAL: dict[str, str] = {
    "barrios": "select cast(n_nationkey as bigint) id, n_name barrio, n_nationkey % 7 id_estrato, "
    "cast(n_regionkey as bigint) id_ciudad from {nation}",
    "ciudades": "select cast(r_regionkey as bigint) id, r_name ciudad, r_regionkey + 2 id_centroope from {region}",
    "coords": "select cast(n_nationkey as bigint) id_barrio, n_name barrio, 3.35e0 + 0.01e0*(n_nationkey % 5) latitud, "
    "-76.55e0 + 0.01e0*floor(n_nationkey/5) longitud, case when n_nationkey % 9 = 4 then null else "
    "concat('RC_', cast(n_nationkey % 4 as varchar(9))) end ruta_cobro, case n_nationkey % 6 when 0 then 'EMPLEADOS' "
    "when 1 then 'TRANSPORTADORA' when 2 then null else concat('RL_', cast(n_nationkey % 6 as varchar(9))) end nom_ruta "
    "from {nation} where n_nationkey % 8 <> 7",
    "contactos": "select c_custkey id, cast(c_nationkey as bigint) id_barrio, cast(c_nationkey % 5 as bigint) id_ciudad "
    "from {customer}",
    "pedidos": "select o.o_orderkey id, o.o_custkey id_contacto, cast(o.o_orderdate as date) fecha_pedido, "
    "o.o_orderdate fecha_hora_pedido, cast(c.c_nationkey as bigint) id_barrio, c.c_nationkey % 5 + 2 id_centroope, "
    "l.entrega fecha_hora_entrega, o.o_orderdate + interval '700' day promesa_entrega, "
    "case when o.o_orderstatus='P' then 0 else 1 end estado_pedido, "
    "case when o.o_orderkey % 10 = 0 then 1 else 0 end anulada, o.o_orderkey % 4 autorizar, "
    "case when o.o_orderkey % 20 = 1 then 1 else 0 end autorizacion_descuento, o.o_orderkey % 3 tipo_documento "
    "from {orders} o join {customer} c on o.o_custkey=c.c_custkey left join (select l_orderkey, max(l_shipdate) entrega "
    "from {lineitem} group by l_orderkey) l on l.l_orderkey=o.o_orderkey",
    "eventos": "select e.event_id idEvento, e.user_id id_contacto, e.ts fecha_evento, e.ts fecha_creacion, "
    "e.event_id % 17 id_autor, e.event_type tipo_evento, e.event_type nombre_evento, e.event_type categoria_evento, "
    "case e.event_type when 'click' then 15 when 'view' then 10 when 'purchase' then 12 when 'signup' then 14 else 99 end "
    "id_evento_tipo, case when e.event_id % 50 = 0 then 0e0 else round(3.35e0 + 0.01e0*(c.c_nationkey % 5) + "
    "0.00001e0*((e.event_id*7919) % 1000 - 500),5) end coordenada_latitud, case when e.event_id % 50 = 0 then 0e0 else "
    "round(-76.55e0 + 0.01e0*floor(c.c_nationkey/5) + 0.00001e0*((e.event_id*104729) % 1000 - 500),5) end "
    "coordenada_longitud from {events} e join {customer} c on e.user_id=c.c_custkey",
    "saldos": "select o_orderkey num_factura, o_custkey id_contacto, cast(o_totalprice as decimal(18,2)) saldo, "
    "case when o_orderkey % 10 = 0 then 1 else 0 end anulada, cast(o_orderdate as date) fecha_factura, "
    "cast(o_custkey % 25 as bigint) id_barrio, cast(date '2001-08-01' - cast(o_orderdate as date) as int) edad_factura "
    "from {orders}",
    "rutas_cobro_zonas": "select cast(n_nationkey as bigint) id_barrio, cast(n_nationkey % 4 as bigint) id_ruta_cobro "
    "from {nation} union all select cast(n_nationkey as bigint), cast((n_nationkey+1) % 4 as bigint) from {nation} "
    "where n_nationkey % 5 = 0",
    "rutas_cobro": "select distinct cast(n_nationkey % 4 as bigint) id, concat('RC_', cast(n_nationkey % 4 as varchar(9))) "
    "ruta from {nation}",
    "densidades": "select c0.barrio, c0.latitud, c0.longitud, k.cobertura, k.contactabilidad, e.efectividad from {coords} c0 "
    "left join (select c.id_barrio, avg(case when o.id_contacto is null then 0e0 else 1e0 end) cobertura, "
    "avg(case when v.id_contacto is null then 0e0 else 1e0 end) contactabilidad from {contactos} c "
    "left join (select distinct id_contacto from {pedidos}) o on o.id_contacto = c.id "
    "left join (select distinct id_contacto from {eventos}) v on v.id_contacto = c.id group by c.id_barrio) k "
    "on k.id_barrio = c0.id_barrio left join (select id_barrio, avg(case when fecha_hora_entrega <= promesa_entrega "
    "then 1e0 else 0e0 end) efectividad from {pedidos} group by id_barrio) e on e.id_barrio = c0.id_barrio",
}


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class Tables:
    """Stored and logical tables of one folder as lazy DataFrames: ``Tables(spark, folder).pedidos``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in STORED:
            found = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        elif name in LOGICAL:
            text = LOGICAL[name]
            found = self.spark.sql(text, **{need: getattr(self, need) for need in _needs(text)})
        else:
            raise AttributeError(name)
        setattr(self, name, found)
        return found


def with_tables(sql: str) -> str:
    """``sql`` as one statement whose ``{name}`` logical tables are defined ahead of it, for another engine."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in LOGICAL and name not in order:
            for need in _needs(LOGICAL[name]):
                add(need)
            order.append(name)

    for name in _needs(sql):
        add(name)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    if not order:
        return plain(sql)
    heads = ", ".join(f"{name} as ({plain(LOGICAL[name])})" for name in order)
    body = plain(sql).strip()
    recursive = body.lower().startswith("with recursive")
    if body.lower().startswith("with"):
        body = ", " + re.sub(r"(?i)^with\s+(recursive\s+)?", "", body)
    return f"with {'recursive ' if recursive else ''}{heads} {body}"
