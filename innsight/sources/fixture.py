"""Hotel tables derived from a TPC-H-like star schema stored as parquet.

Every derived table is a projection, a filter or one keyed join of the source
tables, so column pruning and filters reach the source scans. Customers stand
for guests, orders for bookings, parts for rooms and services, line items for
booked rooms (lines 1 and 2), service consumptions (lines 3 and up) and staff
bonuses (line 7).
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.functions.expressions import MONEY, SUM_MONEY, money
from innsight.schemas import METODOS_PAGO, ROLES_USUARIO
from innsight.streaming._common import file_stream
from innsight.tables import Hotel

FIXTURE_TODAY = dt.date(2001, 6, 15)

# Departments by position.
DEPARTAMENTOS_QUEJA = ("recepcion", "housekeeping", "restaurante", "spa", "mantenimiento", "seguridad", "finanzas")
DEPARTAMENTOS_ENCUESTA = ("recepcion", "housekeeping", "restaurante", "spa", "gimnasio", "entretenimiento", "concierge")
ROLES_EMPLEADO = ("recepcionista", "concierge", "mesero")

#: Line items per task where stays are found. Adaptive execution sizes tasks by
#: compressed bytes, and 64 MB of bare keys are more than ten million rows.
LINES_PER_TASK = 500_000


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _at(day: Column, clock: str) -> Column:
    """A calendar date at a wall-clock time, without a zone."""
    return day.cast("timestamp_ntz") + F.expr(f"interval '{clock}' hour to minute")


def _once(build):
    """Plan a derived table a single time, however many others are derived from it."""

    @functools.wraps(build)
    def planned(self, *args) -> DataFrame:
        key = (build.__name__, *args)
        if key not in self.planned:
            self.planned[key] = build(self, *args)
        return self.planned[key]

    return planned


class _Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str, hoy: dt.date, live: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.dir = sf_dir
        self.hoy = F.lit(hoy)
        self.live = live or {}
        self.planned: dict[tuple, DataFrame] = {}

    @_once
    def raw(self, name: str) -> DataFrame:
        """A source table, or the stream that stands in for it."""
        if name in self.live:
            return self.live[name]
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- dimensions -----------------------------------------------------

    def tipo_servicio(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("long").alias("id_tipo_servicio"),
            F.col("n_name").alias("nombre"),
            F.when(F.col("n_regionkey") % 2 == 0, "interno").otherwise("externo").alias("categoria"),
        )

    def _brand_id(self) -> Column:
        return F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")

    def categoria_habitacion(self) -> DataFrame:
        return (
            self.raw("part")
            .groupBy(self._brand_id().alias("id_categoria"), F.col("p_brand").alias("nombre"))
            .agg(F.min(F.col("p_retailprice").cast(MONEY)).alias("precio_base"))
            .select("id_categoria", "nombre", F.lit(None).cast("string").alias("descripcion"), "precio_base")
        )

    @_once
    def servicio(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id_servicio"),
            (F.col("p_partkey") % 25).alias("id_tipo_servicio"),
            F.col("p_name").alias("nombre_servicio"),
            F.col("p_retailprice").cast(MONEY).alias("precio"),
            (F.col("p_partkey") % 10 != 0).alias("disponible"),
        )

    def huesped(self) -> DataFrame:
        c = F.col("c_custkey")
        nation = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        return (
            self.raw("customer")
            .join(nation, "c_nationkey")
            .select(
                c.alias("id_huesped"),
                F.col("c_name").alias("nombres"),
                F.col("c_mktsegment").alias("apellidos"),
                F.date_sub(F.lit(dt.date(1990, 1, 1)), (c * 73 % 14600).cast("int")).alias("fecha_nacimiento"),
                F.when((c % 10 == 0) | (c % 20 == 13), F.lit(None).cast("string"))
                .when(c % 10 == 5, "")
                .otherwise(F.concat(F.lit("guest"), c.cast("string"), F.lit("@example.com")))
                .alias("email"),
                F.when(c % 50 != 7, F.col("n_name")).alias("pais_origen"),
                F.when(c % 2 == 0, "F").otherwise("M").alias("sexo"),
            )
        )

    def huesped_facturador(self) -> DataFrame:
        c = F.col("c_custkey")
        text = c.cast("string")
        return (
            self.raw("customer")
            .filter(c % 10 != 3)
            .select(
                c.alias("id_huesped_facturador"),
                c.alias("id_huesped"),
                F.concat(F.lit("Calle "), text).alias("direccion"),
                F.lit(None).cast("string").alias("telefono_casa"),
                F.concat(F.lit("311-"), text).alias("telefono_celular"),
                F.concat(F.lit("payer"), text, F.lit("@example.com")).alias("email"),
                F.concat(F.lit("RFC"), text).alias("rfc"),
                F.col("c_mktsegment").alias("procedencia"),
                (c % 12).alias("numero_reservas"),
            )
        )

    def cliente_vip(self) -> DataFrame:
        i = F.col("c_custkey")
        return (
            self.raw("customer")
            .filter((i % 10 != 3) & (i % 4 != 1))
            .select(
                i.alias("id_vip"),
                i.alias("id_huesped_facturador"),
                F.when(i % 7 == 0, "platino")
                .when(i % 7 == 1, "oro")
                .when((i % 7).isin(2, 3), "plata")
                .otherwise("bronce")
                .alias("nivel_vip"),
                (i * 137 % 5000).alias("puntos_acumulados"),
                (i % 6).alias("contador_reservas"),
                F.date_sub(self.hoy, (i * 11 % 540).cast("int")).alias("fecha_registro"),
            )
        )

    def habitacion(self) -> DataFrame:
        i = F.col("p_partkey")
        busy = (
            self.estancia()
            .filter(F.col("fecha_hora_checkout_real").isNull())
            .select(F.col("id_habitacion").alias("p_partkey"))
            .distinct()
            .withColumn("abierta", F.lit(True))
        )
        return (
            self.raw("part")
            .join(busy, "p_partkey", "left")
            .select(
                i.alias("id_habitacion"),
                self._brand_id().alias("id_categoria"),
                i.cast("string").alias("numero_habitacion"),
                F.floor(i / 100).cast("int").alias("piso"),
                F.col("p_retailprice").cast(MONEY).alias("precio"),
                F.when(F.col("abierta"), "ocupada")
                .when(i % 20 == 0, "mantenimiento")
                .when(i % 20 == 1, "limpieza")
                .when(i % 20 == 2, "fuera_de_servicio")
                .otherwise("disponible")
                .alias("estado"),
            )
        )

    def empleado(self) -> DataFrame:
        i = F.col("s_suppkey")
        return self.raw("supplier").select(
            i.alias("id_empleado"),
            F.col("s_name").alias("nombres"),
            F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("apellidos"),
            _pick(ROLES_EMPLEADO, i % 3).alias("rol"),
            F.concat(F.lit("311-555-"), i.cast("string")).alias("telefono"),
            (i * 150 + 10000).cast(MONEY).alias("salario"),
            F.when(i % 4 == 0, F.lit(2500)).otherwise(F.lit(0)).cast(MONEY).alias("bono"),
            (i % 17 != 0).alias("activo"),
            _pick(DEPARTAMENTOS_QUEJA, i % 7).alias("departamento"),
        )

    def usuario(self) -> DataFrame:
        i = F.col("s_suppkey")
        return self.raw("supplier").select(
            i.alias("id_usuario"),
            F.concat(F.lit("user"), i.cast("string"), F.lit("@example.com")).alias("email"),
            F.concat(F.lit("no-secret-"), i.cast("string")).alias("password"),
            _pick(ROLES_USUARIO, i % 5).alias("rol"),
        )

    @_once
    def evento_temporada(self) -> DataFrame:
        return (
            self.raw("orders")
            .select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("mes"))
            .distinct()
            .select(
                (F.year("mes") * 100 + F.month("mes")).cast("long").alias("id_evento"),
                F.concat(F.lit("Temporada "), F.date_format("mes", "yyyy-MM")).alias("nombre_evento"),
                F.col("mes").alias("fecha_inicio"),
                F.last_day("mes").alias("fecha_fin"),
            )
        )

    def paquete_promocional(self) -> DataFrame:
        return self.evento_temporada().select(
            F.col("id_evento").alias("id_paquete_promocional"),
            "id_evento",
            F.concat(F.lit("Paquete "), F.col("nombre_evento")).alias("descripcion"),
            (F.col("id_evento") % 100 * 100 + 5000).cast(MONEY).alias("precio"),
            F.col("fecha_inicio").alias("inicio_validez"),
            F.col("fecha_fin").alias("fin_validez"),
        )

    def detalle_paquete_promocional(self) -> DataFrame:
        i, j = F.col("id_evento"), F.col("j")
        return (
            self.evento_temporada()
            .select("id_evento", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
            .select(
                (i * 2 + j).alias("id_detalle_paquete_promocional"),
                i.alias("id_paquete_promocional"),
                ((i * 7 + j * 13) % 200).alias("id_servicio"),
                (i % 4 + 1).cast("decimal(10,2)").alias("cantidad_incluida"),
            )
        )

    # --- bookings -------------------------------------------------------

    @_once
    def reservacion(self) -> DataFrame:
        k = F.col("o_orderkey")
        payer = F.when(F.col("o_custkey") % 10 == 3, F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))
        start, end = F.col("fecha_inicio"), F.col("fecha_salida")
        state = (
            F.when(k % 10 < 2, "cancelada")
            .when((start > self.hoy) & (k % 2 == 1), "confirmada")
            .when(start > self.hoy, "pendiente")
            .when((end > self.hoy) & (k % 10 < 5), "confirmada")
            .when(end > self.hoy, "check_in")
            .when(k % 20 == 3, "expirada")
            .when(k % 50 == 2, "pendiente")
            .otherwise("completada")
        )
        subtotal = F.col("o_totalprice").cast(MONEY)
        return (
            self.raw("orders")
            .withColumn("fecha_inicio", F.col("o_orderdate").cast("date"))
            .withColumn("fecha_salida", F.date_add("fecha_inicio", (k * 3 % 7 + 1).cast("int")))
            .select(
                k.alias("id_reservacion"),
                F.col("o_custkey").alias("id_huesped"),
                payer.alias("id_huesped_facturador"),
                (k % 10).alias("id_usuario"),
                "fecha_inicio",
                "fecha_salida",
                state.alias("estado"),
                _pick(("internet", "telefono", "presencial"), k % 3).alias("metodo"),
                subtotal.alias("subtotal"),
                money(subtotal * F.lit("1.16").cast("decimal(3,2)")).alias("total"),
            )
        )

    def _line_id(self) -> Column:
        """Surrogate of a line item from all that tells it from others; (order, line) alone does not."""
        said = F.concat_ws(
            ":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.floor("l_quantity").cast("string"),
            F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
            F.col("l_shipdate").cast("date").cast("string"),
        )
        digits = F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")
        # a digest is never null; said so, scans for nulls don't carry it through their shuffles
        return F.coalesce(digits, F.lit(0).cast("long"))

    @_once
    def reservacion_habitacion(self) -> DataFrame:
        nights = (F.col("l_orderkey") * 3 % 7 + 1).cast("int")
        rate = F.col("l_extendedprice").cast(MONEY)
        return (
            self.raw("lineitem")
            .filter(F.col("l_linenumber") <= 2)
            .select(
                self._line_id().alias("id_reservacion_habitacion"),
                F.col("l_orderkey").alias("id_reservacion"),
                F.col("l_partkey").alias("id_habitacion"),
                rate.alias("tarifa_por_noche"),
                nights.alias("noches"),
                F.lit(1).alias("cantidad_habitaciones"),
                (rate * nights).cast(MONEY).alias("subtotal"),
            )
        )

    @_once
    def _stays(self) -> DataFrame:
        """Bookings that became a stay, with the room they got."""
        tasks = self.raw("lineitem").count() // LINES_PER_TASK + 1
        room = (
            self.raw("lineitem")
            .filter(F.col("l_linenumber") <= 2)
            .select(F.col("l_orderkey").alias("id_reservacion"), "l_partkey")
            .repartition(tasks, "id_reservacion")
            .groupBy("id_reservacion")
            .agg(F.min("l_partkey").alias("id_habitacion"))
        )
        bookings = self.reservacion().filter(F.col("estado").isin("completada", "check_in"))
        return bookings.repartition(tasks, "id_reservacion").join(room, "id_reservacion")

    @_once
    def estancia(self) -> DataFrame:
        k = F.col("id_reservacion")
        return self._stays().select(
            k.alias("id_estancia"),
            k,
            (k % 10).alias("id_empleado"),
            "id_habitacion",
            _at(F.col("fecha_inicio"), "15:00").alias("fecha_hora_checkin"),
            _at(F.col("fecha_salida"), "12:00").alias("fecha_hora_checkout_programado"),
            F.when(F.col("estado") == "completada", _at(F.col("fecha_salida"), "11:45")).alias(
                "fecha_hora_checkout_real"
            ),
        )

    def cancelacion(self) -> DataFrame:
        k = F.col("id_reservacion")
        rooms = self.reservacion_habitacion().groupBy("id_reservacion").agg(F.sum("subtotal").alias("suma"))
        cancelled = self.reservacion().filter(F.col("estado") == "cancelada")
        nothing = F.lit(0).cast(SUM_MONEY)
        share = F.coalesce(F.col("suma").cast(SUM_MONEY), nothing) * F.lit("0.55").cast("decimal(3,2)")
        return cancelled.join(rooms, "id_reservacion", "left").select(
            k.alias("id_cancelacion"),
            k,
            (k % 10).alias("id_usuario"),
            F.concat(F.lit("Motivo "), (k % 8).cast("string")).alias("motivo"),
            F.when(k % 5 < 3, F.round(share, 2).cast(SUM_MONEY)).otherwise(nothing).alias("penalizacion"),
            _at(F.date_sub("fecha_inicio", (k * 3 % 10).cast("int")), "10:00").alias("fecha_cancelacion"),
        )

    # --- billing --------------------------------------------------------

    def cuenta(self) -> DataFrame:
        k = F.col("id_reservacion")
        return self._stays().select(
            k.alias("id_cuenta"),
            k,
            F.col("fecha_inicio").alias("fecha_apertura"),
            F.when(F.col("estado") == "completada", F.col("fecha_salida")).alias("fecha_cierre"),
            "subtotal",
            "total",
        )

    @_once
    def factura(self) -> DataFrame:
        k = F.col("id_reservacion")
        return (
            self._stays()
            .filter(F.col("estado") == "completada")
            .select(
                k.alias("id_factura"),
                k.alias("id_cuenta"),
                "id_huesped_facturador",
                (k % 10).alias("id_empleado"),
                F.col("fecha_salida").alias("fecha_emision"),
                "subtotal",
                money(F.col("subtotal") * F.lit("0.16").cast("decimal(3,2)")).alias("impuestos"),
                "total",
                F.when(k % 13 == 0, "vencida").when(k % 11 == 0, "pendiente").otherwise("pagada").alias(
                    "estado_factura"
                ),
            )
        )

    def pago(self) -> DataFrame:
        k, state = F.col("id_factura"), F.col("estado_factura")
        half = money(F.col("total") * F.lit("0.50").cast("decimal(3,2)"))
        return self.factura().select(
            k.alias("id_pago"),
            k,
            F.when(state == "vencida", F.date_add("fecha_emision", 45)).otherwise(F.col("fecha_emision")).alias(
                "fecha_pago"
            ),
            F.when(state == "pendiente", half).otherwise(F.col("total")).alias("monto"),
            _pick(METODOS_PAGO, k % 5).alias("metodo_pago"),
            F.concat(F.lit("REF-"), k.cast("string")).alias("referencia"),
            F.when(state == "pendiente", "pendiente")
            .when(state == "vencida", "reembolsado")
            .when(k % 17 == 0, "fallido")
            .otherwise("completado")
            .alias("estado"),
        )

    def _consumed(self, bookings: DataFrame) -> DataFrame:
        """Service consumptions of ``bookings``, which has ``id_reservacion`` and columns that go along."""
        lines = (
            self.raw("lineitem")
            .filter(F.col("l_linenumber") > 2)
            .select(
                self._line_id().alias("id_consumo"),
                F.col("l_orderkey").alias("id_reservacion"),
                F.col("l_partkey").alias("id_servicio"),
                F.col("l_suppkey").alias("id_empleado"),
                F.floor("l_quantity").cast("int").alias("cantidad"),
                _at(F.col("l_shipdate").cast("date"), "13:00").alias("fecha_hora"),
            )
        )
        price = self.servicio().select("id_servicio", F.col("precio").alias("precio_unitario"))
        return lines.join(bookings, "id_reservacion").join(price, "id_servicio")

    def _guests(self) -> DataFrame:
        """Bookings that may have consumed something, with their guest."""
        held = self.reservacion().filter(F.col("estado").isin("completada", "check_in"))
        return held.select("id_reservacion", "id_huesped")

    @_once
    def consumo_servicio(self) -> DataFrame:
        return self._consumed(self._guests()).select(
            "id_consumo", "id_reservacion", "id_huesped", "id_servicio", "id_empleado", "cantidad", "precio_unitario",
            "fecha_hora",
        )

    def detalle_cuenta(self) -> DataFrame:
        # bookings with an account are found before line items meet them, so these are shuffled once
        accounts = self._stays().select("id_reservacion")
        rooms = self.reservacion_habitacion().join(accounts, "id_reservacion").select(
            (F.col("id_reservacion_habitacion") * 2).alias("id_detalle_cuenta"),
            F.col("id_reservacion").alias("id_cuenta"),
            F.lit("habitacion").alias("tipo"),
            F.col("noches").cast("decimal(10,2)").alias("cantidad"),
            F.col("tarifa_por_noche").alias("precio_unitario"),
            F.lit(0).cast(MONEY).alias("descuento"),
        )
        services = self._consumed(self._guests().join(accounts, "id_reservacion")).select(
            (F.col("id_consumo") * 2 + 1).alias("id_detalle_cuenta"),
            F.col("id_reservacion").alias("id_cuenta"),
            F.lit("servicio").alias("tipo"),
            F.col("cantidad").cast("decimal(10,2)").alias("cantidad"),
            "precio_unitario",
            F.when(F.col("id_reservacion") % 5 == 0, F.lit(50)).otherwise(F.lit(0)).cast(MONEY).alias("descuento"),
        )
        gross = F.col("cantidad") * F.col("precio_unitario")
        tax = money(gross * F.lit("0.16").cast("decimal(3,2)"))
        return (
            rooms.unionByName(services).select(
                "id_detalle_cuenta",
                "id_cuenta",
                "tipo",
                F.concat(F.lit("Cargo "), F.col("tipo")).alias("descripcion"),
                "cantidad",
                "precio_unitario",
                "descuento",
                tax.alias("impuesto"),
                (gross - F.col("descuento") + tax).cast(MONEY).alias("importe"),
            )
        )

    # --- logs, complaints, surveys, bonuses -------------------------------

    def bitacora_habitacion(self) -> DataFrame:
        k = F.col("id_reservacion")
        stays = self.estancia()

        def moves(offset: int, before: str, after: str, when: str) -> DataFrame:
            return stays.filter(F.col(when).isNotNull()).select(
                (k * 2 + offset).alias("id_bitacora"),
                "id_habitacion",
                "id_empleado",
                k,
                F.lit(before).alias("estado_anterior"),
                F.lit(after).alias("estado_nuevo"),
                F.col(when).alias("fecha_hora"),
            )

        return moves(0, "disponible", "ocupada", "fecha_hora_checkin").unionByName(
            moves(1, "ocupada", "limpieza", "fecha_hora_checkout_real")
        )

    def queja(self) -> DataFrame:
        k = F.col("id_reservacion")
        solved = k % 5 != 0
        return (
            self.reservacion()
            .filter(F.col("estado").isin("completada", "cancelada") & (k % 3 == 0))
            .select(
                k.alias("id_queja"),
                "id_huesped",
                k,
                F.when(k % 6 != 0, k % 10).alias("id_empleado"),
                F.lit("Recepcion").alias("receptor"),
                F.concat(F.lit("Queja "), (k % 10).cast("string")).alias("queja"),
                F.date_add("fecha_inicio", 1).alias("fecha_queja"),
                F.when(solved, "Atendido").alias("resolucion_queja"),
                F.when(solved, F.date_add("fecha_inicio", (k % 4 + 1).cast("int"))).alias("fecha_resolucion"),
                _pick(DEPARTAMENTOS_QUEJA, k % 7).alias("departamento"),
            )
        )

    def satisfaccion(self) -> DataFrame:
        k = F.col("id_reservacion")
        return (
            self.reservacion()
            .filter(F.col("estado") == "completada")
            .select(
                k.alias("id_satisfaccion"),
                "id_huesped",
                k,
                F.when(k % 6 != 1, k % 10).alias("id_empleado"),
                _pick(DEPARTAMENTOS_ENCUESTA, k % 7).alias("departamento"),
                F.lit("Encuesta").alias("receptor"),
                F.concat(F.lit("Comentario "), (k % 8).cast("string")).alias("comentarios"),
                F.col("fecha_salida").alias("fecha_satisfaccion"),
                F.when(k % 20 == 7, 2).when(k % 10 == 7, 3).when(k % 4 == 0, 4).otherwise(5).alias("calificacion"),
            )
        )

    def bono_empleado(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .filter(F.col("l_linenumber") == 7)
            .select(
                self._line_id().alias("id_bono"),
                F.col("l_suppkey").alias("id_empleado"),
                (F.col("l_partkey") * 137 % 4500 + 500).cast(MONEY).alias("monto"),
                _at(F.col("l_shipdate").cast("date"), "14:30").alias("fecha_hora"),
                F.concat(F.lit("Motivo "), (F.col("l_orderkey") % 10).cast("string")).alias("motivo"),
            )
        )


_NAMES = (
    "huesped", "usuario", "empleado", "categoria_habitacion", "evento_temporada", "tipo_servicio",
    "huesped_facturador", "cliente_vip", "habitacion", "bono_empleado", "paquete_promocional", "servicio",
    "reservacion", "reservacion_habitacion", "estancia", "cancelacion", "cuenta", "detalle_cuenta", "factura",
    "pago", "detalle_paquete_promocional", "consumo_servicio", "bitacora_habitacion", "queja", "satisfaccion",
)


def fixture_hotel(spark: SparkSession, sf_dir: str, hoy: dt.date = FIXTURE_TODAY) -> Hotel:
    """The 25 logical tables over the parquet files of ``sf_dir``."""
    fixture = _Fixture(spark, sf_dir, hoy)
    return Hotel(spark, {name: getattr(fixture, name) for name in _NAMES})


def room_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room-state requests read from the ``events`` table: (id, room, state, time)."""
    return room_event_columns(spark.read.parquet(f"{sf_dir}/events.parquet"))


def room_event_columns(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    state = (
        F.when(kind == "view", "disponible")
        .when(kind == "click", "ocupada")
        .when(kind == "purchase", "limpieza")
        .when(kind == "signup", "mantenimiento")
        .otherwise("fuera_de_servicio")
    )
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("id_habitacion"),
        state.alias("estado"),
        F.col("ts").alias("fecha_hora"),
    )


# --- request batches -----------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def booking_requests(spark: SparkSession, sf_dir: str, hoy: dt.date = FIXTURE_TODAY) -> DataFrame:
    """One booking request per order, over the next months; some ask for no night at all."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rooms = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.count("*")).scalar()
    start = F.date_add(F.lit(hoy), ((k * 13 + c) % 120).cast("int"))
    return _orders(spark, sf_dir).select(
        k.alias("request_id"),
        F.col("o_orderdate").alias("arrival"),
        c.alias("id_huesped"),
        F.when(c % 10 == 3, c - 1).otherwise(c).alias("id_huesped_facturador"),
        (k % 10).alias("id_usuario"),
        start.alias("fecha_inicio"),
        F.date_add(start, (k % 6).cast("int")).alias("fecha_salida"),
        _pick(("internet", "telefono", "presencial"), k % 3).alias("metodo"),
        ((k * 31 + c) % rooms).alias("id_habitacion"),
    )


def booking_followups(hotel: Hotel) -> DataFrame:
    """One request per stored booking, in order of arrival date."""
    k = F.col("id_reservacion")
    return hotel.reservacion.select(
        k.alias("request_id"),
        F.col("fecha_inicio").cast("timestamp_ntz").alias("arrival"),
        k,
        (k % 10).alias("id_empleado"),
        (k % 10).alias("id_usuario"),
        F.concat(F.lit("Motivo "), (k % 8).cast("string")).alias("motivo"),
        "fecha_inicio",
        "estado",
    )


def checkin_requests(hotel: Hotel) -> DataFrame:
    """Expected bookings asking for the first of their rooms."""
    room = hotel.reservacion_habitacion.groupBy("id_reservacion").agg(F.min("id_habitacion").alias("id_habitacion"))
    return (
        booking_followups(hotel)
        .filter(F.col("estado").isin("pendiente", "confirmada"))
        .join(room, "id_reservacion")
        .select("request_id", "arrival", "id_reservacion", "id_empleado", "id_habitacion")
    )


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return file_stream(spark, sf_dir, f"{name}.parquet", schema)


def stream_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reservacion`` with the orders arriving as a stream."""
    return _Fixture(spark, sf_dir, FIXTURE_TODAY, {"orders": _stream(spark, sf_dir, "orders")}).reservacion()


def stream_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``consumo_servicio`` with the line items arriving as a stream."""
    return _Fixture(spark, sf_dir, FIXTURE_TODAY, {"lineitem": _stream(spark, sf_dir, "lineitem")}).consumo_servicio()


def stream_service_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_requests(spark, sf_dir, {"lineitem": _stream(spark, sf_dir, "lineitem")})


def stream_room_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return room_event_columns(_stream(spark, sf_dir, "events"))


def service_requests(spark: SparkSession, sf_dir: str, live: dict[str, DataFrame] | None = None) -> DataFrame:
    """Line items from the third on as service requests; small quantities become invalid."""
    fixture = _Fixture(spark, sf_dir, FIXTURE_TODAY, live)
    return (
        fixture.raw("lineitem")
        .filter(F.col("l_linenumber") > 2)
        .select(
            fixture._line_id().alias("request_id"),
            F.col("l_shipdate").alias("arrival"),
            F.col("l_orderkey").alias("id_reservacion"),
            F.col("l_partkey").alias("id_servicio"),
            F.col("l_suppkey").alias("id_empleado"),
            (F.floor("l_quantity") - 5).cast("int").alias("cantidad"),
        )
    )
