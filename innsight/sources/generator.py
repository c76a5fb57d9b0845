"""Synthetic hotels of any size, every row computed from its number.

A block holds 50 guests, payers, rooms, employees and users and 120 bookings
(50 completed, 50 cancelled, 10 in house, 10 to come) with everything that
follows from them. ``scale`` is the number of blocks; the service and category
catalogues do not grow. Tables are ``range`` projections plus keyed joins, so
any scale is generated in parallel and nothing is kept on the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.functions.expressions import MONEY, money
from innsight.operators.reconcile import reconcile
from innsight.plans._common import first_reason
from innsight.schemas import METODOS_PAGO, METODOS_RESERVA, ROLES_USUARIO, TABLES
from innsight.tables import Hotel, conform

ANCHOR = dt.date(2026, 5, 15)
BLOCK = 50
BOOKINGS = 120
STAYS = 60

# Base price of the 50 room categories.
PRECIOS_CATEGORIA = (
    1800, 1950, 1700, 2000, 2250, 2050, 2200, 2350, 2100, 2400,
    2700, 2500, 2900, 3300, 3100, 3600, 3000, 3050, 4200, 4600,
    4400, 5000, 4800, 4700, 6800, 7400, 7100, 7600, 7300, 7900,
    7500, 8200, 7800, 8800, 8500, 9000, 14000, 15500, 14500, 15000,
    16500, 15800, 24000, 26500, 25500, 28000, 27500, 26000, 5500, 5200,
)
# Price of the 50 services.
PRECIOS_SERVICIO = (
    1200, 950, 850, 350, 500, 1450, 200, 250, 280, 900,
    650, 480, 1800, 180, 3500, 6500, 12500, 280, 320, 350,
    650, 2400, 250, 150, 1500, 200, 80, 100, 400, 600,
    850, 550, 1800, 1500, 1200, 1400, 2100, 4500, 2800, 180,
    150, 120, 250, 450, 800, 5500, 3800, 650, 750, 220,
)
# Places of origin, staff roles, departments and shifts by position.
ORIGENES = (
    "CDMX", "Guadalajara", "Monterrey", "Tijuana", "Cancun", "Puebla", "Merida", "Leon", "Queretaro", "Hermosillo",
    "Madrid, ES", "Buenos Aires, AR", "Bogota, CO", "Toronto, CA", "Los Angeles, US",
)
ROLES = (
    "gerente_general", "gerente_recepcion", "gerente_finanzas", "jefe_housekeeping", "recepcionista",
    "cajero", "concierge", "botones", "chef", "mesero", "bartender", "masajista", "instructor_gym",
    "mantenimiento", "seguridad",
)
DEPARTAMENTOS = (
    "gerencia", "recepcion", "finanzas", "housekeeping", "restaurante",
    "spa", "gimnasio", "mantenimiento", "seguridad", "entretenimiento",
)
DEPARTAMENTOS_QUEJA = ("recepcion", "housekeeping", "restaurante", "spa", "mantenimiento", "seguridad", "finanzas")
DEPARTAMENTOS_ENCUESTA = (
    "recepcion", "housekeeping", "restaurante", "spa", "gimnasio", "entretenimiento", "concierge",
)
TURNOS = ("matutino", "vespertino", "nocturno")


def _nth(values: tuple, index: Column) -> Column:
    """The value at a zero-based position that wraps around."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _numbered(word: str, n: Column, width: int = 2) -> Column:
    text = n.cast("string")
    return F.concat(F.lit(word), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")))


def _clock(day: Column, time: str) -> Column:
    return day.cast("timestamp_ntz") + F.expr(f"interval '{time}' hour to minute")


def _days_before(day: Column, n: Column) -> Column:
    return F.date_sub(day, n.cast("int"))


def _days_after(day: Column, n: Column) -> Column:
    return F.date_add(day, n.cast("int"))


class _Generator:
    def __init__(self, spark: SparkSession, scale: int, anchor: dt.date):
        self.spark = spark
        self.scale = scale
        self.anchor = F.lit(anchor)

    def _numbers(self, per_block: int) -> DataFrame:
        """``n`` from 1 on, its block ``b`` from 0 on, and its place ``m`` in the block from 1 on."""
        i = F.col("id")
        return self.spark.range(per_block * self.scale).select(
            (i + 1).alias("n"), F.floor(i / per_block).alias("b"), (i % per_block + 1).alias("m")
        )

    def _catalogue(self) -> DataFrame:
        return self.spark.range(1, BLOCK + 1).select(F.col("id").alias("n"))

    # --- catalogues -----------------------------------------------------

    def categoria_habitacion(self) -> DataFrame:
        n = F.col("n")
        return self._catalogue().select(
            n.alias("id_categoria"),
            _numbered("Categoria ", n).alias("nombre"),
            _numbered("Habitacion de categoria ", n).alias("descripcion"),
            _nth(PRECIOS_CATEGORIA, n - 1).alias("precio_base"),
        )

    def tipo_servicio(self) -> DataFrame:
        n = F.col("n")
        return self._catalogue().select(
            n.alias("id_tipo_servicio"),
            _numbered("Tipo ", n).alias("nombre"),
            F.when(n <= 30, "interno").otherwise("externo").alias("categoria"),
        )

    def servicio(self) -> DataFrame:
        n = F.col("n")
        return self._catalogue().select(
            n.alias("id_servicio"),
            n.alias("id_tipo_servicio"),
            _numbered("Servicio ", n).alias("nombre_servicio"),
            _nth(PRECIOS_SERVICIO, n - 1).alias("precio"),
            F.lit(True).alias("disponible"),
        )

    def evento_temporada(self) -> DataFrame:
        n = F.col("n")
        start = _days_after(F.lit(dt.date(2024, 3, 1)), n * 19)
        return self._catalogue().select(
            n.alias("id_evento"),
            _numbered("Temporada ", n).alias("nombre_evento"),
            start.alias("fecha_inicio"),
            _days_after(start, n * 13 % 70 + 4).alias("fecha_fin"),
        )

    def paquete_promocional(self) -> DataFrame:
        return self.evento_temporada().select(
            F.col("id_evento").alias("id_paquete_promocional"),
            "id_evento",
            F.concat(F.lit("Paquete "), F.col("nombre_evento")).alias("descripcion"),
            (F.col("id_evento") * 350 + 5000).alias("precio"),
            F.col("fecha_inicio").alias("inicio_validez"),
            F.col("fecha_fin").alias("fin_validez"),
        )

    def detalle_paquete_promocional(self) -> DataFrame:
        n = F.col("n")
        return self._catalogue().select(
            n.alias("id_detalle_paquete_promocional"),
            n.alias("id_paquete_promocional"),
            (n * 7 % BLOCK + 1).alias("id_servicio"),
            (n % 5 + 1).alias("cantidad_incluida"),
        )

    # --- people and rooms -------------------------------------------------

    def empleado(self) -> DataFrame:
        n, m = F.col("n"), F.col("m")
        salary = (
            F.when(m <= 5, m * 5000 + 60000)
            .when(m <= 15, m * 800 + 35000)
            .when(m <= 30, m * 300 + 18000)
            .otherwise(m * 150 + 10000)
        )
        return self._numbers(BLOCK).select(
            n.alias("id_empleado"),
            _numbered("Empleado", (m - 1) % 20 + 1).alias("nombres"),
            _numbered("Apellido", (m - 1) % 20 + 1).alias("apellidos"),
            _nth(ROLES, m - 1).alias("rol"),
            _numbered("311-555-", n * 97 % 10000, 4).alias("telefono"),
            salary.alias("salario"),
            F.when(m % 4 == 0, 2500).when(m % 7 == 0, 1500).otherwise(0).alias("bono"),
            (m % 17 != 0).alias("activo"),
            _nth(DEPARTAMENTOS, m - 1).alias("departamento"),
        )

    def usuario(self) -> DataFrame:
        n = F.col("n")
        return self._numbers(BLOCK).select(
            n.alias("id_usuario"),
            F.concat(_numbered("user", n, 3), F.lit("@example.com")).alias("email"),
            _numbered("sin-clave-", n, 3).alias("password"),
            _nth(ROLES_USUARIO, n - 1).alias("rol"),
        )

    def huesped(self) -> DataFrame:
        n, m = F.col("n"), F.col("m")
        return self._numbers(BLOCK).select(
            n.alias("id_huesped"),
            _numbered("Nombre", n * 7 % 25 + 1).alias("nombres"),
            _numbered("Apellido", n * 11 % 25 + 1).alias("apellidos"),
            _days_before(F.lit(dt.date(1990, 1, 1)), n * 73 % 14600).alias("fecha_nacimiento"),
            F.concat(_numbered("huesped", n, 3), F.lit("@example.com")).alias("email"),
            _nth(ORIGENES, m * 13).alias("pais_origen"),
            F.when(n % 2 == 0, "F").otherwise("M").alias("sexo"),
        )

    def huesped_facturador(self) -> DataFrame:
        i = F.col("id_huesped")
        letters = F.concat(F.upper(F.left("apellidos", F.lit(2))), F.upper(F.left("nombres", F.lit(2))))
        # The last seven places spell the id in base 36, so no two payers share a number.
        tax_id = F.concat(letters, F.date_format("fecha_nacimiento", "yy"), F.lpad(F.conv(i.cast("string"), 10, 36), 7, "0"))
        return self.huesped().select(
            i.alias("id_huesped_facturador"),
            i,
            F.concat(F.lit("Calle "), (i * 7 % 900 + 100).cast("string")).alias("direccion"),
            _numbered("311-700-", i * 113 % 10000, 4).alias("telefono_casa"),
            _numbered("311-800-", i * 131 % 10000, 4).alias("telefono_celular"),
            F.concat(_numbered("facturador", i, 3), F.lit("@example.com")).alias("email"),
            tax_id.alias("rfc"),
            F.col("pais_origen").alias("procedencia"),
            F.lit(0).alias("numero_reservas"),
        )

    def cliente_vip(self) -> DataFrame:
        n, m = F.col("n"), F.col("m")
        return self._numbers(BLOCK).select(
            n.alias("id_vip"),
            n.alias("id_huesped_facturador"),
            F.when(m <= 5, "platino").when(m <= 10, "oro").when(m <= 25, "plata").otherwise("bronce").alias("nivel_vip"),
            (m * 137 % 5000).alias("puntos_acumulados"),
            F.lit(0).alias("contador_reservas"),
            _days_before(self.anchor, m * 11 % 540).alias("fecha_registro"),
        )

    def habitacion(self) -> DataFrame:
        n, b, m = F.col("n"), F.col("b"), F.col("m")
        floor = F.floor((m - 1) / 10) + 1
        number = F.concat(floor.cast("string"), _numbered("", (m - 1) % 10 + 1))
        return self._numbers(BLOCK).select(
            n.alias("id_habitacion"),
            m.alias("id_categoria"),
            F.when(b == 0, number).otherwise(F.concat(b.cast("string"), F.lit("-"), number)).alias("numero_habitacion"),
            floor.alias("piso"),
            _nth(PRECIOS_CATEGORIA, m - 1).alias("precio"),
            F.lit("disponible").alias("estado"),
        )

    def bono_empleado(self) -> DataFrame:
        n, m = F.col("n"), F.col("m")
        return self._numbers(BLOCK).select(
            n.alias("id_bono"),
            n.alias("id_empleado"),
            (m * 137 % 4500 + 500).alias("monto"),
            _clock(_days_before(self.anchor, m * 11 % 540), "14:30").alias("fecha_hora"),
            _numbered("Motivo ", (m - 1) % 10 + 1).alias("motivo"),
        )

    # --- bookings and what follows from them --------------------------------

    def _bookings(self) -> DataFrame:
        """Bookings with their block ``b``, place in the block ``m`` and place in their group ``g``."""
        m, g, b = F.col("m"), F.col("g"), F.col("b")
        group = F.col("grupo")
        frame = self._numbers(BOOKINGS).withColumn(
            "grupo", first_reason(("completada", m <= 50), ("cancelada", m <= 100), ("check_in", m <= 110), ("futura", m > 110))
        ).withColumn("g", m - F.when(m <= 50, 0).when(m <= 100, 50).when(m <= 110, 100).otherwise(110))

        def by_group(completed: Column, cancelled: Column, in_house: Column, future: Column) -> Column:
            return (
                F.when(group == "completada", completed)
                .when(group == "cancelada", cancelled)
                .when(group == "check_in", in_house)
                .otherwise(future)
            )

        guest = by_group(
            F.when(g <= 40, F.floor((g - 1) / 8) + 1).otherwise(F.floor((g - 41) / 2) + 6),
            F.when(g <= 20, F.floor((g - 1) / 4) + 1).otherwise(g - 10),
            g + 40,
            g + 30,
        )
        user = by_group(g - 1, g * 3 - 1, g * 7 - 1, g * 11 - 1) % BLOCK + 1
        start = by_group(
            _days_before(self.anchor, g * 11 + 30),
            _days_before(self.anchor, g * 9 + 15),
            _days_before(self.anchor, g - 1),
            _days_after(self.anchor, g * 7 + 5),
        )
        end = by_group(
            _days_after(F.col("fecha_inicio"), g * 3 % 7 + 1),
            _days_after(F.col("fecha_inicio"), g * 5 % 7 + 1),
            _days_after(self.anchor, g + 1),
            _days_after(F.col("fecha_inicio"), g % 5 + 1),
        )
        state = by_group(group, group, group, F.when(g <= 5, "confirmada").otherwise("pendiente"))
        return (
            frame.withColumn("fecha_inicio", start)
            .withColumn("fecha_salida", end)
            .select(
                F.col("n").alias("id_reservacion"),
                b,
                m,
                (b * BLOCK + guest).alias("id_huesped"),
                (b * BLOCK + user).alias("id_usuario"),
                "fecha_inicio",
                "fecha_salida",
                state.alias("estado"),
                _nth(METODOS_RESERVA, g - 1).alias("metodo"),
                F.datediff("fecha_salida", "fecha_inicio").alias("noches"),
                (b * BLOCK + m * 7 % BLOCK + 1).alias("id_habitacion"),
                _nth(PRECIOS_CATEGORIA, m * 7).alias("tarifa"),
            )
        )

    def _stays(self) -> DataFrame:
        """Completed and in-house bookings with the running number of their stay and account."""
        m = F.col("m")
        place = F.when(m <= 50, m).otherwise(m - 50)
        return (
            self._bookings()
            .filter(F.col("estado").isin("completada", "check_in"))
            .withColumn("k", place)
            .withColumn("id_cuenta", F.col("b") * STAYS + place)
        )

    def _of_block(self, per_block: int, value: Column) -> Column:
        return F.col("b") * per_block + value % per_block + 1

    def reservacion(self) -> DataFrame:
        return self._bookings().select(
            "id_reservacion",
            "id_huesped",
            F.col("id_huesped").alias("id_huesped_facturador"),
            "id_usuario",
            "fecha_inicio",
            "fecha_salida",
            "estado",
            "metodo",
            F.lit(0).alias("subtotal"),
            F.lit(0).alias("total"),
        )

    def reservacion_habitacion(self) -> DataFrame:
        return self._bookings().select(
            F.col("id_reservacion").alias("id_reservacion_habitacion"),
            "id_reservacion",
            "id_habitacion",
            F.col("tarifa").alias("tarifa_por_noche"),
            "noches",
            F.lit(1).alias("cantidad_habitaciones"),
            (F.col("tarifa") * F.col("noches")).alias("subtotal"),
        )

    def estancia(self) -> DataFrame:
        return self._stays().select(
            F.col("id_cuenta").alias("id_estancia"),
            "id_reservacion",
            self._of_block(BLOCK, F.col("m") * 13).alias("id_empleado"),
            "id_habitacion",
            _clock(F.col("fecha_inicio"), "15:00").alias("fecha_hora_checkin"),
            _clock(F.col("fecha_salida"), "12:00").alias("fecha_hora_checkout_programado"),
            F.when(F.col("estado") == "completada", _clock(F.col("fecha_salida"), "11:45")).alias(
                "fecha_hora_checkout_real"
            ),
        )

    def cuenta(self) -> DataFrame:
        return self._stays().select(
            "id_cuenta",
            "id_reservacion",
            F.col("fecha_inicio").alias("fecha_apertura"),
            F.when(F.col("estado") == "completada", F.col("fecha_salida")).alias("fecha_cierre"),
            F.lit(0).alias("subtotal"),
            F.lit(0).alias("total"),
        )

    def detalle_cuenta(self) -> DataFrame:
        """Room charge, one service and one adjustment per account; tax on the gross amount."""
        k = F.col("k")

        def line(place: int, kind: str, units: Column, price: Column, discount: Column) -> Column:
            return F.struct(
                F.lit(place).alias("l"),
                F.lit(kind).alias("tipo"),
                units.cast("long").alias("cantidad"),
                price.cast("long").alias("precio"),
                discount.cast("long").alias("descuento"),
            )

        lines = F.array(
            line(0, "habitacion", F.col("noches"), F.col("tarifa"), F.lit(0)),
            line(1, "servicio", F.when(k % 3 == 0, 2).otherwise(1), _nth(PRECIOS_SERVICIO, k * 7), F.lit(0)),
            line(2, "ajuste", F.lit(1), k * 11 % 350 + 150, F.when(k % 5 == 0, 50).otherwise(0)),
        )
        gross = (F.col("x.cantidad") * F.col("x.precio")).cast(MONEY)
        tax = money(gross * F.lit("0.16").cast("decimal(3,2)"))
        return (
            self._stays()
            .select("b", "k", "id_cuenta", F.explode(lines).alias("x"))
            .select(
                (F.col("b") * (3 * STAYS) + F.col("x.l") * STAYS + k).alias("id_detalle_cuenta"),
                "id_cuenta",
                "x.tipo",
                F.concat(F.lit("Cargo "), F.col("x.tipo")).alias("descripcion"),
                "x.cantidad",
                F.col("x.precio").alias("precio_unitario"),
                "x.descuento",
                tax.alias("impuesto"),
                (gross - F.col("x.descuento") + tax).alias("importe"),
            )
        )

    def factura(self) -> DataFrame:
        m = F.col("m")
        return (
            self._stays()
            .filter(F.col("estado") == "completada")
            .select(
                (F.col("b") * BLOCK + m).alias("id_factura"),
                "id_cuenta",
                F.col("id_huesped").alias("id_huesped_facturador"),
                self._of_block(BLOCK, m * 17).alias("id_empleado"),
                F.col("fecha_salida").alias("fecha_emision"),
                F.lit(0).alias("subtotal"),
                F.lit(0).alias("impuestos"),
                F.lit(0).alias("total"),
                F.when(m % 13 == 0, "vencida").when(m % 11 == 0, "pendiente").otherwise("pagada").alias("estado_factura"),
            )
        )

    def pago(self) -> DataFrame:
        i, state = F.col("id_factura"), F.col("estado_factura")
        return self.factura().select(
            i.alias("id_pago"),
            i,
            F.when(state == "vencida", F.date_add("fecha_emision", 45)).otherwise(F.col("fecha_emision")).alias(
                "fecha_pago"
            ),
            F.lit(1).alias("monto"),
            _nth(METODOS_PAGO, (i - 1) % BLOCK).alias("metodo_pago"),
            _numbered("REF-", i, 6).alias("referencia"),
            F.when(state == "pendiente", "pendiente")
            .when(state == "vencida", "reembolsado")
            .otherwise("completado")
            .alias("estado"),
        )

    def cancelacion(self) -> DataFrame:
        m = F.col("m")
        penalty = money((F.col("tarifa") * F.col("noches")).cast(MONEY) * F.lit("0.55").cast("decimal(3,2)"))
        return (
            self._bookings()
            .filter(F.col("estado") == "cancelada")
            .select(
                (F.col("b") * BLOCK + m - 50).alias("id_cancelacion"),
                "id_reservacion",
                self._of_block(BLOCK, m * 19).alias("id_usuario"),
                _numbered("Motivo ", (m - 1) % 8 + 1).alias("motivo"),
                F.when((m % 5).isin(0, 1, 2), penalty).otherwise(F.lit(0).cast(MONEY)).alias("penalizacion"),
                _clock(_days_before(F.col("fecha_inicio"), m * 3 % 10), "10:00").alias("fecha_cancelacion"),
            )
        )

    def consumo_servicio(self) -> DataFrame:
        m = F.col("m")
        stays = self._stays()

        def use(offset: int, service: int, staff: int, units: Column, day: Column, time: str) -> DataFrame:
            return stays.select(
                (F.col("b") * (2 * STAYS) + offset + F.col("k")).alias("id_consumo"),
                "id_reservacion",
                "id_huesped",
                (m * service % BLOCK + 1).alias("id_servicio"),
                self._of_block(BLOCK, m * staff).alias("id_empleado"),
                units.alias("cantidad"),
                _nth(PRECIOS_SERVICIO, m * service).alias("precio_unitario"),
                _clock(_days_after(F.col("fecha_inicio"), day), time).alias("fecha_hora"),
            )

        second = F.greatest(F.lit(2), F.col("noches") - 1)
        return use(0, 3, 23, m * 5 % 3 + 1, F.lit(1), "13:00").unionByName(
            use(STAYS, 13, 29, F.lit(1).cast("long"), second, "20:30")
        )

    def bitacora_habitacion(self) -> DataFrame:
        stays = self.estancia()
        e = F.col("id_estancia")
        block, place = F.floor((e - 1) / STAYS), (e - 1) % STAYS + 1

        def moves(offset: int, before: str, after: str, when: str) -> DataFrame:
            return stays.filter(F.col(when).isNotNull()).select(
                (block * (STAYS + BLOCK) + offset + place).alias("id_bitacora"),
                "id_habitacion",
                "id_empleado",
                "id_reservacion",
                F.lit(before).alias("estado_anterior"),
                F.lit(after).alias("estado_nuevo"),
                F.col(when).alias("fecha_hora"),
            )

        return moves(0, "disponible", "ocupada", "fecha_hora_checkin").unionByName(
            moves(STAYS, "ocupada", "limpieza", "fecha_hora_checkout_real")
        )

    def queja(self) -> DataFrame:
        m = F.col("m")
        solved = m % 5 != 0
        return (
            self._bookings()
            .filter(F.col("estado") == "completada")
            .select(
                (F.col("b") * BLOCK + m).alias("id_queja"),
                "id_huesped",
                "id_reservacion",
                self._of_block(BLOCK, m * 31).alias("id_empleado"),
                F.concat(F.lit("Recepcion turno "), _nth(TURNOS, m - 1)).alias("receptor"),
                _numbered("Queja ", (m - 1) % 10 + 1).alias("queja"),
                _days_after(F.col("fecha_inicio"), F.least(F.lit(2), F.col("noches") - 1)).alias("fecha_queja"),
                F.when(solved, "Atendida").alias("resolucion_queja"),
                F.when(solved, _days_after(F.col("fecha_inicio"), F.least(F.lit(3), F.col("noches")))).alias(
                    "fecha_resolucion"
                ),
                _nth(DEPARTAMENTOS_QUEJA, m - 1).alias("departamento"),
            )
        )

    def satisfaccion(self) -> DataFrame:
        m = F.col("m")
        return (
            self._bookings()
            .filter(F.col("estado") == "completada")
            .select(
                (F.col("b") * BLOCK + m).alias("id_satisfaccion"),
                "id_huesped",
                "id_reservacion",
                self._of_block(BLOCK, m * 37).alias("id_empleado"),
                _nth(DEPARTAMENTOS_ENCUESTA, m - 1).alias("departamento"),
                F.concat(F.lit("Encuesta salida turno "), _nth(TURNOS, m - 1)).alias("receptor"),
                _numbered("Comentario ", (m - 1) % 8 + 1).alias("comentarios"),
                F.col("fecha_salida").alias("fecha_satisfaccion"),
                F.when(m % 20 == 0, 2).when(m % 10 == 0, 3).when(m % 4 == 0, 4).otherwise(5).alias("calificacion"),
            )
        )


def generate(spark: SparkSession, scale: int = 1, anchor: dt.date = ANCHOR) -> Hotel:
    """A consistent hotel of ``scale`` blocks around ``anchor``, totals and counters reconciled."""
    source = _Generator(spark, scale, anchor)
    raw = Hotel(
        spark,
        {name: (lambda name=name: conform(getattr(source, name)(), TABLES[name].struct)) for name in TABLES},
    )
    return reconcile(raw)
