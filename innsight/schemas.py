"""Schemas, keys, references, row rules and value domains of the 25 tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# State and category domains, each in its business order.
SEXOS = ("M", "F", "O")
ROLES_USUARIO = ("admin", "recepcion", "finanzas", "gerencia", "reportes")
ORIGENES_SERVICIO = ("interno", "externo")
NIVELES_VIP = ("bronce", "plata", "oro", "platino")
ESTADOS_HABITACION = ("disponible", "ocupada", "mantenimiento", "limpieza", "fuera_de_servicio")
ESTADOS_RESERVA = ("pendiente", "confirmada", "check_in", "completada", "cancelada", "expirada")
METODOS_RESERVA = ("internet", "telefono", "presencial")
TIPOS_DETALLE = ("habitacion", "servicio", "paquete", "ajuste")
ESTADOS_FACTURA = ("pagada", "pendiente", "vencida", "cancelada")
METODOS_PAGO = ("efectivo", "tarjeta_credito", "tarjeta_debito", "transferencia", "paypal")
ESTADOS_PAGO = ("completado", "pendiente", "fallido", "reembolsado")

# Display orders used by two reports.
ORDEN_PAGO = ("completado", "pendiente", "reembolsado", "fallido")
ORDEN_VIP = ("platino", "oro", "plata", "bronce")

# The different notions of a "live" booking, one per operator.
RESERVA_BLOQUEA_AGENDA = ("pendiente", "confirmada", "check_in")
RESERVA_POR_LLEGAR = ("pendiente", "confirmada")
RESERVA_CON_INGRESO = ("completada", "check_in", "confirmada")
RESERVA_LIBERADA = ("cancelada", "expirada")
RESERVA_FINAL = ("cancelada", "completada", "expirada")
RESERVA_CONSUME = ("check_in", "confirmada", "completada")
HABITACION_ASIGNABLE = ("disponible", "limpieza")
HABITACION_INACTIVA = ("mantenimiento", "fuera_de_servicio")

# Tax, penalty and loyalty constants.
TASA_IVA = "0.16"
FACTOR_CON_IVA = "1.16"
TASA_PENALIZACION = "0.55"
DIAS_SIN_PENALIZACION = 7
UMBRALES_VIP = ((15, "platino"), (10, "oro"), (5, "plata"))

RESTRICT, CASCADE, SET_NULL = "restrict", "cascade", "set_null"


@dataclass(frozen=True)
class Reference:
    """Foreign key ``column`` of a table; ``on_delete`` says what a parent delete does."""

    column: str
    parent: str
    on_delete: str = RESTRICT


@dataclass(frozen=True)
class Table:
    """Logical table; the first column is its primary key."""

    name: str
    struct: T.StructType
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()
    checks: tuple[tuple[str, str], ...] = ()

    @property
    def key(self) -> str:
        return self.struct.fieldNames()[0]

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.struct if not f.nullable]


_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "str": T.StringType(),
    "date": T.DateType(),
    "bool": T.BooleanType(),
    "ts": T.TimestampNTZType(),
    "money": T.DecimalType(12, 2),
    "qty": T.DecimalType(10, 2),
}


def _struct(spec: str) -> T.StructType:
    """``name type`` pairs; a trailing ``?`` marks a nullable column."""
    pairs = [item.split() for item in spec.split(",")]
    return T.StructType([T.StructField(n, _TYPES[k.rstrip("?")], k.endswith("?")) for n, k in pairs])


def _in(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


_ALL = (
    Table(
        "huesped",
        _struct("id_huesped long, nombres str, apellidos str, fecha_nacimiento date, email str?,"
                "pais_origen str?, sexo str"),
        checks=(("sexo", _in("sexo", SEXOS)),),
    ),
    Table(
        "usuario",
        _struct("id_usuario long, email str, password str, rol str"),
        unique=(("email",),),
        checks=(("rol", _in("rol", ROLES_USUARIO)),),
    ),
    Table(
        "empleado",
        _struct("id_empleado long, nombres str, apellidos str, rol str, telefono str?, salario money,"
                "bono money, activo bool, departamento str"),
        checks=(("salario", "salario >= 0"), ("bono", "bono >= 0")),
    ),
    Table(
        "categoria_habitacion",
        _struct("id_categoria long, nombre str, descripcion str?, precio_base money"),
        unique=(("nombre",),),
        checks=(("precio_base", "precio_base > 0"),),
    ),
    Table(
        "evento_temporada",
        _struct("id_evento long, nombre_evento str, fecha_inicio date, fecha_fin date"),
        checks=(("fechas", "fecha_fin >= fecha_inicio"),),
    ),
    Table(
        "tipo_servicio",
        _struct("id_tipo_servicio long, nombre str, categoria str"),
        unique=(("nombre",),),
        checks=(("categoria", _in("categoria", ORIGENES_SERVICIO)),),
    ),
    Table(
        "huesped_facturador",
        _struct("id_huesped_facturador long, id_huesped long, direccion str, telefono_casa str?,"
                "telefono_celular str, email str, rfc str, procedencia str?, numero_reservas long"),
        unique=(("id_huesped",), ("email",), ("rfc",)),
        references=(Reference("id_huesped", "huesped"),),
    ),
    Table(
        "cliente_vip",
        _struct("id_vip long, id_huesped_facturador long, nivel_vip str, puntos_acumulados long,"
                "contador_reservas long, fecha_registro date"),
        unique=(("id_huesped_facturador",),),
        references=(Reference("id_huesped_facturador", "huesped_facturador", CASCADE),),
        checks=(("nivel_vip", _in("nivel_vip", NIVELES_VIP)),),
    ),
    Table(
        "habitacion",
        _struct("id_habitacion long, id_categoria long, numero_habitacion str, piso int, precio money,"
                "estado str"),
        unique=(("numero_habitacion",),),
        references=(Reference("id_categoria", "categoria_habitacion"),),
        checks=(("precio", "precio > 0"), ("estado", _in("estado", ESTADOS_HABITACION))),
    ),
    Table(
        "bono_empleado",
        _struct("id_bono long, id_empleado long, monto money, fecha_hora ts, motivo str"),
        references=(Reference("id_empleado", "empleado"),),
        checks=(("monto", "monto > 0"),),
    ),
    Table(
        "paquete_promocional",
        _struct("id_paquete_promocional long, id_evento long, descripcion str, precio money,"
                "inicio_validez date, fin_validez date"),
        references=(Reference("id_evento", "evento_temporada"),),
        checks=(("precio", "precio > 0"), ("fechas", "fin_validez >= inicio_validez")),
    ),
    Table(
        "servicio",
        _struct("id_servicio long, id_tipo_servicio long, nombre_servicio str, precio money, disponible bool"),
        references=(Reference("id_tipo_servicio", "tipo_servicio"),),
        checks=(("precio", "precio > 0"),),
    ),
    Table(
        "reservacion",
        _struct("id_reservacion long, id_huesped long, id_huesped_facturador long, id_usuario long,"
                "fecha_inicio date, fecha_salida date, estado str, metodo str, subtotal money, total money"),
        references=(
            Reference("id_huesped", "huesped"),
            Reference("id_huesped_facturador", "huesped_facturador"),
            Reference("id_usuario", "usuario"),
        ),
        checks=(
            ("fechas", "fecha_salida > fecha_inicio"),
            ("estado", _in("estado", ESTADOS_RESERVA)),
            ("metodo", _in("metodo", METODOS_RESERVA)),
            ("montos", "subtotal >= 0 AND total >= 0"),
        ),
    ),
    Table(
        "reservacion_habitacion",
        _struct("id_reservacion_habitacion long, id_reservacion long, id_habitacion long,"
                "tarifa_por_noche money, noches int, cantidad_habitaciones int, subtotal money"),
        references=(Reference("id_reservacion", "reservacion", CASCADE), Reference("id_habitacion", "habitacion")),
        checks=(
            ("tarifa", "tarifa_por_noche > 0"),
            ("noches", "noches > 0"),
            ("cantidad", "cantidad_habitaciones > 0"),
            ("subtotal", "subtotal >= 0"),
        ),
    ),
    Table(
        "estancia",
        _struct("id_estancia long, id_reservacion long, id_empleado long, id_habitacion long,"
                "fecha_hora_checkin ts, fecha_hora_checkout_programado ts, fecha_hora_checkout_real ts?"),
        references=(
            Reference("id_reservacion", "reservacion"),
            Reference("id_empleado", "empleado"),
            Reference("id_habitacion", "habitacion"),
        ),
        checks=(("checkout_programado", "fecha_hora_checkout_programado > fecha_hora_checkin"),),
    ),
    Table(
        "cancelacion",
        _struct("id_cancelacion long, id_reservacion long, id_usuario long, motivo str, penalizacion money,"
                "fecha_cancelacion ts"),
        unique=(("id_reservacion",),),
        references=(Reference("id_reservacion", "reservacion"), Reference("id_usuario", "usuario")),
        checks=(("penalizacion", "penalizacion >= 0"),),
    ),
    Table(
        "cuenta",
        _struct("id_cuenta long, id_reservacion long, fecha_apertura date, fecha_cierre date?,"
                "subtotal money, total money"),
        unique=(("id_reservacion",),),
        references=(Reference("id_reservacion", "reservacion", CASCADE),),
        checks=(
            ("fechas", "fecha_cierre IS NULL OR fecha_cierre >= fecha_apertura"),
            ("montos", "subtotal >= 0 AND total >= 0"),
        ),
    ),
    Table(
        "detalle_cuenta",
        _struct("id_detalle_cuenta long, id_cuenta long, tipo str, descripcion str, cantidad qty,"
                "precio_unitario money, descuento money, impuesto money, importe money"),
        references=(Reference("id_cuenta", "cuenta", CASCADE),),
        checks=(
            ("tipo", _in("tipo", TIPOS_DETALLE)),
            ("montos", "cantidad > 0 AND precio_unitario >= 0 AND descuento >= 0 AND impuesto >= 0"
                       " AND importe >= 0"),
        ),
    ),
    Table(
        "factura",
        _struct("id_factura long, id_cuenta long, id_huesped_facturador long, id_empleado long,"
                "fecha_emision date, subtotal money, impuestos money, total money, estado_factura str"),
        references=(
            Reference("id_cuenta", "cuenta"),
            Reference("id_huesped_facturador", "huesped_facturador"),
            Reference("id_empleado", "empleado"),
        ),
        checks=(
            ("montos", "subtotal >= 0 AND impuestos >= 0 AND total >= 0"),
            ("estado_factura", _in("estado_factura", ESTADOS_FACTURA)),
        ),
    ),
    Table(
        "pago",
        _struct("id_pago long, id_factura long, fecha_pago date, monto money, metodo_pago str,"
                "referencia str?, estado str"),
        references=(Reference("id_factura", "factura"),),
        checks=(
            ("monto", "monto > 0"),
            ("metodo_pago", _in("metodo_pago", METODOS_PAGO)),
            ("estado", _in("estado", ESTADOS_PAGO)),
        ),
    ),
    Table(
        "detalle_paquete_promocional",
        _struct("id_detalle_paquete_promocional long, id_paquete_promocional long, id_servicio long,"
                "cantidad_incluida qty"),
        unique=(("id_paquete_promocional", "id_servicio"),),
        references=(
            Reference("id_paquete_promocional", "paquete_promocional", CASCADE),
            Reference("id_servicio", "servicio"),
        ),
        checks=(("cantidad", "cantidad_incluida > 0"),),
    ),
    Table(
        "consumo_servicio",
        _struct("id_consumo long, id_reservacion long, id_huesped long, id_servicio long, id_empleado long,"
                "cantidad int, precio_unitario money, fecha_hora ts"),
        references=(
            Reference("id_reservacion", "reservacion"),
            Reference("id_huesped", "huesped"),
            Reference("id_servicio", "servicio"),
            Reference("id_empleado", "empleado"),
        ),
        checks=(("cantidad", "cantidad > 0"), ("precio", "precio_unitario > 0")),
    ),
    Table(
        "bitacora_habitacion",
        _struct("id_bitacora long, id_habitacion long, id_empleado long?, id_reservacion long?,"
                "estado_anterior str, estado_nuevo str, fecha_hora ts"),
        references=(
            Reference("id_habitacion", "habitacion", CASCADE),
            Reference("id_empleado", "empleado", SET_NULL),
            Reference("id_reservacion", "reservacion", SET_NULL),
        ),
    ),
    Table(
        "queja",
        _struct("id_queja long, id_huesped long, id_reservacion long, id_empleado long?, receptor str?,"
                "queja str, fecha_queja date, resolucion_queja str?, fecha_resolucion date?, departamento str"),
        references=(
            Reference("id_huesped", "huesped"),
            Reference("id_reservacion", "reservacion"),
            Reference("id_empleado", "empleado", SET_NULL),
        ),
        checks=(("fechas", "fecha_resolucion IS NULL OR fecha_resolucion >= fecha_queja"),),
    ),
    Table(
        "satisfaccion",
        _struct("id_satisfaccion long, id_huesped long, id_reservacion long, id_empleado long?,"
                "departamento str, receptor str?, comentarios str?, fecha_satisfaccion date, calificacion int"),
        references=(
            Reference("id_huesped", "huesped"),
            Reference("id_reservacion", "reservacion"),
            Reference("id_empleado", "empleado", SET_NULL),
        ),
        checks=(("calificacion", "calificacion BETWEEN 1 AND 5"),),
    ),
)

TABLES: dict[str, Table] = {t.name: t for t in _ALL}

# The date most reports of a fact table filter on; stored files are ordered by it.
MAIN_DATE = {
    "bono_empleado": "fecha_hora",
    "reservacion": "fecha_inicio",
    "estancia": "fecha_hora_checkin",
    "cancelacion": "fecha_cancelacion",
    "cuenta": "fecha_apertura",
    "factura": "fecha_emision",
    "pago": "fecha_pago",
    "consumo_servicio": "fecha_hora",
    "bitacora_habitacion": "fecha_hora",
    "queja": "fecha_queja",
    "satisfaccion": "fecha_satisfaccion",
}


def children_of(parent: str) -> list[tuple[Table, Reference]]:
    """Every (table, reference) pair that points at ``parent``."""
    return [(t, r) for t in _ALL for r in t.references if r.parent == parent]
