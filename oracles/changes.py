"""DuckDB text of the batch appliers: request tables, intermediate steps, results."""

from oracles.tables import HOY, LINE_ID

AHORA = "TIMESTAMP '2001-06-15 11:00:00'"

STEPS: dict[str, str] = {
    # booking requests, one per order
    "peticion": f"""SELECT o_orderkey AS request_id, o_orderdate AS arrival, o_custkey AS id_huesped,
        CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 1 ELSE o_custkey END AS id_huesped_facturador,
        o_orderkey % 10 AS id_usuario,
        {HOY} + CAST((13 * o_orderkey + o_custkey) % 120 AS INTEGER) AS ini,
        {HOY} + CAST((13 * o_orderkey + o_custkey) % 120 + o_orderkey % 6 AS INTEGER) AS fin,
        ['internet','telefono','presencial'][o_orderkey % 3 + 1] AS metodo,
        (31 * o_orderkey + o_custkey) % (SELECT count(*) FROM part) AS id_habitacion FROM orders""",
    "agenda": """SELECT rh.id_habitacion, r.id_reservacion, r.fecha_inicio AS a, r.fecha_salida AS b
        FROM reservacion r JOIN reservacion_habitacion rh USING (id_reservacion)
        WHERE r.estado NOT IN ('cancelada', 'expirada')""",
    "ocupado_antes": """SELECT DISTINCT p.request_id FROM peticion p JOIN agenda q USING (id_habitacion)
        WHERE q.a < p.fin AND q.b > p.ini""",
    "juzgada": """SELECT p.*, h.precio,
        CASE WHEN p.fin <= p.ini THEN 'invalid_range' WHEN h.id_habitacion IS NULL THEN 'unknown_room' END AS absurda,
        CASE WHEN h.estado IN ('mantenimiento', 'fuera_de_servicio') THEN 0
             WHEN p.request_id IN (SELECT request_id FROM ocupado_antes) THEN 0 ELSE 1 END AS libre
        FROM peticion p LEFT JOIN habitacion h USING (id_habitacion)""",
    "previa": """SELECT j.*, CASE WHEN absurda IS NOT NULL THEN absurda WHEN libre = 0 THEN 'room_unavailable'
        WHEN id_huesped NOT IN (SELECT id_huesped FROM huesped) THEN 'unknown_guest'
        WHEN id_huesped_facturador NOT IN (SELECT id_huesped_facturador FROM huesped_facturador) THEN 'unknown_payer'
        WHEN id_usuario NOT IN (SELECT id_usuario FROM usuario) THEN 'unknown_user' END AS motivo FROM juzgada j""",
    "turno": """SELECT *, row_number() OVER (PARTITION BY id_habitacion ORDER BY arrival, request_id) AS n
        FROM previa WHERE motivo IS NULL""",
    # one request per room and step, in order of arrival, against the ranges already granted
    "reparto": """SELECT id_habitacion, CAST(1 AS BIGINT) AS n, request_id, true AS dada,
          [{'a': ini, 'b': fin}] AS rangos FROM turno WHERE n = 1
        UNION ALL
        SELECT t.id_habitacion, t.n, t.request_id,
          len(list_filter(p.rangos, lambda x: x.a < t.fin AND x.b > t.ini)) = 0,
          CASE WHEN len(list_filter(p.rangos, lambda x: x.a < t.fin AND x.b > t.ini)) = 0
               THEN list_append(p.rangos, {'a': t.ini, 'b': t.fin}) ELSE p.rangos END
        FROM reparto p JOIN turno t ON t.id_habitacion = p.id_habitacion AND t.n = p.n + 1""",
    "concedida": """SELECT t.*, CAST(t.fin - t.ini AS INTEGER) AS noches,
        CAST(t.precio * (t.fin - t.ini) AS DECIMAL(12,2)) AS sub
        FROM turno t JOIN (SELECT request_id FROM reparto WHERE dada) USING (request_id)""",
    "nueva": """SELECT id_huesped, id_huesped_facturador, id_usuario, ini AS fecha_inicio, fin AS fecha_salida,
        'confirmada' AS estado, metodo, sub AS subtotal, CAST(round(sub * 1.16, 2) AS DECIMAL(12,2)) AS total
        FROM concedida""",
    "pedido": f"""SELECT {LINE_ID} AS request_id, l_orderkey AS id_reservacion, l_partkey AS id_servicio,
        l_suppkey AS id_empleado, CAST(floor(l_quantity) - 5 AS INTEGER) AS cantidad
        FROM lineitem WHERE l_linenumber > 2""",
    "pedido_juzgado": """SELECT p.*, s.nombre_servicio, s.precio, r.id_huesped,
        CASE WHEN p.cantidad <= 0 THEN 'invalid_quantity' WHEN s.id_servicio IS NULL THEN 'unknown_service'
             WHEN NOT s.disponible THEN 'service_unavailable' WHEN r.id_reservacion IS NULL THEN 'unknown_booking'
             WHEN r.estado NOT IN ('check_in', 'confirmada', 'completada') THEN 'booking_not_active'
             WHEN p.id_empleado NOT IN (SELECT id_empleado FROM empleado) THEN 'unknown_employee' END AS motivo
        FROM pedido p LEFT JOIN servicio s USING (id_servicio) LEFT JOIN reservacion r USING (id_reservacion)""",
    "salida": """SELECT r.id_reservacion, r.id_reservacion % 10 AS id_empleado, r.id_huesped_facturador,
        c.id_cuenta, c.subtotal, c.total,
        CASE WHEN c.id_cuenta IS NULL THEN 'no_account'
             WHEN c.fecha_cierre IS NULL AND c.fecha_apertura > DATE '2001-06-15' THEN 'account_opens_later'
             WHEN r.id_reservacion % 10 NOT IN (SELECT id_empleado FROM empleado) THEN 'unknown_employee'
             WHEN c.total <= 0 THEN 'nothing_to_pay' END AS motivo
        FROM reservacion r LEFT JOIN cuenta c USING (id_reservacion)""",
    # those that leave under strict rules, by the earlier of two requests
    "salida_estricta": """SELECT s.*, coalesce(motivo, CASE WHEN s.id_reservacion NOT IN (SELECT id_reservacion FROM estancia
        WHERE fecha_hora_checkout_real IS NULL) THEN 'no_open_stay' END) AS pega FROM salida s""",
    "salida_ok": "SELECT * FROM salida WHERE motivo IS NULL",
    "anulable": """SELECT r.*, CASE WHEN r.estado IN ('cancelada', 'completada', 'expirada') THEN 'final_state'
        WHEN r.id_reservacion IN (SELECT id_reservacion FROM cancelacion) THEN 'already_cancelled'
        WHEN r.id_reservacion % 10 NOT IN (SELECT id_usuario FROM usuario) THEN 'unknown_user' END AS rechazo
        FROM reservacion r""",
    "anulada": "SELECT * FROM anulable WHERE rechazo IS NULL",
    "llegada": """SELECT r.id_reservacion, r.fecha_inicio, r.fecha_salida, q.id_habitacion, h.estado AS estado_cuarto,
        CASE WHEN h.estado NOT IN ('disponible', 'limpieza') THEN 'room_not_assignable'
             WHEN h.estado IS NULL THEN 'unknown_room'
             WHEN r.id_reservacion % 10 NOT IN (SELECT id_empleado FROM empleado) THEN 'unknown_employee'
             WHEN r.fecha_salida + INTERVAL 12 HOUR <= """ + AHORA + """ THEN 'checkout_not_after_checkin' END AS motivo
        FROM reservacion r JOIN (SELECT id_reservacion, min(id_habitacion) AS id_habitacion
             FROM reservacion_habitacion GROUP BY 1) q USING (id_reservacion)
        LEFT JOIN habitacion h ON h.id_habitacion = q.id_habitacion
        WHERE r.estado IN ('pendiente', 'confirmada')""",
    "ingreso": """SELECT *, row_number() OVER (PARTITION BY id_habitacion ORDER BY fecha_inicio, id_reservacion) AS n
        FROM llegada WHERE motivo IS NULL""",
    "aumento": """SELECT id_huesped_facturador, count(*) AS n, CAST(sum(floor(total / 100)) AS BIGINT) AS p
        FROM reservacion GROUP BY 1""",
    "aumento_nuevo": """SELECT id_huesped_facturador, count(*) AS n, CAST(sum(floor(total / 100)) AS BIGINT) AS p
        FROM nueva GROUP BY 1""",
    "historia": """SELECT f.id_huesped_facturador, count(r.id_reservacion) AS n, coalesce(sum(r.total), 0) AS gasto
        FROM huesped_facturador f LEFT JOIN reservacion r
          ON r.id_huesped_facturador = f.id_huesped_facturador AND r.estado NOT IN ('cancelada', 'expirada')
        GROUP BY 1""",
    "ascenso": """SELECT r.id_reservacion, r.fecha_inicio, r.fecha_salida, v.nivel_vip, x.precio_base,
        CASE WHEN v.nivel_vip IS NULL OR x.precio_base IS NULL THEN 'not_vip'
             WHEN v.nivel_vip NOT IN ('oro', 'platino') THEN 'level_too_low' END AS motivo_rechazo
        FROM reservacion r LEFT JOIN cliente_vip v ON v.id_huesped_facturador = r.id_huesped_facturador
        LEFT JOIN (SELECT id_reservacion, min(precio_base) AS precio_base FROM reservacion_habitacion
             JOIN habitacion USING (id_habitacion) JOIN categoria_habitacion USING (id_categoria) GROUP BY 1) x
          ON x.id_reservacion = r.id_reservacion""",
    "cuarto_ascenso": """SELECT h.id_habitacion, c.precio_base FROM habitacion h
        JOIN categoria_habitacion c USING (id_categoria) WHERE h.estado IN ('disponible', 'limpieza')""",
    "elegido": """SELECT a.id_reservacion, arg_min(k.id_habitacion, (k.precio_base, k.id_habitacion)) AS nueva_hab
        FROM ascenso a JOIN cuarto_ascenso k ON k.precio_base > a.precio_base
        WHERE a.motivo_rechazo IS NULL AND NOT EXISTS (SELECT 1 FROM agenda q
          WHERE q.id_habitacion = k.id_habitacion AND q.id_reservacion <> a.id_reservacion
            AND q.a < a.fecha_salida AND q.b > a.fecha_inicio) GROUP BY 1""",
    # upgrades one call after the other: each with the dearer rooms no other booking holds for good, in order,
    # and those held by bookings that ask themselves
    "fila": """SELECT a.id_reservacion AS i, a.fecha_inicio AS a, a.fecha_salida AS b, a.precio_base AS p,
        r.estado NOT IN ('cancelada', 'expirada') AS viva,
        row_number() OVER (ORDER BY a.fecha_inicio, a.id_reservacion) AS n
        FROM ascenso a JOIN reservacion r USING (id_reservacion) WHERE a.motivo_rechazo IS NULL""",
    "estorbo": """SELECT f.i, q.id_habitacion AS hab, q.id_reservacion AS j,
        q.id_reservacion IN (SELECT i FROM fila) AS pide
        FROM fila f JOIN agenda q ON q.a < f.b AND q.b > f.a AND q.id_reservacion <> f.i""",
    "opcion": """SELECT f.i, list(k.id_habitacion ORDER BY k.precio_base, k.id_habitacion) AS cuartos
        FROM fila f JOIN cuarto_ascenso k ON k.precio_base > f.p
        LEFT JOIN (SELECT DISTINCT i, hab FROM estorbo WHERE NOT pide) e ON e.i = f.i AND e.hab = k.id_habitacion
        WHERE e.i IS NULL GROUP BY 1""",
    "retenida": """SELECT i, list({'hab': hab, 'j': j}) AS lista FROM estorbo WHERE pide GROUP BY 1""",
    "vecindad": "SELECT f.i, count(*) AS k FROM fila f JOIN fila g ON g.a < f.b AND g.b > f.a GROUP BY 1",
    # overlapping requests take or hold one room each of those at most, so no more can be needed
    "solicitud": """SELECT f.*, coalesce(o.cuartos, [])[1:w.k + len(coalesce(e.lista, [])) + 1] AS cuartos,
        coalesce(e.lista, []) AS lista
        FROM fila f JOIN vecindad w USING (i) LEFT JOIN opcion o USING (i) LEFT JOIN retenida e USING (i)""",
    "mudanza": """SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(res BIGINT, hab BIGINT, a DATE, b DATE, viva BOOLEAN)[]) AS hechas
        UNION ALL
        SELECT y.n, list_append(y.hechas, {'res': y.i,
          'hab': list_filter(y.cuartos, lambda c: NOT list_contains(y.ocupadas, c))[1], 'a': y.a, 'b': y.b, 'viva': y.viva})
        FROM (SELECT z.*, list_concat(z.tomadas, list_transform(
              list_filter(z.lista, lambda x: NOT list_contains(z.movidas, x.j)), lambda x: x.hab)) AS ocupadas
          FROM (SELECT s.*, m.hechas,
              list_transform(list_filter(m.hechas, lambda h: h.viva AND h.a < s.b AND h.b > s.a), lambda h: h.hab) AS tomadas,
              list_transform(list_filter(m.hechas, lambda h: h.hab IS NOT NULL), lambda h: h.res) AS movidas
            FROM mudanza m JOIN solicitud s ON s.n = m.n + 1) z) y""",
    "cambio": """SELECT *, lag(estado) OVER (PARTITION BY id_habitacion ORDER BY fecha_hora, request_id) AS antes
        FROM suceso""",
}

_LEVEL = "CASE WHEN {n} >= {a} THEN 'platino' WHEN {n} >= {b} THEN 'oro' WHEN {n} >= {c} THEN 'plata' ELSE {e} END"


def _vips(added: str, a: int, b: int, c: int) -> str:
    level = _LEVEL.format(n="v.contador_reservas + x.n", a=a, b=b, c=c, e="v.nivel_vip")
    return f"""SELECT v.* REPLACE ({level} AS nivel_vip, v.puntos_acumulados + x.p AS puntos_acumulados,
        v.contador_reservas + x.n AS contador_reservas) FROM cliente_vip v JOIN {added} x USING (id_huesped_facturador)"""


CHANGES: dict[str, str] = {
    "p_a_book_bookings": "SELECT * FROM nueva",
    "p_a_book_rooms": """SELECT id_habitacion, precio AS tarifa_por_noche, noches, 1 AS cantidad_habitaciones,
        sub AS subtotal FROM concedida""",
    "p_a_book_vips": _vips("aumento_nuevo", 15, 10, 5),
    "p_a_book_rejected": """SELECT request_id, motivo AS motivo_rechazo FROM previa WHERE motivo IS NOT NULL
        UNION ALL SELECT request_id, 'taken_in_batch' FROM reparto WHERE NOT dada""",
    "p_b_state_log": """SELECT c.id_habitacion, c.request_id % 10 AS id_empleado, CAST(NULL AS BIGINT) AS id_reservacion,
        coalesce(c.antes, h.estado) AS estado_anterior, c.estado AS estado_nuevo, c.fecha_hora
        FROM cambio c JOIN habitacion h USING (id_habitacion) WHERE coalesce(c.antes, h.estado) <> c.estado""",
    "p_b_state_rooms": """SELECT h.* REPLACE (u.estado AS estado) FROM habitacion h
        JOIN (SELECT id_habitacion, arg_max(estado, (fecha_hora, request_id)) AS estado FROM suceso GROUP BY 1) u
        USING (id_habitacion) WHERE u.estado <> h.estado""",
    "p_c_checkout_invoices": f"""SELECT id_cuenta, id_huesped_facturador, id_empleado, {HOY} AS fecha_emision, subtotal,
        CAST(round(0.16 * subtotal, 2) AS DECIMAL(12,2)) AS impuestos, total, 'pagada' AS estado_factura
        FROM salida_ok""",
    "p_c_checkout_payments": f"""SELECT {HOY} AS fecha_pago, total AS monto, 'efectivo' AS metodo_pago,
        'completado' AS estado FROM salida_ok""",
    "p_c_checkout_stays": f"""SELECT e.* REPLACE ({AHORA} AS fecha_hora_checkout_real) FROM estancia e
        WHERE fecha_hora_checkout_real IS NULL AND id_reservacion IN (SELECT id_reservacion FROM salida_ok)""",
    "p_c_checkout_accounts": f"""SELECT c.* REPLACE ({HOY} AS fecha_cierre) FROM cuenta c
        WHERE fecha_cierre IS NULL AND id_reservacion IN (SELECT id_reservacion FROM salida_ok)""",
    "p_c_checkout_bookings": """SELECT r.* REPLACE ('completada' AS estado) FROM reservacion r
        WHERE id_reservacion IN (SELECT id_reservacion FROM salida_ok)""",
    "p_c_checkout_rooms": """SELECT h.* REPLACE ('limpieza' AS estado) FROM habitacion h WHERE estado = 'ocupada'
        AND id_habitacion IN (SELECT id_habitacion FROM estancia WHERE fecha_hora_checkout_real IS NULL
          AND id_reservacion IN (SELECT id_reservacion FROM salida_ok))""",
    "p_c_checkout_log": f"""SELECT id_habitacion, CAST(NULL AS BIGINT) AS id_empleado,
        CAST(NULL AS BIGINT) AS id_reservacion, 'ocupada' AS estado_anterior, 'limpieza' AS estado_nuevo,
        {AHORA} AS fecha_hora FROM habitacion WHERE estado = 'ocupada'
        AND id_habitacion IN (SELECT id_habitacion FROM estancia WHERE fecha_hora_checkout_real IS NULL
          AND id_reservacion IN (SELECT id_reservacion FROM salida_ok))""",
    "p_c_checkout_rejected": """SELECT id_reservacion AS request_id, motivo AS motivo_rechazo FROM salida
        WHERE motivo IS NOT NULL""",
    "p_c_checkout_strict_invoices": f"""SELECT id_cuenta, id_huesped_facturador, id_empleado, {HOY} AS fecha_emision,
        subtotal, CAST(round(0.16 * subtotal, 2) AS DECIMAL(12,2)) AS impuestos, total, 'pagada' AS estado_factura
        FROM salida_estricta WHERE pega IS NULL""",
    "p_c_checkout_strict_rejected": """SELECT id_reservacion AS request_id, pega AS motivo_rechazo FROM salida_estricta
        WHERE pega IS NOT NULL
        UNION ALL SELECT -id_reservacion - 1, coalesce(pega, 'duplicate_request') FROM salida_estricta""",
    "p_d_check_availability": """SELECT request_id, CASE WHEN absurda IS NULL THEN libre END AS disponible,
        absurda AS motivo_rechazo FROM juzgada""",
    "p_e_service_consumption": f"""SELECT id_reservacion, id_huesped, id_servicio, id_empleado, cantidad,
        precio AS precio_unitario, {AHORA} AS fecha_hora FROM pedido_juzgado WHERE motivo IS NULL""",
    "p_e_service_lines": """SELECT c.id_cuenta, 'servicio' AS tipo, 'Servicio: ' || nombre_servicio AS descripcion,
        CAST(cantidad AS DECIMAL(10,2)) AS cantidad, precio AS precio_unitario, CAST(0 AS DECIMAL(12,2)) AS descuento,
        CAST(round(cantidad * precio * 0.16, 2) AS DECIMAL(12,2)) AS impuesto,
        CAST(round(cantidad * precio * 1.16, 2) AS DECIMAL(12,2)) AS importe
        FROM pedido_juzgado p JOIN cuenta c USING (id_reservacion) WHERE motivo IS NULL""",
    "p_e_service_rejected": """SELECT request_id, motivo AS motivo_rechazo FROM pedido_juzgado
        WHERE motivo IS NOT NULL""",
    "p_f_cancel_rows": f"""SELECT a.id_reservacion, a.id_reservacion % 10 AS id_usuario,
        'Motivo ' || (a.id_reservacion % 8) AS motivo,
        CAST(CASE WHEN a.fecha_inicio - {HOY} < 7
             THEN round(coalesce((SELECT CAST(sum(subtotal) AS DECIMAL(22,2)) FROM reservacion_habitacion rh
                  WHERE rh.id_reservacion = a.id_reservacion), 0) * 0.55, 2) ELSE 0 END AS DECIMAL(22,2)) AS penalizacion,
        {AHORA} AS fecha_cancelacion FROM anulada a""",
    "p_f_cancel_rejected": """SELECT id_reservacion AS request_id, rechazo AS motivo_rechazo FROM anulable
        WHERE rechazo IS NOT NULL""",
    "t_j_cancel_bookings": "SELECT * EXCLUDE (rechazo) REPLACE ('cancelada' AS estado) FROM anulada",
    "t_j_cancel_rooms": """SELECT h.* REPLACE ('disponible' AS estado) FROM habitacion h WHERE estado = 'ocupada'
        AND id_habitacion IN (SELECT id_habitacion FROM reservacion_habitacion
          WHERE id_reservacion IN (SELECT id_reservacion FROM anulada))""",
    "t_j_cancel_rooms_strict": """SELECT h.* REPLACE ('disponible' AS estado) FROM habitacion h WHERE estado = 'ocupada'
        AND id_habitacion IN (SELECT id_habitacion FROM reservacion_habitacion
          WHERE id_reservacion IN (SELECT id_reservacion FROM anulada))
        AND id_habitacion NOT IN (SELECT id_habitacion FROM estancia WHERE fecha_hora_checkout_real IS NULL
          AND id_reservacion NOT IN (SELECT id_reservacion FROM anulada))""",
    "p_g_recompute_vip": f"""SELECT x.id_huesped_facturador,
        {_LEVEL.format(n='x.n', a=15, b=10, c=5, e="'bronce'")} AS nivel_vip,
        CAST(floor(x.gasto / 100) AS BIGINT) AS puntos_acumulados, x.n AS contador_reservas,
        coalesce(v.fecha_registro, {HOY}) AS fecha_registro
        FROM historia x LEFT JOIN cliente_vip v USING (id_huesped_facturador)""",
    "p_j_propose_upgrades": """SELECT a.id_reservacion AS request_id, a.id_reservacion, a.fecha_inicio, a.fecha_salida,
        e.nueva_hab AS id_habitacion_nueva, a.motivo_rechazo FROM ascenso a LEFT JOIN elegido e USING (id_reservacion)""",
    "p_j_upgrade_rows": """SELECT rh.* REPLACE (x.h.hab AS id_habitacion) FROM reservacion_habitacion rh
        JOIN (SELECT unnest(hechas) AS h FROM (SELECT hechas FROM mudanza ORDER BY n DESC LIMIT 1)) x
          ON x.h.res = rh.id_reservacion WHERE x.h.hab IS NOT NULL""",
    "p_j_upgrade_rejected": """SELECT id_reservacion AS request_id, motivo_rechazo FROM ascenso
        WHERE motivo_rechazo IS NOT NULL""",
    "t_a_checkin_stays": f"""SELECT id_reservacion, id_reservacion % 10 AS id_empleado, id_habitacion,
        {AHORA} AS fecha_hora_checkin, fecha_salida + INTERVAL 12 HOUR AS fecha_hora_checkout_programado,
        CAST(NULL AS TIMESTAMP) AS fecha_hora_checkout_real FROM ingreso WHERE n = 1""",
    "t_a_checkin_rooms": """SELECT h.* REPLACE ('ocupada' AS estado) FROM habitacion h
        WHERE id_habitacion IN (SELECT id_habitacion FROM ingreso)""",
    "t_g_checkin_rejected": """SELECT id_reservacion AS request_id, motivo AS motivo_rechazo FROM llegada
        WHERE motivo IS NOT NULL UNION ALL SELECT id_reservacion, 'room_not_assignable' FROM ingreso WHERE n > 1""",
    "t_c_room_state_log": """SELECT request_id, id_habitacion, antes AS estado_anterior, estado AS estado_nuevo,
        fecha_hora FROM cambio WHERE antes <> estado""",
    "t_d_enrol_vip": f"""SELECT id_huesped_facturador, 'bronce' AS nivel_vip, CAST(0 AS BIGINT) AS puntos_acumulados,
        CAST(0 AS BIGINT) AS contador_reservas, {HOY} AS fecha_registro FROM huesped_facturador
        WHERE id_huesped_facturador NOT IN (SELECT id_huesped_facturador FROM cliente_vip)""",
    "t_e_count_bookings_payers": """SELECT f.* REPLACE (f.numero_reservas + x.n AS numero_reservas)
        FROM huesped_facturador f JOIN aumento x USING (id_huesped_facturador)""",
    "t_e_count_bookings_vips": _vips("aumento", 15, 10, 5),
    "t_e_count_bookings_legacy": _vips("aumento", 14, 9, 4),
    "t_f_booking_dates": """SELECT request_id, 'invalid_range' AS motivo_rechazo FROM peticion WHERE fin <= ini""",
    "t_h_expire_bookings": f"""SELECT r.* REPLACE ('expirada' AS estado) FROM reservacion r
        WHERE estado IN ('pendiente', 'confirmada') AND fecha_inicio < {HOY}
          AND id_reservacion NOT IN (SELECT id_reservacion FROM estancia)""",
    "t_i_correction_rejected": """SELECT id_consumo, CAST(precio_unitario - 1000 AS DECIMAL(12,2)) AS precio_unitario,
        'invalid_price' AS motivo_rechazo FROM consumo_servicio WHERE precio_unitario <= 1000""",
    "t_i_service_prices": "SELECT * FROM servicio WHERE NOT precio <= 0",
    "t_i_consumption_rejected": """SELECT request_id, 'invalid_quantity' AS motivo_rechazo FROM pedido
        WHERE cantidad <= 0""",
    "src_read_stored": f"""SELECT * FROM reservacion
        WHERE fecha_inicio BETWEEN CAST({HOY} - INTERVAL 1 YEAR AS DATE) AND {HOY}""",
    "snk1_append": "SELECT * FROM factura",
    "snk2_update": f"""SELECT r.* REPLACE (CASE WHEN estado IN ('pendiente', 'confirmada') AND fecha_inicio < {HOY}
          AND id_reservacion NOT IN (SELECT id_reservacion FROM estancia) THEN 'expirada' ELSE estado END AS estado)
        FROM reservacion r""",
    "snk3_insert_if_absent": f"""SELECT * FROM cliente_vip UNION ALL
        SELECT id_huesped_facturador, id_huesped_facturador, 'bronce', 0, 0, {HOY} FROM huesped_facturador
        WHERE id_huesped_facturador NOT IN (SELECT id_vip FROM cliente_vip)""",
    "s1_room_state_log": """SELECT request_id, id_habitacion, antes AS estado_anterior, estado AS estado_nuevo,
        fecha_hora FROM cambio WHERE antes <> estado""",
    "s2_booking_counters": f"""SELECT id_huesped_facturador, n AS contador_reservas, p AS puntos_acumulados,
        {_LEVEL.format(n='n', a=15, b=10, c=5, e="'bronce'")} AS nivel_vip FROM aumento""",
    "s3_consumption_validator": """SELECT request_id, CASE WHEN cantidad <= 0 THEN 'invalid_quantity' END
        AS motivo_rechazo FROM pedido""",
    "s4_consumption_windows": """WITH tramo AS (SELECT *, TIMESTAMP '1970-01-01' + INTERVAL 30 DAY
            * CAST(floor(date_diff('day', DATE '1970-01-01', fecha_hora) / 30) AS INTEGER) AS desde
          FROM consumo_servicio)
        SELECT desde, desde + INTERVAL 30 DAY AS hasta, id_servicio, count(*) AS veces_consumido,
        CAST(sum(cantidad) AS BIGINT) AS unidades, CAST(sum(cantidad * precio_unitario) AS DECIMAL(22,2)) AS importe_total
        FROM tramo GROUP BY 1, 2, 3""",
}
