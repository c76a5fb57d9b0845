"""Staff bonuses, complaints and satisfaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions import full_name, half_open, percentage, ratio, text_key
from innsight.params import Params
from innsight.tables import Hotel


def employee_bonuses(hotel: Hotel, p: Params, ci_ai: bool = False) -> DataFrame:
    """Active employees with last year's bonuses; those without any keep a zero.

    ``ci_ai`` sorts names ignoring case and accents.
    """
    bonuses = (
        hotel.bono_empleado.filter(half_open("fecha_hora", p.last_year))
        .groupBy("id_empleado")
        .agg(F.count("id_bono").alias("bonos"), F.sum("monto").cast("decimal(22,2)").alias("suma"))
    )
    return (
        hotel.empleado.filter(F.col("activo"))
        .join(bonuses, "id_empleado", "left")
        .select(
            "id_empleado",
            full_name().alias("empleado"),
            "departamento",
            "rol",
            "salario",
            F.coalesce("bonos", F.lit(0)).cast("long").alias("num_bonos"),
            F.coalesce("suma", F.lit(0).cast("decimal(22,2)")).alias("bono_acumulado"),
        )
        .orderBy(F.desc("bono_acumulado"), text_key("empleado", ci_ai), "id_empleado")
    )


def complaints_by_department(hotel: Hotel, p: Params) -> DataFrame:
    """Last year's complaints, how many were solved and how fast."""
    solved = F.col("fecha_resolucion").isNotNull()
    return (
        hotel.queja.filter(half_open("fecha_queja", p.last_year))
        .groupBy("departamento")
        .agg(
            F.count("*").alias("quejas"),
            F.count_if(solved).alias("resueltas"),
            percentage(F.count_if(solved), F.count("*")).alias("pct_resueltas"),
            ratio(F.sum(F.datediff("fecha_resolucion", "fecha_queja")), F.count_if(solved)).alias(
                "dias_resolucion_promedio"
            ),
        )
        .orderBy(F.desc("quejas"), "departamento")
    )


def satisfaction_ranking(hotel: Hotel, p: Params) -> DataFrame:
    """Departments by last year's mean rating; ratings of 4 and 5 count as satisfied."""
    happy = F.col("calificacion") >= 4
    return (
        hotel.satisfaccion.filter(half_open("fecha_satisfaccion", p.last_year))
        .groupBy("departamento")
        .agg(
            F.count("*").alias("encuestas"),
            ratio(F.sum("calificacion"), F.count("*")).alias("rating_promedio"),
            F.count_if(happy).alias("satisfechos"),
            percentage(F.count_if(happy), F.count("*")).alias("pct_satisfechos"),
        )
        .orderBy(F.desc("rating_promedio"), F.desc("encuestas"), "departamento")
    )


def employee_public(hotel: Hotel) -> DataFrame:
    """Employees without salary and bonus."""
    return hotel.empleado.select(
        "id_empleado", "nombres", "apellidos", "rol", "telefono", "departamento", "activo"
    )
