"""Keys, references and row rules checked over whole tables; guarded deletes.

Counts are condensed per key before any shuffle or join, so a value that holds
a large share of a table travels as one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.schemas import CASCADE, RESTRICT, SET_NULL, TABLES, Table, children_of
from innsight.session import checkpoint
from innsight.tables import Hotel


def _union(parts: list[DataFrame]) -> DataFrame:
    """Union by halves: each part is analysed a logarithmic number of times."""
    if len(parts) == 1:
        return parts[0]
    middle = len(parts) // 2
    return _union(parts[:middle]).unionByName(_union(parts[middle:]))


def _per_constraint(values: DataFrame, constraints: DataFrame) -> DataFrame:
    """Repeated and missing values per constraint; ``values`` holds (restriccion, falta, n)."""
    missing, repeated = F.col("falta"), ~F.col("falta") & (F.col("n") > 1)
    found = values.groupBy("restriccion").agg(
        F.count_if(repeated).alias("claves_repetidas"),
        F.sum(F.when(repeated, F.col("n"))).alias("filas_repetidas"),
        F.sum(F.when(missing, F.col("n"))).alias("filas_nulas"),
    )
    zero = F.lit(0).cast("long")
    return constraints.join(found, "restriccion", "left").select(
        "tabla",
        "columnas",
        *[F.coalesce(c, zero).alias(c) for c in ("claves_repetidas", "filas_repetidas")],
        F.when(F.col("nulo_es_error"), F.coalesce("filas_nulas", zero)).otherwise(zero).alias("filas_nulas"),
    )


def _key_check(hotel: Hotel, keys: list[tuple[str, tuple[str, ...]]], null_is_error: bool) -> DataFrame:
    """All keys of one type in one pass: their values meet in a single pre-combined grouping.

    Keys of one integer column, which every large table has, are grouped as eight
    bytes; text and keys of several columns are grouped as text.
    """
    numbers, texts, listed = [], [], []
    for number, (table, columns) in enumerate(keys):
        listed.append((number, table, ", ".join(columns), null_is_error))
        kinds = {f.name: f.dataType for f in TABLES[table].struct}
        if len(columns) == 1:
            whole = isinstance(kinds[columns[0]], T.IntegralType)
            value = F.col(columns[0]).cast("long" if whole else "string")
        else:
            whole = False
            # A length in front of each part keeps ("a", "bc") and ("ab", "c") apart.
            text = [F.col(c).cast("string") for c in columns]
            value = F.concat(*[piece for t in text for piece in (F.length(t).cast("string"), F.lit(":"), t)])
        rows = hotel.table(table).select(F.lit(number).alias("restriccion"), value.alias("valor"))
        (numbers if whole else texts).append(rows)
    constraints = hotel.spark.createDataFrame(listed, "restriccion int, tabla string, columnas string, nulo_es_error boolean")
    counted = [
        _union(rows)
        .groupBy("restriccion", "valor")
        .agg(F.count("*").alias("n"))
        .select("restriccion", F.col("valor").isNull().alias("falta"), "n")
        for rows in (numbers, texts)
        if rows
    ]
    return _per_constraint(_union(counted), constraints)


def primary_keys(hotel: Hotel) -> DataFrame:
    """One row per table: repeated and missing primary keys."""
    return _key_check(hotel, [(n, (TABLES[n].key,)) for n in hotel.names()], True)


def unique_keys(hotel: Hotel) -> DataFrame:
    """One row per unique constraint; NULLs never clash."""
    return _key_check(hotel, [(n, cols) for n in hotel.names() for cols in TABLES[n].unique], False)


def foreign_keys(hotel: Hotel) -> DataFrame:
    """One row per reference: orphaned values and the rows that hold them.

    Every table is read once for all its references and once as a parent. Held
    values and parent keys meet in one grouping by (parent, value) that counts
    the rows of each reference side by side: one shuffle, combined inside each
    task first, and no join of large sides. NULL refers to nothing.
    """
    parents = sorted({ref.parent for name in hotel.names() for ref in TABLES[name].references})
    asked = dict.fromkeys(parents, 0)  # references to a parent so far
    rows, listed = [], []
    for name in hotel.names():
        pairs = []
        for ref in TABLES[name].references:
            place = asked[ref.parent]
            asked[ref.parent] += 1
            code = parents.index(ref.parent)
            pairs.append(_met(code, place, ref.column))
            listed.append((code, place, name, ref.column, ref.parent))
        if pairs:
            rows.append(hotel.table(name).select(F.explode(F.array(*pairs)).alias("x")).select("x.*"))
    rows += [hotel.table(p).select(_met(code, -1, TABLES[p].key).alias("x")).select("x.*") for code, p in enumerate(parents)]

    places = range(max(asked.values()))
    orphans = (
        _union(rows)
        .filter(F.col("valor").isNotNull())
        .groupBy("padre", "valor")
        .agg(
            F.max(F.col("lugar") == -1).alias("existe"),
            *[F.count_if(F.col("lugar") == i).alias(f"n{i}") for i in places],
        )
        .filter(~F.col("existe"))
        .groupBy("padre")
        .agg(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("lugar"),
                        F.count_if(F.col(f"n{i}") > 0).alias("claves"),
                        F.sum(f"n{i}").alias("filas"),
                    )
                    for i in places
                ]
            ).alias("x")
        )
        .select("padre", F.explode("x").alias("x"))
        .select("padre", "x.*")
    )
    references = hotel.spark.createDataFrame(listed, "codigo int, lugar int, tabla string, columna string, nombre string")
    zero = F.lit(0).cast("long")
    return references.join(orphans.withColumnRenamed("padre", "codigo"), ["codigo", "lugar"], "left").select(
        "tabla",
        "columna",
        F.col("nombre").alias("padre"),
        F.coalesce("claves", zero).alias("claves_huerfanas"),
        F.coalesce("filas", zero).alias("filas_huerfanas"),
    )


def _met(code: int, place: int, column: str) -> Column:
    """A value of parent ``code``, held by its reference number ``place`` or, at -1, by the parent itself."""
    return F.struct(F.lit(code).alias("padre"), F.lit(place).alias("lugar"), F.col(column).alias("valor"))


def _rules(table: Table) -> list[tuple[str, str, str]]:
    """(kind, name, condition of a broken row); a check that evaluates to NULL passes."""
    checks = [("regla", name, f"NOT coalesce({rule}, true)") for name, rule in table.checks]
    return checks + [("obligatorio", c, f"{c} IS NULL") for c in table.required]


def row_rules(hotel: Hotel, only: str | None = None) -> DataFrame:
    """Violations per row rule and per mandatory column, one scan for all rules of a table.

    ``only`` keeps one kind: ``regla`` or ``obligatorio``.
    """
    parts = []
    for name in hotel.names():
        counts = ", ".join(
            f"struct('{kind}' AS clase, '{rule}' AS regla, count_if({broken}) AS filas)"
            for kind, rule, broken in _rules(TABLES[name])
            if only in (None, kind)
        )
        if counts:
            found = hotel.table(name).selectExpr(f"inline(array({counts}))")
            parts.append(found.select(F.lit(name).alias("tabla"), "*"))
    return _union(parts)


def violating_rows(hotel: Hotel, name: str) -> DataFrame:
    """Rows of one table that break a rule, with the names of all rules they break."""
    broken = F.array_compact(
        F.array(*[F.when(F.expr(bad), F.lit(f"{kind}:{rule}")) for kind, rule, bad in _rules(TABLES[name])])
    )
    return hotel.table(name).withColumn("reglas_rotas", broken).filter(F.size("reglas_rotas") > 0)


@dataclass(frozen=True)
class Deletion:
    """Keys removed per table, rows whose reference was cleared, keys that may not go."""

    deleted: dict[str, DataFrame] = field(default_factory=dict)
    cleared: dict[str, DataFrame] = field(default_factory=dict)
    rejected: DataFrame | None = None

    def remaining(self, hotel: Hotel) -> Hotel:
        """The hotel after the deletion."""
        changed = {}
        for name, rows in self.cleared.items():
            key = TABLES[name].key
            changed[name] = hotel.table(name).join(rows.select(key), key, "left_anti").unionByName(rows)
        for name, keys in self.deleted.items():
            base = changed.get(name, hotel.table(name))
            changed[name] = base.join(keys, TABLES[name].key, "left_anti")
        return hotel.replace(**changed)


def _hits(hotel: Hotel, child: Table, column: str, keys: DataFrame) -> DataFrame:
    """Child rows that point at one of ``keys``: (valor, child key)."""
    links = hotel.table(child.name).select(F.col(column).alias("valor"), child.key)
    return links.join(keys.toDF("valor"), "valor", "left_semi")


def _blocked(hotel: Hotel, parent: str, keys: DataFrame) -> DataFrame | None:
    """Keys that a restricting row holds in place, directly or below a cascade.

    The held values of all references are put together before they meet the
    keys, in one join: a join for each reference would leave all of them, with
    their sorts, to one task.
    """
    held = []
    for child, ref in children_of(parent):
        if ref.on_delete == RESTRICT:
            held.append(hotel.table(child.name).select(F.col(ref.column).alias("valor")))
        elif ref.on_delete == CASCADE:
            hits = _hits(hotel, child, ref.column, keys)
            below = _blocked(hotel, child.name, hits.select(child.key))
            if below is not None:
                held.append(hits.join(below.toDF(child.key), child.key, "left_semi").select("valor"))
    return keys.toDF("valor").join(_union(held), "valor", "left_semi") if held else None


def cascade_delete(hotel: Hotel, name: str, keys: DataFrame) -> Deletion:
    """Delete rows of ``name`` by key, following the references.

    A key that any restricting row still needs is refused as a whole.
    """
    key = TABLES[name].key
    keys = checkpoint(keys.select(key).distinct().join(hotel.table(name).select(key), key, "left_semi"))
    blocked = _blocked(hotel, name, keys)
    if blocked is not None:
        blocked = checkpoint(blocked)
    allowed = keys if blocked is None else keys.join(blocked.toDF(key), key, "left_anti")
    rejected = (
        keys.limit(0).withColumn("motivo", F.lit(""))
        if blocked is None
        else blocked.toDF(key).withColumn("motivo", F.lit("still_referenced"))
    )
    deleted: dict[str, DataFrame] = {}
    cleared: dict[str, list[tuple[str, DataFrame]]] = {}

    def walk(table: str, gone: DataFrame) -> None:
        gone_key = TABLES[table].key
        gone = checkpoint(gone)
        deleted[table] = gone if table not in deleted else deleted[table].unionByName(gone).distinct()
        for child, ref in children_of(table):
            if ref.on_delete == CASCADE:
                walk(child.name, _hits(hotel, child, ref.column, gone.select(gone_key)).select(child.key))
            elif ref.on_delete == SET_NULL:
                cleared.setdefault(child.name, []).append((ref.column, gone.select(gone_key)))

    walk(name, allowed)
    return Deletion(deleted, {t: _clear(hotel, t, refs, deleted.get(t)) for t, refs in cleared.items()}, rejected)


def _clear(
    hotel: Hotel, table: str, refs: list[tuple[str, DataFrame]], gone: DataFrame | None
) -> DataFrame:
    """Whole rows of ``table`` with the references to deleted parents set to NULL."""
    rows = hotel.table(table)
    order = rows.columns
    touched = F.lit(False)
    for i, (column, keys) in enumerate(refs):
        mark = keys.toDF(column).withColumn(f"_m{i}", F.lit(True))
        rows = rows.join(mark, column, "left")
        touched = touched | F.col(f"_m{i}").isNotNull()
    rows = rows.filter(touched)
    for i, (column, _) in enumerate(refs):
        rows = rows.withColumn(column, F.when(F.col(f"_m{i}").isNull(), F.col(column)))
    if gone is not None:
        rows = rows.join(gone, TABLES[table].key, "left_anti")
    return rows.select(*order)
