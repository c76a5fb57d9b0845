"""Parquet storage: explicit schemas, month partitions, appends, keyed updates, versioned commits.

A stored hotel is a folder with one sub-folder per table, cut into parts and,
for tables with a main date, months: ``reservacion/parte=…/mes=200106/``. A
manifest per version names the part folders that make up each table. A commit
writes its parts first and publishes its manifest last, by a move that fails if
that version exists, so readers see the old version or the new one, never a
mixture, and of two writers one comes first.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.schemas import MAIN_DATE, TABLES
from innsight.tables import Delta, Hotel, conform

#: Month of rows without a date, and of tables that are not cut by months.
NO_MONTH = 0
#: How often a commit starts over because another one was published meanwhile.
ATTEMPTS = 8


class CommitConflict(RuntimeError):
    """Another commit changed rows that this one was computed from."""


@dataclass(frozen=True)
class Piece:
    """A stored folder: the rows of one table and month that one commit wrote."""

    tabla: str
    parte: str
    mes: int

    def path(self, root: str) -> str:
        return f"{root}/{self.tabla}/parte={self.parte}/mes={self.mes}"


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``delta`` replacing those of the same key."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)


def insert_if_absent(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Rows of ``delta`` whose key ``base`` does not hold yet; of rows that share a key the least."""
    others = [c for c in delta.columns if c != key]
    once = delta.groupBy(key).agg(F.min(F.struct(*others)).alias("_fila"))
    rows = once.select(key, *[F.col(f"_fila.{c}").alias(c) for c in others]).select(*delta.columns)
    return rows.join(base.select(key), key, "left_anti")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def month_of(column: str | Column) -> Column:
    """Year and month as one number; rows without a date are in ``NO_MONTH``."""
    return F.coalesce(F.year(column) * 100 + F.month(column), F.lit(NO_MONTH))


def write_hotel(hotel: Hotel, root: str) -> None:
    """Store every table of ``hotel`` as version 0; a folder that holds a hotel already is refused."""
    pieces = [piece for name in hotel.names() for piece in _write(hotel.table(name), root, name, 0)]
    if not _publish(hotel.spark, root, 0, hotel.names(), pieces):
        raise CommitConflict(f"{root} holds a hotel")


def read_hotel(spark: SparkSession, root: str, version: int | None = None) -> Hotel:
    """The last committed version, or an earlier one; parquet schemas are declared, never inferred."""
    version = _latest(spark, root) if version is None else version
    names, pieces = _manifest(spark, root, version)

    def loader(name: str):
        return lambda: _read(spark, root, name, [p for p in pieces if p.tabla == name]).drop("mes")

    return Hotel(spark, {name: loader(name) for name in names}, version)


def read_table(
    spark: SparkSession, root: str, name: str, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """A table of the last version with its month as ``mes``, narrowed to main dates from ``start`` to before ``end``.

    The dates become a condition on ``mes`` as well, so months outside are not
    read; a join on ``mes`` with a filtered table prunes them at run time.
    """
    _, pieces = _manifest(spark, root, _latest(spark, root))
    rows = _read(spark, root, name, [p for p in pieces if p.tabla == name])
    date = MAIN_DATE.get(name)
    if start is not None:
        rows = rows.filter((F.col("mes") >= start.year * 100 + start.month) & (F.col(date) >= F.lit(start)))
    if end is not None:
        last = end - dt.timedelta(days=1)
        rows = rows.filter((F.col("mes") <= last.year * 100 + last.month) & (F.col(date) < F.lit(end)))
    return rows


def commit(hotel: Hotel, delta: Delta, root: str) -> Hotel:
    """Store ``delta``, computed from ``hotel``, in ``root`` and return the new version.

    Inserts add a part and rewrite nothing; updates rewrite the months that hold
    the old or the new state of a changed row. If other commits were published
    since ``hotel`` was read, the delta is put on top of them, unless one of them
    changed or removed a row that the delta replaces: then ``CommitConflict`` is
    raised and nothing changes. Rows whose key is stored are not inserted again,
    so a retried commit adds none twice. A commit that dies before its manifest
    is published leaves parts that no version names.
    """
    spark, base = hotel.spark, hotel.version
    for _ in range(ATTEMPTS):
        version = _latest(spark, root)
        if base is not None and version != base:
            _refuse_conflicts(spark, root, delta, base, version)
        names, pieces = _manifest(spark, root, version)
        for name, rows in delta.updates.items():
            pieces = _updated(spark, root, name, rows, version + 1, pieces)
        for name, rows in delta.inserts.items():
            mine = [p for p in pieces if p.tabla == name]
            fresh = insert_if_absent(_read(spark, root, name, mine), conform(rows, TABLES[name].struct), TABLES[name].key)
            pieces = pieces + _write(fresh, root, name, version + 1)
        if _publish(spark, root, version + 1, [*dict.fromkeys([*names, *delta.updates, *delta.inserts])], pieces):
            return read_hotel(spark, root, version + 1)
    raise CommitConflict(f"{ATTEMPTS} other commits came first")


def _refuse_conflicts(spark: SparkSession, root: str, delta: Delta, base: int, version: int) -> None:
    """Rows that ``delta`` replaces must be the same in both versions, or have its own content already."""
    old, new = read_hotel(spark, root, base), read_hotel(spark, root, version)
    for name, rows in delta.updates.items():
        key, columns = TABLES[name].key, TABLES[name].struct.fieldNames()

        def state(df: DataFrame, label: str) -> DataFrame:
            return df.select(F.col(key), F.struct(*columns).alias(label))  # noqa: B023

        changes = state(conform(rows, TABLES[name].struct), "nueva")
        seen = changes.join(state(old.table(name), "antes"), key, "left").join(state(new.table(name), "ahora"), key, "left")
        kept = F.col("ahora").eqNullSafe(F.col("antes")) | F.col("ahora").eqNullSafe(F.col("nueva"))
        if not seen.filter(~kept).isEmpty():
            raise CommitConflict(f"{name} changed between versions {base} and {version}")


def _updated(spark, root: str, name: str, rows: DataFrame, version: int, pieces: list[Piece]) -> list[Piece]:
    """``pieces`` with the months that hold changed rows of table ``name`` written anew."""
    table = TABLES[name]
    rows = conform(rows, table.struct)
    mine = [p for p in pieces if p.tabla == name]
    stored = _read(spark, root, name, mine)
    touched = stored.select(table.key, "mes").join(rows.select(table.key), table.key, "left_semi").select("mes")
    if name in MAIN_DATE:
        touched = touched.unionByName(rows.select(month_of(MAIN_DATE[name]).alias("mes")))
    # as many months as the calendar has
    months = {r.mes for r in touched.distinct().collect()}
    again = [p for p in mine if p.mes in months]
    whole = upsert(_read(spark, root, name, again).drop("mes"), rows, table.key)
    return [p for p in pieces if p not in again] + _write(whole, root, name, version)


def _read(spark: SparkSession, root: str, name: str, pieces: list[Piece]) -> DataFrame:
    """Rows of ``pieces`` with their month ``mes``, a partition column."""
    columns = [T.StructField(f.name, f.dataType, True) for f in TABLES[name].struct]
    struct = T.StructType([*columns, T.StructField("mes", T.IntegerType())])
    if not pieces:
        return spark.createDataFrame([], struct)
    reader = spark.read.schema(T.StructType([*struct, T.StructField("parte", T.StringType())]))
    return reader.option("basePath", f"{root}/{name}").parquet(*[p.path(root) for p in pieces]).drop("parte")


def _write(rows: DataFrame, root: str, name: str, version: int) -> list[Piece]:
    """Write one part, facts cut by month and in date order within.

    The key is part of the range: a month or date that holds a large share of
    the rows still spreads over many files.
    """
    part = f"{version:08d}-{uuid.uuid4().hex[:12]}"
    out = conform(rows, TABLES[name].struct)
    if name in MAIN_DATE:
        order = ["mes", MAIN_DATE[name], TABLES[name].key]
        out = out.withColumn("mes", month_of(MAIN_DATE[name]))
        out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    else:
        out = out.withColumn("mes", F.lit(NO_MONTH))
    folder = f"{root}/{name}/parte={part}"
    out.write.partitionBy("mes").parquet(folder)
    fs, path = _file_system(rows.sparkSession, folder)
    names = [status.getPath().getName() for status in fs.listStatus(path) if status.isDirectory()]
    return [Piece(name, part, int(n.removeprefix("mes="))) for n in sorted(names) if n.startswith("mes=")]


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _manifest_path(root: str, version: int) -> str:
    return f"{root}/_manifest/v{version:08d}.json"


def _latest(spark: SparkSession, root: str) -> int:
    fs, folder = _file_system(spark, f"{root}/_manifest")
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return max(int(n[1:9]) for n in names if n.startswith("v"))


def _manifest(spark: SparkSession, root: str, version: int) -> tuple[list[str], list[Piece]]:
    """Tables and pieces of a version: as many as tables, months and commits since the last rewrite make."""
    said = json.loads(spark.read.text(_manifest_path(root, version), wholetext=True).first()[0])
    return said["tablas"], [Piece(*p) for p in said["piezas"]]


def _publish(spark: SparkSession, root: str, version: int, names: list[str], pieces: list[Piece]) -> bool:
    """Make ``version`` visible as a whole; False if another writer has published it.

    The manifest is written under a name of its own and then gets its final
    name: by a rename that refuses to replace, or on a local disk by a hard link.
    """
    jvm = spark.sparkContext._jvm
    final = _manifest_path(root, version)
    fs, own = _file_system(spark, f"{root}/_manifest/.{uuid.uuid4().hex}")
    stream = fs.create(own)
    stream.write(bytearray(json.dumps({"tablas": names, "piezas": [[p.tabla, p.parte, p.mes] for p in pieces]}).encode()))
    stream.close()
    target = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(final))
    try:
        if target.toUri().getScheme() == "file":
            place = jvm.java.nio.file.Path.of
            jvm.java.nio.file.Files.createLink(place(target.toUri()), place(fs.makeQualified(own).toUri()))
            fs.delete(own, False)
        else:
            refuse = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(fs.makeQualified(own), target, refuse)
    except Exception as error:  # a Java exception; only this one means that the version exists
        if "AlreadyExists" not in str(error):
            raise
        fs.delete(own, False)
        return False
    return True
