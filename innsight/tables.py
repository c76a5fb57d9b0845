"""``Hotel``: the tables a report reads; ``Delta``: the changes an applier emits."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from innsight.schemas import TABLES

Loader = Callable[[], DataFrame]


class Hotel:
    """Named logical tables, each built on first use.

    A loader that is never asked for never touches storage, so a report plans
    only the scans it needs.
    """

    def __init__(self, spark: SparkSession, loaders: Mapping[str, Loader], version: int | None = None):
        unknown = set(loaders) - set(TABLES)
        if unknown:
            raise KeyError(f"unknown tables: {sorted(unknown)}")
        self.spark = spark
        #: of a stored hotel, the version it was read from
        self.version = version
        self._loaders = dict(loaders)
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._loaders[name]()
        return self._built[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def names(self) -> list[str]:
        return [n for n in TABLES if n in self._loaders]

    def replace(self, **tables: DataFrame) -> Hotel:
        """A new version in which the given tables stand in for the old ones."""
        loaders = dict(self._loaders)
        loaders.update({name: (lambda df=df: df) for name, df in tables.items()})
        return Hotel(self.spark, loaders, self.version)

    def apply(self, delta: Delta) -> Hotel:
        """The version after ``delta``: new rows appended, changed rows replaced."""
        from innsight.sources.store import upsert

        changed = {name: self.table(name) for name in {*delta.inserts, *delta.updates}}
        for name, rows in delta.updates.items():
            changed[name] = upsert(changed[name], rows, TABLES[name].key)
        for name, rows in delta.inserts.items():
            changed[name] = changed[name].unionByName(rows)
        return self.replace(**changed)


@dataclass(frozen=True)
class Delta:
    """What a batch of requests does: rows to add, rows to replace, refused requests."""

    inserts: dict[str, DataFrame] = field(default_factory=dict)
    updates: dict[str, DataFrame] = field(default_factory=dict)
    rejected: DataFrame | None = None


def conform(rows: DataFrame, struct: StructType) -> DataFrame:
    """Columns in declared order and type; a column that is missing becomes NULL."""
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in struct
        ]
    )
