"""Room-state log kept up to date from a stream of state events.

Each micro-batch runs the batch form of the log, which spreads a busy room over
many tasks. Two tables carry over between batches: the last state per room, of
which a batch writes the rooms it changed, and the events still too young to be
put in order. Everything a batch
writes sits in a folder named after the batch, so a replay after a lost
executor or driver overwrites its own output and nothing else.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.functions import ntz
from innsight.plans.rooms import previous_value
from innsight.session import checkpoint
from innsight.streaming._common import LatestRows, drain, each_batch, put

_EVENTS = "request_id long, id_habitacion long, estado string, fecha_hora timestamp_ntz"
_STATES = "id_habitacion long, estado string"
_LOG = "request_id long, id_habitacion long, estado_anterior string, estado_nuevo string, fecha_hora timestamp_ntz"


@dataclass(frozen=True)
class RoomLog:
    """Folders of one running log; ``delay`` is how late an event may arrive."""

    spark: SparkSession
    root: str
    delay: dt.timedelta = dt.timedelta(hours=1)

    def run(self, events: DataFrame) -> None:
        """Consume the available events (request_id, id_habitacion, estado, fecha_hora)."""
        drain(each_batch(events, self._batch), f"{self.root}/control")

    def log(self) -> DataFrame:
        return self._all("bitacora", _LOG)

    def closed_log(self) -> DataFrame:
        """The log of a source that has ended: pending events have nothing to wait for and are logged, too."""
        changes = self._changes(self.pending(), self._states().read())
        return self.log().unionByName(changes.select(*_names(_LOG)))

    def late(self) -> DataFrame:
        """Events that came after their time had been closed."""
        return self._all("tardios", _EVENTS)

    def pending(self) -> DataFrame:
        """Events waiting for the watermark."""
        return self._carried("pendientes", _EVENTS, self._last_batch())

    def _all(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").select(*_names(schema))

    def _last_batch(self) -> int:
        """The newest finished batch; the horizon table has one row per batch."""
        found = self._horizons().agg(F.max("lote")).first()[0]
        return -1 if found is None else found

    def _horizons(self) -> DataFrame:
        schema = "horizonte timestamp_ntz, lote long"
        return self.spark.read.schema(schema).parquet(f"{self.root}/horizonte")

    def _carried(self, name: str, schema: str, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/lote={batch}")

    def _states(self) -> LatestRows:
        return LatestRows(self.spark, f"{self.root}/estados", ["id_habitacion"], _STATES)

    def _changes(self, due: DataFrame, states: DataFrame) -> DataFrame:
        """Real state changes among ``due`` events, given the states before them."""
        before = states.withColumnRenamed("estado", "_inicial")
        return (
            previous_value(due, "id_habitacion", ["fecha_hora", "request_id"], "estado")
            .join(before, "id_habitacion", "left")
            .withColumn("estado_anterior", F.coalesce("anterior", "_inicial"))
            .filter(F.col("estado_anterior") != F.col("estado"))
            .withColumnRenamed("estado", "estado_nuevo")
        )

    def _batch(self, fresh: DataFrame, batch: int) -> None:
        closed = None
        if batch > 0:
            closed = self._horizons().filter(F.col("lote") == batch - 1).first()[0]
        arrived = checkpoint(fresh.select(*_names(_EVENTS)))
        on_time = arrived
        if closed is not None:
            put(arrived.filter(F.col("fecha_hora") <= ntz(closed)), f"{self.root}/tardios", batch)
            on_time = arrived.filter(F.col("fecha_hora") > ntz(closed))
        else:
            put(arrived.limit(0), f"{self.root}/tardios", batch)
        newest = arrived.agg(F.max("fecha_hora")).first()[0]
        horizon = max((h for h in (closed, newest - self.delay if newest else None) if h), default=None)

        waiting = self._carried("pendientes", _EVENTS, batch - 1).unionByName(on_time)
        ready = F.lit(False) if horizon is None else F.col("fecha_hora") <= ntz(horizon)
        due, later = waiting.filter(ready), waiting.filter(~ready)
        log = self._changes(due, self._states().read(batch - 1))
        last = due.groupBy("id_habitacion").agg(
            F.max(F.struct("fecha_hora", "request_id", "estado")).getField("estado").alias("estado")
        )
        put(log.select(*_names(_LOG)), f"{self.root}/bitacora", batch)
        put(later, f"{self.root}/pendientes", batch)
        self._states().write(last, batch)
        marks = self.spark.createDataFrame([(horizon,)], "horizonte timestamp_ntz")
        put(marks, f"{self.root}/horizonte", batch)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]
