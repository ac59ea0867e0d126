"""First of each key and places within domains over all files that ever come, by keyed state without a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.shared import ship
from .jobs import run_to_end

#: State lives on the executors' disks and, by batch, in the query's checkpoint; only changes are uploaded, and no space is
#: taken ahead, which many small stores would multiply.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
KEY, GROUP = "__key", "__group"


class First(StatefulProcessor):
    """Passes on the least row of a key that no batch before had; a key costs one boolean of state."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0].startswith("o"):  # a row without a key is like no other and needs no state
            yield from rows
        elif not self.seen.exists():
            self.seen.update((True,))
            yield min(rows, key=lambda r: r[self.order])

    def close(self) -> None:
        pass


class Places(StatefulProcessor):
    """Numbers a group's rows in order, on from the batch before, up to ``cap``; a group costs one number of state."""

    def __init__(self, order: str, cap: int):
        self.order, self.cap = order, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "taken long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        taken = self.taken.get()[0] if self.taken.exists() else 0
        room, best = self.cap - taken, []
        for r in rows:  # holds twice the room at most
            best.append(r)
            if len(best) >= 2 * max(room, 1):
                best = sorted(best, key=lambda r: r[self.order])[: max(room, 0)]
        best = sorted(best, key=lambda r: r[self.order])[: max(room, 0)]
        if best:
            self.taken.update((taken + len(best),))
        for i, r in enumerate(best):
            yield Row(**r.asDict(), place=taken + i + 1)

    def close(self) -> None:
        pass


def _least(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The n least rows of a key in each Arrow batch: what a hot key sends on shrinks before the shuffle, and no answer changes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[b.groupby(by, sort=False)[order].rank(method="first") <= n]

    return df.mapInPandas(cut, df.schema)


def seen_places(stream: DataFrame, key: str, group: str, order: str, cap: int) -> DataFrame:
    """The loop over files "pass over a known key; else it is known, and takes its group's next place, if one of ``cap`` is left".

    Exact over all batches of a query's checkpoint, whatever their sizes, as long as ``order`` (unique, not null, numbers)
    rises from batch to batch; within a batch it is the order of the loop. A row beyond the cap has made its key known.
    A null key is no key, a null group is a group. Adds ``place`` from 1. State: a boolean a key and a number a group, for good.
    Columns beside the three travel through Python workers, so texts are better joined to the result by id.
    """
    ship(stream.sparkSession)
    own = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("o"), F.col(order).cast("string")))
    rows = stream.withColumn(KEY, own).withColumn(GROUP, F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")))
    first = _least(rows, KEY, order, 1).groupBy(KEY).transformWithState(First(order), rows.schema, "Append", "None")
    schema = StructType([*rows.schema.fields, StructField("place", LongType())])
    out = _least(first, GROUP, order, cap).groupBy(GROUP).transformWithState(Places(order, cap), schema, "Append", "None")
    return out.drop(KEY, GROUP)


def seen_files(source: DataFrame, path: str, key: str, group: str, order: str, cap: int) -> DataFrame:
    """Runs seen_places over what is new since the last run under ``path`` and returns all rows that stay so far.

    The sink commits a batch's files together, and the state goes back to the last batch committed, so a run that is killed
    goes on where it was.
    """
    conf = source.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        conf.set(k, v)
    try:
        return run_to_end(seen_places(source, key, group, order, cap), path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
