"""Index refresh and the fact fold over streams of files, and event-time windows as an extension."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.facts import fold_step


def file_stream(spark: SparkSession, path: str, schema, most_files: int = 64) -> DataFrame:
    """New Parquet files of a folder, so many a trigger at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def refresh_index(changes: DataFrame, keys: Sequence[str], order: Sequence[Column], write: Callable[[DataFrame, int], None], checkpoint: str):
    """For every batch of changes, hand its newest row of each key to `write`; ends when what is there has been read."""
    from ..operators.relational import latest

    return changes.writeStream.foreachBatch(lambda df, i: write(latest(df, keys, order), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unchanged_skipped(pages: DataFrame, time: str, keys: Sequence[str], delay: str = "7 days") -> DataFrame:
    """Pages whose keys were not seen within the delay: state is dropped behind the watermark, so it stays bounded."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def fold_stream(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """id, outcome for each fact as it arrives; the state of a key is its current fact alone.

    facts: keys, id, hash, confidence, read_at, human, arrived. Facts of one trigger are taken in order of arrival, then id.
    """
    state = "id bigint, hash string, confidence bigint, read_at bigint, human boolean"

    def fold(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        current = dict(zip(("id", "hash", "confidence", "read_at", "human"), held.get)) if held.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values(["arrived", "id"], kind="stable")
        for r in rows.itertuples(index=False):
            fact = {"id": int(r.id), "hash": r.hash, "confidence": int(r.confidence), "read_at": int(r.read_at), "human": bool(r.human)}
            outcome = fold_step(current, fact)
            if outcome in ("accepted", "superseded"):
                current = fact
            out.append((fact["id"], outcome))
        held.update(tuple(current.values()))
        yield pd.DataFrame(out, columns=["id", "outcome"])

    return facts.groupBy(*keys).applyInPandasWithState(fold, "id bigint, outcome string", state, "append", GroupStateTimeout.NoTimeout)


#: The state store that typed state needs; set it on the session before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_FACT = "id bigint, hash string, confidence bigint, read_at bigint, human boolean"


class FactFold(StatefulProcessor):
    """The fold of one key's facts with typed state: the current fact, and the conflicts that wait for a person until their time runs out."""

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", _FACT)
        self.held = handle.getMapState("held", "id bigint", "until bigint")

    def handleInputRows(self, key, rows, timerValues):
        found = self.current.get()
        current = dict(zip(("id", "hash", "confidence", "read_at", "human"), found)) if found is not None else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["arrived", "id"], kind="stable").itertuples(index=False):
            fact = {"id": int(r.id), "hash": r.hash, "confidence": int(r.confidence), "read_at": int(r.read_at), "human": bool(r.human)}
            outcome = fold_step(current, fact)
            if outcome in ("accepted", "superseded"):
                current = fact
            if outcome == "conflict_flagged":
                until = int(pd.Timestamp(r.at).value // 1_000_000) + self.hold_ms
                self.held.updateValue((fact["id"],), (until,))
                self.handle.registerTimer(until)
            out.append((fact["id"], outcome))
        self.current.update(tuple(current.values()))
        yield pd.DataFrame(out, columns=["id", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = sorted(k[0] for k, until in list(self.held.iterator()) if until[0] <= now)
        for i in gone:
            self.held.removeKey((i,))
        if gone:
            yield pd.DataFrame([(i, "lapsed") for i in gone], columns=["id", "outcome"])

    def close(self) -> None:
        pass


def fold_with_timers(facts: DataFrame, keys: Sequence[str], hold: str = "7 days", delay: str = "1 day") -> DataFrame:
    """id, outcome for each fact as it arrives, and "lapsed" for a conflict that nobody settled within `hold` of its event time.

    facts: keys, id, hash, confidence, read_at, human, arrived, at (timestamp). State is a fact and the open conflicts of a key; a query that starts again from its checkpoint goes on with both. Facts later than
    the watermark (`delay` behind the newest) are left out. The session needs STATE_STORE.
    """
    hold_ms = int(pd.Timedelta(hold).total_seconds() * 1000)
    marked = facts.withWatermark("at", delay)
    return marked.groupBy(*keys).transformWithStateInPandas(FactFold(hold_ms), "id bigint, outcome string", "append", "eventTime")


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Extension: counts by event-time window, late rows beyond the watermark left out."""
    counted = events.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
