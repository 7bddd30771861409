"""Observations that arrive continuously, merged into keyed state.

The state of an item is its merged record: for each field the value and the priority of the source that gave it.  The
catalogue's own values have priority CATALOGUE and are never replaced; an observation fills a field that is blank or
was filled by a source of larger number.  So the record does not depend on the order of arrival, and a micro-batch reads and
writes the state of its own keys only: the catalogue is read once, as the first state of a new query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from catalogkit.operators.ordered import keep_last

CATALOGUE = 0
BLANK = ("", "null", "none", "n/a")  # fixed values: texts that count as nothing
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def blank(value: object) -> bool:
    return value is None or value != value or str(value).strip().lower() in BLANK


class Record(StatefulProcessor):
    """One item: (value, priority) of each field, in ``fields``' order."""

    def __init__(self, key: str, fields: Sequence[str]):
        self.key, self.fields = key, list(fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("record", ", ".join(f"v{i} string, p{i} int" for i in range(len(self.fields))))

    def merged(self, held: list, rows: pd.DataFrame) -> list[str]:
        """Takes over what the rows know better; the names of the fields that changed."""
        changed = []
        ordered = rows.sort_values("priority", kind="stable")
        for i, field in enumerate(self.fields):
            for value, priority in zip(ordered[field], ordered["priority"]):
                if not blank(value) and (blank(held[2 * i]) or priority < held[2 * i + 1]):
                    if held[2 * i] != value:
                        changed.append(field)
                    held[2 * i : 2 * i + 2] = [value, int(priority)]
                    break
        return changed

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        held = [None, None] * len(self.fields)
        self.merged(held, initialState.assign(priority=CATALOGUE))
        self.state.update(tuple(held))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self.state.get() or [None, None] * len(self.fields)) if self.state.exists() else [None, None] * len(self.fields)
        changed: list[str] = []
        for frame in rows:
            changed += [f for f in self.merged(held, frame) if f not in changed]
        self.state.update(tuple(held))
        if changed:
            one = {self.key: [key[0]], **{f: [held[2 * i]] for i, f in enumerate(self.fields)}, "changed": ["|".join(f for f in self.fields if f in changed)]}
            yield pd.DataFrame(one)

    def close(self) -> None:
        pass


def merge_stream(observations: DataFrame, catalogue: DataFrame, fields: Sequence[str], key: str = "code") -> DataFrame:
    """(key, fields, changed) of every item that a micro-batch of the stream ``observations`` (key, priority, fields) changed.

    Priorities are whole numbers above CATALOGUE, the smallest the best; of one priority the value that came first stays.
    Fields are text; blank ones, and observations without a key, say nothing.  ``catalogue`` holds one row of a key, and
    gives the first state; later runs of the query go on from their checkpoint.  The session's state store is STORE.
    """
    first = catalogue.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).groupBy(key)
    seen = observations.where(F.col(key).isNotNull()).select(key, F.col("priority").cast("int").alias("priority"), *[F.col(f).cast("string").alias(f) for f in fields])
    schema = ", ".join([f"`{key}` string", *[f"`{f}` string" for f in fields], "changed string"])
    return seen.groupBy(key).transformWithStateInPandas(Record(key, fields), schema, "Update", "None", first)


def start(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's changes as the folder ``batch=N`` of ``path``; a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(catalogue: DataFrame, path: str, fields: Sequence[str], key: str = "code") -> DataFrame:
    """The catalogue's (key, fields) under the changes written so far: each item's latest record."""
    changes = catalogue.sparkSession.read.parquet(path).select(key, *fields, F.col("batch").cast("int").alias("batch"))
    base = catalogue.select(key, *[F.col(f).cast("string").alias(f) for f in fields], F.lit(-1).alias("batch"))
    return keep_last(base.unionByName(changes), [key], ["batch"]).drop("batch")
