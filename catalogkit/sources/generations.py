"""Catalogues that change by committed generations.

A catalogue is a folder.  ``data/<id>`` holds the rows of one write, whatever came of it; ``log/<n>.json`` names the writes
that make up generation n, the oldest first, and is written last, by a rename that fails if n is there already.  Readers
resolve the newest log alone.  So a write is seen whole or not at all, over any number of partitions and files; a writer
that dies leaves files that nobody reads, and of two writers that meet one is told to start again from the other's result.
Everything goes through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.operators.ordered import keep_last

GONE = "__gone"  # set in the rows of a write whose keys the catalogue no longer holds
KEPT = 20  # writes that a generation lists before the next commit folds them into one


class Conflict(RuntimeError):
    """Another writer has committed since the catalogue was read."""


@dataclass(frozen=True)
class Change:
    """What a commit writes, or would write: ``rows`` with GONE, and the generation that holds it (None: a dry run)."""

    rows: DataFrame
    generation: int | None


class Catalogue:
    def __init__(self, spark: SparkSession, path: str, key: str = "code"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("log").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def generations(self) -> list[int]:
        """The committed ones, in order."""
        if not self._fs.exists(self._at("log")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def writes(self, generation: int) -> list[str]:
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/log/{generation}.json").first()[0])["writes"]

    def read(self, generation: int | None = None) -> DataFrame | None:
        """The rows of a generation, the newest if none is named; None before the first commit.

        Of rows that share a key the latest write counts; keys of one write are one row each, see ``commit``."""
        known = self.generations()
        generation = (known[-1] if known else None) if generation is None else generation
        if generation is None:
            return None
        return self._resolved(self.writes(generation)).where(f"NOT {GONE}").drop(GONE)

    def _resolved(self, writes: list[str]) -> DataFrame:
        every = None
        for n, name in enumerate(writes):
            one = self.spark.read.parquet(f"{self.path}/data/{name}").withColumn("__at", F.lit(n))
            every = one if every is None else every.unionByName(one, allowMissingColumns=True)
        if len(writes) == 1:
            return every.drop("__at")
        return keep_last(every, [self.key], ["__at"]).drop("__at")

    def changes(self, new: DataFrame, whole: bool = False) -> DataFrame:
        """The rows of ``new`` that the catalogue lacks or holds otherwise, with GONE false; with ``whole`` also the keys
        that ``new`` lacks, with GONE true and nulls."""
        old = self.read()
        flagged = new.withColumn(GONE, F.lit(False))
        if old is None:
            return flagged
        rest = [c for c in new.columns if c != self.key]
        text = lambda df: F.to_json(F.struct(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in rest]), {"ignoreNullFields": "false"})
        before = old.select(F.col(self.key).alias("__k"), F.xxhash64(text(old)).alias("__was"))
        met = flagged.withColumn("__is", F.xxhash64(text(new))).join(before, F.col(self.key) == F.col("__k"), "full")
        changed = F.col(GONE).isNotNull() & ~F.col("__is").eqNullSafe(F.col("__was"))
        lost = F.col(GONE).isNull() if whole else F.lit(False)
        picked = [F.coalesce(self.key, "__k").alias(self.key) if c == self.key else F.col(c) for c in new.columns]
        return met.where(changed | lost).select(*picked, F.coalesce(GONE, F.lit(True)).alias(GONE))

    def commit(self, new: DataFrame, whole: bool = False, apply: bool = False) -> Change:
        """Writes what ``new`` changes as the next generation; without ``apply`` nothing is written.

        ``new`` holds one row of a key; rows without a key can't be told apart and are refused.  ``whole`` says that
        ``new`` is the whole catalogue, so that other keys go.  Raises Conflict if another commit came between."""
        known = self.generations()
        at = known[-1] + 1 if known else 0
        rows = self.changes(new, whole)
        if not apply:
            return Change(rows, None)
        name = uuid.uuid4().hex
        place = f"{self.path}/data/{name}"
        rows.write.parquet(place)
        written = self.spark.read.parquet(place)
        wrong = written.groupBy(self.key).count().where(f"count > 1 OR {self.key} IS NULL")
        if not wrong.isEmpty():
            raise ValueError(f"{self.key} is missing or repeats, for example {wrong.first()[0]!r}")
        writes = [*(self.writes(known[-1]) if known else []), name]
        if len(writes) > KEPT:
            folded = uuid.uuid4().hex
            self._resolved(writes).where(f"NOT {GONE}").write.parquet(f"{self.path}/data/{folded}")
            writes = [folded]
        self._publish(at, writes)
        return Change(written, at)

    def _publish(self, at: int, writes: list[str]) -> None:
        """Writes the log beside its place and renames it there, which fails if the generation is committed already."""
        text = bytearray(json.dumps({"generation": at, "writes": writes}).encode())
        draft, final = self._at(f"log/.{uuid.uuid4().hex}"), self._at(f"log/{at}.json")
        out = self._fs.create(draft, False)
        out.write(text)
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"generation {at} of {self.path} is there already")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the logs but the newest ``keep`` and the writes that no log left names; returns these writes.

        For when no writer is at work: a write that is not committed yet looks like one that failed."""
        known = self.generations()
        for n in known[: max(0, len(known) - keep)]:
            self._fs.delete(self._at(f"log/{n}.json"), False)
        used = {w for n in self.generations() for w in self.writes(n)}
        there = [s.getPath().getName() for s in self._fs.listStatus(self._at("data"))] if self._fs.exists(self._at("data")) else []
        dead = sorted(n for n in there if n not in used)
        for n in dead:
            self._fs.delete(self._at(f"data/{n}"), True)
        return dead
