"""Incremental stacking: finished observations merge into a running stack of time windows and bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binned(events: DataFrame, window: str, watermark: str | None = None) -> DataFrame:
    """(start, e, counts, energy) per time window and energy bin; the merge of two parts is a plain sum.

    The same expression serves a stream, where ``watermark`` bounds the state, and a batch.
    """
    source = events if watermark is None else events.withWatermark("time", watermark)
    e = F.floor(F.col("energy") / 2.500013).cast("int").alias("e")
    g = source.groupBy(F.window("time", window).alias("w"), e).agg(F.count("*").alias("counts"), F.sum("energy").alias("energy"))
    return g.select(F.col("w.start").alias("start"), "e", "counts", "energy")


def stream(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, window: str = "1 day", watermark: str = "2 days"):
    """Stack Parquet files of photons (time, energy) as they arrive; finished windows are appended to ``sink``."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(source)
    return binned(events, window, watermark).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").start()


class StackStore:
    """A running stack in a folder: deltas by batch, and snapshots that hold all batches up to a number.

    A batch is added by writing its delta over whatever an earlier attempt left there, so a batch that is played again counts
    once; one that a snapshot already holds is passed over. A table counts from its ``_SUCCESS`` marker on, which Spark
    writes last. Rows are (keys, sums): merging is addition, in any order. ``compact`` and ``add`` may be repeated
    after a failure; one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: list[str]):
        self.spark, self.path, self.keys, self.sums = spark, path.rstrip("/"), keys, sums

    def _numbers(self, kind: str) -> list[int]:
        """The finished tables below a folder."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Add the sums of one batch: rows (keys, sums), not yet merged or merged."""
        held = self._numbers("snapshot")
        if held and batch <= held[-1]:
            return
        self._merged(rows).write.mode("overwrite").parquet(f"{self.path}/delta/{batch}")

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])

    def _parts(self) -> tuple[int, list[str]]:
        held = self._numbers("snapshot")
        upto = held[-1] if held else -1
        deltas = [n for n in self._numbers("delta") if n > upto]
        return max([upto, *deltas]), [*([f"{self.path}/snapshot/{upto}"] if held else []), *(f"{self.path}/delta/{n}" for n in deltas)]

    def read(self) -> DataFrame | None:
        """The stack of all finished batches; None before the first."""
        _, parts = self._parts()
        return self._merged(reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in parts])) if parts else None

    def compact(self) -> None:
        """Write a snapshot of all finished batches, which later reads start from; batches must come in order of their numbers."""
        upto, parts = self._parts()
        if len(parts) > 1:
            self.read().write.mode("overwrite").parquet(f"{self.path}/snapshot/{upto}")


def stream_into(spark: SparkSession, source: str, schema, store: StackStore, checkpoint: str, window: str = "1 day", compact_every: int = 64, files: int = 16):
    """Stack Parquet files of photons (time, energy) as they arrive, each micro-batch as a batch of the store.

    Nothing is late: a window may grow at any time, and ``n_late`` counts the photons of windows that end before the newest photon
    of earlier batches' days began, window by window. Restarted from its checkpoint, the stream plays the last batch again,
    which the store counts once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        known = store.read()
        newest = None if known is None else known.agg(F.max("start")).first()[0]
        late = F.lit(0).cast("bigint") if newest is None else F.when(F.col("start") < F.lit(newest), F.col("counts")).otherwise(0)
        store.add(binned(batch, window).withColumn("n_late", late), number)
        if number % compact_every == compact_every - 1:
            store.compact()

    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").start()
