"""Tables of the library written to and read from a store: intervals, maps, spectra, flux points, copies of observations.

All are Parquet that Spark commits. Times are written as seconds after a reference, energies by bin edges.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors share: below spark.checkpoint.dir, on one machine else a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="photonlake-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_intervals(df: DataFrame, path: str, reference: int) -> None:
    """(keys..., start, stop) in seconds as met_start and met_stop, seconds after the reference."""
    rest = [c for c in df.columns if c not in ("start", "stop")]
    df.select(*rest, (F.col("start") - reference).alias("met_start"), (F.col("stop") - reference).alias("met_stop"), F.lit(reference).alias("reference")).write.mode("overwrite").parquet(path)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in ("met_start", "met_stop", "reference")]
    return df.select(*rest, (F.col("met_start") + F.col("reference")).alias("start"), (F.col("met_stop") + F.col("reference")).alias("stop"))


def write_sparse_map(cube: DataFrame, path: str, width: int) -> None:
    """(px, py, e, value) as (pix, channel, value) without zeros, pixels numbered row by row."""
    cube.filter("value <> 0").select((F.col("py") * width + F.col("px")).alias("pix"), F.col("e").alias("channel"), "value").write.mode("overwrite").parquet(path)


def read_sparse_map(spark: SparkSession, path: str, width: int) -> DataFrame:
    return spark.read.parquet(path).select((F.col("pix") % width).alias("px"), F.floor(F.col("pix") / width).cast("int").alias("py"), F.col("channel").alias("e"), "value")


def write_spectrum(spectrum: DataFrame, path: str, e_width: float) -> None:
    """(e, counts) as (channel, counts, e_min, e_max) of equal energy bins."""
    spectrum.select(F.col("e").alias("channel"), "counts", (F.col("e") * e_width).alias("e_min"), ((F.col("e") + 1) * e_width).alias("e_max")).write.mode("overwrite").parquet(path)


def write_flux_points(points: DataFrame, path: str, shape: str, key: str = "series") -> None:
    """Flux points (key, day, flux, err): ``long``, a row each; ``light_curve``, a row each with time bounds; ``wide``, a row per key with arrays in order of days."""
    if shape == "long":
        out = points.select(key, "day", "flux", "err")
    elif shape == "light_curve":
        out = points.select(key, F.col("day").alias("time_min"), (F.col("day") + 1).alias("time_max"), "flux", "err")
    elif shape == "wide":
        rows = points.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("day", "flux", "err"))).alias("r"))
        out = rows.select(key, F.col("r.day").alias("days"), F.col("r.flux").alias("fluxes"), F.col("r.err").alias("errs"))
    else:
        raise ValueError(f"not a shape of flux points: {shape!r}")
    out.write.mode("overwrite").parquet(path)


def read_flux_points(spark: SparkSession, path: str, key: str = "series") -> DataFrame:
    """(key, day, flux, err) of any of the shapes."""
    df = spark.read.parquet(path)
    if "days" in df.columns:
        return df.select(key, F.explode(F.arrays_zip("days", "fluxes", "errs")).alias("r")).select(key, F.col("r.days").alias("day"), F.col("r.fluxes").alias("flux"), F.col("r.errs").alias("err"))
    return df.select(key, (F.col("time_min") if "time_min" in df.columns else F.col("day")).alias("day"), "flux", "err")


def copy_observations(tables: dict[str, DataFrame], wanted: DataFrame, path: str) -> None:
    """The rows of the wanted obs_ids of each table in a folder of its own, partitioned by the observation's last two digits, with an index."""
    for name, df in tables.items():
        kept = df.join(wanted.select("obs_id").distinct(), "obs_id", "left_semi").withColumn("part", F.pmod("obs_id", F.lit(100)))
        kept.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")
    index = wanted.select("obs_id").distinct().select("obs_id", F.explode(F.array(*map(F.lit, tables))).alias("kind"))
    index.withColumn("path", F.concat(F.lit(f"{path}/"), "kind", F.lit("/part="), F.pmod("obs_id", F.lit(100)))).write.mode("overwrite").parquet(f"{path}/index")


def read_copy(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("part")


class Rounds:
    """Tables that the rounds of an iteration write and reread below a new folder, so that plans do not grow and a lost executor costs a reread."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, new_folder(spark, label), 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
