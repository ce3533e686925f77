"""Session helpers shared by every operator: table access, code shipping, durable cut points."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_PACKAGE = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the Parquet tables; naming columns keeps the scan narrow from the start."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_evidentia_shipped", False):
        return
    with tempfile.TemporaryDirectory() as folder:
        archive = os.path.join(folder, "evidentia_src.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(_PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(_PACKAGE.parent))
        if sc.master.startswith("local[") or sc.master == "local":
            # Workers of a local session share this process's import path.
            sc._evidentia_shipped = True
            return
        keep = os.path.join(tempfile.mkdtemp(prefix="evidentia-"), "evidentia_src.zip")
        os.replace(archive, keep)
        sc.addPyFile(keep)
    sc._evidentia_shipped = True


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, as Spark itself reaches it, and the path in it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return bool(fs.exists(at))


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    fs, at = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file, replaced where it exists."""
    fs, at = _file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only in a local session without it."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"evidentia-checkpoint-{uuid.uuid4().hex}")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing the rows to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-bound Python stages at least one task a core.

    A scan that already has that many splits is left alone, so a large input is
    never shuffled for this; only inputs of a few files are dealt out again. Rows that come out of
    a shuffle are spread already, and asking for their splits would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def first_of_each(df: DataFrame, key: str) -> DataFrame:
    """One row for each key: re-delivered rows carry the same content, so any of them serves.

    The aggregation combines on the map side, so only one copy of a key leaves each task.
    Rows without a key belong to no record and are left out.
    """
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def bounded_sample(df: DataFrame, key: str, most: int, *by: str) -> DataFrame:
    """About ``most`` rows (of each group), up to twice as many, chosen by a hash of the key.

    Rows are thinned where they are read, by a share from the exact counts, so no task ever
    holds or sends more than its part of the sample.
    """
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    if not by:
        n = df.count()
        return df if n <= most else df.where(drawn < 1.5 * most / n)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    joined = df.join(F.broadcast(sizes), list(by))  # one row a group; groups are few
    return joined.where(drawn < F.lit(1.5 * most) / F.col("_size")).drop("_size")


def global_order(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Rows with their places (from 0) in a total order, without one task that sorts all of them:
    a range-partitioned sort, the sizes of its partitions (one row a task), and places within each.

    The sorted rows are written to the checkpoint folder first, so that a partition that is lost
    and computed again keeps its bounds and numbers.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    placed = durable(parts.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))
    before = F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_before")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, at).drop("_part", "_id", "_before")


def own_group(tie: str, *keys: str) -> Column:
    """A further partition key that sets each row with a null key apart, so that such rows neither
    count as neighbours nor meet in one task."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return F.when(~known, F.col(tie))


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def qualified(name: str) -> Column:
    """A column reference that survives dots in the name."""
    return F.col("`" + name.replace("`", "``") + "`")
