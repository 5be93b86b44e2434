"""Session helpers: table access, reliable staging, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000


def session(app: str = "quillon", cores: str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | extra
    spark = SparkSession.builder.appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()
_STAGED: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no copy of their own."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillon-")) / "quillon.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a session on one machine gets a local one where none is set."""
    set_already = spark.conf.get("spark.checkpoint.dir", None)
    if not set_already:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_already = context.get() if context.isDefined() else None
    if not set_already:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        set_already = "file://" + folder
        spark.sparkContext.setCheckpointDir(set_already)
        spark.conf.set("spark.checkpoint.dir", set_already)
    return set_already


def staged(df: DataFrame, name: str = "t", *by: str) -> DataFrame:
    """Write df as a table into the shared folder and read it back.

    It cuts the lineage, survives the loss of executors, and lets several readers prune
    columns of one result. An empty df keeps its schema. `by` are columns to partition the files by.
    """
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex[:12]}")
    _STAGED.append(path)
    writer = df.repartition(*by).write.partitionBy(*by) if by else df.write
    writer.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete the tables that staged() has written in this application; what reads from them must be done with."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once per row, however many others or filters read them.

    A filter on a computed column moves below it and repeats what it is made of; through a generator it does not.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.withColumn("_once", made).select(*[c for c in df.columns if c not in columns], "_once.*")


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; it counts no further than needed."""
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is measured to be small, else df as it is (shuffled join)."""
    return F.broadcast(df) if small_enough(df, rows) else df


def spread_join(rows: DataFrame, side: DataFrame, on: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined (inner or left) with a side of one row per key: broadcast if it is measured to be small, else shuffled
    by key and a hash of the column `by`, so that a key that a third of the rows have is spread over `salts` tasks."""
    if small_enough(side):
        return rows.join(F.broadcast(side), on, how)
    spread = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Null keys get salts without bound: they find nothing, and do not meet.
    salt = F.when(F.col(on).isNull(), F.hash(by)).otherwise(F.pmod(F.hash(by), F.lit(salts)))
    return rows.withColumn("_salt", salt).join(spread, [on, "_salt"], how).drop("_salt")


def latest_by_id(df: DataFrame, key: str = "id", order: str = "created_at") -> DataFrame:
    """One row per key, of the greatest order value: delivered twice counts once.

    Ties between differing rows go to the greatest row by its other columns' JSON.
    """
    cols = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct(F.col(order), F.to_json(F.struct(*cols))))
    return df.groupBy(key).agg(best.alias("_r")).select(key, "_r.*").select(*df.columns)
