"""Changes of the tables as DataFrame transforms: replaced pages, new rows, audit and alerts, atomic saves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T


def replace_pages(pages: DataFrame, new: DataFrame, document_ids: DataFrame) -> DataFrame:
    """All pages of the given documents dropped (left anti), the new ones added."""
    return pages.join(document_ids.select("document_id").distinct(), "document_id", "left_anti").unionByName(new, allowMissingColumns=True).select(*pages.columns)


def page_records(extracted: DataFrame) -> DataFrame:
    """One page row per page of the array `pages` of (id, pages, created_at); raw text falls back to the text."""
    p = F.col("p")
    return extracted.select(F.col("id").alias("document_id"), "created_at", F.explode("pages").alias("p")).select(
        T.stable_id("page", "document_id", p["page_number"]).alias("id"), "document_id", p["page_number"].alias("page_number"), p["text"].alias("text"),
        F.coalesce(F.nullif(p["raw_text"], F.lit("")), p["text"]).alias("raw_text"), p["confidence"].alias("confidence"), p["quality"].alias("quality"),
        F.lit(None).cast("array<double>").alias("embedding"), "created_at", p["page_number"].cast("bigint").alias("ordinal"),
    )


def create(rows: DataFrame, prefix: str, default_name: str, name: str = "name", status: str | None = None) -> DataFrame:
    """New clients, matters or tasks: names trimmed, blank ones by default, ids that depend on the row alone."""
    out = rows.withColumn(name, F.coalesce(F.nullif(T.strip(name), F.lit("")), F.lit(default_name)))
    if status:
        out = out.withColumn("status", F.coalesce(F.nullif(T.strip("status"), F.lit("")) if "status" in rows.columns else F.lit(None), F.lit(status)))
    return out.withColumn("id", T.stable_id(prefix, *rows.columns))


def grant(users: DataFrame, user_id: str, column: str, new_ids: DataFrame) -> DataFrame:
    """users with the ids added to one user's rights."""
    ids = new_ids.agg(F.array_sort(F.collect_set("id")).alias("_new"))
    had = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return users.crossJoin(F.broadcast(ids)).withColumn(column, F.when(F.col("id") == user_id, F.array_union(had, "_new")).otherwise(F.col(column))).drop("_new")


def audit(rows: DataFrame, actor: str, action: str, entity: str, details: Column | None = None) -> DataFrame:
    """One audit row per created or changed row (id, created_at)."""
    said = details if details is not None else F.lit(None)
    return rows.select(
        T.stable_id("audit", F.lit(action), "id", "created_at").alias("id"), F.lit(actor).alias("actor_id"), F.lit(action).alias("action"), F.lit(entity).alias("entity"),
        F.col("id").alias("entity_id"), said.cast("map<string,string>").alias("details"), "created_at",
    )


def alerts(documents: DataFrame) -> DataFrame:
    """An alert for each new document that needs attention; errors at level error, the others as warnings."""
    bad = documents.filter(F.col("status").isin("ocr_pending", "low_quality", "error"))
    return bad.select(
        T.stable_id("alert", "id", "status").alias("id"), F.when(F.col("status") == "error", "error").otherwise("warning").alias("level"),
        F.concat(F.coalesce("filename", F.lit("")), F.lit(": "), F.coalesce(F.nullif("message", F.lit("")), "status")).alias("message"), "created_at", F.lit(False).alias("seen"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of old whose key is not among the new ones, and the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def save(df: DataFrame, path: str) -> str:
    """Write a new version of a table beside the old ones, then name it as the current one; returns the version's folder.

    The name stands in one small file that is replaced as a whole, so a reader finds the old version or
    the new one, on file systems without rename as well; a failure before that leaves the old one current.
    """
    version = f"v-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/{version}")
    stream, _ = _pointer(df.sparkSession, path, write=True)
    stream.write(bytearray(version.encode()))
    stream.close()
    return f"{path}/{version}"


def current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table written by save()."""
    stream, size = _pointer(spark, path, write=False)
    version = bytes(stream.readNBytes(size)).decode()
    stream.close()
    return spark.read.parquet(f"{path}/{version}")


def _pointer(spark: SparkSession, path: str, write: bool):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    fs = name.getFileSystem(conf)
    return (fs.create(name, True), 0) if write else (fs.open(name), int(fs.getFileStatus(name).getLen()))
