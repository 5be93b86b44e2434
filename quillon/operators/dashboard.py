"""Counts, sorted lists and labels of the overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import label

# Labels of codes.
STATUS_LABELS = {"imported": "Importe", "ocr_pending": "OCR requis", "ocr_processing": "OCR en cours", "indexed": "Indexe", "error": "Erreur", "low_quality": "Lisibilite faible"}
QUALITY_LABELS = {"good": "Bonne", "medium": "Moyenne", "low": "Faible", "unknown": "Inconnue", "error": "Erreur", "unsupported": "Non pris en charge"}


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of conditional counts, each table aggregated on its own and only over the columns needed."""
    docs = tables["documents"].agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("status") == "indexed").alias("indexed"),
        F.count_if(F.col("analysis_method").isNotNull() & (F.col("analysis_method") != "")).alias("analyzed"),
        F.count_if(F.col("status").isin("imported", "ocr_pending", "ocr_processing")).alias("pending"),
        F.count_if(F.col("status").isin("error", "low_quality")).alias("errors"),
    )
    ones = [
        tables["clients"].agg(F.count("*").alias("clients")), tables["matters"].agg(F.count("*").alias("matters")), docs,
        tables["tasks"].agg(F.count_if(F.col("status") == "open").alias("open_tasks")),
        tables["pages"].agg(F.count_if(F.size(F.coalesce("embedding", F.array().cast("array<double>"))) > 0).alias("semantic_pages")),
    ]
    out = ones[0]
    for one in ones[1:]:
        out = out.crossJoin(one)  # one row by one row
    return out


def newest(table: DataFrame, k: int, order: str = "created_at", tie: str = "id") -> DataFrame:
    """The k newest rows; a null date is oldest, ties by id."""
    return table.orderBy(F.col(order).desc_nulls_last(), F.col(tie)).limit(k)


def public_state(tables: dict[str, DataFrame], user_id: str, audited: int = 25) -> dict[str, DataFrame]:
    """The parts of the overview: counts, clients, matters, documents and alerts newest first, tasks by due date, the newest audit rows, the user."""
    by_date = lambda t: tables[t].orderBy(F.col("created_at").desc_nulls_last(), "id")
    return {
        "stats": counts(tables), "clients": tables["clients"], "matters": tables["matters"], "documents": by_date("documents"), "tasks": tasks_by_due(tables["tasks"]),
        "alerts": by_date("alerts"), "audit_logs": newest(tables["audit_logs"], audited), "current_user": tables["users"].filter(F.col("id") == user_id),
    }


def tasks_by_due(tasks: DataFrame) -> DataFrame:
    """Tasks by due date, those without one first."""
    return tasks.orderBy(F.col("due_date").asc_nulls_first(), "id")


def percent(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("bigint")


def labelled(documents: DataFrame) -> DataFrame:
    return documents.select("id", label("status", STATUS_LABELS).alias("status_label"), label("quality", QUALITY_LABELS).alias("quality_label"), percent(F.col("confidence")).alias("percent"), F.to_date("created_at").alias("day"))
