"""References to records that do not exist, and what hangs below them.

Direct orphans come from distinct keys: each referring column is first reduced to its distinct keys
(combined map-side, so a hot key costs nothing), those are held against the tables they point to,
and only the unsound keys go back to the rows, over a salted join. The cascade then takes the rows
found as orphaned records and follows the foreign-key graph down with semi-joins until a round adds
no record (fixpoint); every record is taken at most once, so cycles end.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.runtime import staged

SALTS = 16


@dataclass(frozen=True)
class Reference:
    table: str
    column: str
    target: str
    reported: bool = True
    #: Whether the target's rows can carry the status `deleted`.
    marked: bool = False


#: The foreign keys of the platform; matters.client_id only passes orphanhood on.
GRAPH = (
    Reference("documents", "matter_id", "matters", marked=True),
    Reference("documents", "client_id", "clients"),
    Reference("tasks", "matter_id", "matters", marked=True),
    Reference("pages", "document_id", "documents"),
    Reference("matters", "client_id", "clients", reported=False),
)


def key_of(column: str | Column) -> Column:
    """An id without outer blanks and case; null where nothing is left."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def _targets(table: DataFrame, by_status: bool) -> DataFrame:
    """One row per key: earliest created_at, and whether the latest delivery has status deleted."""
    marked = F.lower(F.trim(F.col("status"))) == "deleted" if by_status else F.lit(False)
    return (
        table.select(key_of("id").alias("_key"), F.col("created_at").alias("_at"), F.coalesce(marked, F.lit(False)).alias("_marked"))
        .filter("_key is not null")
        .groupBy("_key")
        .agg(F.min("_at").alias("_first"), F.max_by("_marked", F.struct(F.col("_at"), F.col("_marked"))).alias("_marked"))
    )


def direct(tables: dict[str, DataFrame], ref: Reference) -> DataFrame:
    """(table_name, column_name, row_id, reason, created_at) of the unsound references of one column.

    Null and blank references are none. Rows repeated under one id count once, with their earliest
    created_at. A null created_at is never late. Of the reasons, deleted comes before late.
    """
    own = tables[ref.table].select(F.col("id").alias("row_id"), key_of(ref.column).alias("_key"), F.col("created_at").alias("_row_at")).filter("_key is not null")
    logs = (
        tables["audit_logs"].filter(F.col("action").startswith("delete_"))
        .select(key_of("entity_id").alias("_key"), F.lit(True).alias("_logged")).filter("_key is not null").distinct()
    )
    keys = own.groupBy("_key").agg(F.min("_row_at").alias("_least"))
    there = _targets(tables[ref.target], ref.marked)
    unsound = (
        keys.join(there.withColumn("_there", F.lit(True)), "_key", "left").join(logs, "_key", "left")
        .select("_key", "_first", F.when(F.col("_there").isNull(), F.when(F.col("_logged"), "deleted").otherwise("missing")).when(F.col("_marked"), "deleted").when(F.col("_first") > F.col("_least"), "late").alias("reason"))
        .filter("reason is not null")
    )
    salted = unsound.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        own.withColumn("_salt", F.pmod(F.hash("row_id"), F.lit(SALTS)))
        .join(salted, ["_key", "_salt"])
        .groupBy("row_id", "_key", "reason", "_first").agg(F.min("_row_at").alias("created_at"))
        .filter("reason <> 'late' or _first > created_at")
        .groupBy("row_id", "reason").agg(F.min("created_at").alias("created_at"))
        .select(F.lit(ref.table).alias("table_name"), F.lit(ref.column).alias("column_name"), "row_id", "reason", "created_at")
    )


def unsound_references(tables: dict[str, DataFrame], graph: tuple[Reference, ...] = GRAPH) -> DataFrame:
    """The direct orphans of every reported reference."""
    parts = [direct(tables, r) for r in graph if r.reported]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cascade(tables: dict[str, DataFrame], graph: tuple[Reference, ...] = GRAPH) -> DataFrame:
    """(table_name, row_id, kind, depth, created_at): direct orphans at depth 0, inherited ones below.

    A record is an orphan if one of its references is missing or deleted, or leads to an orphan.
    Late references resolve, so they pass nothing on. A record that is both is direct.
    """
    heads = [direct(tables, r).filter("reason <> 'late'").select("table_name", "row_id", "created_at") for r in graph]
    front = heads[0]
    for h in heads[1:]:
        front = front.unionByName(h)
    front = staged(front.groupBy("table_name", "row_id").agg(F.min("created_at").alias("created_at")), "orphans")
    seen = front
    found = [front.withColumns({"kind": F.lit("direct"), "depth": F.lit(0)})]
    children = {t: [r for r in graph if r.target == t] for t in {r.target for r in graph}}
    for depth in itertools.count(1):  # ends: every round takes new records only
        steps = []
        for target, refs in children.items():
            lost = front.filter(F.col("table_name") == target).select(key_of("row_id").alias("_key")).distinct()
            for r in refs:
                rows = tables[r.table].select(F.col("id").alias("row_id"), key_of(r.column).alias("_key"), "created_at")
                # A hot parent's rows are spread: the lost keys are repeated per salt.
                spread = lost.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                steps.append(
                    rows.withColumn("_salt", F.pmod(F.hash("row_id"), F.lit(SALTS))).join(spread, ["_key", "_salt"], "left_semi")
                    .select(F.lit(r.table).alias("table_name"), "row_id", "created_at")
                )
        new = steps[0]
        for s in steps[1:]:
            new = new.unionByName(s)
        new = new.groupBy("table_name", "row_id").agg(F.min("created_at").alias("created_at"))
        new = new.join(seen.select("table_name", "row_id"), ["table_name", "row_id"], "left_anti")
        front = staged(new, "orphans")
        if front.isEmpty():
            break
        found.append(front.withColumns({"kind": F.lit("inherited"), "depth": F.lit(depth)}))
        seen = seen.unionByName(front)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("table_name", "row_id", "kind", "depth", "created_at")
