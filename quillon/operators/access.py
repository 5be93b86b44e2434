"""Who may see what: rights as expressions and as joins."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


@dataclass(frozen=True)
class Rights:
    """One user's rights, taken as values so that the filter is pushed to the scan."""

    clients: tuple[str, ...] = ()
    matters: tuple[str, ...] = ()

    @classmethod
    def of(cls, users: DataFrame, user_id: str) -> Rights:
        """The rights of a user (one row is read); an unknown user has none."""
        row = users.filter(F.col("id") == user_id).select("allowed_client_ids", "allowed_matter_ids").head()
        return cls(tuple(row[0] or ()), tuple(row[1] or ())) if row else cls()

    def visible(self) -> Column:
        """Never null: a document of an allowed matter or client, or one that is not filed at all."""
        member = lambda c, ids: F.coalesce(F.col(c).isin(*[i for i in ids if i]), F.lit(False)) if any(ids) else F.lit(False)
        return member("matter_id", self.matters) | member("client_id", self.clients) | (blank("matter_id") & blank("client_id"))


@dataclass(frozen=True)
class Filters:
    """Optional search filters; an unset one passes everything, an unknown date passes a date range."""

    client_id: str | None = None
    matter_id: str | None = None
    responsible: str | None = None
    type: str | None = None
    from_date: date | None = None
    to_date: date | None = None

    def matches(self) -> Column:
        out = F.lit(True)
        for name in ("client_id", "matter_id", "responsible"):
            if value := getattr(self, name):
                out = out & F.coalesce(F.col(name) == value, F.lit(False))
        if self.type:
            out = out & (F.coalesce(F.col("type") == self.type, F.lit(False)) | F.coalesce(F.col("doc_type") == self.type, F.lit(False)))
        if self.from_date:
            out = out & (F.col("document_date").isNull() | (F.col("document_date") >= F.lit(self.from_date)))
        if self.to_date:
            out = out & (F.col("document_date").isNull() | (F.col("document_date") <= F.lit(self.to_date)))
        return out


def readable(documents: DataFrame, rights: Rights) -> DataFrame:
    """The documents that a user may read."""
    return documents.filter(rights.visible())


def visible_counts(users: DataFrame, documents: DataFrame) -> DataFrame:
    """(user_id, visible): documents each user may see, without pairing users with documents.

    Documents are first counted per (client, matter); rights are exploded and joined to those counts;
    documents allowed both ways are taken off once.
    """
    groups = documents.groupBy("client_id", "matter_id").agg(F.count("*").alias("n"))
    open_to_all = documents.agg(F.count_if(blank("matter_id") & blank("client_id")).alias("everyone"))
    right = lambda c: users.select(F.col("id").alias("user_id"), F.explode(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))).alias("right_id")).filter("right_id <> ''")
    by_client = right("allowed_client_ids").join(groups, F.col("right_id") == F.col("client_id"))
    by_matter = right("allowed_matter_ids").join(groups, F.col("right_id") == F.col("matter_id"))
    either = by_client.unionByName(by_matter).select("user_id", "client_id", "matter_id", "n").distinct()
    seen = either.groupBy("user_id").agg(F.sum("n").alias("n"))
    return (
        users.select(F.col("id").alias("user_id")).join(seen, "user_id", "left").crossJoin(F.broadcast(open_to_all))
        .select("user_id", (F.coalesce("n", F.lit(0)) + F.col("everyone")).alias("visible"))
    )
