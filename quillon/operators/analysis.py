"""Documents to facts: the analysis of a whole table as one column plan, and its way back into the table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import lexicons as L
from quillon.functions import facts
from quillon.functions import text as T
from quillon.operators.matters import finder, least_score, name_tree
from quillon.runtime import BROADCAST_ROWS, checked_broadcast, latest_by_id, once, staged
from quillon.sources import providers


def document_text(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(document_id, text), of all documents or of those given (see access.readable): one page as it is, several marked with their numbers. Blank and null texts count as empty.

    Rows repeated under one page id count once. Pages of one document meet in one row, as in the documents table.
    """
    if documents is not None:
        pages = pages.join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi")
    row = F.struct("document_id", F.col("page_number").alias("n"), F.col("ordinal").alias("o"), F.col("text").alias("t"))
    once = pages.groupBy("id").agg(F.min_by(row, F.struct("ordinal", "page_number", "text")).alias("r")).select("r.*")
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "o", F.coalesce("t", F.lit("")).alias("t"))))
    marked = F.transform(F.col("p"), lambda x: F.concat(F.lit("--- Page "), x["n"].cast("string"), F.lit(" ---\n"), x["t"]))
    return once.groupBy("document_id").agg(parts.alias("p")).select("document_id", F.when(F.size("p") == 1, F.col("p")[0]["t"]).otherwise(F.array_join(marked, "\n\n")).alias("text"))


def named_in(docs: DataFrame, names: DataFrame, block: int = BROADCAST_ROWS) -> DataFrame:
    """(id, fiscal, matter_id) of docs (id, fiscal, low_text) that hold a matter's name (matter_id, name) anywhere.

    All names of a block are looked for in one pass over a text (Aho-Corasick); more than a block of
    names take as many passes as there are blocks, so what is sent to the tasks is bounded.
    """
    names = names.filter("name <> ''")
    blocks = -(-names.count() // block) or 1
    kind = docs.schema["id"].dataType.simpleString()
    out = None
    for i in range(blocks):
        rows = names.filter(F.pmod(F.xxhash64("matter_id"), F.lit(blocks)) == i).select("matter_id", "name").collect()  # about `block` rows
        sent = docs.sparkSession.sparkContext.broadcast([(r["matter_id"], r["name"]) for r in rows])

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids: dict[str, list[str]] = {}
            for m, n in sent.value:
                ids.setdefault(n, []).append(m)
            tree = name_tree(ids)
            for b in batches:
                found = [(d, f, m) for d, f, t in zip(b["id"], b["fiscal"], b["low_text"]) if ids for m in dict.fromkeys(m for _, group in tree.iter(t) for m in group)]
                yield pd.DataFrame(found, columns=["id", "fiscal", "matter_id"])

        one = docs.select("id", "fiscal", "low_text").mapInPandas(run, f"id {kind}, fiscal boolean, matter_id string")
        out = one if out is None else out.unionByName(one)
    return out


def classify_matter(docs: DataFrame, matters: DataFrame) -> DataFrame:
    """(id, matter_id, matter_score) of documents (id, low_text, words, labels) that reach the threshold.

    The share of a matter's words (with hints) that the document has, and 0.35 if it names the matter.
    Each document meets an index of words and whole names in its own row, see matters.MatterIndex. Ties
    go to the matter stored first (created_at), then to the greater id.
    """
    best = once(docs, m=finder(matters)(F.col("low_text"), F.concat("words", "labels"))).select("id", least_score(F.col("labels")).alias("least"), "m.*").filter("matter_id is not null")
    order = F.struct("matter_score", (-F.col("since")).alias("age"), "matter_id")
    return best.groupBy("id").agg(F.max_by(F.struct("matter_id", "matter_score", "least"), order).alias("b")).select("id", "b.*").filter("matter_score >= least").drop("least")


def analyse(documents: DataFrame, matters: DataFrame | None = None, rules: tuple[L.DocTypeRule, ...] = L.DOC_TYPE_RULES) -> DataFrame:
    """documents (id, text, filename, type, document_date, matter_id, matter_locked) with the struct `analysis`.

    A locked document keeps its matter with score 1. Null text is analysed as empty.
    """
    t = F.coalesce("text", F.lit(""))
    base = once(documents.withColumns({"_text": t, "_normal": T.normalise(t)}), _words=F.array_distinct(T.tokens("_text")))
    base = once(base, _keys=facts.keywords_in(F.col("_words"), rules))
    base = once(base, _kind= F.coalesce(facts.doc_type(F.col("_normal"), F.col("_keys"), rules), F.nullif(F.col("type"), F.lit("")), F.lit("Document")))
    base = once(base, _day=F.coalesce(facts.text_date("_text"), F.col("document_date")), _people=facts.persons("_text"), _tags=facts.tags(F.col("_words"), F.col("_kind")))
    if matters is not None:
        base = once(base, _best=finder(matters)(F.lower("_text"), F.concat("_words", "_tags")))
        enough = F.col("_best.matter_score") >= least_score(F.col("_tags"))
        base = base.withColumns({"_matter": F.when(enough, F.col("_best.matter_id")), "_score": F.when(enough, F.col("_best.matter_score"))})
    else:
        base = base.withColumns({"_matter": F.lit(None).cast("string"), "_score": F.lit(0.0)})
    locked = F.coalesce("matter_locked", F.lit(False))
    matter, score = F.when(locked, F.col("matter_id")).otherwise(F.col("_matter")), F.when(locked, 1.0).otherwise(F.coalesce("_score", F.lit(0.0)))
    analysis = F.struct(
        facts.title(F.col("_kind"), F.col("_people"), F.col("_day"), F.col("_text"), F.col("filename")).alias("title"),
        F.col("_kind").alias("doc_type"), F.col("_day").alias("doc_date"), F.col("_people").alias("persons"),
        facts.summary(F.col("_kind"), F.col("_people"), F.col("_day"), F.col("_tags"), F.col("_text")).alias("summary"),
        F.col("_tags").alias("tags"), matter.alias("matter_id"), F.lit("local-rules").alias("method"), facts.confidence(F.size("_words"), score).alias("confidence"),
    )
    return base.withColumn("analysis", analysis).select(*documents.columns, "analysis")


def merge_analysis(llm: Column, rules: Column) -> Column:
    """A model's fields where it gave any, the rules' otherwise; the greater confidence."""
    text = lambda f: F.coalesce(F.nullif(llm[f], F.lit("")), rules[f])
    many = lambda f: F.when(F.size(F.coalesce(llm[f], F.array().cast("array<string>"))) > 0, llm[f]).otherwise(rules[f])
    return F.when(llm.isNull(), rules).otherwise(F.struct(
        text("title").alias("title"), text("doc_type").alias("doc_type"), F.coalesce(llm["doc_date"], rules["doc_date"]).alias("doc_date"), many("persons").alias("persons"),
        text("summary").alias("summary"), many("tags").alias("tags"), F.coalesce(llm["matter_id"], rules["matter_id"]).alias("matter_id"), llm["method"].alias("method"), F.greatest(llm["confidence"], rules["confidence"]).alias("confidence"),
    ))


def payload(c: str | Column, method: str = "llm") -> Column:
    """A model's JSON answer, checked: lengths cut, lists made distinct, dates by form only."""
    p = F.from_json(T.col(c), "title string, doc_type string, doc_date string, persons array<string>, summary string, tags array<string>, matter_id string")
    names = lambda f, n: F.slice(F.transform(F.array_distinct(F.filter(F.transform(F.coalesce(p[f], F.array().cast("array<string>")), T.strip), lambda x: x != "")), lambda x: F.substring(x, 1, 120)), 1, n)
    cut = lambda f, n: F.substring(T.strip(F.coalesce(p[f], F.lit(""))), 1, n)
    answered = F.startswith(F.get_json_object(T.col(c), "$"), F.lit("{"))  # anything else is no answer
    return F.when(answered, F.struct(
        cut("title", 140).alias("title"), cut("doc_type", 80).alias("doc_type"), F.when(F.regexp_like(p["doc_date"], F.lit(r"^(?:19|20)\d{2}-[01]\d-[0-3]\d$")), F.to_date(F.try_to_timestamp(p["doc_date"], F.lit("yyyy-MM-dd")))).alias("doc_date"),
        names("persons", 12).alias("persons"), cut("summary", 900).alias("summary"), names("tags", 8).alias("tags"), F.nullif(p["matter_id"], F.lit("")).alias("matter_id"), F.lit(method).alias("method"), F.lit(0.9).alias("confidence"),
    ))


def analyse_with_model(documents: DataFrame, matters: DataFrame, model: str = "off", rules: tuple[L.DocTypeRule, ...] = L.DOC_TYPE_RULES, listed: int = 200) -> DataFrame:
    """analyse(), with a registered model's fields where it gives any: see providers.MODELS.

    The prompt lists the matters there are, at most `listed` of them, the oldest first; where there are more, only
    those are offered to the model, and a matter that it names and that does not exist is dropped. An
    answer that is no JSON leaves the rules' analysis; blank texts are not sent.
    """
    done = analyse(documents, matters, rules)
    if model not in providers.MODELS:
        return done
    known = matters.groupBy("id").agg(F.min_by(F.struct("name", "responsible"), "created_at").alias("m"), F.min("created_at").alias("at"))
    offered = [(r["id"], r["name"] or "", r["responsible"] or "") for r in known.orderBy("at", "id").limit(listed).select("id", "m.*").collect()]
    kept = F.when(F.coalesce("matter_locked", F.lit(False)), F.col("matter_id"))
    asked = staged(done.withColumn("_said", providers.ask(providers.prompt(F.col("text"), offered, kept), F.col("text"), model)), "answers")  # a model is asked once
    told = asked.withColumn("_llm", payload("_said", model)).drop("_said")
    named = told.select(F.col("_llm.matter_id").alias("_known")).filter("_known is not null").distinct().join(known.select(F.col("id").alias("_known")), "_known", "left_semi").withColumn("_is", F.lit(True))
    told = told.withColumn("_known", F.coalesce("_llm.matter_id", F.concat(F.lit("\x00"), F.col("id").cast("string")))).join(checked_broadcast(named), "_known", "left")
    llm = F.when(F.col("_llm").isNotNull(), F.col("_llm").withField("matter_id", F.when(F.coalesce("matter_locked", F.lit(False)), F.col("matter_id")).when(F.col("_is"), F.col("_llm.matter_id"))))
    return told.withColumn("analysis", merge_analysis(llm, F.col("analysis"))).select(*documents.columns, "analysis")


def apply_analysis(documents: DataFrame) -> DataFrame:
    """documents with the struct `analysis` written into their columns; the matter is overwritten even by null unless locked."""
    a = F.col("analysis")
    keep = lambda f, own: F.coalesce(F.nullif(a[f], F.lit("")), F.col(own))
    return documents.withColumns({
        "title": keep("title", "title"), "type": keep("doc_type", "type"), "doc_type": keep("doc_type", "doc_type"),
        "document_date": F.coalesce("document_date", a["doc_date"]), "persons": a["persons"], "summary": a["summary"], "tags": a["tags"],
        "analysis_method": a["method"], "analysis_confidence": a["confidence"],
        "matter_id": F.when(F.coalesce("matter_locked", F.lit(False)), F.col("matter_id")).otherwise(a["matter_id"]),
    }).drop("analysis")


def sync_client(documents: DataFrame, matters: DataFrame) -> DataFrame:
    """documents with the client of their matter where they have none."""
    owner = latest_by_id(matters.select("id", "client_id", "created_at")).select(F.col("id").alias("matter_id"), F.col("client_id").alias("_client"))
    joined = documents.join(checked_broadcast(owner), "matter_id", "left")
    return joined.withColumn("client_id", F.coalesce(F.nullif("client_id", F.lit("")), F.nullif("_client", F.lit("")))).select(*documents.columns)
