"""Documents into the tables: intake of files, reprocessing, and the two jobs over a whole corpus.

Each is a composition of column plans over all rows at once; the tables that change come back as
DataFrames, to be saved by the caller (see store.save).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import analysis, store
from quillon.runtime import staged
from quillon.sources import engines, files, providers

#: What extraction says of a document.
EXTRACTED = ("status", "has_text_layer", "ocr_required", "quality", "confidence", "page_count", "message")
#: What analysis says of a document.
ANALYSED = ("title", "type", "doc_type", "document_date", "persons", "summary", "tags", "analysis_method", "analysis_confidence", "matter_id", "client_id")


def text_of(pages: Column) -> Column:
    """The text of an array of pages, marked with their numbers where there are several."""
    one = lambda p: F.concat(F.lit("--- Page "), p["page_number"].cast("string"), F.lit(" ---\n"), F.coalesce(p["text"], F.lit("")))
    return F.when(F.size(pages) == 1, F.coalesce(pages[0]["text"], F.lit(""))).otherwise(F.array_join(F.transform(pages, one), "\n\n"))


def uploaded(uploads: DataFrame) -> DataFrame:
    """Document rows of uploads (filename, content, mime_type, client_id, matter_id, type, responsible, document_date, created_at[, id]).

    A matter that comes with the upload locks it; a type `Auto` is none. Ids depend on the row alone unless given.
    """
    name = T.safe_filename("filename")
    typed = F.when(F.coalesce("type", F.lit("Auto")) == "Auto", "").otherwise(F.col("type"))
    df = uploads if "id" in uploads.columns else uploads.withColumn("id", T.stable_id("doc", "filename", "created_at", F.sha2("content", 256)))
    blank = F.array().cast("array<string>")
    return df.withColumns({
        "filename": name, "stored_name": F.concat("id", F.lit("_"), name), "path": name, "mime_type": F.coalesce(F.nullif("mime_type", F.lit("")), F.lit("application/octet-stream")),
        "matter_locked": F.coalesce(F.col("matter_id") != "", F.lit(False)), "title": name, "type": typed, "doc_type": typed, "responsible": F.coalesce("responsible", F.lit("")),
        "persons": blank, "summary": F.lit(""), "tags": blank, "analysis_method": F.lit(""), "analysis_confidence": F.lit(0.0), "updated_at": F.col("created_at"),
    })


def analysed(documents: DataFrame, matters: DataFrame) -> DataFrame:
    """documents (with text, null where there are no pages) with the analysis of their text applied and clients synchronised."""
    read, unread = documents.filter("text is not null"), documents.filter("text is null")
    found = analysis.apply_analysis(analysis.analyse(read, matters))
    return analysis.sync_client(found, matters).select(*documents.columns).unionByName(unread)


def _with_pages(documents: DataFrame, matters: DataFrame, provider: str, extracted: str | None, ocr: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents with text and extraction, analysed; their page rows)."""
    read = engines.read_waiting(staged(files.extract(documents, extracted), "extracted"), ocr) if ocr else files.extract(documents, extracted)
    read = staged(read.drop("content"), "read")
    done = analysed(read.withColumn("text", F.when(F.size("pages") > 0, text_of(F.col("pages")))), matters)
    pages = store.page_records(read.select("id", "pages", F.col("updated_at").alias("created_at")))
    return done.drop("pages", "text"), providers.embed(pages.drop("embedding"), "text", provider)


def audited(documents: DataFrame, actor: str, action: str) -> DataFrame:
    """One audit row for each document, with its status."""
    rows = store.audit(documents.select("id", F.col("updated_at").alias("created_at"), "status"), actor, action, "document", F.create_map(F.lit("status"), "status"))
    return rows


def intake(uploads: DataFrame, matters: DataFrame, actor: str, provider: str = "off", extracted: str | None = None, ocr: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The new rows of documents, pages, alerts and audit_logs for uploads, see uploaded().

    Files without text get no pages and no analysis; documents that need attention raise an alert. Null
    contents are empty files. `extracted` names a column with text that an outside tool took from a PDF, `ocr`
    the recognition engines to run on images and scanned pages, see engines.selected().
    """
    documents, pages = _with_pages(uploaded(uploads), matters, provider, extracted, list(ocr))
    documents = staged(documents.drop("path"), "documents")
    return {"documents": documents, "pages": pages, "alerts": store.alerts(documents), "audit_logs": audited(documents, actor, "upload")}


def reprocess(documents: DataFrame, pages: DataFrame, contents: DataFrame, matters: DataFrame, actor: str, at: Column, provider: str = "off", extracted: str | None = None, ocr: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """documents and pages with those of contents (id, content[, text layer]) extracted and analysed anew, and the audit rows of that.

    A locked document keeps its matter; no alert is raised. Contents of unknown documents are left out.
    """
    again = documents.drop(*EXTRACTED).join(contents, "id").withColumns({"path": F.coalesce("filename", F.lit("")), "updated_at": at})
    done, fresh = _with_pages(again, matters, provider, extracted, list(ocr))
    done = staged(done.select(*documents.columns), "documents")
    old = documents.join(done.select("id"), "id", "left_anti").select(*documents.columns)
    return {
        "documents": old.unionByName(done), "pages": store.replace_pages(pages, fresh, done.select(F.col("id").alias("document_id"))), "audit_logs": audited(done, actor, "reprocess"),
        "report": done.select("id", "filename", "status", "quality", "confidence", "message"),
    }


def reanalyse(documents: DataFrame, pages: DataFrame, matters: DataFrame) -> DataFrame:
    """documents analysed anew from their stored pages; those without pages stay as they are."""
    texts = analysis.document_text(pages).withColumnRenamed("document_id", "id")
    joined = documents.drop("text").join(texts, "id", "left")
    return analysed(joined.select(*[c for c in documents.columns if c != "text"], "text"), matters)
