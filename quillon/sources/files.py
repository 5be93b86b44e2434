"""Files to pages: format dispatch, text files, PDF text and literals, page splitting.

Input is a DataFrame (path, mime_type, content), as spark.read.format("binaryFile") gives it with a
MIME column; text that an outside tool has extracted from a PDF can be passed in `extracted`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon import lexicons as L
from quillon.functions import text as T

PAGE_CHARS = 20_000


def route(path: str | Column, mime: str | Column) -> Column:
    """text, pdf, image or unsupported; the order of the tests decides (x.pdf sent as text/plain is text)."""
    suffix = F.lower(F.regexp_extract(T.col(path), r"(\.[^./]*)$", 1))
    m = F.coalesce(F.lower(T.col(mime)), F.lit(""))
    return (
        F.when(suffix.isin(*L.TEXT_EXTENSIONS) | F.startswith(m, F.lit("text/")), "text")
        .when((suffix == ".pdf") | (m == "application/pdf"), "pdf")
        .when(suffix.isin(*L.IMAGE_EXTENSIONS) | F.startswith(m, F.lit("image/")), "image")
        .otherwise("unsupported")
    )


@F.pandas_udf(StringType())
def decode(content: pd.Series) -> pd.Series:
    """UTF-8 with undecodable bytes dropped."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def pdf_literals(content: str | Column) -> Column:
    """The readable literal strings of a PDF's bytes, one per line (used where no text was extracted)."""
    raw = F.decode(T.col(content), "ISO-8859-1")
    found = F.filter(F.regexp_extract_all(raw, F.lit(r"(?s)\((.*?)\)"), 1), lambda x: F.length(x) >= 3)
    plain = F.transform(found, lambda x: F.replace(F.replace(F.replace(x, F.lit("\\\\n"), F.lit("\n")), F.lit("\\\\r"), F.lit("\n")), F.lit("\\\\t"), F.lit("\t")))
    kept = F.transform(F.filter(plain, T.looks_like_pdf_literal), T.clean)
    return F.array_join(F.filter(kept, T.looks_like_text), "\n")


def pdf_page_estimate(content: str | Column) -> Column:
    return F.greatest(F.regexp_count(F.decode(T.col(content), "ISO-8859-1"), F.lit(r"/Type\s*/Page\b")), F.lit(1))


def split_pages(text: str | Column, least: float = 0.45) -> Column:
    """Pages of form-fed text: blank ones are skipped before numbering; pages below `least` are dropped, their numbers stay unused."""
    parts = F.filter(F.transform(F.split(F.coalesce(T.col(text), F.lit("")), "\f"), T.strip), lambda p: p != "")
    cleaned = F.transform(parts, lambda p, i: F.struct((i + 1).alias("n"), T.clean(p).alias("t")))
    scored = F.transform(cleaned, lambda p: F.struct(p["n"].alias("n"), p["t"].alias("t"), T.quality(p["t"]).alias("q")))
    pages = F.transform(scored, lambda p: F.struct(
        p["n"].cast("int").alias("page_number"), F.substring(p["t"], 1, PAGE_CHARS).alias("text"), p["q"]["confidence"].alias("confidence"), p["q"]["quality"].alias("quality"), F.lit(None).cast("string").alias("raw_text"),
    ))
    return F.filter(pages, lambda p: p["confidence"] >= least)


def extract(files: DataFrame, extracted: str | None = None) -> DataFrame:
    """files with status, has_text_layer, ocr_required, quality, confidence, page_count, pages and message.

    Scanned files come out as ocr_pending: an OCR engine fills them in, see sources.ocr. A null content
    is read as empty. Pages are an array, to be exploded by the caller.
    """
    kind = route("path", "mime_type")
    body = F.coalesce(decode(F.col("content")), F.lit(""))
    plain = T.quality(body)
    text_page = F.array(F.struct(F.lit(1).alias("page_number"), body.alias("text"), plain["confidence"].alias("confidence"), plain["quality"].alias("quality"), body.alias("raw_text")))
    layer = F.coalesce(T.col(extracted), F.lit("")) if extracted else F.lit("")
    pdf_text = F.when(T.strip(layer) != "", layer).otherwise(pdf_literals(F.col("content")))
    none = F.array().cast(none_type())
    df = files.withColumns({"_kind": kind, "_body": body}).withColumn("_pdf", F.when(F.col("_kind") == "pdf", split_pages(pdf_text)))
    mean = F.aggregate("_pdf", F.lit(0.0), lambda a, p: a + p["confidence"]) / F.size("_pdf")
    read = (F.col("_kind") == "pdf") & (F.size("_pdf") > 0)
    is_text = F.col("_kind") == "text"
    blank_text = T.strip("_body") == ""
    good = mean >= 0.75
    return df.withColumns({
        "status": F.when(is_text, F.when(blank_text, "low_quality").otherwise("indexed")).when(read, F.when(good, "indexed").otherwise("low_quality")).when(F.col("_kind") == "unsupported", "error").otherwise("ocr_pending"),
        "has_text_layer": is_text | read,
        "ocr_required": ~(is_text | read | (F.col("_kind") == "unsupported")),
        "quality": F.when(is_text, plain["quality"]).when(read, F.when(good, "good").otherwise("low")).when(F.col("_kind") == "unsupported", "unsupported").otherwise("unknown"),
        "confidence": F.when(is_text, plain["confidence"]).when(read, F.round(mean, 3)).otherwise(0.0),
        "page_count": F.when(is_text, 1).when(F.col("_kind") == "pdf", F.greatest(pdf_page_estimate("content"), F.coalesce(F.size("_pdf"), F.lit(0)))).when(F.col("_kind") == "image", 1).otherwise(0),
        "pages": F.when(is_text, text_page.cast(none_type())).when(read, F.col("_pdf")).otherwise(none),
        "message": F.when(F.col("_kind") == "unsupported", "unsupported format").when(is_text | read, "").otherwise("no text layer; OCR required"),
    }).drop("_kind", "_body", "_pdf")


def none_type() -> str:
    return "array<struct<page_number:int,text:string,confidence:double,quality:string,raw_text:string>>"
