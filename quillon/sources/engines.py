"""Recognition engines over a table of images: candidates of every engine and mode, then of turned images, then the best.

An engine is a factory that runs once per Python worker and gives a function from an image's bytes, a
mode and an angle to words (text, confidence, page, block, paragraph, line); lines are numbered where the
engine tells them. Built-in factories stand for programs and packages that a machine may have; which of
them are used is decided once, on the driver. An image on which an engine fails has no candidate of it.
"""

from __future__ import annotations

import csv
import io
import os
import shutil
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.runtime import staged
from quillon.sources import files, ocr

Word = tuple[str, float, int, int, int, int]
Recognise = Callable[[bytes, str, int], list[Word]]


@dataclass(frozen=True)
class Engine:
    """factory: makes the function; available: asked on the driver; modes: the ways to run it; filtered: whether noise is dropped."""

    factory: Callable[[], Recognise]
    available: Callable[[], bool]
    modes: tuple[str, ...]
    filtered: bool = True


def parse_tsv(table: str) -> list[Word]:
    """Words of a recogniser's table of tab-separated values; rows without a number for their confidence count as rejected."""

    def number(x: str | None, kind: type = int, other: float = 0) -> float:
        try:
            return kind(float(x))
        except (TypeError, ValueError):
            return other

    rows = csv.DictReader(io.StringIO(table), delimiter="\t", quoting=csv.QUOTE_NONE)
    at = ("page_num", "block_num", "par_num", "line_num")
    return [(r.get("text") or "", number(r.get("conf"), float, -1.0), *(number(r.get(c)) for c in at)) for r in rows]


def languages(listing: str) -> tuple[str, str]:
    """The languages to ask for, of a listing of installed ones, and a remark where they do not suit."""
    there = set(listing.split("\n")[1:])
    for wanted in (("fra", "eng"), ("fra",)):
        if set(wanted) <= there:
            return "+".join(wanted), ""
    # The remarks.
    return "eng", "Langue OCR francaise absente; installe `tesseract-lang` pour de meilleurs resultats." if "eng" in there else "Aucune langue OCR adaptee detectee dans Tesseract."


def _tesseract() -> Recognise:
    asked, _ = languages(subprocess.run(["tesseract", "--list-langs"], capture_output=True, text=True, timeout=10).stdout)

    def run(image: bytes, mode: str, angle: int) -> list[Word]:
        done = subprocess.run(["tesseract", "stdin", "stdout", "-l", asked, "--psm", mode, "tsv"], input=turned(image, angle), capture_output=True, timeout=120)
        return parse_tsv(done.stdout.decode("utf-8", "ignore"))

    return run


def turned(image: bytes, angle: int) -> bytes:
    """The image turned by an angle; needs an imaging package, raises without one."""
    if not angle:
        return image
    from PIL import Image

    out = io.BytesIO()
    Image.open(io.BytesIO(image)).rotate(-angle, expand=True, fillcolor="white").save(out, "PNG")
    return out.getvalue()


def in_lines(texts: list[str], marks: list) -> list[Word]:
    """Words of an engine that gives a list of lines and a list of confidences."""
    mark = lambda i: float(marks[i]) if i < len(marks) and isinstance(marks[i], (int, float)) else 0.0
    return [(str(t), mark(i), 0, 0, 0, i) for i, t in enumerate(texts)]


def _rapid() -> Recognise:
    from rapidocr import RapidOCR

    model = RapidOCR()

    def run(image: bytes, mode: str, angle: int) -> list[Word]:
        got = model(turned(image, angle))
        return in_lines(list(got.txts or []), list(got.scores or []))

    return run


def paddle_words(pages: list) -> list[Word]:
    """Words of an engine whose pages are mappings, or have one as `json`, plain or to be called, maybe under `res`."""
    out: list[Word] = []
    for page in pages or []:
        told = page if isinstance(page, dict) else getattr(page, "json", {})
        told = told() if callable(told) else told
        told = told.get("res", told)
        out += in_lines(list(told.get("rec_texts") or told.get("texts") or []), list(told.get("rec_scores") or told.get("scores") or []))
    return out


def _paddle() -> Recognise:
    import numpy as np
    from paddleocr import PaddleOCR
    from PIL import Image

    model = PaddleOCR(lang="fr")
    return lambda image, mode, angle: paddle_words(model.predict(np.asarray(Image.open(io.BytesIO(turned(image, angle))).convert("RGB"))))


def _importable(name: str) -> Callable[[], bool]:
    import importlib.util

    return lambda: importlib.util.find_spec(name) is not None


#: Engines by name, in the order of preference of the packages; more can be registered.
ENGINES: dict[str, Engine] = {
    "rapidocr": Engine(_rapid, _importable("rapidocr"), ("rapid",)),
    "paddleocr": Engine(_paddle, _importable("paddleocr"), ("paddle",)),
    "tesseract": Engine(_tesseract, lambda: shutil.which("tesseract") is not None, ocr.MODES, filtered=False),
}
_SHORT = {"rapid": "rapidocr", "paddle": "paddleocr"}


def selected(env: dict[str, str] = os.environ) -> list[str]:
    """The engines to run: the one that the environment asks for, or under `auto` the first package there is and the program besides."""
    wanted = env.get("DOCUMENT_OCR_ENGINE", "auto").lower()
    there = [n for n, e in ENGINES.items() if e.available()]
    if wanted != "auto":
        return [n for n in there if n == _SHORT.get(wanted, wanted)]
    packages = [n for n in there if n != "tesseract"]
    return packages[:1] + [n for n in there if n == "tesseract"]


WORDS = "image_id string, engine string, psm string, angle int, page_num int, block_num int, par_num int, line_num int, ordinal int, text string, conf double"


def recognise(images: DataFrame, names: list[str], angles: tuple[int, ...] = (0,)) -> DataFrame:
    """Word rows of images (image_id, content) for every engine, mode and angle; segments that look like noise are left out."""
    chosen = [(n, ENGINES[n]) for n in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [(n, e, e.factory()) for n, e in chosen]
        for b in batches:
            for image, content in zip(b["image_id"], b["content"]):
                rows = []
                for n, e, engine in made:
                    for angle in angles:
                        for mode in e.modes:
                            try:
                                words = engine(bytes(content or b""), mode, angle)
                            except Exception:  # an image that an engine can't read has no candidate of it
                                continue
                            rows += [(image, n, mode, angle, *at, i, text, conf) for i, (text, conf, *at) in enumerate(words)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in WORDS.split(", ")])

    words = images.select("image_id", "content").mapInPandas(run, WORDS)
    noisy = [n for n, e in chosen if e.filtered]
    return words.filter(~(F.col("engine").isin(*noisy) & ocr.segment_is_noise("text", "conf"))) if noisy else words


def read_images(images: DataFrame, names: list[str]) -> DataFrame:
    """The best candidate of each image (image_id, content): turned images are tried only where the upright one is not good enough.

    Images on which no engine finds words have no row; rows repeated under one image_id are read once.
    """
    once = images.groupBy("image_id").agg(F.first("content").alias("content"))
    return best_of(recognise(once, names), lambda poor: recognise(once.join(poor, "image_id"), names, ocr.ANGLES))


def best_of(words: DataFrame, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The best candidate by image of word rows; `again` gives the word rows of those images (image_id) that need a second look."""
    first = staged(ocr.candidates(ocr.words_to_text(words)), "candidates")
    good = staged(ocr.best_candidate(first), "upright")
    poor = ocr.needs_rotation(good)
    second = ocr.candidates(ocr.words_to_text(again(poor)))
    return ocr.best_candidate(first.unionByName(second))


def render_pages(documents: DataFrame, dpi: int = 220) -> DataFrame:
    """(id, page_number, content) of documents (id, path, mime_type, content): an image is its only page, a PDF's pages are drawn
    where the program for it is there. Files that it can't read have no pages."""
    kinds = documents.select("id", "content", files.route("path", "mime_type").alias("kind"), files.pdf_page_estimate("content").alias("pages")).filter("kind in ('image', 'pdf') and content is not null")
    program = shutil.which("pdftoppm")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, content, kind, pages in zip(b["id"], b["content"], b["kind"], b["pages"]):
                drawn = [(i, 1, bytes(content))] if kind == "image" else []
                for n in range(1, pages + 1) if kind == "pdf" and program else ():
                    one = subprocess.run([program, "-r", str(dpi), "-png", "-f", str(n), "-l", str(n), "-", "-"], input=bytes(content), capture_output=True, timeout=120)
                    if one.returncode or not one.stdout:
                        break
                    drawn.append((i, n, one.stdout))
                yield pd.DataFrame(drawn, columns=["id", "page_number", "content"])

    return kinds.mapInPandas(run, "id string, page_number int, content binary")


# What is said of documents on which recognition found nothing to rely on.
UNRELIABLE = {"image": "OCR execute mais le texte extrait n'est pas assez fiable pour etre indexe.", "pdf": "OCR execute mais aucun texte fiable n'a ete extrait. Verifier la qualite du scan."}


def read_waiting(documents: DataFrame, names: list[str], images: DataFrame | None = None) -> DataFrame:
    """Extracted documents (id, path, mime_type, content, status, pages, ...) with those that wait for recognition read.

    `images` are their pages (id, page_number, content), by default those of render_pages(). Pages whose text is
    not to be relied on are left out; a document without any page to rely on has low quality and no pages. Without
    engines, and where no page could be drawn, a document goes on waiting.
    """
    if not names:
        return documents
    waiting = documents.filter("status = 'ocr_pending'")
    images = staged(images if images is not None else render_pages(waiting), "images")
    name = F.concat("id", F.lit("\x1f"), F.col("page_number").cast("string"))
    best = staged(read_images(images.select(name.alias("image_id"), "content"), names), "read")
    of = best.select(F.split("image_id", "\x1f")[0].alias("id"), F.split("image_id", "\x1f")[1].cast("int").alias("page_number"), "*", ocr.meaningful().alias("fit"), ocr.method_message().alias("said"))
    page = F.struct("page_number", F.substring("text", 1, files.PAGE_CHARS).alias("text"), "confidence", "quality", F.substring("raw_text", 1, files.PAGE_CHARS).alias("raw_text"), "said")
    per = of.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("fit"), page))).alias("read"), F.max("confidence").alias("any"))
    got = images.groupBy("id").agg(F.count("*").alias("drawn")).join(per, "id", "left").withColumns({"read": F.coalesce("read", F.array().cast(f"array<struct<{files.none_type()[13:-2]},said:string>>")), "any": F.coalesce("any", F.lit(0.0))})
    df = documents.join(got, "id", "left").withColumn("kind", files.route("path", "mime_type"))
    tried, found = (F.col("status") == "ocr_pending") & F.col("drawn").isNotNull(), F.size("read") > 0
    mean = F.aggregate("read", F.lit(0.0), lambda a, p: a + p["confidence"]) / F.size("read")
    quality = F.when(F.col("kind") == "image", F.col("read")[0]["quality"]).when(mean >= 0.72, "good").when(mean >= 0.45, "medium").otherwise("low")
    told = F.array_join(F.transform(F.slice("read", 1, 2), lambda p: p["said"]), " ")
    pages = F.transform("read", lambda p: F.struct(*[p[c].alias(c) for c in ("page_number", "text", "confidence", "quality", "raw_text")]))
    unreliable = F.when(F.col("kind") == "image", UNRELIABLE["image"]).otherwise(UNRELIABLE["pdf"])
    new = {
        "status": F.when(found & ((F.col("kind") == "image") | (mean >= 0.45)), "indexed").otherwise("low_quality"), "quality": F.when(found, quality).otherwise("low"),
        "confidence": F.when(found, F.round(mean, 3)).when(F.col("kind") == "image", F.col("any")).otherwise(0.0), "pages": pages, "message": F.when(found, told).otherwise(unreliable),
        "page_count": F.greatest("page_count", "drawn").cast("int"),
    }
    return df.select(*[F.when(tried, new[c]).otherwise(F.col(c)).cast(documents.schema[c].dataType).alias(c) if c in new else F.col(c) for c in documents.columns])
