"""OCR results to text: word tables, noise, scoring, choice of candidates, corrections, engine plug-ins."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon import lexicons as L
from quillon.functions import text as T

MODES = ("11", "6", "4", "3")
ANGLES = (-4, -2, 2, 4)


def words_to_text(words: DataFrame) -> DataFrame:
    """(image_id, engine, psm, angle, raw_text, words, mean_conf): words in input order, lines in page order.

    Words without text or with a negative or null confidence are left out; a candidate without words is none.
    """
    key = ["image_id", "engine", "psm", "angle"]
    line = ["page_num", "block_num", "par_num", "line_num"]
    good = words.withColumn("text", T.clean("text")).filter("text <> '' and conf >= 0").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in line})
    lines = good.groupBy(*key, *line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda w: w["text"]), " ").alias("t"), F.count("*").alias("n"), F.sum("conf").alias("c"))
    return lines.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*line, "t"))), lambda x: x["t"]), "\n").alias("raw_text"),
        F.sum("n").alias("words"), (F.sum("c") / F.sum("n")).alias("mean_conf"),
    )


def segment_is_noise(text: str | Column, confidence: str | Column) -> Column:
    """Whether a recognised segment is too short, too unlike words, or too vowel-less for its confidence."""
    t, conf = T.clean(F.coalesce(T.col(text), F.lit(""))), T.col(confidence)
    n = F.size(F.regexp_extract_all(t, F.lit("[A-Za-zÀ-ÿ0-9]+"), 0))
    letters, vowels = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(F.lower(t), F.lit("[aeiouyàâäéèêëîïôöùûüœ]"))
    return (
        (t == "") | ((conf < 0.65) & (n <= 1))
        | ((conf < 0.75) & (F.length(t) <= 4) & (F.upper(t) == t) & (letters > 0) & ~F.regexp_like(t, F.lit(r"\d")))
        | ((conf < 0.7) & (T.semantic_score(t) < 0.25)) | ((conf < 0.7) & (letters >= 5) & (vowels / letters < 0.18))
    )


def candidates(texts: DataFrame) -> DataFrame:
    """texts (raw_text, words, mean_conf, ...) with corrected text, confidence and quality."""
    mean = F.when((F.col("mean_conf") > 1) | (F.col("engine") == "tesseract"), F.col("mean_conf") / 100).otherwise(F.col("mean_conf"))
    scored = texts.withColumn("text", postprocess(F.col("raw_text"))).withColumn("semantic", T.semantic_score("text"))
    conf = F.round(0.68 * mean + 0.24 * F.col("semantic") + 0.08 * F.least(F.col("words") / F.lit(80.0), F.lit(1.0)), 3)
    return scored.withColumn("confidence", conf).withColumn("quality", F.when(F.col("confidence") >= 0.72, "good").when(F.col("confidence") >= 0.45, "medium").otherwise("low"))


def meaningful() -> Column:
    return (F.col("words") >= 8) & (F.col("confidence") >= 0.45) & (F.col("semantic") >= 0.42)


def best_candidate(cands: DataFrame) -> DataFrame:
    """Of each image the candidate of most confidence, then most words, then the first in mode order."""
    cols = [c for c in cands.columns if c != "image_id"]
    order = F.struct("confidence", "words", (-F.coalesce(F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col("psm")), F.lit(9))).alias("o"), (-F.abs("angle")).alias("a"), "engine")
    return cands.groupBy("image_id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("image_id", "r.*")


def needs_rotation(best: DataFrame) -> DataFrame:
    """Images whose best unrotated candidate is not good enough to stop at."""
    return best.filter(~((F.col("confidence") >= 0.72) & meaningful())).select("image_id")


def method_message() -> Column:
    name = F.when(F.col("engine") == "paddleocr", "PaddleOCR").when(F.col("engine") == "rapidocr", "RapidOCR").otherwise("Tesseract")
    head = F.concat(F.lit("OCR applique avec "), name, F.lit(", mode "), F.col("psm"))
    return F.when(F.col("angle") == 0, F.concat(head, F.lit("."))).otherwise(F.concat(head, F.lit(", apres correction d'inclinaison "), F.col("angle").cast("string"), F.lit(" degres.")))


def bounded_distance(a: str, b: str, most: int = 2) -> int:
    """Edit distance, most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


@functools.lru_cache(maxsize=100_000)
def correct_word(word: str) -> str:
    """A word by the table of misreadings, else by the nearest term (ties: alphabetical); a capital stays one."""
    low = word.lower()
    fixed = L.OCR_WORDS.get(low)
    if not fixed and len(low) >= 5 and low.isalpha() and low not in L.OCR_TERMS and low not in L.OCR_PROTECTED:
        near, term = min((bounded_distance(low, t), t) for t in L.OCR_TERMS)
        fixed = term if near <= 1 or (near == 2 and len(low) >= 9) else None
    if not fixed or fixed == low:
        return word
    return fixed[:1].upper() + fixed[1:] if word[:1].isupper() else fixed


#: Each phrase rule with a piece of text that must be there for it to apply.
_PHRASES = tuple((max(re.findall(r"[a-z]{3,}(?![?*a-z])|\d{3,}", p.replace("\\b", " ").replace("\\s", " ").lower()), key=len, default=""), re.compile(p, re.IGNORECASE), by) for p, by in L.OCR_PHRASES)


def phrases(text: str) -> str:
    """The phrase rules in order."""
    low = text.lower()
    for needed, pattern, by in _PHRASES:
        if needed in low and (new := pattern.sub(by, text)) != text:
            text, low = new, new.lower()
    return text


@F.pandas_udf(StringType())
def _correct(texts: pd.Series) -> pd.Series:
    find = re.compile(r"\b[A-Za-zÀ-ÿ']+\b")

    def one(t: str | None) -> str | None:
        if not t:
            return t
        t = re.sub(r"([.,;:!?])(?=[A-Za-zÀ-ÿ])", r"\1 ", re.sub(r"\s+([.,;:!?])", r"\1", phrases(t)))
        t = find.sub(lambda m: correct_word(m.group(0)), " ".join(t.split()))
        return " ".join(phrases(t).split())

    return texts.map(one)


def postprocess(c: Column) -> Column:
    """Clean, apply the phrase rules, set blanks around punctuation, correct words, apply the phrase rules again."""
    return _correct(T.clean(c))
