"""Text expressions: everything but accent folding stays inside the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon import lexicons as L

TOKEN = r"[a-zA-ZÀ-ÿ0-9']+"
#: Fixed classes of the quality formula: letters and digits of any script, and common punctuation.
READABLE = r"[\p{L}\p{N}" + re.escape(L.COMMON_PUNCTUATION.replace("\n", "").replace("\r", "").replace("\t", "")).replace("/", r"\/").replace("\\ ", " ") + r"\n\r\t]"
UNREADABLE = "[^" + READABLE[1:]
WORD = r"[a-zA-ZÀ-ÿ]{2,}"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Outer white space of any kind removed."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def one_line(c: str | Column) -> Column:
    """Every run of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def tokens(c: str | Column) -> Column:
    """Lower-case tokens in order, with repeats; stop words and single characters dropped; null gives none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOKEN), 0)
    stop = F.array(*[F.lit(w) for w in L.STOP_WORDS])
    return F.filter(found, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def tokenize(text: str) -> list[str]:
    """tokens() for a value on the driver (queries)."""
    return [t for t in re.findall(TOKEN, text.lower()) if len(t) > 1 and t not in L.STOP_WORDS]


def expand(words: list[str], hints: dict[str, tuple[str, ...]] = L.SEMANTIC_HINTS) -> list[str]:
    """The words and their hints, one level deep, distinct, in a fixed order."""
    return list(dict.fromkeys([*words, *(h for w in words for h in hints.get(w, ()))]))


@F.pandas_udf(StringType())
def normalise(texts: pd.Series) -> pd.Series:
    """ASCII words: compatibility forms decomposed, marks dropped, all but letters and digits as one blank."""
    import unicodedata

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        if not t.isascii():
            t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).replace("œ", "oe").replace("æ", "ae")
        return " ".join(re.findall("[a-z0-9]+", t.lower()))

    return texts.map(one)


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _only(c: Column, others: str) -> Column:
    """How many characters are left without runs of the others: far fewer matches than counting one by one."""
    return F.length(F.regexp_replace(c, others + "+", ""))


def letters(c: Column) -> Column:
    return _only(c, r"\P{L}")


def readable(c: Column) -> Column:
    return _only(c, UNREADABLE)


def blanks(c: Column, kind: str = r"(?U)\s") -> Column:
    return F.length(c) - _only(c, kind)


def quality(c: str | Column) -> Column:
    """struct(quality, confidence): shares of readable characters, letters, blanks, and length. Null and blank: empty, 0."""
    t = strip(F.coalesce(col(c), F.lit("")))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    raw = F.least(
        0.48 * readable(t) / n + 0.22 * letters(t) / n
        + 0.1 * F.least(3 * (blanks(t) / n), F.lit(1.0)) + 0.2 * F.least(F.length(t) / F.lit(1200.0), F.lit(1.0)),
        F.lit(1.0),
    )
    label = F.when(t == "", "empty").when(raw >= 0.72, "good").when(raw >= 0.45, "medium").otherwise("low")
    return F.struct(label.alias("quality"), F.when(t == "", 0.0).otherwise(F.round(raw, 3)).alias("confidence"))


def clean(c: str | Column) -> Column:
    """Unreadable characters and all white space as single blanks."""
    return one_line(F.regexp_replace(F.regexp_replace(col(c), "\\x00", " "), UNREADABLE, " "))


def plausible(word: Column) -> Column:
    """Whether a word has the shape of one: enough vowels among its letters, not too long."""
    alpha = _count(word, r"\p{L}")
    vowels = _count(word, "[aeiouyàâäéèêëîïôöùûüœ]")
    return F.when(F.length(word) <= 2, True).when(F.length(word) > 28, False).otherwise((alpha > 0) & (vowels / alpha >= 0.18))


def semantic_score(c: str | Column, common: tuple[str, ...] = L.COMMON_WORDS) -> Column:
    """How much a text reads like language, 0 to 1; 0 without words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(WORD), 0)
    n = F.size(words)
    known = F.array(*[F.lit(w) for w in common])
    hits = F.size(F.filter(words, lambda w: F.array_contains(known, w)))
    long = F.size(F.filter(words, lambda w: F.length(w) > 22))
    raw = 0.72 * F.size(F.filter(words, plausible)) / n + 0.28 * F.least(hits / F.lit(4.0), F.lit(1.0)) - F.least(long / n, F.lit(0.4))
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(raw, F.lit(1.0))))


def looks_like_text(c: str | Column) -> Column:
    """Enough letters and readable characters to be a text line."""
    t = F.coalesce(col(c), F.lit(""))
    n = F.length(t)
    return (n >= 3) & (letters(t) >= 2) & (readable(t) / n > 0.88) & (F.regexp_like(t, F.lit(r"[ \n\r\t]")) | (n < 80))


def looks_like_pdf_literal(c: str | Column) -> Column:
    """The same for literal strings of a PDF; short ones must hold a blank."""
    t = strip(F.coalesce(col(c), F.lit("")))
    n, alpha, fit, gaps = F.length(t), letters(t), readable(t), blanks(t, r"[ \n\r\t]")
    return F.when(n < 3, False).when(n < 80, (alpha >= 2) & (fit / n > 0.9) & (gaps >= 1)).otherwise((alpha >= 8) & (fit / n > 0.86) & (gaps / n > 0.03))


def excerpt(c: str | Column, words: list[str]) -> Column:
    """Some 310 characters around the earliest place where any of the words stands (as a substring), else from the start."""
    t = col(c)
    low = F.lower(t)
    found = F.filter(F.array(*[F.locate(w, low) for w in words]) if words else F.array(F.lit(0)), lambda p: p > 0)
    at = F.coalesce(F.array_min(found), F.lit(1)) - 1
    start, end = F.greatest(at - 90, F.lit(0)), F.least(at + 220, F.length(t))
    body = one_line(F.substring(t, start + 1, end - start))
    return F.concat(F.when(start > 0, "... ").otherwise(""), body, F.when(end < F.length(t), " ...").otherwise(""))


def safe_filename(c: str | Column) -> Column:
    """A base name of safe characters, at most 160 long; blank becomes document."""
    base = strip(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"([^/]*)/*$", 1))
    return F.substring(F.regexp_replace(F.when(base == "", "document").otherwise(base), r"[^a-zA-Z0-9._ -]+", "_"), 1, 160)


def clip(c: str | Column, limit: int = 15_000, head: int = 12_000, tail: int = 3_000) -> Column:
    """A long text cut to its head and tail around a mark of omission (for prompts only)."""
    t = col(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, head), F.lit("\n[...]\n"), F.right(t, F.lit(tail)))).otherwise(t)


def label(c: str | Column, labels: dict[str, str]) -> Column:
    """A code's label; an unknown code stays itself."""
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(m, col(c)), col(c))


def stable_id(prefix: str, *keys: str | Column) -> Column:
    """prefix_ and 12 hexadecimal digits that depend on the keys alone, so retries give the same id."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(col(k).cast("string"), F.lit("\x00")) for k in keys]), 256), 1, 12))
