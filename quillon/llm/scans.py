"""Text of scanned pages as continuous paragraphs: running lines, page numbers, split words, misread characters.

Lines at page edges that recur within their document, but for misread characters (folded, then up to
two edits) and numbers, are running headers or footers; lines that hold the page's number, or a number that runs on with
the document's pages, are page numbers. Words split at a line
end are joined where the corpus vocabulary knows the joined word better than the one with a hyphen.
Misread words are mostly those that occur no more often in clean pages than in scanned ones and that a known confusion of characters
turns into a much more frequent word of the corpus. All counts are of the whole corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.runtime import checked_broadcast, staged

#: Confusions of character recognition: what is read, what stands there. A parameter of the operators.
CONFUSIONS = (
    ("c", "e"), ("l", "i"), ("f", "t"), ("@", "a"), ("5", "s"), ("0", "o"), ("ii", "u"), ("cl", "d"), ("rn", "m"), ("1", "l"), ("1", "i"), ("6", "é"), ("6", "b"),
    ("y", "v"), ("q", "g"), ("li", "h"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("m", "rn"), ("im", "nn"), ("d", "cl"), ("é", "è"), ("8", "b"), ("9", "g"), ("vv", "w"), ("tl", "d"),
)
#: How much more frequent the right word must be, and how frequent at least.
RATIO, LEAST = 8, 5
#: From this ratio and word length on a word is a misreading wherever it stands.
SURE_RATIO, SURE_LENGTH = 300, 6
SALTS = 16
WORD = r"[\p{L}\p{N}@]+"
HYPHENS = "-‐‑­"
NUMBER_LINE = r"^[\s\[({—–-]*(?:\p{L}{1,8}\.?[  ]?)?(\d{1,4})(?:[  ]?(?:/|sur|de|of|von)[  ]?\d{1,4})?[\s\])}.—–-]*$"


def fold(c: Column) -> Column:
    """A line's form without numbers, marks and the differences that misreading makes."""
    c = F.regexp_replace(F.lower(c), r"(?<!\S)\S*\d\S*\d\S*(?!\S)|(?<!\S)[\[({—–-]*\d[\])}.—–-]*(?!\S)", "#")
    c = F.translate(c, "àâäáãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    c = F.translate(F.replace(F.replace(c, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), "01568@9icbqyf", "olseeagleegvt")
    for whole, parts in (("d", "el"), ("m", "rn"), ("h", "ll"), ("u", "ll"), ("w", "vv")):
        c = F.replace(c, F.lit(whole), F.lit(parts))
    return F.regexp_replace(c, r"[^\p{L}#&/]+", "")


def source_lines(pages: DataFrame) -> DataFrame:
    """(id, document_id, page_number, lines): raw_text, else text, as lines; one row per id."""
    src = F.coalesce(F.col("raw_text"), F.col("text"))
    rows = pages.filter(F.col("id").isNotNull() & src.isNotNull()).groupBy("id").agg(F.min(F.struct("document_id", "page_number", src.alias("src"))).alias("r")).select("id", "r.*")
    return rows.select("id", "document_id", "page_number", F.split("src", r"\r?\n|\f|\r").alias("lines"))


def number_sequences(numbered: DataFrame) -> DataFrame:
    """(id, counted_at) of numbered (id, document_id, page_number, odd: struct(place, value) of numbers at the edges that are not the page's).

    Numbers that stand the same distance from page_number on two or more pages of a document run on with
    its pages: they are page numbers of another count, places are given for those.
    """
    each = numbered.filter("document_id is not null and page_number is not null").select("id", "document_id", "page_number", F.explode("odd").alias("o")).select("id", "document_id", F.col("o.place").alias("place"), (F.col("o.value") - F.col("page_number")).alias("off"))
    runs = each.groupBy("document_id", "off").agg(F.count_distinct("id").alias("n")).filter("n > 1").select("document_id", "off")
    salted = runs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # one document may hold a third of the pages
    return each.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(salted, ["document_id", "off", "salt"]).groupBy("id").agg(F.sort_array(F.collect_set("place")).alias("counted_at"))


def edges(lines: DataFrame) -> DataFrame:
    """lines with top, foot (places of the first and last line that is no page number) and number_at (places of page numbers).

    A page number is the page's own, or one of a sequence that runs on with the document's pages; without a
    page_number every number on a line of its own at an edge is one.
    """
    at = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.regexp_like(F.get("lines", i), F.lit(r"\S")))
    df = lines.withColumn("at", at).withColumn("near", F.array_distinct(F.concat(F.slice("at", 1, 2), F.slice(F.reverse("at"), 1, 2))))
    numbers = F.filter(F.transform("near", lambda i: F.struct(i.alias("place"), F.regexp_extract(F.get("lines", i), NUMBER_LINE, 1).try_cast("int").alias("value"))), lambda x: x["value"].isNotNull())
    df = staged(df.withColumn("numbers", numbers).drop("near"), "lines")  # read twice: for sequences and for what follows
    own = lambda x: F.col("page_number").isNull() | (x["value"] == F.col("page_number"))
    odd = df.select("id", "document_id", "page_number", F.filter("numbers", lambda x: ~own(x)).alias("odd")).filter("size(odd) > 0")
    counted = checked_broadcast(staged(number_sequences(odd), "sequences"))
    none = F.array().cast("array<int>")
    df = df.join(counted, "id", "left").withColumn("number_at", F.array_union(F.transform(F.filter("numbers", own), lambda x: x["place"]), F.coalesce("counted_at", none)))
    free = F.array_except("at", "number_at")
    return df.withColumn("free", free).withColumn("top", F.get("free", F.lit(0))).withColumn("foot", F.when(F.size("free") > 1, F.element_at("free", -1))).drop("free", "at", "numbers", "counted_at")


def alike_forms(singles: DataFrame, others: DataFrame) -> DataFrame:
    """(document_id, side, form) of singles that are within a few edits (one from 8 characters, two from 16) of another form of their document and side.

    Segment join: a form cut into three has one part unchanged in any form two edits away, at most two places off.
    """
    cut = lambda n, i, off="0": f"substring(form, cast({i} * {n} div 3 as int) + {off} + 1, cast(({i} + 1) * {n} div 3 as int) - cast({i} * {n} div 3 as int))"
    key = lambda n, i, part: f"xxhash64(document_id, side, {n}, {i}, {part})"
    parts = F.expr(f"transform(sequence(0, 2), i -> {key('length(form)', 'i', cut('length(form)', 'i'))})")
    asked = F.expr(f"array_distinct(flatten(transform(sequence(length(form) - 2, length(form) + 2), n -> flatten(transform(sequence(0, 2), i -> transform(sequence(-2, 2), s -> {key('n', 'i', cut('n', 'i', 's'))}))))))")
    cols, long = ["document_id", "side", "form"], F.length("form") >= 8
    left = singles.filter(long).select(*cols, F.explode(asked).alias("h"))
    right = others.filter(long).select(F.col("document_id").alias("_d"), F.col("side").alias("_s"), F.col("form").alias("_f"), F.explode(parts).alias("h"))
    most = F.when(F.least(F.length("form"), F.length("_f")) >= 16, 2).otherwise(1)
    same = (F.col("document_id") == F.col("_d")) & (F.col("side") == F.col("_s")) & (F.col("form") != F.col("_f"))
    return left.join(right, "h").filter(same).filter(F.levenshtein("form", "_f", 2).between(1, most)).select(*cols).distinct()


def running_lines(pages: DataFrame) -> DataFrame:
    """pages of edges() with header_at: places of the edge lines that recur on two or more pages of their document."""
    # A header is no part of a sentence: it ends without a mark, and what follows one at the top begins anew.
    free = lambda side: ~F.regexp_like(F.get("lines", F.col(side)), F.lit(r"[.!?,;:…‐­-]\s*$")) & (F.lit(side != "top") | ~F.regexp_like(F.coalesce(F.get("lines", F.col(side) + 1), F.lit("")), F.lit(r"^\s*\p{Ll}")))
    # A blank line parts it from the text: asked for where only an alike form recurs, as first lines of pages nearly alike are alike, too.
    apart = lambda side: F.regexp_like(F.coalesce(F.get("lines", F.col(side) + (1 if side == "top" else -1)), F.lit("")), F.lit(r"^\s*$"))
    line = lambda side: F.struct(F.lit(side).alias("side"), F.when(free(side), F.col(side)).alias("place"), fold(F.get("lines", F.col(side))).alias("form"), apart(side).alias("apart"))
    ends = pages.select("id", "document_id", F.explode(F.array(line("top"), line("foot"))).alias("e")).select("id", "document_id", "e.*").filter("place is not null and length(form) >= 4 and document_id is not null")
    forms = staged(ends.groupBy("document_id", "side", "form").agg(F.count("*").alias("n"), F.max("apart").alias("apart")), "forms")
    often, singles, cols = forms.filter("n > 1").drop("n", "apart"), forms.filter("n = 1 and apart").drop("n", "apart"), ["document_id", "side", "form"]
    # Misread past the fold: first held against the recurring forms, so that only what is left is compared among itself.
    near = staged(alike_forms(singles, often), "near")
    rest = singles.join(near, cols, "left_anti")
    salted = often.unionByName(near).unionByName(alike_forms(rest, rest)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # one document may hold a third of the pages
    marked = ends.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(salted, ["document_id", "side", "form", "salt"]).groupBy("id").agg(F.sort_array(F.collect_set("place")).alias("header_at"))
    return pages.join(marked, "id", "left").withColumn("header_at", F.coalesce("header_at", F.array().cast("array<int>")))


def bodies(pages: DataFrame) -> DataFrame:
    """(id, document_id, page_number, has_header, has_number, body): the lines left when running lines and numbers are gone."""
    keep = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.concat("header_at", "number_at"), s["i"]))
    return pages.select("id", "document_id", "page_number", (F.size("header_at") > 0).alias("has_header"), (F.size("number_at") > 0).alias("has_number"), F.array_join(F.transform(keep, lambda s: s["x"]), "\n").alias("body"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, clean, scanned): how often each word stands in pages with a text layer and in scanned ones, from (text, is_scan)."""
    return texts.select("is_scan", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)).alias("word")).groupBy("word").agg(F.count_if(~F.col("is_scan")).alias("clean"), F.count_if("is_scan").alias("scanned"))


def readings(word: str, confusions=CONFUSIONS, depth: int = 2) -> set[str]:
    """What a word may have been before up to `depth` confusions: some thousands of readings for 40 equal letters, some hundred for words."""
    front, seen = {word}, {word}
    for _ in range(depth):
        new = set()
        for w in front:
            for wrong, right in confusions:
                i = w.find(wrong)
                while i >= 0:
                    new.add(w[:i] + right + w[i + len(wrong) :])
                    i = w.find(wrong, i + 1)
        front = new - seen
        seen |= front
    return {w for w in seen if w != word and not re.search(r"[\d@]", w)}


def misreadings(words: DataFrame, confusions=CONFUSIONS) -> DataFrame:
    """(wrong, right): words of scans that a confusion turns into a word much more frequent; the most frequent one counts."""
    rare = words.filter(((F.col("clean") <= F.col("scanned")) | (F.length("word") >= SURE_LENGTH)) & F.length("word").between(3, 40) & ~F.regexp_like("word", F.lit(r"\d.*\d.*\d")) & F.regexp_like("word", F.lit(r"\p{L}")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(w, n, s, r) for w, n, s in zip(b["word"], b["n"], b["mostly_scanned"]) for r in readings(w, confusions)]
            yield pd.DataFrame(out, columns=["wrong", "n", "mostly", "right"])

    frequent = words.filter((F.col("clean") > 0) & (F.col("clean") + F.col("scanned") >= LEAST)).select(F.col("word").alias("right"), (F.col("clean") + F.col("scanned")).alias("m"))
    hits = rare.select("word", (F.col("clean") + F.col("scanned")).alias("n"), (F.col("clean") <= F.col("scanned")).alias("mostly_scanned")).mapInPandas(run, "wrong string, n bigint, mostly boolean, right string").join(frequent, "right").filter(F.col("m") >= F.when(F.col("mostly"), RATIO).otherwise(SURE_RATIO) * F.col("n"))
    return hits.groupBy("wrong").agg(F.max_by("right", F.struct("m", "right")).alias("right"))


def _splits(body: Column) -> Column:
    """Pairs (first, second) of word parts around a hyphen at a line's end."""
    pattern = r"(\p{L}+)[" + HYPHENS + r"][ \t]*\n\s*(\p{L}+)"
    whole = F.regexp_extract_all(body, F.lit(pattern), 0)
    return F.transform(whole, lambda x: F.struct(F.lower(F.regexp_extract(x, pattern, 1)).alias("first"), F.lower(F.regexp_extract(x, pattern, 2)).alias("second"), (F.regexp_like(x, F.lit("^\\p{L}+-"))).alias("plain"), F.regexp_like(F.regexp_extract(x, pattern, 2), F.lit(r"^\p{Ll}")).alias("low")))


def analyse(pages: DataFrame, scanned: Column) -> dict[str, DataFrame]:
    """Tables of one pass over the corpus: bodies, splits (id, first, second, joined) and misread (id, wrong, right).

    pages needs id, document_id, page_number, text, raw_text and what `scanned` reads. Null and blank pages
    have no findings; rows repeated under one id count once; a page without document has no running lines.
    """
    body = staged(bodies(running_lines(edges(source_lines(pages.filter(scanned))))), "bodies")
    texts = pages.filter(~scanned).select(F.coalesce("text", "raw_text").alias("text"), F.lit(False).alias("is_scan")).filter("text is not null").unionByName(body.select(F.col("body").alias("text"), F.lit(True).alias("is_scan")))
    words = staged(vocabulary(texts), "words")
    # Words split at line ends: joined if the vocabulary knows the whole word, or neither form and the second part is in lower case.
    parts = body.select("id", F.explode(_splits(F.col("body"))).alias("s")).select("id", "s.*").distinct()
    asked = parts.select("first", "second").distinct()
    pair = F.regexp_extract_all(F.lower("text"), F.lit(r"(?=(\p{L}+-\p{L}+))(?<!\p{L})"), 1)
    hyphenated = texts.filter(F.contains("text", F.lit("-"))).select(F.explode(pair).alias("pair")).groupBy("pair").agg(F.count("*").alias("own"))
    known = (
        asked.withColumn("pair", F.concat("first", F.lit("-"), "second")).join(hyphenated, "pair", "left")
        .withColumn("word", F.concat("first", "second")).join(words.select("word", (F.col("clean") + F.col("scanned")).alias("whole")), "word", "left")
        .select("first", "second", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("whole", F.lit(0)).alias("whole"))
    )
    splits = parts.join(known, ["first", "second"]).withColumn("joined", ((F.col("whole") > F.col("own")) | ((F.col("own") == 0) & F.col("low"))))
    wrong = staged(misreadings(words), "misreadings")
    said = body.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(WORD), 0))).alias("wrong"))
    misread = said.join(checked_broadcast(wrong), "wrong").select("id", "wrong", "right")
    return {"bodies": body, "splits": splits.select("id", "first", "second", "joined"), "misread": misread}


def findings(tables: dict[str, DataFrame]) -> DataFrame:
    """(page_id, kind) with kind hyphen, misread, header or page_number."""
    b = tables["bodies"]
    kinds = [
        tables["splits"].filter("joined").select(F.col("id").alias("page_id"), F.lit("hyphen").alias("kind")),
        tables["misread"].select(F.col("id").alias("page_id"), F.lit("misread").alias("kind")),
        b.filter("has_header").select(F.col("id").alias("page_id"), F.lit("header").alias("kind")),
        b.filter("has_number").select(F.col("id").alias("page_id"), F.lit("page_number").alias("kind")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.distinct()


def rebuild(body: str, splits: list, misread: list) -> str:
    """A page's lines as paragraphs, split words joined and misread words replaced."""
    joined = {(s["first"], s["second"]): s["joined"] for s in splits}
    right = {m["wrong"]: m["right"] for m in misread}

    def join(m: re.Match) -> str:
        key = (m[1].lower(), m[2].lower())
        return m[1] + m[2] if joined.get(key, m[2][:1].islower()) else f"{m[1]}-{m[2]}"

    text = re.sub(rf"([^\W\d_]+)[{HYPHENS}][ \t]*\n\s*([^\W\d_]+)", join, body)

    def fix(m: re.Match) -> str:
        r = right.get(m[0].lower())
        if not r:
            return m[0]
        return r.upper() if m[0].isupper() and len(m[0]) > 1 else r[:1].upper() + r[1:] if m[0][:1].isupper() else r

    if right:
        text = re.sub(r"[^\W_@]+(?:@[^\W_]+)*@?|@[^\W_]+", fix, text)
    out: list[str] = []
    for line in re.split(r"\r?\n|\r|\f", text):
        line = " ".join(line.split())
        if not line:
            if out and out[-1] and re.search(r"[.!?:»\")]$", out[-1]):
                out.append("")  # a paragraph ends where a sentence does
            continue
        if out and out[-1]:
            out[-1] += " " + line
        else:
            out.append(line)
    return "\n\n".join(x for x in out if x)


def paragraphs(tables: dict[str, DataFrame]) -> DataFrame:
    """(page_id, text): every scanned page as continuous paragraphs."""
    splits = tables["splits"].groupBy("id").agg(F.collect_list(F.struct("first", "second", "joined")).alias("splits"))
    misread = tables["misread"].groupBy("id").agg(F.collect_list(F.struct("wrong", "right")).alias("misread"))
    both = tables["bodies"].select("id", "body").join(splits, "id", "left").join(misread, "id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed = lambda x: list(x) if x is not None else []
        for b in batches:
            yield pd.DataFrame({"page_id": b["id"], "text": [rebuild(t, listed(s), listed(m)) for t, s, m in zip(b["body"], b["splits"], b["misread"])]})

    return both.mapInPandas(run, "page_id string, text string")
