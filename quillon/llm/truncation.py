"""Texts cut off before their last sentence does, by word n-grams inside texts against n-grams at ends.

All in Spark SQL. A text that ends without a sentence's stop is held against the whole field: how often its
last words stand inside texts with other words behind them, and how often at an end. Two views are counted:
the words as they are but for numbers (0, dates as well, the page's own number #), and masked ones (capitalised
words as N, a word with a stop behind it as x.), so that closing lines, totals, signatures, page numbers and running
lines are learned from the corpus as n-grams that are mostly terminal; there is no list of them. The longest
view that has been seen often enough decides: trigrams first of all, longer masked n-grams before them, pairs
and single words where trigrams are too rare. A text whose last words go on nearly always is cut, one whose
last word hardly stands inside texts is cut within that word. A page whose sentence goes on is whole: the next
page begins in lower case with a word that the corpus knows behind this page's last words.

The corpus's n-grams pass a bitmap of those that are asked for before they are counted; it has a fixed size,
only spares the shuffle, and the join behind it is exact, so there is one plan at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import one_line
from quillon.operators.orphans import key_of
from quillon.runtime import checked_broadcast, staged

#: Occurrences from which an n-gram is evidence, the share of them at ends from which it closes a text, and the different texts it must close.
SEEN, CLOSING_SHARE, CLOSING_TEXTS = 6, 0.5, 3
#: A closing line as sure as that is one even at a length where cuts pile up.
SURE_SHARE = 0.9
#: Words at a text's edges that do not count as inside for masked n-grams: running lines stand there.
TOP, FOOT = 12, 8
#: A short word with a stop is an abbreviation if it ends so few of the texts' sentences.
ABBREVIATION_SHARE, ABBREVIATION_SEEN = 0.004, 60
#: A length is a limit if it occurs so many times as often as the lengths around it.
SPIKE, SPIKE_LEAST, SPIKE_NEAR = 8.0, 6, 20

DATE = r"(?<!\S)\d{1,2}(?:er|\.)? (?:de )?\p{L}+\.? (?:de |del )?\d{4}\b"
STOP = r"[.!?][\"'»”’)\]]*$"
OMISSION = r"(?:…|\.\.\.|\[\.\.\.\]|\(\.\.\.\))[\"'»”’)\]]*$"
#: The views in the order in which they decide: m masked, e as they are; the number of words. h is a masked pair with the page's own number.
VIEWS = (("m", 5), ("m", 3), ("h", 2), ("e", 3), ("e", 2), ("e", 1))
#: Characters of a text's end that its last words are taken from.
TAIL = 160
#: The bitmap: 2**15 rows of 64 words of 64 bits.
_SLOT = "shiftrightunsigned(h, 49)"
_WORD = "cast(shiftrightunsigned(h, 43) & 63 as int)"
_BIT = "cast(shiftrightunsigned(h, 37) & 63 as int)"


def numbered(text: Column, number: Column) -> Column:
    """A text on one line with dates and numbers as 0 and the page's own number as #."""
    m = F.concat(F.lit(" "), F.regexp_replace(one_line(text), DATE, "0"), F.lit(" "))
    for behind in (" ", "/"):
        own = F.replace(m, F.concat(F.lit(" "), number, F.lit(behind)), F.lit(f" #{behind}"))
        m = F.coalesce(own, m)  # no number: nothing to replace
    # Patterns begin with a plain character: lookbehinds at every place of a text cost several times as much.
    m = F.regexp_replace(m, r" [^ \d]*\d[^ ]*?(?=[.,;:!?)\]]* )", " 0")
    return F.regexp_replace(m, r"0(?: 0)+(?![^ .,;:!?)\]])", "0")


def plain(line: Column) -> Column:
    """Words of a numbered line with their punctuation, in lower case."""
    return F.split(F.lower(F.trim(line)), " ")


def masked(line: Column) -> Column:
    """Words of a numbered line with ends of sentences and capitalised words masked."""
    m = F.regexp_replace(line, r" (?:[^ .!?]{4,}|[0#%€])[)»”\]]*[.!?]+[)»”\]]* ", " x. ")
    m = F.regexp_replace(m, r"(?<!x\.) \p{Lu}[\p{L}'’-]*+(?!:)(?! :)", " N")
    return F.split(F.trim(F.regexp_replace(m, r"N(?: N)+(?!\p{L})", "N")), " ")


def bare(c: Column) -> Column:
    """A word without the marks behind it; marks alone stay."""
    marked = F.endswith(c, F.lit(","))
    for mark in ";:.!?":
        marked = marked | F.endswith(c, F.lit(mark))
    return F.when(marked, F.coalesce(F.nullif(F.rtrim(c, F.lit(",;:.!?")), F.lit("")), c)).otherwise(c)


def gram(view: str, n: int, words: Column, at: Column, last: Column) -> Column:
    """Hash of the n words up to place `at`, of which the last one is given bare."""
    kind = "e" if view == "e" else "m"
    return F.xxhash64(F.lit(f"{kind}{n}"), *[F.get(words, at - k) for k in range(n - 1, 0, -1)], last)


def _abbreviation(word: Column) -> Column:
    return F.when(F.endswith(word, F.lit(".")) & (F.length(word) <= 5), F.xxhash64(F.lit("a"), word))


def grams_inside(lines: DataFrame, top: int, foot: int) -> DataFrame:
    """(h) of all views at all places of lines (w plain, m masked) that other words follow."""
    w, m, i = F.col("w"), F.col("m"), F.col("i")
    places = lines.select("w", "m", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w"), F.size("m")) - 1)).alias("i"))
    places = places.select("w", "m", "i", bare(F.get(w, i)).alias("last_w"), bare(F.get(m, i)).alias("last_m"))
    out = [F.when((i >= n - 1) & (i < F.size(w) - 1), gram("e", n, w, i, F.col("last_w"))) for v, n in VIEWS if v == "e"]
    out += [F.when((i >= n - 1 + top) & (i < F.size(m) - 1 - foot), gram("m", n, m, i, F.col("last_m"))) for v, n in VIEWS if v == "m"]
    out += [F.when((i >= n - 1 + top) & (i < F.size(m) - 1 - foot) & F.contains("last_m", F.lit("#")), gram("m", n, m, i, F.col("last_m"))) for v, n in VIEWS if v == "h"]
    return places.select(F.explode(F.array(*out, F.when(i < F.size(w) - 1, _abbreviation(F.get(w, i))))).alias("h")).filter("h is not null")


def grams_at_end(w: Column, m: Column) -> dict[str, Column]:
    """The views of a text's last words by name; null where the text has fewer words."""
    out = {}
    for v, n in VIEWS:
        words = w if v == "e" else m
        full, last = F.size(words) >= n, F.element_at(words, -1)
        out[f"{v}{n}"] = F.when(full & F.contains(last, F.lit("#")) if v == "h" else full, gram(v, n, words, F.size(words) - 1, bare(last)))
    return out | {"a": _abbreviation(F.element_at(w, -1))}


def asked_for(grams: DataFrame, asked: DataFrame) -> DataFrame:
    """Those of grams (h, ...) that may be among asked (h), by the bitmap: all that are, and few others while it is not full."""
    words = asked.selectExpr(f"{_SLOT} slot", f"{_WORD} word", f"shiftleft(1L, {_BIT}) mask").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    rows = words.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("by")).selectExpr("slot", "transform(sequence(0, 63), i -> coalesce(by[i], 0L)) bits")
    hit = F.expr(f"shiftrightunsigned(bits[{_WORD}], {_BIT}) & 1L = 1L")
    return grams.withColumn("slot", F.expr(_SLOT)).join(F.broadcast(staged(rows, "bitmap")), "slot").filter(hit).drop("slot", "bits")  # at most 2**15 rows


def limits(lengths: DataFrame) -> DataFrame:
    """(len) of (len): lengths at which texts without a sentence end pile up, and up to three below them."""
    n = lengths.groupBy("len").agg(F.count("*").alias("n"))
    around = n.select(F.explode(F.sequence(F.col("len") - SPIKE_NEAR, F.col("len") - 4)).alias("len"), "n").groupBy("len").agg(F.sum("n").alias("below"))
    piled = n.join(around, "len", "left").filter((F.col("n") >= SPIKE_LEAST) & (F.col("n") >= SPIKE * F.coalesce("below", F.lit(0)) / (SPIKE_NEAR - 3)))
    return piled.select(F.explode(F.sequence(F.col("len") - 3, F.col("len"))).alias("len")).distinct().withColumn("at_limit", F.lit(True))


def ends_of(base: DataFrame) -> DataFrame:
    """base (tail, number, ...) with the words at the end, plain (w) and masked (m).

    A text whose last word is the page's own number comes once as it is and once without that number (bared).
    """
    tail = F.col("tail")
    lone = F.concat(F.lit(r"\s(?:[—–-] ?)?[\[(]?"), F.col("number"), F.lit(r"(?:\s?/\s?\d+)?[\])]?(?: ?[—–-])?$"))
    bared = F.nullif(F.regexp_replace(tail, lone, F.lit("")), tail)
    forms = F.when(bared.isNull(), F.array(F.struct(tail.alias("left"), F.lit(False).alias("bared")))).otherwise(F.array(F.struct(tail.alias("left"), F.lit(False).alias("bared")), F.struct(bared.alias("left"), F.lit(True).alias("bared"))))
    df = base.withColumn("form", F.explode(forms)).select(*base.columns, "form.*")
    last = lambda words: F.slice(words, F.greatest(F.size(words) - 7, F.lit(1)), 8)
    df = df.withColumn("line", numbered(F.col("left"), F.col("number")))
    return df.withColumns({"w": last(plain(F.col("line"))), "m": last(masked(F.col("line"))), "whole_left": F.regexp_like("left", F.lit(STOP))}).drop("left", "tail", "line")


def cut_records(records: DataFrame, follows: bool = False, seen: int = SEEN) -> DataFrame:
    """(record_id, evidence) of records (record_id, text[, document_id, page_number]) whose text was cut.

    evidence: omission (a mark of it), abbreviation (a stop that never ends a text), limit (cut at a length
    where many are), inside (stops where texts go on), fragment (stops within a word). Endings that the
    corpus has too rarely to tell are no cases. Null and blank texts and null ids are no cases; rows repeated
    under one id count once; very long texts are used whole. References are compared without case and outer blanks.
    """
    own = records.filter(F.col("record_id").isNotNull() & F.col("text").isNotNull())
    number = F.col("page_number").cast("string") if follows else F.lit(None).cast("string")
    placed = [key_of("document_id").alias("document"), F.col("page_number").alias("page")] if follows else []
    near = one_line(F.right(F.rtrim("text"), F.lit(TAIL)))
    tail = F.when(near == "", F.right(one_line("text"), F.lit(TAIL))).otherwise(near)
    begins = F.regexp_extract(F.left("text", F.lit(120)), r"^[\s\x{FEFF}\x{A0}]*([\p{Ll}(\d&»€%]\S*)", 1)  # a first word in lower case
    # Written once: what follows reads the texts' ends several times, and their insides once.
    base = staged(own.select("record_id", *placed, number.alias("number"), tail.alias("tail"), begins.alias("begins"), F.length("text").alias("len"), F.xxhash64("text").alias("of")).filter("tail <> ''"), "tails")
    mark = F.right("tail", F.lit(12))
    stop, omitted = F.regexp_like(mark, F.lit(STOP)), F.regexp_like(mark, F.lit(OMISSION))
    short = stop & ~omitted & F.regexp_like(mark, F.lit(r" \p{L}{1,4}\.$"))
    open_ = base.drop("begins", "of").withColumns({"omitted": omitted, "short_stop": short, "stop": stop & ~omitted}).filter("omitted or short_stop or not stop")
    key = ["record_id", "len", "omitted", "short_stop", "bared", "closed", "masked_end"]
    ends = ends_of(open_).withColumns({"closed": F.col("bared") & F.col("whole_left"), "masked_end": F.regexp_like(F.element_at("m", -1), F.lit(r"^(?:N|.*[0#].*)$"))})
    first = F.lit(None).cast("string")
    if follows:
        # Where a sentence may go on: the next page's first word, if it is in lower case.
        nexts = base.select("document", (F.col("page") - 1).alias("page"), F.col("begins").alias("first")).filter("document is not null and page is not null").groupBy("document", "page").agg(F.min("first").alias("first"))
        apart = F.coalesce("document", F.concat(F.lit("\x00"), "record_id"))  # null keys do not meet in one task
        ends = ends.withColumn("document", apart).join(nexts, ["document", "page"], "left")
        first = F.nullif(F.get(plain(numbered(F.col("first"), F.lit(None).cast("string"))), F.lit(0)), F.lit(""))
    views = grams_at_end(F.col("w"), F.col("m"))
    size = F.size("w")
    views["b3"] = F.when(first.isNotNull() & (size >= 2), F.xxhash64(F.lit("e3"), F.element_at("w", -2), F.element_at("w", -1), bare(first)))
    views["b2"] = F.when(first.isNotNull(), F.xxhash64(F.lit("e2"), F.element_at("w", -1), bare(first)))
    each = F.filter(F.array(*[F.struct(F.lit(i).alias("view"), h.alias("h")) for i, h in enumerate(views.values())]), lambda x: x["h"].isNotNull())
    judged = staged(ends.select(*key, F.when(~F.col("stop"), F.col("len")).alias("open_len"), each.alias("each")).distinct(), "judged")
    # Counts over the whole field, of those n-grams that are asked for.
    wanted = judged.select(*key, F.explode("each").alias("x")).select(*key, "x.*")
    asked = staged(wanted.select("h").distinct(), "asked")
    lines = own.select(number.alias("number"), "text").select(numbered(F.col("text"), F.col("number")).alias("line")).select(plain(F.col("line")).alias("w"), masked(F.col("line")).alias("m"))
    every = grams_inside(lines, *((TOP, FOOT) if follows else (0, 0)))
    inside = asked_for(every, asked).groupBy("h").agg(F.count("*").alias("inside"))
    at_end = grams_at_end(F.col("w"), F.col("m"))
    final = ends_of(base.select("of", "tail", "number")).select("of", F.explode(F.array_distinct(F.array(*at_end.values()))).alias("h")).filter("h is not null")
    ended = asked_for(final, asked).groupBy("h", "of").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("ends"), F.count("*").alias("texts"))
    counts = asked.join(inside, "h", "left").join(ended, "h", "left").select("h", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("inside", "ends", "texts")])
    found = wanted.join(staged(counts, "counts"), "h")
    order = {v: i for i, v in enumerate(views)}
    total, is_ = F.col("inside") + F.col("ends"), lambda *v: F.col("view").isin(*[order[x] for x in v])
    deciding = (F.col("view") < len(VIEWS)) & (total >= seen)
    per = found.groupBy(*key).agg(
        F.min(F.when(deciding, F.struct("view", (F.col("ends") / total).alias("share"), "texts"))).alias("best"),
        F.coalesce(F.max(F.when(is_("e1"), F.col("inside") <= F.col("ends"))), F.lit(False)).alias("fragment"),
        F.coalesce(F.max(F.when(is_("b3", "b2"), F.col("inside") > 0)), F.lit(False)).alias("goes_on"),
        F.coalesce(F.max(F.when(is_("a"), (total >= ABBREVIATION_SEEN) & (F.col("ends") <= ABBREVIATION_SHARE * total))), F.lit(False)).alias("abbreviation"),
    )
    piled = limits(judged.select(F.col("open_len").alias("len")).filter("len is not null"))
    per = per.join(checked_broadcast(piled), "len", "left")
    closing = (F.col("best.share") >= CLOSING_SHARE) & (F.col("best.texts") >= CLOSING_TEXTS) & (F.col("best.view") < order["e1"]) & (F.col("masked_end") | ~F.col("fragment"))
    sure = closing & (F.col("best.share") >= SURE_SHARE) & (F.col("best.view") <= order["m3"])
    evidence = (
        F.when(F.col("omitted"), "omission").when(F.col("short_stop"), F.when(F.col("abbreviation"), "abbreviation"))
        .when(F.col("closed") | F.col("goes_on") | sure, None).when(F.col("at_limit"), "limit").when(closing, None)
        .when(F.col("fragment") & ~F.col("masked_end"), "fragment").when(F.col("best.view").isNotNull(), "inside")
    )
    # With its page number or without it: a text that is whole in one form is whole.
    return (
        per.select("record_id", "len", evidence.alias("evidence")).groupBy("record_id", "len").agg(F.bool_and(F.col("evidence").isNotNull()).alias("cut"), F.min("evidence").alias("evidence"))
        .filter("cut").groupBy("record_id").agg(F.min("evidence").alias("evidence"))
    )
