"""Facts read out of document text: type, date, persons, tags, title and summary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon import lexicons as L
from quillon.functions.text import col, one_line, strip

NAME = r"[A-ZÉÈÀÂÊÎÔÛÇ][A-Za-zÀ-ÿ'-]+\s+[A-Z][A-ZÀ-Ÿ'-]{2,}"
TITLES = "(?:Dr|Docteur|Maître|Maitre)"


def _strings(values) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _any_phrase(normal: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(normal, F.lit(p))
    return out


def keywords_in(tokens: Column, rules: tuple[L.DocTypeRule, ...] = L.DOC_TYPE_RULES) -> Column:
    """The tokens that any rule asks for: the few that doc_type() then holds against each rule."""
    return F.array_intersect(tokens, _strings(dict.fromkeys([*L.TAX_WORDS, *L.ENERGY_WORDS, *(w for r in rules for w in r.keywords)])))


def doc_type(normal: Column, keywords: Column, rules: tuple[L.DocTypeRule, ...] = L.DOC_TYPE_RULES) -> Column:
    """The best rule's name: 8 points for each phrase in the folded text, 1 for each of its keywords among `keywords`, see keywords_in().

    An invoice loses to a tax notice or an energy bill. Ties go to the earlier rule; below 2 points: null.
    """
    among = lambda words: F.size(F.array_intersect(keywords, _strings(words)))
    taxed = _any_phrase(normal, L.TAX_PHRASES) | (among(L.TAX_WORDS) >= 2)
    energy = _any_phrase(normal, L.ENERGY_PHRASES) | (among(L.ENERGY_WORDS) >= 2)
    scores = []
    for i, rule in enumerate(rules):
        said = F.lit(0)
        for p in rule.phrases:
            said = said + F.contains(normal, F.lit(p)).cast("int") * 8
        s = said + among(rule.keywords)
        if rule.name == "Facture":
            s = s - taxed.cast("int") * 8 - energy.cast("int") * 14
        if rule.name == "Facture d'energie":
            s = s + (said > 0).cast("int") * 10
        scores.append(F.struct(s.alias("score"), F.lit(-i).alias("place"), F.lit(rule.name).alias("name")))
    return F.array_max(F.filter(F.array(*scores), lambda x: x["score"] >= 2))["name"]


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is no such day."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def text_date(c: str | Column) -> Column:
    """The first day/month/year in figures, else day month-name year in French, else an ISO date.

    A date in figures that does not exist ends the search without one; an unknown month name does not.
    """
    t = F.coalesce(col(c), F.lit(""))
    fig, word, iso = r"(?U)\b([0-3]?\d)[/-]([01]?\d)[/-]((?:19|20)\d{2})\b", r"(?U)\b([0-3]?\d)\s+([a-zA-ZÀ-ÿ]+)\s+((?:19|20)\d{2})\b", r"(?U)\b((?:19|20)\d{2})-([01]\d)-([0-3]\d)\b"
    months = F.create_map(*[F.lit(x) for k, v in L.MONTHS.items() for x in (k, str(v))])
    month = F.element_at(months, F.lower(F.regexp_extract(t, word, 2)))
    return (
        F.when(F.regexp_like(t, F.lit(fig)), safe_date(F.regexp_extract(t, fig, 3), F.regexp_extract(t, fig, 2), F.regexp_extract(t, fig, 1)))
        .when(F.regexp_like(t, F.lit(word)) & month.isNotNull(), safe_date(F.regexp_extract(t, word, 3), month, F.regexp_extract(t, word, 1)))
        .when(F.regexp_like(t, F.lit(iso)), safe_date(F.regexp_extract(t, iso, 1), F.regexp_extract(t, iso, 2), F.regexp_extract(t, iso, 3)))
    )


def persons(c: str | Column, most: int = 10) -> Column:
    """Up to ten names in the order of the five patterns, one for each spelling without title and case."""
    t = F.coalesce(col(c), F.lit(""))
    found = F.concat(
        F.regexp_extract_all(t, F.lit(rf"(?U)\bClient\s+({NAME})\b"), 1),
        F.regexp_extract_all(t, F.lit(rf"(?U)\b(?:Monsieur|Madame|Patient|Patiente)\s+({NAME})\b"), 1),
        F.regexp_extract_all(t, F.lit(rf"(?U)\bRedacteur\s+({TITLES}\s+{NAME})\b"), 1),
        F.regexp_extract_all(t, F.lit(rf"(?U)\b{TITLES}\s+{NAME}\b"), 0),
        F.regexp_extract_all(t, F.lit(rf"(?U)\b{NAME}\b"), 0),
    )
    tidy = F.transform(found, lambda x: F.regexp_replace(one_line(F.replace(x, F.lit(" - "), F.lit(" "))), r"^[ .,:;-]+|[ .,:;-]+$", ""))
    kept = F.filter(tidy, lambda x: ~not_a_person(x))
    key = lambda x: F.regexp_replace(F.lower(x), r"^(?:dr|docteur|maître|maitre)\s+", "")
    first = F.aggregate(
        kept,
        F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("names")),
        lambda s, x: F.when(F.array_contains(s["keys"], key(x)), s).otherwise(F.struct(F.array_append(s["keys"], key(x)).alias("keys"), F.array_append(s["names"], x).alias("names"))),
        lambda s: s["names"],
    )
    return F.slice(first, 1, most)


def not_a_person(x: Column) -> Column:
    words = F.regexp_extract_all(x, F.lit("[A-Za-zÀ-ÿ]+"), 0)
    upper = F.array_distinct(F.transform(words, lambda w: F.upper(w)))
    return (
        (F.length(x) < 4) | (F.length(x) > 60) | (F.lower(x) == "service des urgences") | F.startswith(x, F.lit("Affaire "))
        | F.exists(words, lambda w: F.length(w) > 24) | F.arrays_overlap(upper, _strings(L.NON_PERSON_TERMS))
        | ((F.upper(x) == x) & (F.size(upper) <= 2) & F.arrays_overlap(upper, _strings(L.NON_PERSON_ENDINGS)))
    )


def tags(tokens: Column, kind: Column, keywords: dict[str, tuple[str, ...]] = L.TAG_KEYWORDS, most: int = 6) -> Column:
    """Tags whose keywords occur, in lexicon order; the type in lower case goes first if it is not among them."""
    hit = F.filter(F.array(*[F.when(F.arrays_overlap(tokens, _strings(w)), F.lit(t)) for t, w in keywords.items()]), lambda x: x.isNotNull())
    low = F.lower(kind)
    return F.slice(F.when(kind.isNotNull() & (kind != "") & ~F.array_contains(hit, low), F.concat(F.array(low), hit)).otherwise(hit), 1, most)


def title(kind: Column, people: Column, day: Column, text: Column, filename: Column) -> Column:
    """Type, first person and date; where there is no more than 'Document', the first line or the file's name."""
    head = F.concat(F.coalesce(F.nullif(kind, F.lit("")), F.lit("Document")), F.when(F.size(people) > 0, F.concat(F.lit(" - "), people[0])).otherwise(""), F.when(day.isNotNull(), F.concat(F.lit(" ("), day.cast("string"), F.lit(")"))).otherwise(""))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n.]"), one_line), lambda x: F.length(x) > 3)
    first = F.get(lines, F.lit(0))
    short = F.when(F.length(first) > 137, F.concat(F.substring(first, 1, 137), F.lit("..."))).otherwise(first)
    return F.substring(F.when(head == "Document", F.coalesce(short, F.nullif(filename, F.lit("")), F.lit("Document"))).otherwise(head), 1, 140)


def summary(kind: Column, people: Column, day: Column, labels: Column, text: Column) -> Column:
    """An introduction, the themes, and the first two sentences of more than 35 characters; at most 900 characters."""
    intro = F.concat(
        F.lit("Document analyse comme "), F.coalesce(F.nullif(kind, F.lit("")), F.lit("document")),
        F.when(day.isNotNull(), F.concat(F.lit(" date du "), day.cast("string"))).otherwise(""),
        F.when(F.size(people) > 0, F.concat(F.lit(", concernant "), F.array_join(F.slice(people, 1, 3), ", "))).otherwise(""), F.lit("."),
    )
    themes = F.when(F.size(labels) > 0, F.concat(F.lit("Themes detectes: "), F.array_join(F.slice(labels, 1, 5), ", "), F.lit(".")))
    sentences = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+"), strip), lambda s: F.length(s) > 35), 1, 2)
    return F.substring(F.concat_ws(" ", intro, themes, F.array_join(sentences, " ")), 1, 900)


def confidence(distinct_tokens: Column, matter_score: Column) -> Column:
    return F.round(F.least(0.52 + F.least(distinct_tokens / F.lit(180.0), F.lit(0.22)) + F.least(matter_score, F.lit(0.16)), F.lit(0.92)), 3)
