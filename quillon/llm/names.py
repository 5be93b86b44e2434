"""Variant spellings of names, by a pigeonhole segment join.

Names are reduced to distinct spellings first, then read as a person (family and given name or
initials) or an organisation (distinctive word, kind of business, legal form). Distinctive words are
cut into k+2 segments: two words within k edits agree in at least two of them up to shifts, so an
inverted index of pairs of segments finds every such pair of words. Two segments instead of one make the
keys half a word long: no frequent beginning or ending alone brings words together. Pairs are verified
with banded edit distances: one edit (a transposition of neighbours counts as one), two in long words.
A rare spelling is tied to the most frequent word it may stand for, given names likewise within a family;
nicknames and initials then decide which bearer of that family name is meant.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import staged

EDITS = 2
#: From this length of the longer word on two edits are accepted, below it one.
LONG = 8
#: A given name is taken for a slip of another one of its family if that one is so many times as frequent everywhere.
SLIP = 10
# Titles, legal forms, kinds of business with their abbreviations, nicknames. Parameters of a deployment.
TITLES = ("m", "mr", "mme", "mlle", "me", "maitre", "dr", "docteur", "monsieur", "madame", "mrs", "ms", "miss", "herr", "frau", "sr", "sra", "don", "dona", "prof", "pr")
LEGAL = {"sas": "sas", "sarl": "sarl", "sa": "sa", "sci": "sci", "gmbh": "gmbh", "gesellschaft mbh": "gmbh", "ltd": "ltd", "limited": "ltd", "societe": "", "ste": "", "eurl": "eurl", "snc": "snc", "ag": "ag", "sl": "sl", "inc": "inc", "llc": "llc"}
BUSINESS = {"energies": "energies", "energie": "energies", "transports": "transports", "transport": "transports", "transp": "transports", "conseil": "conseil", "cons": "conseil", "batiment": "batiment", "bat": "batiment", "distribution": "distribution", "distrib": "distribution", "associes": "associes", "fils": "fils"}
NICKNAMES = {
    "tony": "antoine", "mado": "madeleine", "will": "guillaume", "bill": "guillaume", "beb": "benoit", "olive": "olivier", "dany": "daniel", "cathy": "catherine", "gaby": "gabrielle", "mimi": "marie",
    "jo": "josephine", "fatou": "fatoumata", "manu": "emmanuelle", "domi": "dominique", "lolo": "laurent", "momo": "mohamed", "kiki": "christophe", "titi": "thibault", "yann": "yannick", "nono": "noemie",
    "phil": "philippe", "vero": "veronique", "vince": "vincent", "val": "valerie", "caro": "caroline", "max": "maxime", "jim": "james", "bob": "robert", "liz": "elisabeth", "lena": "helene", "zaza": "isabelle",
}


def fold(text: str) -> str:
    """Lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("œ", "oe").replace("æ", "ae").replace("ß", "ss")) if not unicodedata.combining(c))


def is_contact(name: str) -> bool:
    """Addresses and numbers among the persons are no names."""
    return bool(re.search(r"@|\(at\)|\d{3}|\d\D?\d\D?\d|https?:|www\.", name)) or not re.search(r"[^\W\d_]", name)


def parse(name: str) -> tuple[str, list[str], list[str], str, str] | None:
    """(kind, tokens, shapes, business, legal) of a spelling; None where there is no name in it.

    kind is person or organisation. shapes: I initials, U upper case, L other; C marks a word before a comma.
    """
    if is_contact(name):
        return None
    text = " ".join(name.split())
    text = re.sub(r"\b((?:[A-Za-z]\.){2,})", lambda m: m[1].replace(".", "") if fold(m[1].replace(".", "")) in LEGAL else m[1], text)
    low = fold(text)
    words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", low)
    legal = [LEGAL[w] for w in words if w in LEGAL]
    if "gesellschaft" in words and "mbh" in words:
        legal.append("gmbh")
    business = [BUSINESS[w] for w in words if w in BUSINESS]
    if legal or business:
        core = [w for w in words if w not in LEGAL and w not in BUSINESS and w not in ("gesellschaft", "mbh", "et", "and", "und", "y", "the")]
        if not core:
            return None
        return "organisation", ["".join(core)], [], "+".join(sorted(set(business))), next((x for x in legal if x), "")
    comma = re.match(r"^\s*([^,]+),\s*([^,]+)$", text)
    parts = re.findall(r"(?:[^\W\d_]\.-?)+(?:[^\W\d_](?![^\W\d_]))?|[^\W\d_]+(?:['’-][^\W\d_]+)*", text)
    tokens, shapes = [], []
    for p in parts:
        plain = re.sub(r"[^\w]", "", fold(p))
        if "." not in p and plain in TITLES and len(parts) > 1 and not tokens:
            continue
        if p.endswith(".") and plain in TITLES and len(parts) > 2 and not tokens:
            continue
        initial = "." in p or len(plain) == 1 or (len(plain) == 2 and p.isupper())
        tokens.append(plain if initial else re.sub(r"[’']", "", fold(p)))
        shapes.append("I" if initial else "U" if p.isupper() else "L")
    if comma and len(tokens) == 2:
        shapes[0] = "C"
    if not tokens or all(s == "I" for s in shapes):
        return None
    return "person", tokens, shapes, "", ""


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, a transposition of neighbours counting as one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        now = [most + 1] * (len(b) + 1)
        now[0] = i
        for j in range(lo, hi + 1):
            now[j] = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                now[j] = min(now[j], before[j - 2] + 1)
        if min(now[max(0, lo - 1) : hi + 1]) > most:
            return most + 1
        before, row = row, now
    return min(row[len(b)], most + 1)


def plain_distance(a: str, b: str, most: int) -> int:
    """Edits between two words, a transposition counting as two; most + 1 if there are more."""
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


def segments(length: int, k: int = EDITS) -> list[tuple[int, int]]:
    """(start, size) of k+2 segments of nearly equal size, of one letter each where there are fewer letters."""
    n, out, at = min(k + 2, length), [], 0
    for i in range(n):
        size = length // n + (i >= n - length % n)
        out.append((at, size))
        at += size
    return out


def segment_pairs(length: int, k: int = EDITS) -> list[tuple[int, int]]:
    """The pairs of segments of which one is intact in every word within k edits; words of three letters have single ones."""
    n = min(k + 2, length)
    return [(i, j) for i in range(n) for j in range(i + 1, n)] if n == k + 2 else [(i, i) for i in range(n)]


def shifts(delta: int, k: int = EDITS) -> list[tuple[int, int]]:
    """By how much two segments may stand off in a word longer by delta: the edits before, between and behind them are k together."""
    return [(s, t) for s in range(-k, k + 1) for t in range(-k, k + 1) if abs(s) + abs(t - s) + abs(delta - t) <= k]


def same_but_slips(a: str, b: str) -> bool:
    """Whether two words are one edit apart, or two in long words."""
    return distance(a, b, 1) <= 1 or (max(len(a), len(b)) >= LONG and plain_distance(a, b, EDITS) <= EDITS)


def alike_words(words: DataFrame, k: int = EDITS) -> DataFrame:
    """(a, b): different words of (word) of three letters or more that are the same but for slips, found through pairs of segments."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w in b["word"]:
                if len(w) > k:
                    cut = segments(len(w), k)
                    part = lambda i: w[cut[i][0] : cut[i][0] + cut[i][1]]  # noqa: B023, E731
                    out += [(f"{len(w)}.{i}.{j}.{part(i)}.{part(j)}", w) for i, j in segment_pairs(len(w), k)]
            yield pd.DataFrame(out, columns=["part", "a"])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = set()
            for w in b["word"]:
                for length in range(max(k + 1, len(w) - k), len(w) + 1):  # each pair once: the indexed word is not longer
                    cut, off = segments(length, k), shifts(len(w) - length, k)
                    for i, j in segment_pairs(length, k):
                        (p, n), (q, m) = cut[i], cut[j]
                        for s, t in off:
                            if p + s >= 0 and q + t + m <= len(w) and (i == j or p + s + n <= q + t):
                                out.add((f"{length}.{i}.{j}.{w[p + s : p + s + n]}.{w[q + t : q + t + m]}", w))
            yield pd.DataFrame(list(out), columns=["part", "b"])

    left = words.select("word").mapInPandas(index, "part string, a string")
    right = words.select("word").mapInPandas(probe, "part string, b string")
    # The sides' sizes are only known once Python has made them, so the join is told to shuffle.
    pairs = left.join(right.hint("merge"), "part").filter("a <> b").select("a", "b").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[same_but_slips(x, y) for x, y in zip(b["a"], b["b"])]]

    close = pairs.mapInPandas(verify, "a string, b string")
    return close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def short_for(short: str, full: str) -> bool:
    """Whether a given name may be the short form or the initials of another."""
    if short == full:
        return True
    parts = full.split("-")
    letters = "".join(p[0] for p in parts if p)
    if len(short) <= 2:
        return short == letters or full.startswith(short)
    plain = full.replace("-", "")
    if NICKNAMES.get(short) == full:
        return True
    return len(short) < len(plain) and (plain.startswith(short) or (len(short) >= 4 and short[-1] in "yi" and plain.startswith(short[:-1])))


class Fulls:
    """The two heaviest names that a short form may stand for: short_for() over many names, without comparing each with each."""

    def __init__(self) -> None:
        self.top: dict[tuple[str, str], list[tuple[float, str]]] = {}

    def add(self, full: str, weight: float) -> None:
        plain = full.replace("-", "")
        keys = {("i", "".join(p[0] for p in full.split("-") if p)), ("i", full[:1]), ("i", full[:2]), ("n", full)}
        keys |= {("p", plain[:n]) for n in range(3, len(plain))} | {("y", plain[:n]) for n in range(3, len(plain) - 1)}
        for k in keys:
            self.top[k] = sorted([*self.top.get(k, ()), (weight, full)], reverse=True)[:3]  # one of them may be the short form itself

    def of(self, short: str) -> list[tuple[float, str]]:
        """Up to two (weight, name), heaviest first, without the short form itself."""
        if not short:
            return []
        if len(short) <= 2:
            keys = [("i", short)]
        else:
            keys = [("p", short), ("n", NICKNAMES.get(short, ""))] + ([("y", short[:-1])] if len(short) >= 4 and short[-1] in "yi" else [])
        return sorted({x for k in keys for x in self.top.get(k, ()) if x[1] != short}, reverse=True)[:2]


def spellings(values: DataFrame) -> DataFrame:
    """(name, n, kind, tokens, shapes, business, legal) of the distinct spellings of (name)."""
    distinct = values.filter("name is not null").groupBy("name").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(name, n, *p) for name, n in zip(b["name"], b["n"]) if (p := parse(name))]
            yield pd.DataFrame(rows, columns=["name", "n", "kind", "tokens", "shapes", "business", "legal"])

    return distinct.mapInPandas(run, "name string, n bigint, kind string, tokens array<string>, shapes array<string>, business string, legal string")


def read_persons(parsed: DataFrame) -> DataFrame:
    """(name, n, word, given): family and given name of each person; given is empty where there is none.

    Upper case, a comma or initials tell which is the family name; where they do not, the word that other
    spellings show as a given name more often is one.
    """
    people = parsed.filter("kind = 'person'")
    shown = people.filter((F.size("tokens") == 2) & (F.array_join(F.col("shapes"), "").isin("UL", "LU", "CL", "CU")))
    family = F.when(F.get("shapes", F.lit(0)).isin("U", "C"), F.lit(0)).otherwise(F.lit(1))
    votes = shown.select(F.explode(F.array(F.struct(F.get("tokens", family).alias("t"), F.lit(0).alias("g")), F.struct(F.get("tokens", 1 - family).alias("t"), F.lit(1).alias("g")))).alias("v"), "n")
    given_votes = votes.groupBy("v.t").agg(F.sum(F.when(F.col("v.g") == 1, F.col("n")).otherwise(-F.col("n"))).alias("vote"))
    each = people.select("name", "n", F.posexplode(F.arrays_zip("tokens", "shapes")).alias("at", "x")).select("name", "n", "at", F.col("x.tokens").alias("t"), F.col("x.shapes").alias("s"))
    scored = each.join(given_votes, "t", "left").withColumn("vote", F.coalesce("vote", F.lit(0)))
    # The family name is the word of least rank: marked by a comma, then no initial, then upper case beside other words, then least often a given name, then last.
    mixed = F.size(F.array_distinct(F.transform(F.filter("all", lambda x: x["s"] != "I"), lambda x: x["s"]))) > 1
    rank = lambda x: F.struct(
        F.when(x["s"] == "C", 0).otherwise(1).alias("c"), F.when(x["s"] == "I", 1).otherwise(0).alias("i"), F.when(mixed & (x["s"] == "U"), 0).otherwise(1).alias("u"), x["vote"].alias("v"), (-x["at"]).alias("p"), x["t"].alias("t"),
    )
    joined = scored.groupBy("name", "n").agg(F.sort_array(F.collect_list(F.struct("at", "t", "s", "vote"))).alias("all"))
    best = joined.withColumn("best", F.array_min(F.transform("all", rank)))
    given = F.array_join(F.transform(F.filter("all", lambda x: x["at"] != -F.col("best.p")), lambda x: x["t"]), "-")
    return best.select("name", "n", F.col("best.t").alias("word"), given.alias("given"))


def anchors(bearers: DataFrame) -> DataFrame:
    """(word, anchor) of (word, context, n): the word itself, or the most frequent word within the edits that shares its context and is more frequent."""
    n = staged(bearers.groupBy("word").agg(F.sum("n").alias("n")), "words")
    close = staged(alike_words(n), "alike")  # small tables, written so that the plan does not repeat the join
    ctx = bearers.select("word", F.explode("contexts").alias("context")).distinct()
    shared = close.join(ctx.select(F.col("word").alias("a"), "context"), "a").join(ctx.select(F.col("word").alias("b"), "context"), ["b", "context"]).select("a", "b").distinct()
    ranked = shared.join(n.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b").filter("nb > na or (nb = na and b < a)")
    best = staged(ranked.groupBy("a").agg(F.max_by("b", F.struct("nb", "b")).alias("anchor")).select(F.col("a").alias("word"), "anchor"), "best")
    # An anchor may itself be anchored: followed to the end; every step leads to a more frequent word, or to a smaller one.
    while True:
        on = best.select(F.col("word").alias("anchor"), F.col("anchor").alias("further"))
        step = staged(best.join(on, "anchor", "left").select("word", F.coalesce("further", "anchor").alias("anchor"), F.col("further").isNotNull().alias("moved")), "best")
        best = step.select("word", "anchor")
        if step.filter("moved").isEmpty():
            break
    return n.select("word").join(best, "word", "left").select("word", F.coalesce("anchor", "word").alias("anchor"))


def given_slips(placed: DataFrame) -> DataFrame:
    """(anchor, given, meant) of placed (anchor, given, n): given names that are a slip of a much more frequent one of the same family."""
    forms = placed.filter("length(given) >= 4").groupBy("anchor", "given").agg(F.sum("n").alias("n"))
    total = staged(forms.groupBy(F.col("given").alias("word")).agg(F.sum("n").alias("n")), "given")
    close = staged(alike_words(total), "alike")
    side = lambda c: total.select(F.col("word").alias(c), F.col("n").alias(f"n{c}"))
    much = close.join(side("a"), "a").join(side("b"), "b").filter(F.col("nb") >= SLIP * F.col("na"))
    there = forms.select("anchor", F.col("given").alias("b"))
    found = forms.select("anchor", F.col("given").alias("a")).join(much, "a").join(there, ["anchor", "b"])
    return found.groupBy("anchor", F.col("a").alias("given")).agg(F.max_by("b", F.struct("nb", "b")).alias("meant"))


def entities(values: DataFrame) -> DataFrame:
    """(name, entity, kind, n): the spellings of (name) with the entity each one means.

    Names in equal letters are one spelling; nulls, blanks and contact data are left out. Initials that
    several bearers of a family name share go to the one named most often if that is at least three times
    as often as the next; else they stand for themselves.
    """
    parsed = staged(spellings(values), "spellings")
    people = staged(read_persons(parsed), "people")
    contexts = F.when(F.col("given") == "", F.array(F.lit("?"))).otherwise(F.array(F.substring("given", 1, 1)))
    nick = F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv])
    contexts = F.array_distinct(F.concat(contexts, F.coalesce(F.array(F.substring(F.element_at(nick, F.col("given")), 1, 1)), F.array().cast("array<string>"))))
    family = anchors(people.select("word", contexts.alias("contexts"), "n"))
    placed = staged(people.join(family, "word"), "placed")
    placed = staged(placed.join(given_slips(placed), ["anchor", "given"], "left").withColumn("given", F.coalesce("meant", "given")).drop("meant"), "placed")
    forms = staged(placed.groupBy("anchor", "given").agg(F.sum("n").alias("n")), "forms")

    def resolve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Which full given name each form of one family name means."""
        n = dict(zip(group["given"], group["n"]))
        every, fulls, heads = Fulls(), Fulls(), Fulls()
        long = lambda g: len(g.replace("-", "")) > 2
        for g in n:
            if long(g):
                every.add(g, 0)
        full = {g for g in n if long(g) and not every.of(g)}
        for g in full:
            fulls.add(g, n[g])
        top = sorted(((n[g], g) for g in full), reverse=True)[:2]  # for names without a given one
        means, alone = {}, []
        for g in n:
            fits = [] if g in full else fulls.of(g) if g else top
            means[g] = fits[0][1] if fits and (len(fits) == 1 or fits[0][0] >= 3 * fits[1][0]) else g
            if means[g] == g and g not in full and g:
                alone.append(g)
        # Short forms without a full one (initials and nicknames alone) meet where they fit each other.
        for g in sorted(alone, key=lambda g: (-len(g), g)):
            fit = heads.of(g)
            if len(fit) == 1:
                means[g] = fit[0][1]
            else:
                heads.add(g, 0)
        return pd.DataFrame([(key[0], g, m) for g, m in means.items()], columns=["anchor", "given", "bearer"])

    bearers = forms.groupBy("anchor").applyInPandas(resolve, "anchor string, given string, bearer string")
    persons = placed.join(bearers, ["anchor", "given"]).select("name", F.concat_ws("|", F.lit("person"), "anchor", "bearer").alias("entity"), F.lit("person").alias("kind"), "n")
    firms = parsed.filter("kind = 'organisation'").select("name", "n", F.get("tokens", F.lit(0)).alias("word"), "business", "legal")
    firm_anchor = anchors(firms.select("word", F.array("business").alias("contexts"), "n"))
    firms = staged(firms.join(firm_anchor, "word"), "firms")
    # A form without a legal form takes the most frequent one of its name.
    legal = firms.filter("legal <> ''").groupBy("anchor", "business", "legal").agg(F.sum("n").alias("m"))
    top = legal.groupBy("anchor", "business").agg(F.max_by("legal", F.struct("m", "legal")).alias("usual"))
    organisations = firms.join(top, ["anchor", "business"], "left").select(
        "name", F.concat_ws("|", F.lit("organisation"), "anchor", "business", F.coalesce(F.nullif("legal", F.lit("")), "usual", F.lit(""))).alias("entity"), F.lit("organisation").alias("kind"), "n"
    )
    return persons.unionByName(organisations)


def variant_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a smaller: different spellings of one entity. An entity of many spellings is paired in parts."""
    n = linked.select("entity", "name").distinct()
    many = n.groupBy("entity").agg(F.count("*").alias("c")).filter("c > 1").withColumn("parts", F.ceil(F.col("c") / 1000).cast("int")).drop("c")
    n = n.join(many, "entity")
    left = n.select("entity", F.col("name").alias("name_a"), F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"))
    right = n.select("entity", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["entity", "part"]).filter("name_a < name_b").select("name_a", "name_b").distinct()
