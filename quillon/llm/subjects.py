"""Subject areas of documents by class-association rules.

A bounded sample of labelled documents is cut into sentences; a sentence's words and word pairs that
lean to some subject are its items. Parallel frequent-pattern growth mines itemsets with a subject;
a rule is kept if no part of it is as sure of the same subject. Each rule's confidence is shrunk
towards the subject's prior by its support (calibration). A first set of rules assigns the sample's
sentences to subjects, a second set is mined from those assigned sentences: documents of several
subjects and stray sentences then no longer blur the rules. Every sentence of every document is scored
by the evidence of its matching rules, and a document has the subjects of at least a quarter of its
subject-bearing sentences.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import staged

#: Bound of the labelled sample, in documents; chosen by a hash of the id, the same at every size.
SAMPLE = 20_000
SHARE = 0.25
LEAST_LEAN, LEAST_CONFIDENCE, MAX_ITEMS = 0.6, 0.65, 3
#: Least sentences and documents of an item: numbers, and shares of the sample.
LEAST_SUPPORT, LEAST_DOCS, LEAST_SUPPORT_SHARE, LEAST_DOCS_SHARE = 3, 2, 5e-5, 5e-4
#: Items of a basket of pattern growth.
BASKET = 12
#: Sentences by which rates are smoothed, and the evidence from which a sentence bears a subject.
SMOOTHING, BEARING = 20.0, 0.6
# Frequent function words tell a sentence's language, within which subjects are weighed.
FUNCTION_WORDS = {
    "fr": "le la les des du une est pour avec dans sur par qui que au aux ne pas sans et ce cette ou son sa",
    "en": "the of and to in for with on was were has have this that not nor from before by is are our",
    "de": "der die das und ist den dem des mit für von zu auf nicht wird wurde sowie als bei im am auch ob ohne",
    "es": "el la los las de del y en con por para una que se no sin según al su este ni desde",
}
_CLASS, NONE = "class=", "-"

#: The mark between the pages of a document's text.
_PAGE_MARK = re.compile(r"--- Page \d+ ---")
_SPLIT = re.compile(r"[-‐‑­]\s+(?=[a-zà-ÿœ])")
_END = re.compile(r"[.!?…]+[\"»)]?\s+(?=[^a-zà-ÿ])")
_ABBREVIATION = re.compile(r"(?:^|[\s.(])(?:[A-ZÀ-Ý]|Dr|Mr|Ms|Sr|Mrs|Sra|Ref|Réf|Tél)$")
_TOKEN = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text as lower-case words. Running lines stay: they lean to no subject, so that they weigh nothing."""
    if not text:
        return []
    if "--- Page" in text:
        text = _PAGE_MARK.sub(". ", text)
    text = _SPLIT.sub("", text)
    out, at = [], 0
    for m in _END.finditer(text):
        if text[m.start()] == "." and _ABBREVIATION.search(text, max(at, m.start() - 6), m.start()):
            continue
        out.append(text[at : m.start()])
        at = m.end()
    out.append(text[at:])
    return [w for x in out if (w := _TOKEN.findall(x.lower()))]


def items_of(words: list[str]) -> set[str]:
    """Words of three letters or more, and pairs of neighbouring ones with what stands between."""
    out = {w for w in words if len(w) > 2}
    out.update(f"{a} {b}" for a, b in zip(words, words[1:]) if len(a) > 1 or len(b) > 1)
    return out


_TONGUES = {g: frozenset(w.split()) for g, w in FUNCTION_WORDS.items()}


def language(words: list[str]) -> str:
    """The language with most function words in a sentence; fr before the others on a tie, und without any."""
    n = {g: sum(w in known for w in words) for g, known in _TONGUES.items()}
    best = max(n, key=lambda g: n[g])
    return best if n[best] else "und"


@dataclass
class Rules:
    """Rules (items, subject, confidence), to be matched against the items of a sentence."""

    rows: list[tuple[tuple[str, ...], str, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.single: dict[str, list[tuple[str, float]]] = defaultdict(list)
        self.several: dict[str, list[tuple[frozenset, str, float]]] = defaultdict(list)
        for items, subject, confidence in self.rows:
            if len(items) == 1:
                self.single[items[0]].append((subject, confidence))
            else:
                self.several[min(items, key=lambda x: (-len(x), x))].append((frozenset(items), subject, confidence))
        known = set(self.single) | set(self.several)
        self.words = {i for i in known if " " not in i}
        self.pairs = {i for i in known if " " in i}
        self.firsts = {i.split(" ")[0] for i in self.pairs}

    def best(self, words: list[str], favoured: frozenset = frozenset()) -> str | None:
        """The subject with most evidence, None where there is not enough; favoured subjects win near ties."""
        items = self.words.intersection(words)
        if self.pairs:
            firsts, pairs = self.firsts, self.pairs
            items.update(p for a, b in zip(words, words[1:]) if a in firsts and (p := f"{a} {b}") in pairs)
        doubt: dict[str, float] = {}
        full = None
        for i in items:
            for subject, c in self.single.get(i, ()):
                doubt[subject] = doubt.get(subject, 1.0) * (1 - c)
            for need, subject, c in self.several.get(i, ()):
                full = full or items_of(words)
                if need <= full:
                    doubt[subject] = doubt.get(subject, 1.0) * (1 - c)
        if not doubt:
            return None
        odds = {s: (1 - d) * (1.3 if s in favoured else 1.0) for s, d in doubt.items()}
        # Near certainty on several sides: the least doubt decides.
        top = min(doubt, key=lambda s: (doubt[s] / (3.0 if s in favoured else 1.0), s))
        return top if odds[top] >= BEARING else None


def _sentences(texts: pd.DataFrame, names: frozenset[str], rules: Rules | None) -> Iterator[tuple[int, str, str, set[str]]]:
    """(document's place, language, subject, items) of the sentences of (text, subjects).

    Without rules the sentences of documents with one subject get it, others are left out; with rules each
    gets its own, and those that bear none are the background.
    """
    for place, (t, subjects) in enumerate(zip(texts["text"], texts["subjects"])):
        own = frozenset(subjects)
        if rules is None and len(own) != 1:
            continue
        for words in sentences(t):
            given = next(iter(own)) if rules is None else rules.best(words, own) or NONE
            yield place, language(words), given, items_of([w for w in words if w not in names])


def _counts(texts: DataFrame, names: frozenset[str], rules: Rules | None) -> DataFrame:
    """(item, lang, subject, n) per document: in how many of its sentences an item stands; the item "" counts all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            for place, lang, subject, items in _sentences(b, names, rules):
                n.update((place, i, lang, subject) for i in items)
                n[place, "", lang, subject] += 1
            yield pd.DataFrame([(i, lang, subject, c) for (_, i, lang, subject), c in n.items()], columns=["item", "lang", "subject", "n"])

    return texts.mapInPandas(run, "item string, lang string, subject string, n bigint")


def windows(items: list[str], size: int = BASKET) -> Iterator[list[str]]:
    """Parts of a list that overlap by half, so that neighbours meet in one of them; a short list is its only part."""
    for i in range(0, max(len(items) - size // 2, 1), size // 2):
        yield items[i : i + size]


def _baskets(texts: DataFrame, lean: frozenset[str], names: frozenset[str], rules: Rules | None) -> DataFrame:
    """(items): a sentence's leaning items and its subject; of a very long sentence in overlapping parts, in alphabetical order.

    Frequent-pattern growth doubles with every item of a basket, so baskets have a size; single items are
    counted over whole sentences elsewhere, see mine().
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = ((subject, items & lean) for _, _, subject, items in _sentences(b, names, rules))
            yield pd.DataFrame({"items": [[*part, _CLASS + subject] for subject, items in found if items for part in windows(sorted(items))]})

    return texts.mapInPandas(run, "items array<string>")


def _shares(counts: DataFrame, sizes: dict[str, dict[str, float]], by: list[str]) -> DataFrame:
    """(*by, lang, whole, docs, subject, share) of counts (*by, lang, subject, n, d): the subjects' shares in
    what `by` names, as if all subjects had equally many sentences in the language.

    Rates are smoothed towards the mean rate (calibration), so that few occurrences prove little. One
    aggregation has a sum per subject; sizes are the numbers of sentences, a small table of languages by subjects.
    """
    subjects = sorted({x for n in sizes.values() for x in n})
    at = {s: i for i, s in enumerate(subjects)}
    sums = [F.sum(F.when(F.col("subject") == s, F.col("n")).otherwise(0)).alias(f"n{i}") for s, i in at.items()]
    most = [F.max(F.when(F.col("subject") == s, F.col("d")).otherwise(0)).alias(f"d{i}") for s, i in at.items()]
    wide = counts.groupBy(*by, "lang").agg(*sums, *most)
    table = lambda f: F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), f(n))])[F.col("lang")]
    inverse = table(lambda n: F.array(*[F.lit(1.0 / (n[s] + SMOOTHING) if s in n else 0.0) for s in subjects]))
    n = F.array(*[F.col(f"n{i}").cast("double") for i in range(len(subjects))])
    d = F.array(*[F.col(f"d{i}").cast("bigint") for i in range(len(subjects))])
    rated = (
        wide.select(*by, "lang", n.alias("n"), d.alias("d"), inverse.alias("inverse")).withColumn("whole", F.aggregate("n", F.lit(0.0), lambda x, y: x + y))
        .withColumn("mean", SMOOTHING * F.col("whole") / table(lambda n: F.lit(float(sum(n.values())))))
        .withColumn("rates", F.zip_with("n", "inverse", lambda x, v: (x + F.col("mean")) * v)).withColumn("all", F.aggregate("rates", F.lit(0.0), lambda x, y: x + y))
    )
    names = F.array(*[F.lit(s) for s in subjects])
    each = F.transform(F.sequence(F.lit(0), F.lit(len(subjects) - 1)), lambda i: F.struct((F.get("rates", i) / F.col("all")).alias("share"), F.get(names, i).alias("subject"), F.get("n", i).alias("n"), F.get("d", i).alias("docs")))
    best = rated.select(*by, "lang", "whole", F.array_max(F.filter(each, lambda x: x["subject"] != NONE)).alias("b"))
    return best.select(*by, "lang", "whole", "b.subject", "b.share", "b.n", "b.docs")


def mine(texts: DataFrame, names: frozenset[str], rules: Rules | None = None) -> Rules:
    """Rules from (text, subjects), by frequent-pattern growth over sentences; see the module's description.

    Statistics stay in Spark; the leaning items and the pruned rules, which come to the driver, are bounded
    by the sample. An item or a rule has the one subject that it leans to most. `names` are words of people
    and organisations, which say nothing of a subject.
    """
    every = staged(_counts(texts, names, rules), "items")
    sizes: dict[str, dict[str, float]] = defaultdict(dict)
    for r in every.filter("item = ''").groupBy("lang", "subject").agg(F.sum("n").alias("n")).collect():
        sizes[r["lang"]][r["subject"]] = float(r["n"])
    total = sum(n for x in sizes.values() for n in x.values())
    if not any(s != NONE for x in sizes.values() for s in x):
        return Rules()
    support, docs = max(LEAST_SUPPORT, total * LEAST_SUPPORT_SHARE), max(LEAST_DOCS, texts.count() * LEAST_DOCS_SHARE)
    per = every.filter("item <> ''").groupBy("item", "lang", "subject").agg(F.sum("n").alias("n"), F.count("*").alias("d"))
    # An item speaks the language in which it stands most often.
    item = _shares(per, sizes, ["item"]).groupBy("item").agg(F.max_by(F.struct("lang", "subject", "share", "docs"), F.struct("whole", "lang")).alias("r")).select("item", "r.*")
    leaning = {r["item"]: (r["lang"], r["subject"], r["share"]) for r in item.filter((F.col("share") >= LEAST_LEAN) & (F.col("docs") >= docs)).collect()}
    # A pair of words goes in only where it leans more than either word alone.
    needless = lambda i: any(w in leaning and leaning[w][1] == leaning[i][1] and leaning[w][2] >= leaning[i][2] - 0.02 for w in i.split(" "))
    lean = frozenset(i for i in leaning if " " not in i or not needless(i))
    if not lean:
        return Rules()
    baskets = staged(_baskets(texts, lean, names, rules), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support / total), minConfidence=0.0).fit(baskets)
    sets = model.freqItemsets.filter(F.size("items").between(2, MAX_ITEMS + 1))
    is_class = lambda x: F.startswith(x, F.lit(_CLASS))
    split = sets.select(F.sort_array(F.filter("items", lambda x: ~is_class(x))).alias("body"), F.filter("items", is_class).alias("head"), F.col("freq").alias("n")).filter("size(head) = 1 and size(body) >= 2")
    tongues = texts.sparkSession.createDataFrame(sorted((i, leaning[i][0]) for i in lean), "item string, lang string")
    heads = split.select("body", F.substring(F.get("head", F.lit(0)), len(_CLASS) + 1, 1000).alias("subject"), "n", F.lit(1).alias("d"), F.get("body", F.lit(0)).alias("item"))
    sure = _shares(heads.join(F.broadcast(tongues), "item"), sizes, ["body"]).filter((F.col("share") >= LEAST_CONFIDENCE) & (F.col("n") > 0))
    # Single items by their counts over whole sentences, sets of items by pattern growth.
    alone = {((i,), leaning[i][1]): leaning[i][2] for i in lean if leaning[i][2] >= LEAST_CONFIDENCE}
    return Rules(_prune(alone | {(tuple(r["body"]), r["subject"]): r["share"] for r in sure.select("body", "subject", "share").collect()}))


def _prune(sure: dict[tuple[tuple[str, ...], str], float]) -> list[tuple[tuple[str, ...], str, float]]:
    """Rules without those that a part of theirs makes needless; a word's pair counts as having the words as parts."""
    out = []
    for (body, s), c in sorted(sure.items(), key=lambda x: (len(x[0][0]), x[0])):
        inner = [(w,) for i in body if " " in i for w in i.split(" ")]
        if not any(sure.get((p, s), 0.0) >= c - 0.02 for p in [*_parts(body), *inner]):
            out.append((body, s, min(c, 0.995)))
    return out


def _parts(body: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
    n = len(body)
    for mask in range(1, (1 << n) - 1):
        yield tuple(body[i] for i in range(n) if mask >> i & 1)


def learn(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", subject: str = "subject", persons: str | None = "persons", sample: int = SAMPLE) -> Rules:
    """Rules from at most `sample` labelled documents. Null texts and null labels teach nothing; without labels there are no rules."""
    own = labels.filter(F.col(subject).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.sort_array(F.collect_set(subject)).alias("subjects"))
    chosen = own.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = documents.select(F.col(key).alias("_id"), F.col(text).alias("text"), *([F.col(persons).alias("persons")] if persons else [])).filter("text is not null")
    people = F.first("persons") if persons else F.lit(None).cast("array<string>")
    taught = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.max("text").alias("text"), F.first("subjects").alias("subjects"), people.alias("persons"))
    taught = staged(taught.select(F.col("_id").cast("string").alias("doc"), "text", "subjects", "persons"), "labelled")
    words = taught.select(F.explode(F.regexp_extract_all(F.lower(F.array_join("persons", " ")), F.lit(r"\p{L}{3,}"), 0)).alias("w")).groupBy("w").count()
    names = frozenset(r["w"] for r in words.collect())
    return mine(taught, names, mine(taught, names))


def subjects_of(text: str | None, rules: Rules, share: float = SHARE) -> list[tuple[str, int, int]]:
    """(subject, sentences, bearing sentences) of the subjects that reach the share of a text's bearing sentences."""
    n: dict[str, int] = defaultdict(int)
    for words in sentences(text):
        s = rules.best(words)
        if s:
            n[s] += 1
    bearing = sum(n.values())
    return sorted((s, c, bearing) for s, c in n.items() if c >= share * bearing)


def assign(documents: DataFrame, rules: Rules, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, subject, n_sentences, n_bearing) of every document; one without subject-bearing sentences has no row."""
    shared = documents.sparkSession.sparkContext.broadcast(rules.rows)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Rules(shared.value)
        for b in batches:
            rows = [(i, *x) for i, t in zip(b["_id"], b["text"]) for x in subjects_of(t, matcher)]
            yield pd.DataFrame(rows, columns=[key, "subject", "n_sentences", "n_bearing"])

    source = documents.select(F.col(key).alias("_id"), F.col(text).alias("text")).filter("text is not null")
    return source.mapInPandas(run, f"`{key}` {kind}, subject string, n_sentences int, n_bearing int")
