"""Ranked page search: term cosine, synonym hints, phrase bonus and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.vectors import cosine
from quillon.operators.access import Filters, Rights
from quillon.runtime import latest_by_id, once, spread_join

TOP = 50
#: A document's fields that are searched with each of its pages.
FIELDS = ("title", "type", "doc_type", "summary", "persons", "tags")


def searchable() -> Column:
    """Title, type, summary, persons, tags and the page's text, one per line; empty ones dropped."""
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    parts = F.array("title", "type", "doc_type", "summary", joined("persons"), joined("tags"), "page_text")
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def scores(body: Column, query: str, vector: list[float] | None = None) -> dict[str, Column]:
    """Score columns of a text. The term frequencies of the query's few words are counted in place;
    only the norm needs all of a page's tokens."""
    q = T.tokenize(query)
    wide = T.expand(q)
    counts = {w: q.count(w) for w in dict.fromkeys(q)}
    qnorm = sum(n * n for n in counts.values()) ** 0.5
    toks = F.col("_tokens")
    tf = lambda w: F.size(F.filter(toks, lambda t: t == w))
    total = lambda cols: sum(cols, F.lit(0))
    # Sum of squared frequencies over distinct tokens, from the sorted tokens: each run of n adds n*n.
    runs = F.aggregate(
        F.array_sort(toks),
        F.struct(F.lit("").alias("w"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("s")),
        lambda a, t: F.when(a["w"] == t, F.struct(a["w"].alias("w"), (a["n"] + 1).alias("n"), (a["s"] + 2 * a["n"] + 1).alias("s"))).otherwise(F.struct(t.alias("w"), F.lit(1).cast("bigint").alias("n"), (a["s"] + 1).alias("s"))),
        lambda a: a["s"],
    )
    has = F.size(toks) > 0
    exact = F.when(has & F.lit(bool(q)), total([tf(w) * n for w, n in counts.items()]) / F.greatest(F.sqrt(runs.cast("double")) * qnorm, F.lit(1e-9))).otherwise(0.0)
    hint = F.when(has, total([tf(w) for w in wide]) / F.greatest(F.size(F.array_distinct(toks)), F.lit(1))).otherwise(0.0)
    phrase = query.lower().strip()
    bonus = F.when(F.lit(bool(phrase)) & F.contains(F.lower(body), F.lit(phrase)), 0.25).otherwise(0.0)
    plain = 0.65 * F.col("exact_raw") + 0.35 * F.col("hint_raw") + F.col("bonus")
    if vector is None:
        return {"exact_raw": exact, "hint_raw": hint, "bonus": bonus, "vector_raw": F.lit(0.0), "semantic_raw": F.col("hint_raw"), "score_raw": plain}
    near = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))
    has_vector = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    semantic = F.greatest("hint_raw", "vector_raw")
    blended = F.when(has_vector, 0.35 * F.col("exact_raw") + 0.55 * F.col("semantic_raw") + 0.10 * F.col("hint_raw") + F.col("bonus")).otherwise(0.65 * F.col("exact_raw") + 0.35 * F.col("semantic_raw") + F.col("bonus"))
    return {"exact_raw": exact, "hint_raw": hint, "bonus": bonus, "vector_raw": near, "semantic_raw": semantic, "score_raw": blended}


def search(tables: dict[str, DataFrame], query: str, rights: Rights, filters: Filters = Filters(), vector: list[float] | None = None, top: int = TOP) -> DataFrame:
    """The best pages of permitted, indexed documents; a query without tokens finds nothing.

    Scores are rounded to four places before they are ranked, ties stay in storage order (ordinal).
    Rows repeated under one page id count once. Null and empty texts score by their document's fields.

    Only ids and scores are ranked; texts, titles and names are read again for the pages that are left.
    Pages that hold no word of the query, not even within another word, are not split into tokens.
    """
    q = T.tokenize(query)
    docs = tables["documents"].filter((F.col("status") == "indexed") & rights.visible() & filters.matches()).select(F.col("id").alias("document_id"), *FIELDS)
    pages = tables["pages"].select(F.col("id").alias("page_id"), "document_id", F.col("text").alias("page_text"), "page_number", "ordinal", *(["embedding"] if vector is not None else []))
    if not q:
        pages = pages.filter(F.lit(False))
    wide, phrase = T.expand(q), query.lower().strip()
    hits = once(spread_join(pages, docs, "document_id", "page_id"), body=searchable())
    low = F.lower("body")
    any_ = F.contains(low, F.lit(phrase)) if phrase else F.lit(False)
    for w in wide:
        any_ = any_ | F.contains(low, F.lit(w))
    hits = once(hits, _any=any_)
    if vector is None:
        hits = hits.filter("_any")
    ranked = once(hits, _tokens=F.when(F.col("_any"), T.tokens("body")).otherwise(F.array().cast("array<string>")))
    for names in (("exact_raw", "hint_raw", "bonus", "vector_raw"), ("semantic_raw",), ("score_raw",)):  # each reads those before
        made = scores(F.col("body"), query, vector)
        ranked = once(ranked, **{n: made[n] for n in names})
    slim = ranked.filter("score_raw > 0").select("page_id", "document_id", "page_number", "ordinal", F.round("score_raw", 4).alias("score"), F.round("exact_raw", 4).alias("exact_score"), F.round("semantic_raw", 4).alias("semantic_score"))
    row = F.struct("document_id", "page_number", "ordinal", "score", "exact_score", "semantic_score")
    best = slim.groupBy("page_id").agg(F.min_by(row, "ordinal").alias("r")).select("page_id", "r.*")
    return presented(best, tables, wide, top)


def presented(ranked: DataFrame, tables: dict[str, DataFrame], wide: list[str], top: int) -> DataFrame:
    """The `top` best of ranked (page_id, document_id, page_number, ordinal and scores), with titles, names and excerpts."""
    best = ranked.orderBy(F.desc("score"), "ordinal").limit(top)
    found = best.collect()  # `top` rows
    spark = tables["pages"].sparkSession
    kept = F.broadcast(spark.createDataFrame(found, best.schema))
    ids = lambda c: [r[c] for r in found]
    texts = tables["pages"].filter(F.col("id").isin(ids("page_id"))).groupBy(F.col("id").alias("page_id")).agg(F.min_by("text", "ordinal").alias("page_text"))
    about = tables["documents"].filter(F.col("id").isin(ids("document_id"))).select(F.col("id").alias("document_id"), *FIELDS, "filename", "client_id", "matter_id")
    full = kept.join(about, "document_id").join(texts, "page_id").withColumn("body", searchable())
    full = full.dropDuplicates(["page_id"])
    named = lambda t, c: latest_by_id(tables[t].select("id", "name", "created_at").join(F.broadcast(full.select(F.col(c).alias("id")).distinct()), "id", "left_semi")).select(F.col("id").alias(c), F.col("name").alias(t[:-1] + "_name"))  # noqa: E731  for `top` pages
    return (
        full.join(named("matters", "matter_id"), "matter_id", "left").join(named("clients", "client_id"), "client_id", "left")
        .select(
            "page_id", "document_id", "page_number",
            F.coalesce(F.nullif("title", F.lit("")), "filename").alias("title"),
            F.coalesce(F.nullif("doc_type", F.lit("")), F.nullif("type", F.lit("")), F.lit("")).alias("document_type"),
            F.coalesce("matter_name", F.lit("")).alias("matter_name"), F.coalesce("client_name", F.lit("")).alias("client_name"),
            "score", "exact_score", "semantic_score", T.excerpt("body", wide or [" "]).alias("excerpt"), "ordinal",
        ).orderBy(F.desc("score"), "ordinal").drop("ordinal")
    )


#: Parts of the postings table by token, of which a query reads as many as it has words.
BUCKETS = 256


def postings(tables: dict[str, DataFrame], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, token, page_id, document_id, page_number, ordinal, tf, norm, tokens): the words of every page of an indexed
    document, with the page's norm and number of different words, to be written partitioned by bucket.

    Rights are not in it: they are asked for when it is searched. Pages without words have no rows.
    """
    docs = tables["documents"].filter("status = 'indexed'").select(F.col("id").alias("document_id"), *FIELDS)
    row = F.struct("document_id", "page_number", "ordinal", F.col("text").alias("page_text"))
    pages = tables["pages"].filter("document_id is not null").groupBy(F.col("id").alias("page_id")).agg(F.min_by(row, "ordinal").alias("r")).select("page_id", "r.*")
    words = spread_join(pages, docs, "document_id", "page_id").select("page_id", "document_id", "page_number", "ordinal", T.tokens(searchable()).alias("t"))
    each = words.select("*", F.explode(F.transform(F.array_distinct("t"), lambda w: F.struct(w.alias("token"), F.size(F.filter("t", lambda x: x == w)).alias("tf")))).alias("w")).drop("t")
    page = Window.partitionBy("page_id")
    flat = each.select("page_id", "document_id", "page_number", "ordinal", "w.*")
    return flat.withColumns({"norm": F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(page).cast("double")), "tokens": F.count("*").over(page), "bucket": F.pmod(F.hash("token"), F.lit(buckets))})


def search_postings(index: DataFrame, tables: dict[str, DataFrame], query: str, rights: Rights, filters: Filters = Filters(), top: int = TOP, buckets: int = BUCKETS) -> DataFrame:
    """search() without vectors over postings(): only the query's words are read, and the texts of pages that may hold its phrase.

    It differs from search() in one case: a page that holds the phrase only within other words, and no word of the query, is not found.
    """
    q, spark = T.tokenize(query), index.sparkSession
    wide, phrase = T.expand(q), query.lower().strip()
    words = spark.createDataFrame([(w,) for w in wide] or [("",)], "token string").withColumn("bucket", F.pmod(F.hash("token"), F.lit(buckets)))
    parts = [r["bucket"] for r in words.select("bucket").distinct().collect()]  # as many as the query has words
    docs = tables["documents"].filter((F.col("status") == "indexed") & rights.visible() & filters.matches()).select(F.col("id").alias("document_id"), *FIELDS)
    hits = index.filter(F.col("bucket").isin(parts) & F.col("token").isin(wide))
    counts = {w: q.count(w) for w in dict.fromkeys(q)}
    qnorm = sum(n * n for n in counts.values()) ** 0.5
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("token")), F.lit(0)) if counts else F.lit(0)
    key = ["page_id", "document_id", "page_number", "ordinal", "norm", "tokens"]
    per = hits.groupBy(*key).agg(F.sum(F.col("tf") * weight).alias("dot"), F.sum("tf").alias("hint"), F.collect_set("token").alias("said"))
    per = spread_join(per, docs, "document_id", "page_id")
    inner = T.tokenize(" ".join(phrase.split()[1:-1]))  # the phrase's first and last word may be parts of others
    asked = per.filter(F.size(F.array_intersect("said", F.array(*[F.lit(w) for w in inner]))) == len(set(inner))) if inner else per
    texts = tables["pages"].groupBy(F.col("id").alias("page_id")).agg(F.min_by("text", "ordinal").alias("page_text"))
    held = asked.join(texts, "page_id").filter(F.contains(F.lower(searchable()), F.lit(phrase))).select("page_id", F.lit(0.25).alias("bonus"))
    exact = F.col("dot") / F.greatest(F.col("norm") * qnorm, F.lit(1e-9))
    hint = F.col("hint") / F.greatest("tokens", F.lit(1))
    raw = per.join(held, "page_id", "left").withColumns({"exact_raw": exact, "hint_raw": hint}).withColumn("score_raw", 0.65 * F.col("exact_raw") + 0.35 * F.col("hint_raw") + F.coalesce("bonus", F.lit(0.0)))
    ranked = raw.filter("score_raw > 0").select("page_id", "document_id", "page_number", "ordinal", F.round("score_raw", 4).alias("score"), F.round("exact_raw", 4).alias("exact_score"), F.round("hint_raw", 4).alias("semantic_score"))
    return presented(ranked if q else ranked.limit(0), tables, wide, top)


def cosine_topk(pages: DataFrame, vector: list[float], k: int = 25) -> DataFrame:
    """(page_id, similarity) of the k pages nearest to a vector; ties by id."""
    near = F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])), 4)
    return pages.select(F.col("id").alias("page_id"), near.alias("similarity")).distinct().orderBy(F.desc("similarity"), "page_id").limit(k)
