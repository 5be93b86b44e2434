"""The queries of this subpackage: each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, hilbert, names, near, packing, personal, scans, subjects, truncation
from quillon.operators.orphans import key_of
from quillon.runtime import load, spread_join, staged


def _cut(spark: SparkSession, root: str) -> DataFrame:
    pages = load(spark, root, "pages").select(F.col("id").alias("record_id"), "document_id", "page_number", "text")
    summaries = load(spark, root, "documents").select(F.col("id").alias("record_id"), F.col("summary").alias("text"))
    named = lambda df, name: df.select(F.lit(name).alias("field_name"), "record_id", "evidence")
    return named(truncation.cut_records(pages, follows=True), "pages.text").unionByName(named(truncation.cut_records(summaries), "documents.summary"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _cut(spark, root).select("field_name", "record_id").distinct()


def p1_sources(spark: SparkSession, root: str) -> DataFrame:
    """(source, field_name, records, cut, share) of every intake channel; unfiled sources are null."""
    documents = load(spark, root, "documents").select("id", "source", "summary").distinct()
    sources = documents.groupBy(key_of("id").alias("key")).agg(F.min("source").alias("source"))
    pages = load(spark, root, "pages").filter(F.trim("text") != "").select(F.col("id").alias("record_id"), key_of("document_id").alias("key")).distinct()
    of_page = spread_join(pages, sources, "key", "record_id", "left").select(F.lit("pages.text").alias("field_name"), "record_id", "source")
    of_summary = documents.filter(F.trim("summary") != "").select(F.lit("documents.summary").alias("field_name"), F.col("id").alias("record_id"), "source")
    all_ = of_page.unionByName(of_summary).join(_cut(spark, root), ["field_name", "record_id"], "left")
    n = all_.groupBy("source", "field_name").agg(F.count("*").alias("records"), F.count("evidence").alias("cut"))
    return n.withColumn("share", F.round(F.col("cut") / F.col("records"), 4))


def _scans(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Pages of documents that needed OCR; a page without document is one if its raw text has lines."""
    pages = load(spark, root, "pages").select("id", "document_id", "page_number", "text", "raw_text")
    ocr = load(spark, root, "documents").filter("id is not null").groupBy(key_of("id").alias("_key")).agg(F.max("ocr_required").alias("_ocr"))
    joined = spread_join(pages.withColumn("_key", key_of("document_id")), ocr, "_key", "id", "left").drop("_key")
    scanned = F.coalesce("_ocr", F.contains("raw_text", F.lit("\n")), F.lit(False))
    return scans.analyse(joined, scanned)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return scans.findings(_scans(spark, root))


def p2_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return scans.paragraphs(_scans(spark, root))


def _alike_pages(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return near.near_pairs(load(spark, root, "pages"), "id", "text", "words3", 0.6)


def _alike_names(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return near.near_pairs(load(spark, root, "documents"), "id", "filename", "name3", 0.6)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    pages, names = near.expand(*_alike_pages(spark, root)), near.expand(*_alike_names(spark, root))
    return pages.select(F.lit("pages.text").alias("field_name"), "id_a", "id_b").unionByName(names.select(F.lit("documents.filename").alias("field_name"), "id_a", "id_b"))


def p3_page_groups(spark: SparkSession, root: str) -> DataFrame:
    return near.groups(*_alike_pages(spark, root))


def p3_document_groups(spark: SparkSession, root: str) -> DataFrame:
    return near.groups(*_alike_names(spark, root))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    near = hilbert.neighbours(load(spark, root, "pages"), "id", "embedding").select("id", F.explode("others").alias("other"))
    return near.select(F.least("id", "other").alias("page_id_a"), F.greatest("id", "other").alias("page_id_b")).distinct()


def p5_neighbours(spark: SparkSession, root: str) -> DataFrame:
    near = hilbert.neighbours(load(spark, root, "pages"), "id", "embedding")
    return near.select(F.col("id").alias("page_id"), F.posexplode("others").alias("rank", "neighbour_id")).withColumn("rank", F.col("rank") + 1)


def _names(spark: SparkSession, root: str) -> DataFrame:
    persons = load(spark, root, "documents").select(F.explode("persons").alias("name"))
    return names.entities(persons.unionByName(load(spark, root, "matters").select(F.col("responsible").alias("name"))))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return names.variant_pairs(staged(_names(spark, root), "linked"))


def p6_entities(spark: SparkSession, root: str) -> DataFrame:
    return _names(spark, root)


def _personal(spark: SparkSession, root: str) -> tuple[DataFrame, personal.Lexicon]:
    documents = load(spark, root, "documents").select("id", "summary", "persons")
    text = lambda df, field, c: df.select(F.lit(field).alias("field_name"), F.col("id").alias("record_id"), F.col(c).alias("text"))
    texts = (
        text(load(spark, root, "pages"), "pages.text", "text").unionByName(text(documents, "documents.summary", "summary"))
        .unionByName(text(documents.select("id", F.explode("persons").alias("person")), "documents.persons", "person"))
    )
    people = documents.select(F.explode("persons").alias("name")).unionByName(load(spark, root, "matters").select(F.col("responsible").alias("name"))).unionByName(load(spark, root, "users").select("name"))
    return texts, personal.Lexicon.of(people)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return personal.found(*_personal(spark, root))


def p7_redacted(spark: SparkSession, root: str) -> DataFrame:
    """The texts with placeholders; the key is a parameter of the deployment, this one is for tests."""
    texts, lexicon = _personal(spark, root)
    return personal.redacted(texts, lexicon, b"quillon test key")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode_column(load(spark, root, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    sizes = bpe.count_column(load(spark, root, "documents").filter("text <> ''"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens")


def p9_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, root))


def _subjects(spark: SparkSession, root: str) -> DataFrame:
    documents = load(spark, root, "documents").select("doc_id", "text", "persons")
    return subjects.assign(documents, subjects.learn(documents, load(spark, root, "doc_subjects")))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return _subjects(spark, root).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, root: str) -> DataFrame:
    """(subject, label_fr, documents, share): the share of all documents that have an area; areas without documents count 0."""
    total = load(spark, root, "documents").agg(F.count_distinct("doc_id").alias("total"))
    n = p10_found(spark, root).groupBy("subject").agg(F.count("*").alias("documents"))
    areas = load(spark, root, "subjects").join(n, "subject", "left").crossJoin(F.broadcast(total))
    return areas.select("subject", "label_fr", F.coalesce("documents", F.lit(0)).alias("documents"), F.round(F.coalesce("documents", F.lit(0)) / F.greatest("total", F.lit(1)), 4).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_sources, p2_found, p2_paragraphs, p3_found, p3_page_groups, p3_document_groups, p5_found, p5_neighbours, p6_found, p6_entities, p7_found, p7_redacted, p8_ids, p9_containers, p9_fill, p10_found, p10_composition)}


SHINGLES_SQL = """select id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) s from (select id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from (select distinct id, text from pages where text is not null)) where len(w) >= 3"""
NAMES_SQL = """select id, unnest(list_distinct(case when length(n) < 3 then [n] else list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3)) end)) s from (select distinct id, regexp_replace(lower(regexp_replace(filename, '\\.[A-Za-z]{1,5}$', '')), '[^a-z0-9]', '', 'g') n from documents where filename is not null) where n <> ''"""


def _alike_sql(field: str, shingles: str) -> str:
    return f"""select '{field}' field_name, a id_a, b id_b from (with s as ({shingles}), n as (select id, count(*) n from s group by 1), c as (select x.id a, y.id b, count(*) c from s x join s y on x.s = y.s and x.id < y.id group by 1, 2)
    select a, b from c join n p on p.id = a join n q on q.id = b where c >= 0.6 * (p.n + q.n - c) - 1e-9)"""


def _groups_sql(shingles: str) -> str:
    """Classes of equal sets of shingles, their links, and the groups that the links make."""
    return f"""with recursive s as ({shingles}), k as (select id, string_agg(s, '|' order by s) c from s group by id), reps as (select c, min(id) rep, count(*) copies from k group by c),
    t as (select s.id, s.s from s where id in (select rep from reps)), n as (select id, count(*) n from t group by 1), c as (select x.id a, y.id b, count(*) c from t x join t y on x.s = y.s and x.id <> y.id group by 1, 2),
    e as (select a, b from c join n p on p.id = a join n q on q.id = b where c >= 0.6 * (p.n + q.n - c) - 1e-9), r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
    select k.id, least(rep, coalesce(g.least, rep)) group_id, copies, coalesce(l.links, 0) links from k join reps using (c) left join (select a, min(b) least from r group by a) g on g.a = rep left join (select a, count(*) links from e group by a) l on l.a = rep"""


NEAR_SQL = """with v as (select distinct on (id) id, embedding e from pages where len(embedding) = 64 and not list_contains(list_transform(embedding, lambda x: x is null), true) and list_sum(list_transform(embedding, lambda x: abs(x))) > 0 order by id),
u as (select id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from v),
p as (select a.id a, b.id b, row_number() over (partition by a.id order by round(list_inner_product(a.e, b.e), 6) desc, b.id) r from u a join u b on a.id <> b.id)"""
PAIRS = " select distinct least(a, b) page_id_a, greatest(a, b) page_id_b from p where r <= 5"


def oracle_sql() -> dict[str, str]:
    """Exact SQL where the whole tables allow it; the other queries are tested against brute force or libraries."""
    return {"p3_found": _alike_sql("pages.text", SHINGLES_SQL) + " union all " + _alike_sql("documents.filename", NAMES_SQL), "p3_page_groups": _groups_sql(SHINGLES_SQL), "p3_document_groups": _groups_sql(NAMES_SQL), "p5_found": NEAR_SQL + PAIRS}
