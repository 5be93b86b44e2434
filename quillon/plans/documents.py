"""Queries of the document analysis, intake, reprocessing and recognition, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import facts
from quillon.functions import text as T
from quillon.operators import access, analysis, dashboard, intake, store
from quillon.plans import facts_sql as S
from quillon.plans.catalog import USER, query, tables
from quillon.runtime import load, once
from quillon.sources import engines, files, ocr

MOMENT = "2026-01-01 00:00:00"


def joined(c: str, to: str | None = None):
    """An array of strings as one string, so that results compare alike everywhere."""
    return F.array_join(c, "; ").alias(to or c)


# --- facts ------------------------------------------------------------------------------------------


@query(f"select doc_id, case when text is not null then {S.normal('text')} end normal from documents")
def normalised_text(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "documents").select("doc_id", T.normalise("text").alias("normal"))


@query(f"select id doc_id, array_to_string(persons, '; ') persons from {S.persons('(select doc_id id, coalesce(text, chr(32)) t from documents)')}")
def extract_persons(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "documents").select("doc_id", facts.persons("text").alias("persons")).select("doc_id", joined("persons"))


@query(f"with w as (select doc_id id, list_distinct({S.tokens('text')}) w, {S.normal('coalesce(text, chr(32))')} n from documents) select id doc_id, found_type from {S.doc_types('w')}")
def doc_types(spark: SparkSession, root: str) -> DataFrame:
    d = load(spark, root, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = once(d.withColumn("n", T.normalise("t")), k=facts.keywords_in(F.array_distinct(T.tokens("t"))))
    return d.select("doc_id", facts.doc_type(F.col("n"), F.col("k")).alias("found_type"))


ANALYSED = "id, title, doc_type, doc_date, array_to_string(persons, '; ') persons, summary, array_to_string(tags, '; ') tags, matter_id, method, confidence"


@query(f"select {ANALYSED} from {S.analysis('documents')}")
def analyse_documents(spark: SparkSession, root: str) -> DataFrame:
    """The whole analysis: type, date, persons, tags, matter, title, summary and confidence of every document."""
    docs = load(spark, root, "documents").drop("title", "summary", "persons", "tags")
    done = analysis.analyse(docs, load(spark, root, "matters")).select("id", "analysis.*")
    return done.withColumns({"persons": joined("persons"), "tags": joined("tags")})


# --- pages and recognition -------------------------------------------------------------------------------

SPLIT = S.quality("t")


@query(
    f"""with f as (select id, regexp_replace(coalesce(text, ''), '--- Page \\d+ ---\\n', chr(12), 'g') t from documents),
    p as (select id, list_filter(list_transform(string_split(t, chr(12)), lambda x: {S.strip('x')}), lambda x: x <> '') parts from f),
    u as (select id, unnest(parts) part, generate_subscripts(parts, 1) n from p), c as (select id, n, {S.readable('part')} t from u),
    q as (select id, n page_number, left(t, 20000) as text, {SPLIT[1]} confidence, {SPLIT[0]} quality from c) select * from q where confidence >= 0.45"""
)
def page_split(spark: SparkSession, root: str) -> DataFrame:
    """Documents' texts as form-fed pages: marks between pages become form feeds, pages are cleaned, scored and numbered."""
    fed = F.regexp_replace(F.coalesce("text", F.lit("")), r"--- Page \d+ ---\n", "\f")
    return load(spark, root, "documents").select("id", F.explode(files.split_pages(fed)).alias("p")).select("id", F.col("p.page_number").cast("bigint").alias("page_number"), "p.text", "p.confidence", "p.quality")


@query(f"select distinct c.id, c.text from pages p join {S.corrected('(select distinct on (id) id, coalesce(raw_text, text) t from pages order by id, ordinal)')} c on c.id = p.id")
def ocr_corrected(spark: SparkSession, root: str) -> DataFrame:
    first = load(spark, root, "pages").groupBy("id").agg(F.min_by(F.coalesce("raw_text", "text", F.lit("")), "ordinal").alias("t"))
    return first.select("id", ocr.postprocess(F.col("t")).alias("text"))


def ocr_words(spark: SparkSession, root: str) -> DataFrame:
    """Word rows as an engine gives them, made of the lines of the pages' raw text: two modes upright, and one turned."""
    pages = load(spark, root, "pages").filter("raw_text is not null").groupBy("id").agg(F.min_by("raw_text", "ordinal").alias("raw"))
    lines = pages.select("id", F.posexplode(F.split("raw", "\n")).alias("line_num", "line"))
    words = lines.select("id", "line_num", F.posexplode(F.split("line", " ")).alias("at", "text"))
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("psm"), F.lit(a).alias("angle"), F.lit(c).alias("base")) for m, a, c in (("11", 0, 40), ("6", 0, 55), ("6", 2, 70))]))
    known = F.pmod(F.length("text") * 7 + F.col("at"), F.lit(45))
    return words.select("id", "line_num", "at", "text", modes.alias("m")).select(
        F.col("id").alias("image_id"), F.lit("tesseract").alias("engine"), "m.psm", "m.angle", F.lit(1).alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), "line_num", F.col("at").alias("ordinal"), "text",
        F.when(F.length("text") == 1, -1).otherwise(F.col("m.base") + known).cast("double").alias("conf"),
    )


OCR_SQL = f"""with p as (select id, arg_min(raw_text, ordinal) raw from pages where raw_text is not null group by id),
l as (select id, unnest(string_split(raw, chr(10))) line, generate_subscripts(string_split(raw, chr(10)), 1) - 1 line_num from p),
w as (select id, line_num, unnest(string_split(line, ' ')) as text, generate_subscripts(string_split(line, ' '), 1) - 1 pos from l),
k as (select id, line_num, pos, {S.readable('text')} word, case when length(text) = 1 then -1 else base + (length(text) * 7 + pos) % 45 end conf, psm, angle from w, (values ('11', 0, 40), ('6', 0, 55), ('6', 2, 70)) m(psm, angle, base)),
g as (select id, psm, angle, line_num, string_agg(word, ' ' order by pos, word) line, count(*) n, sum(conf) c from k where word <> '' and conf >= 0 group by all),
c as (select id, psm, angle, string_agg(line, chr(10) order by line_num) t, sum(n) words, sum(c) / sum(n) / 100 mean from g group by all),
x as (select *, id || '|' || psm || '|' || angle as key from c), y as (select id as key, text as fixed from {S.corrected("(select key id, t from x)")}),
z as (select x.id, psm, angle, words, fixed, mean, {{score}} semantic from x join y using (key)),
v as (select *, round(0.68 * mean + 0.24 * semantic + 0.08 * least(words / 80.0, 1.0), 3) conf from z),
o as (select *, row_number() over (partition by id order by conf desc, words desc, psm = '6') r from v where angle = 0),
needed as (select id from o where r = 1 and not (conf >= 0.72 and words >= 8 and semantic >= 0.42)),
e as (select * from v where angle = 0 or id in (select id from needed)),
b as (select *, row_number() over (partition by id order by conf desc, words desc, case psm when '11' then 0 else 1 end, abs(angle)) r from e)
select id image_id, psm, angle, words::bigint words, fixed as text, conf confidence, case when conf >= 0.72 then 'good' when conf >= 0.45 then 'medium' else 'low' end quality,
 'OCR applique avec Tesseract, mode ' || psm || case when angle = 0 then '.' else ', apres correction d''inclinaison ' || angle || ' degres.' end message from b where r = 1"""


def sql_semantic(text: str) -> str:
    from quillon import lexicons as L

    letters = "regexp_replace(x, '[^\\p{L}]', '', 'g')"
    w = f"regexp_extract_all(lower(coalesce({text}, '')), '[a-zA-ZÀ-ÿ]{{2,}}')"
    good = f"len(list_filter({w}, lambda x: length(x) <= 2 or (length(x) <= 28 and length({letters}) > 0 and length(regexp_replace(x, '[^aeiouyàâäéèêëîïôöùûüœ]', '', 'g')) / length({letters})::double >= 0.18)))"
    return f"(case when len({w}) = 0 then 0.0 else greatest(0.0, least(0.72 * {good} / len({w})::double + 0.28 * least(len(list_filter({w}, lambda x: list_contains({S.listed(L.COMMON_WORDS)}, x))) / 4.0, 1.0) - least(len(list_filter({w}, lambda x: length(x) > 22))::double / len({w}), 0.4), 1.0)) end)"


@query(OCR_SQL.replace("{score}", sql_semantic("fixed")))
def ocr_best(spark: SparkSession, root: str) -> DataFrame:
    """The best recognition of each page: modes against each other, then turned images where those are not good enough."""
    words = ocr_words(spark, root)
    best = engines.best_of(words.filter("angle = 0"), lambda poor: words.filter("angle <> 0").join(poor, "image_id", "left_semi"))
    return best.select("image_id", "psm", "angle", "words", "text", "confidence", "quality", ocr.method_message().alias("message"))


# --- intake, reprocessing, the whole corpus ------------------------------------------------------------------

#: The documents' own texts as uploaded text files.
UPLOADS = "(select id, text, regexp_replace(case when trim(filename) = '' or filename is null then 'document' else trim(regexp_extract(filename, '([^/]*)/*$', 1)) end, '[^a-zA-Z0-9._ -]+', '_', 'g') filename, '' as type, null::date document_date, matter_id, coalesce(matter_id <> '', false) matter_locked, client_id from documents)"
OWNERS = "(select id mid, arg_max(client_id, created_at) c from matters group by id)"
CHECKED = S.quality("t")


def contents(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "documents").withColumn("content", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))


def sql_intake() -> str:
    return f"""with u as {UPLOADS}, v as (select id, coalesce(text, '') as text, filename, type, document_date, matter_id, matter_locked, client_id from u), a as {S.analysis('v')},
    q as (select id, {S.strip("coalesce(text, '')")} t from u)
    select q.id, case when t = '' then 'low_quality' else 'indexed' end status, {CHECKED[0]} quality, {CHECKED[1]} confidence, a.title, a.doc_type, a.doc_date document_date, case when v.matter_locked then v.matter_id else a.matter_id end matter_id,
    coalesce(nullif(v.client_id, ''), nullif(o.c, '')) client_id, a.confidence analysis_confidence from q join v using (id) join a using (id) left join {OWNERS} o on o.mid = case when v.matter_locked then v.matter_id else a.matter_id end"""


@query(sql_intake())
def intake_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every document's text taken in as an uploaded text file: extraction, pages, analysis, filing."""
    up = contents(spark, root).select("id", "filename", "content", F.lit("text/plain").alias("mime_type"), "client_id", "matter_id", F.lit("Auto").alias("type"), "responsible", F.lit(None).cast("date").alias("document_date"), F.lit(MOMENT).cast("timestamp").alias("created_at"))
    new = intake.intake(up, load(spark, root, "matters"), USER)
    return new["documents"].select("id", "status", "quality", "confidence", "title", "doc_type", "document_date", "matter_id", "client_id", "analysis_confidence")


@query(f"""with q as (select id, {S.strip("coalesce(text, '')")} t from documents) select 'document' entity, 'upload' as action, case when t = '' then 'low_quality' else 'indexed' end status, count(*) n, count(*) filter (where t = '') alerts from q group by all""")
def intake_audit(spark: SparkSession, root: str) -> DataFrame:
    """What intake writes beside the documents: audit rows by status, and the alerts raised."""
    up = contents(spark, root).select("id", "filename", "content", F.lit("text/plain").alias("mime_type"), "client_id", "matter_id", F.lit("Auto").alias("type"), "responsible", F.lit(None).cast("date").alias("document_date"), F.lit(MOMENT).cast("timestamp").alias("created_at"))
    new = intake.intake(up, load(spark, root, "matters"), USER)
    raised = new["alerts"].groupBy(F.lit("low_quality").alias("status")).agg(F.count("*").alias("alerts"))
    n = new["audit_logs"].groupBy("entity", "action", F.col("details")["status"].alias("status")).agg(F.count("*").alias("n"))
    return n.join(raised, "status", "left").select("entity", "action", "status", "n", F.coalesce("alerts", F.lit(0)).alias("alerts"))


@query(
    f"""with q as (select id, filename, {S.strip("coalesce(text, '')")} t, coalesce(text, '') as text from documents)
    select id, filename, case when t = '' then 'low_quality' else 'indexed' end status, {CHECKED[0]} quality, {CHECKED[1]} confidence, '' as message, 1::bigint pages, length(text)::bigint chars from q"""
)
def reindex_all(spark: SparkSession, root: str) -> DataFrame:
    """Every document extracted again, its pages replaced and its analysis renewed: the report, with the pages that are there then."""
    docs, t = load(spark, root, "documents").drop("doc_id", "text", "lang", "source", "n_chars"), tables(spark, root, "pages", "matters")
    source = contents(spark, root).select("id", "content")
    text = docs.withColumn("mime_type", F.lit("text/plain"))
    out = intake.reprocess(text, t["pages"], source, t["matters"], USER, F.lit(MOMENT).cast("timestamp"))
    pages = out["pages"].groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))
    return out["report"].join(pages, "id", "left")


STORED = f"(select d.id, x.text, filename, type, document_date, matter_id, matter_locked, client_id, title from documents d join ({{text}}) x on x.document_id = d.id)"


def sql_reanalyse() -> str:
    from quillon.plans.catalog import SQL

    stored = STORED.replace("{text}", SQL["document_text"])
    return f"""with v as {stored}, a as {S.analysis('v')}
    select d.id, d.filename, coalesce(a.doc_type, d.type) as type, coalesce(a.title, d.title) title, case when a.id is null or d.matter_locked then d.matter_id else a.matter_id end matter_id,
    case when a.id is null then d.client_id else coalesce(nullif(d.client_id, ''), nullif(o.c, '')) end client_id from documents d left join a using (id) left join {OWNERS} o on o.mid = case when d.matter_locked then d.matter_id else a.matter_id end"""


@query(sql_reanalyse())
def reanalyse_all(spark: SparkSession, root: str) -> DataFrame:
    """Every document analysed again from its stored pages: the report, and where it is filed then."""
    t = tables(spark, root, "documents", "pages", "matters")
    return intake.reanalyse(t["documents"], t["pages"], t["matters"]).select("id", "filename", "type", "title", "matter_id", "client_id")


# --- lists and texts under rights ----------------------------------------------------------------------------

ALLOWED = f"""(select d.* from documents d, (select allowed_client_ids c, allowed_matter_ids m from users where id = '{USER}') where coalesce(matter_id <> '' and list_contains(m, matter_id), false) or coalesce(client_id <> '' and list_contains(c, client_id), false) or (coalesce(matter_id, '') = '' and coalesce(client_id, '') = ''))"""


@query(f"select id, title, created_at from {ALLOWED} order by created_at desc, id limit 50")
def documents_for_user(spark: SparkSession, root: str) -> DataFrame:
    t = tables(spark, root, "documents", "users")
    return dashboard.newest(access.readable(t["documents"], access.Rights.of(t["users"], USER)).select("id", "title", "created_at"), 50)


def sql_texts() -> str:
    from quillon.plans.catalog import SQL

    return f"select x.document_id, x.text from ({SQL['document_text']}) x where document_id in (select id from {ALLOWED})"


@query(sql_texts())
def texts_for_user(spark: SparkSession, root: str) -> DataFrame:
    """The texts of the documents that a user may read."""
    t = tables(spark, root, "documents", "pages", "users")
    return analysis.document_text(t["pages"], access.readable(t["documents"], access.Rights.of(t["users"], USER)))


@query("select 'alert' as kind, level, message, created_at from (select case when status = 'error' then 'error' else 'warning' end as level, coalesce(filename, '') || ': ' || coalesce(nullif(message, ''), status) message, created_at, id from documents where status in ('ocr_pending', 'low_quality', 'error') order by created_at desc, message limit 50)")
def alerts_newest(spark: SparkSession, root: str) -> DataFrame:
    raised = store.alerts(load(spark, root, "documents"))
    return dashboard.newest(raised, 50, tie="message").select(F.lit("alert").alias("kind"), "level", "message", "created_at")


# --- files ---------------------------------------------------------------------------------------------------


@query(
    f"""with f as (select id, regexp_replace(coalesce(text, ''), '--- Page \\d+ ---\\n', chr(12), 'g') t from documents),
    p as (select id, list_filter(list_transform(string_split(t, chr(12)), lambda x: {S.strip('x')}), lambda x: x <> '') parts from f), u as (select id, unnest(parts) part, generate_subscripts(parts, 1) pos from p),
    c as (select id, pos, {S.readable('part')} t from u), q as (select id, pos, {SPLIT[1]} confidence from c), l as (select id, count(*) n, list_reduce(list_concat([0.0::double], list(confidence order by pos)), lambda a, b: a + b) total from q where confidence >= 0.45 group by id), m as (select id, n, round(total / n, 3) mean, total / n exact from l)
    select f.id, case when n is null then 'ocr_pending' when exact >= 0.75 then 'indexed' else 'low_quality' end status, case when n is null then 'unknown' when exact >= 0.75 then 'good' else 'low' end quality,
    round(coalesce(mean, 0.0), 2) confidence, greatest(coalesce(n, 0), 1)::bigint page_count, n is null ocr_required, case when n is null then 'no text layer; OCR required' else '' end message from f left join m using (id)"""
)
def pdf_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents' texts as the text layers of PDF files: pages, mean confidence, status."""
    fed = F.regexp_replace(F.coalesce("text", F.lit("")), r"--- Page \d+ ---\n", "\f")
    d = load(spark, root, "documents").select("id", fed.alias("layer"), F.lit("a.pdf").alias("path"), F.lit("application/pdf").alias("mime_type"), F.lit(b"").alias("content"))
    return files.extract(d, "layer").select("id", "status", "quality", F.round("confidence", 2).alias("confidence"), F.col("page_count").cast("bigint").alias("page_count"), "ocr_required", "message")


#: A PDF's bytes as they hold literal strings: the sentences of a text in brackets, plain ASCII, and a page object for each page.
ASCII_SQL = "regexp_replace(coalesce(text, ''), '[^ -~]', ' ', 'g')"


def sql_literals() -> str:
    count = lambda e, others: f"length(regexp_replace({e}, '{others}', '', 'g'))"
    letters = lambda e: count(e, "[^\\p{L}]")
    readable = lambda e: count(e, r"[^\p{L}\p{N}'' \-_.,;:!?()\[\]{}\"/@+*=#%€$&\n\r\t]")
    blanks = lambda e: count(e, r"[^ \n\r\t]")
    t = S.strip("x")
    literal = f"case when length({t}) < 3 then false when length({t}) < 80 then {letters(t)} >= 2 and {readable(t)} / length({t})::double > 0.9 and {blanks(t)} >= 1 else {letters(t)} >= 8 and {readable(t)} / length({t})::double > 0.86 and {blanks(t)} / length({t})::double > 0.03 end"
    line = f"length(x) >= 3 and {letters('x')} >= 2 and {readable('x')} / length(x)::double > 0.88 and (regexp_matches(x, '[ \\n\\r\\t]') or length(x) < 80)"
    return f"""with b as (select id, '(' || replace({ASCII_SQL}, '. ', '.) Tj (') || ') Tj ' || repeat('/Type /Page ', coalesce(page_count, 0)) raw from documents),
    l as (select id, raw, list_filter(list_filter(regexp_extract_all(raw, '(?s)\\((.*?)\\)', 1), lambda x: length(x) >= 3), lambda x: {literal}) found from b)
    select id, array_to_string(list_filter(list_transform(found, lambda x: {S.readable('x')}), lambda x: {line}), chr(10)) as text, greatest(len(regexp_extract_all(raw, '/Type\\s*/Page\\b')), 1)::bigint pages from l"""


@query(sql_literals())
def pdf_literals(spark: SparkSession, root: str) -> DataFrame:
    """What is read from PDF files without a text layer: their literal strings, and the pages they seem to have."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", " ")
    raw = F.concat(F.lit("("), F.replace(plain, F.lit(". "), F.lit(".) Tj (")), F.lit(") Tj "), F.expr("repeat('/Type /Page ', coalesce(page_count, 0))"))
    d = load(spark, root, "documents").select("id", F.encode(raw, "ISO-8859-1").alias("content"))
    return d.select("id", files.pdf_literals("content").alias("text"), files.pdf_page_estimate("content").cast("bigint").alias("pages"))


@query("select doc_id, case when length(text) > 1500 then substr(text, 1, 1200) || chr(10) || '[...]' || chr(10) || right(text, 300) else text end clipped from documents")
def clipped_text(spark: SparkSession, root: str) -> DataFrame:
    """Texts clipped for a prompt, with limits that these texts reach."""
    return load(spark, root, "documents").select("doc_id", T.clip("text", 1500, 1200, 300).alias("clipped"))


# --- filters, new records, answers of a model, noise ------------------------------------------------------------

@query("with c as (select min(client_id) c, min(matter_id) filter (where client_id is not null and matter_id <> '') m, min(responsible) filter (where responsible <> '') r from documents where client_id <> '') select 'client' as filter, id from documents, c where client_id = c union all select 'matter', id from documents, c where matter_id = m union all select 'responsible', id from documents, c where responsible = r")
def documents_filtered(spark: SparkSession, root: str) -> DataFrame:
    """The documents that each of the equality filters lets through; the values are the smallest ones there are."""
    docs = load(spark, root, "documents")
    filed = docs.filter("client_id <> ''")
    c, m, r = filed.agg(F.min("client_id"), F.min(F.when(F.col("matter_id") != "", F.col("matter_id"))), F.min(F.when(F.col("responsible") != "", F.col("responsible")))).head()
    one = lambda name, f: docs.filter(f.matches()).select(F.lit(name).alias("filter"), "id")
    return one("client", access.Filters(client_id=c)).unionByName(one("matter", access.Filters(matter_id=m))).unionByName(one("responsible", access.Filters(responsible=r)))


def sql_created() -> str:
    name = S.strip("n")
    id_ = lambda prefix, *cols: f"'{prefix}_' || substr(sha256(concat_ws(chr(31), {', '.join(f'coalesce({c}, chr(0))' for c in cols)})), 1, 12)"
    return f"""with c as (select coalesce(nullif({name}, ''), 'Nouveau client') v, contact from (select name n, contact from clients)), m as (select coalesce(nullif({name}, ''), 'Nouvelle affaire') v, coalesce(nullif({S.strip('status')}, ''), 'active') s from (select responsible n, status from matters)),
    t as (select coalesce(nullif({name}, ''), 'Nouvelle tache') v, coalesce(nullif({S.strip('status')}, ''), 'open') s from (select title n, status from tasks)),
    r as (select 'client' entity, {id_('client', 'v', 'contact')} id, v as name, null status from c union all select 'matter', {id_('matter', 'v', 's')}, v, s from m union all select 'task', {id_('task', 'v', 's')}, v, s from t)
    select entity, id, name, status, 'create' as action, '{USER}' actor_id from r"""


@query(sql_created())
def created_records(spark: SparkSession, root: str) -> DataFrame:
    """New clients, matters and tasks of typed names, and the audit rows of that."""
    made = {
        "client": store.create(load(spark, root, "clients").select("name", "contact"), "client", "Nouveau client"),
        "matter": store.create(load(spark, root, "matters").select(F.col("responsible").alias("name"), "status"), "matter", "Nouvelle affaire", status="active"),
        "task": store.create(load(spark, root, "tasks").select("title", "status"), "task", "Nouvelle tache", name="title", status="open").withColumnRenamed("title", "name"),
    }
    out = None
    for entity, rows in made.items():
        status = F.col("status") if "status" in rows.columns else F.lit(None).cast("string")
        rows = rows.select("id", "name", status.alias("status"), F.lit(MOMENT).cast("timestamp").alias("created_at"))
        log = store.audit(rows, USER, "create", entity).select(F.col("entity_id").alias("id"), "entity", "action", "actor_id").distinct()
        one = rows.join(log, "id").select("entity", "id", "name", "status", "action", "actor_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""with a as (select id, case when text is null then 'no answer' else '{{' || '"title": ' || to_json(title) || ', "doc_type": ' || to_json(type) || ', "doc_date": ' || to_json(document_date::varchar) || ', "persons": ' || to_json(persons) || ', "summary": ' || to_json(summary) || ', "matter_id": ' || to_json(matter_id) || '}}' end said, title, type, document_date, persons, summary, matter_id, text from documents)
    select id, {S.strip("coalesce(title, '')")}[1:140] title, {S.strip("coalesce(type, '')")}[1:80] doc_type, case when document_date::varchar similar to '(19|20)\\d{{2}}-[01]\\d-[0-3]\\d' then document_date end doc_date,
    coalesce(array_to_string((select list(v order by pos) from (select v, min(pos) pos from (select {S.strip('v')} v, pos from (select unnest(coalesce(persons, [])) v, generate_subscripts(coalesce(persons, []), 1) pos)) where v <> '' group by v))[1:12], '; '), '') persons,
    {S.strip("coalesce(summary, '')")}[1:900] summary, nullif(matter_id, '') matter_id from a where text is not null"""
)
def model_answers(spark: SparkSession, root: str) -> DataFrame:
    """A model's answers checked: the documents' own fields as JSON, and no JSON where there is no text."""
    docs = load(spark, root, "documents")
    said = F.when(F.col("text").isNull(), "no answer").otherwise(F.to_json(F.struct("title", F.col("type").alias("doc_type"), F.col("document_date").cast("string").alias("doc_date"), "persons", "summary", "matter_id")))
    a = docs.select("id", analysis.payload(said).alias("a")).filter("a is not null").select("id", "a.*")
    return a.select("id", "title", "doc_type", "doc_date", joined("persons"), "summary", "matter_id")


def sql_noise() -> str:
    words = "len(regexp_extract_all(t, '[A-Za-zÀ-ÿ0-9]+'))"
    letters, vowels = "length(regexp_replace(t, '[^\\p{L}]', '', 'g'))", "length(regexp_replace(lower(t), '[^aeiouyàâäéèêëîïôöùûüœ]', '', 'g'))"
    return f"""with l as (select distinct id, unnest(string_split(coalesce(raw_text, text, ''), chr(10))) line from pages), c as (select id, line, conf, {S.readable('line')} t from l, (values (0.6::double), (0.72::double), (0.9::double)) v(conf))
    select conf, count(*) lines, count(*) filter (where t = '' or (conf < 0.65 and {words} <= 1) or (conf < 0.75 and length(t) <= 4 and upper(t) = t and {letters} > 0 and not regexp_matches(t, '\\d')) or (conf < 0.7 and {sql_semantic('t')} < 0.25) or (conf < 0.7 and {letters} >= 5 and {vowels} / {letters}::double < 0.18)) noise from (select distinct * from c) group by conf"""


@query(sql_noise())
def ocr_noise(spark: SparkSession, root: str) -> DataFrame:
    """How many lines of the pages an engine's segment filter would drop at three confidences."""
    lines = load(spark, root, "pages").select("id", F.explode(F.split(F.coalesce("raw_text", "text", F.lit("")), "\n")).alias("line")).distinct()
    each = lines.select("line", F.explode(F.array(*[F.lit(c) for c in (0.6, 0.72, 0.9)])).alias("conf"))
    return each.groupBy("conf").agg(F.count("*").alias("lines"), F.count_if(ocr.segment_is_noise("line", "conf")).alias("noise"))
