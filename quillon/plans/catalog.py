"""The core queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import lexicons as L
from quillon.functions import facts
from quillon.functions import text as T
from quillon.operators import access, analysis, dashboard, orphans, search, store
from quillon.runtime import checked_broadcast, latest_by_id, load, staged
from quillon.sources import files, ocr
from quillon.streaming import landing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

USER, TEXT_QUERY = "user_001", "facture du contrat de garantie"
PROBE = "select embedding from pages where id = (select min(id) from pages where len(embedding) = 64 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0)"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def tables(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    return {n: load(spark, root, n) for n in names}


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_tokens(expr: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({expr}, '')), '[a-zA-ZÀ-ÿ0-9'']+'), lambda t: length(t) > 1 and not list_contains({sql_list(L.STOP_WORDS)}, t))"


def probe(spark: SparkSession, root: str) -> list[float]:
    """The vector of the first usable page by id (one row is read)."""
    usable = (F.size("embedding") == 64) & (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x)) > 0)
    return list(load(spark, root, "pages").filter(usable).select("id", "embedding").orderBy("id").head()["embedding"])


# --- tokens and quality ---------------------------------------------------------------------------


@query(f"select doc_id, len(t)::bigint n_tokens, len(list_distinct(t))::bigint n_distinct from (select doc_id, {sql_tokens('text')} t from documents)")
def token_counts(spark, root):
    t = load(spark, root, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@query(
    f"""with n as (select lang, t token, count(*) n from (select lower(trim(lang)) lang, unnest({sql_tokens('text')}) t from documents) where lang is not null group by all)
    select lang, token, n from (select *, row_number() over (partition by lang order by n desc, token) r from n) where r <= 10"""
)
def term_frequency_topk(spark, root):
    from pyspark.sql import Window

    words = load(spark, root, "documents").select(F.lower(F.trim("lang")).alias("lang"), F.explode(T.tokens("text")).alias("token")).filter("lang is not null")
    n = words.groupBy("lang", "token").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))).filter("r <= 10").drop("r")


SQL_QUALITY = r"""select {key}, case when t = '' then 'empty' when c >= 0.72 then 'good' when c >= 0.45 then 'medium' else 'low' end quality, case when t = '' then 0.0 else round(c, 3) end confidence
from (select {key}, t, least(0.48 * length(regexp_replace(t, '[^\p{{L}}\p{{N}}'' \-_.,;:!?()\[\]{{}}"/@+*=#%€$&\n\r\t]', '', 'g')) / n + 0.22 * length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / n
 + 0.1 * least(3.0 * (length(regexp_replace(t, '[^\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}\x{{85}}\x{{2028}}\x{{2029}}]', '', 'g')) / n), 1.0) + 0.2 * least(length(t) / 1200.0, 1.0), 1.0) c
 from (select {key}, t, greatest(length(t), 1)::double n from (select {key}, regexp_replace(coalesce({text}, ''), '^[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}\x{{85}}\x{{2028}}\x{{2029}}]+|[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}\x{{85}}\x{{2028}}\x{{2029}}]+$', '', 'g') t from {table})))"""


@query(SQL_QUALITY.format(key="doc_id", text="text", table="documents"))
def text_quality(spark, root):
    return load(spark, root, "documents").select("doc_id", T.quality("text").alias("q")).select("doc_id", "q.*")


@query("select stored, computed, count(*) n from (select distinct p.id, p.quality stored, q.quality computed from pages p join (" + SQL_QUALITY.format(key="id", text="text", table="pages") + ") q on p.id = q.id) group by all")
def quality_agreement(spark, root):
    """Stored against computed quality of the pages, a confusion table."""
    p = load(spark, root, "pages").select("id", F.col("quality").alias("stored"), T.quality("text")["quality"].alias("computed")).distinct()
    return p.groupBy("stored", "computed").agg(F.count("*").alias("n"))


@query(
    f"""select id, case when n = 0 then 0.0 else round(greatest(0.0, least(0.72 * good / n + 0.28 * least(hits / 4.0, 1.0) - least(long::double / n, 0.4), 1.0)), 4) end score from (
    select id, len(w)::double n, len(list_filter(w, lambda x: length(x) <= 2 or (length(x) <= 28 and length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) > 0 and length(regexp_replace(x, '[^aeiouyàâäéèêëîïôöùûüœ]', '', 'g')) / length(regexp_replace(x, '[^\\p{{L}}]', '', 'g'))::double >= 0.18))) good,
    len(list_filter(w, lambda x: list_contains({sql_list(L.COMMON_WORDS)}, x))) hits, len(list_filter(w, lambda x: length(x) > 22)) long
    from (select distinct id, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-ZÀ-ÿ]{{2,}}') w from pages))"""
)
def semantic_text_score(spark, root):
    return load(spark, root, "pages").select("id", F.round(T.semantic_score("text"), 4).alias("score")).distinct()


# --- search -----------------------------------------------------------------------------------------

Q = T.tokenize(TEXT_QUERY)
WIDE = T.expand(Q)


def sql_search(where: str = "true", vector: bool = False) -> str:
    score = "0.65 * exact + 0.35 * hint + bonus"
    if vector:
        score = "case when len(embedding) > 0 then 0.35 * exact + 0.55 * greatest(hint, near) + 0.10 * hint + bonus else 0.65 * exact + 0.35 * greatest(hint, near) + bonus end"
    near = f"case when len(embedding) = 64 and not list_contains(list_transform(embedding, lambda x: x is null), true) and list_sum(list_transform(embedding, lambda x: abs(x))) > 0 then list_cosine_similarity(list_resize(list_transform(embedding, lambda x: coalesce(x, 0.0)), 64, 0.0), ({PROBE})) else 0.0 end" if vector else "0.0"
    tf = lambda w: f"len(list_filter(tk, lambda x: x = '{w}'))"
    counts = {w: Q.count(w) for w in dict.fromkeys(Q)}
    return f"""with d as (select * from documents, (select allowed_client_ids c, allowed_matter_ids m from users where id = '{USER}')
  where status = 'indexed' and (coalesce(matter_id <> '' and list_contains(m, matter_id), false) or coalesce(client_id <> '' and list_contains(c, client_id), false) or (coalesce(matter_id, '') = '' and coalesce(client_id, '') = '')) and {where}),
b as (select p.id page_id, p.document_id, p.page_number, p.ordinal, p.embedding, d.filename, d.client_id, d.matter_id, d.title, d.type, d.doc_type,
  list_aggregate(list_filter([d.title, d.type, d.doc_type, d.summary, list_aggregate(coalesce(d.persons, []), 'string_agg', ' '), list_aggregate(coalesce(d.tags, []), 'string_agg', ' '), p.text], lambda x: x is not null and x <> ''), 'string_agg', chr(10)) body
  from (select distinct on (id) * from pages order by id, ordinal) p join d on p.document_id = d.id),
t as (select *, {sql_tokens('body')} tk from b),
s as (select *, case when len(tk) > 0 then ({' + '.join(f'{n} * {tf(w)}' for w, n in counts.items())}) / greatest(sqrt({sum(n * n for n in counts.values())}) * sqrt(list_sum(list_transform(map_values(list_histogram(tk)), lambda x: x * x))), 1e-9) else 0.0 end exact,
  case when len(tk) > 0 then ({' + '.join(tf(w) for w in WIDE)}) / len(list_distinct(tk))::double else 0.0 end hint, case when contains(lower(body), '{TEXT_QUERY}') then 0.25 else 0.0 end bonus, {near} near from t),
r as (select *, {score} raw from s)
select page_id, document_id, page_number, coalesce(nullif(title, ''), filename) title, coalesce(nullif(doc_type, ''), nullif(type, ''), '') document_type, coalesce(mm.name, '') matter_name, coalesce(cc.name, '') client_name,
 round(raw, 4) score, round(exact, 4) exact_score, round({'greatest(hint, near)' if vector else 'hint'}, 4) semantic_score,
 case when st > 0 then '... ' else '' end || trim(regexp_replace(substr(body, st + 1, least(pos + 220, length(body)) - st), '[\\s\\x{{A0}}\\x{{202F}}\\x{{2009}}]+', ' ', 'g')) || case when pos + 220 < length(body) then ' ...' else '' end excerpt
from (select *, greatest(pos - 90, 0) st from (select *, coalesce(list_min(list_filter([{', '.join(f"instr(lower(body), '{w}')" for w in WIDE)}], lambda x: x > 0)), 1) - 1 pos from r)) x
left join (select id, arg_max(name, created_at) name from matters group by id) mm on mm.id = x.matter_id left join (select id, arg_max(name, created_at) name from clients group by id) cc on cc.id = x.client_id
where raw > 0 order by round(raw, 4) desc, ordinal limit 50"""


def _search(spark, root, filters=access.Filters(), vector=None):
    t = tables(spark, root, "documents", "pages", "matters", "clients", "users")
    return search.search(t, TEXT_QUERY, access.Rights.of(t["users"], USER), filters, vector)


@query(sql_search())
def search_lexical(spark, root):
    return _search(spark, root)


@query(sql_search())
def search_indexed(spark, root):
    """The same search over a postings table, which this query writes first; a deployment keeps it."""
    t = tables(spark, root, "documents", "pages", "matters", "clients", "users")
    index = staged(search.postings(t), "postings", "bucket")
    return search.search_postings(index, t, TEXT_QUERY, access.Rights.of(t["users"], USER))


FILTER_SQL = "(type = 'Quittance de loyer' or doc_type = 'Quittance de loyer') and (document_date is null or document_date between date '2015-01-01' and date '2022-12-31')"


@query(sql_search(FILTER_SQL))
def search_filtered(spark, root):
    from datetime import date

    return _search(spark, root, access.Filters(type="Quittance de loyer", from_date=date(2015, 1, 1), to_date=date(2022, 12, 31)))


@query(sql_search(vector=True))
def search_hybrid(spark, root):
    return _search(spark, root, vector=probe(spark, root))


@query(
    f"""select page_id, similarity from (select distinct id page_id, round(case when len(embedding) = 64 and not list_contains(list_transform(embedding, lambda x: x is null), true) and list_sum(list_transform(embedding, lambda x: abs(x))) > 0 then list_cosine_similarity(list_resize(list_transform(embedding, lambda x: coalesce(x, 0.0)), 64, 0.0), ({PROBE})) else 0.0 end, 4) similarity from pages) order by similarity desc, page_id limit 25"""
)
def dense_cosine_topk(spark, root):
    return search.cosine_topk(load(spark, root, "pages"), probe(spark, root))


@query(
    """with d as (select client_id, matter_id, count(*) n from documents group by all)
    select u.id user_id, coalesce(sum(n) filter (where coalesce(matter_id <> '' and list_contains(allowed_matter_ids, matter_id), false) or coalesce(client_id <> '' and list_contains(allowed_client_ids, client_id), false) or (coalesce(matter_id, '') = '' and coalesce(client_id, '') = '')), 0)::bigint visible
    from users u, d group by u.id"""
)
def acl_visible(spark, root):
    return access.visible_counts(load(spark, root, "users"), load(spark, root, "documents"))


EXCERPT_WORDS = ["facture", "contrat", "annexe"]


@query(
    f"""select doc_id, case when st > 0 then '... ' else '' end || trim(regexp_replace(substr(text, st + 1, least(pos + 220, length(text)) - st), '[\\s\\x{{A0}}\\x{{202F}}\\x{{2009}}]+', ' ', 'g')) || case when pos + 220 < length(text) then ' ...' else '' end excerpt
    from (select *, greatest(pos - 90, 0) st from (select doc_id, text, coalesce(list_min(list_filter([{', '.join(f"instr(lower(text), '{w}')" for w in EXCERPT_WORDS)}], lambda x: x > 0)), 1) - 1 pos from documents where text is not null))"""
)
def excerpt(spark, root):
    return load(spark, root, "documents").filter("text is not null").select("doc_id", T.excerpt("text", EXCERPT_WORDS).alias("excerpt"))


# --- facts ----------------------------------------------------------------------------------------


@query(
    r"""with f as (select doc_id, coalesce(text, '') t from documents), x as (select doc_id,
    regexp_extract(t, '(?:^|[^\p{L}\p{N}_])([0-3]?\d)[/-]([01]?\d)[/-]((?:19|20)\d{2})(?:$|[^\p{L}\p{N}_])', ['d', 'm', 'y']) a,
    regexp_extract(t, '(?:^|[^\p{L}\p{N}_])([0-3]?\d)\s+([a-zA-ZÀ-ÿ]+)\s+((?:19|20)\d{2})(?:$|[^\p{L}\p{N}_])', ['d', 'm', 'y']) b,
    regexp_extract(t, '(?:^|[^\p{L}\p{N}_])((?:19|20)\d{2})-([01]\d)-([0-3]\d)(?:$|[^\p{L}\p{N}_])', ['y', 'm', 'd']) c from f),
    m as (select *, map_extract(MONTHS, lower(b.m))[1] mm from x)
    select doc_id, case when a.d <> '' then try_cast(a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0') as date) when mm is not null then try_cast(b.y || '-' || lpad(mm, 2, '0') || '-' || lpad(b.d, 2, '0') as date)
    when c.d <> '' then try_cast(c.y || '-' || c.m || '-' || c.d as date) end text_date from m""".replace("MONTHS", "map {" + ", ".join(f"'{k}': '{v}'" for k, v in L.MONTHS.items()) + "}")
)
def extract_dates(spark, root):
    return load(spark, root, "documents").select("doc_id", facts.text_date("text").alias("text_date"))


@query(
    f"""with t as (select doc_id, list_distinct({sql_tokens('text')}) w from documents)
    select doc_id, array_to_string(list_filter([{', '.join(f"case when list_has_any(w, {sql_list(v)}) then '{k}' end" for k, v in L.TAG_KEYWORDS.items())}], lambda x: x is not null)[1:6], ',') tags from t"""
)
def tags(spark, root):
    w = F.array_distinct(T.tokens("text"))
    return load(spark, root, "documents").select("doc_id", w.alias("w")).select("doc_id", F.array_join(facts.tags(F.col("w"), F.lit("")), ",").alias("tags"))


def sql_matter_words() -> str:
    hints = "map {" + ", ".join(f"'{k}': {sql_list(v)}" for k, v in L.MATTER_HINTS.items()) + "}"
    return f"list_distinct(list_concat({sql_tokens("concat_ws(' ', coalesce(name, ''), coalesce(responsible, ''))")}, flatten(list_transform({sql_tokens("concat_ws(' ', coalesce(name, ''), coalesce(responsible, ''))")}, lambda t: coalesce(map_extract({hints}, t)[1], [])))))"


@query(
    f"""with m as (select id, name, created_at, {sql_matter_words()} w from (select id, arg_min(name, created_at) name, arg_min(responsible, created_at) responsible, min(created_at) created_at from matters group by id)),
    d as (select doc_id, lower(coalesce(text, '')) low, list_distinct({sql_tokens('text')}) w, list_filter([{', '.join(f"case when list_has_any({sql_tokens('text')}, {sql_list(v)}) then '{k}' end" for k, v in L.TAG_KEYWORDS.items())}], lambda x: x is not null)[1:6] g from documents),
    s as (select doc_id, m.id matter_id, m.created_at, list_contains(g, 'fiscal') f, len(list_intersect(list_distinct(list_concat(d.w, g)), m.w)) / greatest(len(m.w), 1)::double + case when m.name <> '' and contains(low, lower(m.name)) then 0.35 else 0.0 end score from d, m)
    select doc_id, matter_id, round(score, 6) score from (select *, row_number() over (partition by doc_id order by score desc, created_at, matter_id desc) r from s) where r = 1 and score >= case when f then 0.22 else 0.14 end"""
)
def matter_match(spark, root):
    """The matter each document's text points to, by words through an inverted index."""
    w = F.array_distinct(T.tokens("text"))
    docs = load(spark, root, "documents").select(F.col("doc_id").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("low_text"), w.alias("words")).withColumn("labels", facts.tags(F.col("words"), F.lit("")))
    found = analysis.classify_matter(docs, load(spark, root, "matters"))
    return found.select(F.col("id").alias("doc_id"), "matter_id", F.round("matter_score", 6).alias("score"))


# --- overview, lists, joins -------------------------------------------------------------------------


@query(
    """select (select count(*) from clients) clients, (select count(*) from matters) matters, count(*) documents, count(*) filter (where status = 'indexed') indexed, count(*) filter (where analysis_method <> '') analyzed,
    count(*) filter (where status in ('imported', 'ocr_pending', 'ocr_processing')) pending, count(*) filter (where status in ('error', 'low_quality')) errors, (select count(*) from tasks where status = 'open') open_tasks, (select count(*) from pages where len(embedding) > 0) semantic_pages from documents"""
)
def dashboard_counts(spark, root):
    return dashboard.counts(tables(spark, root, "clients", "matters", "documents", "tasks", "pages"))


@query("select id, actor_id, action, entity, entity_id, created_at from (select distinct id, actor_id, action, entity, entity_id, created_at from audit_logs) order by created_at desc, id limit 25")
def audit_latest(spark, root):
    return dashboard.newest(load(spark, root, "audit_logs").select("id", "actor_id", "action", "entity", "entity_id", "created_at").distinct(), 25)


@query("select distinct id, title, assignee, due_date from tasks where status = 'open'")
def open_tasks(spark, root):
    t = load(spark, root, "tasks").filter(F.col("status") == "open").select("id", "title", "assignee", "due_date").distinct()
    return dashboard.tasks_by_due(t)


@query("select id, title, created_at from documents order by created_at desc, id limit 50")
def documents_newest(spark, root):
    return dashboard.newest(load(spark, root, "documents").select("id", "title", "created_at"), 50)


@query("select date_trunc('day', created_at) as start, action, count(*) n from audit_logs where created_at is not null group by all")
def audit_windows(spark, root):
    """The streaming aggregation over a finished table."""
    return landing.counts_per_window(load(spark, root, "audit_logs"))


def sql_case(column: str, labels: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in labels.items()) + f" else {column} end"


@query(f"select id, {sql_case('status', dashboard.STATUS_LABELS)} status_label, {sql_case('quality', dashboard.QUALITY_LABELS)} quality_label, floor(confidence * 100 + 0.5)::bigint percent, created_at::date as day from documents")
def labels(spark, root):
    return dashboard.labelled(load(spark, root, "documents"))


@query(
    """with m as (select id, arg_max(name, created_at) n, arg_max(client_id, created_at) c from matters group by id), c as (select id, arg_max(name, created_at) n from clients group by id)
    select d.id, coalesce(m.n, '') matter_name, coalesce(c.n, '') client_name from documents d left join m on m.id = d.matter_id left join c on c.id = d.client_id"""
)
def display_names(spark, root):
    name = lambda t, k: checked_broadcast(latest_by_id(load(spark, root, t).select("id", "name", "created_at")).select(F.col("id").alias(k), F.col("name").alias(t)))
    d = load(spark, root, "documents").select("id", "matter_id", "client_id")
    return d.join(name("matters", "matter_id"), "matter_id", "left").join(name("clients", "client_id"), "client_id", "left").select("id", F.coalesce("matters", F.lit("")).alias("matter_name"), F.coalesce("clients", F.lit("")).alias("client_name"))


@query("with m as (select id, arg_max(client_id, created_at) c from matters group by id) select d.id, coalesce(nullif(d.client_id, ''), nullif(m.c, '')) client_id from documents d left join m on m.id = d.matter_id")
def client_sync(spark, root):
    d = load(spark, root, "documents").select("id", "client_id", "matter_id")
    return analysis.sync_client(d, load(spark, root, "matters")).select("id", "client_id")


@query(
    """with p as (select distinct on (id) id, document_id, coalesce(page_number, 0) n, ordinal, coalesce(text, '') t from pages order by id, ordinal)
    select document_id, case when count(*) = 1 then any_value(t) else string_agg('--- Page ' || n || ' ---' || chr(10) || t, chr(10) || chr(10) order by n, ordinal, t) end as text from p group by 1"""
)
def document_text(spark, root):
    return analysis.document_text(load(spark, root, "pages"))


# --- sources and changes ------------------------------------------------------------------------------


@query(
    """select id, case when lower(regexp_extract(filename, '(\\.[^./]*)$', 1)) in ('.txt', '.md', '.csv', '.json', '.html', '.xml', '.rtf') or lower(coalesce(mime_type, '')) like 'text/%' then 'text'
    when lower(regexp_extract(filename, '(\\.[^./]*)$', 1)) = '.pdf' or lower(mime_type) = 'application/pdf' then 'pdf'
    when lower(regexp_extract(filename, '(\\.[^./]*)$', 1)) in ('.png', '.jpg', '.jpeg', '.tif', '.tiff', '.bmp', '.webp') or lower(mime_type) like 'image/%' then 'image' else 'unsupported' end route from documents"""
)
def format_dispatch(spark, root):
    return load(spark, root, "documents").select("id", files.route("filename", "mime_type").alias("route"))


@query("select id, substr(regexp_replace(case when trim(filename) = '' or filename is null then 'document' else trim(regexp_extract(filename, '([^/]*)/*$', 1)) end, '[^a-zA-Z0-9._ -]+', '_', 'g'), 1, 160) safe_name from documents")
def safe_names(spark, root):
    return load(spark, root, "documents").select("id", T.safe_filename("filename").alias("safe_name"))


@query(
    """with gone as (select id from documents where status = 'low_quality')
    select document_id, page_number, text from (select distinct id, document_id, page_number, text from pages where document_id not in (select id from gone)) union all select id, 1, text from documents where id in (select id from gone)"""
)
def reprocess_merge(spark, root):
    """Pages of doubtful documents replaced by their re-extracted text."""
    d = load(spark, root, "documents").filter("status = 'low_quality'").select(F.col("id").alias("document_id"), "text")
    pages = load(spark, root, "pages").select("id", "document_id", "page_number", "text").distinct()
    new = d.select(T.stable_id("page", "document_id").alias("id"), "document_id", F.lit(1).alias("page_number"), "text")
    return store.replace_pages(pages, new, d).select("document_id", "page_number", "text")


@query("select case when status = 'error' then 'error' else 'warning' end as level, count(*) n from documents where status in ('ocr_pending', 'low_quality', 'error') group by 1")
def alert_levels(spark, root):
    return store.alerts(load(spark, root, "documents")).groupBy("level").agg(F.count("*").alias("n"))


@query(
    f"""with w as (select distinct unnest({sql_tokens('text')}) token from documents), x as (select token, unnest({sql_list(L.OCR_TERMS)}) term from w where length(token) >= 5)
    select token, term, levenshtein(ascii, term) distance from (select *, regexp_replace(token, '[^ -~]', '~', 'g') as ascii from x) where abs(length(token) - length(term)) <= 2 and levenshtein(ascii, term) <= 2"""
)
def levenshtein_terms(spark, root):
    """Distinct tokens within two edits of a domain term; the terms are a fixed list, compared inside the row."""
    w = load(spark, root, "documents").select(F.explode(T.tokens("text")).alias("token")).distinct().filter(F.length("token") >= 5)
    near = F.array(*[F.struct(F.lit(t).alias("term"), F.when(F.abs(F.length("token") - len(t)) <= 2, F.levenshtein("token", F.lit(t), 2)).otherwise(-1).alias("distance")) for t in L.OCR_TERMS])
    return w.select("token", F.explode(F.filter(near, lambda x: x["distance"] >= 0)).alias("x")).select("token", "x.term", F.col("x.distance").cast("bigint").alias("distance"))


# --- references ------------------------------------------------------------------------------------------

REFERENCE_TABLES = ("pages", "documents", "tasks", "matters", "clients", "audit_logs")


def sql_key(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"


def sql_direct(table: str, column: str, target: str) -> str:
    marked = "arg_max(lower(trim(coalesce(status, ''))) = 'deleted', created_at)" if target == "matters" else "false"
    return f"""select '{table}' table_name, '{column}' column_name, row_id, case when first is null then case when logged then 'deleted' else 'missing' end when marked then 'deleted' else 'late' end reason, row_at created_at
 from (select r.id row_id, {sql_key('r.' + column)} k, min(r.created_at) row_at from {table} r group by 1, 2) x
 left join (select {sql_key('id')} k, min(created_at) first, {marked} marked from {target} group by 1) t using (k)
 left join (select distinct {sql_key('entity_id')} k, true logged from audit_logs where action like 'delete\\_%' escape '\\') l using (k)
 where k is not null and (first is null or marked or first > row_at)"""


DIRECT = " union all ".join(sql_direct(r.table, r.column, r.target) for r in orphans.GRAPH if r.reported)


@query(f"select distinct table_name, column_name, row_id, reason from ({DIRECT})")
def p4_found(spark, root):
    return orphans.unsound_references(tables(spark, root, *REFERENCE_TABLES)).select("table_name", "column_name", "row_id", "reason").distinct()


@query(f"select table_name, column_name, strftime(created_at, '%Y-%m') as month, reason, count(distinct row_id) n from ({DIRECT}) group by all")
def p4_monthly(spark, root):
    found = orphans.unsound_references(tables(spark, root, *REFERENCE_TABLES))
    return found.groupBy("table_name", "column_name", F.date_format("created_at", "yyyy-MM").alias("month"), "reason").agg(F.count_distinct("row_id").alias("n"))


def sql_cascade() -> str:
    heads = " union ".join(f"select table_name, row_id from ({sql_direct(r.table, r.column, r.target)}) where reason <> 'late'" for r in orphans.GRAPH)
    steps = " union ".join(f"select '{r.table}', c.id from g join {r.table} c on g.table_name = '{r.target}' and {sql_key('c.' + r.column)} = {sql_key('g.row_id')}" for r in orphans.GRAPH)
    return f"""with recursive h as ({heads}), g(table_name, row_id) as (select * from h union select * from ({steps}))
    select table_name, row_id, case when exists (select 1 from h where h.table_name = g.table_name and h.row_id = g.row_id) then 'direct' else 'inherited' end kind from g"""


@query(sql_cascade())
def p4_cascade(spark, root):
    return orphans.cascade(tables(spark, root, *REFERENCE_TABLES)).select("table_name", "row_id", "kind")


@query(f"select table_name, strftime(born, '%Y-%m') as month, kind, count(*) n from (select c.*, coalesce(a, b, d, e, f) born from ({sql_cascade()}) c " + " ".join(f"left join (select id {v}i, min(created_at) {v} from {t} group by 1) on c.table_name = '{t}' and {v}i = c.row_id" for v, t in zip("abdef", ("pages", "documents", "tasks", "matters", "clients"))) + ") group by all")
def p4_report(spark, root):
    """Direct and inherited orphans per table and month."""
    c = orphans.cascade(tables(spark, root, *REFERENCE_TABLES))
    return c.groupBy("table_name", F.date_format("created_at", "yyyy-MM").alias("month"), "kind").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    from quillon.plans import documents  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
