"""SQL of the document analysis, put together from pieces over relations that a caller names."""

from __future__ import annotations

from quillon import lexicons as L
from quillon.functions import facts
from quillon.functions import text as T

WS = r"[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{85}\x{2028}\x{2029}]"


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def one_line(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'))"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def tokens(e: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({e}, '')), '[a-zA-ZÀ-ÿ0-9'']+'), lambda t: length(t) > 1 and not list_contains({listed(L.STOP_WORDS)}, t))"


def normal(e: str) -> str:
    for wrong, right in (("ﬁ", "fi"), ("ﬂ", "fl"), ("œ", "oe"), ("æ", "ae"), ("…", "..."), ("²", "2"), ("³", "3"), ("№", "No"), ("½", "1/2"), ("¾", "3/4"), ("¼", "1/4"), ("™", "TM"), ("ﬀ", "ff"), ("ª", "a"), ("º", "o")):
        e = f"replace({e}, '{wrong}', '{right}')"
    return f"trim(regexp_replace(lower(strip_accents({e})), '[^a-z0-9]+', ' ', 'g'))"


def dates(source: str) -> str:
    """(id, text_date) of a relation (id, t)."""
    months = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in L.MONTHS.items()) + "}"
    edge = r"[^\p{L}\p{N}_]"
    return rf"""(with x as (select id,
    regexp_extract(t, '(?:^|{edge})([0-3]?\d)[/-]([01]?\d)[/-]((?:19|20)\d{{2}})(?:$|{edge})', ['d', 'm', 'y']) a,
    regexp_extract(t, '(?:^|{edge})([0-3]?\d){WS}+([a-zA-ZÀ-ÿ]+){WS}+((?:19|20)\d{{2}})(?:$|{edge})', ['d', 'm', 'y']) b,
    regexp_extract(t, '(?:^|{edge})((?:19|20)\d{{2}})-([01]\d)-([0-3]\d)(?:$|{edge})', ['y', 'm', 'd']) c from {source}),
    m as (select *, map_extract({months}, lower(b.m))[1] mm from x)
    select id, case when a.d <> '' then try_cast(a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0') as date) when mm is not null then try_cast(b.y || '-' || lpad(mm, 2, '0') || '-' || lpad(b.d, 2, '0') as date)
    when c.d <> '' then try_cast(c.y || '-' || c.m || '-' || c.d as date) end text_date from m)"""


def persons(source: str) -> str:
    """(id, persons) of a relation (id, t). Blanks are doubled first, so that neighbouring names both have theirs."""
    name, edge = facts.NAME.replace(r"\s+", WS + "+").replace("'", "''"), r"[^\p{L}\p{N}_]"
    titles = facts.TITLES
    patterns = (f"Client{WS}+({name})", f"(?:Monsieur|Madame|Patient|Patiente){WS}+({name})", f"Redacteur{WS}+({titles}{WS}+{name})", f"({titles}{WS}+{name})", f"({name})")
    found = ", ".join(f"regexp_extract_all(t, '(?:^|{edge}){p}(?:$|{edge})', 1)" for p in patterns)
    words = "regexp_extract_all(v, '[A-Za-zÀ-ÿ]+')"
    upper = f"list_distinct(list_transform({words}, lambda w: upper(w)))"
    # A hyphen or apostrophe before a digit or a small letter ends a name in capitals, too.
    return rf"""(with b as (select id, regexp_replace(regexp_replace(t, '([A-Z][A-ZÀ-Ÿ''-]+[''-])([0-9a-zà-ÿ_])', '\1 \2', 'g'), '({WS})', '\1\1', 'g') t from {source}),
    f as (select id, unnest(list_concat({found})) v, generate_subscripts(list_concat({found}), 1) pos from b),
    c as (select id, pos, regexp_replace({one_line("replace(regexp_replace(v, '  +', ' ', 'g'), ' - ', ' ')")}, '^[ .,:;-]+|[ .,:;-]+$', '', 'g') v from f),
    k as (select id, pos, v, regexp_replace(lower(v), '^(?:dr|docteur|maître|maitre){WS}+', '') key from c
     where length(v) between 4 and 60 and lower(v) <> 'service des urgences' and not starts_with(v, 'Affaire ') and len(list_filter({words}, lambda w: length(w) > 24)) = 0 and not list_has_any({upper}, {listed(L.NON_PERSON_TERMS)})
     and not (upper(v) = v and len({upper}) <= 2 and list_has_any({upper}, {listed(L.NON_PERSON_ENDINGS)}))),
    o as (select id, arg_min(v, pos) v, min(pos) pos from k group by id, key)
    select s.id, coalesce(p.persons, []) persons from {source} s left join (select id, list(v order by pos)[1:10] persons from o group by id) p using (id))"""


def doc_types(source: str) -> str:
    """(id, found_type) of a relation (id, n, w): folded text and distinct tokens; null below two points."""
    among = lambda words: f"len(list_intersect(w, {listed(words)}))"
    said = lambda phrases: " + ".join(f"contains(n, '{p}')::int" for p in phrases)
    taxed = f"(({said(L.TAX_PHRASES)}) > 0 or {among(L.TAX_WORDS)} >= 2)"
    energy = f"(({said(L.ENERGY_PHRASES)}) > 0 or {among(L.ENERGY_WORDS)} >= 2)"
    scores = []
    for i, r in enumerate(L.DOC_TYPE_RULES):
        s = f"8 * ({said(r.phrases)}) + {among(r.keywords)}"
        if r.name == "Facture":
            s += f" - 8 * {taxed}::int - 14 * {energy}::int"
        if r.name == "Facture d'energie":
            s += f" + 10 * (({said(r.phrases)}) > 0)::int"
        scores.append(f"1000 * ({s}) + {999 - i}")
    return f"(select id, case when best >= 2000 then {listed(r.name for r in L.DOC_TYPE_RULES)}[1000 - best % 1000] end found_type from (select id, greatest({', '.join(scores)}) best from {source}))"


def tags(words: str) -> str:
    return f"list_filter([{', '.join(f'case when list_has_any({words}, {listed(v)}) then {chr(39)}{k}{chr(39)} end' for k, v in L.TAG_KEYWORDS.items())}], lambda x: x is not null)"


def matter_words() -> str:
    hints = "map {" + ", ".join(f"'{k}': {listed(v)}" for k, v in L.MATTER_HINTS.items()) + "}"
    own = tokens("concat_ws(' ', coalesce(name, ''), coalesce(responsible, ''))")
    return f"list_distinct(list_concat({own}, flatten(list_transform({own}, lambda t: coalesce(map_extract({hints}, t)[1], [])))))"


def analysis(source: str) -> str:
    """The whole analysis of a relation (id, text, filename, type, document_date, matter_id, matter_locked)."""
    sentences = f"list_filter(list_transform(string_split(regexp_replace(t, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: length(x) > 35)[1:2]"
    line = f"list_filter(list_transform(regexp_split_to_array(t, '[\\n.]'), lambda x: {one_line('x')}), lambda x: length(x) > 3)[1]"
    return f"""(with s as (select *, coalesce(text, '') t from {source}),
    w as (select id, t, list_distinct({tokens('t')}) w, {normal('t')} n from s),
    a as (select s.*, w.w, coalesce(y.found_type, nullif(s.type, ''), 'Document') kind, coalesce(d.text_date, s.document_date) dday, p.persons people from s join w using (id) join {doc_types('w')} y using (id) join {dates('(select id, t from s)')} d using (id) join {persons('(select id, t from s)')} p using (id)),
    b as (select *, {tags('w')} hit from a),
    g as (select *, (case when list_contains(hit, lower(kind)) then hit else list_concat([lower(kind)], hit) end)[1:6] labels from b),
    m as (select id mid, name mname, stored, {matter_words()} mw from (select id, arg_min(name, created_at) name, arg_min(responsible, created_at) responsible, min(created_at) stored from matters group by id)),
    sc as (select g.id, mid, stored, list_contains(labels, 'fiscal') f, len(list_intersect(list_distinct(list_concat(w, labels)), mw)) / greatest(len(mw), 1)::double + case when mname <> '' and contains(lower(t), lower(mname)) then 0.35 else 0.0 end score from g, m),
    mm as (select id, mid, score from (select *, row_number() over (partition by id order by score desc, stored, mid desc) r from sc) where r = 1 and score >= case when f then 0.22 else 0.14 end),
    h as (select g.*, case when matter_locked then g.matter_id else mm.mid end chosen, case when matter_locked then 1.0 else coalesce(mm.score, 0.0) end ms,
      kind || case when len(people) > 0 then ' - ' || people[1] else '' end || case when dday is not null then ' (' || dday::varchar || ')' else '' end head,
      'Document analyse comme ' || kind || case when dday is not null then ' date du ' || dday::varchar else '' end || case when len(people) > 0 then ', concernant ' || array_to_string(people[1:3], ', ') else '' end || '.' intro, {sentences} said, {line} line
      from g left join mm using (id))
    select id, left(case when head = 'Document' then coalesce(case when length(line) > 137 then left(line, 137) || '...' else line end, nullif(filename, ''), 'Document') else head end, 140) title, kind doc_type, dday doc_date, people persons,
      left(concat_ws(' ', intro, case when len(labels) > 0 then 'Themes detectes: ' || array_to_string(labels[1:5], ', ') || '.' end, array_to_string(said, ' ')), 900) summary, labels tags, chosen matter_id, 'local-rules' as method,
      round(least(0.52 + least(len(w) / 180.0, 0.22) + least(ms, 0.16), 0.92), 3) confidence from h)"""


def readable(text: str) -> str:
    """Unreadable characters and white space as single blanks."""
    return one_line(rf"regexp_replace(replace({text}, chr(0), ' '), '[^\p{{L}}\p{{N}}'' \-_.,;:!?()\[\]{{}}\"/@+*=#%€$&\n\r\t]', ' ', 'g')")


def phrases(e: str) -> str:
    """The phrase rules of recognised text, in order."""
    for p, by in L.OCR_PHRASES:
        e = f"regexp_replace({e}, '{p.replace(chr(39), chr(39) * 2)}', '{by.replace(chr(39), chr(39) * 2)}', 'gi')"
    return e


def corrected(source: str) -> str:
    """(id, text) of a relation (id, t): cleaned, phrase rules, blanks around marks, words corrected, phrase rules."""
    fixed = "map {" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in L.OCR_WORDS.items()) + "}"
    return rf"""(with c as (select id, coalesce({readable("coalesce(t, '')")}, '') t from {source}),
    p as (select id, {one_line(r"regexp_replace(regexp_replace(" + phrases('t') + r", '\s+([.,;:!?])', '\1', 'g'), '([.,;:!?])([A-Za-zÀ-ÿ])', '\1 \2', 'g')")} t from c),
    u as (select id, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}_'']+|[^\p{{L}}\p{{N}}_'']+')) piece, generate_subscripts(regexp_extract_all(t, '[\p{{L}}\p{{N}}_'']+|[^\p{{L}}\p{{N}}_'']+'), 1) pos from p),
    q as (select distinct piece, regexp_extract(piece, '^''*', 0) front, regexp_extract(piece, '[^'']''*$', 0)[2:] back, trim(piece, '''') word from u),
    w as (select piece, front, back, word, lower(word) low from q where regexp_full_match(word, '[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'']*')),
    d as (select low, min(term) filter (where e = m) term, any_value(m) m from (select *, min(e) over (partition by low) m from (select low, term, levenshtein(regexp_replace(low, '[^ -~]', '~', 'g'), term) e from (select distinct low from w where length(low) >= 5 and regexp_full_match(low, '\p{{L}}+') and not list_contains({listed([*L.OCR_TERMS, *L.OCR_PROTECTED])}, low)), (select unnest({listed(L.OCR_TERMS)}) term) where abs(length(low) - length(term)) <= 2)) group by low),
    r as (select piece, front, back, word, coalesce(map_extract({fixed}, w.low)[1], case when m <= 1 or (m = 2 and length(w.low) >= 9) then term end) fix from w left join d using (low)),
    j as (select id, string_agg(case when fix is null or fix = lower(word) then u.piece else front || case when regexp_matches(word, '^\p{{Lu}}') then upper(fix[1]) || fix[2:] else fix end || back end, '' order by pos) t from u left join r on r.piece = u.piece group by id)
    select c.id, {one_line(phrases("coalesce(j.t, '')"))} as text from c left join j using (id))"""


def quality(text: str) -> tuple[str, str]:
    """Expressions of a stripped text's label and confidence."""
    ws = f"length(regexp_replace({text}, '[^{WS[1:]}', '', 'g'))"
    raw = rf"least(0.48 * length(regexp_replace({text}, '[^\p{{L}}\p{{N}}'' \-_.,;:!?()\[\]{{}}\"/@+*=#%€$&\n\r\t]', '', 'g')) / greatest(length({text}), 1)::double + 0.22 * length(regexp_replace({text}, '[^\p{{L}}]', '', 'g')) / greatest(length({text}), 1)::double + 0.1 * least(3.0 * ({ws} / greatest(length({text}), 1)::double), 1.0) + 0.2 * least(length({text}) / 1200.0, 1.0), 1.0)"
    return f"case when {text} = '' then 'empty' when {raw} >= 0.72 then 'good' when {raw} >= 0.45 then 'medium' else 'low' end", f"case when {text} = '' then 0.0 else round({raw}, 3) end"
