"""SQL of the core queries that SQL can express (DuckDB dialect), over the same whole tables.

Its regular expressions know only ASCII at word boundaries, so texts are first brought to ASCII where that
matters: other letters and digits become ``_``, all else ``~`` or a blank.
"""

from __future__ import annotations

from corpuslane.functions.text import ABBREVIATIONS, CLINICAL_STOPWORDS
from corpuslane.operators.deid import PHI_PATTERNS
from corpuslane.operators.relations import DDI, GENE_DISEASE
from corpuslane.operators.retrieval import SYNONYMS
from corpuslane.operators.sections import NOTE_TYPES


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def _exploded(key: str, rows: str) -> str:
    """(key, pos, sentence) of rows with a list ``p``."""
    return f"select {key}, pos, p[pos + 1] as sentence from (select {key}, p, unnest(range(len(p)))::int as pos from ({rows}))"


SENTENCES_PLAIN = _exploded(
    "doc_id",
    "select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as p from documents where text is not null",
)


def _biomedical(text: str) -> str:
    t = text
    for a in ABBREVIATIONS:
        t = f"regexp_replace({t}, {q(a.replace('.', '[.]'))}, {q(a.replace('.', chr(2)))}, 'gi')"
    some = "|".join(a.replace(".", chr(2)) for a in ABBREVIATIONS)
    t = f"regexp_replace({t}, {q('([.!?])\\s+([A-Z0-9]|' + some + ')')}, '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(1)), lambda x: replace(trim(x), chr(2), '.')), lambda x: x <> '')"


SENTENCES_BIOMEDICAL = _exploded("row_id", f"select row_id, {_biomedical('text')} as p from clinical_notes where text is not null")

CLEAN_WHITESPACE = r"""select row_id, md5(t) as hash, length(t)::int as n_chars from (select row_id, regexp_replace(regexp_replace(regexp_replace(
  text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t\r\f\x0B]+(\n|$)', '\1', 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') as t from clinical_notes)"""

_ASCII = r"regexp_replace(regexp_replace({t}, '[^\x00-\x7F\p{{L}}\p{{N}}]', '~', 'g'), '[^\x00-\x7F]', '_', 'g')"
_RULES = [p.replace(r"[\p{L}\p{N}_-]", "[A-Za-z0-9_-]") for p in PHI_PATTERNS.values()]


def _cascade() -> str:
    rows, n = f"select row_id, {_ASCII.format(t='text')} as t, 0 as n from clinical_notes", 0
    for p in _RULES:
        rows = f"select row_id, regexp_replace(t, {q(p)}, '[REDACTED]', 'gi') as t, n + coalesce(len(regexp_extract_all(t, {q('(?i)' + p)})), 0) as n from ({rows})"
    return f"select row_id, md5(t) as hash, n::int as phi_count from ({rows})"


DEID_TEXT = _cascade()
DEID_AUDIT = " union all ".join(
    f"select {q(k)} as phi_type, sum(n)::bigint as n, count(*) filter (n > 0) as texts from (select coalesce(len(regexp_extract_all({_ASCII.format(t='text')}, {q('(?i)' + p)})), 0) as n from clinical_notes)"
    for k, p in zip(PHI_PATTERNS, _RULES, strict=True)
)
PHI_RESIDUAL = (
    "select section_id, coalesce(" + " or ".join(f"regexp_matches(t, {q('(?i)' + p)})" for p in _RULES) + f", false) as has_phi from (select section_id, {_ASCII.format(t='text')} as t from note_sections)"
)
NOTE_TYPES = (
    "select row_id, case trim(category) " + " ".join(f"when {q(k)} then {q(v)}" for k, v in NOTE_TYPES.items())
    + " else lower(trim(category)) end as note_type, year(chartdate)::int as year from clinical_notes where coalesce(iserror, '') <> '1' and text is not null and trim(text) <> ''"
)

BREAKPOINTS = """with s as (select vec_id, label, list_dot_product(a, b) / (greatest(sqrt(list_dot_product(a, a)), 1e-8) * greatest(sqrt(list_dot_product(b, b)), 1e-8)) as sim
  from (select vec_id, label, embedding::double[] as a, lead(embedding) over (partition by label order by vec_id)::double[] as b from embeddings)),
  c as (select label, quantile_cont(sim, 0.15) as cut from s group by 1)
  select vec_id, s.label, round(sim, 6) as sim, coalesce(sim < cut, false) as is_break from s join c on s.label = c.label"""

DENSE = """select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from (
  select u.vec_id as query_id, v.vec_id as doc_id, round(list_dot_product(u.embedding::double[], v.embedding::double[]), 9) as score
  from embeddings u, embeddings v where u.vec_id % 20 = 0 and {where})) where rank <= 10"""

_TOKENS = (
    r"list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower({t}), '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g'), '\b[a-z][a-z0-9\-]{{1,30}}\b'), "
    + "lambda w: not list_contains([" + ", ".join(q(w) for w in CLINICAL_STOPWORDS) + "], w))"
)


def tokens(t: str) -> str:
    return _TOKENS.format(t=t)


_POSTINGS = f"""tk as (select doc_id, {tokens('text')} as w from documents where text is not null),
  post as (select term, doc_id, dl, count(*) as tf from (select doc_id, len(w) as dl, unnest(w) as term from tk) group by 1, 2, 3),
  st as (select (select count(*) from tk) as n, (select sum(tf) from post)::double / (select count(*) from tk) as avgdl),
  terms as (select term, count(*) as df, ln((any_value(st.n) - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf from post, st group by 1)"""
BM25_STATS = f"with {_POSTINGS} select term, df, round(idf, 6) as idf from terms"


def _bm25(where: str) -> str:
    return f"""{_POSTINGS},
  qt as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({tokens('question')}) as term from eval_items where item_id % 20 = 0) group by 1, 2),
  sc as (select query_id, doc_id, sum(qtf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) as score
    from qt join terms using (term) join post using (term), st where doc_id in (select doc_id from documents where {where}) group by 1, 2),
  bm as (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id)::int as rank from sc where score > 0)"""


def bm25(where: str) -> str:
    return f"with {_bm25(where)} select query_id, doc_id, round(score, 6) as score, rank from bm where rank <= 10"


_HASHED = """
  hw as (select 0 as side, doc_id as id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents where text is not null
    union all select 1, item_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) from eval_items where item_id % 20 = 0),
  hv as (select distinct w, ('0x' || substr(md5(w), 1, 6))::int as h from (select distinct w from hw)),
  hc as (select side, id, (h // 2) % 16 as c, sum(case when h % 2 = 0 then 1 else -1 end)::double as v from hw join hv using (w) group by 1, 2, 3),
  hn as (select side, id, greatest(sqrt(sum(v * v)), 1e-8) as n from hc group by 1, 2),
  hd as (select qq.item_id as query_id, dd.doc_id, round(coalesce(x.s, 0) / (coalesce(nq.n, 1e-8) * coalesce(nd.n, 1e-8)), 9) as score
    from (select item_id from eval_items where item_id % 20 = 0) qq cross join (select doc_id from documents where text is not null) dd
    left join (select a.id as qid, b.id as did, sum(a.v * b.v) as s from hc a join hc b on a.c = b.c where a.side = 1 and b.side = 0 group by 1, 2) x on x.qid = qq.item_id and x.did = dd.doc_id
    left join hn nq on nq.side = 1 and nq.id = qq.item_id left join hn nd on nd.side = 0 and nd.id = dd.doc_id),
  hr as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from hd)"""
HASHED_SEARCH = f"with {_HASHED.strip()} select query_id, doc_id, round(score, 6) as score, rank from hr where rank <= 30"

_RRF = f"""{_bm25('true')}, {_HASHED.strip()},
  fu as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.doc_id, b.doc_id) as doc_id, a.rank as dr, b.rank as sr,
    coalesce(0.7::double / (60 + a.rank), 0) + coalesce(0.3::double / (60 + b.rank), 0) as score
    from (select * from hr where rank <= 30) a full join (select * from bm where rank <= 30) b on a.query_id = b.query_id and a.doc_id = b.doc_id),
  rr as (select *, row_number() over (partition by query_id order by round(score, 12) desc, dr nulls last, sr nulls last, doc_id)::int as rank from fu)"""
RRF = f"with {_RRF} select query_id, doc_id, round(score, 9) as score, rank from rr where rank <= 10"


def word_set(t: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({t}), '[^\s\x0B]+'))"


_F1 = "case when len(list_intersect(a, b)) > 0 then 2.0::double * len(list_intersect(a, b)) / (len(a) + len(b)) else 0.0 end"
RERANK = f"""with {_RRF}, j as (select query_id, doc_id, rank, {word_set('question')} as a, {word_set('text')} as b from rr join documents using (doc_id) join eval_items on item_id = query_id where rank <= 10),
  z as (select query_id, doc_id, {_F1} as s, rank from j), y as (select query_id, doc_id, s, row_number() over (partition by query_id order by round(s, 9) desc, rank)::int as rank from z)
  select query_id, doc_id, round(s, 6) as score, rank from y where rank <= 5"""


def expansion() -> str:
    parts = []
    for term, words in SYNONYMS.items():
        own = "[" + ", ".join(q(w) for w in words[:5]) + "]"
        parts.append(f"case when contains(lower(t), {q(term)}) then list_filter({own}, lambda w: not contains(lower(t), lower(w))) else [] end")
    extra = "(" + " || ".join(parts) + ")[:5]"
    return f"""select item_id, case when len(x) > 0 then t || ' ' || array_to_string(x, ' ') else t end as expanded from (select item_id, t, {extra} as x
      from (select item_id, question || ' ' || case when item_id % 2 = 0 then 'after stroke or heart attack' else 'with diabetes on MRI' end as t from eval_items))"""


RETRIEVAL_METRICS = f"""with hits as ({DENSE.format(where='true')}),
  rel as (select a.vec_id as query_id, b.vec_id as doc_id from embeddings a join embeddings b on a.label = b.label where a.vec_id % 20 = 0),
  n as (select query_id, count(*) as relevant from rel group by 1),
  h as (select hits.query_id, rank, rel.doc_id is not null as hit from hits left join rel on rel.query_id = hits.query_id and rel.doc_id = hits.doc_id),
  ks as (select unnest([1, 3, 5, 10]) as k),
  pq as (select k, h.query_id, count(*) filter (hit and rank <= k) as c, sum(case when hit and rank <= k then 1 / log2(rank + 1) else 0 end) as g, min(rank) filter (hit) as first from h, ks group by 1, 2),
  ideal as (select k, m, sum(1 / log2(i + 1.0::double)) as ig from (select k, m, unnest(range(1, least(k, m) + 1)) as i from ks, (select distinct relevant as m from n)) group by 1, 2)
  select pq.k, round(avg(c / pq.k), 6) as precision, round(avg(c / relevant), 6) as recall, round(avg(g / ig), 6) as ndcg, round(avg(coalesce(1 / first, 0)), 6) as mrr, count(*) as n_queries
  from pq join n using (query_id) join ideal on ideal.k = pq.k and ideal.m = n.relevant group by 1"""

BLEU = r"""with w as (select rec_id as id, regexp_extract_all(lower(title), '[^\s\x0B]+') as h, regexp_extract_all(lower(abstract), '[^\s\x0B]+') as r from pubmed_abstracts where title is not null and abstract is not null),
  ns as (select unnest([1, 2, 3, 4]) as n),
  g as (select id, n, 0 as side, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' '))) as g from w, ns
    union all select id, n, 1, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) from w, ns),
  c as (select id, n, g, count(*) filter (side = 0) as h, count(*) filter (side = 1) as r from g group by 1, 2, 3),
  p as (select n, sum(least(h, r)) as m, sum(h) as t from c group by 1),
  l as (select sum(len(h)) as hl, sum(len(r)) as rl, count(*) as n from w)
  select round(case when hl = 0 then 0 when hl >= rl then 1 else exp(1 - rl / hl) end * exp((select sum(ln(greatest(case when m > 0 then m / t when t > 0 then 1 / pow(2, n) else 0 end, 1e-10))) / 4 from p)), 9) as bleu, n from l"""

ROUGE = f"""select rec_id, round(f, 6) as rouge1, round(f, 6) as "rougeL" from (select rec_id, {_F1} as f from (select rec_id, {word_set('title')} as a, {word_set('abstract')} as b
  from pubmed_abstracts where title is not null and abstract is not null))"""

_EVIDENCE = """ev as (select distinct e.item_id, p.passage_id, p.text from (select item_id, unnest(relevant_doc_ids) as name from eval_items) e
  join (select 'pmid_' || pmid as name, arg_max(abstract, rec_id) filter (abstract is not null) as text, max(rec_id) as passage_id from pubmed_abstracts where pmid is not null group by pmid) p using (name) where p.text is not null)"""
_SENTS = "list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"

ANSWER_SCORES = rf"""with {_EVIDENCE}, g as (select item_id, list(text order by passage_id) as p from ev group by 1),
  j as (select e.item_id, {word_set('question')} as q, {word_set('passage')} as a, {word_set("coalesce(answer, '')")} as t, p, lower(array_to_string(p[:5], ' ')) as ctx,
    list_filter({_SENTS.format(t='passage')}, lambda x: length(x) > 20) as long from eval_items e join g using (item_id)),
  k as (select item_id, case when len(long) > 0 then len(list_filter(long, lambda x: len(list_filter((regexp_split_to_array(lower(x), '\s+'))[:5], lambda w: contains(ctx, w))) > 0)) / len(long) else 1.0 end as f,
    least(2 * case when len(q) > 0 then len(list_intersect(q, a)) / len(q) else 0.0 end, 1.0) as r,
    case when len(t) > 0 then len(list_intersect(t, list_distinct(flatten(list_transform(p, lambda x: {word_set('x')}))))) / len(t) else 1.0 end as c,
    case when len(p) > 0 then len(list_filter(p, lambda x: len(list_intersect(q, {word_set('x')})) / len(q) > 0.15::double)) / len(p) else 0.0 end as pr from j)
  select item_id, round(f::double, 6) as faithfulness, round(r::double, 6) as relevance, round(c::double, 6) as context_recall, round(pr::double, 6) as context_precision,
    round(coalesce(len(list_filter([f, r, c, pr]::double[], lambda x: x > 0)) / list_sum(list_transform(list_filter([f, r, c, pr]::double[], lambda x: x > 0), lambda x: 1 / x)), 0)::double, 6) as overall from k"""

_CONTEXT = f"""{_bm25('true')}, cx as (select query_id, bm.doc_id, rank, score, text, sum(len(regexp_extract_all(text, '\\S+')) * 1.3::double) over (partition by query_id order by rank rows unbounded preceding) as cum
  from bm join documents on documents.doc_id = bm.doc_id where rank <= 8)"""
CONTEXT_SELECT = f"with {_CONTEXT} select query_id, doc_id, rank, round(cum, 6) as cum_tokens from cx where cum <= 1200"
CONTEXT_FORMAT = f"""with {_CONTEXT}, nn as (select query_id, row_number() over (partition by query_id order by rank) as n, text from cx where cum <= 1200)
  select query_id, md5(string_agg('[Doc ' || n || ']' || chr(10) || coalesce(text, '') || chr(10), chr(10) || '---' || chr(10) order by n)) as hash, count(*)::int as n_citations from nn group by 1"""


def _claims(key: str, text: str, tbl: str) -> str:
    return rf"""(select answer_id, i::int as claim_id, c as claim from (select *, row_number() over (partition by answer_id order by i) as k from (
  select answer_id, i, trim(p[i + 1]) as c from (select answer_id, p, unnest(range(len(p))) as i from (
    select {key} as answer_id, string_split(regexp_replace(trim({text}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as p from {tbl} where {text} is not null)))
  where length(c) >= 15 and not regexp_matches(lower(c), '^(note:|disclaimer:|sources:)') and not contains(lower(c), 'confidence level:')) where k <= 20)"""


CLAIMS = f"select * from {_claims('rec_id', 'abstract', 'pubmed_abstracts')}"

_NEG = r"\b(?:no|not|never|without|neither|nor|denies|denied|kein|keine|nicht|ne|pas|sin|ninguna|ninguno)\b"
FAITHFULNESS = rf"""with {_EVIDENCE}, cl as {_claims('item_id', 'passage', 'eval_items')},
  s as (select answer_id, claim_id, passage_id, case when len(a) > 0 then len(list_intersect(a, b)) / len(a) else 0.0 end::double as share, fl from (
    select answer_id, claim_id, passage_id, {word_set('claim')} as a, {word_set('text')} as b,
      regexp_matches({_ASCII.format(t='lower(claim)')}, {q(_NEG)}) <> regexp_matches({_ASCII.format(t='lower(text)')}, {q(_NEG)}) as fl from cl left join ev on ev.item_id = cl.answer_id)),
  v as (select answer_id, claim_id, max(round(case when fl then 0.0 else share end, 9)) as e, max(case when fl then share else 0.0 end) as c from s group by 1, 2),
  g as (select answer_id, count(*) as claims, count(*) filter (e >= 0.7::double) as supported, count(*) filter (coalesce(e, 0) < 0.7::double and c > 0.5::double) as contradicted from v group by 1)
  select item_id as answer_id, coalesce(claims, 0) as claims, coalesce(supported, 0) as supported, coalesce(contradicted, 0) as contradicted,
    coalesce(claims - supported - contradicted, 0) as neutral, round(coalesce(supported / claims, 1.0)::double, 6) as faithfulness from eval_items left join g on g.answer_id = item_id"""


def _relation(rules: tuple, lower: bool) -> str:
    out = []
    for p, s, o, kind, conf, _ in rules:
        rx = q("(?i)" + p)
        low = "lower" if lower else ""
        out.append(
            f"select rec_id as doc_id, {low}(trim(unnest(regexp_extract_all(abstract, {rx}, {s})))) as subject, {low}(trim(unnest(regexp_extract_all(abstract, {rx}, {o})))) as object, "
            f"{q(kind)} as kind, {conf}::double as confidence from pubmed_abstracts where abstract is not null"
        )
    return " union all ".join(out)


def ddi() -> str:
    return f"select distinct * from ({_relation(DDI, True)})"


def gene_disease() -> str:
    return _relation(GENE_DISEASE, False)


LABEL_ACCURACY = r"""with x as (select lower(answer) as gold, case when regexp_matches(t, '^yes') or regexp_matches(t, '\byes[,. ]') then 'yes' when regexp_matches(t, '^no') or regexp_matches(t, '\bno[,. ]') then 'no' else 'maybe' end as p
  from (select answer, lower(concat_ws(' ', case item_id % 3 when 0 then 'Yes,' when 1 then 'It is no, as' end, passage)) as t from eval_items where answer is not null))
  select case when grouping(gold) = 1 then 'all' else gold end as label, round(avg((gold = p)::int::double), 6) as accuracy, count(*) as n from x group by rollup(gold)"""

BIOASQ = rf"""with x as (select item_id, answer, case item_id % 4 when 0 then case when item_id % 8 = 0 then 'Yes. ' else 'No. ' end when 2 then '- yes' || chr(10) || '- maybe' || chr(10) || '- ' else '' end || passage as t from eval_items where answer is not null),
  z as (select 'yesno' as type, case when regexp_matches(lower(answer), '^(yes|no)') then (case when item_id % 8 = 0 then 'yes' else 'no' end = case when regexp_matches(lower(answer), '^yes') then 'yes' else 'no' end)::int::double end as s from x where item_id % 4 = 0
    union all select 'factoid', contains(lower(t), lower(answer))::int::double from x where item_id % 4 = 1
    union all select 'list', case when lower(answer) in ('yes', 'maybe') then 2.0::double / 4 else 0 end from x where item_id % 4 = 2
    union all select 'summary', {_F1} from (select {word_set('t')} as a, {word_set('answer')} as b from x where item_id % 4 = 3))
  select type, round(coalesce(avg(s), 0), 6) as score, count(s) as n from z group by 1"""

ENTITY_PRF = """with p as (select distinct pmid, lower(x) as t, case when contains(x, '/') then 'DRUG' else 'DISEASE' end as type from (select pmid, unnest(mesh_terms) as x from pubmed_abstracts where pmid is not null)),
  g as (select pmid, lower(x) as t, 'DISEASE' as type, count(*) as times from (select pmid, unnest(coalesce(mesh_terms, []) || coalesce(keywords, [])) as x from pubmed_abstracts where pmid is not null) group by 1, 2, 3),
  c as (select coalesce(p.type, g.type) as type, coalesce(sum(case when p.t is not null then coalesce(times, 0) else 0 end), 0)::bigint as tp, count(*) filter (times is null) as fp, coalesce(sum(case when p.t is null then times else 0 end), 0)::bigint as fn
    from p full join g on p.pmid = g.pmid and p.t = g.t and p.type = g.type group by 1),
  a as (select * from c union all select 'all', sum(tp)::bigint, sum(fp)::bigint, sum(fn)::bigint from c where tp + fp > 0 union all select 'micro_all', sum(tp)::bigint, sum(fp)::bigint, sum(fn)::bigint from c),
  z as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end::double as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end::double as r from a)
  select type, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from z"""
