"""SQL of the core queries over sections, entities, relations and verification (DuckDB dialect)."""

from __future__ import annotations

from corpuslane.operators.generation import DISCLAIMER, REFUSAL
from corpuslane.operators.relations import ADR, DDI, GENE_DISEASE
from corpuslane.operators.sections import NOTE_TYPES, RADIOLOGY_HEADERS, SECTION_HEADERS, SECTIONED
from corpuslane.plans import sql
from corpuslane.plans.sql import q

# sections -----------------------------------------------------------------------------------------

_GOOD = "coalesce(iserror, '') <> '1' and text is not null and trim(text) <> ''"


def _marked(text: str, rx: str) -> str:
    """A text cut at the beginnings of a pattern's matches, each match closed by chr(2)."""
    return f"string_split(regexp_replace({text}, {q(rx)}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"


#: Rows (key, i, s, e) of a list ``p`` as cut by :func:`_marked`: the i-th match and its half-open span.
_SPANS = "select {key}, i, s, s + length(split_part(p[i + 1], chr(2), 1)) as e from (select *, list_sum(list_transform(p[1:i], lambda x: length(x)))::int - i + 1 as s from (select {key}, p, unnest(range(1, len(p)))::int as i from ({rows})))"


def _bounds(name: str, headers: dict[str, str], first_only: bool) -> str:
    parts = []
    for k, (section, p) in enumerate(headers.items()):
        rows = f"select row_id, {_marked('text', '(?i)(?:' + p + ')' + chr(92) + 's*:?' + chr(92) + 's*' + chr(92) + 'n')} as p from {name}"
        parts.append(f"select row_id, e, {k} as ord, {q(section)} as section_name, s from ({_SPANS.format(key='row_id', rows=rows)})" + (" where i = 1" if first_only else ""))
    return " union all ".join(parts)


def _sections(src: str, headers: dict[str, str], first_only: bool = False) -> str:
    """CTEs: b (bounds of table ``src``), sl (sections with their text, in order)."""
    return f"""b as ({_bounds(src, headers, first_only)}),
  sl as (select row_id, section_name, e as start_char, stop as end_char, e, ord, s, regexp_replace(regexp_replace(substring(text, e + 1, stop - e), '^[\\s\\x0B]+', ''), '[\\s\\x0B]+$', '') as t
    from (select b.*, text, coalesce(lead(e) over (partition by row_id order by e, ord, section_name, s), length(text))::int as stop from b join {src} using (row_id)))"""


_NOTES = f"n as (select row_id, text from clinical_notes where {_GOOD} and trim(category) in ({', '.join(q(c) for c in SECTIONED)}))"
_SEGMENTS = f"""{_NOTES}, {_sections('n', SECTION_HEADERS)},
  sg as (select row_id, (row_number() over (partition by row_id order by e, ord, section_name, s) - 1)::int as ord, section_name, start_char, end_char, t from sl where length(t) >= 30
    union all select row_id, 0, 'body', 0, length(text)::int, text from n where row_id not in (select row_id from b))"""
NOTE_SEGMENTS = f"with {_SEGMENTS} select row_id, ord, section_name, start_char, end_char, md5(t) as hash from sg"
NOTE_DOCUMENTS = f"""with {_SEGMENTS}, c as (select row_id, text, {"case trim(category) " + " ".join(f"when {q(k)} then {q(v)}" for k, v in NOTE_TYPES.items()) + " else lower(trim(category)) end"} as note_type from clinical_notes where {_GOOD})
  select 'note_' || row_id as doc_id, row_id, 'full_note' as section, note_type, md5(text) as hash from c where row_id not in (select row_id from sg)
  union all select 'note_' || row_id || '_' || ord || '_' || section_name, row_id, section_name, note_type, md5(t) from sg join c using (row_id) where length(t) >= 20"""
RADIOLOGY = f"""with n as (select row_id, text from clinical_notes where {_GOOD} and trim(category) = 'Radiology'), {_sections('n', {k: k for k in RADIOLOGY_HEADERS}, True)}
  select row_id, count(section_name)::int as n_sections, length(coalesce(any_value(t) filter (section_name = 'impression'), any_value(t) filter (section_name = 'findings'), ''))::int as impression_chars
  from n left join sl using (row_id) group by row_id"""

# verification -------------------------------------------------------------------------------------

_SCORED = rf"""{sql._EVIDENCE}, cl as {sql._claims('item_id', 'passage', 'eval_items')},
  sc as (select answer_id, claim_id, claim, passage_id, text, case when len(a) > 0 then len(list_intersect(a, b)) / len(a) else 0.0 end::double as share, fl from (
    select answer_id, claim_id, claim, passage_id, text, {sql.word_set('claim')} as a, {sql.word_set('text')} as b,
      regexp_matches({sql._ASCII.format(t='lower(claim)')}, {q(sql._NEG)}) <> regexp_matches({sql._ASCII.format(t='lower(text)')}, {q(sql._NEG)}) as fl from cl left join ev on ev.item_id = cl.answer_id)),
  sr as (select *, case when text is null then null when fl then 0.0 else share end as ent, case when text is null then null when fl then share else 0.0 end as con from sc),
  vf as (select answer_id, claim_id, coalesce(max(round(ent, 9)), 0.0) as e, coalesce(max(con), 0.0) as c,
    (list({{'p': passage_id, 't': text}} order by round(ent, 9) desc, passage_id) filter (text is not null))[1] as best from sr group by 1, 2),
  lb as (select *, case when e >= 0.7::double then 'entailment' when c > 0.5::double then 'contradiction' else 'neutral' end as label from vf)"""
CLAIM_LABELS = f"""with {_SCORED} select answer_id, claim_id, label, round(case when label = 'contradiction' then c else e end, 6) as score,
  case when label = 'entailment' then best.p end as passage_id from lb"""
CITATIONS = f"""with {_SCORED},
  cx as (select item_id as answer_id, row_number() over (partition by item_id order by passage_id)::int as n, text from ev),
  pr as (select distinct answer_id, left(best.t, 50) as head from lb where label = 'entailment' and best.t <> ''),
  ok as (select distinct cx.answer_id, n from cx join pr on pr.answer_id = cx.answer_id and contains(text, head)),
  ci as (select item_id as answer_id, unnest(regexp_extract_all(passage || ' [Doc 1] [Doc 2] [Doc 9]', '\\[Doc (\\d+)\\]', 1))::int as n from eval_items),
  g as (select ci.answer_id, count(*) as citations, count(ok.n) as supported from ci left join ok on ok.answer_id = ci.answer_id and ok.n = ci.n group by 1)
  select item_id as answer_id, coalesce(citations, 0) as citations, coalesce(supported, 0) as supported, round(coalesce(supported / citations, 1.0)::double, 6) as accuracy
  from eval_items left join g on g.answer_id = item_id"""
CONSISTENCY = f"""with {_SCORED}, a as (select answer_id, claim_id, avg(coalesce(ent >= 0.3::double, false)::int::double) as agree from sr group by 1, 2)
  select answer_id, count(*) as claims, count(*) filter (agree >= 0.67::double) as consistent, round((count(*) filter (agree >= 0.67::double) / count(*))::double, 6) as score from a group by 1"""

_FIRST = f"coalesce(({sql._SENTS.format(t='text')})[1], '') || ' [Doc ' || n || ']'"
ANSWERS = f"""with {sql._CONTEXT}, dn as (select query_id, row_number() over (partition by query_id order by rank) as n, coalesce(text, '') as text from cx where cum <= 1200),
  g as (select query_id, count(*)::int as n_citations, string_agg({_FIRST}, ' ' order by n) filter (n <= 3) as said, list_distinct(flatten(list({sql.word_set('text')}))) as words from dn group by 1),
  r as (select item_id as query_id, n_citations, said || chr(10) || chr(10) || 'Confidence level: ' || case when k >= m / 2 then 'high' when k > 0 then 'medium' else 'low' end as raw
    from (select *, len(list_intersect(w, words)) as k, len(w) as m from (select item_id, {sql.word_set('question')} as w from eval_items where item_id % 20 = 0) left join g on query_id = item_id)),
  c as (select *, lower(raw) as l from r)
  select query_id, md5(case when n_citations > 0 then raw || chr(10) || chr(10) || {q(DISCLAIMER)} else {q(REFUSAL)} end) as hash,
    case when n_citations is null then 0.0 when contains(l, 'confidence level: high') or contains(l, 'high confidence') then 0.85 when contains(l, 'confidence level: medium') or contains(l, 'moderate confidence') then 0.6
      when contains(l, 'confidence level: low') or contains(l, 'low confidence') then 0.35
      when contains(l, 'insufficient evidence') or contains(l, 'cannot answer') or contains(l, 'not enough information') or contains(l, 'context does not contain') then 0.1 else 0.7 end::double as confidence,
    coalesce(n_citations, 0)::int as n_citations from c"""

# relations ----------------------------------------------------------------------------------------


def _rule(k: int, rule: tuple) -> str:
    p, s, o, kind, conf, _ = rule
    rx = "(?i)" + p
    rows = f"select rec_id, abstract, {_marked('abstract', rx)} as p, regexp_extract_all(abstract, {q(rx)}, {s}) as su, regexp_extract_all(abstract, {q(rx)}, {o}) as ob from pubmed_abstracts where abstract is not null"
    spans = _SPANS.format(key="rec_id, abstract, su, ob", rows=rows)
    return f"select rec_id as doc_id, abstract as text, {k} as rule, s, e, trim(su[i]) as subject, trim(ob[i]) as object, {q(kind)} as kind, {conf}::double as confidence from ({spans})"


def _near(c: str, rx: str) -> str:
    return f"regexp_matches({sql._ASCII.format(t=c)}, {q(rx)})"


_INSIDE = "substring(text, s + 1, e - s)"
_ADR = f"""ar as ({" union all ".join(_rule(k, r) for k, r in enumerate(ADR))}),
  ad as (select doc_id, subject, object, kind, confidence * case when speculative then 0.8 else 1.0 end as confidence, negated, speculative, case when stop > 0 then trim(substring(text, b + 1, stop - b)) else {_INSIDE} end as evidence from (
    select *, {_near("substring(text, greatest(s - 30, 0) + 1, s - greatest(s - 30, 0))", r'(?i)\b(?:no|not|without|negative for|denies?)\b')} as negated,
      {_near(_INSIDE, r'(?i)\b(?:may|might|could|possibly|potentially|suspected)\b')} as speculative,
      s - length(string_split(substring(text, 1, s), '.')[-1]) as b, case when instr(substring(text, e + 1), '.') > 0 then e + instr(substring(text, e + 1), '.') else 0 end as stop from ar))"""
_KEPT = "from ad where confidence >= 0.6::double and not negated"
REL_ADR = f"with {_ADR} select doc_id, subject, object, kind, confidence, negated, speculative, evidence {_KEPT}"
REL_GRAPH = f"""with {_ADR}, al as (select 'drug_interaction' as relation, doc_id, subject, object, confidence from ({sql.ddi()})
  union all select 'adverse_reaction', doc_id, lower(subject), lower(object), confidence {_KEPT}
  union all select 'gene_disease', doc_id, lower(subject), lower(object), confidence from ({sql.gene_disease()}))
  select relation, subject, object, count(*) as n, count(distinct doc_id) as docs, max(confidence) as confidence from al group by 1, 2, 3"""
assert DDI and GENE_DISEASE

# entities -----------------------------------------------------------------------------------------

_TERM = "trim(replace(split_part(x, '/', 1), '*', ''))"
_ENTITIES = rf"""tm as (select distinct lower(t) as run, case when regexp_matches(lower(t), '(?:in|ine|ab|ib|ex|tin)$') then 'DRUG' when regexp_matches(lower(t), 'protein$') then 'PROTEIN' else 'DISEASE' end as type
    from (select {_TERM} as t from (select unnest(mesh_terms) as x from pubmed_abstracts)) where t is not null and t <> ''),
  mx as (select max(len(regexp_extract_all(run, '[^\s]+'))) as longest from tm),
  wd as ({_SPANS.format(key='chunk_id, text', rows="select chunk_id, text, " + _marked('text', r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*") + " as p from chunks where text is not null")}),
  sp as (select *, sum(case when substring(text, pe + 1, s - pe) = ' ' then 0 else 1 end) over (partition by chunk_id order by i) as block from (select *, lag(e) over (partition by chunk_id order by i) as pe from wd)),
  ru as (select a.chunk_id as doc_id, substring(a.text, a.s + 1, b.e - a.s) as text, a.s as start, b.e as "end" from sp a join mx on true join sp b on a.chunk_id = b.chunk_id and a.block = b.block and b.i >= a.i and b.i < a.i + longest),
  en as (select doc_id, type, text, start, "end", 1.0::double as confidence from ru join tm on lower(text) = run)"""
NER = f"with {_ENTITIES} select * from en"
NER_COUNTS = f"with {_ENTITIES} select type, count(*) as n from en group by 1"
NER_STRUCTURED = f"with {_ENTITIES} select doc_id, type, list(text order by start, text) as texts from (select doc_id, type, text, min(start) as start from en group by 1, 2, 3) group by 1, 2"
NER_OVERLAP = f"""with {_ENTITIES}, fo as (select doc_id, list_reduce(list([{{'s': start, 'e': "end", 'type': type, 'text': text}}] order by start, "end" desc, type, text),
    lambda a, x: case when len(list_filter(a, lambda k: k.s < x[1].e and x[1].s < k.e)) > 0 then a else a || x end) as kept from en group by 1)
  select doc_id, k.type as type, k.text as text, k.s as start, k.e as "end", 1.0::double as confidence from (select doc_id, unnest(kept) as k from fo)"""
ENTITY_PAIRS = f"""with {_ENTITIES}, se as (select chunk_id as doc_id, (unnest(range(len(p))))::int as pos, unnest(p) as sentence from (select chunk_id, {sql._SENTS.format(t='text')} as p from chunks where text is not null)),
  dr as (select se.doc_id, pos, sentence, text, instr(sentence, text) as at from se join (select distinct doc_id, text from en where type = 'DRUG') n on n.doc_id = se.doc_id and contains(sentence, text))
  select x.doc_id, x.pos, x.text as first, y.text as second, md5(replace(replace(x.sentence, x.text, '[DRUG1]'), y.text, '[DRUG2]')) as hash
  from dr x join dr y on x.doc_id = y.doc_id and x.pos = y.pos and x.at < y.at"""

# providers and the retrieval plan -----------------------------------------------------------------


def _provider(dim: int) -> str:
    return f"""(with hc as (select side, id, (h // 2) % {dim} as c, sum(case when h % 2 = 0 then 1 else -1 end)::double as v from ew join eh using (w) group by 1, 2, 3),
    hn as (select side, id, greatest(sqrt(sum(v * v)), 1e-8) as n from hc group by 1, 2),
    hd as (select qq.item_id as query_id, dd.item_id as doc_id, round(coalesce(x.s, 0) / (coalesce(nq.n, 1e-8) * coalesce(nd.n, 1e-8)), 9) as score
      from (select item_id from eval_items where item_id % 20 = 0 and question is not null) qq cross join (select item_id from eval_items where passage is not null) dd
      left join (select a.id as qid, b.id as did, sum(a.v * b.v) as s from hc a join hc b on a.c = b.c where a.side = 1 and b.side = 0 group by 1, 2) x on x.qid = qq.item_id and x.did = dd.item_id
      left join hn nq on nq.side = 1 and nq.id = qq.item_id left join hn nd on nd.side = 0 and nd.id = dd.item_id),
    hr as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from hd)
    select 'hashing-{dim}' as provider, round(avg(1 / rank), 6) as mrr, round(avg(score), 6) as avg_sim from hr where query_id = doc_id)"""


COMPARE = f"""with ew as (select 0 as side, item_id as id, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+')) as w from eval_items
    union all select 1, item_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) from eval_items where item_id % 20 = 0),
  eh as (select w, ('0x' || substr(md5(w), 1, 6))::int as h from (select distinct w from ew))
  select * from {_provider(16)} union all select * from {_provider(64)}"""


def _expanded() -> str:
    """(query_id, t) of the expanded questions."""
    return sql.expansion().replace(
        "select item_id, question || ' ' || case when item_id % 2 = 0 then 'after stroke or heart attack' else 'with diabetes on MRI' end as t from eval_items", "select item_id, question as t from eval_items where item_id % 20 = 0"
    )


_WIDE = sql._bm25("lang = 'en'").replace(
    f"select item_id as query_id, unnest({sql.tokens('question')}) as term from eval_items where item_id % 20 = 0", f"select item_id as query_id, unnest({sql.tokens('expanded')}) as term from ({_expanded()})"
)
RETRIEVE = f"""with {_WIDE}, {sql._HASHED.strip().split("hn as (")[0].rstrip().rstrip(",")},
  hd as (select qq.item_id as query_id, dd.doc_id, coalesce(x.s, 0) as score
    from (select item_id from eval_items where item_id % 20 = 0) qq cross join (select doc_id from documents where text is not null and lang = 'en') dd
    left join (select a.id as qid, b.id as did, sum(a.v * b.v) as s from hc a join hc b on a.c = b.c where a.side = 1 and b.side = 0 group by 1, 2) x on x.qid = qq.item_id and x.did = dd.doc_id),
  hr as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from hd),
  fu as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.doc_id, b.doc_id) as doc_id, a.rank as dr, b.rank as sr,
    coalesce(0.7::double / (60 + a.rank), 0) + coalesce(0.3::double / (60 + b.rank), 0) as score
    from (select * from hr where rank <= 150) a full join (select * from bm where rank <= 150) b on a.query_id = b.query_id and a.doc_id = b.doc_id),
  rr as (select *, row_number() over (partition by query_id order by round(score, 12) desc, dr nulls last, sr nulls last, doc_id)::int as rank from fu),
  j as (select query_id, doc_id, rank, {sql.word_set('question')} as a, {sql.word_set('text')} as b from rr join documents using (doc_id) join eval_items on item_id = query_id where rank <= 50),
  z as (select query_id, doc_id, {sql._F1} as s, rank from j), y as (select query_id, doc_id, s, row_number() over (partition by query_id order by round(s, 9) desc, rank)::int as rank from z)
  select query_id, doc_id, round(s, 6) as rerank_score, rank, 'hybrid_rrf+reranked' as method from y where rank <= 10"""

# chunks -------------------------------------------------------------------------------------------


def _chunked(rows: str, size: int, overlap: int, least: int) -> str:
    """:func:`_folded` over the sentences of ``rows`` (key, text)."""
    return f"src as materialized ({rows}), " + _folded(f"select key, text, {sql._biomedical('text')} as p from src where text is not null", size, overlap, least)


def _folded(lists: str, size: int, overlap: int, least: int) -> str:
    """CTEs up to ck (key, text, k, first, t, rest): greedy chunks of the sentence lists ``p`` of rows (key, text, p).

    The open chunk is always a run of sentences [a, i); a row of ``st`` is the state before sentence i,
    ``pa`` and ``pi`` being the run that its step closed.
    """
    return rf"""ss as materialized (select key, text, p, list_transform(p, lambda x: floor(len(regexp_extract_all(x, '[^\s\x0B]+')) * 1.3::double)::int) as t from ({lists})),
  st as (select key, 1 as i, 1 as a, 0 as n, null::int as pa, null::int as pi from ss where len(p) > 0
    union all select key, i + 1, case when full_ then b else a end, case when full_ then coalesce(list_sum(t[b:i - 1]), 0)::int else n end + t[i], case when full_ then a end, case when full_ then i end from (
      select *, coalesce(list_min(list_filter(range(a, i), lambda j: list_sum(t[j:i - 1]) <= {overlap})), i)::int as b from (
        select st.key, i, a, n, t, (n + t[i] > {size} and i > a) as full_ from st join ss using (key) where i <= len(t)))),
  cu as (select key, pa as a, pi as i, false as rest from st where pa is not null union all select key, a, i, true from st join ss using (key) where i = len(t) + 1),
  ct as (select cu.*, text, p[a] as first, array_to_string(p[a:i - 1], ' ') as t from cu join ss using (key)),
  ck as (select *, (row_number() over (partition by key order by i, rest) - 1)::int as k, floor(len(regexp_extract_all(t, '[^\s\x0B]+')) * 1.3::double)::int as tokens
    from ct where not rest or floor(len(regexp_extract_all(t, '[^\s\x0B]+')) * 1.3::double) >= {least})"""


_AT = "greatest(case when instr(text, first) = 0 then -1 when rest then length(text) - length(string_split(text, first)[-1]) - length(first) else instr(text, first) - 1 end, 0)"
CHUNKS_SENTENCE = f"""with recursive {_chunked('select doc_id as key, text from documents', 128, 24, 10)}
  select key || '_chunk_' || k as chunk_id, key as doc_id, k as chunk_index, tokens as token_count, ({_AT})::int as char_start, ({_AT} + length(t))::int as char_end, md5(t) as hash from ck"""
CHUNKS_SECTION = f"""with recursive {_chunked("select {'d': note_row_id, 'o': section_id, 's': coalesce(section_name, '')} as key, text from note_sections", 64, 16, 10)}
  select key.d::varchar as doc_id, key.o::int as ord, key.s as section_name, (row_number() over (partition by key.d order by key.o, k) - 1)::int as chunk_index, tokens as token_count, md5(t) as hash from ck"""


_GROUPS = "select {'d': doc_id, 'g': g} as key, '' as text, list(s order by i) as p from gr group by doc_id, g"
CHUNKS_SEMANTIC = f"""with recursive dl as materialized (select doc_id, {sql._biomedical('text')} as p from documents where text is not null),
  sn as materialized (select doc_id, len(p) as n, unnest(range(1, len(p) + 1)) as i, unnest(p) as s from dl),
  wv as (select doc_id, i, ('0x' || substr(md5(w), 1, 6))::int as h from (select doc_id, i, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) as w from sn where n >= 3)),
  co as materialized (select doc_id, i, (h // 2) % 16 as c, sum(case when h % 2 = 0 then 1 else -1 end)::double as v from wv group by 1, 2, 3),
  no as (select doc_id, i, greatest(sqrt(sum(v * v)), 1e-8) as m from co group by 1, 2),
  sm as materialized (select sn.doc_id, sn.i, round(coalesce(x.d / (a.m * b.m), 0.0), 9) as sim from sn left join (select k.doc_id, k.i, sum(k.v * l.v) as d from co k join co l on k.doc_id = l.doc_id and k.c = l.c and l.i = k.i + 1 group by 1, 2) x on x.doc_id = sn.doc_id and x.i = sn.i
    left join no a on a.doc_id = sn.doc_id and a.i = sn.i left join no b on b.doc_id = sn.doc_id and b.i = sn.i + 1 where n >= 3 and sn.i < n),
  ct0 as (select doc_id, round(quantile_cont(sim, 0.15), 9) as cut from sm group by 1),
  gr as materialized (select sn.doc_id, sn.i, s, coalesce(sum(case when sim < cut then 1 else 0 end) over (partition by sn.doc_id order by sn.i rows between unbounded preceding and 1 preceding), 0) as g
    from sn left join sm on sm.doc_id = sn.doc_id and sm.i = sn.i left join ct0 on ct0.doc_id = sn.doc_id),
  {_folded(_GROUPS, 128, 24, 10)}
  select key.d as doc_id, (row_number() over (partition by key.d order by key.g, k) - 1)::int as chunk_index, tokens as token_count, md5(t) as hash from ck"""

# training pairs, further metrics ------------------------------------------------------------------

CONTRASTIVE = f"""with ab as (select name, passage_id as doc_id, text from (select 'pmid_' || pmid as name, arg_max(abstract, rec_id) filter (abstract is not null) as text, max(rec_id) as passage_id from pubmed_abstracts where pmid is not null group by pmid) where text is not null and text <> ''),
  tr as (select distinct item_id, doc_id from (select item_id, unnest(relevant_doc_ids) as name from eval_items where item_id % 20 = 0) join ab using (name)),
  hw as (select 0 as side, doc_id as id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from ab union all select 1, item_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) from eval_items where item_id % 20 = 0),
  hv as (select w, ('0x' || substr(md5(w), 1, 6))::int as h from (select distinct w from hw)),
  hc as (select side, id, (h // 2) % 16 as c, sum(case when h % 2 = 0 then 1 else -1 end)::double as v from hw join hv using (w) group by 1, 2, 3),
  hd as (select item_id, ab.doc_id, coalesce(s, 0) as score from (select item_id from eval_items where item_id % 20 = 0) cross join ab
    left join (select a.id as qid, b.id as did, sum(a.v * b.v) as s from hc a join hc b on a.c = b.c where a.side = 1 and b.side = 0 group by 1, 2) on qid = item_id and did = ab.doc_id),
  hr as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from hd),
  ng as (select item_id, arg_min(doc_id, rank) as doc_id from hr where rank <= 30 and not exists (select 1 from tr where tr.item_id = hr.item_id and tr.doc_id = hr.doc_id) group by 1)
  select md5(question) as query, md5(p.text) as positive, md5(n.text) as negative from tr join eval_items using (item_id) join ab p on p.doc_id = tr.doc_id
    left join ng on ng.item_id = tr.item_id left join ab n on n.doc_id = ng.doc_id where question <> ''"""

ROUGE_PLAIN = r"""with w as (select rec_id, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') as a, regexp_extract_all(lower(abstract), '[\p{L}\p{N}]+') as b from pubmed_abstracts where title is not null and abstract is not null),
  g as (select rec_id, 1 as k, 0 as side, unnest(a) as g from w union all select rec_id, 1, 1, unnest(b) from w
    union all select rec_id, 2, 0, unnest(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) from w union all select rec_id, 2, 1, unnest(list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1])) from w),
  c as (select rec_id, k, g, count(*) filter (side = 0) as x, count(*) filter (side = 1) as y from g group by 1, 2, 3),
  m as (select rec_id, k, 2.0::double * sum(least(x, y)) / sum(x + y) as f from c group by 1, 2)
  select rec_id, round(coalesce(any_value(f) filter (k = 1), 0.0), 6) as rouge1, round(coalesce(any_value(f) filter (k = 2), 0.0), 6) as rouge2 from w left join m using (rec_id) group by 1"""

EMBEDDING_SCORE = r"""with w as (select rec_id, regexp_extract_all(lower(regexp_replace(title, '[^\x00-\x7F]', ' ', 'g')), '[a-z0-9]+') as a, regexp_extract_all(lower(regexp_replace(abstract, '[^\x00-\x7F]', ' ', 'g')), '[a-z0-9]+') as b
    from pubmed_abstracts where title is not null and abstract is not null),
  t as (select rec_id, 0 as side, unnest(a) as w from w union all select rec_id, 1, unnest(b) from w),
  h as (select rec_id, side, ('0x' || substr(md5(w), 1, 6))::int % 32 as h from t),
  s as (select rec_id, side, h, count(*) as n from h group by 1, 2, 3),
  p as (select x.rec_id, x.side, (sum(case when y.h is not null then x.n else 0 end) / sum(x.n))::double as share from s x left join s y on x.rec_id = y.rec_id and x.side <> y.side and x.h = y.h group by 1, 2),
  r as (select rec_id, coalesce(any_value(share) filter (side = 0), 0.0) as p, coalesce(any_value(share) filter (side = 1), 0.0) as q, len(a) > 0 and len(b) > 0 as ok from w left join p using (rec_id) group by rec_id, a, b)
  select rec_id, round(case when ok then p else 0.0 end, 6) as precision, round(case when ok then q else 0.0 end, 6) as recall, round(case when ok and p + q > 0 then 2 * p * q / (p + q) else 0.0 end, 6) as f1 from r"""

CLAIM_REPLIES = f"""with h as {sql._claims('item_id', 'passage', 'eval_items')}
  select item_id as answer_id, unnest([0, 1])::int as claim_id, unnest([passage, 'second claim']) as claim from eval_items where item_id % 2 = 0 and trim(passage) <> ''
  union all select item_id, 0, 'second claim' from eval_items where item_id % 2 = 0 and trim(passage) = ''
  union all select answer_id, claim_id, claim from h where answer_id % 2 = 1"""

LINKED = f"""with {_ENTITIES}, ky as (select name, count(distinct pmid) as score from (select pmid, unnest(keywords) as name from pubmed_abstracts where pmid is not null) where name is not null group by 1),
  cc as (select n, c from (select lower(trim(name)) as n, {{'id': md5(name), 'name': upper(name)}} as c, row_number() over (partition by lower(trim(name)) order by score desc, md5(name) desc) as k from ky) where k = 1)
  select doc_id, start, "end", type, c.id as concept_id, c.name as concept_name from en left join cc on n = lower(trim(text))"""
