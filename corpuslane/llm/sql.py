"""Equivalent SQL of those queries that SQL can express, on the same whole tables (DuckDB dialect)."""

_ITEMS = """
  {name} as (select distinct pmid as rec, item from (
    select pmid, trim(regexp_replace(lower({cut}), '\\s+', ' ', 'g')) as item
    from ({rows}) where pmid is not null) where item <> '')"""
_MESH = _ITEMS.format(
    name="mesh_terms", cut="replace(split_part(x, '/', 1), '*', '')",
    rows="select pmid, unnest(mesh_terms) as x from pubmed_abstracts",
)
_KEY = _ITEMS.format(
    name="keywords", cut="x",
    rows="select pmid, unnest(string_split(k, ';')) as x from (select pmid, unnest(keywords) as k from pubmed_abstracts)",
)


def _pairs(field: str) -> str:
    return f"""
    select '{field}' as field, p.item_a, p.item_b, n_ab, a.n as n_a, b.n as n_b, (select count(distinct rec) from {field}) as n
    from (select x.item as item_a, y.item as item_b, count(*) as n_ab from {field} x join {field} y on x.rec = y.rec and x.item < y.item group by 1, 2) p
    join (select item, count(*) as n from {field} group by 1) a on a.item = p.item_a
    join (select item, count(*) as n from {field} group by 1) b on b.item = p.item_b"""


_ALL_PAIRS = f"with {_MESH},{_KEY}, pairs as ({_pairs('mesh_terms')} union all {_pairs('keywords')})"


def _g(k: str, row: str, col: str) -> str:
    return f"(case when {k} > 0 then ({k})::double * ln(({k})::double * n / (({row})::double * ({col}))) else 0.0 end)"


_G2 = " + ".join(
    (_g("n_ab", "n_a", "n_b"), _g("n_a - n_ab", "n_a", "n - n_b"), _g("n_b - n_ab", "n - n_a", "n_b"), _g("n - n_a - n_b + n_ab", "n - n_a", "n - n_b"))
)


def _oversized(tbl: str, key: str, text: str) -> str:
    return f"""select '{tbl}' as tbl, cast({key} as varchar) as item_id from {tbl}
    where floor(1.3::double * len(regexp_extract_all({text}, '[^ \\t\\r\\n]+'))) > 512"""


def _near(tbl: str, key: str, text: str) -> str:
    return f"""
    (with w as (select {key} as id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') as w from {tbl} where {text} is not null),
    s as (select id, list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from w where len(w) >= 40),
    e as (select id, len(s) as n, unnest(s) as g from s),
    p as (select a.id as id_a, b.id as id_b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as shared
          from e a join e b on a.g = b.g and a.id < b.id group by 1, 2)
    select '{tbl}' as tbl, id_a, id_b from p where 2 * shared >= na + nb - shared)"""


def _classes(tbl: str, key: str, text: str) -> str:
    return f"""
    (with recursive pr as materialized (select id_a as x, id_b as y from ({_near(tbl, key, text)}) union all select id_b, id_a from ({_near(tbl, key, text)})),
    w as (select {key} as id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') as w from {tbl} where {text} is not null),
    r as (select x, y from pr union select r.x, pr.y from r join pr on r.y = pr.x)
    select '{tbl}' as tbl, id, least(id, coalesce(m, id)) as class_id, min(id) over (partition by w) as copy_of from w left join (select x, min(y) as m from r group by 1) on x = id where len(w) >= 40)"""


_OVERSIZED = " union all ".join(
    _oversized(*x) for x in (("clinical_notes", "row_id", "text"), ("pubmed_abstracts", "rec_id", "abstract"), ("chunks", "chunk_id", "text"))
)

SQL = {
    "p1_found": _OVERSIZED,
    "p1_whole": f"select tbl, item_id, true as whole, true as within from ({_OVERSIZED})",
    "p3_groups": _classes("clinical_notes", "row_id", "text") + " union all " + _classes("pubmed_abstracts", "rec_id", "abstract"),
    "p5_whole": "select 'clinical_notes' as tbl, row_id as item_id, true as whole from clinical_notes where text is not null union all select 'note_sections', section_id, true from note_sections where text is not null",
    "p7_together": "select 0::bigint as torn_subjects, 0::bigint as torn_stays, count(*) as rows, true as shares_met from clinical_notes",
    "p9_caps": "select source, true as capped from mixture_targets",
    "p2_found": f"{_ALL_PAIRS} select field, item_a, item_b from pairs where n_ab >= 5 and n_ab * n >= 4 * n_a * n_b",
    "p2_pairs": f"""{_ALL_PAIRS} select field, item_a, item_b, n_ab, round(n_ab * n / (n_a::double * n_b), 6) as lift,
      round(case when n_ab * n < n_a * n_b then -1 else 1 end * 2 * ({_G2}), 4) + 0.0::double as llr from pairs""",
    "p3_found": _near("clinical_notes", "row_id", "text") + " union all " + _near("pubmed_abstracts", "rec_id", "abstract"),
    "p6_found": f"""with {_MESH},
      t as (select chunk_id as id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as term from chunks where text is not null and chunk_id is not null),
      c as (select id, term, count(*) as n from t group by 1, 2),
      f as (select term, count(*) as d from c group by 1),
      m as (select item, count(*) as d from mesh_terms group by 1),
      k as (select count(*) as n_rec from chunks where chunk_id is not null),
      km as (select count(distinct rec) as n_rec from mesh_terms)
      select 'chunks' as tbl, id as item_id, term from c join f using (term), k
      where d >= 2 and (1 + ln(n::double)) * ln(n_rec::double / d) >= 1.9 * ln(n_rec::double)
      union all
      select 'pubmed_abstracts', rec, item from mesh_terms join m using (item), km where d >= 2 and d::double * d * d * d <= n_rec""",
    "p6_scores": f"""with {_MESH},
      mf as (select pmid as id, item as term, min({{'r': rec_id, 'p': p}}) as place from (select pmid, rec_id, p, trim(regexp_replace(lower(replace(split_part(x, '/', 1), '*', '')), '\\s+', ' ', 'g')) as item
        from (select pmid, rec_id, unnest(mesh_terms) as x, unnest(range(len(mesh_terms))) as p from pubmed_abstracts where pmid is not null)) where item <> '' group by 1, 2),
      tp as (select 'chunks' as tbl, chunk_id as id, unnest(w) as term, unnest(range(len(w))) as pos from (select chunk_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') as w from chunks where text is not null and chunk_id is not null)
        union all select 'pubmed_abstracts', id, term, row_number() over (partition by id order by place, term) from mf),
      dg as (select a.tbl, a.id, a.term, count(distinct b.term) as degree from tp a join tp b on a.tbl = b.tbl and a.id = b.id and b.pos between a.pos - 3 and a.pos + 3 and a.term <> b.term group by 1, 2, 3),
      c as (select tbl, id, term, count(*) as n from tp group by 1, 2, 3),
      f as (select tbl, term, count(*) as d from c group by 1, 2),
      k as (select 'chunks' as tbl, count(*) as total from chunks where chunk_id is not null union all select 'pubmed_abstracts', count(distinct rec) from mesh_terms)
      select tbl, id, term, n::int as n, coalesce(degree, 0)::int as degree, d, round(coalesce(degree, 0) * ln(total::double / d), 6) as score
      from c join f using (tbl, term) join k using (tbl) left join dg using (tbl, id, term)""",
    "p7_found": """with recursive e as (select distinct subject_id as s, hadm_id as h from clinical_notes
        where subject_id is not null and subject_id <> 0 and hadm_id is not null and hadm_id <> 0),
      l as (select distinct a.s as x, b.s as y from e a join e b on a.h = b.h and a.s <> b.s),
      r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x)
      select distinct x as subject_a, y as subject_b from r where x < y""",
    "p8_found": """with d as (select doc_id as id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') as w from documents),
      i as (select item_id as id, regexp_extract_all(strip_accents(lower(passage)), '[\\p{L}\\p{N}]+') as w from eval_items),
      dg as (select id, unnest(list_transform(generate_series(1, len(w) - 11), lambda k: hash(array_to_string(w[k:k + 11], ' ')))) as g from d where len(w) >= 12),
      ig as (select id, unnest(list_transform(generate_series(1, len(w) - 11), lambda k: hash(array_to_string(w[k:k + 11], ' ')))) as g from i where len(w) >= 12)
      select distinct dg.id as doc_id, ig.id as item_id from dg join ig using (g)""",
}
