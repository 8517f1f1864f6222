"""DuckDB SQL for the queries that plain SQL can express over whole tables."""

from __future__ import annotations

FOLD = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"

_P1 = f"""
with entries as (
  select distinct 'resume' basket, resume_id rid, {FOLD.format('canonical_skill')} item from skill_matches where resume_id is not null
  union
  select distinct 'profile', rid, {FOLD.format('item')} from (select row_number() over () rid, unnest(required_skills) item from profiles_learned)
), live as (select * from entries where item <> ''),
n as (select basket, count(distinct rid) n from live group by 1),
f as (select basket, item, count(*) c from live group by 1, 2),
ab as (select x.basket, x.item item_a, y.item item_b, count(*) ab from live x join live y on x.basket = y.basket and x.rid = y.rid and x.item < y.item group by 1, 2, 3)
select ab.basket, item_a, item_b, ab, fa.c a, fb.c b, n.n, ab * n.n / (fa.c * fb.c)::double lift
from ab join n using (basket) join f fa on fa.basket = ab.basket and fa.item = item_a join f fb on fb.basket = ab.basket and fb.item = item_b
where ab >= case ab.basket when 'resume' then 5 else 3 end and ab * n.n >= 3 * fa.c * fb.c"""

_P2 = f"""
with rows as (
  select 'canonical_skill' field_name, resume_id, canonical_skill term from skill_matches
  union all select 'skills_raw', resume_id, unnest(skills_raw) from extracted
), live as (select field_name, resume_id, {FOLD.format('term')} term from rows where resume_id is not null),
n as (select 'canonical_skill' field_name, count(distinct resume_id) n from skill_matches union all select 'skills_raw', count(distinct resume_id) from extracted)
select field_name, term, count(*) occurrences, count(distinct resume_id) records,
  case when count(distinct resume_id) <= 2 then 'rare' when count(distinct resume_id) > 0.1 * any_value(n) then 'common' else 'useful' end verdict
from live join n using (field_name) where term <> '' group by 1, 2"""

_P5 = """
with pairs as (
  select resume_id, upper(trim(k)) k0, try_cast(json_extract(scores, '$."' || k || '"') as double) s, json_type(json_extract(scores, '$."' || k || '"')) t
  from (select resume_id, scores, unnest(json_keys(scores)) k from predictions where json_valid(scores) and json_type(scores) = 'OBJECT')
), items as (
  select 'resume' kind, resume_id::varchar key, replace(k0, '_', '-') item, null::bigint num, max(s) s from pairs where s is not null and t in ('DOUBLE', 'BIGINT', 'UBIGINT') group by all
  union all
  select 'requisition', req_id::varchar, resume_id::varchar, resume_id, max(fit_score) from predictions where fit_score is not null and not isnan(fit_score) and req_id is not null and resume_id is not null group by all
), ranked as (select kind, key, item, row_number() over (partition by kind, key order by s desc, num, item) r from items)
select kind grouping_kind, key group_key, r::int rank_no, item item_key from ranked where key is not null and r <= case kind when 'resume' then 3 else 5 end"""


def _bigrams(columns: str) -> str:
    return f"""
words as (select resume_id, {columns}, regexp_extract_all(lower(resume_text), '[a-z0-9]+') w from resumes where resume_text is not null),
sets as (select *, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) s from words where len(w) >= 20),
flat as (select resume_id, len(s) n, unnest(s) g from sets),
"""


_P4 = f"""with {_bigrams('label')}
meet as (select x.resume_id a, y.resume_id b, any_value(x.n) na, any_value(y.n) nb, count(*) c from flat x join flat y on x.g = y.g and x.resume_id < y.resume_id group by 1, 2)
select a resume_id_a, b resume_id_b from meet where 5 * c >= 3 * (na + nb - c)"""

_P4_ROWS = f"""with {_bigrams('label')}
classes as (select resume_id, min(resume_id) over (partition by list_sort(s)) class_id, count(*) over (partition by list_sort(s)) copies from sets),
near as (select a, b from (select x.resume_id a, y.resume_id b, any_value(x.n) na, any_value(y.n) nb, count(*) c from flat x join flat y on x.g = y.g and x.resume_id <> y.resume_id group by 1, 2) where 5 * c >= 3 * (na + nb - c)),
linked as (select x.class_id, count(distinct y.class_id) links from near join classes x on x.resume_id = a join classes y on y.resume_id = b where x.class_id <> y.class_id group by 1)
select resume_id, class_id, copies, coalesce(links, 0) links from classes left join linked using (class_id)"""

_P6 = f"""with {_bigrams(FOLD.format('split') + ' sp, source')}
sided as (select f.*, sp, source from flat f join sets using (resume_id) where sp in ('train', 'dev', 'test')),
meet as (select x.resume_id e, y.resume_id t, any_value(x.sp) split, any_value(x.source) source, any_value(x.n) na, any_value(y.n) nb, count(*) c
  from sided x join sided y on x.g = y.g and x.sp <> 'train' and y.sp = 'train' group by 1, 2)
select split, source, least(e, t) resume_id_a, greatest(e, t) resume_id_b, e from meet where 4 * c >= 3 * (na + nb - c)"""

ORACLE: dict[str, str] = {
    "p1_lift": _P1,
    "p1_found": f"select basket, item_a, item_b from ({_P1})",
    "p2_counts": _P2,
    "p2_found": f"select field_name, term, verdict from ({_P2}) where verdict <> 'useful'",
    "p4_found": _P4,
    "p4_classes": _P4_ROWS,
    "p5_found": _P5,
    "p6_found": f"select split, source, resume_id_a, resume_id_b from ({_P6})",
    # what a right packing must come to: every text that isn't empty is placed, nothing breaks a capacity, little room is lost
    "p9_report": "select count(*) documents, 0::bigint over_capacity, 0::bigint split_needlessly, true well_filled from documents where text <> '' and doc_id is not null",
    "p6_report": f"select split, source, count(distinct e) eval_records, count(*) pairs from ({_P6}) group by 1, 2",
}
