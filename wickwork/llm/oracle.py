"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations


def parity_join_sql(words: int = 4, numerator: int = 85, denominator: int = 100) -> str:
    """Shingle sets joined on shingles, links by exact counts, components by reachability."""
    return f"""
with recursive d as (
  select row_number() over () rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w
  from documents
), s as materialized (
  select distinct rid, unnest(case when len(w) = 0 then []::varchar[] when len(w) < {words} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) end) sh
  from d
), n as materialized (select rid, count(*) n from s group by rid
), c as materialized (select x.rid a, y.rid b, count(*) i from s x join s y on x.sh = y.sh and x.rid <> y.rid group by all
), l as materialized (
  select a, b from c join n na on na.rid = a join n nb on nb.rid = b where {denominator} * i >= {numerator} * (na.n + nb.n - i)
), r as (select rid a, rid b from d union select r.a, l.b from r join l on r.b = l.a
), m as (select r.a, min(d.doc_id) component_id from r join d on d.rid = r.b group by r.a)
select d.doc_id, coalesce(n.n, 0) n_shingles, m.component_id from d left join n on n.rid = d.rid join m on m.a = d.rid
"""


def vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Lloyd rounds as a chain of assignments and floored means; for lengths that are multiples of ``parts``."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} as materialized (
  select rid, part, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * {entries} + c.e) m
  from p join c{k} c using (part) group by rid, part)"""
        )
        if k < rounds:
            steps.append(
                f"""s{k} as (select part, m % {entries} e, pos, sum(x)::bigint s, count(*) n
  from (select part, m, unnest(v) x, unnest(range(len(v))) pos from a{k} join p using (rid, part)) group by all
), c{k + 1} as materialized (select c.part, c.e, coalesce(f.v, c.v) v from c{k} c left join
  (select part, e, list((s - ((s % n) + n) % n) // n order by pos) v from s{k} group by part, e) f on f.part = c.part and f.e = c.e)"""
            )
    chain = ", ".join(steps)
    return f"""
with k as materialized (
  select row_number() over (order by vec_id nulls last, embedding) rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) x
  from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as materialized (
  select rid, part, x[part * (len(x) // {parts}) + 1:(part + 1) * (len(x) // {parts})] v from k, (select unnest(range({parts})) part)
), c0 as materialized (select part, rid - 1 e, v from p where rid <= {entries}
), {chain}
, o as (select rid, string_agg(printf('%02x', (m % {entries})::int), '' order by part) code, sum(m // {entries})::bigint error from a{rounds} group by rid
), h as (select sha256(string_agg(x::varchar, ',' order by part, e, pos)) h from (select part, e, unnest(v) x, unnest(range(len(v))) pos from c{rounds}))
select k.vec_id, o.code, o.error, (sum(o.error) over (partition by k.label))::bigint label_error, h.h codebooks_sha256 from k join o using (rid), h
"""
