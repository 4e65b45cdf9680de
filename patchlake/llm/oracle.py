"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from patchlake.llm import centroids, hard_negatives, line_dedup, mixing

_WORDS = "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint"

_EXACT_DEDUP = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
from n window w as (partition by t)
"""

_MIXING = f"""
with d as (select doc_id, source, {_WORDS} as size, md5(coalesce(doc_id::varchar, '')) as h from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (
  select *, ((row_number() over (order by source nulls last) - 1) % {mixing.MAX_REPEATS} + 1)::bigint as weight,
    source_size * {mixing.MAX_REPEATS} as lim, (sum(source_size) over ())::bigint as total
  from s0),
s2 as (
  select *, (sum(weight) over ())::bigint as aw,
    coalesce(sum(lim) over o, 0)::bigint as used, coalesce(sum(weight) over o, 0)::bigint as uw
  from s1 window o as (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding)),
s3 as (select *, lim * (aw - uw) <= (total - used) * weight as is_full from s2),
s4 as (
  select *, (sum(case when is_full then lim else 0 end) over ())::bigint as fs, (sum(case when is_full then weight else 0 end) over ())::bigint as fw
  from s3),
s5 as (
  select source, source_size, case when is_full then lim::double else (total - fs) * weight::double / nullif(aw - fw, 0) end as target,
    least(source_size, greatest({mixing.LEAST_BLOCKS}, ceil(source_size / {mixing.BLOCK_WORDS})))::bigint as nb
  from s4),
s6 as (select *, coalesce(round(target * nb / nullif(source_size, 0)), 0)::bigint as ns from s5),
lanes as (
  select source, nb, (sum(ns) over (order by source nulls last))::bigint as high, ns, (sum(ns) over ())::bigint as alls from s6 where ns > 0),
edges as (
  select source, nb, ((high - ns)::hugeint * {mixing._POINTS}) // alls as lo, (high::hugeint * {mixing._POINTS}) // alls as hi from lanes),
slots as (
  select i as slot, ((i % {mixing._POINTS}) * {mixing.GOLDEN}) % {mixing._POINTS} as point
  from (select unnest(range(coalesce((select max(alls) from lanes), 0))) as i)),
ranked as (
  select source, nb, row_number() over (partition by source order by slot) - 1 as r
  from slots join edges on point >= lo and point < hi),
uses as (select source, r % nb as block, count(*) as uses from ranked where r < {mixing.MAX_REPEATS} * nb group by all),
placed as (
  select d.*, s6.source_size, s6.target, s6.nb,
    (sum(size) over (partition by d.source order by h, doc_id, size rows unbounded preceding))::bigint as e
  from d join s6 on d.source is not distinct from s6.source),
grid as (
  select source, nb, source_size, unnest(range(nb)) as block from s6 where source_size > 0),
cells as (
  select source, block,
    block * (source_size // nb) + least(block, source_size % nb) as b0,
    (block + 1) * (source_size // nb) + least(block + 1, source_size % nb) as b1
  from grid),
used as (
  select c.*, coalesce(u.uses, 0) as uses from cells c left join uses u on c.block = u.block and c.source is not distinct from u.source),
spent as (
  select source, b0, b1, uses, (sum(uses * (b1 - b0)) over (partition by source order by b0 rows unbounded preceding) - uses * (b1 - b0))::bigint as before
  from used),
marks as (
  select doc_id, source, size, source_size, target, e as at, 1 as sign from placed where size > 0
  union all select doc_id, source, size, source_size, target, e - size, -1 from placed where size > 0),
valued as (
  select m.doc_id, m.source, sum(sign * (s.before + s.uses * (m.at - s.b0)))::bigint as taken
  from (select *, coalesce(source, '~null~') as k from marks) m
  asof join (select *, coalesce(source, '~null~') as k from spent) s on m.k = s.k and m.at >= s.b0
  group by all)
select p.doc_id, p.size, p.source_size, p.target, coalesce(v.taken, 0)::bigint as taken, p.source
from placed p left join valued v on p.doc_id = v.doc_id and p.source is not distinct from v.source
"""

_LINE_DEDUP = f"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents),
lines as (select doc_id, unnest(s) as line, unnest(range(len(s))) as i from split),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
often as (
  select key, max(doc_id) as keeper, count(distinct doc_id) as documents from keyed
  where length(key) >= {line_dedup.MIN_CODE_POINTS} group by key having count(distinct doc_id) >= {line_dedup.MIN_DOCUMENTS}),
judged as (select k.*, o.documents, o.key is not null and k.doc_id <> o.keeper as gone from keyed k left join often o on k.key = o.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256,
  coalesce(max(documents) filter (where gone), 0) as n_most
from judged group by doc_id
"""

_HARD_NEGATIVES = f"""
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from rows a join rows b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
positives as (
  select *, row_number() over (partition by anchor_id order by score desc, id) as place from pairs where same
  qualify place <= {hard_negatives.POSITIVES})
select p.anchor_id, p.id as positive_id, (row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id))::int as rank,
  n.id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join pairs n on p.anchor_id = n.anchor_id and not n.same
where {hard_negatives.LOWEST} * p.score <= 100 * n.score and 100 * n.score <= {hard_negatives.HIGHEST} * p.score
qualify rank <= {hard_negatives.NEGATIVES}
"""


def _clustering() -> str:
    """The rounds one after the other; a distance and a number share one integer, so that the minimum settles ties."""
    k = centroids.CENTROIDS
    steps = [
        f"""
with kept as (
  select vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::double)) as q from embeddings
  where len(embedding) = {centroids.COMPONENTS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (
  select row_number() over (order by h) - 1 as cluster, q as c
  from (select q, sha256('{centroids.SEED}:' || vec_id::varchar) as h from kept order by h limit {k}))"""
    ]
    assign = """
a{i} as materialized (
  select vec_id, q, min((list_dot_product(q, q) - 2 * list_dot_product(q, c) + list_dot_product(c, c))::bigint * {k} + cluster) as best
  from kept, c{i} group by vec_id, q)"""
    move = """
s{i} as (select best % {k} as cluster, unnest(q)::hugeint as x, unnest(range({n})) as d from a{i}),
m{i} as (
  select cluster, list(mean order by d) as c from (
    select cluster, d, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::double as mean from s{i} group by all)
  group by cluster),
c{j} as materialized (select c{i}.cluster, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} on c{i}.cluster = m{i}.cluster)"""
    for i in range(centroids.ROUNDS):
        steps += [assign.format(i=i, k=k), move.format(i=i, j=i + 1, k=k, n=centroids.COMPONENTS)]
    steps.append(assign.format(i=centroids.ROUNDS, k=k))
    last = f"""
select vec_id, (best % {k})::int as cluster, (best // {k})::bigint as distance,
  (sum(best // {k}) over (partition by best % {k}))::bigint as cluster_inertia, (sum(best // {k}) over ())::bigint as inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::bigint::varchar), ',')) as centroid_sha256
from a{centroids.ROUNDS} join c{centroids.ROUNDS} on cluster = best % {k}
"""
    return ",".join(steps) + last


ORACLE: dict[str, str] = {
    "op6_exact_dedup": _EXACT_DEDUP,
    "op9_mixing": _MIXING,
    "op11_line_dedup": _LINE_DEDUP,
    "op12_hard_negatives": _HARD_NEGATIVES,
    "op13_centroid_clustering": _clustering(),
}
