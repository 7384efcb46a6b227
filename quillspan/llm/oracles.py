"""DuckDB SQL for the operators that SQL can express, written for small tables."""

from __future__ import annotations

HOST_QUALITY = r"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
s as (select *, regexp_extract_all(t, '[^ \t-\r]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as x from d),
wd as (select rid, unnest(w) as a, unnest(range(len(w))) as pos from s),
tri as (select rid, pos, a, lead(a, 1) over (partition by rid order by pos) as b, lead(a, 2) over (partition by rid order by pos) as c from wd),
dup as (select rid, pos, count(*) over (partition by rid, a, b, c) as n from tri where c is not null),
cov as (select rid, count(distinct p) as n from (select rid, unnest([pos, pos + 1, pos + 2]) as p from dup where n > 1) group by 1),
base as (select doc_id, source, len(w) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
  len(x) - len(list_distinct(x)) as n_dup_lines, len(x) as n_lines, coalesce(cov.n, 0) as n_repeat_words from s left join cov using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 10 * n_symbols > n_words as r2, 2 * n_dup_lines > n_lines as r3 from base),
h as (select source, count(*)::double as n, count(*) filter (where base_failed)::double as f1, count(*) filter (where r2)::double as f2, count(*) filter (where r3)::double as f3 from f group by 1),
p as (select sum(f1) / sum(n) as m1, sum(f2) / sum(n) as m2, sum(f3) / sum(n) as m3, sum(f1 * f1 / n) / sum(n) - pow(sum(f1) / sum(n), 2) as v1, sum(f2 * f2 / n) / sum(n) - pow(sum(f2) / sum(n), 2) as v2, sum(f3 * f3 / n) / sum(n) - pow(sum(f3) / sum(n), 2) as v3 from h),
k as (select m1, m2, m3, case when v1 > 1e-12 then greatest(1, least(1000, m1 * (1 - m1) / v1 - 1)) else 1000 end as s1, case when v2 > 1e-12 then greatest(1, least(1000, m2 * (1 - m2) / v2 - 1)) else 1000 end as s2,
  case when v3 > 1e-12 then greatest(1, least(1000, m3 * (1 - m3) / v3 - 1)) else 1000 end as s3 from p),
b as (select source, greatest((f1 + m1 * s1) / (n + s1), (f2 + m2 * s2) / (n + s2), (f3 + m3 * s3) / (n + s3)) > 0.5 as blocked, (f2 + m2 * s2) / (n + s2) > 1.25 * m2 as held2, (f3 + m3 * s3) / (n + s3) > 1.25 * m3 as held3 from h, k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or blocked or (held2 and r2) or (held3 and r3)) as kept from f join b on f.source is not distinct from b.source"""

NGRAM_JACCARD = r"""
with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') as w from documents),
wd as (select rid, unnest(w) as a, unnest(range(len(w))) as pos from d where len(w) >= 3),
tri as (select rid, a || ' ' || lead(a, 1) over (partition by rid order by pos) || ' ' || lead(a, 2) over (partition by rid order by pos) as g from wd),
s as (select distinct rid, g from tri where g is not null union select rid, array_to_string(w, ' ') from d where len(w) in (1, 2)),
n as (select rid, count(*) as n from s group by 1),
link as (select x.rid as a, y.rid as b from s x join s y on x.g = y.g join n nx on nx.rid = x.rid join n ny on ny.rid = y.rid where nx.n * 10 >= 9 * ny.n and ny.n * 10 >= 9 * nx.n
  group by x.rid, y.rid, nx.n, ny.n having 100 * count(*) >= 90 * (nx.n + ny.n - count(*))),
reach as (select rid as a, rid as b from d union select r.a, l.b from reach r join link l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(o.doc_id) as component_id from d left join n using (rid) join reach r on r.a = d.rid join d o on o.rid = r.b group by d.rid, d.doc_id, n.n"""

LINE_DEDUP = r"""
with t as (select doc_id, string_split(lower(coalesce(text, '')), chr(10)) as x from documents),
l as (select doc_id, unnest(range(len(x))) as line_no, trim(regexp_replace(unnest(x), '[ \t\v\f\r]+', ' ', 'g'), ' ') as line from t),
s as (select doc_id, line_no, line, doc_id * 1000000 + line_no as place from l where line <> ''),
c as (select line, string_split(line, ' ') as w, len(string_split(line, ' ')) as n, min(place) as place from s group by 1),
m as (select * from c where n >= 5),
p as (select a.line, a.w as aw, b.w as bw, b.place from m a join m b on b.w[1] = a.w[1] and b.w[2] = a.w[2] and b.place < a.place and abs(a.n - b.n) <= 1
  union select a.line, a.w, b.w, b.place from m a join m b on b.w[-1] = a.w[-1] and b.w[-2] = a.w[-2] and b.place < a.place and abs(a.n - b.n) <= 1),
e as (select line, place, greatest(len(aw), len(bw)) as most, least(len(aw), len(bw)) as least_n,
  list_position(list_transform(range(1, least(len(aw), len(bw)) + 1), lambda i: aw[i] <> bw[i]), true) as head, list_position(list_transform(range(1, least(len(aw), len(bw)) + 1), lambda i: aw[-i] <> bw[-i]), true) as tail from p),
k as (select line, min(place) as kept from e where coalesce(nullif(head, 0) - 1, least_n) + coalesce(nullif(tail, 0) - 1, least_n) >= most - 1 group by 1)
select s.doc_id, cast(s.line_no as int) as line_no, coalesce(k.kept, c.place) // 1000000 as kept_doc_id, cast(coalesce(k.kept, c.place) % 1000000 as int) as kept_line_no
from s join c using (line) left join k using (line) where coalesce(k.kept, c.place) <> s.place"""

_ESCAPED = "replace({}, '\\', '\\\\')"
for _c in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]"):  # the bracket template's control strings, in its order
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

CHAT_FORMAT = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p as (select *, case role when 'user' then length('<s>[INST]  [/INST]') when 'assistant' then length(' </s>') when 'system' then length('[SYS]  [/SYS]') else length('[ROLE][/ROLE] </s>') + length({_ESCAPED.format('role')}) end + length({_ESCAPED.format('text')}) as piece from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256, cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, cast(sum(piece) as bigint) as formatted_chars from p group by 1"""

FILL_IN_MIDDLE = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
g as (select *, length(t) as n, [cast('0x' || substr(h, 8 * i + 1, 8) as bigint) for i in range(4)] as x from d),
c as (select *, least(x[1] % (n + 1), x[2] % (n + 1)) as a, greatest(x[1] % (n + 1), x[2] % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or x[3] % 100 >= 90 then 'plain' when x[4] % 100 < 20 then 'spm' else 'psm' end as form from g),
p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p"""

VORONOI_TOPK = """
with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.rid, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from v q join v c on c.rid <> q.rid where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from p)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10"""

_MEANS = "select cluster, list(f order by i) as v from (select cluster, i, cast(((s - ((s % n) + n) % n) // n) as bigint) as f from (select cluster, i, sum(x) as s, count(*) as n from (select cluster, unnest(v) as x, unnest(range(64)) as i from a{0}) group by 1, 2)) group by 1"
_ROUNDS = "".join(
    f"""d{r} as (select rid, vec_id, m.v, c.cluster, list_sum(list_transform(list_zip(m.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from m, c{r} c),
a{r} as (select * from d{r} qualify row_number() over (partition by rid order by d, cluster) = 1){"," if r < 3 else ""}
"""
    + (f"m{r} as ({_MEANS.format(r)}), c{r + 1} as (select c.cluster, coalesce(n.v, c.v) as v from c{r} c left join m{r} n using (cluster)),\n" if r < 3 else "")
    for r in range(4)
)
BALL_KMEANS = f"""
with m as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select row_number() over (order by sha256('1:' || cast(vec_id as varchar)), v) - 1 as cluster, v from m order by 1 limit 16),
{_ROUNDS}
select vec_id, cast(cluster as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(c3.v, ',')) as centroid_sha256 from a3 join c3 using (cluster)"""

ORACLES = {"op1_chat_format": CHAT_FORMAT, "op2_host_quality": HOST_QUALITY, "op6_ngram_jaccard": NGRAM_JACCARD, "op9_line_dedup": LINE_DEDUP, "op11_fill_in_middle": FILL_IN_MIDDLE, "op12_voronoi_topk": VORONOI_TOPK, "op13_ball_kmeans": BALL_KMEANS}
