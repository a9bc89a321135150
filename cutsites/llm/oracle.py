"""SQL for the queries that SQL can express."""

from __future__ import annotations

from cutsites.llm.decontamination import WINDOW
from cutsites.llm.mixing import BINS, MAX_REPEATS, SHARE, WEIGHTS

_WEIGHT = f"(case (row_number() over (order by key) - 1) % {len(WEIGHTS)} " + " ".join(f"when {i} then {w}" for i, w in enumerate(WEIGHTS)) + " end)::double"

MIXING = f"""
with d as (
  select doc_id, coalesce('0' || source, '1') as key, md5(concat_ws(':', 'mix', doc_id::varchar)) as h, md5(coalesce(text, '')) as tie,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
  from documents),
s as (select key, sum(size)::bigint as source_size from d group by key),
w as (select *, {_WEIGHT} as weight, {float(MAX_REPEATS)}::double * source_size as cap, (sum(source_size) over ())::double as total from s),
f as (select *, cap / weight as ratio,
        ({SHARE}::double * total - coalesce(sum(cap) over (order by cap / weight, key rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (order by cap / weight, key rows between current row and unbounded following) as level
      from w),
g as (select level from f where cap > level * weight order by ratio, key limit 1),
t as (select key, source_size, {SHARE}::double * total as budget, least(cap, coalesce((select level from g), ratio) * weight) as target from f),
q as (select d.*, source_size, target, budget, sum(size) over (partition by key order by h, tie rows unbounded preceding)::bigint as sent from d join t using (key)),
i as (select q.*, (e * source_size + sent) / target as v from q, range(0, {MAX_REPEATS}) r(e) where size > 0 and target > 0),
b as (select *, cast(floor(v * {BINS}) as bigint) as bin from i),
r as (select *, sum(size) over (order by bin, v, key rows unbounded preceding) as run from b),
k as (select doc_id, h, tie, key, count(*) as n from r where run <= budget group by doc_id, h, tie, key)
select q.doc_id, q.size, q.source_size::bigint as source_size, q.target, q.size * coalesce(k.n, 0)::bigint as taken
from q left join k on q.h = k.h and q.tie = k.tie and q.key = k.key and q.doc_id is not distinct from k.doc_id
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

DECONTAMINATION = f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select distinct coalesce(item_id::varchar, 'null') as item, {_WORDS} as w from benchmark),
p as (select item, w, least({WINDOW}, len(w)) as n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) as s from i where len(w) > 0),
phrases as (select distinct item, n, array_to_string(w[s:s + n - 1], ' ') as phrase from p),
x as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from phrases) where len(w) >= n),
hits as (select doc_id, s, x.n, item from x join phrases y on x.n = y.n and array_to_string(w[s:s + x.n - 1], ' ') = phrase),
words as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + n)) as pos from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""


BLOCK_ANCHORS = r"""
with d as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
x as (select r, unnest(range(1, len(w) - 33)) as s, w from d where len(w) >= 35),
y as (select r, s, count(*) over (partition by array_to_string(w[s:s + 34], ' ')) as n from x),
gone as (select distinct r, unnest(range(s, s + 35)) as pos from y where n > 1),
p as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
k as (select r, string_agg(word, ' ' order by pos) as kept, count(*) as n from p anti join gone using (r, pos) group by r)
select doc_id, len(w)::bigint as n_words, len(w)::bigint - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (r)
"""


FILTER_AUDIT = r"""
with d as (
  select doc_id, coalesce(text, '') as t, coalesce(source, '') as part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
m as (
  select doc_id, part,
    case when len(w) < 200 then 1 else 0 end
    + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end
    + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as mask
  from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
c as (
  select part, mask, count(*) as n, count(*) filter (coalesce(good, false)) as good, count(*) filter (coalesce(toxic, false)) as toxic
  from m left join l using (doc_id) group by part, mask),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from f a, f b, f c, f d, f e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, unnest([1, 2, 3, 4, 5]) as step from o),
b as (
  select filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) as own,
    coalesce(list_sum([1 << (instr('ABCDE', filter_order[i]) - 1) for i in range(1, step)]), 0)::bigint as before
  from s),
r as (
  select part, filter_order, step,
    sum(case when mask & (before | own) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & own > 0 and mask & before = 0 then n else 0 end)::bigint as removed,
    sum(case when mask & own > 0 and mask & before > 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = own then n else 0 end)::bigint as unique_fails,
    sum(case when mask & own > 0 and mask & before = 0 then good else 0 end)::bigint as good_lost,
    sum(case when mask & own > 0 and mask & before = 0 then toxic else 0 end)::bigint as toxic_lost
  from c, b group by part, filter_order, step)
select *, sum(removed) over (partition by part, filter_order[step])::bigint as shapley from r
"""


BURST_TRIES = r"""
with o as (
  select conv_id, turn, coalesce(role, '') as role, md5(coalesce(text, '')) as h, md5(md5(coalesce(text, '')) || coalesce(role, '')) as id,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
  from conversations where conv_id is not null),
own as (
  select conv_id, list(id order by turn nulls first, role, h) as ids, list(words order by turn nulls first, role, h) as words from o group by conv_id),
bytes as (select *, list_prepend(4294967295, [unicode(x)::bigint for x in string_split(conv_id::varchar, '')]) as b from own),
crc as (  -- CRC-32: eight shifts a byte
  select *, (4294967295 - list_reduce(b, lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, 3988292384 * (a & 1))))) % 4 as h
  from bytes),
r as (
  select c.conv_id, coalesce(f.ids[1:c.h], []) || c.ids[c.h + 1:] as ids, coalesce(f.words[1:c.h], []) || c.words[c.h + 1:] as words
  from crc c left join own f on f.conv_id = c.conv_id - c.conv_id % 20),
u as (select conv_id, ids, words, unnest(range(0, len(ids) + 1)) as d from r),
p as (
  select conv_id, d, md5(array_to_string(ids[1:d], ',')) as key, case when d > 0 then md5(array_to_string(ids[1:d - 1], ',')) end as above,
         case when d > 0 then words[d] else 0 end as w, d = len(ids) as ends
  from u),
n as (
  select key, d, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, any_value(w) as w,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from p group by key, d),
k as (select above as key, d - 1 as d, count(*) as n_children, min(conv_id) as least from n where d > 0 group by above, d),
x as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (key, d)),
s as (
  select p.key, p.d, sum(case when x.n_children = 0 then 1 else 0 end) as n_leaves, sum((x.n_convs - 1) * x.w) as saved_tokens
  from x join p on p.conv_id = x.conv_id and p.d <= x.d group by p.key, p.d)
select x.conv_id, x.d::bigint as depth, a.conv_id as parent_conv_id, x.n_convs, x.n_children, s.n_leaves::bigint as n_leaves,
       s.saved_tokens::bigint as saved_tokens, x.ends_sha256
from x join s using (key, d) left join n a on a.key = x.above and a.d = x.d - 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_mixing": MIXING, "op9_decontamination": DECONTAMINATION, "op11_block_anchors": BLOCK_ANCHORS, "op12_filter_audit": FILTER_AUDIT,
        "op13_burst_tries": BURST_TRIES,
    }
