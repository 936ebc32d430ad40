"""DuckDB SQL for the results of operators that SQL can express."""

from __future__ import annotations

from . import sharding, url_filter

#: Draws and the tree are the operator's; crc32 is folded over the bytes with a table made by rule.
_DRAW = "-ln((('0x' || substr(md5('{level}:' || {child} || ':' || key), 1, 13))::bigint + 0.5e0) / 4503599627370496e0)"


def _sharding() -> str:
    tree = sharding.uniform_tree(16)

    grown = sharding.grow(tree)

    def choose(level: str, children: list[int]) -> str:
        weight = {c: sum(x.weight for x in grown if getattr(x, level) == c) for c in children}
        draws = ", ".join(f"{{'d': {_DRAW.format(level=level, child=c)} / {weight[c]}e0, 'c': {c}}}" for c in children)
        return f"list_min([{draws}]).c"

    regions = sorted({x.region for x in tree})
    racks = {g: sorted({x.rack for x in tree if x.region == g}) for g in regions}
    shards = {k: sorted({x.shard for x in tree if x.rack == k}) for g in regions for k in racks[g]}
    rack = " ".join(f"when {g} then {choose('rack', racks[g])}" for g in regions)
    shard = " ".join(f"when {k} then {choose('shard', shards[k])}" for k in shards)
    return f"""with crc_table as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, b: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i))),
d as (select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) as n, coalesce(doc_id::varchar, 'null') as key from documents),
b as (select *, hex(encode(text)) as h from d),
c as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i::int + 1, 2))::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as crc from b, crc_table),
r as (select *, {choose("region", regions)} as region, {choose("region", [*regions, max(regions) + 1])} as region17 from c), k as (select *, case region {rack} end as rack from r), s as (select *, case rack {shard} end as shard from k),
o as (select *, ('0x' || substr(md5('slot:' || key || ':' || crc), 1, 3))::int as bucket from s)
select doc_id, n::bigint + 1 as size, crc::bigint as text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by bucket, doc_id, crc, n) - 1 as slot, (case when region17 = {max(regions) + 1} then 16 else shard end)::int as grown_shard from o"""


SHARDING = _sharding()

WARC = """with p as (select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, url, octet_length(encode(html)) as n, max(page_id) over (partition by h) as top,
 list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 10 * (k // 8)::int, 10))::bigint >> (35 - 5 * (k % 8))::int) & 31)::int + 1, 1)), 'string_agg', '') as digest from p)
select page_id, url, n::bigint as payload_bytes, digest as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from d"""


def _url_filter() -> str:
    u = url_filter
    rest = "substr(url, strpos(url, '://') + 3)"
    fits = [f"when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then {{'rule': '{r}', 'verdict': '{v}'}}" for v, r in sorted(u.RULES, key=lambda x: -len(x[1]))]
    link = "(?i)(?:href|src)\\s*=\\s*[\"'']?(?:https?:)?//([^/?#\"''\\s<>]+)"
    low = f"translate({{}}, '{u.UPPER}', '{u.LOWER}')"
    steps = []
    for i in range(u.ITERATIONS):
        steps.append(
            f"s{i + 1} as materialized (select kind, host, sum(score) as score from (select s.kind, e.dst as host, {u.DAMPING}e0 * score * share as score from s{i} s join step e on e.kind = s.kind and e.host = s.host union all select kind, host, {1 - u.DAMPING}e0 * score from s0) group by 1, 2)"
        )
    return f"""with b as (select page_id, html, case when strpos(url, '://') > 0 then {low.format(f"regexp_extract({rest}, '^([^/?#]*)', 1)")} else '' end as host, case when strpos(url, '://') > 0 then regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) else '' end as path from pages),
m as (select *, case {' '.join(fits)} end as m from b), ruled as (select page_id, html, host, path, m.rule as rule, m.verdict as ruled from m),
l as (select host as src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: {low.format('x')}))) as dst from ruled where host <> ''),
links as (select src, dst, count(*)::double as w from l where src <> dst group by 1, 2),
nodes as (select host from ruled where host <> '' union select dst from links),
sub as (select distinct array_to_string(list_slice(string_split(host, '.'), i + 1, len(string_split(host, '.'))), '.') as src from (select host, unnest(range(len(string_split(host, '.')))) as i from nodes)),
up as (select src, substr(src, strpos(src, '.') + 1) as dst, {u.PARENT_WEIGHT}e0 as w from sub where strpos(src, '.') > 0),
edges as (select src, dst, sum(w) as w from (select * from links union all select * from up union all select dst, src, w from up) group by 1, 2),
two as (select 'trust' as kind, src, dst, w from edges union all select 'distrust', dst, src, w from edges),
step as materialized (select kind, src as host, dst, w / sum(w) over (partition by kind, src) as share from two),
per as (select host, count(*) as n, count(*) filter (ruled = 'allow') as a, count(*) filter (ruled = 'block') as k from ruled where host <> '' group by 1),
seed as (select 'trust' as kind, host, a as pages from per where a > k union all select 'distrust', host, k from per where k > {u.BLOCKED_SHARE}e0 * n),
s0 as materialized (select kind, host, pages / sum(pages) over (partition by kind) as score from seed where pages > 0),
{", ".join(steps)},
bad as (select host from (select host, sum(case when kind = 'trust' then score else 0e0 end) as t, sum(case when kind = 'distrust' then score else 0e0 end) as d from s{u.ITERATIONS} group by 1) where d > t)
select page_id, host, path, rule, coalesce(ruled, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from ruled"""


URL_FILTER = _url_filter()

PHRASES = """with d as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) as piece from documents),
p as (select lang, list_filter(string_split_regex(piece, '[ \\t]'), lambda x: x <> '') as w from d),
n as (select lang, sum(len(w))::bigint as n from p group by 1),
f as materialized (select lang, k, phrase, count(*) as a from (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase from p, (select unnest(range(1, 5)) as k) where len(w) >= k) group by 1, 2, 3),
c as materialized (select *, string_split(phrase, ' ') as w from f where k > 1 and a >= 30),
cut as (select lang, phrase, a, j, array_to_string(w[1 : j], ' ') as head, array_to_string(w[j + 1 :], ' ') as tail from (select *, unnest(range(1, k)) as j from c)),
s as (select cut.*, l.a as l, r.a as r, (2000000::hugeint * cut.a) // (l.a + r.a) as score from cut join f l on l.lang = cut.lang and l.phrase = head join f r on r.lang = cut.lang and r.phrase = tail),
worst as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(a) as longer from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c)) group by 1, 2),
kept as (select worst.* from worst left join inside using (lang, phrase) where longer is null or 100 * longer < 80 * a)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join n using (lang) where rank <= 2000"""

SUFFIXES = """with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as materialized (select doc_id, i, substr(h, 2 * i::int + 1, 100) as s from (select doc_id, h, unnest(range(n - 49)) as i from d where n >= 50)),
hit as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as least from w) where least < doc_id),
runs as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from hit)),
spans as (select doc_id, min(i) as a, max(i) + 50 as b from runs group by doc_id, run),
gaps as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as low, a as high from spans union all select d.doc_id, coalesce(max(b), 0), any_value(n) from d left join spans using (doc_id) group by d.doc_id),
kept as (select doc_id, string_agg(substr(h, 2 * low::int + 1, 2 * (high - low)::int), '' order by low, high) as k from gaps join d using (doc_id) group by doc_id)
select doc_id, n::bigint as n_bytes, (n - len(k) // 2)::bigint as n_removed, (select count(*) from spans s where s.doc_id = d.doc_id) as n_spans, sha256(unhex(k)) as kept_sha256 from d join kept using (doc_id)"""
