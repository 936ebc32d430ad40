"""SQL of recursive filters, spectra, peaks and tests, for the queries that need it.

Each function gives the text of common table expressions, to stand in a `with recursive` list. A
series is (recording_index, channel); tables of samples have n and x_uv.
"""

from __future__ import annotations

import numpy as np

from sparktrode.functions import filters as C

KEY = "recording_index, channel"


def same(a: str, b: str) -> str:
    return f"{a}.recording_index={b}.recording_index and {a}.channel={b}.channel"


def cascade(name: str, source: str, sections: np.ndarray) -> str:
    """`name`(series, i, y): the sections over `source`(series, i, x) from the steady state of its first x."""
    start = ", ".join(f"{v!r}e0*x" if "e" not in repr(v) else f"{v!r}*x" for v in map(float, C.steady_state(sections).ravel()))
    steps, out, v = [], [], "e.x"
    for k, row in enumerate(sections):
        b0, b1, b2, a1, a2 = (f"cast({float(c)!r} as double)" for c in row)
        steps.append(f"{b0}*{v} + s{2 * k} as v{k}")
        out += [f"{b1}*{v} - {a1}*v{k} + s{2 * k + 1} as p{2 * k}", f"{b2}*{v} - {a2}*v{k} as p{2 * k + 1}"]
        v = f"v{k}"
    n = 2 * len(sections)
    # v's come before p's in a subquery, as a p needs them
    return f"""{name}_r({KEY}, i, y, {", ".join(f"s{k}" for k in range(n))}) as (select {KEY}, cast(-1 as bigint), cast(0 as double), {start} from {source} where i = 0
 union all select recording_index, channel, i, v{len(sections) - 1}, {", ".join(f"p{k}" for k in range(n))} from (select e.recording_index, e.channel, e.i, {", ".join(steps)}, {", ".join(out)} from {name}_r r join {source} e on {same("r", "e")} and e.i = r.i + 1)),
{name} as materialized (select {KEY}, i, y from {name}_r where i >= 0)"""


def zero_phase(name: str, source: str, sections: np.ndarray, pad: int) -> str:
    """`name`(series, n, x_uv): source filtered forward and backward with odd extension."""
    return f"""{name}_s as materialized (select {KEY}, count(*) c, least({pad}, count(*)-1) p, first(x_uv order by n) x0, last(x_uv order by n) x1 from {source} group by all),
{name}_e as materialized (select s.recording_index, s.channel, p-n as i, 2*x0-x_uv as x from {source} d join {name}_s s using ({KEY}) where n between 1 and p
 union all select s.recording_index, s.channel, p+n, x_uv from {source} d join {name}_s s using ({KEY})
 union all select s.recording_index, s.channel, p+c+(c-2-n), 2*x1-x_uv from {source} d join {name}_s s using ({KEY}) where n between c-1-p and c-2),
{cascade(name + "_f", name + "_e", sections)},
{name}_b as materialized (select f.recording_index, f.channel, c+2*p-1-i as i, y as x from {name}_f f join {name}_s using ({KEY})),
{cascade(name + "_g", name + "_b", sections)},
{name} as materialized (select g.recording_index, g.channel, c+p-1-i as n, y as x_uv from {name}_g g join {name}_s using ({KEY}) where c+p-1-i between 0 and c-1)"""


def robust_z(name: str, source: str, value: str, variant: str) -> str:
    """`name`(series, n, x_uv, z) of an expression over `source`."""
    z = "dev/(1.4826e0*(mad+1e-12))" if variant == "A" else "case when mad=0 then 0e0 else 0.6745e0*dev/mad end"
    return f"""{name}_m as (select {KEY}, median({value}) med from {source} group by all), {name}_d as (select s.*, {value}-med dev from {source} s join {name}_m using ({KEY})),
{name}_a as (select {KEY}, median(abs(dev)) mad from {name}_d group by all), {name} as materialized (select {KEY}, n, x_uv, {z} z from {name}_d join {name}_a using ({KEY}))"""


def peaks(name: str, source: str, value: str, threshold: float) -> str:
    """`name`(series, n, height): local maxima of an expression over `source`."""
    return f"""{name}_v as (select {KEY}, n, {value} v from {source}), {name}_t as (select *, case when lag(v) over w = v then 0 else 1 end fresh from {name}_v window w as (partition by {KEY} order by n)),
{name}_n as (select *, sum(fresh) over (partition by {KEY} order by n) run from {name}_t), {name}_q as (select {KEY}, run, min(n) a, max(n) b, min(v) h from {name}_n group by all),
{name}_h as (select *, lag(h) over w p, lead(h) over w q from {name}_q window w as (partition by {KEY} order by a)), {name} as materialized (select {KEY}, (a+b)//2 as n, h as height from {name}_h where h > p and h > q and h >= {threshold!r}e0)"""


def suppress(name: str, source: str, distance: int) -> str:
    """Highest first, of equal ones the later; peaks nearer than the distance to a kept one go."""
    return f"""{name}_o as materialized (select *, row_number() over (partition by {KEY} order by height desc, n desc) r from {source}),
{name}_r as (select distinct {KEY}, cast(0 as bigint) r, cast([] as bigint[]) kept from {source}
 union all select o.recording_index, o.channel, o.r, case when len([x for x in kept if abs(x-o.n) < {distance}]) = 0 then list_append(kept, cast(o.n as bigint)) else kept end from {name}_r s join {name}_o o on {same("s", "o")} and o.r = s.r + 1),
{name} as materialized (select o.* exclude (r) from {name}_o o join (select {KEY}, arg_max(kept, r) kept from {name}_r group by all) k on {same("o", "k")} and list_contains(kept, cast(o.n as bigint)))"""


def refractory(name: str, source: str, distance: int) -> str:
    """The first is kept, then the next at least the distance later."""
    return f"""{name}_o as materialized (select *, row_number() over (partition by {KEY} order by n) r from {source}),
{name}_r as (select distinct {KEY}, cast(0 as bigint) r, cast(-1000000 as bigint) kept from {source}
 union all select o.recording_index, o.channel, o.r, case when o.n - kept >= {distance} then cast(o.n as bigint) else kept end from {name}_r s join {name}_o o on {same("s", "o")} and o.r = s.r + 1),
{name} as materialized (select o.* exclude (r) from {name}_o o join {name}_r k on {same("o", "k")} and o.r = k.r and o.n = k.kept)"""


def half_widths(name: str, spikes: str, source: str) -> str:
    """`name`(series, n, width): width of |x_uv| at half the prominence, the bases without a limit."""
    return f"""{name}_y as materialized (select {KEY}, n as m, abs(x_uv) y, max(n) over (partition by {KEY}) n1 from {source}),
{name}_p as (select s.recording_index, s.channel, s.n, y as h, n1 from (select distinct {KEY}, n from {spikes}) s join {name}_y y on {same("s", "y")} and y.m = s.n where s.n < n1),
{name}_i as (select p.recording_index, p.channel, n, h, coalesce(max(m) filter (m < n and y > h), -1) lo, coalesce(min(m) filter (m > n and y > h), max(p.n1)+1) hi from {name}_p p join {name}_y y on {same("p", "y")} group by p.recording_index, p.channel, n, h),
{name}_z as (select i.recording_index, i.channel, n, h, greatest(min(y) filter (m > lo and m <= n), min(y) filter (m >= n and m < hi)) as base from {name}_i i join {name}_y y on {same("i", "y")} group by all),
{name}_l as (select * exclude (base), h - (h - base)/2 as level from {name}_z),
{name}_c as (select l.recording_index, l.channel, n, h, level, max(m) filter (m < n and y <= level) a, min(m) filter (m > n and y <= level) b from {name}_l l join {name}_y y on {same("l", "y")} group by all),
{name} as (select c.recording_index, c.channel, n, case when level < h then (b - case when yb.y < level then (level-yb.y)/(zb.y-yb.y) else 0 end) - (a + case when ya.y < level then (level-ya.y)/(za.y-ya.y) else 0 end) else 0 end as width
 from {name}_c c left join {name}_y ya on {same("ya", "c")} and ya.m=a left join {name}_y za on {same("za", "c")} and za.m=a+1 left join {name}_y yb on {same("yb", "c")} and yb.m=b left join {name}_y zb on {same("zb", "c")} and zb.m=b-1)"""


def spectra(name: str, source: str, fs_hz: float, window: str = "0.5e0-0.5e0*cos(2*pi()*j/len)") -> str:
    """`name`(keys of `source`, k, f_hz, pxx) of segments (seg, len, j, x): a row for each sample."""
    return f"""{name}_x as (select * exclude (x), x - avg(x) over (partition by seg) as x, {window} as w from {source}),
{name}_f as (select seg, len, k, sum(x*w*cos(2*pi()*((k*j)%len)/len)) re, sum(x*w*sin(2*pi()*((k*j)%len)/len)) im, sum(w*w) ww from {name}_x, (select unnest(range(101)) k) where k <= len//2 group by all),
{name} as materialized (select seg, len, k, k*{fs_hz!r}e0/len as f_hz, (re*re+im*im)/({fs_hz!r}e0*ww)*case when k=0 or 2*k=len then 1 else 2 end as pxx from {name}_f)"""


#: Two-sided p of Student's t by Simpson's rule: with t = sqrt(df) tan(a) the density is a power of the cosine.
P_VALUE = """(select 2*exp(lgamma((df+1)/2)-lgamma(df/2))/sqrt(pi()) * (pi()/2-atan(abs(t)/sqrt(df)))/4000e0/3 *
 sum(case when i in (0,4000) then 1 when i%2=1 then 4 else 2 end * case when df = 1 then 1 else greatest(cos(atan(abs(t)/sqrt(df)) + (pi()/2-atan(abs(t)/sqrt(df)))*i/4000e0), 0e0)**(df-1) end) from (select unnest(range(4001)) i))"""
