"""Queries of samples, decoding and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktrode.operators import decode as D
from sparktrode.operators import samples as P

from .base import RAW, query, r, raw_words, signal, signal_sql, spikes, table, values

B = 64  # a small block, so that blocks matter on small data too
ONE = ["recording_index", "channel", "n", "x_uv"]


@query("select o_orderkey, o_totalprice, 'named' as found_by from orders union all select o_orderkey, o_totalprice, 'values' from orders")
def p1_time_column(spark, sf_dir):
    """By name, and by values: o_custkey doesn't rise, and a column with a gap doesn't count."""
    o = table(spark, sf_dir, "orders")
    named = o.select("o_totalprice", "o_custkey", F.col("o_orderkey").alias("seconds"))
    gap = F.when(F.col("o_orderkey") % 101 != 0, F.col("o_orderkey").cast("double"))
    risen = o.select(gap.alias("gap"), "o_custkey", (F.col("o_orderkey") / F.lit(1.0)).alias("x"), "o_totalprice")
    pick = lambda d, how: d.select(F.col(P.time_column(d)).cast("long").alias("o_orderkey"), "o_totalprice", F.lit(how).alias("found_by"))
    return pick(named, "named").unionByName(pick(risen, "values"))


@query(f"with {signal_sql()}, d as (select recording_index, channel, t_s - lag(t_s) over (partition by recording_index, channel order by n) dt from fx_signal) select recording_index, channel, round(1/median(dt),6) as fs_hz from d where dt is not null group by 1,2")
def p2_sampling_rate(spark, sf_dir):
    out = P.sampling_rate(signal(spark, sf_dir))
    return out.select("recording_index", "channel", r("fs_hz").alias("fs_hz"))


@query(f"with {signal_sql()} select recording_index, channel, n, x_uv from fx_signal where channel in ('click','view') ")
def p3_pick_channels(spark, sf_dir):
    return P.pick_channels(signal(spark, sf_dir), "click, view,error", "error").select(*ONE)


@query("select p_partkey, p_name from part where not regexp_matches(trim(regexp_replace(lower(trim(p_name)), '[\\s\\-./()]+', '_', 'g'), '_'), 'marker|ttl|trigger|event|digital|dig|din|dout|stim|sync')")
def p4_markers(spark, sf_dir):
    return P.drop_markers(table(spark, sf_dir, "part"), "p_name").select("p_partkey", "p_name")


@query(f"with {signal_sql()} select recording_index, channel, n, x_uv, case channel when 'view' then 0 else 2 end as place from fx_signal where channel in ('view','purchase')")
def p5_target_channels(spark, sf_dir):
    return P.target_channels(signal(spark, sf_dir), ["view", "absent", "purchase"]).select(*ONE, "place")


@query(f"with {signal_sql()} select a.recording_index, a.channel || '-' || b.channel as channel, a.n, a.x_uv - b.x_uv as x_uv from fx_signal a join fx_signal b on a.recording_index=b.recording_index and a.n=b.n where (a.channel='click' and b.channel='view') or (a.channel='error' and b.channel='click')")
def p6_differences(spark, sf_dir):
    return P.differences(signal(spark, sf_dir), [("click", "view"), ("error", "click"), ("error", "absent")]).select(*ONE)


@query(f"with {signal_sql()}, c as (select * from fx_signal where t_s >= 0.5e0 and t_s <= 2e0) select recording_index, channel, n, x_uv from c where (recording_index, channel) in (select (recording_index, channel) from c group by all having count(*) >= 100)")
def p7_crop(spark, sf_dir):
    return P.crop(signal(spark, sf_dir), 0.5, 2.0, 100.0).select(*ONE)


@query(f"with {signal_sql()}, f as (select recording_index, min(t_s) t0 from fx_signal group by 1) select recording_index, channel, n, x_uv from fx_signal join f using (recording_index) where t_s-t0 >= 0.01e0*60 and t_s-t0 <= 0.03e0*60")
def p8_crop_minutes(spark, sf_dir):
    return P.crop_minutes(signal(spark, sf_dir), 0.01, 0.03).select(*ONE)


@query(f"with {signal_sql()}, e as (select recording_index, channel, (min(t_s)+max(t_s))/2 mid from fx_signal group by 1,2), k as (select s.* from fx_signal s join e using (recording_index, channel) where abs(t_s-mid) <= 1e0) select recording_index, channel, n, x_uv from k where (recording_index, channel) in (select (recording_index, channel) from k group by all having max(t_s)-min(t_s) >= 1.8e0)")
def p9_middle_window(spark, sf_dir):
    return P.middle_window(signal(spark, sf_dir), 2.0).select(*ONE)


@query(f"with {signal_sql()}, k as (select *, row_number() over (partition by recording_index, channel order by n)-1 as m from fx_signal where not (t_s between 0.2e0 and 0.5e0) and not (t_s between 1e0 and 1.25e0)) select recording_index, channel, m as n, x_uv from k")
def p10_exclude_ranges(spark, sf_dir):
    return P.exclude_ranges(signal(spark, sf_dir), P.ranges_of("0.2-0.5, 1.25-1, x, 3-")).select(*ONE)


FILLED = signal_sql(holes=True) + """, g as (select *, last_value(case when x_uv is not null then n end ignore nulls) over w1 as ln, last_value(x_uv ignore nulls) over w1 as lx, first_value(case when x_uv is not null then n end ignore nulls) over w2 as hn, first_value(x_uv ignore nulls) over w2 as hx from fx_signal
 window w1 as (partition by recording_index, channel order by n rows between unbounded preceding and current row), w2 as (partition by recording_index, channel order by n rows between current row and unbounded following)),
filled as (select recording_index, channel, n, t_s, case when ln is null then hx when hn is null or hn = ln then lx else lx + (hx-lx)/(hn-ln)*(n-ln) end as x_uv from g)"""


@query(f"with {FILLED} select recording_index, channel, n, round(x_uv,6) as x_uv from filled")
def g1_fill_gaps(spark, sf_dir):
    return P.fill_gaps(signal(spark, sf_dir, holes=True), B).select("recording_index", "channel", "n", r("x_uv").alias("x_uv"))


@query(f"with {signal_sql()}, m as (select recording_index, channel, n, case when recording_index = 2 and n > 0 then null else x_uv end x_uv from fx_signal), k as (select recording_index, channel, count(x_uv) c from m group by 1,2) select recording_index, channel, n, case when c < 2 then 0e0 else x_uv end as x_uv from m join k using (recording_index, channel)")
def g2_sparse_policy(spark, sf_dir):
    s = signal(spark, sf_dir).withColumn("x_uv", F.when((F.col("recording_index") != 2) | (F.col("n") == 0), F.col("x_uv")))
    return P.sparse_policy(s, "zeros").select(*ONE)


ZA = signal_sql() + ", md as (select recording_index, channel, median(x_uv) med from fx_signal group by 1,2), dv as (select s.*, x_uv-med dev from fx_signal s join md using (recording_index, channel)), ma as (select recording_index, channel, median(abs(dev)) mad from dv group by 1,2), zz as (select dv.*, dev/(1.4826e0*(mad+1e-12)) z, case when mad=0 then 0e0 else 0.6745e0*dev/mad end zb from dv join ma using (recording_index, channel))"


@query(f"with {ZA} select recording_index, channel, n, z as za, zb from zz")
def f4_robust_z(spark, sf_dir):
    a = P.robust_z(signal(spark, sf_dir)).select("recording_index", "channel", "n", F.col("z").alias("za"))
    b = P.robust_z(signal(spark, sf_dir), "B").select("recording_index", "channel", "n", F.col("z").alias("zb"))
    return a.join(b, ["recording_index", "channel", "n"])


@query(f"""with {signal_sql()}, e as (select recording_index, channel, min(x_uv) lo, max(x_uv) hi, count(*) total from fx_signal group by 1,2), c as (select recording_index, channel, cast(least(floor((x_uv-lo)/((hi-lo)/300)),299) as int) bin, count(*) c from fx_signal join e using (recording_index, channel) group by 1,2,3)
select e.recording_index, e.channel, cast(i as int) as bin, round(lo+(i+5e-1)*((hi-lo)/300),6) as centre, round(coalesce(c,0)/(total*((hi-lo)/300)),6) as density from e cross join (select unnest(range(300)) i) left join c on c.recording_index=e.recording_index and c.channel=e.channel and c.bin=i""")
def f5_histogram(spark, sf_dir):
    h = P.histogram(signal(spark, sf_dir))
    return h.select("recording_index", "channel", "bin", r("centre").alias("centre"), r("density").alias("density"))


@query(f"""with {signal_sql()}, m as (select recording_index, channel, avg(x_uv) m from fx_signal group by 1,2), c as (select s.recording_index, s.channel, n, x_uv-m as c from fx_signal s join m using (recording_index, channel)),
p as (select a.recording_index, a.channel, b.n-a.n as lag, sum(a.c*b.c) s from c a join c b on a.recording_index=b.recording_index and a.channel=b.channel and b.n between a.n and a.n+20 group by 1,2,3)
select p.recording_index, p.channel, cast(p.lag as int) as lag, round(p.s/z.s,6) as acg from p join p z on z.recording_index=p.recording_index and z.channel=p.channel and z.lag=0""")
def w7_autocorrelogram(spark, sf_dir):
    out = P.autocorrelation(signal(spark, sf_dir), 20, B)
    return out.select("recording_index", "channel", "lag", r("acg").alias("acg"))


@query(f"with {RAW} select recording, n, round((word-32768)*0.195e0,6) as uv from fx_raw")
def d1_amplifier(spark, sf_dir):
    return raw_words(spark, sf_dir).select("recording", "n", r(D.amplifier_uv(F.col("word"))).alias("uv"))


@query(f"with {RAW} select recording, n, round(37.4e-6*word,6) as aux_v, round(74.8e-6*word,6) as supply_v, round(0.01e0*word,6) as temperature_c from fx_raw")
def d2_auxiliary(spark, sf_dir):
    w = F.col("word")
    return raw_words(spark, sf_dir).select("recording", "n", r(D.auxiliary_v(w)).alias("aux_v"), r(D.supply_v(w)).alias("supply_v"), r(D.temperature_c(w)).alias("temperature_c"))


@query(f"with {RAW} select recording, n, round((case recording when 1 then 152.59e-6*(word-32768) when 2 then 312.5e-6*(word-32768) else 50.354e-6*word end)*1e3,6) as millivolts, round(312.5e-6*(word-32768)*1e3,6) as stim_millivolts from fx_raw")
def d3_board_adc(spark, sf_dir):
    mode = F.when(F.col("recording") == 2, 13).otherwise(F.col("recording"))
    return raw_words(spark, sf_dir).select("recording", "n", r(D.adc_v(F.col("word"), mode) * 1e3).alias("millivolts"), r(D.stim_adc_v(F.col("word")) * 1e3).alias("stim_millivolts"))


@query(f"with {RAW} select recording, n, round(-0.01923e0*(word-512),6) as volts from fx_raw")
def d4_dc_amplifier(spark, sf_dir):
    return raw_words(spark, sf_dir).select("recording", "n", r(D.dc_v(F.col("word"))).alias("volts"))


@query(f"with {RAW} select recording, n, 'DIN-' || o as channel, ((word >> o) & 1) = 1 as level from fx_raw, (values (0),(3),(7),(15)) t(o)")
def d5_digital(spark, sf_dir):
    channels = F.broadcast(values(spark, [(f"DIN-{o}", o) for o in (0, 3, 7, 15)], "channel string, native_order int"))
    return raw_words(spark, sf_dir).crossJoin(channels).select("recording", "n", "channel", D.digital(F.col("word"), F.col("native_order")).alias("level"))


@query(f"with {RAW} select recording, n, ((word>>15)&1)=1 as compliance, ((word>>14)&1)=1 as charge_recovery, ((word>>13)&1)=1 as amp_settle, (word&255)*case when ((word>>8)&1)=1 then -1 else 1 end as stim from fx_raw")
def d6_stim_word(spark, sf_dir):
    return raw_words(spark, sf_dir).select("recording", "n", *[c.alias(k) for k, c in D.stim_parts(F.col("word")).items()])


@query(f"with {RAW} select recording, n, round((word&255)*case when ((word>>8)&1)=1 then -1 else 1 end*1e-8/1e-6,6) as ua from fx_raw")
def d7_stim_current(spark, sf_dir):
    return raw_words(spark, sf_dir).select("recording", "n", r(D.stim_ua(D.stim_parts(F.col("word"))["stim"], 1e-8)).alias("ua"))


@query(f"with {RAW}, d as (select recording, tick - lag(tick) over (partition by recording order by n) s from fx_raw) select recording, count(*) filter (s <> 1) as gaps from d group by 1")
def d8_timestamp_gaps(spark, sf_dir):
    return D.timestamp_gaps(raw_words(spark, sf_dir), block=B)


@query(f"with {RAW} select recording, n, round(tick/30000e0,6) as t_s from fx_raw")
def d9_seconds(spark, sf_dir):
    return raw_words(spark, sf_dir).select("recording", "n", r(D.seconds(F.col("tick"), 30000.0)).alias("t_s"))


@query(f"with {RAW} select 'aux' as axis, recording, tick from fx_raw where n % 4 = 0 union all select 'supply', recording, tick from fx_raw where n % 60 = 0")
def d10_slow_axes(spark, sf_dir):
    raw = raw_words(spark, sf_dir)
    pick = lambda name, k: D.subsampled(raw, k).select(F.lit(name).alias("axis"), "recording", "tick")
    return pick("aux", 4).unionByName(pick("supply", 60))


PAIRS = [("click", "view"), ("error", "absent")]
#: The rate of each recording by its time column, and the same text in SQL.
RATES = ", st as (select recording_name, t_s - lag(t_s) over (partition by recording_name, channel order by n) dt from fx_signal), rt as (select recording_name, 1/median(dt) as fs_hz from st where dt is not null group by 1)"


def rates(samples):
    steps = P.with_previous(samples, "t_s").filter("previous is not null")
    return P.medians(steps, ["recording_name"], F.col("t_s") - F.col("previous")).select("recording_name", r(1 / F.col("median")).alias("fs_hz"))


@query(f"""with {signal_sql()}{RATES}, e as (select recording_name, channel, max(n)+1 as s, min(t_s) t0, max(t_s) t1 from fx_signal group by 1,2),
f as (select recording_name, max(s) samples, min(t0) start_s, max(t1) end_s, count(*) channels, count(*) filter (channel in ('click','view')) exported, string_agg(channel, ', ' order by channel) filter (channel in ('click','view')) exported_names, cast(bool_or(channel='click') and bool_or(channel='view') as bigint) differences from e group by 1),
g as (select f.*, round(fs_hz,6) fs_hz, samples/round(fs_hz,6) as duration_s from f join rt using (recording_name))
select recording_name, cast(samples as bigint) samples, round(start_s,6) start_s, round(end_s,6) end_s, channels, exported, exported_names, differences, fs_hz, round(duration_s,6) duration_s from g
union all select 'all', cast(sum(samples) as bigint), round(min(start_s),6), round(max(end_s),6), null, null, null, null, min(fs_hz), round(sum(duration_s),6) from g""")
def a9_conversion_summary(spark, sf_dir):
    s = signal(spark, sf_dir)
    out = P.conversion_summary(s, rates(s), ["click", "view", "absent"], PAIRS)
    return out.select("recording_name", "samples", r("start_s").alias("start_s"), r("end_s").alias("end_s"), "channels", "exported", "exported_names", "differences", "fs_hz", r("duration_s").alias("duration_s"))


@query(f"with {signal_sql()}, c as (select recording_index, max(n)+1 c from fx_signal group by 1), o as (select recording_index, sum(c) over (order by recording_index) - c as before from c) select s.recording_index, channel, n, round((before + n)/1e2,6) as t_all_s from fx_signal s join o using (recording_index)")
def a10_continuous_time(spark, sf_dir):
    return P.continuous_time(signal(spark, sf_dir), 100.0).select("recording_index", "channel", "n", r("t_all_s").alias("t_all_s"))


@query(f"""with {signal_sql()}{RATES}, h as (select distinct recording_name, channel from fx_signal), z as (select round(min(fs_hz),6) fs_hz from rt),
c as (select channel, count(*) files from h where channel in ('click','view','error') group by 1 union all select 'click-view', count(*) from h a join h b using (recording_name) where a.channel='click' and b.channel='view' union all select 'error-absent', 0)
select channel, files, fs_hz from c, z""")
def a11_channel_union(spark, sf_dir):
    s = signal(spark, sf_dir)
    return P.channel_union(s, rates(s), ["click", "view", "error", "absent"], PAIRS)
