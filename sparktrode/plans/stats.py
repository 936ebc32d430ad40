"""Queries of baseline, stimulation and post statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktrode.operators import statistics as S
from sparktrode.sources.tables import written

from .base import query, r
from .counts import WINDOWS, windows
from .dsp_sql import P_VALUE

UNIT, GROUP = ["channel"], "grp"
KEYS = ["channel", "grp"]

RATES = WINDOWS + """, rates as (select *, window_end_s-window_start_s as window_duration_s, spike_count/(window_end_s-window_start_s) as hz,
 case when epoch_label='Baseline' then 'Baseline' when epoch_label='Post' then 'Post' else 'Stimulation' end as phase,
 case epoch_label when '-70nA' then '-70 nA' when '-90nA' then '-90 nA' end as stim, case when epoch_label='Post' then 'Post' end as post_label from fx_windows),
halves as (select *, case when phase='Baseline' then case when (window_start_s+window_end_s)/2 < (min(window_start_s) over u + (max(window_end_s) over u - min(window_start_s) over u)/2) then 'Baseline first half' else 'Baseline second half' end end as half from rates window u as (partition by channel, grp, phase)),
parts as (select *, case when recording_index in (2,3) then 1 when recording_index in (4,5) then 2 end as part_index, case when recording_index in (2,3) then '-70 nA' when recording_index in (4,5) then '-90 nA' end as stimulation_label from halves),
bt as (select channel, grp, avg(hz) filter (half='Baseline first half') h1, avg(hz) filter (half='Baseline second half') h2, count(*) filter (half='Baseline first half') n1, count(*) filter (half='Baseline second half') n2,
 avg(hz) b, stddev_samp(hz)/sqrt(count(*)) be, count(*) bn, stddev_samp(hz) filter (half='Baseline second half')/sqrt(count(*) filter (half='Baseline second half')) e2 from parts where phase='Baseline' group by 1,2),
pm as (select channel, grp, part_index, stimulation_label, avg(hz) filter (phase='Stimulation') s, count(*) filter (phase='Stimulation') sn, stddev_samp(hz) filter (phase='Stimulation')/sqrt(count(*) filter (phase='Stimulation')) se,
 avg(hz) filter (phase='Post') p, count(*) filter (phase='Post') pn, stddev_samp(hz) filter (phase='Post')/sqrt(count(*) filter (phase='Post')) pe from parts where part_index is not null group by 1,2,3,4),
pt as (select pm.*, bt.* exclude (channel, grp), coalesce(h2,b) as ref, (h2-h1)/nullif(h1,0)*100 as bp, e2/abs(nullif(h1,0))*100 as bpe, (s-coalesce(h2,b))/nullif(coalesce(h2,b),0)*100 as sp, se/abs(nullif(coalesce(h2,b),0))*100 as spe,
 (p-coalesce(h2,b))/nullif(coalesce(h2,b),0)*100 as pp, pe/abs(nullif(coalesce(h2,b),0))*100 as ppe from pm left join bt on bt.channel=pm.channel and bt.grp=pm.grp),
long as (select grp, part_index, 'Part ' || part_index || ': ' || stimulation_label as part_label, stimulation_label, 'Baseline' as phase, h2 as hz, bp as pct, h1 as a, h2 as b2, h1 as ref, 'Baseline first half' as rl from pt
 union all select grp, part_index, 'Part ' || part_index || ': ' || stimulation_label, stimulation_label, 'Stimulation', s, sp, b, s, ref, 'Baseline second half' from pt
 union all select grp, part_index, 'Part ' || part_index || ': ' || stimulation_label, stimulation_label, 'Post', p, pp, b, p, ref, 'Baseline second half' from pt)"""


def rates(spark, sf_dir):
    return S.prepare(windows(spark, sf_dir))


def parts(spark, sf_dir):
    return S.experiment_parts(S.baseline_halves(rates(spark, sf_dir), KEYS), KEYS)


def part_table(spark, sf_dir):
    return S.part_table(written(parts(spark, sf_dir), "parts"), KEYS)


def tables(spark, sf_dir):
    """The part table and the windows it comes from, each written once for a query that needs both often."""
    rows = written(parts(spark, sf_dir), "parts")
    return written(S.part_table(rows, KEYS), "part_table"), rows


def rounded(df, **names):
    """Doubles rounded, and columns renamed."""
    return df.select(*[(r(c, 6) if t == "double" else F.col(c)).alias(names.get(c, c)) for c, t in df.dtypes])


@query(f"with {RATES} select recording_name, channel, phase, round(stddev_samp(hz)*1e6/sqrt(count(*)),6) as sem, round(stddev_samp(hz)*1e6,6) as sd from rates group by 1,2,3")
def a6_error_bars(spark, sf_dir):
    hz = F.col("firing_rate_hz") * 1e6
    return rounded(rates(spark, sf_dir).groupBy("recording_name", "channel", "phase").agg(S.error(hz).alias("sem"), S.error(hz, "sd").alias("sd")))


@query(f"with {RATES} select channel, case when channel='view' then 'Unlabeled' else grp end as grp, phase, round(avg(hz),6) as mean_firing_rate_hz, round(stddev_samp(hz)/sqrt(count(*)),6) as sem_firing_rate_hz, count(*) as n_windows, round(avg(spike_count),6) as mean_spike_count, round(avg(window_duration_s),6) as mean_window_duration_s from rates group by 1,2,3")
def a7_unit_means(spark, sf_dir):
    rows = rates(spark, sf_dir).withColumn("grp", F.when(F.col("channel") != "view", F.col("grp")))
    return rounded(S.unit_means(rows, UNIT, GROUP))


@query(f"with {RATES} select recording_index, channel, window_index, round(hz*1e6,6) as micro_hz from rates")
def a8_firing_rate(spark, sf_dir):
    return rates(spark, sf_dir).select("recording_index", "channel", "window_index", r(F.col("firing_rate_hz") * 1e6).alias("micro_hz"))


@query(f"with {RATES} select recording_index, channel, window_index, half as baseline_half from halves where phase='Baseline'")
def e1_baseline_halves(spark, sf_dir):
    return S.baseline_halves(rates(spark, sf_dir), KEYS).filter("phase = 'Baseline'").select("recording_index", "channel", "window_index", "baseline_half")


@query(f"with {RATES} select channel, grp, round(h1,9) as baseline_first_half_hz, round(h2,9) as baseline_second_half_hz, n1 as baseline_first_half_n_windows, n2 as baseline_second_half_n_windows, round(h2-h1,9) as delta_hz, round((h2-h1)/nullif(h1,0)*100,6) as percent_change from bt")
def e2_baseline_table(spark, sf_dir):
    out = S.baseline_table(S.baseline_halves(rates(spark, sf_dir), KEYS), KEYS)
    return out.withColumns({c: r(c, 9) for c in ("baseline_first_half_hz", "baseline_second_half_hz", "delta_hz")} | {"percent_change": r("percent_change")})


@query(f"with {RATES} select recording_index, channel, window_index, part_index, stimulation_label, 'Part ' || part_index || ': ' || stimulation_label as part_label from parts")
def e3_experiment_parts(spark, sf_dir):
    return parts(spark, sf_dir).select("recording_index", "channel", "window_index", "part_index", "stimulation_label", "part_label")


@query(f"with {RATES} select distinct part_index, stimulation_label, 'Part ' || part_index || ': ' || stimulation_label as part_label from parts where part_index is not null")
def e4_detected_parts(spark, sf_dir):
    return S.detected_parts(parts(spark, sf_dir))


@query(f"""with {RATES} select channel, grp, part_index, stimulation_label, 'Part ' || part_index || ': ' || stimulation_label as part_label, round(s*1e3,6) as stimulation_hz, sn as stimulation_n_windows, round(se*1e3,6) as stimulation_window_error_hz, round(p*1e3,6) as post_hz, pn as post_n_windows, round(pe*1e3,6) as post_window_error_hz,
round(b*1e3,6) as baseline_hz, round(be*1e3,6) as baseline_window_error_hz, bn as baseline_n_windows, round(h1*1e3,6) as baseline_first_half_hz, round(h2*1e3,6) as baseline_second_half_hz, n1 as baseline_first_half_n_windows, n2 as baseline_second_half_n_windows, round(bp,6) as baseline_percent_change,
round(ref*1e3,6) as percent_reference_hz, 'Baseline second half' as percent_reference_label, round((s-b)*1e3,6) as stimulation_delta_hz, round(sp,6) as stimulation_percent_change, round((p-b)*1e3,6) as post_delta_hz, round(pp,6) as post_percent_change from pt""")
def e5_part_table(spark, sf_dir):
    out = part_table(spark, sf_dir).drop("baseline_percent_change_error", "stimulation_percent_change_error", "post_percent_change_error")
    return out.select(*[(r(F.col(c) * 1e3) if c.endswith("_hz") else r(c) if t == "double" else F.col(c)).alias(c) for c, t in out.dtypes])


@query(f"with {RATES} select channel, part_index, round(bpe,6) as baseline_percent_change_error, round(spe,6) as stimulation_percent_change_error, round(ppe,6) as post_percent_change_error from pt")
def e6_percent_errors(spark, sf_dir):
    return rounded(part_table(spark, sf_dir).select("channel", "part_index", "baseline_percent_change_error", "stimulation_percent_change_error", "post_percent_change_error"))


_PAIRED = ", d as (select grp, part_index, part_label, stimulation_label, phase, count(b2-a) n, max(abs(b2-a)) <= 1e-8 z, avg(b2-a)/(stddev_samp(b2-a)/sqrt(count(b2-a))) t from long group by all)"


@query(f"""with {RATES}{_PAIRED} select l.part_index, l.part_label, l.stimulation_label, l.grp as "group", l.phase, count(hz) as n_units, round(avg(hz)*1e3,6) as mean_hz, round(stddev_samp(hz)/sqrt(count(hz))*1e3,6) as sem_hz, min(rl) as percent_reference_label, round(avg(ref)*1e3,6) as percent_reference_mean_hz, round(avg(pct),6) as percent_change_mean, round(stddev_samp(pct)/sqrt(count(pct)),6) as percent_change_sem, count(pct) as percent_change_n,
'paired t-test' as paired_test_used, max(n) as paired_n, round(max(case when n > 1 and not z then t end),6) as t, max(case when n > 1 then n-1e0 end) as df from long l join d using (grp, part_index, part_label, stimulation_label, phase) group by 1,2,3,4,5""")
def e7_part_summary(spark, sf_dir):
    out = S.part_summary(*tables(spark, sf_dir), GROUP).drop("all_zero")
    return out.select(*[(r(F.col(c) * 1e3) if c.endswith("_hz") else r(c) if t == "double" else F.col(c)).alias(c) for c, t in out.dtypes])


@query(f"with {RATES}{_PAIRED} select part_index, grp, phase, n as paired_n, z as all_zero, round(case when n > 1 and not z then t end,6) as t, cast(case when n > 1 then n-1.0 end as double) as df from d")
def e8_paired_test(spark, sf_dir):
    long = S.phase_rows(part_table(spark, sf_dir), GROUP)
    return rounded(S.t_stats(long, ["part_index", "group", "phase"], F.col("b") - F.col("a")), group="grp")


_RANKED = """, o as (select *, row_number() over (partition by grp, phase, part_index order by recording_index, window_start_s, window_end_s, window_index, channel) k, row_number() over (partition by grp, half order by recording_index, window_start_s, window_end_s, window_index, channel) kh from parts),
pairs as (select x.part_index, x.phase, x.grp, y.hz a, x.hz b2 from o x join o y on y.phase='Baseline' and y.grp=x.grp and y.k=x.k where x.part_index is not null
 union all select q.part_index, 'Baseline', x.grp, x.hz, y.hz from o x join o y on x.grp=y.grp and x.kh=y.kh and x.half='Baseline first half' and y.half='Baseline second half' join (select distinct part_index, grp from parts where part_index is not null) q on q.grp=x.grp)"""


@query(f"with {RATES}{_RANKED} select part_index, phase, grp, count(*) as paired_n, max(abs(b2-a)) <= 1e-8 as all_zero, round(avg(b2-a)/(stddev_samp(b2-a)/sqrt(count(*))),6) as t, cast(count(*)-1.0 as double) as df from pairs group by 1,2,3")
def e9_window_test(spark, sf_dir):
    return rounded(S.t_stats(S.window_pairs(written(parts(spark, sf_dir), "parts"), GROUP), ["part_index", "phase", "group"], F.col("b") - F.col("a")), group="grp")


@query(f"""with {RATES}, g as (select part_index, part_label, stimulation_label, phase, grp, count(pct) n, avg(pct) m, var_samp(pct) v from long group by 1,2,3,4,5)
select a.part_index, a.phase, a.grp as group_1, b.grp as group_2, a.n as n_group_1, b.n as n_group_2, round(a.m,6) as group_1_mean, round(b.m,6) as group_2_mean, round(case when a.n>1 and b.n>1 then (a.m-b.m)/sqrt(a.v/a.n+b.v/b.n) end,6) as t,
round(case when a.n>1 and b.n>1 then (a.v/a.n+b.v/b.n)**2/((a.v/a.n)**2/(a.n-1)+(b.v/b.n)**2/(b.n-1)) end,6) as df from g a join g b using (part_index, part_label, stimulation_label, phase) where a.grp < b.grp""")
def e10_unpaired_test(spark, sf_dir):
    return rounded(S.unpaired_tests(tables(spark, sf_dir)[0], GROUP).drop("part_label", "stimulation_label", "all_zero"))


@query("select p_partkey, p, case when p < 0.0001 then '****' when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' when p is null then 'n/a' else 'ns' end as stars from (select p_partkey, case when p_size % 7 = 0 then null else round(p_size*p_size/30000.0,8) end as p from part)")
def e11_stars(spark, sf_dir):
    from .base import table

    p = F.when(F.col("p_size") % 7 != 0, F.round(F.col("p_size") * F.col("p_size") / 30000.0, 8))
    return table(spark, sf_dir, "part").select("p_partkey", p.alias("p")).withColumn("stars", S.stars(F.col("p")))


_STARS = "case when p is null then 'n/a' when p < 1e-4 then '****' when p < 1e-3 then '***' when p < 1e-2 then '**' when p < 0.05 then '*' else 'ns' end"


@query(f"""with {RATES}, lab as (select channel, grp, phase, case when phase='Stimulation' then stim when part_index is null then 'Post' else 'Post ' || part_index end as category, avg(hz) as v, stddev_samp(hz)/sqrt(count(*)) as e, min(recording_index*100+window_index) as first_seen from parts where phase <> 'Baseline' group by 1,2,3,4),
c as (select bt.grp, 'Baseline' as phase, 'Baseline' as category, -1 as first_seen, h1 as a, h2 as v, (h2-h1)/nullif(h1,0)*100 as pct, e2/abs(nullif(h1,0))*100 as err from bt where (h2-h1)/nullif(h1,0)*100 is not null
 union all select lab.grp, phase, category, first_seen, b, v, (v-coalesce(h2,b))/nullif(coalesce(h2,b),0)*100, e/abs(nullif(coalesce(h2,b),0))*100 from lab left join bt on bt.channel=lab.channel and bt.grp=lab.grp),
g as (select grp, phase, category, min(first_seen) fs, count(pct) n, avg(pct) mean, case when count(pct)>1 then stddev_samp(pct)/sqrt(count(pct)) else max(err) end as error, count(v-a) pn, max(abs(v-a)) <= 1e-8 as z, avg(v-a)/(stddev_samp(v-a)/sqrt(count(v-a))) as td from c group by 1,2,3 having count(pct) > 0),
v as (select *, case when pn > 1 and not z then td end as t, case when pn > 1 then pn-1e0 end as df from g), q as (select *, case when z and df is not null then 1e0 when t is not null then {P_VALUE} end as p from v),
ct as (select phase, category, cast(dense_rank() over (order by case phase when 'Baseline' then 1 when 'Stimulation' then 2 else 3 end, min(first_seen), category) as int) as category_order from c group by 1,2 having count(pct) > 0)
select grp as "group", category, category_order, n, round(mean,6) as mean, round(error,6) as error, round(t,6) as t, df, round(p,8) as p_value, {_STARS} as significance from q join ct using (phase, category)""")
def e12_pooled_changes(spark, sf_dir):
    out = S.pooled_changes(written(parts(spark, sf_dir), "parts"), GROUP, UNIT)
    return out.select(*[r(c, 8 if c == "p_value" else 6).alias(c) if t == "double" and c != "df" else F.col(c) for c, t in out.dtypes])


@query(f"with {RATES} select part_index, channel, round(case when count(sp) > 1 then stddev_samp(sp)/sqrt(count(sp)) else max(spe) end,6) as error from pt group by 1,2")
def e13_fallback_error(spark, sf_dir):
    pct = F.col("stimulation_percent_change")
    out = part_table(spark, sf_dir).groupBy("part_index", "channel").agg(F.count(pct).alias("n"), S.error(pct).alias("across"), F.max("stimulation_percent_change_error").alias("single"))
    return out.select("part_index", "channel", r(S.fallback_error(F.col("across"), F.col("n"), F.col("single"))).alias("error"))


_CELLS = "union all ".join(f"select part_index, stimulation_label, grp, '{k}' as kind, '{p}' as phase, {v} as v, {e} as e from pt " for k, p, v, e in [("frequency", "Baseline", "b", "be"), ("frequency", "Stimulation", "s", "se"), ("frequency", "Post", "p", "pe"), ("percent", "Baseline", "bp", "bpe"), ("percent", "Stimulation", "sp", "spe"), ("percent", "Post", "pp", "ppe")])


@query(f"""with {RATES}{_PAIRED}, tt as (select part_index, grp, phase, z, case when n > 1 and not z then t end as t, case when n > 1 then n-1e0 end as df from d), q as (select *, case when z and df is not null then 1e0 when t is not null then {P_VALUE} end as p from tt),
cells as ({_CELLS}), h as (select *, count(v) over (partition by part_index, kind, phase) > 0 as has, count(case when phase <> 'Baseline' then v end) over (partition by part_index, kind) > 0 as others, count(case when kind='frequency' and phase='Stimulation' then v end) over (partition by part_index) > 0 as stimulated from cells),
a as (select part_index, grp, kind, phase, case when phase='Stimulation' or (phase='Post' and not stimulated) then stimulation_label else phase end as label, avg(v) m, case when count(v) > 1 then stddev_samp(v)/sqrt(count(v)) else max(e) end as er, count(v) n from h where has and (others or kind='percent') group by all)
select a.part_index, a.grp as "group", a.kind, a.phase, a.label, round(case when kind='frequency' then 1e3 else 1e0 end*m,6) as mean, round(case when kind='frequency' then 1e3 else 1e0 end*er,6) as error, a.n, case when kind='frequency' and a.phase='Baseline' then null when q.part_index is null then null else {_STARS} end as significance from a left join q on q.part_index=a.part_index and q.grp=a.grp and q.phase=a.phase""")
def e14_plot_tables(spark, sf_dir):
    s = S.plot_tables(*tables(spark, sf_dir), GROUP)
    scale = F.when(F.col("kind") == "frequency", 1e3).otherwise(1.0)
    return s.select("part_index", "group", "kind", "phase", "label", r(scale * F.col("mean")).alias("mean"), r(scale * F.col("error")).alias("error"), "n", "significance")


@query(f"""with {RATES}, l as (select *, lag(phase) over (partition by channel, grp order by window_start_s, window_index, recording_index) as prev from rates)
select channel, recording_index, window_index, phase, window_start_s/60 as minutes, round(hz*1e3,6) as milli_hz, coalesce(prev <> phase, false) as boundary from l""")
def e15_time_course(spark, sf_dir):
    out = S.time_course(rates(spark, sf_dir), KEYS, 80)
    return out.select("channel", "recording_index", "window_index", "phase", "minutes", r(F.col("firing_rate_hz") * 1e3).alias("milli_hz"), "boundary")


@query(f"""with {RATES}, c as (select channel, grp, avg(hz) filter (epoch_label='Baseline') b, avg(hz) filter (epoch_label='Post') p, avg(hz) filter (epoch_label='-70nA') s from rates group by 1,2), u as (select channel, grp, 'Post' as post_condition, b, p from c union all select channel, grp, '-70nA', b, s from c)
select u.channel, u.post_condition, round(u.b*1e3,6) as baseline_hz, round(u.p*1e3,6) as post_hz, round((u.p-u.b)*1e3,6) as delta_hz, round(h2*1e3,6) as percent_reference_hz, round((u.p-h2)/nullif(h2,0)*100,6) as percent_change from u join bt on bt.channel=u.channel and bt.grp=u.grp where u.b is not null and u.p is not null""")
def e16_paired_conditions(spark, sf_dir):
    rows = S.baseline_halves(rates(spark, sf_dir), KEYS)
    out = S.paired_conditions(rows, KEYS, ["Post", "-70nA"]).drop("grp")
    return out.select(*[(r(F.col(c) * 1e3) if c.endswith("_hz") else r(c) if t == "double" else F.col(c)).alias(c) for c, t in out.dtypes])


@query(f"with {RATES} select channel, grp, part_index, round(bp,6) as baseline_percent_change, round(sp,6) as stimulation_percent_change, round(pp,6) as post_percent_change, round(ref*1e3,6) as percent_reference_hz from pt")
def e17_percent_projection(spark, sf_dir):
    out = part_table(spark, sf_dir)
    return out.select("channel", "grp", "part_index", *[r(c).alias(c) for c in ("baseline_percent_change", "stimulation_percent_change", "post_percent_change")], r(F.col("percent_reference_hz") * 1e3).alias("percent_reference_hz"))


@query(f"""with {RATES}{_PAIRED}, v as (select part_index, grp, phase, z, round(case when n > 1 and not z then t end,6) as tr, case when n > 1 and not z then t end as t, case when n > 1 then n-1e0 end as df from d where (select count(*) from long l where l.part_index=d.part_index and l.grp=d.grp and l.phase=d.phase and (hz is not null or pct is not null)) > 0),
q as (select *, case when z and df is not null then 1e0 when t is not null then {P_VALUE} end as p from v)
select part_index, grp as "group", phase, tr as t, df, round(p,8) as p_value, case when p is null then 'n/a' when p < 1e-4 then '****' when p < 1e-3 then '***' when p < 1e-2 then '**' when p < 0.05 then '*' else 'ns' end as significance from q""")
def e8_p_values(spark, sf_dir):
    """p and stars of every test; held against published values in the tests as well."""
    out = S.with_significance(S.part_summary(*tables(spark, sf_dir), GROUP))
    return out.select("part_index", "group", "phase", r("t").alias("t"), "df", r("p_value", 8).alias("p_value"), "significance")
