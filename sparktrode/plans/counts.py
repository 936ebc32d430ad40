"""Queries of windowed counts, labels and conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrode.functions import labels as L
from sparktrode.operators import statistics as S
from sparktrode.operators import windows as O

from .base import EV, RECORDING_S, WINDOW_S, query, r, spikes, table, values

KEYS = ["recording_index", "recording_name", "epoch_label", "channel", "grp"]
SETTINGS = {"fs_est_hz": 100.0, "z_thr": 5.0, "polarity": "neg", "refractory_ms": 1.0, "hp_lo_hz": 300.0, "hp_hi_hz": 5000.0}
SKIPS = [(3600.0, 30000.0), (20000.0, 40000.0), (100000.0, 100010.0)]
EPOCHS = [(1, "early", 0.0, 90000.0), (2, "middle", 80000.0, 300000.0), (3, "late", 400000.0, 600000.0), (4, "short", 21000.0, 39000.0)]

SERIES = EV + ", series as (select distinct recording_index, recording_name, epoch_label, channel, grp from fx_spikes)"
WINDOWS = SERIES + """, fx_windows as (select s.*, cast(i+1 as int) as window_index, i*21600e0 as window_start_s, (i+1)*21600e0 as window_end_s, coalesce(n,0) as spike_count
 from series s cross join (select unnest(range(24)) as i) left join (select recording_index as ri, channel as ch, cast(floor(t_s/21600e0) as int) as b, count(*) as n from fx_spikes group by 1,2,3) c
 on c.ri = s.recording_index and c.ch = s.channel and c.b = i)"""
_SKIPS = ", skips(s_start,s_end) as (values " + ",".join(f"({a},{b})" for a, b in SKIPS) + ")"
_EPOCHS = ", epochs(ord,epoch,e_start,e_end) as (values " + ",".join(f"({o},'{n}',{a},{b})" for o, n, a, b in EPOCHS) + ")"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes(spark, sf_dir).select(*KEYS).distinct()


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spike counts of every series in windows of six hours."""
    bounds = series(spark, sf_dir).withColumns({"t0": F.lit(0.0), "t1": F.lit(RECORDING_S)})
    return O.count_in_windows(spikes(spark, sf_dir), O.tumbling_folded(bounds, WINDOW_S).drop("t0", "t1"), KEYS, WINDOW_S)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes(spark, sf_dir).groupBy("recording_index", "channel").agg(F.min("t_s").alias("t0"), F.max("t_s").alias("t1"))


SPANS = EV + ", spans as (select recording_index, channel, min(t_s) t0, max(t_s) t1 from fx_spikes group by 1,2)"


@query(f"""with {SPANS}, n as (select *, cast(greatest(ceil((t1-t0)/21600e0),1) as int) n from spans)
select recording_index, channel, cast(i+1 as int) as window_index, round(t0+i*21600e0,6) as window_start_s, round(least(t0+i*21600e0+21600e0, t1+1e-12),6) as window_end_s
from n, (select unnest(range(40)) i) where i < n""")
def c1_tumbling_ceil(spark, sf_dir):
    return O.tumbling_ceil(spans(spark, sf_dir), WINDOW_S).select("recording_index", "channel", "window_index", r("window_start_s").alias("window_start_s"), r("window_end_s").alias("window_end_s"))


@query(f"""with {SPANS}, n as (select *, cast(greatest(floor((t1-t0+1e-2)/21600e0),1) as int) n from spans where t1-t0+1e-2 > 0)
select recording_index, channel, cast(i+1 as int) as window_index, round(t0+i*21600e0,6) as window_start_s,
round(case when i = n-1 then t0+(t1-t0+1e-2) else t0+(i+1)*21600e0 end,6) as window_end_s from n, (select unnest(range(40)) i) where i < n""")
def c2_tumbling_folded(spark, sf_dir):
    return O.tumbling_folded(spans(spark, sf_dir), WINDOW_S, 0.01).select("recording_index", "channel", "window_index", r("window_start_s").alias("window_start_s"), r("window_end_s").alias("window_end_s"))


@query(f"with {WINDOWS} select recording_index, channel, window_index, spike_count from fx_windows")
def c3_window_counts(spark, sf_dir):
    return windows(spark, sf_dir).select("recording_index", "channel", "window_index", "spike_count")


@query(f"""with {WINDOWS} select recording_index, recording_name, epoch_label, channel, window_index, window_start_s, window_end_s, window_end_s-window_start_s as window_duration_s,
'Min ' || cast(cast((window_index-1)*360 as int) as varchar) || '-' || cast(cast(window_index*360 as int) as varchar) as window_label, spike_count,
cast(100.0 as double) as fs_est_hz, cast(5.0 as double) as z_thr, 'neg' as polarity, cast(1.0 as double) as refractory_ms, cast(300.0 as double) as hp_lo_hz, cast(5000.0 as double) as hp_hi_hz from fx_windows""")
def c4_count_rows(spark, sf_dir):
    return O.count_rows(windows(spark, sf_dir).drop("grp"), SETTINGS)


@query(f"with {WINDOWS} select distinct recording_index, 'Min ' || ((window_index-1)*360) || '-' || (window_index*360) as window_label from fx_windows")
def p23_window_label(spark, sf_dir):
    return windows(spark, sf_dir).select("recording_index", O.window_label(F.col("window_start_s"), F.col("window_end_s")).alias("window_label")).distinct()


@query(f"""with {WINDOWS}, m(recording_name, o) as (values ('rec_1',50),('rec_2',10),('rec_3',40),('rec_4',20),('rec_5',30))
select recording_name, channel, window_index, spike_count, cast(dense_rank() over (order by o) as int) as recording_index from (select w.recording_name, channel, window_index, spike_count, o from fx_windows w join m on m.recording_name = w.recording_name)""")
def c5_recording_order(spark, sf_dir):
    order = values(spark, [(f"rec_{i}", o) for i, o in enumerate((50, 10, 40, 20, 30), 1)], "recording_name string, order_index int")
    rows = windows(spark, sf_dir).select("recording_index", "recording_name", "channel", "window_index", "spike_count")
    return O.ordered_recordings(rows, order)


@query(f"""with {SERIES}, files as (select distinct '/data/' || channel || '/' || recording_name || '.csv' as path, channel || '/' || recording_name || '.csv' as given, recording_name || '.csv' as base from series),
m(k, label) as (values ('/data/click/rec_1.csv','by path'),('view/rec_2.csv','by given'),('rec_1.csv','by base'),('rec_3.csv','by base'))
select path, given, coalesce(a.label, b.label, c.label) as epoch_label from files left join m a on a.k = path left join m b on b.k = given left join m c on c.k = base""")
def c6_epoch_lookup(spark, sf_dir):
    name = F.concat("recording_name", F.lit(".csv"))
    files = series(spark, sf_dir).select(F.concat(F.lit("/data/"), "channel", F.lit("/"), name).alias("path"), F.concat("channel", F.lit("/"), name).alias("given")).distinct()
    manifest = values(spark, [("/data/click/rec_1.csv", "by path"), ("view/rec_2.csv", "by given"), ("rec_1.csv", "by base"), ("rec_3.csv", "by base")], "key string, label string")
    return O.epoch_labels(files, manifest)


def _ranges(spark):
    return values(spark, EPOCHS, "ord int, epoch string, e_start double, e_end double"), values(spark, SKIPS, "s_start double, s_end double")


@query(f"""with {WINDOWS}{_EPOCHS} select recording_index, channel, window_index, window_start_s, window_end_s, coalesce(string_agg(epoch, '|' order by ord), '') as epoch
from fx_windows left join epochs on window_start_s < e_end and window_end_s > e_start group by 1,2,3,4,5""")
def c7_epoch_tags(spark, sf_dir):
    return O.epoch_tags(windows(spark, sf_dir), _ranges(spark)[0], ["recording_index", "channel", "window_index"])


@query(f"""with {WINDOWS}{_SKIPS} select recording_index, channel, window_index, spike_count from fx_windows w
where not exists (select 1 from skips where w.window_start_s < s_end and w.window_end_s > s_start)""")
def c8_skip_windows(spark, sf_dir):
    return O.drop_skipped(windows(spark, sf_dir), _ranges(spark)[1]).select("recording_index", "channel", "window_index", "spike_count")


@query(f"""with {SERIES}{_SKIPS}{_EPOCHS}, lost as (select epoch, sum(greatest(least(e_end,s_end)-greatest(e_start,s_start),0.0)) lost from epochs, skips group by 1),
c as (select recording_index, channel, epoch, count(*) n from fx_spikes s, epochs where t_s >= e_start and t_s < e_end and not exists (select 1 from skips where t_s >= s_start and t_s < s_end) group by 1,2,3)
select s.recording_index, s.channel, e.epoch, round(e_start/60,6) epoch_start_min, round(e_end/60,6) epoch_end_min, round((e_end-e_start-lost)/60,6) effective_duration_min, coalesce(n,0) spike_count, round(coalesce(n,0)/((e_end-e_start-lost)/60),6) spikes_per_min
from series s cross join epochs e join lost l on l.epoch = e.epoch left join c on c.recording_index = s.recording_index and c.channel = s.channel and c.epoch = e.epoch where e_end-e_start-lost > 0""")
def c9_epoch_summary(spark, sf_dir):
    e, s = _ranges(spark)
    out = O.epoch_summary(spikes(spark, sf_dir), series(spark, sf_dir), e, s, ["recording_index", "channel"])
    return out.select("recording_index", "channel", "epoch", *[r(c).alias(c) for c in ("epoch_start_min", "epoch_end_min", "effective_duration_min")], "spike_count", r("spikes_per_min").alias("spikes_per_min"))


@query(f"""with {WINDOWS}, x as (select *, row_number() over (partition by channel order by recording_index, window_index)-1 as x from fx_windows)
select channel, recording_index, cast(min(x) as int) first_x, cast(max(x) as int) last_x, min(x)-5e-1 as boundary, (min(x)+max(x))/2 as middle from x group by 1,2""")
def c10_continuous_axis(spark, sf_dir):
    return O.continuous_axis(windows(spark, sf_dir))


BLANKED = WINDOWS + """, b as (select cast(row_number() over (order by recording_index, channel, window_index) as int) as row_order, recording_name, channel, window_index, spike_count from fx_windows),
gap as (select row_order, case when row_order % 50 in (0,1) then null else recording_name end recording_name, case when row_order % 50 in (0,1) then '  ' else channel end channel, spike_count from b)"""


@query(f"""with {BLANKED}, s as (select *, recording_name is null and trim(channel) = '' as blank from gap), t as (select *, sum(blank::int) over (order by row_order) g from s)
select row_order, channel, spike_count, cast(dense_rank() over (order by g) as int) as data_set_index from t where not blank""")
def c11_data_sets(spark, sf_dir):
    line = F.row_number().over(O.W.orderBy("recording_index", "channel", "window_index"))
    gap = F.col("row_order") % 50 < 2
    rows = windows(spark, sf_dir).withColumn("row_order", line).withColumns({"recording_name": F.when(~gap, F.col("recording_name")), "channel": F.when(gap, "  ").otherwise(F.col("channel"))})
    return O.data_sets(rows, "row_order", ["recording_name", "channel"]).select("row_order", "channel", "spike_count", "data_set_index")


@query(f"with {WINDOWS} select coalesce(median(case when d > 0 then d end), 60e0) as window_s from (select case when window_index % 3 = 0 then 2*(window_end_s-window_start_s) else window_end_s-window_start_s end d from fx_windows)")
def c12_source_window(spark, sf_dir):
    d = F.col("window_end_s") - F.col("window_start_s")
    return O.source_window_s(windows(spark, sf_dir).withColumn("window_duration_s", F.when(F.col("window_index") % 3 == 0, 2 * d)))


def _holed(spark, sf_dir):
    hole = F.col("window_index") % 5 == 0
    return windows(spark, sf_dir).withColumns({"window_start_s": F.when(~hole, F.col("window_start_s"))})


@query(f"with {WINDOWS} select recording_index, channel, window_index, case when window_index % 5 = 0 then window_index*21600e0 else window_start_s end window_start_s, case when window_index % 5 = 0 then window_index*21600e0+21600e0 else window_end_s end window_end_s from fx_windows")
def c13_fill_timing(spark, sf_dir):
    return O.fill_timing(_holed(spark, sf_dir), WINDOW_S).select("recording_index", "channel", "window_index", "window_start_s", "window_end_s")


SEGMENTS = WINDOWS + """, o as (select *, cast(recording_index*1000+window_index as int) as row_order, case when window_index > 14 then epoch_label || ' b' else epoch_label end as lab from fx_windows),
ch as (select *, case when lag(lab) over (partition by channel order by row_order) is distinct from lab then 1 else 0 end c from o),
seg as (select *, sum(c) over (partition by channel order by row_order) as segment_index from ch)"""


def _segments(spark, sf_dir):
    rows = windows(spark, sf_dir).withColumns({"row_order": F.col("recording_index") * 1000 + F.col("window_index"), "epoch_label": F.when(F.col("window_index") > 14, F.concat("epoch_label", F.lit(" b"))).otherwise(F.col("epoch_label"))})
    return O.epoch_segments(rows, ["channel"], ["epoch_label"], "row_order")


@query(f"with {SEGMENTS} select channel, row_order, cast(segment_index as bigint) segment_index, min(row_order) over (partition by channel, segment_index) as segment_start_order from seg")
def c14_epoch_segments(spark, sf_dir):
    return _segments(spark, sf_dir).select("channel", "row_order", "segment_index", "segment_start_order")


@query(f"""with {SEGMENTS}, i as (select *, row_number() over (partition by channel, segment_index order by window_start_s, window_index, row_order)-1 i, count(*) over (partition by channel, segment_index) n from seg)
select channel, cast(segment_index as bigint) segment_index, cast(least(i//4, greatest(n//4-1,0)) as int) bin, arg_min(recording_index, i) recording_index, arg_min(lab, i) epoch_label, min(window_start_s) window_start_s, max(window_end_s) window_end_s, max(window_end_s)-min(window_start_s) window_duration_s, cast(sum(spike_count) as bigint) spike_count
from i group by 1,2,3""")
def c15_rebin(spark, sf_dir):
    return O.rebin(_segments(spark, sf_dir), ["channel"], WINDOW_S, 4 * WINDOW_S, ["window_start_s", "window_index", "row_order"])


@query(f"""with {WINDOWS}, x as (select *, row_number() over (partition by channel order by recording_index, window_index)-1 x from fx_windows),
b as (select channel, recording_index, epoch_label, min(x) start_x, max(x) end_x from x group by 1,2,3), f as (select *, row_number() over (partition by channel order by start_x) block from b),
g as (select *, min(block) over (partition by channel, epoch_label) fb from f)
select channel, cast(block as bigint) as block, recording_index, epoch_label, cast(start_x as int) start_x, cast(end_x as int) end_x, (start_x+end_x)/2 as middle, case when start_x > 0 then start_x-5e-1 end as boundary, cast(dense_rank() over (partition by channel order by epoch_label = 'Post', fb) as int) as legend from g""")
def c16_epoch_blocks(spark, sf_dir):
    return O.epoch_blocks(windows(spark, sf_dir), ["channel"], ["recording_index", "window_index"])


@query(f"""with {WINDOWS}, a as (select row_number() over (order by window_index) as rank, spike_count from fx_windows where recording_index=1 and channel='click'), b as (select row_number() over (order by window_index) as rank, spike_count from fx_windows where recording_index=3 and channel='click'), l as (select max(rank) n from a)
select 'A' as part, cast(rank as int) rank, cast(rank as int) as x, spike_count, n+5e-1 as boundary from a, l union all select 'B', cast(rank as int), cast(rank+n as int), spike_count, n+5e-1 from b, l""")
def c17_stitched(spark, sf_dir):
    w = windows(spark, sf_dir).filter("channel = 'click'")
    return O.stitched(w.filter("recording_index = 1"), w.filter("recording_index = 3"), "window_index")


@query(f"""with {WINDOWS}, p as (select *, case when epoch_label='Baseline' then 'Baseline' else 'Post' end as phase from fx_windows where epoch_label in ('Baseline','Post')), l as (select max(c) n from (select count(*) c from p where phase='Baseline' group by channel))
select channel, phase, recording_index, window_index, cast(row_number() over (partition by channel, phase order by recording_index, window_index)-1 + case when phase='Post' then n+1 else 0 end as bigint) as x, spike_count from p, l""")
def c18_baseline_post_axis(spark, sf_dir):
    w = windows(spark, sf_dir).withColumn("phase", L.phase(F.col("epoch_label"))).filter("phase <> 'Stimulation'")
    return O.baseline_post_axis(w)


@query(f"with {WINDOWS} select recording_index, channel, window_index, spike_count from fx_windows where case when channel = 'view' then window_index in (2, 4, 24, 99) else window_index between 3 and 9 end")
def p11_minute_selection(spark, sf_dir):
    w, keys = windows(spark, sf_dir), ["recording_index", "channel"]
    span = O.select_minutes(w.filter("channel <> 'view'"), keys, "window_start_s", (3, 9))
    return span.unionByName(O.select_minutes(w.filter("channel = 'view'"), keys, "window_start_s", [2, 4, 24, 99])).select(*keys, "window_index", "spike_count")


@query(f"with {WINDOWS} select recording_index, channel, window_index, spike_count from fx_windows where window_index < 24")
def p12_drop_last_window(spark, sf_dir):
    return O.drop_last_window(windows(spark, sf_dir), ["recording_index", "channel"]).select("recording_index", "channel", "window_index", "spike_count")


@query("select p_partkey as chan, p_name as epoch_label, p_size as spike_count, p_retailprice as window_duration_s from part")
def p13_aliases(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chan"), F.col("p_name").alias("Condition"), F.col("p_size").alias("N-Spikes"), F.col("p_retailprice").alias("Duration (s)"))
    return rows.withColumnsRenamed({k: v for k, v in L.renames(rows.columns).items() if v != "channel"})


MESSY = WINDOWS + """, messy as (select case when window_index = 2 then '  ' else ' ' || recording_name || ' ' end recording_name, case when window_index=3 then null else epoch_label end epoch_label, channel, case when window_index=4 then 'x' else cast(spike_count as varchar) end spike_count,
 window_start_s, case when window_index=5 then window_start_s when window_index=6 then window_end_s/2 else window_end_s end window_end_s, window_index from fx_windows)"""


def _messy(spark, sf_dir):
    w, i = windows(spark, sf_dir), F.col("window_index")
    return w.select(
        F.when(i == 2, "  ").otherwise(F.concat(F.lit(" "), "recording_name", F.lit(" "))).alias("recording_name"), F.when(i != 3, F.col("epoch_label")).alias("epoch_label"), "channel",
        F.when(i == 4, "x").otherwise(F.col("spike_count").cast("string")).alias("spike_count"), "window_start_s",
        F.when(i == 5, F.col("window_start_s")).when(i == 6, F.col("window_end_s") / 2).otherwise(F.col("window_end_s")).alias("window_end_s"), "window_index",
    )


@query(f"""with {MESSY} select trim(recording_name) recording_name, epoch_label, channel, try_cast(spike_count as double) spike_count, window_start_s, window_end_s, window_end_s-window_start_s window_duration_s, window_index from messy
where trim(recording_name) <> '' and epoch_label is not null and try_cast(spike_count as double) is not null and window_end_s - window_start_s > 0""")
def p14_row_cleaning(spark, sf_dir):
    return S.prepare(_messy(spark, sf_dir)).select("recording_name", "epoch_label", "channel", "spike_count", "window_start_s", "window_end_s", "window_duration_s", "window_index")


LABELS = ["Baseline", "pre-drug", "High pressure", "Post 1", "wash out", "washout", "-70nA", "  ", "nan", "After stim", "Recovery", "Before", "100 uA x", "con-trol", "60na pulse", "81nA", "H2O2  x"]
_LABELS = "labs(label) as (values " + ",".join(f"('{x}')" for x in LABELS) + "), l as (select distinct p_brand || ' ' || label as label from part, labs union select label from labs union select p_type from part)"


def _labels(spark, sf_dir):
    part, labs = table(spark, sf_dir, "part"), F.broadcast(values(spark, [(x,) for x in LABELS], "label string"))
    mixed = part.select("p_brand").distinct().crossJoin(labs).select(F.concat("p_brand", F.lit(" "), "label").alias("label"))
    return mixed.union(labs).union(part.select("p_type")).distinct()


_BARE = r"replace(trim(regexp_replace(lower(trim(label)), '[\s\-./()]+', '_', 'g'), '_'), '_', '')"


@query(f"""with {_LABELS} select label, case when trim(label)='' or lower(trim(label))='nan' then null when regexp_matches({_BARE}, 'baseline|basal|before|pre|pretreatment|control') then 'Baseline'
when regexp_matches({_BARE}, 'post|after|recovery|washout') then 'Post' else 'Stimulation' end as phase from l""")
def p15_phase(spark, sf_dir):
    return _labels(spark, sf_dir).withColumn("phase", L.phase(F.col("label")))


@query(f"""with {_LABELS} select label, coalesce(nullif(regexp_replace(regexp_replace(trim(label), '\\s+', ' ', 'g'), '(?i)([-+]?\\d+(?:\\.\\d+)?)\\s*([munp]?a)\\b', '\\1 \\2', 'g'),''),'Stimulation') as stimulation,
coalesce(nullif(regexp_replace(trim(label), '\\s+', ' ', 'g'),''),'Post') as post from l""")
def p16_label_cleanup(spark, sf_dir):
    return _labels(spark, sf_dir).select("label", L.clean_stimulation(F.col("label")).alias("stimulation"), L.clean_post(F.col("label")).alias("post"))


@query(f"""with {_LABELS} select label, case when contains(lower(label),'baseline') then 'Baseline' when contains(lower(label),'h2o2') then 'H2O2 at 0.25 Atm' when contains(lower(label),'81na') then '-80 nA' when contains(lower(label),'90na') then '-90 nA'
when contains(lower(label),'70na') then '-70 nA' when contains(lower(label),'60na') then '-60 nA' when contains(lower(label),'50na') then '-50 nA' else trim(label) end as shown from l""")
def p17_plot_label(spark, sf_dir):
    return _labels(spark, sf_dir).select("label", L.plot_label(F.col("label")).alias("shown"))


@query("""select stem, case when contains(lower(stem),'pbs') or contains(lower(stem),'vehicle') then 'PBS' when contains(lower(stem),'base') then 'Baseline' when contains(stem,'6') then 'Post(-70nA)' when contains(stem,'1') then 'Post(-1V)' else 'Unknown' end as condition, split_part(stem,'_',1) as animal
from (select distinct replace(p_brand,'#','') || case p_size % 4 when 0 then '_Base' when 1 then '_PBS' else '_x' end as stem from part)""")
def p18_file_names(spark, sf_dir):
    tail = F.when(F.col("p_size") % 4 == 0, "_Base").when(F.col("p_size") % 4 == 1, "_PBS").otherwise("_x")
    stems = table(spark, sf_dir, "part").select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), tail).alias("stem")).distinct()
    return stems.select("stem", L.condition_of_file(F.col("stem")).alias("condition"), L.animal_of_file(F.col("stem")).alias("animal"))


def tips(spark, sf_dir):
    size = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " um").otherwise(" mm"))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("tip"), F.col("p_retailprice").alias("value"))


_TIPS = "tips as (select p_partkey, p_size || case when p_size % 2 = 0 then ' um' else ' mm' end as tip, p_retailprice as value, cast(p_size * case when p_size % 2 = 0 then 1 else 1000 end as double) as um from part)"


@query(f"with {_TIPS} select p_partkey, tip, um from tips")
def p19_units(spark, sf_dir):
    return tips(spark, sf_dir).select("p_partkey", "tip", L.micrometres(F.col("tip")).alias("um"))


@query(f"with {_TIPS} select tip, um, avg_value, coalesce(sd,0) as sd_value, n from (select tip, um, round(avg(value),6) avg_value, round(stddev_samp(value),6) sd, count(*) n from tips group by 1,2)")
def a5_tip_summary(spark, sf_dir):
    return S.tip_summary(tips(spark, sf_dir), "tip", "value").select("tip", "um", r("mean").alias("avg_value"), r("sd").alias("sd_value"), "n").orderBy("um", "tip")


@query(f"""with {WINDOWS} select recording_name, channel, window_start_s, cast(row_number() over (partition by recording_name, channel order by window_start_s) as int) as window_index from fx_windows""")
def p20_window_index(spark, sf_dir):
    rows = windows(spark, sf_dir).withColumn("phase", L.phase(F.col("epoch_label"))).drop("window_index")
    return S.numbered_windows(rows, "window_start_s").select("recording_name", "channel", "window_start_s", "window_index")


@query(f"with {WINDOWS} select recording_index, channel, window_index, 'Baseline,Post' as comparisons from fx_windows where epoch_label in ('Baseline','Post')")
def p22_phase_filter(spark, sf_dir):
    w = S.keep_phases(windows(spark, sf_dir), "Pre, recovery, base")
    wanted = L.comparisons("all", "Pre, recovery, base")
    return w.select("recording_index", "channel", "window_index", F.lit(",".join(wanted)).alias("comparisons"))


ANIMALS = EV + ", an as (select user_id % 6 as animal, epoch_label as condition, channel from fx_spikes), s as (select distinct animal, condition, channel from an union select a.animal, c.condition, h.channel from (select distinct animal from an) a, (select distinct condition from an) c, (select distinct channel from an) h)"


@query(f"with {ANIMALS} select s.animal, s.condition, s.channel, count(an.animal) as spike_count from s left join an on an.animal=s.animal and an.condition=s.condition and an.channel=s.channel group by 1,2,3")
def a1_animal_counts(spark, sf_dir):
    keys = ["animal", "condition", "channel"]
    a = spikes(spark, sf_dir).select((F.col("user_id") % 6).alias("animal"), F.col("epoch_label").alias("condition"), "channel")
    return S.animal_counts(a, keys)


@query(f"""with {ANIMALS}, c as (select animal, condition, channel, count(*) n from an group by 1,2,3), o(condition, ord) as (values ('Baseline',1),('-70nA',2),('-90nA',3),('Post',4),('absent',5))
select o.condition, ord, round(avg(n),6) as mean, round(stddev_samp(n),6) as sd from c join o on o.condition = c.condition group by 1,2""")
def a2_condition_means(spark, sf_dir):
    m = S.condition_means(a1_animal_counts(spark, sf_dir).filter("spike_count > 0"), ["Baseline", "-70nA", "-90nA", "Post", "absent"])
    return m.select("condition", "ord", r("mean").alias("mean"), r("sd").alias("sd")).orderBy("ord")


CONDITIONS = EV + ", cond as (select cast(ts as date) as day, case channel when 'view' then 'PBS' when 'click' then 'Baseline' when 'purchase' then 'Post' end as condition, count(*) as n from fx_spikes where channel in ('view','click','purchase') group by 1,2), hourly as (select cast(ts as date) as day, hour(ts) as hour, case channel when 'view' then 'PBS' when 'click' then 'Baseline' when 'purchase' then 'Post' end as condition, count(*) as n from fx_spikes where channel in ('view','click','purchase') group by 1,2,3)"


CONDITION_OF = {"view": "PBS", "click": "Baseline", "purchase": "Post"}


def conditions(spark, sf_dir):
    """A row for each hour, condition and day, so that a session repeats its conditions."""
    name = F.coalesce(*[F.when(F.col("channel") == k, v) for k, v in CONDITION_OF.items()])
    rows = spikes(spark, sf_dir).select(F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hour"), name.alias("condition")).filter("condition is not null")
    return rows.groupBy("day", "hour", "condition").agg(F.count(F.lit(1)).alias("count"))


def daily(spark, sf_dir):
    return conditions(spark, sf_dir).groupBy("day", "condition").agg(F.sum("count").alias("count"))


@query(f"""with {CONDITIONS}, p as (select day, arg_max(n, hour) filter (condition='Baseline') as "Baseline", arg_max(n, hour) filter (condition='PBS') as "PBS", arg_max(n, hour) filter (condition='Post') as "Post" from hourly group by 1)
select * from p where "Baseline" is not null and "PBS" is not null and "Post" is not null""")
def a3_condition_pivot(spark, sf_dir):
    return S.condition_pivot(conditions(spark, sf_dir), "day", ["Baseline", "PBS", "Post"], "hour")


@query(f"""with {CONDITIONS}, b as (select day, n as base from cond where condition='Baseline') select cond.day, condition, round(100e0*n/nullif(base,0),6) as pct from cond left join b on b.day = cond.day""")
def a4_percent_of_baseline(spark, sf_dir):
    return S.percent_of_baseline(daily(spark, sf_dir), "day").select("day", "condition", r("pct").alias("pct"))
