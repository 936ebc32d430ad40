"""Queries of spike detection and spike trains."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktrode.operators import samples as P
from sparktrode.operators import spikes as K
from sparktrode.operators.filtering import zero_phase_design

from . import dsp_sql as Q
from .base import EV, query, r, signal, signal_sql, spikes
from .signals import ZA

#: Samples in a block: a group of rows in Python costs milliseconds, however few they are.
B = BLOCK = 1 << 14
FS = 20000.0
PEAKS = ZA + ", " + Q.peaks("pk", "zz", "abs(z)", 1.2)


def fast(spark, sf_dir):
    return signal(spark, sf_dir, FS)


def found(spark, sf_dir):
    x = fast(spark, sf_dir)
    return K.peaks(P.robust_z(x), 1.2, ends=K.series_ends(x), block=B)


@query(f"with {PEAKS} select recording_index, channel, n, height from pk")
def k1_peaks(spark, sf_dir):
    return found(spark, sf_dir)


@query(f"with recursive {PEAKS}, {Q.suppress('kept', 'pk', 5)} select recording_index, channel, n, height from kept")
def k2_suppress(spark, sf_dir):
    return K.suppress(found(spark, sf_dir), 5, B)


@query(f"with recursive {PEAKS}, {Q.refractory('kept', 'pk', 5)} select recording_index, channel, n, height from kept")
def k3_refractory(spark, sf_dir):
    return K.refractory(found(spark, sf_dir), 5, B)


@query(f"""with {PEAKS}, mx as (select recording_index, channel, max(n) last from fx_signal group by 1,2), o as (select pk.*, least(pk.n+12, last) stop from pk join mx using (recording_index, channel)),
s as (select o.recording_index, o.channel, o.n, o.height, f.n - o.n as k, f.x_uv from o join fx_signal f on f.recording_index=o.recording_index and f.channel=o.channel and f.n >= o.n and f.n < o.stop where o.stop > o.n+1),
w as (select recording_index, channel, n, height, first(k order by x_uv desc, k) as width from s group by 1,2,3,4) select recording_index, channel, n, height, width from w where width > 0 and width <= 8""")
def k4_opposite_width(spark, sf_dir):
    return K.opposite_width(found(spark, sf_dir), fast(spark, sf_dir), 12, "neg", 0, 8)


@query(f"with {PEAKS}, {Q.half_widths('hw', 'pk', 'fx_signal')} select recording_index, channel, n, round(width,6) as width from hw")
def k5_half_prominence_width(spark, sf_dir):
    out = K.half_prominence_width(found(spark, sf_dir), fast(spark, sf_dir), B)
    return out.select("recording_index", "channel", "n", r("width").alias("width"))


@query(f"with {PEAKS} select pk.recording_index, pk.channel, pk.n, height, x_uv as amp_uv from pk join fx_signal f on f.recording_index=pk.recording_index and f.channel=pk.channel and f.n=pk.n where abs(x_uv) >= 40 and abs(x_uv) <= 100")
def k6_amplitude_gate(spark, sf_dir):
    at = found(spark, sf_dir).join(fast(spark, sf_dir).select("recording_index", "channel", "n", "x_uv"), ["recording_index", "channel", "n"])
    return K.amplitude_gate(at, F.col("x_uv"), 40.0, 100.0).drop("x_uv")


WAVES = PEAKS + """, mx as (select recording_index, channel, max(n) n1 from fx_signal group by 1,2), wv as (select pk.recording_index, pk.channel, pk.n, f.n - pk.n + 12 as k, f.x_uv from pk join mx using (recording_index, channel) join fx_signal f on f.recording_index=pk.recording_index and f.channel=pk.channel and f.n >= pk.n-12 and f.n < pk.n+20 where pk.n >= 12 and pk.n+20 <= n1)"""


@query(f"with {WAVES} select recording_index, channel, n, cast(k as int) as k, x_uv from wv")
def k7_waveforms(spark, sf_dir):
    w = K.waveforms(found(spark, sf_dir), fast(spark, sf_dir), 12, 20)
    return w.select("recording_index", "channel", "n", F.posexplode("wave").alias("k", "x_uv"))


@query(f"with {WAVES} select recording_index, channel, cast(k as int) as k, round(avg(x_uv),6) as mean_uv, round(stddev_pop(x_uv)/sqrt(count(*)),6) as sem_uv, count(*) as n_spikes from wv group by 1,2,3")
def k8_mean_waveform(spark, sf_dir):
    m = K.mean_waveform(K.waveforms(found(spark, sf_dir), fast(spark, sf_dir), 12, 20))
    return m.select("recording_index", "channel", "k", r("mean_uv").alias("mean_uv"), r("sem_uv").alias("sem_uv"), "n_spikes")


@query(f"""with {PEAKS}, mx as (select recording_index, channel, max(n) n1 from fx_signal group by 1,2), w as (select pk.recording_index, pk.channel, f.n-pk.n as k, f.x_uv from pk join mx using (recording_index, channel) join fx_signal f on f.recording_index=pk.recording_index and f.channel=pk.channel and f.n >= pk.n-15 and f.n < pk.n+15 where pk.n >= 15 and pk.n+15 <= n1)
select recording_index, channel, round(k/20e3,6) as t_rel_s, round(avg(x_uv),6) as lfp_sta_uv, count(*) as n_used from w group by recording_index, channel, k""")
def k9_triggered_average(spark, sf_dir):
    t = K.triggered_average(found(spark, sf_dir), fast(spark, sf_dir), 15, FS)
    return t.select("recording_index", "channel", r("t_rel_s").alias("t_rel_s"), r("lfp_sta_uv").alias("lfp_sta_uv"), "n_used")


@query(f"""with recursive {PEAKS}, {Q.suppress('kept', 'pk', 5)}, mx as (select recording_index, channel, max(n) n1 from fx_signal group by 1,2),
w as (select k.recording_index, k.channel, k.n, k.height, min(x_uv) lo, max(x_uv) hi from kept k join mx using (recording_index, channel) join fx_signal f on f.recording_index=k.recording_index and f.channel=k.channel and f.n >= k.n-12 and f.n < k.n+20 where k.n >= 12 and k.n+20 <= n1 group by 1,2,3,4),
a as (select recording_index, channel, n, height, case when abs(lo) > abs(hi) then lo else hi end as amp_uv from w) select * from a where abs(amp_uv) between 40 and 700""")
def k11_detect_abs(spark, sf_dir):
    return K.detect_abs(fast(spark, sf_dir), FS, 1.2, 0.25, 12, 20, 40.0, 700.0).drop("wave")


_BAND_B, _PAD_B = zero_phase_design((300.0, 5000.0), FS, 3, "B")
_BAND_A, _PAD_A = zero_phase_design((300.0, 3000.0), FS, 4, "A")


@query(f"""with recursive {signal_sql(FS)}, {Q.zero_phase('fl', 'fx_signal', _BAND_B, _PAD_B)}, {Q.robust_z('zf', 'fl', 'x_uv', 'B')}, {Q.peaks('pp', 'zf', 'z', 1.0)}, {Q.peaks('pn', 'zf', '-z', 1.0)}, {Q.suppress('sp', 'pp', 5)}, {Q.suppress('sn', 'pn', 5)},
bo as materialized (select recording_index, channel, n, max(height) as height from (select * from sp union all select * from sn) group by 1,2,3), {Q.refractory('kept', 'bo', 5)}, o as (select k.*, least(k.n+10, c-1) stop from kept k join fl_s using (recording_index, channel)),
s as (select o.recording_index, o.channel, o.n, o.height, f.n-o.n as k, f.x_uv, first(f.x_uv) over (partition by o.recording_index, o.channel, o.n order by f.n) as x0 from o join fl f on f.recording_index=o.recording_index and f.channel=o.channel and f.n >= o.n and f.n < o.stop where o.stop > o.n+1),
w as (select recording_index, channel, n, height, x0, case when x0 < 0 then first(k order by x_uv desc, k) else first(k order by x_uv, k) end as width from s group by 1,2,3,4,5)
select recording_index, channel, n, round(height,6) as height, cast(width as int) as width, round(x0,6) as amp_uv from w where width > 0 and width <= 10 and abs(x0) between 10 and 700""")
def k12_detect_polarity(spark, sf_dir):
    out = K.detect_polarity(fast(spark, sf_dir), FS, 1.0, 0.25, "both", 10.0, 700.0, (0, 10), block=BLOCK)
    return out.select("recording_index", "channel", "n", r("height").alias("height"), F.col("width").cast("int").alias("width"), r("amp_uv").alias("amp_uv"))


@query(f"""with recursive {signal_sql(FS)}, {Q.zero_phase('fl', 'fx_signal', _BAND_A, _PAD_A)}, {Q.robust_z('zf', 'fl', 'abs(x_uv)', 'A')}, {Q.peaks('pp', 'zf', 'z', 1.0)}, {Q.suppress('kept', 'pp', 5)},
g as materialized (select k.*, f.x_uv as amp_uv from kept k join fl f on f.recording_index=k.recording_index and f.channel=k.channel and f.n=k.n where abs(f.x_uv) between 10 and 700), {Q.half_widths('hw', 'g', 'fl')}
select recording_index, channel, n, round(height,6) as height, round(amp_uv,6) as amp_uv, round(width/20e0,6) as width_ms from g join hw using (recording_index, channel, n) where width/20e3*1000 between 0.01e0 and 2e0""")
def k13_detect_neuropil(spark, sf_dir):
    out = K.detect_neuropil(fast(spark, sf_dir), FS, 1.0, 0.25, "both", 10.0, 700.0, (0.01, 2.0), block=BLOCK)
    return out.select("recording_index", "channel", "n", r("height").alias("height"), r("amp_uv").alias("amp_uv"), r("width_ms").alias("width_ms"))


@query(f"with {signal_sql(1500.0)}, d as (select recording_index, channel || case when channel = 'view' then '_spike' else '' end as channel, t_s - lag(t_s) over (partition by recording_index, channel order by n) dt from fx_signal) select recording_index, channel, round(1/median(dt),3) as fs_hz, round(1/median(dt),3) < 2000 as under_resolved, not ends_with(channel, '_spike') as band_pass from d where dt is not null group by 1,2")
def k14_resolution(spark, sf_dir):
    rates = P.sampling_rate(signal(spark, sf_dir, 1500.0)).withColumn("fs_hz", r("fs_hz", 3))
    return K.resolution_flags(rates.withColumn("channel", F.when(F.col("channel") == "view", "view_spike").otherwise(F.col("channel"))))


def trains(spark, sf_dir):
    return spikes(spark, sf_dir)


@query(f"with {EV}, s as (select recording_index, channel, min(t_s) t0, cast(floor((max(t_s)-min(t_s))/3600e0) as int) l from fx_spikes group by 1,2), c as (select f.recording_index, f.channel, cast(floor((t_s-t0)/3600e0) as int) b, count(*) c from fx_spikes f join s using (recording_index, channel) group by 1,2,3) select s.recording_index, s.channel, round(t0+(i+5e-1)*3600e0,6) as t_s, coalesce(c,0)/3600e0*1e3 as milli_hz from s join (select unnest(range(200)) i) on i <= l left join c on c.recording_index=s.recording_index and c.channel=s.channel and c.b=i")
def k15_firing_rate(spark, sf_dir):
    out = K.firing_rate(trains(spark, sf_dir), 3600.0)
    return out.select("recording_index", "channel", r("t_s").alias("t_s"), (F.col("rate_hz") * 1e3).alias("milli_hz"))


ISI = EV + ", isi as (select recording_index, channel, event_id, (t_s - lag(t_s) over (partition by recording_index, channel order by t_s, event_id))*1000 as isi_ms from fx_spikes), i as (select * from isi where isi_ms is not null)"


@query(f"with {ISI} select recording_index, channel, event_id, round(isi_ms,3) as isi_ms from i")
def k16_intervals(spark, sf_dir):
    return K.intervals(trains(spark, sf_dir)).select("recording_index", "channel", "event_id", r("isi_ms", 3).alias("isi_ms"))


@query(f"""with {ISI}, e as (select recording_index, channel, greatest(50e0, quantile_cont(isi_ms, 0.99)) hi from i group by 1,2), c as (select i.recording_index, i.channel, cast(least(floor(isi_ms/(hi/59)),58) as int) b, count(*) c from i join e using (recording_index, channel) where isi_ms <= hi group by 1,2,3)
select e.recording_index, e.channel, cast(k as int) as bin, round(k*(hi/59),3) as left_ms, round((k+1)*(hi/59),3) as right_ms, coalesce(c,0) as count from e cross join (select unnest(range(59)) k) left join c on c.recording_index=e.recording_index and c.channel=e.channel and c.b=k""")
def k17_interval_histogram(spark, sf_dir):
    h = K.interval_histogram(K.intervals(trains(spark, sf_dir)))
    return h.select("recording_index", "channel", "bin", r("left_ms", 3).alias("left_ms"), r("right_ms", 3).alias("right_ms"), "count")


@query(f"""with {ISI}, e as (select recording_index, channel, log10(greatest(5e-1, min(isi_ms))) lo, log10(greatest(1e3, max(isi_ms))) hi from i group by 1,2), c as (select i.recording_index, i.channel, cast(least(floor((log10(isi_ms)-lo)/((hi-lo)/59)),58) as int) b, count(*) c from i join e using (recording_index, channel) where isi_ms > 0 and log10(isi_ms) between lo and hi group by 1,2,3)
select e.recording_index, e.channel, cast(k as int) as bin, coalesce(c,0) as count from e cross join (select unnest(range(59)) k) left join c on c.recording_index=e.recording_index and c.channel=e.channel and c.b=k""")
def k18_log_histogram(spark, sf_dir):
    return K.interval_histogram(K.intervals(trains(spark, sf_dir)), log=True).select("recording_index", "channel", "bin", "count")


@query(f"""with {EV}, t as (select recording_index, channel, min(t_s) t0, cast(floor((max(t_s)-min(t_s))/6e2)+1 as int) bins, count(*) k from fx_spikes group by 1,2 having count(*) > 1), g as (select recording_index, channel, t0, bins, k, b from t, (select unnest(range(900)) b) where b < bins),
c as (select g.recording_index, g.channel, g.b, g.bins, g.k, count(f.event_id) - g.k/g.bins as c from g left join fx_spikes f on f.recording_index=g.recording_index and f.channel=g.channel and floor((f.t_s-g.t0)/6e2)=g.b group by 1,2,3,4,5),
p as (select a.recording_index, a.channel, x.b - a.b as lag, sum(a.c*x.c) s from c a join c x on a.recording_index=x.recording_index and a.channel=x.channel and x.b between a.b and a.b+8 group by 1,2,3)
select recording_index, channel, lag*6e2 as lag_s, round(s,6) as acg from p union all select recording_index, channel, -lag*6e2, round(s,6) from p where lag > 0""")
def k19_train_autocorrelogram(spark, sf_dir):
    a = K.train_autocorrelogram(trains(spark, sf_dir), 600.0, 8)
    return a.select("recording_index", "channel", "lag_s", r("acg").alias("acg"))


@query(f"with {EV} select recording_index, channel, t_s from fx_spikes")
def k20_raster(spark, sf_dir):
    return K.raster(trains(spark, sf_dir))
