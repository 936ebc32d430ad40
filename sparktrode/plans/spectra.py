"""Queries of filters and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktrode.functions import filters as C
from sparktrode.operators import filtering as Fl
from sparktrode.operators import spectral as S
from sparktrode.operators import spikes as K

from . import dsp_sql as Q
from .base import query, r, signal, signal_sql, values
from .trains import BLOCK, FS, PEAKS, fast, found

FS_HZ = 100.0
BANDS = [("delta", 1.0, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 20.0), ("none", 60.0, 70.0)]
_BANDS = ", bands(band, lo, hi) as (values " + ",".join(f"('{n}', cast({a} as double), cast({b} as double))" for n, a, b in BANDS) + ")"
#: Segments of 200 samples by 100; of a shorter series all samples are one.
PSD = signal_sql() + """, sz as (select recording_index, channel, count(*) size, least(count(*), 200) len, case when count(*) < 200 then count(*) else 100 end step from fx_signal group by 1,2), sg as (select *, i*step as n0 from sz, (select unnest(range(2000)) i) where i*step+len <= size),
ss as materialized (select {recording_index: g.recording_index, channel: g.channel, i: i} as seg, len, f.n-n0 as j, x_uv as x from sg g join fx_signal f on f.recording_index=g.recording_index and f.channel=g.channel and f.n >= n0 and f.n < n0+len),
""" + Q.spectra("sp", "ss", FS_HZ) + """, psd as (select *, 10*log10(pxx+1e-20) as pxx_db from (select seg.recording_index as recording_index, seg.channel as channel, f_hz, avg(pxx) pxx from sp where f_hz <= 45 group by all))"""


def psd(spark, sf_dir):
    return S.welch(signal(spark, sf_dir), FS_HZ, 45.0)


@query(f"with {PSD} select recording_index, channel, round(f_hz,6) as f_hz, round(pxx,6) as pxx from psd")
def w1_welch(spark, sf_dir):
    return psd(spark, sf_dir).select("recording_index", "channel", r("f_hz").alias("f_hz"), r("pxx").alias("pxx"))


@query(f"""with {PSD}{_BANDS}, a as (select recording_index, channel, band, coalesce((f_hz-lag(f_hz) over w)*(pxx+lag(pxx) over w)/2,0) area from psd join bands on f_hz >= lo and f_hz < hi window w as (partition by recording_index, channel, band order by f_hz)),
s as (select recording_index, channel, band, sum(area) p from a group by 1,2,3) select k.recording_index, k.channel, b.band, round(p,6) as power from (select distinct recording_index, channel from psd) k cross join bands b left join s on s.recording_index=k.recording_index and s.channel=k.channel and s.band=b.band""")
def w2_band_power(spark, sf_dir):
    return S.band_power(psd(spark, sf_dir), BANDS).select("recording_index", "channel", "band", r("power").alias("power"))


@query(f"""with {signal_sql()}{_BANDS}, sz as (select recording_index, channel, count(*) size from fx_signal group by 1,2), sg as (select *, i*100 as n0 from sz, (select unnest(range(2000)) i) where i*100+300 <= size),
ss as materialized (select {{recording_index: g.recording_index, channel: g.channel, n0: n0, k: q}} as seg, 100 as len, f.n-n0-50*q as j, x_uv as x from sg g, (select unnest(range(5)) q) join fx_signal f on f.recording_index=g.recording_index and f.channel=g.channel and f.n >= n0+50*q and f.n < n0+50*q+100),
{Q.spectra('sp', 'ss', FS_HZ)}, m as (select seg.recording_index as recording_index, seg.channel as channel, seg.n0 as n0, f_hz, avg(pxx) p from sp group by all),
a as (select m.*, band, (f_hz-lag(f_hz) over w)*(p+lag(p) over w)/2 area from m join bands on f_hz >= lo and f_hz < hi where band <> 'none' window w as (partition by recording_index, channel, n0, band order by f_hz))
select recording_index, channel, (n0+150)/1e2 as t_s, band, round(sum(area),6) as power from a group by recording_index, channel, n0, band""")
def w3_sliding_band_power(spark, sf_dir):
    out = S.sliding_band_power(signal(spark, sf_dir), FS_HZ, BANDS[:4], 3.0, 1.0, 1.0)
    return out.select("recording_index", "channel", "t_s", "band", r("power").alias("power"))


@query(f"""with {signal_sql()}, sz as (select recording_index, channel, count(*) size, least(count(*), 200) len, case when count(*) < 200 then count(*) else 50 end step from fx_signal group by 1,2), sg as (select *, i*step as n0 from sz, (select unnest(range(2000)) i) where i*step+len <= size),
ss as materialized (select {{recording_index: g.recording_index, channel: g.channel, n0: n0}} as seg, len, f.n-n0 as j, x_uv as x from sg g join fx_signal f on f.recording_index=g.recording_index and f.channel=g.channel and f.n >= n0 and f.n < n0+len),
{Q.spectra('sp', 'ss', FS_HZ)} select seg.recording_index as recording_index, seg.channel as channel, round((seg.n0+len/2)/1e2,6) as t_s, round(f_hz,6) as f_hz, round(10*log10(pxx+1e-20),6) as db from sp where f_hz <= 45""")
def w4_spectrogram(spark, sf_dir):
    return S.spectrogram(signal(spark, sf_dir), FS_HZ, 45.0).select("recording_index", "channel", r("t_s").alias("t_s"), r("f_hz").alias("f_hz"), r("db").alias("db"))


@query(f"""with {PSD}, cut as (select * from psd where recording_index <> 2 or (f_hz * 2) % 3 = 0), ct as (select recording_index, channel, count(*) c from cut group by 1,2), best as (select channel, first(recording_index order by c, recording_index) as of from ct group by 1),
lead as (select *, lead(f_hz) over w f2, lead(pxx_db) over w p2 from cut window w as (partition by recording_index, channel order by f_hz)), g as (select cut.channel, f_hz as g from cut join best on best.channel=cut.channel and of=recording_index)
select recording_index, lead.channel, round(g,6) as f_hz, round(case when f2 is null then pxx_db else pxx_db+(p2-pxx_db)*(g-f_hz)/(f2-f_hz) end,6) as pxx_db from lead join g on g.channel=lead.channel where g >= f_hz and (f2 is null or g < f2)""")
def w5_overlay(spark, sf_dir):
    cut = psd(spark, sf_dir).filter((F.col("recording_index") != 2) | (F.col("f_hz") * 2 % 3 == 0))
    return S.overlay(cut).select("recording_index", "channel", r("f_hz").alias("f_hz"), r("pxx_db").alias("pxx_db"))


@query(f"with {PSD} select coalesce(channel,'all') as channel, round(min(pxx_db),6) as lo_db, round(max(pxx_db),6) as hi_db from psd group by rollup (channel)")
def w6_db_range(spark, sf_dir):
    return S.db_range(psd(spark, sf_dir)).select("channel", r("lo_db").alias("lo_db"), r("hi_db").alias("hi_db"))


_SECTIONS, _PAD = Fl.zero_phase_design((5.0, 20.0), FS_HZ, 4, "A")


@query(f"with recursive {signal_sql()}, {Q.zero_phase('fl', 'fx_signal', _SECTIONS, _PAD)} select recording_index, channel, n, round(x_uv,6) as x_uv from fl")
def f2_zero_phase(spark, sf_dir):
    out = Fl.zero_phase(signal(spark, sf_dir), (5.0, 20.0), FS_HZ, 4, "A", BLOCK)
    return out.select("recording_index", "channel", "n", r("x_uv").alias("x_uv"))


_META = [(1, 200.0, 60, 1), (2, 200.0, 50, 2), (3, 200.0, 60, 3), (4, 200.0, 0, 1), (5, 200.0, 60, 2)]
_NOTCH = ", ".join(f"({k}, {', '.join(f'cast({float(c)!r} as double)' for c in C.notch(fs, hz)[0])})" for k, fs, hz, version in _META if hz and version < 3)


@query(f"""with recursive {signal_sql()}, co(recording_index, b0, b1, b2, a1, a2) as (values {_NOTCH}), d as materialized (select recording_index, channel, n, x_uv as x, lag(x_uv) over w xp, lag(x_uv, 2) over w xq, b0, b1, b2, a1, a2 from fx_signal join co using (recording_index) window w as (partition by recording_index, channel order by n)),
rec(recording_index, channel, n, y, yp) as (select recording_index, channel, n, x, cast(0 as double) from d where n = 0 union all select d.recording_index, d.channel, d.n, case when d.n < 2 then x else b0*x + b1*xp + b2*xq - a1*r.y - a2*r.yp end, r.y from rec r join d on d.recording_index=r.recording_index and d.channel=r.channel and d.n = r.n+1)
select recording_index, channel, n, round(y,6) as x_uv from rec union all select recording_index, channel, n, round(x_uv,6) from fx_signal where recording_index not in (select recording_index from co)""")
def f3_notch(spark, sf_dir):
    meta = values(spark, _META, "recording_index int, fs_hz double, notch_hz int, version_major int")
    return Fl.notch_filter(signal(spark, sf_dir), meta, block=BLOCK).select("recording_index", "channel", "n", r("x_uv").alias("x_uv"))


_TUKEY = "case when j <= 24 then 0.5e0*(1+cos(pi()*(j/24e0-1))) when j >= 72 then 0.5e0*(1+cos(pi()*((96-j)/24e0-1))) else 1e0 end"


@query(f"""with {PEAKS}, mx as (select recording_index, channel, max(n) n1 from fx_signal group by 1,2), ss as materialized (select {{recording_index: pk.recording_index, channel: pk.channel, n: pk.n}} as seg, 96 as len, f.n-pk.n+48 as j, f.x_uv as x
 from pk join mx using (recording_index, channel) join fx_signal f on f.recording_index=pk.recording_index and f.channel=pk.channel and f.n >= pk.n-48 and f.n < pk.n+48 where pk.n >= 48 and pk.n+48 <= n1), {Q.spectra('sp', 'ss', FS, _TUKEY)}
select seg.recording_index as recording_index, seg.channel as channel, 0e0 as t_s, round(f_hz,6) as f_hz, round(avg(10*log10(pxx+1e-20)),6) as db from sp where f_hz <= 5000 group by seg.recording_index, seg.channel, f_hz""")
def k10_triggered_spectrogram(spark, sf_dir):
    waves = K.waveforms(found(spark, sf_dir).select("recording_index", "channel", "n"), fast(spark, sf_dir), 48, 48)
    return S.triggered_spectrogram(waves, FS, 5000.0).select("recording_index", "channel", "t_s", r("f_hz").alias("f_hz"), r("db").alias("db"))
