"""Queries of sources and sinks: files are derived from the tables and read back."""

from __future__ import annotations

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from sparktrode.operators import decode as D
from sparktrode.operators import statistics as S
from sparktrode.sources import intan, tables

from .base import RAW, query, r, ranges, raw_words, signal, signal_sql, spikes
from .counts import KEYS as SERIES_KEYS
from .counts import WINDOWS, windows
from .stats import GROUP, KEYS, RATES, rates
from .stats import tables as stat_tables

CHANNELS_RHD = [(0, "A-000"), (0, "A-001"), (1, "AUX1"), (2, "VDD"), (3, "ADC-00"), (4, "DIN-00"), (5, "DOUT-00")]
CHANNELS_RHS = [(0, "A-000"), (0, "A-001"), (3, "ADC-00"), (4, "DAC-00"), (5, "DIN-00"), (6, "DOUT-00")]


#: Samples in a file: a long recording is many files, so a task never holds all of it.
FILE_SAMPLES = 4096


def words_of_files(spark, sf_dir):
    """The raw words with their file; whole files, in tasks of as many rows at any size."""
    name = F.format_string("rec-%d-%05d", "recording", F.floor(F.col("n") / FILE_SAMPLES))
    parts = max(ranges(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return raw_words(spark, sf_dir).withColumn("file", name).repartition(parts, "file")


def write_files(spark, sf_dir, variant: str, most: int | None = None) -> str:
    """Recording files of the raw words, each of one range of a recording, written by the executors."""
    folder = tables.shared_folder(spark, variant)
    store, at = pafs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)

    def write(pdf):
        name = pdf["file"].iloc[0]
        pdf = pdf.sort_values("n").head(most) if most is not None else pdf.sort_values("n")
        w, t = pdf["word"].to_numpy(), pdf["tick"].to_numpy()
        n = len(w)
        two = np.stack([w, (w + 1) % 65536])
        one = {k: w[None, :] for k in ("adc", "dac", "din", "dout")}
        words = {"amplifier": two, "dc": two, "stim": two, "aux": w[None, : n // 4], "supply": w[None, :n], "temp": w[None, :n]} | one
        data = intan.write_recording(CHANNELS_RHS if variant == "rhs" else CHANNELS_RHD, words, t, variant=variant, dc=True, temps=1, board=13, notch_mode=2, notes=("one", "", "zwei"))
        files, where = pafs.FileSystem.from_uri(folder)
        with files.open_output_stream(f"{where}/{name}.{variant}") as out:
            out.write(data)
        return pdf[["file"]].head(1).assign(bytes=len(data))

    words_of_files(spark, sf_dir).groupBy("file").applyInPandas(write, "file string, bytes long").count()
    return folder


def read_files(spark, folder, **options):
    intan.register(spark)
    reader = spark.read.format("recording").option("path", folder)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


_FILES = RAW + f", fx_file as (select 'rec-' || recording || '-' || lpad(cast(n//{FILE_SAMPLES} as varchar), 5, '0') as rec, n % {FILE_SAMPLES} as n, tick, word from fx_raw), c as (select rec, count(*)//128 as blocks from fx_file group by 1)"
_WHOLE = _FILES + ", w as (select fx_file.* from fx_file join c using (rec) where n < blocks*128)"


@query(f"with {_WHOLE} select rec as recording, 'A-000' as channel, n, tick, round((word-32768)*0.195e0,6) as uv from w union all select rec, 'A-001', n, tick, round(((word+1)%65536-32768)*0.195e0,6) from w")
def s3_rhd_ingest(spark, sf_dir):
    s = read_files(spark, write_files(spark, sf_dir, "rhd"))
    return s.select("recording", "channel", "n", "tick", r(D.amplifier_uv(F.col("raw"))).alias("uv"))


@query(f"with {_WHOLE} select rec as recording, 'A-000' as channel, n, tick, (word&255)*case when ((word>>8)&1)=1 then -1 else 1 end as stim from w union all select rec, 'A-001', n, tick, (((word+1)%65536)&255)*case when ((((word+1)%65536)>>8)&1)=1 then -1 else 1 end from w")
def s4_rhs_ingest(spark, sf_dir):
    s = read_files(spark, write_files(spark, sf_dir, "rhs"), signal="stim")
    return s.select("recording", "channel", "n", "tick", D.stim_parts(F.col("raw"))["stim"].alias("stim"))


@query(f"with {_FILES} select rec as recording, 'rhs' as variant, '2.0' as version, cast(30000 as double) as fs_hz, 60 as notch_hz, blocks, 'one||zwei' as notes, 'REF' as reference_channel, 13 as board_mode, true as dc_saved from c")
def s5_metadata(spark, sf_dir):
    m = read_files(spark, write_files(spark, sf_dir, "rhs"), table="metadata")
    return m.select("recording", "variant", "version", "fs_hz", "notch_hz", "blocks", F.array_join("notes", "|").alias("notes"), "reference_channel", "board_mode", "dc_saved")


_KINDS = ",".join(f"('{n}',{k},'{intan.RHD_TYPES[k]}')" for k, n in CHANNELS_RHD)


@query(f"with {_FILES}, k(native_name, signal_type, signal) as (values {_KINDS}) select rec as recording, native_name, signal_type, signal from c, k")
def s6_channel_types(spark, sf_dir):
    c = read_files(spark, write_files(spark, sf_dir, "rhd"), table="channels").filter("enabled")
    return c.select("recording", "native_name", "signal_type", "signal")


@query(f"with {_FILES} select rec as recording, 0 as blocks, 0 as samples from c")
def s7_header_only(spark, sf_dir):
    """Files without data blocks have metadata and no samples."""
    folder = write_files(spark, sf_dir, "rhd", 0)
    counts = read_files(spark, folder).groupBy("recording").agg(F.count(F.lit(1)).alias("k"))
    m = read_files(spark, folder, table="metadata").join(counts, "recording", "left")
    return m.select("recording", F.col("blocks").cast("int").alias("blocks"), F.coalesce("k", F.lit(0)).cast("int").alias("samples"))


@query(f"with {signal_sql()} select recording_index, n, t_s as time_s, max(x_uv) filter (channel='click') as click, max(x_uv) filter (channel='error') as error, max(x_uv) filter (channel='purchase') as purchase, max(x_uv) filter (channel='signup') as signup, max(x_uv) filter (channel='view') as view from fx_signal group by 1,2,3")
def s8_wide_sink(spark, sf_dir):
    folder = tables.shared_folder(spark, "wide")
    names = [x["channel"] for x in signal(spark, sf_dir).select("channel").distinct().collect()]
    tables.write_wide(signal(spark, sf_dir), folder, names)
    w = tables.read_wide(spark, folder)
    return w.select(F.substring_index("recording_name", "_", -1).cast("int").alias("recording_index"), F.col("n").cast("long").alias("n"), "time_s", *sorted(names))


@query(f"with {signal_sql(holes=True)} select recording_name, n, t_s as time_s, channel, x_uv from fx_signal where not (recording_index = 2 and channel = 'view')")
def s9_wide_to_long(spark, sf_dir):
    """Missing samples stay; a channel that a recording lacks gives no rows in it."""
    folder = tables.shared_folder(spark, "wide")
    s = signal(spark, sf_dir, holes=True).filter("recording_index <> 2 or channel <> 'view'")
    names = [x["channel"] for x in s.select("channel").distinct().collect()]
    tables.write_wide(s, folder, names)
    ends = s.groupBy("recording_name", "channel").agg(F.max("n").alias("last"))  # channels of a recording differ in length
    long = tables.to_long(tables.read_wide(spark, folder), ["recording_name", "n", "time_s"])
    long = long.join(ends, ["recording_name", "channel"]).filter("n <= last")
    return long.select("recording_name", F.col("n").cast("long").alias("n"), "time_s", "channel", "x_uv")


@query(f"with {signal_sql()} select recording_name, count(*) as rows_read, count(distinct n) as samples from fx_signal group by 1")
def s1_recording_scan(spark, sf_dir):
    """One file a recording is written; the name comes from the file's path."""
    folder = tables.shared_folder(spark, "scan")
    signal(spark, sf_dir).select("recording_name", "channel", "n", "x_uv").repartition("recording_name").write.partitionBy("recording_name").option("header", True).csv(folder)
    files = spark.read.option("header", True).option("recursiveFileLookup", True).csv(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"recording_name=([^/]+)/", 1)
    return files.select(name.alias("recording_name"), "n").groupBy("recording_name").agg(F.count(F.lit(1)).alias("rows_read"), F.countDistinct("n").alias("samples"))


@query(f"with {WINDOWS} select recording_name, channel, window_index, cast(spike_count as varchar) as spike_count, case when recording_index % 2 = 1 then epoch_label end as epoch_label from fx_windows")
def s2_tolerant_load(spark, sf_dir):
    """Files of three delimiters, some without a column, are written and read as one table."""
    folder = tables.shared_folder(spark, "tolerant")
    w = windows(spark, sf_dir).select("recording_index", "recording_name", "channel", F.col("window_index").cast("string").alias("window_index"), F.col("spike_count").cast("string").alias("spike_count"), "epoch_label")
    for k, sep in enumerate(",;\t"):
        part = w.filter(F.col("recording_index") % 3 == k)
        part.filter("recording_index % 2 = 1").drop("recording_index").write.option("header", True).option("sep", sep).csv(f"{folder}/a{k}")
        part.filter("recording_index % 2 = 0").drop("recording_index", "epoch_label").write.option("header", True).option("sep", sep).csv(f"{folder}/b{k}")
    out = tables.read_tolerant(spark, f"{folder}/*")
    return out.select("recording_name", "channel", F.col("window_index").cast("int").alias("window_index"), "spike_count", "epoch_label")


@query(f"with {RATES} select 'unit_means' as tab, count(*) as n from (select distinct channel, grp, phase from rates) union all select 'baseline_split', count(*) from bt union all select 'part_values', count(*) from pt union all select 'part_summary', count(*) from (select distinct part_label, grp, phase from long) union all select 'unpaired', count(*) from (select distinct part_label, phase from long) union all select 'cleaned', count(*) from rates union all select 'percent', count(*) from pt")
def s10_analysis_sinks(spark, sf_dir):
    folder = tables.shared_folder(spark, "analysis")
    t, p = stat_tables(spark, sf_dir)
    named = {
        "cleaned": rates(spark, sf_dir), "unit_means": S.unit_means(rates(spark, sf_dir), ["channel"], GROUP), "baseline_split": S.baseline_table(p, KEYS), "part_values": t,
        "part_summary": S.part_summary(t, p, GROUP), "percent": t.select(*KEYS, "part_index", "stimulation_percent_change", "post_percent_change"), "unpaired": S.unpaired_tests(t, GROUP),
    }
    out = None
    for name in tables.write_tables(named, folder, ("unpaired",)):
        n = spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tab"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"with {WINDOWS} select recording_index, channel, window_index, spike_count from fx_windows")
def s11_count_sink(spark, sf_dir):
    folder = tables.shared_folder(spark, "counts")
    windows(spark, sf_dir).write.partitionBy(SERIES_KEYS[0]).parquet(folder)
    return spark.read.parquet(folder).select("recording_index", "channel", "window_index", "spike_count")


@query(f"with {WINDOWS} select recording_index, channel, event_id, printf('%.6f', t_s) as t_s from fx_spikes")
def s12_spike_time_sink(spark, sf_dir):
    folder = tables.shared_folder(spark, "times")
    spikes(spark, sf_dir).select("recording_index", "channel", "event_id", F.format_string("%.6f", "t_s").alias("t_s")).write.option("header", True).csv(folder)
    t = spark.read.option("header", True).schema("recording_index int, channel string, event_id long, t_s string").csv(folder)
    return t
