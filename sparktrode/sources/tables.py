"""Delimited files in and out: wide sample tables, count tables and analysis tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are no character in windows-1252, and what its other bytes from 80 to 9F stand for:
#: Spark reads them as those of iso-8859-1.
UNDEFINED_1252 = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
AS_1252 = {chr(b): bytes([b]).decode("windows-1252") for b in range(0x80, 0xA0) if b not in UNDEFINED_1252}


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; set here if unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{tag}-{uuid.uuid4().hex}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: later steps read it instead of working it out again."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that `written` made, once nothing will read it again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_wide(samples: DataFrame, path: str, channels: list[str]) -> None:
    """One row for each recording and time, a column for each channel in order of names."""
    wide = samples.groupBy("recording_name", "n", "t_s").pivot("channel", sorted(channels)).agg(F.first("x_uv"))
    wide.withColumnRenamed("t_s", "time_s").write.partitionBy("recording_name").option("header", True).csv(path)


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """Recordings with a union of channels; absent channels are null. The name is the folder's."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def to_long(wide: DataFrame, ids: list[str], recording: str = "recording_name") -> DataFrame:
    """A row for each time and channel of a recording; missing samples are null and stay, for gap filling.

    A channel without any sample in a recording is absent there, as in files of other channels.
    """
    channels = [c for c in wide.columns if c not in ids]
    value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    typed = wide.select(*[F.col(f"`{c}`") for c in ids], *[value(c).alias(c) for c in channels])
    long = lambda d, keys, name: d.unpivot([F.col(f"`{c}`") for c in keys], [F.col(f"`{c}`") for c in channels], "channel", name)
    counts = typed.groupBy(recording).agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in channels])
    there = long(counts, [recording], "samples").filter("samples > 0").select(recording, "channel")  # a row a recording and channel
    return long(typed, ids, "x_uv").join(there, [recording, "channel"], "left_semi")


def sniff(line: str) -> str:
    """The delimiter of a header line: the most frequent of comma, semicolon and tab."""
    return max(",;\t", key=line.count)


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files of any of three delimiters, with or without a byte order mark.

    A file's first line tells its delimiter; files of one delimiter and header are read together.
    A file that isn't UTF-8 is windows-1252, or iso-8859-1 if it has bytes that the former lacks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("i"))
    gaps = F.hex(F.col("value").cast("binary")).rlike("^(..)*(" + "|".join(f"{b:02X}" for b in UNDEFINED_1252) + ")")
    heads = lines.groupBy("file").agg(F.min_by(F.col("value").cast("binary"), F.struct("at", "i")).alias("head"), F.max(~F.is_valid_utf8("value")).alias("odd"), F.max(gaps).alias("gaps")).collect()  # a row a file
    groups: dict[tuple[str, bytes, str], list[str]] = {}
    for h in heads:
        head = bytes(h["head"]).removeprefix(b"\xef\xbb\xbf")
        encoding = "utf-8" if not h["odd"] else "iso-8859-1" if h["gaps"] else "windows-1252"
        groups.setdefault((sniff(head.decode("iso-8859-1")), head, encoding), []).append(h["file"])
    out = None
    for (sep, _, encoding), files in sorted(groups.items()):
        part = spark.read.option("header", True).option("sep", sep).option("encoding", "utf-8" if encoding == "utf-8" else "iso-8859-1").csv(files)
        if encoding == "windows-1252":
            shown, meant = "".join(AS_1252), "".join(AS_1252.values())
            part = part.select(*[F.translate(F.col(f"`{c}`"), shown, meant).alias(c.translate(str.maketrans(AS_1252))) for c in part.columns])
        part = part.withColumnsRenamed({c: c.lstrip("\ufeff") for c in part.columns})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_tables(tables: dict[str, DataFrame], folder: str, skip_empty: tuple[str, ...] = ()) -> list[str]:
    """Each named table to its own folder, in place of an older one; some only if not empty."""
    done = []
    for name, df in tables.items():
        if name in skip_empty and df.isEmpty():
            continue
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        done.append(name)
    return done
