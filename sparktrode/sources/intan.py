"""Raw recording files as a splittable Spark data source.

``spark.read.format("recording").option("path", folder)`` reads RHD and RHS files. A file is a
header and data blocks of fixed size, so it splits by ranges of blocks; a task seeks to its range
and reads only the bytes of the signal asked for. ``table`` chooses samples (default), metadata or
channels; ``signal`` one of amplifier, aux, supply, temp, adc, dac, dc, stim, din, dout, tick.

`read` takes the recordings, the channels and the range of n that are wanted: other files aren't
planned, other channels' bytes aren't read, and blocks outside the range are neither planned nor
read. These are options and not pushed filters, as Spark 4.1 keeps the filters that one query of a
DataFrame pushed for the next one, which then lacks rows. ``mergeBytes`` is the longest hole between
needed bytes that is read along to save a request.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The formats' magic numbers and signal types.
RHD_MAGIC, RHS_MAGIC = 0xC6912702, 0xD69127AC
RHD_TYPES = {0: "amplifier", 1: "aux", 2: "supply", 3: "adc", 4: "din", 5: "dout"}
RHS_TYPES = {0: "amplifier", 3: "adc", 4: "dac", 5: "din", 6: "dout"}
NOTCH_HZ = {1: 50, 2: 60}
FREQUENCIES = ["dsp_enabled", "actual_dsp_cutoff_hz", "actual_lower_hz", "actual_upper_hz", "desired_dsp_cutoff_hz", "desired_lower_hz", "desired_upper_hz"]
SETTLE = ["dsp_enabled", "actual_dsp_cutoff_hz", "actual_lower_hz", "actual_lower_settle_hz", "actual_upper_hz", "desired_dsp_cutoff_hz", "desired_lower_hz", "desired_lower_settle_hz", "desired_upper_hz"]

SAMPLES = "recording string, channel string, n long, tick long, raw int"
METADATA = """recording string, variant string, version string, version_major int, fs_hz double, samples_per_block int, notch_hz int, notes array<string>, reference_channel string,
 board_mode int, blocks long, dc_saved boolean, temp_sensors int, frequencies map<string,double>, stim map<string,double>"""
CHANNELS = """recording string, signal_type int, signal string, enabled boolean, native_name string, custom_name string, native_order int, custom_order int, chip_channel int, board_stream int,
 port_name string, port_prefix string, port_number int, impedance_ohm double, impedance_phase double, trigger_mode int, trigger_threshold int, trigger_channel int, trigger_edge int"""


class _Reader:
    """Little-endian values and strings of a header, in order."""

    def __init__(self, data: io.BufferedIOBase | io.BytesIO):
        self.data = data

    def take(self, form: str) -> tuple:
        size = struct.calcsize("<" + form)
        raw = self.data.read(size)
        if len(raw) < size:
            raise EOFError("the header ends early")
        return struct.unpack("<" + form, raw)

    def text(self) -> str:
        (size,) = self.take("I")
        if size == 0xFFFFFFFF:
            return ""
        raw = self.data.read(size)
        if len(raw) < size:
            raise ValueError("a string is longer than the file")
        return raw.decode("utf-16-le")


def read_header(data) -> dict:
    """Everything before the data blocks, and where those start."""
    read = _Reader(data)
    (magic,) = read.take("I")
    if magic not in (RHD_MAGIC, RHS_MAGIC):
        raise ValueError("not a recording file")
    rhs = magic == RHS_MAGIC
    major, minor = read.take("hh")
    (fs,) = read.take("f")
    names = SETTLE if rhs else FREQUENCIES
    freq = dict(zip(names, map(float, read.take("h" + "f" * (len(names) - 1))), strict=True))
    (mode,) = read.take("h")
    freq["desired_impedance_hz"], freq["actual_impedance_hz"] = read.take("ff")
    stim = {}
    if rhs:
        stim["amp_settle_mode"], stim["charge_recovery_mode"] = map(float, read.take("hh"))
        stim["step_size"], stim["recovery_current_limit"], stim["recovery_target_voltage"] = read.take("fff")
    notes = [read.text() for _ in range(3)]
    newer = lambda a, b: (major, minor) >= (a, b)
    dc = bool(read.take("h")[0]) if rhs else False
    temps = read.take("h")[0] if not rhs and newer(1, 1) else 0
    board = read.take("h")[0] if rhs or newer(1, 3) else 0
    reference = read.text() if rhs or major > 1 else None
    channels = []
    for port in range(1, read.take("h")[0] + 1):
        name, prefix = read.text(), read.text()
        enabled, count, _ = read.take("hhh")
        for _ in range(count if enabled > 0 else 0):
            native, custom = read.text(), read.text()
            if rhs:
                native_order, custom_order, kind, on, chip, _, stream = read.take("hhhhhHh")
            else:
                native_order, custom_order, kind, on, chip, stream = read.take("hhhhhh")
            trigger, impedance = read.take("hhhh"), read.take("ff")
            types = RHS_TYPES if rhs else RHD_TYPES
            if on and kind not in types:
                raise ValueError(f"unknown channel type {kind}")
            channels.append((kind, types.get(kind), bool(on), native, custom, native_order, custom_order, chip, stream, name, prefix, port, *map(float, impedance), *trigger))
    per_block = 128 if rhs or major > 1 else 60
    return {
        "variant": "rhs" if rhs else "rhd", "major": major, "minor": minor, "fs": float(fs), "per_block": per_block, "notch": NOTCH_HZ.get(mode, 0), "notes": notes, "reference": reference,
        "board": board, "dc": dc, "temps": temps, "freq": freq, "stim": {k: float(v) for k, v in stim.items()}, "channels": channels, "signed": rhs or newer(1, 2), "start": data.tell(),
    }


def layout(h: dict) -> dict[str, tuple[int, int, int]]:
    """For each signal its offset in a block, samples a block and channels; 'size' is the block's."""
    n = h["per_block"]
    count = lambda kind: sum(c[2] and c[1] == kind for c in h["channels"])
    amp = count("amplifier")
    if h["variant"] == "rhd":
        parts = [("amplifier", n, amp), ("aux", n // 4, count("aux")), ("supply", 1, count("supply")), ("temp", 1, h["temps"]), ("adc", n, count("adc"))]
    else:
        parts = [("amplifier", n, amp), *([("dc", n, amp)] if h["dc"] else []), ("stim", n, amp), ("adc", n, count("adc")), ("dac", n, count("dac"))]
    parts += [("din", n, int(count("din") > 0)), ("dout", n, int(count("dout") > 0))]
    out, at = {"tick": (0, n, 1)}, 4 * n
    for name, samples, channels in parts:
        out[name] = (at, samples, channels)
        at += 2 * samples * channels
    return out | {"size": (at, 0, 0)}


#: Bytes of files in one task, bytes of blocks turned into a batch together, and of holes read along.
SPLIT_BYTES, READ_BYTES, MERGE_BYTES = 64 << 20, 4 << 20, 4096
#: Bytes that opening a file counts for, and the tasks below which small files have one each.
OPEN_BYTES, LEAST_TASKS = 1 << 16, 64


def stem(path: str) -> str:
    """A recording's name: its file's, without folder and ending."""
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


class Bytes(InputPartition):
    """The blocks of a file that begin in a range of its bytes."""

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class Ranges(InputPartition):
    """Ranges of several small files."""

    def __init__(self, ranges: list[Bytes]):
        self.ranges = ranges


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.table = self.options.get("table", "samples")
        self.signal = self.options.get("signal", "amplifier")
        self.merge = int(self.options.get("mergebytes", MERGE_BYTES))
        self.recordings, self.channels = (set(json.loads(x)) if (x := self.options.get(k)) else None for k in ("recordings", "channels"))
        self.low, self.high = int(self.options.get("first", 0)), int(x) if (x := self.options.get("last")) else None

    def files(self) -> list[tuple[str, int]]:
        """Paths and sizes, from the listing alone."""
        path = self.options["path"]
        store, at = pafs.FileSystem.from_uri(path)
        head = path[: len(path) - len(at)] if path.endswith(at) else ""
        info = store.get_file_info(pafs.FileSelector(at, recursive=True))
        found = (x for x in info if x.is_file and x.path.lower().endswith((".rhd", ".rhs")))
        return sorted((head + x.path, x.size) for x in found if self.recordings is None or stem(x.path) in self.recordings)

    @staticmethod
    def open(path: str):
        store, at = pafs.FileSystem.from_uri(path)
        return store.open_input_file(at), store.get_file_info(at).size

    def header(self, path: str) -> tuple[dict, int]:
        source, size = self.open(path)
        with source:
            h = read_header(source)
        left, block = size - h["start"], layout(h)["size"][0]
        if left % block:
            raise ValueError(f"{path}: not a whole number of data blocks")
        return h, left // block

    def wanted(self, h: dict, blocks: int) -> tuple[int, int]:
        """The blocks that hold the n asked for."""
        per = layout(h).get(self.signal, (0, h["per_block"], 0))[1]
        return min(self.low // per, blocks), blocks if self.high is None else min(max(self.high // per + 1, 0), blocks)

    def partitions(self) -> list[Bytes | Ranges]:
        """Headers or ranges of bytes; small ones are put together. Only the tasks open files, unless
        a range of n is asked for: then headers tell where in the files it is."""
        step = int(self.options.get("bytespertask", SPLIT_BYTES))
        if self.table != "samples":
            return self.together([Bytes(f, 0, 0) for f, _ in self.files()], step)
        out = []
        for f, size in self.files():
            low, high = 0, size
            if self.low or self.high is not None:
                h, blocks = self.header(f)
                first, end = self.wanted(h, blocks)
                block = layout(h)["size"][0]
                low, high = h["start"] + first * block, h["start"] + end * block
                if low >= high:
                    continue
            out += [Bytes(f, b, min(b + step, high)) for b in range(low, max(high, low + 1), step)]
        return self.together(out, step)

    @staticmethod
    def together(ranges: list[Bytes], step: int) -> list[Bytes | Ranges]:
        """Neighbours in one task up to `step` bytes, what opening costs counted, but no fewer than
        LEAST_TASKS tasks for that."""
        costs = [x.end - x.begin + OPEN_BYTES for x in ranges]
        most, size, lots = min(step, sum(costs) // LEAST_TASKS), 0, []
        for x, cost in zip(ranges, costs, strict=True):
            if not lots or size + cost > most:
                lots.append([])
                size = 0
            lots[-1].append(x)
            size += cost
        return [Ranges(x) if len(x) > 1 else x[0] for x in lots]

    def read(self, part: Bytes | Ranges | None) -> Iterator[pa.RecordBatch]:
        if isinstance(part, Ranges):
            for x in part.ranges:
                yield from self.read(x)
            return
        if part is None:  # no file
            return
        h, blocks = self.header(part.path)
        name = stem(part.path)
        if self.table == "metadata":
            yield pa.RecordBatch.from_pylist([{
                "recording": name, "variant": h["variant"], "version": f"{h['major']}.{h['minor']}", "version_major": h["major"], "fs_hz": h["fs"], "samples_per_block": h["per_block"], "notch_hz": h["notch"],
                "notes": h["notes"], "reference_channel": h["reference"], "board_mode": h["board"], "blocks": blocks, "dc_saved": h["dc"], "temp_sensors": h["temps"], "frequencies": list(h["freq"].items()), "stim": list(h["stim"].items()),
            }], schema=_arrow(METADATA))
        elif self.table == "channels":
            schema = _arrow(CHANNELS)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (name, *c), strict=True)) for c in h["channels"]], schema=schema)
        else:
            size = layout(h)["size"][0]
            begins = lambda at: min(max(-(-(at - h["start"]) // size), 0), blocks)
            first, end = self.wanted(h, blocks)
            yield from self.samples(part.path, max(begins(part.begin), first), min(begins(part.end), end), h, name)

    def blocks(self, source, h: dict, first: int, count: int, pieces: list[tuple[int, int]]) -> np.ndarray:
        """Blocks as rows of bytes, of which only the pieces, (begin, end) in a block, are filled.

        Pieces with holes of at most `merge` bytes are read together, over blocks too.
        """
        size, joined = layout(h)["size"][0], []
        for a, b in sorted(pieces):
            if joined and a - joined[-1][1] <= self.merge:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        out = np.zeros(count * size, np.uint8)
        at = h["start"] + first * size

        def fill(a: int, b: int) -> None:
            source.seek(at + a)
            out[a:b] = np.frombuffer(source.read(b - a), np.uint8)

        if len(joined) == 1 and size - joined[0][1] + joined[0][0] <= self.merge:
            fill(joined[0][0], (count - 1) * size + joined[0][1])
        else:
            for k in range(count):
                for a, b in joined:
                    fill(k * size + a, k * size + b)
        return out.reshape(count, size)

    def samples(self, path: str, begin: int, end: int, h: dict, name: str) -> Iterator[pa.RecordBatch]:
        places = layout(h)
        if self.signal not in places:
            return
        at, per, count = places[self.signal]
        if not count or begin >= end:
            return
        kind = {"dc": "amplifier", "stim": "amplifier"}.get(self.signal, self.signal)
        names = [c[4] or c[3] for c in h["channels"] if c[2] and c[1] == kind]
        names = [self.signal] if self.signal in ("din", "dout", "tick") else names or [f"temp-{i}" for i in range(count)]
        picked = [i for i in range(count) if self.channels is None or names[i] in self.channels]
        if not picked:
            return
        pieces = [(0, 4 * h["per_block"])] + ([(at + 2 * per * i, at + 2 * per * (i + 1)) for i in picked] if self.signal != "tick" else [])
        names, count = [names[i] for i in picked], len(picked)
        ticks, every = "<i4" if h["signed"] else "<u4", h["per_block"] // per
        step = max(1, READ_BYTES // max(places["size"][0], 64 * per * count))
        source, _ = self.open(path)
        with source:
            for b in range(begin, end, step):
                k = min(step, end - b)
                rows = self.blocks(source, h, b, k, pieces)
                tick = np.ascontiguousarray(rows[:, : 4 * h["per_block"]]).view(ticks).astype(np.int64)[:, ::every]
                if self.signal == "tick":
                    raw = tick[:, None, :]
                else:
                    raw = np.stack([np.ascontiguousarray(rows[:, a:e]).view("<u2") for a, e in pieces[1:]], axis=1)
                shape = (k, count, per)
                n = np.arange(b, b + k)[:, None, None] * per + np.arange(per)
                inside = (n >= self.low) & (n <= (n if self.high is None else self.high))
                own = None if inside.all() else np.broadcast_to(inside, shape).ravel()
                flat = lambda x, s=shape, own=own: pa.array(np.broadcast_to(x, s).ravel() if own is None else np.broadcast_to(x, s).ravel()[own])
                channel = pa.DictionaryArray.from_arrays(flat(np.arange(count, dtype=np.int32)[:, None]), pa.array(names, pa.string())).cast(pa.string())
                recording = pa.DictionaryArray.from_arrays(flat(np.zeros(1, np.int32)), pa.array([name])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([recording, channel, flat(n), flat(tick[:, None, :]), flat(raw.astype(np.int32))], schema=_arrow(SAMPLES))


class Recording(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return {"metadata": METADATA, "channels": CHANNELS}.get(self.options.get("table", "samples"), SAMPLES)

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(dict(self.options))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "map<string,double>": pa.map_(pa.string(), pa.float64())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.replace("map<string,double>", "map<string;double>").split(",")) for t in [t.replace(";", ",")]])


def register(spark) -> None:
    spark.dataSource.register(Recording)


def read(spark, path: str, recordings: list[str] | None = None, channels: list[str] | None = None, first: int = 0, last: int | None = None, **options: str) -> DataFrame:
    """The samples of a folder's files, or of some of its recordings and channels, with n from first
    to last, both included. options are the source's, say signal or mergeBytes."""
    register(spark)
    wanted = {k: json.dumps(list(v)) for k, v in (("recordings", recordings), ("channels", channels)) if v is not None}
    ends = {"first": str(first)} | ({"last": str(last)} if last is not None else {})
    return spark.read.format("recording").option("path", path).options(**wanted, **ends, **options).load()


def _text(x: str) -> bytes:
    raw = x.encode("utf-16-le")
    return struct.pack("<I", len(raw)) + raw


def write_recording(channels: list[tuple], words: dict[str, np.ndarray], ticks: np.ndarray, version: tuple[int, int] = (2, 0), variant: str = "rhd", fs_hz: float = 30000.0, notch_mode: int = 0, temps: int = 0, board: int = 0, dc: bool = False, notes: tuple[str, str, str] = ("", "", "")) -> bytes:
    """A file's bytes: channels are (signal type, name); words hold (channels, samples) of uint16
    for each signal of the layout. Samples beyond whole blocks are left out."""
    rhs = variant == "rhs"
    out = [struct.pack("<Ihhf", RHS_MAGIC if rhs else RHD_MAGIC, *version, fs_hz)]
    out.append(struct.pack("<h" + "f" * (8 if rhs else 6), 1, *range(1, 9 if rhs else 7)) + struct.pack("<hff", notch_mode, 1000.0, 1001.0))
    if rhs:
        out.append(struct.pack("<hhfff", 0, 1, 1e-8, 1e-9, 0.5))
    out += [_text(x) for x in notes]
    newer = version >= (1, 1), version >= (1, 3)
    out.append(struct.pack("<hh", int(dc), board) if rhs else (struct.pack("<h", temps) if newer[0] else b"") + (struct.pack("<h", board) if newer[1] else b""))
    if rhs or version[0] > 1:
        out.append(_text("REF"))
    out.append(struct.pack("<h", 1) + _text("Port A") + _text("A") + struct.pack("<hhh", 1, len(channels), 0))
    for i, (kind, name) in enumerate(channels):
        order = struct.pack("<hhhhhHh", i, i, kind, 1, i, 0, 0) if rhs else struct.pack("<hhhhhh", i, i, kind, 1, i, 0)
        out.append(_text(name) + _text(name) + order + struct.pack("<hhhhff", 0, 0, 0, 0, 1e4 + i, -30.0))
    head = b"".join(out)
    h = read_header(io.BytesIO(head))
    places, n = layout(h), h["per_block"]
    blocks = [head]
    for b in range(len(ticks) // n):
        blocks.append(ticks[b * n : (b + 1) * n].astype("<i4").tobytes())
        for name, (_, per, count) in places.items():
            if name not in ("tick", "size") and count:
                blocks.append(words[name][:, b * per : (b + 1) * per].astype("<u2").tobytes())
    return b"".join(blocks)
