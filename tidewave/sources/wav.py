"""WAV files as a data source: blocks of samples by byte range, or headers alone.

    spark.dataSource.register(WavSource)
    spark.read.format("wav").option("path", folder).load()                                # path, sr, channels, frames, block, samples
    spark.read.format("wav").schema("path string, sr double").option("path", f).load()    # reads headers only

Files are cut into byte ranges by their size, so that nothing of them is read to plan a scan; a block
belongs to the range in which it begins. Filters on path and block are taken over by the
reader (spark.sql.python.filterPushdown.enabled must be set), and a schema without samples and block reads no data.
Options: path (a file, or a folder with *.wav), blockFrames, rangeBytes, offset and duration (seconds), mono (else
channels stay interleaved). PCM of 8, 16, 24 and 32 bits and floats of 32 and 64 bits. Files are opened by
pyarrow, in any store that it knows; `signals.load` reads whole files by Spark's own reader.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..session import ship

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # a source is planned before the package's files are there

_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Header:
    sr: int
    channels: int
    bits: int
    float_: bool
    at: int  # of the first sample
    frames: int

    @property
    def width(self) -> int:
        return self.channels * self.bits // 8


def opened(path: str):
    """(file system, path in it) of a path or URI."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def header(f) -> Header:
    """Of an open file; chunks other than format and data are passed over. A data chunk that says more than there is ends with the file."""
    f.seek(0)
    riff, _, wave = struct.unpack("<4sI4s", f.read(12))
    if riff != b"RIFF" or wave != b"WAVE":
        raise ValueError("not a WAV file")
    kind = None
    while len(head := f.read(8)) == 8:
        name, size = struct.unpack("<4sI", head)
        if name == b"fmt ":
            raw = f.read(size)
            code, channels, sr, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            kind = struct.unpack("<H", raw[24:26])[0] if code == _EXTENSIBLE else code, channels, sr, bits
        elif name == b"data":
            if kind is None or kind[0] not in (_PCM, _FLOAT):
                raise ValueError("only PCM and floats are read")
            at = f.tell()
            f.seek(0, 2)
            size = min(size, f.tell() - at)
            return Header(kind[2], kind[1], kind[3], kind[0] == _FLOAT, at, size // (kind[1] * kind[3] // 8))
        else:
            f.seek(size, 1)
        if size % 2:
            f.seek(1, 1)
    raise ValueError("a WAV file without data")


def decoded(raw: bytes, h: Header) -> np.ndarray:
    """(frame, channel) in -1 to 1."""
    if h.float_:
        x = np.frombuffer(raw, f"<f{h.bits // 8}").astype(float)
    elif h.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif h.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{h.bits // 8}").astype(float) / float(1 << (h.bits - 1))
    return x.reshape(-1, h.channels)


def encoded(x: np.ndarray, sr: int, kind: str = "pcm16") -> bytes:
    """A file's bytes of (frame, channel) samples; pcm16 or float32."""
    x = np.asarray(x, float)
    x = x[:, None] if x.ndim == 1 else x
    data = x.astype("<f4").tobytes() if kind == "float32" else np.clip(np.floor(x * 32767 + 0.5), -32768, 32767).astype("<i2").tobytes()
    bits, code, channels = (32, _FLOAT, x.shape[1]) if kind == "float32" else (16, _PCM, x.shape[1])
    form = struct.pack("<HHIIHH", code, channels, sr, sr * channels * bits // 8, channels * bits // 8, bits)
    return struct.pack("<4sI4s4sI", b"RIFF", 36 + len(data) + len(data) % 2, b"WAVE", b"fmt ", 16) + form + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int

    def __post_init__(self):
        super().__init__(None)


class WavReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.schema = schema
        # options arrive in lower or in their own case
        self.options = {k.lower(): v for k, v in options.items()}
        self.low, self.high, self.paths = 0, None, None

    def pushFilters(self, filters):
        for f in filters:
            of = f.attribute if hasattr(f, "attribute") else None
            if of == ("path",) and isinstance(f, EqualTo):
                self.paths = {f.value}
            elif of == ("block",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                v = int(f.value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = v + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    @property
    def whole(self) -> bool:
        """Whether only headers are asked for."""
        return not {"samples", "block"} & set(self.names)

    def partitions(self):
        path = self.options["path"]
        store, at = opened(path)
        found = [store.get_file_info(at)]
        if found[0].type == fs.FileType.Directory:
            found = [x for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(x.path).lower(), "*.wav")]
        prefix = path[: path.index(at)] if at in path else ""
        step = int(self.options.get("rangebytes", 32 << 20))
        out = []
        for x in sorted(found, key=lambda x: x.path):
            name = prefix + x.path
            if x.type != fs.FileType.File or self.paths is not None and name not in self.paths:
                continue
            out += [Range(name, 0, x.size)] if self.whole else [Range(name, b, min(b + step, x.size)) for b in range(0, max(x.size, 1), step)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        store, at = opened(partition.path)
        with store.open_input_file(at) as f:
            h = header(f)
            first = min(int(float(self.options.get("offset", 0)) * h.sr), h.frames)
            last = min(first + int(float(self.options["duration"]) * h.sr), h.frames) if "duration" in self.options else h.frames
            facts = {"path": partition.path, "sr": float(h.sr), "channels": h.channels, "frames": last - first, "duration": (last - first) / h.sr}
            if self.whole:
                yield tuple(facts[n] for n in self.names)
                return
            size, mono = int(self.options.get("blockframes", 65536)), str(self.options.get("mono", "true")).lower() == "true"
            for block in range(self.low, -(-(last - first) // size) if self.high is None else min(self.high, -(-(last - first) // size))):
                a = h.at + (first + block * size) * h.width
                if not partition.begin <= a < partition.end:
                    continue
                f.seek(a)
                x = decoded(f.read((min((block + 1) * size, last - first) - block * size) * h.width), h)
                facts |= {"block": block, "samples": (x.mean(axis=1) if mono else x.ravel()).tolist()}
                yield tuple(facts[n] for n in self.names)


class WavSource(DataSource):
    @classmethod
    def name(cls):
        return "wav"

    def schema(self):
        return "path string, sr double, channels int, frames bigint, block bigint, samples array<double>"

    def reader(self, schema):
        return WavReader(schema, self.options)


def read_blocks(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A scan of WAV files with the source's options. Turns the session's pushdown to Python sources on, which this one needs."""
    ship(spark).dataSource.register(WavSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("wav").options(path=path, **{k: str(v) for k, v in options.items()})
    return (r.schema(schema) if schema else r).load()


def write(signals: DataFrame, folder: str, kind: str = "pcm16") -> int:
    """Writes a file for each signal (signal_id, sr, samples), named by its id; returns how many. A task that is run again writes the same file again, under another name until it is whole."""
    ship(signals.sparkSession)

    def run(it):
        store, at = opened(folder)
        store.create_dir(at, recursive=True)
        for b in it:
            for k, (name, sr) in enumerate(zip(b.column("signal_id").to_pylist(), b.column("sr").to_pylist())):
                target = f"{at}/{name}.wav"
                part = f"{target}.{id(b)}.part"
                with store.open_output_stream(part) as f:
                    f.write(encoded(np.asarray(b.column("samples")[k].values, float), int(sr), kind))
                store.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return signals.select(signals["signal_id"].cast("string").alias("signal_id"), "sr", "samples").mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0
