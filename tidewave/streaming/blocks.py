"""Streams of sample blocks: a WAV source with block offsets, and operators whose state is kept by signal.

Blocks may come in any order. One that comes before its turn waits in the state until those before it
are there, or until the watermark passes its own time: then what is missing counts as
silence, and is dropped if it comes after all. So a signal's state is bounded by the blocks within the
watermark's delay, a filter's tail and a peak picker's window.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor

from ..session import ship
from ..sources import wav

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WavStreamReader(DataSourceStreamReader):
    """Offsets are numbers of blocks: up to `blocksPerTrigger` more of every file at a time."""

    def __init__(self, options):
        self.options = {k.lower(): v for k, v in options.items()}
        self.size, self.step = int(self.options.get("blockframes", 65536)), int(self.options.get("blockspertrigger", 16))
        self.at = 0

    def _reader(self, low: int, high: int) -> wav.WavReader:
        reader = wav.WavReader(_Fields(["path", "block", "samples"]), self.options)
        reader.low, reader.high = low, high
        return reader

    def initialOffset(self):
        return {"block": 0}

    def latestOffset(self):
        heads = wav.WavReader(_Fields(["frames"]), self.options)
        most = max((row[0] for p in heads.partitions() for row in heads.read(p)), default=0)
        self.at = min(self.at + self.step, -(-most // self.size))
        return {"block": self.at}

    def partitions(self, start, end):
        self.at = max(self.at, end["block"])
        return [_Part(p, start["block"], end["block"]) for p in self._reader(0, 0).partitions()]

    def read(self, partition):
        return self._reader(partition.low, partition.high).read(partition.range)

    def commit(self, end):
        pass


class _Fields:
    def __init__(self, names):
        self.fields = [type("Field", (), {"name": n}) for n in names]


class _Part(wav.InputPartition):
    def __init__(self, range_, low, high):
        super().__init__(None)
        self.range, self.low, self.high = range_, low, high


class WavStream(DataSource):
    @classmethod
    def name(cls):
        return "wavstream"

    def schema(self):
        return "path string, block bigint, samples array<double>"

    def streamReader(self, schema):
        return WavStreamReader(self.options)


def read_wav(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, block, samples of WAV files as a stream."""
    ship(spark).dataSource.register(WavStream)
    return spark.readStream.format("wavstream").options(path=path, **{k: str(v) for k, v in options.items()}).load()


class _InTurn(StatefulProcessor):
    """Gives `step` a signal's blocks in order: step(state, samples) returns the new state and what to emit, in columns.

    The state is a list of numbers, whatever they mean to the step.
    """

    def __init__(self, length: int, columns: list[str]):
        self.length, self.columns = length, columns

    def init(self, handle):
        self.handle = handle
        self.known = handle.getValueState("known", "next bigint, numbers array<double>")
        self.waiting = handle.getMapState("waiting", "block bigint", "ms bigint, samples array<double>")

    def step(self, numbers, block, y):
        raise NotImplementedError

    def _run(self, key, numbers, number, skip: bool):
        """All blocks whose turn it is; skip: the first that waits, even if others are missing before it."""
        blocks = {k[0]: v for k, v in self.waiting.iterator()}
        made = []
        while blocks and (number in blocks or skip):
            if number in blocks:
                y = np.asarray(blocks.pop(number)[1], float)
                self.waiting.removeKey((number,))
            else:  # missing for good
                y = np.zeros(self.length)
            numbers, out = self.step(numbers, number, y)
            made += out
            number += 1
            skip = skip and bool(blocks) and min(blocks) > number
        self.known.update((number, [float(x) for x in numbers]))
        if blocks:  # until the watermark has passed the first that waits
            self.handle.registerTimer(blocks[min(blocks)][0] + 1)
        if made:
            yield pd.DataFrame([(key[0], *row) for row in made], columns=["signal_id", *self.columns])

    def _state(self):
        found = self.known.get()
        return (0, []) if found is None else (found[0], list(found[1]))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803
        number, numbers = self._state()
        for f in rows:
            for block, ts, samples in f[["block", "ts", "samples"]].itertuples(index=False):
                if block >= number:
                    self.waiting.updateValue((int(block),), (int(pd.Timestamp(ts).value // 1_000_000), [float(x) for x in samples]))
        yield from self._run(key, numbers, number, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803
        number, numbers = self._state()
        first, ms = min(((k[0], v[0]) for k, v in self.waiting.iterator()), default=(number, 0))
        yield from self._run(key, numbers, number, first > number and ms < timerValues.getCurrentWatermarkInMs())

    def close(self):
        pass


class CombFilter(_InTurn):
    """y = x + alpha y `delay` samples before. The state is the last `delay` outputs."""

    def __init__(self, length: int, delay: int, alpha: float):
        super().__init__(length, ["block", "samples"])
        self.delay, self.alpha = delay, alpha

    def step(self, numbers, block, y):
        past = np.concatenate((np.zeros(max(self.delay - len(numbers), 0)), numbers))
        out = np.concatenate((past, y))
        for i in range(self.delay, len(out), self.delay):
            n = min(self.delay, len(out) - i)
            out[i : i + n] += self.alpha * out[i - self.delay : i - self.delay + n]
        return out[-self.delay :], [(block, out[self.delay :].tolist())]


class PeakPicker(_InTurn):
    """Peaks as `rhythm.peak_pick` finds them. The state is the last peak, the place of the first sample kept, and the samples that windows still need."""

    def __init__(self, length: int, pre_max: int = 3, post_max: int = 3, pre_avg: int = 3, post_avg: int = 3, delta: float = 0.07, wait: int = 30):
        super().__init__(length, ["idx"])
        self.windows, self.delta, self.wait = (pre_max, post_max, pre_avg, post_avg), delta, wait

    def step(self, numbers, block, y):
        last, at, kept = (numbers[0], int(numbers[1]), np.asarray(numbers[2:])) if len(numbers) else (-1.0, 0, np.zeros(0))
        x = np.concatenate((kept, y))
        pre_max, post_max, pre_avg, post_avg = self.windows
        before, behind = max(pre_max, pre_avg), max(post_max, post_avg)
        peaks = []
        for i in range(before, len(x) - behind):
            if x[i] >= x[i - pre_max : i + post_max + 1].max() and x[i] >= x[i - pre_avg : i + post_avg + 1].mean() + self.delta and (last < 0 or at + i - last >= self.wait):
                last = float(at + i)
                peaks.append((at + i,))
        drop = max(len(x) - behind - before, 0)
        return [last, at + drop, *x[drop:]], peaks


def in_turn(blocks: DataFrame, processor: _InTurn, output: str, late: str = "1 hour") -> DataFrame:
    """A processor over a stream (signal_id, block, ts, samples); ts: a block's time after 1970, which rises with its number. output: the columns behind signal_id."""
    spark = ship(blocks.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # what this kind of state needs
    kind = blocks.select("signal_id").schema[0].dataType.simpleString()
    return blocks.withWatermark("ts", late).groupBy("signal_id").transformWithStateInPandas(processor, f"signal_id {kind}, {output}", "append", "eventTime")
