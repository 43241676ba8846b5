"""All registered queries of the signal and music operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import events, frames, processors, spectra, stored, streams

_PARTS = (spectra, events, frames, stored, streams, processors)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
FLAGSHIP = "frame_rms"
