"""From kernels over one signal to DataFrame operators.

A signal is a row, so a lifted kernel needs no shuffle: it runs where the row is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _inputs(column: pa.Array) -> list:
    """The column's values; lists of numbers as numpy views of the batch, lists of them as matrices."""
    kind = column.type
    if pa.types.is_list(kind) and pa.types.is_floating(kind.value_type):
        flat, at = np.asarray(column.flatten()), np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0)))).astype(np.int64)
        known = column.is_valid().to_pylist()
        return [flat[i:j] if ok else None for i, j, ok in zip(at[:-1], at[1:], known)]
    if pa.types.is_list(kind) and pa.types.is_list(kind.value_type):
        return [None if not x.is_valid else as_matrix(x.values) for x in column]
    return column.to_pylist()


def as_matrix(rows: pa.Array) -> np.ndarray:
    """A list of lists of numbers; of equal lengths, without going through Python's numbers."""
    widths = np.asarray(rows.value_lengths().fill_null(-1))
    flat = rows.flatten()
    if len(widths) and (widths == widths[0]).all() and widths[0] > 0 and not flat.null_count:
        return np.asarray(flat, float).reshape(len(widths), -1)
    return np.array(rows.to_pylist(), float)


def _outputs(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind) and pa.types.is_floating(kind.value_type) and all(v is not None for v in values):
        parts = [np.asarray(v, float) for v in values]
        at = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.zeros(0)))
    return pa.array([_plain(v) for v in values], kind)


def _plain(v):
    if isinstance(v, np.ndarray):
        return v.tolist()
    return v.item() if isinstance(v, np.generic) else v


def lift(df: DataFrame, kernel: Callable[..., Iterable[tuple]], inputs: list[str], outputs: str, keep: str = "signal_id") -> DataFrame:
    """Rows (keep, *outputs) from kernel(*inputs) of each row; a kernel gives any number of tuples.

    Arrays arrive as numpy arrays, nulls in them as NaN; a null array gives no rows.
    """
    from ..session import ship

    ship(df.sparkSession)
    kind = df.select(keep).schema[0].dataType.simpleString()
    names = [x.split()[0] for x in _fields(outputs)]

    def run(it):
        for b in it:
            keys, columns = b.column(keep).to_pylist(), [_inputs(b.column(c)) for c in inputs]
            out = [[] for _ in range(len(names) + 1)]
            for row in zip(keys, *columns):
                if any(v is None for v in row[1:]):
                    continue
                for made in kernel(*row[1:]):
                    for c, v in zip(out, (row[0], *made)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([_outputs(c, f.type) for c, f in zip(out, schema)], [keep, *names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    text = f"{keep} {kind}, {outputs}"
    schema = list(to_arrow_schema(StructType.fromDDL(text)))
    return df.select(keep, *inputs).mapInArrow(run, text)


def _fields(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]


def by_frame(df: DataFrame, kernel: Callable[..., np.ndarray], inputs: list[str] | None = None, keep: str = "signal_id") -> DataFrame:
    """(keep, frame, v) of a kernel that gives a (frame, value) matrix or a vector of one value a frame."""

    def rows(*args):
        m = np.asarray(kernel(*args), float)
        return ((i, np.atleast_1d(r)) for i, r in enumerate(m))

    return lift(df, rows, inputs or ["samples", "sr"], "frame bigint, v array<double>", keep)


def tidy(frames: DataFrame, keep: str = "signal_id", bin_name: str = "bin") -> DataFrame:
    """(keep, frame, bin, v) from (keep, frame, v array)."""
    return frames.select(keep, "frame", F.posexplode("v").alias(bin_name, "v"))


def packed(df: DataFrame, keep: str = "signal_id", bin_name: str = "bin") -> DataFrame:
    """(keep, frame, v array) from (keep, frame, bin, v)."""
    return df.groupBy(keep, "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct(bin_name, "v"))), lambda x: x["v"]).alias("v"))
