"""Queries over an event table of 1,000 hours of another year, against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_queries import rows

from tidewave.plans import catalog

NAMES = "frame_rms stft_relational stft_halo istft_halo deemphasis comb_forward pcen viterbi forward_backward crf_log_partition peak_candidates backtrack trim split waveshow_envelope stream_blocks piano_hmm tempogram mel_spectrogram_processor asof_nearest".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(3)
    n = 3000
    hours = np.sort(rng.random(n)) * 997 + 1.25
    hours[[0, -1]] = 0.5, 999.5
    table = pa.table({
        "event_id": pa.array(np.arange(n)), "ts": pa.array(((1751333400 + hours * 3600) * 1e6).astype(np.int64), pa.timestamp("us")), "user_id": pa.array(rng.integers(0, 20, n)),
        "event_type": pa.array(rng.choice(["click", "purchase", "view"], n)), "value": pa.array(rng.random(n) * 200), "props": pa.array(["{}"] * n),
    })
    at = tmp_path_factory.mktemp("dates")
    pq.write_table(table, at / "events.parquet")
    return str(at)


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalog.ORACLE_SQL])
def test_other_dates(spark, folder, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    got = catalog.QUERIES[name](spark, folder).toPandas()
    want = c.sql(catalog.ORACLE_SQL[name]).df()
    assert len(got) and rows(got) == rows(want)


def test_no_tuning_without_peaks(spark, tmp_path):
    rng = np.random.default_rng(4)
    hours = np.concatenate([np.arange(240) + 0.5, rng.random(400) * 240])
    table = pa.table({
        "event_id": pa.array(np.arange(640)), "ts": pa.array(((1704067200 + hours * 3600) * 1e6).astype(np.int64), pa.timestamp("us")), "user_id": pa.array(rng.integers(0, 20, 640)),
        "event_type": pa.array(["even"] * 240 + ["noise"] * 400), "value": pa.array(np.concatenate([np.full(240, 70.0), rng.random(400) * 200])), "props": pa.array(["{}"] * 640),
    })
    pq.write_table(table, tmp_path / "events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    got = catalog.QUERIES["estimate_tuning"](spark, str(tmp_path)).toPandas()
    assert list(got.signal_id) == ["noise"] and rows(got) == rows(c.sql(catalog.ORACLE_SQL["estimate_tuning"]).df())
