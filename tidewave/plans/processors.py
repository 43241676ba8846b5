"""Queries of the processors, windows, frequency grids and remaining column operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import banks, units, windows
from ..operators import processors as P
from ..operators import spectral
from ..operators.lift import by_frame, lift, tidy
from ..sources import signals as src
from . import spectra
from .spectra import HOP, N, SIG, SIZE, SPEC, SR, R, sig

QUERIES, ORACLE_SQL = {}, {}


def add(name, query, sql=None, digits=6):
    spectra.add(name, query, sql, digits)
    QUERIES[name] = spectra.QUERIES.pop(name)
    if sql:
        ORACLE_SQL[name] = spectra.ORACLE_SQL.pop(name)


def matrix(kernel, bin_name="bin"):
    return lambda s, d: tidy(by_frame(sig(s, d), lambda y, sr: kernel(y)), bin_name=bin_name)


def scalars(kernel, schema):
    return lambda s, d: lift(sig(s, d), kernel, ["samples"], schema)


# zeros on both sides, symmetric window
PFR = f"""{SIG}, n AS (SELECT signal_id, unnest(range(-{SIZE // 2}, {N} + {SIZE // 2})) AS idx FROM sig WHERE idx = 0), z AS (SELECT n.signal_id, n.idx + {SIZE // 2} AS idx, coalesce(y, 0) AS y FROM n LEFT JOIN sig USING (signal_id, idx)),
pf AS (SELECT z.signal_id, f.frame, z.idx - f.frame * {HOP} AS i, z.y FROM (SELECT unnest(range(0, {N} // {HOP} + 1)) AS frame) f JOIN z ON z.idx BETWEEN f.frame * {HOP} AND f.frame * {HOP} + {SIZE - 1})"""
PSPEC = f"""{PFR}, pr AS (SELECT signal_id, frame, k.bin, sum(y * (0.5 - 0.5 * cos(2 * pi() * i / {SIZE - 1})) * cos(2 * pi() * k.bin * i / {SIZE})) AS re, sum(y * (0.5 - 0.5 * cos(2 * pi() * i / {SIZE - 1})) * sin(2 * pi() * k.bin * i / {SIZE})) AS im
  FROM pf CROSS JOIN (SELECT unnest(range(0, {SIZE // 2 + 1})) AS bin) k GROUP BY 1, 2, 3), ps AS (SELECT signal_id, frame, bin, sqrt(re * re + im * im) AS m FROM pr)"""
FS = {"frame_size": SIZE, "hop_size": HOP}
BANK = P.FilteredSpectrogram(**FS, num_bands=6, fmin=1.0, sample_rate=SR)
PBANK = spectra.values(BANK.filterbank)
add("processor_framed_signal", matrix(P.FramedSignal(SIZE, HOP), "i"), f"WITH {PFR} SELECT signal_id, frame, CAST(i AS BIGINT) AS i, {R('y')} AS v FROM pf")
add("processor_spectrogram", matrix(P.Spectrogram(**FS)), f"WITH {PSPEC} SELECT signal_id, frame, bin, {R('m')} AS v FROM ps")
add("processor_filtered_spectrogram", matrix(BANK, "band"), f"WITH {PSPEC} SELECT signal_id, frame, band, {R('sum(w * m)')} AS v FROM ps JOIN {PBANK} fb USING (bin) GROUP BY 1, 2, 3")
add("processor_log_spectrogram", matrix(P.LogarithmicFilteredSpectrogram(**FS, num_bands=6, fmin=1.0, sample_rate=SR), "band"), f"WITH {PSPEC} SELECT signal_id, frame, band, {R('ln(sum(w * m) + 1)')} AS v FROM ps JOIN {PBANK} fb USING (bin) GROUP BY 1, 2, 3")
add("processor_chroma_deep", matrix(P.ChromaProcessor("deep", 10.0, 2048.0)))
add("processor_chroma_clp", matrix(P.ChromaProcessor("clp", 10.0, 2048.0)))
add("processor_activation", scalars(lambda y: enumerate(P.ActivationProcessor(1.0, SR, SIZE)(y)), "frame bigint, v double"))
add("processor_downbeat_activation", matrix(lambda y: P.DownBeatActivation.of(np.minimum(y / 10, 1)), "k"), f"WITH {SIG} SELECT signal_id, idx AS frame, k, {R('CASE k WHEN 0 THEN 1 - least(y / 10, 1) WHEN 1 THEN 0.6 * least(y / 10, 1) ELSE 0.4 * least(y / 10, 1) END', 6)} AS v FROM sig CROSS JOIN (SELECT unnest(range(0, 3)) AS k)")
add("processor_beats", scalars(lambda y: ((float(t),) for t in P.BeatTracking(40.0)(np.clip(y / 5, 0, 1))), "time double"))
add("processor_downbeats", scalars(lambda y: ((float(t), int(p)) for t, p in P.DownBeatTracking(fps=40.0)(P.DownBeatActivation.of(np.clip(y / 6, 0, 1)))), "time double, position bigint"))
add("processor_onsets", scalars(lambda y: ((float(t),) for t in P.OnsetPeakPicking(0.1, fps=100.0)(y)), "time double"))
add("processor_tempo", scalars(lambda y: [tuple(map(float, P.TempoEstimation(40.0)(y)[0]))], "bpm double, strength double"))
add("processor_key", scalars(lambda y: enumerate(P.KeyRecognition()(y[:24])), "k bigint, v double"), f"WITH {SIG} SELECT signal_id, idx AS k, {R('y')} AS v FROM sig WHERE idx < 24")
add("processor_chords", scalars(lambda y: P.ChordRecognition()(spectral.power(y, 64, 8, None, False)[:, :25] + 1e-9), "start double, stop double, label string"))
add("processor_notes", scalars(lambda y: P.PianoNotes(threshold=1.0)(y[:, None]), "onset double, pitch bigint, duration double, velocity double"))
# --- windows and grids
_WSQL = {"hann": "0.5 - 0.5 * cos(2 * pi() * i / 32)", "hamming": "0.54 - 0.46 * cos(2 * pi() * i / 32)", "blackman": "0.42 - 0.5 * cos(2 * pi() * i / 32) + 0.08 * cos(4 * pi() * i / 32)", "bartlett": "1 - abs(2 * i / 32.0 - 1)", "rectangular": "1.0", "triangular": "1 - abs(2 * (i - 16.0) / 34)"}
add("windows", lambda s, d: s.createDataFrame([(k, i, float(v)) for k in _WSQL for i, v in enumerate(windows.WINDOWS[k](32))], "name string, i bigint, v double"), " UNION ALL ".join(f"SELECT '{k}' AS name, i, {R(v)} AS v FROM (SELECT unnest(range(0, 32)) AS i)" for k, v in _WSQL.items()))
add("window_kaiser", lambda s, d: s.createDataFrame([(i, float(v)) for i, v in enumerate(windows.kaiser(32))], "i bigint, v double"), f"WITH x AS (SELECT i, 6 * sqrt(1 - pow(2 * i / 32.0 - 1, 2)) AS h FROM (SELECT unnest(range(0, 32)) AS i)), t AS (SELECT i, pow(h, 2 * k) / pow(exp(lgamma(k + 1)), 2) AS v, pow(6.0, 2 * k) / pow(exp(lgamma(k + 1)), 2) AS top FROM x CROSS JOIN (SELECT unnest(range(0, 40)) AS k)) SELECT i, {R('sum(v) / sum(top)')} AS v FROM t GROUP BY 1")
_GRIDS = {"fft": banks.fft_frequencies(22050, 64), "cqt": banks.cqt_frequencies(36, 32.7), "semitone": banks.semitone_frequencies(), "tempo": banks.tempo_frequencies(65)[1:], "fourier_tempo": banks.fourier_tempo_frequencies(64), "mel": banks.mel_frequencies(10)}
_GSQL = {"fft": ("i * 22050 / 64.0", 33), "cqt": ("32.7 * pow(2, i / 12.0)", 36), "semitone": ("440 * pow(2, (i + 24 - 69) / 12.0)", 96), "tempo": ("60 * 22050.0 / (512 * (i + 1))", 64), "fourier_tempo": ("i * 22050 * 60 / (512 * 64.0)", 33)}
_MEL = "15 + 27 * ln(11025 / 1000.0) / ln(6.4)"
add("frequency_grids", lambda s, d: s.createDataFrame([(k, i, float(v)) for k, g in _GRIDS.items() for i, v in enumerate(g)], "grid string, i bigint, v double"), " UNION ALL ".join(f"SELECT '{k}' AS grid, i, {R(v)} AS v FROM (SELECT unnest(range(0, {n})) AS i)" for k, (v, n) in _GSQL.items()) + f" UNION ALL SELECT 'mel', i, {R('CASE WHEN m < 15 THEN 200 * m / 3 ELSE 1000 * exp(ln(6.4) / 27 * (m - 15)) END')} FROM (SELECT i, i * ({_MEL}) / 9 AS m FROM (SELECT unnest(range(0, 10)) AS i))")
add("times_like", lambda s, d: by_frame(sig(s, d), lambda y, sr: spectra.S(y)[:, :1]).select("signal_id", "frame", units.frames_to_time(F.col("frame"), SR, HOP).alias("time"), units.frames_to_samples(F.col("frame"), HOP).alias("sample")), f"WITH {SPEC} SELECT signal_id, frame, {R(f'frame * {HOP} / {SR}')} AS time, frame * {HOP} AS sample FROM spec WHERE bin = 0")
add("constant_q_wavelets", lambda s, d: s.createDataFrame([(k, i, float(v.real), float(v.imag)) for k, w in enumerate(banks.constant_q_wavelets(2048.0, 12, 12, 130.0)) for i, v in enumerate(w)], "band bigint, i bigint, re double, im double"))
add("logarithmic_filterbank", lambda s, d: s.createDataFrame([(int(b), int(k), float(w)) for (b, k), w in np.ndenumerate(banks.logarithmic(22050, 2048)) if w], "band bigint, bin bigint, w double"))
# --- columns
add("magphase", lambda s, d: lift(sig(s, d), lambda y: ((t, k, z.real, z.imag) for t, r in enumerate(spectral.stft_complex(y, SIZE, HOP, None, False)) for k, z in enumerate(r[1:-1])), ["samples"], "frame bigint, bin bigint, re double, im double").select("signal_id", "frame", "bin", F.hypot("re", "im").alias("mag"), (F.col("re") / F.hypot("re", "im")).alias("c"), (F.col("im") / F.hypot("re", "im")).alias("s")), f"WITH {SPEC} SELECT signal_id, frame, bin - 1 AS bin, {R('sqrt(re * re + im * im)')} AS mag, {R('re / sqrt(re * re + im * im)')} AS c, {R('im / sqrt(re * re + im * im)')} AS s FROM reim WHERE bin BETWEEN 1 AND {SIZE // 2 - 1}")
add("apply_a_weighting", lambda s, d: matrix(spectra.S)(s, d).where("bin > 0").select("signal_id", "frame", "bin", (units.amplitude_to_db(F.col("v")) + units.a_weighting(F.col("bin") * 500.0)).alias("v")), f"""WITH {SPEC} SELECT signal_id, frame, bin, {R('20 * log10(greatest(m, 1e-5)) + 2.0 + 20 * log10(pow(12194, 2) * pow(bin * 500.0, 4) / ((pow(bin * 500.0, 2) + pow(20.6, 2)) * sqrt((pow(bin * 500.0, 2) + pow(107.7, 2)) * (pow(bin * 500.0, 2) + pow(737.9, 2))) * (pow(bin * 500.0, 2) + pow(12194, 2))))')} AS v FROM spec WHERE bin > 0""")
add("hourly_sum_reduce", lambda s, d: src.hourly_events(s, d).groupBy("signal_id").agg(F.count("*").alias("n"), F.sum("y").alias("s")), f"WITH {SIG} SELECT signal_id, count(*) AS n, {R('sum(y)')} AS s FROM sig GROUP BY 1")
