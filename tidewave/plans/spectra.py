"""Queries of framing, spectral and feature operators over the hourly event signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import banks, units
from ..operators import features, rhythm, scans, spectral
from ..operators.lift import by_frame, lift, tidy
from ..sources import signals as src
from . import blocked

SIZE, HOP, SR, MELS = 32, 8, 32.0, 8
QUERIES, ORACLE_SQL = {}, {}

#: the adapter: signal_id, idx (hour from the table's first one on), y
SIG = """hourly AS (SELECT event_type AS signal_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, sum(value) / CAST(97.317 AS DOUBLE) AS y FROM events GROUP BY 1, 2),
base AS (SELECT signal_id, hour - (SELECT min(hour) FROM hourly) AS idx, y FROM hourly WHERE hour IS NOT NULL),
sig AS (SELECT s.signal_id, g.idx, coalesce(b.y, 0) AS y FROM (SELECT DISTINCT signal_id FROM base) s
  CROSS JOIN (SELECT unnest(range(0, (SELECT max(idx) + 1 FROM base))) AS idx) g LEFT JOIN base b ON b.signal_id = s.signal_id AND b.idx = g.idx)"""
#: samples of a signal
N = "(SELECT max(idx) + 1 FROM base)"
FRAMED = f"""{SIG},
fr AS (SELECT s.signal_id, f.frame, s.idx - f.frame * {HOP} AS i, s.y FROM (SELECT unnest(range(0, ({N} - {SIZE}) // {HOP} + 1)) AS frame) f JOIN sig s ON s.idx BETWEEN f.frame * {HOP} AND f.frame * {HOP} + {SIZE - 1})"""
SPEC = f"""{FRAMED},
reim AS (SELECT signal_id, frame, k.bin, sum(y * (0.5 - 0.5 * cos(2 * pi() * i / {SIZE})) * cos(2 * pi() * k.bin * i / {SIZE})) AS re,
  -sum(y * (0.5 - 0.5 * cos(2 * pi() * i / {SIZE})) * sin(2 * pi() * k.bin * i / {SIZE})) AS im
  FROM fr CROSS JOIN (SELECT unnest(range(0, {SIZE // 2 + 1})) AS bin) k GROUP BY 1, 2, 3),
spec AS (SELECT signal_id, frame, bin, sqrt(re * re + im * im) AS m, bin * {SR} / {SIZE} AS f FROM reim)"""


def values(m: np.ndarray) -> str:
    """A bank as a VALUES table (band, bin, w)."""
    rows = ", ".join(f"({b}, {k}, CAST({float(m[b, k])!r} AS DOUBLE))" for b in range(m.shape[0]) for k in range(m.shape[1]))
    return f"(SELECT * FROM (VALUES {rows}) t(band, bin, w))"


def add(name: str, query, sql: str | None = None, digits: int = 6, rounded=F.round) -> None:
    """Registers a query; double columns are rounded on both sides, here by rounded(column, digits)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[(rounded(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def scaled(c, digits: int = 6):
    """A column rounded as SQL's round() does it: scaled, halves away from zero. F.round goes through decimal text, which takes longer than making the row."""
    c, by = F.col(c), 10.0**digits
    return F.when(F.abs(c) < 2.0**51 / by, F.signum(c) * F.floor(F.abs(c) * by + 0.5) / by).otherwise(F.round(c, digits))


def R(x: str, digits: int = 6) -> str:  # noqa: N802
    return f"round({x}, {digits}) + 0.0"


def sig(spark, d):
    return src.event_signals(spark, d, SR)


def S(y):  # noqa: N802
    return spectral.stft(y, SIZE, HOP, None, False)


def per_frame(kernel):
    """A kernel's (frame, bin) values as rows."""
    return lambda s, d: tidy(by_frame(sig(s, d), lambda y, sr: kernel(y)))


def per_frame_one(kernel):
    return lambda s, d: by_frame(sig(s, d), lambda y, sr: kernel(y)).select("signal_id", "frame", F.col("v")[0].alias("v"))


F_HZ = banks.fft_frequencies(SR, SIZE)
MEL = banks.mel(SR, SIZE, MELS)


def frame_rms(spark, d):
    """Framing and RMS by array functions alone."""
    s = sig(spark, d)
    starts = F.sequence(F.lit(0), F.size("samples") - SIZE, F.lit(HOP))
    framed = s.select("signal_id", F.posexplode(F.transform(starts, lambda a: F.slice("samples", a + 1, SIZE))).alias("frame", "v"))
    energy = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rms = F.sqrt(energy / SIZE)
    top = F.max("rms").over(Window.partitionBy("signal_id"))
    return framed.select("signal_id", F.col("frame").cast("bigint").alias("frame"), rms.alias("rms")).withColumn("db", units.amplitude_to_db(F.col("rms"), top))


add("frame_rms", frame_rms, f"""WITH {FRAMED}, r AS (SELECT signal_id, frame, sqrt(avg(y * y)) AS rms FROM fr GROUP BY 1, 2)
SELECT signal_id, frame, {R('rms')} AS rms, {R('greatest(20 * log10(greatest(rms, 1e-5)), 20 * log10(greatest(max(rms) OVER (PARTITION BY signal_id), 1e-5)) - 80)')} AS db FROM r""")
add("frame", lambda s, d: tidy(by_frame(sig(s, d), lambda y, sr: spectral.frames(y, SIZE, HOP)), bin_name="i").select("signal_id", "frame", F.col("i").cast("bigint").alias("i"), "v"), f"WITH {FRAMED} SELECT signal_id, frame, i, {R('y')} AS v FROM fr")
add("zero_crossing_rate", per_frame_one(lambda y: features.zero_crossing_rate(y - 1.0, SIZE, HOP, False)), f"""WITH {FRAMED}, z AS (SELECT signal_id, frame, i, (y - 1.0 < 0) AS neg, lag(y - 1.0 < 0) OVER (PARTITION BY signal_id, frame ORDER BY i) AS before FROM fr)
SELECT signal_id, frame, {R(f'sum(CASE WHEN neg <> before THEN 1 ELSE 0 END) / {SIZE}.0')} AS v FROM z GROUP BY 1, 2""")
add("zero_crossings", lambda s, d: src.hourly_events(s, d).withColumn("c", F.coalesce((F.col("y") < 1) != (F.lag("y").over(Window.partitionBy("signal_id").orderBy("idx")) < 1), F.lit(False))).select("signal_id", "idx", "c"), f"WITH {SIG} SELECT signal_id, idx, coalesce((y < 1) <> (lag(y) OVER (PARTITION BY signal_id ORDER BY idx) < 1), false) AS c FROM sig")
add("preemphasis", lambda s, d: src.hourly_events(s, d).select("signal_id", "idx", (F.col("y") - 0.97 * F.coalesce(F.lag("y").over(Window.partitionBy("signal_id").orderBy("idx")), F.lit(0.0))).alias("v")), f"WITH {SIG} SELECT signal_id, idx, {R('y - 0.97 * coalesce(lag(y) OVER (PARTITION BY signal_id ORDER BY idx), 0)')} AS v FROM sig")
add("deemphasis", blocked.recurrence(scans.one_pole(0.9048374180359595)), f"WITH {SIG} SELECT a.signal_id, a.idx, {R('sum(pow(CAST(0.9048374180359595 AS DOUBLE), a.idx - b.idx) * b.y)')} AS v FROM sig a JOIN sig b ON a.signal_id = b.signal_id AND b.idx <= a.idx GROUP BY 1, 2")
add("stft_magnitude", per_frame(S), f"WITH {SPEC} SELECT signal_id, frame, bin, {R('m')} AS v FROM spec")
add("stft_complex", lambda s, d: lift(sig(s, d), lambda y: ((t, k, z.real, z.imag) for t, r in enumerate(spectral.stft_complex(y, SIZE, HOP, None, False)) for k, z in enumerate(r)), ["samples"], "frame bigint, bin bigint, re double, im double"), f"WITH {SPEC} SELECT signal_id, frame, bin, {R('re')} AS re, {R('im')} AS im FROM reim")
add("power_spectrogram", per_frame(lambda y: spectral.power(y, SIZE, HOP, None, False)), f"WITH {SPEC} SELECT signal_id, frame, bin, {R('m * m')} AS v FROM spec")
add("stft_halo", lambda s, d: tidy(blocked.frames(s, d, SIZE, HOP).select("signal_id", "frame", blocked.magnitude().alias("v"))), f"WITH {SPEC} SELECT signal_id, frame, bin, {R('m')} AS v FROM spec")
add("istft_halo", lambda s, d: blocked.istft(s, d, SIZE, HOP), f"WITH {SIG} SELECT signal_id, idx, {R('y')} AS v FROM sig")
add("stft_relational", lambda s, d: stft_relational(s, d), f"WITH {SPEC} SELECT signal_id, frame, bin, {R('m')} AS v FROM spec")
MELSQL = f"mel AS (SELECT signal_id, frame, band, sum(w * m * m) AS v FROM spec JOIN {values(MEL)} fb USING (bin) GROUP BY 1, 2, 3)"
add("melspectrogram", lambda s, d: tidy(by_frame(sig(s, d), lambda y, sr: spectral.melspectrogram(y, SR, SIZE, HOP, MELS, center=False)), bin_name="band"), f"WITH {SPEC}, {MELSQL} SELECT signal_id, frame, band, {R('v')} AS v FROM mel")
DBSQL = "db AS (SELECT signal_id, frame, band, greatest(10 * log10(greatest(v, 1e-10)), 10 * log10(greatest(max(v) OVER (PARTITION BY signal_id), 1e-10)) - 80) AS v FROM mel)"
add("power_to_db", lambda s, d: tidy(by_frame(sig(s, d), lambda y, sr: spectral.power_to_db(spectral.melspectrogram(y, SR, SIZE, HOP, MELS, center=False))), bin_name="band"), f"WITH {SPEC}, {MELSQL}, {DBSQL} SELECT signal_id, frame, band, {R('v')} AS v FROM db")
add("mfcc", lambda s, d: tidy(by_frame(sig(s, d), lambda y, sr: spectral.mfcc(y, SR, 5, SIZE, HOP, MELS, False)), bin_name="coef"), f"WITH {SPEC}, {MELSQL}, {DBSQL} SELECT signal_id, frame, fb.band AS coef, {R('sum(w * v)')} AS v FROM db JOIN {values(banks.dct(5, MELS))} fb ON fb.bin = db.band GROUP BY 1, 2, 3")
add("spectral_centroid", per_frame_one(lambda y: features.centroid(S(y), F_HZ)), f"WITH {SPEC} SELECT signal_id, frame, {R('CASE WHEN sum(m) > 0 THEN sum(f * m) / sum(m) ELSE 0 END')} AS v FROM spec GROUP BY 1, 2")
add("spectral_bandwidth", per_frame_one(lambda y: features.bandwidth(S(y), F_HZ)), f"WITH {SPEC}, c AS (SELECT signal_id, frame, sum(f * m) / sum(m) AS c FROM spec GROUP BY 1, 2) SELECT signal_id, frame, {R('sqrt(sum(m * (f - c) * (f - c)) / sum(m))')} AS v FROM spec JOIN c USING (signal_id, frame) GROUP BY 1, 2")
add("spectral_rolloff", per_frame_one(lambda y: features.rolloff(S(y), F_HZ, 0.8512345)), f"WITH {SPEC}, r AS (SELECT signal_id, frame, f, sum(m) OVER (PARTITION BY signal_id, frame ORDER BY bin) AS c, sum(m) OVER (PARTITION BY signal_id, frame) AS t FROM spec) SELECT signal_id, frame, {R('min(f)')} AS v FROM r WHERE c >= 0.8512345 * t GROUP BY 1, 2")
add("spectral_flatness", per_frame_one(lambda y: features.flatness(S(y))), f"WITH {SPEC} SELECT signal_id, frame, {R('CASE WHEN sum(m) < 1e-10 THEN 0 ELSE exp(avg(ln(greatest(m * m, 1e-10)))) / avg(greatest(m * m, 1e-10)) END')} AS v FROM spec GROUP BY 1, 2")
add("spectral_contrast", per_frame(lambda y: features.contrast(S(y), F_HZ, 3, 2.0)), f"""WITH {SPEC}, e(band, lo, hi) AS (VALUES (0, 0, 2), (1, 2, 4), (2, 4, 8), (3, 8, 16)), b AS (SELECT signal_id, frame, band, m FROM spec JOIN e ON f >= lo AND f < hi)
SELECT signal_id, frame, band AS bin, {R('10 * log10(greatest(max(m), 1e-10)) - 10 * log10(greatest(min(m), 1e-10))')} AS v FROM b GROUP BY 1, 2, 3""")
# edges 0, 2.5, 5, 16 Hz at 1 Hz a bin, halves up: bins 0-2, 3-4, 5-15; of 3, 2 and 11 bins the outermost 1, 1 and 3
add("spectral_contrast_shares", per_frame(lambda y: features.contrast(S(y), F_HZ, 2, 2.5, 0.3)), f"""WITH {SPEC}, e(band, lo, hi, n, q) AS (VALUES (0, 0, 3, 3, 1), (1, 3, 5, 2, 1), (2, 5, 16, 11, 3)), b AS (SELECT signal_id, frame, band, n, q, m, row_number() OVER (PARTITION BY signal_id, frame, band ORDER BY m) AS r FROM spec JOIN e ON spec.bin >= lo AND spec.bin < hi)
SELECT signal_id, frame, band AS bin, {R('10 * log10(greatest(avg(m) FILTER (WHERE r > n - q), 1e-10)) - 10 * log10(greatest(avg(m) FILTER (WHERE r <= q), 1e-10))')} AS v FROM b GROUP BY 1, 2, 3""")
CHROMA = banks.chroma(SR, SIZE)
CHSQL = f"ch AS (SELECT signal_id, frame, band AS c, sum(w * m * m) AS v FROM spec JOIN {values(CHROMA)} fb USING (bin) GROUP BY 1, 2, 3)"
add("chroma_stft", lambda s, d: tidy(by_frame(sig(s, d), lambda y, sr: features.chroma_stft(y, SR, SIZE, HOP, center=False)), bin_name="c"), f"WITH {SPEC}, {CHSQL} SELECT signal_id, frame, c, {R('v')} AS v FROM ch")
add("tonnetz", lambda s, d: tidy(by_frame(sig(s, d), lambda y, sr: features.tonnetz(features.chroma_stft(y, SR, SIZE, HOP, center=False))), bin_name="axis"), f"""WITH {SPEC}, {CHSQL}, t AS (SELECT signal_id, frame, c, v / sum(v) OVER (PARTITION BY signal_id, frame) AS v FROM ch)
SELECT signal_id, frame, a.axis, {R("sum(v * CASE a.axis WHEN 0 THEN sin(pi() * 7 * c / 6) WHEN 1 THEN cos(pi() * 7 * c / 6) WHEN 2 THEN sin(pi() * 3 * c / 2) WHEN 3 THEN cos(pi() * 3 * c / 2) WHEN 4 THEN sin(pi() * 2 * c / 3) / 2 ELSE cos(pi() * 2 * c / 3) / 2 END)")} AS v FROM t CROSS JOIN (SELECT unnest(range(0, 6)) AS axis) a GROUP BY 1, 2, 3""")
add("chroma_normalized", lambda s, d: tidy(by_frame(sig(s, d), lambda y, sr: features.chroma_stft(y, SR, SIZE, HOP, norm=np.inf, center=False)), bin_name="c"), f"WITH {SPEC}, {CHSQL} SELECT signal_id, frame, c, {R('v / max(v) OVER (PARTITION BY signal_id, frame)')} AS v FROM ch")
VQ = banks.variable_q(SR, SIZE, 12, 6, 3.0)
add("cqt", lambda s, d: tidy(by_frame(sig(s, d), lambda y, sr: np.sqrt(spectral.power(y, SIZE, HOP, None, False) @ VQ.T)), bin_name="band"), f"WITH {SPEC} SELECT signal_id, frame, band, {R('sqrt(sum(w * m * m))')} AS v FROM spec JOIN {values(VQ)} fb USING (bin) GROUP BY 1, 2, 3")
add("chroma_cqt_fold", lambda s, d: tidy(by_frame(sig(s, d), lambda y, sr: features.fold(spectral.power(y, SIZE, HOP, None, False) @ VQ.T, 6, 3)), bin_name="c"), f"WITH {SPEC} SELECT signal_id, frame, (band % 6) // 2 AS c, {R('sum(w * m * m)')} AS v FROM spec JOIN {values(VQ)} fb USING (bin) GROUP BY 1, 2, 3")
add("poly_features", per_frame(lambda y: features.poly_features(S(y), F_HZ)), f"WITH {SPEC} SELECT signal_id, frame, p AS bin, {R('CASE p WHEN 0 THEN regr_slope(m, f) ELSE regr_intercept(m, f) END')} AS v FROM spec CROSS JOIN (SELECT unnest(range(0, 2)) AS p) GROUP BY signal_id, frame, p")
add("stack_memory", per_frame(lambda y: features.stack_memory(S(y)[:, :3], 2, 2)), f"""WITH {SPEC} SELECT signal_id, frame, bin + 3 * k AS bin, {R('CASE k WHEN 0 THEN m ELSE coalesce(lag(m, 2) OVER (PARTITION BY signal_id, bin, k ORDER BY frame), 0) END')} AS v FROM spec CROSS JOIN (SELECT unnest(range(0, 2)) AS k) WHERE bin < 3""")
add("delta", per_frame(lambda y: features.delta(S(y)[:, :4], 5)), f"""WITH {SPEC}, w AS (SELECT signal_id, frame, bin, (2 * lead(m, 2) OVER o + lead(m) OVER o - lag(m) OVER o - 2 * lag(m, 2) OVER o) / 10 AS v, max(frame) OVER (PARTITION BY signal_id) AS n FROM spec WHERE bin < 4 WINDOW o AS (PARTITION BY signal_id, bin ORDER BY frame))
SELECT a.signal_id, a.frame, a.bin, {R('b.v')} AS v FROM w a JOIN w b ON a.signal_id = b.signal_id AND a.bin = b.bin AND b.frame = least(greatest(a.frame, 2), a.n - 2)""")
add("onset_strength", per_frame_one(lambda y: rhythm.onset_strength(y, SR, HOP, SIZE, MELS, center=False)), f"WITH {SPEC}, {MELSQL}, {DBSQL}, d AS (SELECT signal_id, frame, greatest(0, coalesce(v - lag(v) OVER (PARTITION BY signal_id, band ORDER BY frame), 0)) AS d FROM db) SELECT signal_id, frame, {R('avg(d)')} AS v FROM d GROUP BY 1, 2")
add("superflux", per_frame_one(lambda y: rhythm.superflux(spectral.power_to_db(spectral.melspectrogram(y, SR, SIZE, HOP, MELS, center=False)))), f"""WITH {SPEC}, {MELSQL}, {DBSQL}, x AS (SELECT signal_id, frame, band, v, max(v) OVER (PARTITION BY signal_id, frame ORDER BY band ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top FROM db),
d AS (SELECT signal_id, frame, greatest(0, coalesce(v - lag(top) OVER (PARTITION BY signal_id, band ORDER BY frame), 0)) AS d FROM x) SELECT signal_id, frame, {R('sum(d)')} AS v FROM d GROUP BY 1, 2""")
add("high_frequency_content", per_frame_one(lambda y: rhythm.high_frequency_content(S(y))), f"WITH {SPEC} SELECT signal_id, frame, {R('sum(bin * m * m)', 5)} AS v FROM spec GROUP BY 1, 2", 5)
add("kl_divergence", per_frame_one(lambda y: rhythm.kl_divergence(S(y))), f"""WITH {SPEC}, p AS (SELECT signal_id, frame, bin, (m + 1e-10) / sum(m + 1e-10) OVER (PARTITION BY signal_id, frame) AS p FROM spec), q AS (SELECT *, lag(p) OVER (PARTITION BY signal_id, bin ORDER BY frame) AS q FROM p)
SELECT signal_id, frame, {R('greatest(0, coalesce(sum(p * ln(p / q)), 0))')} AS v FROM q GROUP BY 1, 2""")
# without the first and the last bin, whose phase is only a sign
add("complex_flux", per_frame_one(lambda y: rhythm.complex_flux(spectral.stft_complex(y, SIZE, HOP, None, False)[:, 1:-1])), f"""WITH {SPEC}, a AS (SELECT signal_id, frame, bin, re, im, lag(sqrt(re * re + im * im)) OVER o AS m1, 2 * lag(atan2(im, re)) OVER o - lag(atan2(im, re), 2) OVER o AS ph FROM reim WINDOW o AS (PARTITION BY signal_id, bin ORDER BY frame))
SELECT signal_id, frame, {R('coalesce(sum(CASE WHEN bin BETWEEN 1 AND 15 THEN sqrt(pow(re - m1 * cos(ph), 2) + pow(im - m1 * sin(ph), 2)) END), 0)')} AS v FROM a GROUP BY 1, 2""")
add("pcen", lambda s, d: blocked.pcen(s, d, SIZE, HOP, SR, 1.0), None)


def stft_relational(spark, d):
    """The transform as a join with its basis and a sum: what an equi-join matrix product looks like."""
    i, k = np.meshgrid(np.arange(SIZE), np.arange(SIZE // 2 + 1), indexing="ij")
    w = 0.5 - 0.5 * np.cos(2 * np.pi * i / SIZE)
    basis = spark.createDataFrame([(int(a), int(b), float(c), float(s)) for a, b, c, s in zip(i.ravel(), k.ravel(), (w * np.cos(2 * np.pi * k * i / SIZE)).ravel(), (-w * np.sin(2 * np.pi * k * i / SIZE)).ravel())], "i bigint, bin bigint, c double, s double")
    # each sample belongs to at most SIZE / HOP frames
    y = src.hourly_events(spark, d)
    y = y.join(F.broadcast(y.agg((F.max("idx") + 1).alias("n"))))  # one row
    last = F.least(F.floor(F.col("idx") / HOP), F.floor((F.col("n") - SIZE) / HOP))
    first = F.greatest(F.ceil((F.col("idx") - SIZE + 1) / HOP), F.lit(0))
    fr = y.where(first <= last).select("signal_id", F.explode(F.sequence(first, last)).alias("frame"), "idx", "y").select("signal_id", "frame", (F.col("idx") - F.col("frame") * HOP).alias("i"), "y")
    out = fr.join(F.broadcast(basis), "i").groupBy("signal_id", "frame", "bin").agg(F.sum(F.col("y") * F.col("c")).alias("re"), F.sum(F.col("y") * F.col("s")).alias("im"))
    return out.select("signal_id", "frame", "bin", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("v"))


PCEN_T = SR / (HOP * 2 * np.pi)  # frames of a time constant of one second, over 2 pi
PCEN_B = float((np.sqrt(1 + 4 * PCEN_T**2) - 1) / (2 * PCEN_T**2))
ORACLE_SQL["pcen"] = f"""WITH {SPEC}, k AS (SELECT a.signal_id, a.frame, a.bin, any_value(a.m) AS s, sum(pow(CAST({1 - PCEN_B!r} AS DOUBLE), a.frame - b.frame) * CASE WHEN b.frame = 0 THEN 1 ELSE {PCEN_B!r} END * b.m) AS e FROM spec a JOIN spec b ON a.signal_id = b.signal_id AND a.bin = b.bin AND b.frame <= a.frame GROUP BY 1, 2, 3)
SELECT signal_id, frame, bin, {R('sqrt(s / pow(1e-6 + e, 0.98) + 2) - sqrt(CAST(2 AS DOUBLE))')} AS v FROM k"""

# operators without a form in SQL, or an iterative one: kernels on every signal
add("istft_round_trip", lambda s, d: lift(sig(s, d), lambda y: [(float(np.abs(spectral.istft(spectral.stft_complex(y, SIZE, HOP), HOP, length=len(y)) - y).max()),)], ["samples"], "error double"), f"WITH {SIG} SELECT DISTINCT signal_id, CAST(0 AS DOUBLE) AS error FROM sig")
add("reassigned_spectrogram", lambda s, d: lift(sig(s, d), lambda y: ((t, list(a), list(b), list(c)) for t, (a, b, c) in enumerate(zip(*spectral.reassigned(y, SR, SIZE, HOP)))), ["samples"], "frame bigint, mag array<double>, freq array<double>, time array<double>"))
for _name, _kernel in {
    "vqt": lambda y: spectral.vqt(y, 2048.0, 64, 32.7, None, 12, 2.0, 256), "hybrid_cqt": lambda y: spectral.hybrid_cqt(y, 2048.0, 64, 32.7, None, 12, 256), "chroma_cqt": lambda y: features.chroma_cqt(y, 2048.0, 512), "chroma_vqt": lambda y: features.chroma_vqt(y, 2048.0, 512, gamma=1.0),
    "chroma_cens": lambda y: features.cens(features.chroma_cqt(y, 2048.0, 64)), "deep_chroma_context": lambda y: features.deep_chroma_context(S(y)), "fourier_tempogram": lambda y: rhythm.fourier_tempogram(y, 96), "tempogram": lambda y: rhythm.tempogram(y, 96), "phase_vocoder": lambda y: np.abs(spectral.phase_vocoder(spectral.stft_complex(y, SIZE, HOP), 1.5, HOP)),
    "mel_to_stft": lambda y: spectral.mel_to_stft(spectral.melspectrogram(y, SR, SIZE, HOP, MELS), SR, SIZE), "mfcc_to_mel": lambda y: spectral.mfcc_to_mel(spectral.mfcc(y, SR, 5, SIZE, HOP, MELS), MELS), "interp_harmonics": lambda y: features.interp_harmonics(S(y), F_HZ, (1, 2, 3)).reshape(-1, 3 * len(F_HZ)), "salience": lambda y: features.salience(S(y), F_HZ, (1, 2, 3)),
    "f0_harmonics": lambda y: features.f0_harmonics(S(y), F_HZ, np.full(len(S(y)), 2.0), (1, 2, 3)), "tempogram_ratio": lambda y: features.tempogram_ratio(rhythm.tempogram(y, 96), banks.tempo_frequencies(96, 1, 8.0)), "log_filterbank": lambda y: S(y) @ banks.logarithmic(SR, SIZE, 6, 2.0, 14.0, 8.0).T,
}.items():
    add(_name, per_frame(_kernel))
SEGMENT = f"{SIG}, seg AS (SELECT signal_id, frame, idx - frame + 48 AS i, y * 0.5 * (1 - cos(2 * pi() * (idx - frame + 48) / 96)) AS v FROM sig JOIN (SELECT unnest(range(0, {N})) AS frame) f ON idx BETWEEN frame - 48 AND frame + 47)"
LOCAL_ACF = f"{SEGMENT}, acf AS (SELECT a.signal_id, a.frame, b.i - a.i AS lag, sum(a.v * b.v) AS v FROM seg a JOIN seg b ON a.signal_id = b.signal_id AND a.frame = b.frame AND b.i >= a.i GROUP BY 1, 2, 3), tg AS (SELECT s.signal_id, s.idx AS frame, g.lag, coalesce(acf.v, 0) AS v FROM sig s CROSS JOIN (SELECT unnest(range(0, 96)) AS lag) g LEFT JOIN acf ON acf.signal_id = s.signal_id AND acf.frame = s.idx AND acf.lag = g.lag)"
ORACLE_SQL["tempogram"] = f"WITH {LOCAL_ACF} SELECT signal_id, frame, lag AS bin, {R('v')} AS v FROM tg"
ORACLE_SQL["fourier_tempogram"] = f"WITH {SEGMENT} SELECT signal_id, frame, bin, {R('CASE WHEN bin = 0 THEN 2 ELSE 4 END * sqrt(pow(sum(v * cos(2 * pi() * bin * i / 128)), 2) + pow(sum(v * sin(2 * pi() * bin * i / 128)), 2)) / 128')} AS v FROM seg CROSS JOIN (SELECT unnest(range(0, 49)) AS bin) GROUP BY 1, 2, 3"
# a tempo of 120 k lies between the lags above and below 480 / (120 k), on a line in beats a minute
ORACLE_SQL["tempogram_ratio"] = f"""WITH {LOCAL_ACF}, k AS (SELECT bin, 120.0 * (bin + 1) AS bpm, CAST(ceil(4 / (bin + 1)) AS BIGINT) AS slow, CAST(floor(4 / (bin + 1)) AS BIGINT) AS fast FROM (SELECT unnest(range(0, 4)) AS bin)),
met AS (SELECT a.signal_id, a.frame, k.bin, CASE WHEN slow = fast THEN a.v ELSE a.v + (b.v - a.v) * (bpm - 480.0 / slow) / (480.0 / fast - 480.0 / slow) END AS v FROM k JOIN tg a ON a.lag = slow JOIN tg b ON b.signal_id = a.signal_id AND b.frame = a.frame AND b.lag = fast),
top AS (SELECT *, max(abs(v)) OVER (PARTITION BY signal_id, frame) AS top FROM met) SELECT signal_id, frame, bin, {R('CASE WHEN top > 1e-10 THEN v / top ELSE v END')} AS v FROM top"""
# the magnitude at h times a frequency: on a line between the bins around it, 0 beyond the last
HARMONIC = f"""{SPEC}, hm AS (SELECT s.signal_id, s.frame, s.bin, h.h, coalesce(lo.m + (s.f * h.h * {SIZE} / {SR} - lo.bin) * (coalesce(hi.m, lo.m) - lo.m), 0) AS v FROM spec s CROSS JOIN (SELECT unnest([1, 2, 3]) AS h) h
 LEFT JOIN spec lo ON lo.signal_id = s.signal_id AND lo.frame = s.frame AND lo.bin = CAST(floor(s.f * h.h * {SIZE} / {SR}) AS BIGINT) LEFT JOIN spec hi ON hi.signal_id = s.signal_id AND hi.frame = s.frame AND hi.bin = lo.bin + 1)"""
ORACLE_SQL["interp_harmonics"] = f"WITH {HARMONIC} SELECT signal_id, frame, (h - 1) * {SIZE // 2 + 1} + bin AS bin, {R('v')} AS v FROM hm"
ORACLE_SQL["salience"] = f"WITH {HARMONIC} SELECT signal_id, frame, bin, {R('sum(v) / 3')} AS v FROM hm GROUP BY 1, 2, 3"
ORACLE_SQL["f0_harmonics"] = f"WITH {HARMONIC} SELECT signal_id, frame, h - 1 AS bin, {R('v')} AS v FROM hm WHERE bin * {SR} / {SIZE} = 2"
for _name, _kernel in {
    "griffinlim": lambda y: spectral.griffinlim(S(y), 8, HOP), "griffinlim_cqt": lambda y: spectral.griffinlim_cqt(spectral.cqt(y, 2048.0, 64, 32.7, None, 12, 256), 2048.0, 256, 64, 4, 32.7), "mel_to_audio": lambda y: spectral.mel_to_audio(spectral.melspectrogram(y, SR, SIZE, HOP, MELS), SR, SIZE, HOP, n_iter=4), "mfcc_to_audio": lambda y: spectral.mfcc_to_audio(spectral.mfcc(y, SR, 5, SIZE, HOP, MELS), SR, MELS, SIZE, HOP, 4),
    "resample": lambda y: spectral.resample(y, 24.0, 16.0), "autocorrelate": lambda y: spectral.autocorrelate(y, 48), "lpc": lambda y: spectral.lpc(y, 8),
}.items():
    add(_name, lambda s, d, k=_kernel: lift(sig(s, d), lambda y: enumerate(k(y)), ["samples"], "idx bigint, v double"))
ORACLE_SQL["autocorrelate"] = f"WITH {SIG} SELECT a.signal_id, b.idx - a.idx AS idx, {R('sum(a.y * b.y)')} AS v FROM sig a JOIN sig b ON a.signal_id = b.signal_id AND b.idx - a.idx BETWEEN 0 AND 47 GROUP BY 1, 2"
