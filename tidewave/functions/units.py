"""Scalar conversions as column expressions. Values that have no result give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def hz_to_mel(f: Column, htk: bool = False) -> Column:
    if htk:
        return 2595 * F.log10(1 + f / 700)
    return F.when(f < 1000, f * 3 / 200).otherwise(15 + F.log(f / 1000) * (27 / math.log(6.4)))


def mel_to_hz(m: Column, htk: bool = False) -> Column:
    if htk:
        return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)
    return F.when(m < 15, m * 200 / 3).otherwise(1000 * F.exp((m - 15) * (math.log(6.4) / 27)))


def hz_to_midi(f: Column) -> Column:
    return F.when(f > 0, 12 * F.log2(f / 440) + 69)


def midi_to_hz(m: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (m - 69) / 12)


def hz_to_oct(f: Column, tuning: float = 440.0) -> Column:
    return F.when(f > 0, F.log2(f / (tuning / 16)))


def hz_to_octs(f: Column, tuning: float = 0.0, bpo: int = 12) -> Column:
    return hz_to_oct(f, 440 * 2 ** (tuning / bpo))


def octs_to_hz(o: Column, tuning: float = 0.0, bpo: int = 12) -> Column:
    return F.pow(F.lit(2.0), o) * (440 * 2 ** (tuning / bpo) / 16)


def midi_to_note(m: Column) -> Column:
    """Rounded away from zero at halves; octaves by floor division."""
    n = F.round(m).cast("bigint")
    return F.concat(F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod(n, F.lit(12)) + 1).cast("int")), F.floor(n / 12 - 1).cast("bigint").cast("string"))


def note_to_midi(s: Column) -> Column:
    """A letter, sharps and flats in either spelling, and an octave (0 without one); null for anything else."""
    pattern = "^([A-Ga-g])([#b♯♭]*)(-?[0-9]+)?$"
    letter = F.upper(F.regexp_extract(s, pattern, 1))
    marks = F.regexp_extract(s, pattern, 2)
    base = F.when(letter == "C", 0).when(letter == "D", 2).when(letter == "E", 4).when(letter == "F", 5).when(letter == "G", 7).when(letter == "A", 9).when(letter == "B", 11)
    shift = F.length(F.regexp_replace(marks, "[^#♯]", "")) - F.length(F.regexp_replace(marks, "[^b♭]", ""))
    octave = F.regexp_extract(s, pattern, 3)
    return F.when(letter != "", base + shift + 12 * (F.when(octave == "", 0).otherwise(F.try_to_number(octave, F.lit("S999")).cast("int")) + 1)).cast("double")


def hz_to_note(f: Column) -> Column:
    return midi_to_note(hz_to_midi(f))


def note_to_hz(s: Column) -> Column:
    return midi_to_hz(note_to_midi(s))


def times_to_frames(t: Column, sr: float = 22050, hop: int = 512) -> Column:
    return F.floor(t * sr / hop)


def frames_to_time(f: Column, sr: float = 22050, hop: int = 512) -> Column:
    return f * hop / sr


def times_to_samples(t: Column, sr: float = 22050) -> Column:
    return F.floor(t * sr)


def samples_to_time(s: Column, sr: float = 22050) -> Column:
    return s / sr


def frames_to_samples(f: Column, hop: int = 512) -> Column:
    return f * hop


def samples_to_frames(s: Column, hop: int = 512) -> Column:
    return F.floor(s / hop)


def a_weighting(f: Column) -> Column:
    return _weight(f, (12194.0, 20.6, 107.7, 737.9), "a") + 2.0


def b_weighting(f: Column) -> Column:
    return _weight(f, (12194.0, 20.6, 158.5), "b") + 0.17


def c_weighting(f: Column) -> Column:
    return _weight(f, (12194.0, 20.6), "c") + 0.06


def _weight(f: Column, poles, kind: str) -> Column:
    s = f * f
    c = [p * p for p in poles]
    log = lambda x: F.log10(x)
    out = math.log10(c[0]) - log(s + c[0]) - log(s + c[1])
    if kind == "a":
        out = out + 2 * log(s) - 0.5 * log(s + c[2]) - 0.5 * log(s + c[3])
    elif kind == "b":
        out = out + 1.5 * log(s) - 0.5 * log(s + c[2])
    else:
        out = out + log(s)
    return F.when(f > 0, 20 * out)


def d_weighting(f: Column) -> Column:
    s = f * f
    h = ((1037918.48 - s) * (1037918.48 - s) + 1080768.16 * s) / ((9837328 - s) * (9837328 - s) + 11723776 * s)
    return F.when(f > 0, 20 * F.log10(f / 6.8966888496476e-5 * F.sqrt(h / ((s + 79919.29) * (s + 1345600)))))


def amplitude_to_db(x: Column, top: Column | None = None, ref: float = 1.0, amin: float = 1e-5, top_db: float | None = 80.0) -> Column:
    """`top` is the greatest x of the whole tensor, such as a window maximum."""
    return _db(x, top, ref, amin, top_db, 20)


def power_to_db(x: Column, top: Column | None = None, ref: float = 1.0, amin: float = 1e-10, top_db: float | None = 80.0) -> Column:
    return _db(x, top, ref, amin, top_db, 10)


def _db(x, top, ref, amin, top_db, scale):
    db = lambda v: scale * F.log10(F.greatest(v, F.lit(amin)) / ref)
    return db(x) if top is None or not top_db or top_db <= 0 else F.greatest(db(x), db(top) - top_db)


def db_to_amplitude(x: Column, ref: float = 1.0) -> Column:
    return ref * F.pow(F.lit(10.0), x / 20)


def db_to_power(x: Column, ref: float = 1.0) -> Column:
    return ref * F.pow(F.lit(10.0), x / 10)
