"""Key, chord and note decoding kernels (numpy)."""

from __future__ import annotations

import numpy as np

from . import sequence

PITCHES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
KEYS = tuple(f"{p} {m}" for m in ("major", "minor") for p in PITCHES)
CHORDS = ("N", *(f"{p}:{m}" for m in ("maj", "min") for p in PITCHES))


def key_detect(act):
    """(index, label, is major) of 24 activations, or of the mean of a sequence of them."""
    a = np.asarray(act, float)
    a = a.mean(axis=0) if a.ndim == 2 else a
    i = int(a.argmax())
    return i, KEYS[i], i < 12


def relative_key(i):
    return 12 + (i + 9) % 12 if i < 12 else (i - 12 + 3) % 12


def chord_detect(act, self_bias=1.0):
    """Runs (start, end, label) of the best CRF path over 25 classes; staying has a bonus."""
    path, _ = sequence.crf_viterbi(np.log(np.maximum(act, sequence.TINY)), self_bias * np.eye(act.shape[1]))
    return [(a, b, CHORDS[k] if k < len(CHORDS) else "N") for a, b, k in sequence.runs(path)]


def chord_simple(act):
    return [(a, b, CHORDS[k] if k < len(CHORDS) else "N") for a, b, k in sequence.runs(act.argmax(axis=1))]


def _notes(on, act, shortest, low=21):
    out = []
    for p in range(on.shape[1]):
        for a, b, k in sequence.runs(on[:, p]):
            if k and b - a >= shortest:
                out.append((a, b, low + p, float(act[a:b, p].mean())))
    return sorted(out, key=lambda n: (n[0], n[2]))


def piano_threshold(act, threshold=0.5, shortest=3):
    """(onset, offset, midi, velocity) of runs over the threshold."""
    return _notes(act >= threshold, act, shortest)


def piano_hmm(act, p_on=0.01, p_off=0.05, shortest=3):
    """(onset, offset, midi, velocity) of the likeliest path of each pitch between off, where it is at first but for 1 %, and on."""
    trans, first = np.log([[1 - p_on, p_on], [p_off, 1 - p_off]]), np.log([0.99, 0.01])
    score = np.log(np.clip(np.stack([1 - act, act], axis=-1), 1e-7, 1 - 1e-7))
    on = np.stack([sequence.viterbi_log(score[:, k], first, trans)[0] for k in range(act.shape[1])], axis=1) if act.shape[1] else act
    return _notes(on == 1, act, shortest)


def note_name(midi):
    return f"{PITCHES[midi % 12]}{midi // 12 - 1}"
