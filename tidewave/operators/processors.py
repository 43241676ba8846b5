"""Processors in the time-major style: classes with parameters that are called on one signal or activation sequence.

Rates default to 44100 Hz and 441 samples a hop, activations to 100 frames a second.
Processors named after networks compute the curves that stand in for them here: no
network is run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions import banks
from . import effects, evaluate, features, harmony, pitch, rhythm, spectral  # noqa: F401


@dataclass(frozen=True)
class Signal:
    samples: np.ndarray
    sample_rate: float = 44100.0
    start: float = 0.0
    stop: float | None = None

    def __post_init__(self):
        a = int(self.start * self.sample_rate)
        b = None if self.stop is None else int(self.stop * self.sample_rate)
        object.__setattr__(self, "samples", np.asarray(self.samples, float)[a:b])


@dataclass(frozen=True)
class FramedSignal:
    frame_size: int = 2048
    hop_size: int = 441
    origin: str = "center"

    def __call__(self, y):
        return spectral.origin_frames(np.asarray(y, float), self.frame_size, self.hop_size, self.origin)


@dataclass(frozen=True)
class STFT:
    frame_size: int = 2048
    hop_size: int = 441
    window: object = np.hanning  # symmetric
    origin: str = "center"

    def __call__(self, y):
        return np.fft.rfft(FramedSignal(self.frame_size, self.hop_size, self.origin)(y) * self.window(self.frame_size), axis=1)


@dataclass(frozen=True)
class Spectrogram(STFT):
    def __call__(self, y):
        return np.abs(STFT.__call__(self, y))


@dataclass(frozen=True)
class FilteredSpectrogram(Spectrogram):
    """Triangles on the 2595 log10 mel scale, without area normalisation."""

    num_bands: int = 80
    fmin: float = 30.0
    fmax: float | None = None
    sample_rate: float = 44100.0

    @property
    def filterbank(self):
        return banks.mel(self.sample_rate, self.frame_size, self.num_bands, self.fmin, self.fmax, htk=True, area=False)

    def __call__(self, y):
        return Spectrogram.__call__(self, y) @ self.filterbank.T


@dataclass(frozen=True)
class LogarithmicFilteredSpectrogram(FilteredSpectrogram):
    mul: float = 1.0
    add: float = 1.0

    def __call__(self, y):
        return np.log(self.mul * FilteredSpectrogram.__call__(self, y) + self.add)


@dataclass(frozen=True)
class SemitoneFilterbank:
    low: int = 24
    high: int = 119
    sample_rate: float = 44100.0

    def __call__(self, y):
        return effects.semitone_filterbank(y, self.sample_rate, self.low, self.high)


@dataclass(frozen=True)
class ChromaProcessor:
    """Chroma at a frame rate: from the STFT (`deep`), or from the constant-Q transform (`clp`)."""

    kind: str = "deep"
    fps: float = 10.0
    sample_rate: float = 44100.0

    def __call__(self, y):
        hop = int(self.sample_rate / self.fps)
        return features.chroma_stft(y, self.sample_rate, 8192, hop) if self.kind == "deep" else features.chroma_cqt(y, self.sample_rate, hop)


@dataclass(frozen=True)
class ActivationProcessor:
    """Onset strength over its maximum: stands in for beat and onset networks."""

    fps: float = 100.0
    sample_rate: float = 44100.0
    n_fft: int = 2048

    def __call__(self, y):
        x = rhythm.onset_strength(y, self.sample_rate, int(self.sample_rate / self.fps), self.n_fft)
        return x / x.max() if len(x) and x.max() > 0 else x


@dataclass(frozen=True)
class DownBeatActivation(ActivationProcessor):
    """(none, beat, downbeat) from one curve e: 1 - e, 0.6 e, 0.4 e."""

    def __call__(self, y):
        return self.of(ActivationProcessor.__call__(self, y))

    @staticmethod
    def of(e):
        return np.stack([1 - e, 0.6 * e, 0.4 * e], axis=1)


@dataclass(frozen=True)
class BeatTracking:
    fps: float = 100.0
    min_bpm: float = 55.0
    max_bpm: float = 215.0
    threshold: float = 0.05

    def __call__(self, act):
        return rhythm.neural_beats(act, self.fps, self.min_bpm, self.max_bpm, self.threshold)[1] / self.fps


@dataclass(frozen=True)
class DownBeatTracking:
    """(time, position in the bar) of each beat."""

    beats_per_bar: tuple = (4,)
    fps: float = 100.0

    def __call__(self, act):
        beats, down = rhythm.downbeats(act, self.fps, self.beats_per_bar[0])
        position, out = 0, []
        for b, d in zip(beats, down):
            position = 1 if d else position % self.beats_per_bar[0] + 1
            out.append((b / self.fps, position))
        return np.array(out).reshape(-1, 2)


@dataclass(frozen=True)
class OnsetPeakPicking:
    threshold: float = 0.3
    pre: float = 0.03
    post: float = 0.03
    combine: float = 0.03
    delay: float = 0.0
    fps: float = 100.0

    def __call__(self, act):
        f = lambda s: int(round(s * self.fps))
        return rhythm.neural_onset_detect(np.asarray(act, float), self.threshold, "adaptive", f(self.pre), f(self.post), max(1, f(self.combine))) / self.fps + self.delay


@dataclass(frozen=True)
class TempoEstimation:
    fps: float = 100.0
    min_bpm: float = 40.0
    max_bpm: float = 250.0

    def __call__(self, act):
        return np.array([[rhythm.tempo_from_activations(act, self.fps, self.min_bpm, self.max_bpm), 1.0]])


@dataclass(frozen=True)
class KeyRecognition:
    """24 activations pass through; other shapes give the uniform distribution."""

    def __call__(self, act):
        a = np.asarray(act, float)
        return a if a.shape[-1:] == (24,) else np.full(24, 1 / 24)


@dataclass(frozen=True)
class ChordRecognition:
    fps: float = 10.0

    def __call__(self, act):
        return [(a / self.fps, b / self.fps, label) for a, b, label in harmony.chord_detect(act)]


@dataclass(frozen=True)
class PianoNotes:
    """(onset, pitch, duration, velocity) in seconds."""

    fps: float = 100.0
    threshold: float = 0.5

    def __call__(self, act):
        return [(a / self.fps, p, (b - a) / self.fps, v) for a, b, p, v in harmony.piano_threshold(act, self.threshold)]


@dataclass(frozen=True)
class OnsetEvaluation:
    window: float = 0.025
    counts: dict = field(default_factory=dict)

    def __call__(self, est, ref):
        p, r, f = evaluate.onset_scores(ref, est, self.window)
        tp = int(round(p * len(est)))
        return {"precision": p, "recall": r, "f_measure": f, "tp": tp, "fp": len(est) - tp, "fn": len(ref) - tp}


@dataclass(frozen=True)
class BeatEvaluation:
    window: float = 0.07

    def __call__(self, est, ref):
        return evaluate.beat_scores(ref, est, self.window)


@dataclass(frozen=True)
class TempoEvaluation:
    tolerance: float = 0.08

    def __call__(self, est, ref):
        return dict(zip(("acc1", "acc2"), evaluate.tempo_scores(ref, est, self.tolerance)))
