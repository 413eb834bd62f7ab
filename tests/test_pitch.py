"""Pitch of tones whose frequency is known, and chunks against the whole."""

import numpy as np
import pytest

from turnwise.operators.pitch import pitch_frames, tracked

RATE = 8000


def tone(hertz, seconds):
    t = np.arange(int(RATE * seconds)) / RATE
    return np.sin(2 * np.pi * hertz * t) + 0.5 * np.sin(4 * np.pi * hertz * t)


@pytest.mark.parametrize("hertz", [80.0, 120.0, 233.0, 350.0])
def test_tones_are_found(hertz):
    f0, confidence, _ = pitch_frames(tone(hertz, 0.5), RATE)
    assert np.abs(f0 - hertz).max() < 0.01 * hertz and confidence.min() > 0.9


def test_short_and_silent_signals():
    assert len(pitch_frames(np.zeros(10), RATE)[0]) == 0
    assert pitch_frames(np.zeros(RATE), RATE)[2].max() == 0


def test_chunks_give_the_frames_of_the_whole(spark):
    x = np.concatenate([tone(110, 0.25), tone(180, 0.25)])
    rows = spark.createDataFrame([(t, i, float(v)) for t in (1, 2) for i, v in enumerate(x if t == 1 else x[:50])], "track long, i long, x double")
    found = tracked(rows, RATE, 0.1).orderBy("frame").collect()
    f0, confidence, rms = pitch_frames(x, RATE)
    assert [(r.track, r.frame) for r in found] == [(1, k) for k in range(len(f0))]
    assert np.allclose([r.f0 for r in found], f0) and np.allclose([r.confidence for r in found], confidence, atol=1e-6) and np.allclose([r.rms for r in found], rms)
