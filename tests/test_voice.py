"""Measures of generated sounds whose pitch, jitter and shimmer are known."""

from __future__ import annotations

import wave

import numpy as np
import pytest

from turnlake.functions import voice
from turnlake.sources import files

RATE = 16_000


def pulses(periods, heights):
    """A sound of decaying pulses at exact, fractional places."""
    places = np.cumsum([0.01, *periods])[:-1]
    at = np.arange(int((places[-1] + 0.03) * RATE)) / RATE
    out = np.zeros(len(at))
    for place, height in zip(places, heights, strict=True):
        since = at - place
        on = (since >= 0) & (since < 0.02)
        out[on] += height * np.exp(-since[on] * 900) * np.sin(2 * np.pi * 600 * since[on])
    return out * 0.4


@pytest.mark.parametrize("pitch", [90.0, 133.3, 220.0, 410.0])
def test_pitch_of_tones(pitch):
    at = np.arange(RATE) / RATE
    tone = sum(np.sin(2 * np.pi * pitch * k * at) / k for k in range(1, 6)) * 0.2
    found = voice.measures(tone, RATE)
    assert abs(found["pitch_mean"] / pitch - 1) < 0.005 and found["jitter"] < 0.002 and found["shimmer"] < 0.01


def test_jitter_and_shimmer_of_pulses():
    rng = np.random.default_rng(4)
    periods = 1 / 125 * (1 + 0.02 * rng.choice([-1, 1], 240))
    heights = 1 + 0.05 * rng.choice([-1, 1], 240)
    found = voice.measures(pulses(periods, heights), RATE)
    jitter = np.abs(np.diff(periods[:-1])).mean() / periods.mean()
    shimmer = np.abs(np.diff(heights)).mean() / heights.mean()
    assert abs(found["pitch_median"] / 125 - 1) < 0.02
    assert abs(found["jitter"] / jitter - 1) < 0.01 and abs(found["shimmer"] / shimmer - 1) < 0.01


def test_no_voice():
    rng = np.random.default_rng(5)
    assert voice.measures(np.zeros(RATE), RATE)["voiced"] == 0
    assert voice.measures(np.zeros(10), RATE)["pitch_mean"] is None
    assert voice.measures(rng.standard_normal(RATE) * 0.1, RATE)["voiced"] < 10


@pytest.mark.parametrize("scale", [0.8, 1.3])
def test_a_moved_voice_has_another_pitch_and_the_same_length(scale):
    sound = pulses(np.full(150, 1 / 140), np.ones(150))
    other = voice.moved(sound, RATE, scale)
    assert len(other) == len(sound)
    assert abs(voice.measures(other, RATE)["pitch_median"] / (140 * scale) - 1) < 0.02
    with pytest.raises(ValueError):
        voice.moved(sound, RATE, 0)


def test_measured_recordings(spark, tmp_path):
    for name, sound, channels in (("a", pulses(np.full(120, 1 / 150), np.ones(120)), 1), ("b", np.zeros(RATE), 1), ("c", np.zeros(RATE), 2)):
        with wave.open(f"{tmp_path}/{name}.wav", "wb") as file:
            file.setparams((channels, 2, RATE, 0, "NONE", ""))
            file.writeframes((sound * 32767).astype("<i2").tobytes())
    (tmp_path / "d.wav").write_bytes(b"RIFF")
    found = {r.stem: r for r in files.measured_recordings(spark, str(tmp_path)).collect()}
    assert abs(found["a"].pitch_mean / 150 - 1) < 0.01 and found["a"].fault is None
    assert [found[x].fault for x in "bcd"] == ["no_voice", "not_mono", "unreadable"]
