"""Pitch, jitter and shimmer of recordings, and a recording moved to another pitch, on arrays of samples.

Pitch: in every frame the normalised autocorrelation (that of the windowed sound over that of the window) has peaks at the
periods that the frame may have; one of them, or none, is chosen for each frame so that the whole path is cheapest, with a
cost for jumps of pitch and for changes between voiced and unvoiced. Jitter and shimmer: in voiced stretches each period
is found from the one before it, at the lag where the waveforms of the two are most alike, and the lengths and peaks of
neighbouring periods are compared. Method: Boersma, "Accurate short-term analysis of the fundamental frequency and the
harmonics-to-noise ratio of a sampled sound" (1993).
"""

from __future__ import annotations

import numpy as np

#: Least and greatest pitch in Hz; seconds between frames; periods of the least pitch in a frame; candidates of a frame.
FLOOR, CEILING, STEP, PERIODS, CANDIDATES = 75.0, 500.0, 0.01, 3, 8
#: Costs: strength of the unvoiced candidate, what a frame must have of the loudest peak to be voiced, preference of high
#: pitches, a jump of an octave, a change between voiced and unvoiced.
UNVOICED, SILENCE, HIGH, JUMP, CHANGE = 0.45, 0.03, 0.01, 0.35, 0.14
#: Periods in a row that count: at most so far apart in length and in peak; bounds of a period in seconds.
PERIOD_FACTOR, PEAK_FACTOR, SHORTEST, LONGEST = 1.3, 1.6, 0.0001, 0.02
#: Frames that are transformed at once.
FRAMES = 4096


def frames_of(samples: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, seconds of their middles): overlapping stretches of PERIODS periods of the least pitch, without their means."""
    size, hop = int(PERIODS / FLOOR * rate), max(1, int(STEP * rate))
    if len(samples) < size:
        return np.zeros((0, max(size, 1))), np.zeros(0)
    cut = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    return cut, (np.arange(len(cut)) * hop + size / 2) / rate


def candidates(samples: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pitch, strength, seconds): for each frame up to CANDIDATES pitches, 0 for none, the first being the unvoiced one."""
    cut, at = frames_of(samples, rate)
    size = cut.shape[1]
    window = np.hanning(size)
    room = 1 << (2 * size - 1).bit_length()
    own = np.fft.irfft(np.abs(np.fft.rfft(window, room)) ** 2)[:size]
    low, high = max(2, int(rate / CEILING)), min(size // 2, int(rate / FLOOR) + 1)
    loudest = np.abs(samples - samples.mean()).max() if len(samples) else 0.0
    pitch, strength = np.zeros((len(cut), CANDIDATES)), np.full((len(cut), CANDIDATES), -np.inf)
    for i in range(0, len(cut), FRAMES):
        part = cut[i : i + FRAMES] - cut[i : i + FRAMES].mean(axis=1, keepdims=True)
        peak = np.abs(part).max(axis=1)
        power = np.fft.irfft(np.abs(np.fft.rfft(part * window, room)) ** 2)[:, :size]
        alike = (power / np.where(power[:, :1] > 0, power[:, :1], 1)) / (own / own[0])
        before, here, after = alike[:, low - 1 : high - 1], alike[:, low:high], alike[:, low + 1 : high + 1]
        bend = np.where((here > before) & (here >= after) & (here > UNVOICED / 2), 2 * here - before - after, np.nan)
        shift = 0.5 * (after - before) / bend
        height = here + 0.25 * (after - before) * shift
        found = rate / (np.arange(low, high) + shift)
        height = np.where(np.isnan(bend) | (found < FLOOR) | (found > CEILING), -np.inf, np.minimum(height, 2 - height) - HIGH * np.log2(FLOOR / found))
        best = np.argsort(-height, axis=1)[:, : CANDIDATES - 1]
        pitch[i : i + FRAMES, 1 : best.shape[1] + 1] = np.take_along_axis(found, best, axis=1)
        strength[i : i + FRAMES, 1 : best.shape[1] + 1] = np.take_along_axis(height, best, axis=1)
        quiet = np.maximum(0, 2 - peak / loudest / (SILENCE / (1 + UNVOICED))) if loudest > 0 else np.full(len(part), 2.0)
        strength[i : i + FRAMES, 0] = UNVOICED + quiet
    return np.where(np.isfinite(strength), pitch, 0), strength, at


def pitch_track(samples: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(pitch in Hz, 0 where unvoiced; seconds) of each frame: the path through the candidates with the most strength less costs."""
    pitch, strength, at = candidates(samples, rate)
    if not len(pitch):
        return np.zeros(0), at
    octaves = np.log2(np.where(pitch > 0, pitch, 1))
    voiced = pitch > 0
    total, back = strength[0].copy(), np.zeros(pitch.shape, dtype=np.int64)
    for i in range(1, len(pitch)):
        cost = np.where(voiced[i - 1][:, None] & voiced[i][None], JUMP * np.abs(octaves[i - 1][:, None] - octaves[i][None]), np.where(voiced[i - 1][:, None] == voiced[i][None], 0.0, CHANGE))
        reach = total[:, None] - cost
        back[i] = reach.argmax(axis=0)
        total = reach.max(axis=0) + strength[i]
    path = np.empty(len(pitch), dtype=np.int64)
    path[-1] = total.argmax()
    for i in range(len(pitch) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return pitch[np.arange(len(pitch)), path], at


def _likest(samples: np.ndarray, at: float, period: float, direction: int) -> float | None:
    """The place one period on (or back) from a mark at which the waveform is most like that at the mark; None at the ends."""
    half = int(period / 2)
    lags = np.arange(int(0.8 * period), int(1.25 * period) + 2)
    middle = int(round(at))
    if half < 2 or middle - half < 0 or middle + half >= len(samples):
        return None
    low, high = middle + direction * lags[-1] - half, middle + direction * lags[-1] + half
    if min(low, middle + direction * lags[0] - half) < 0 or max(high, middle + direction * lags[0] + half) >= len(samples):
        return None
    own = samples[middle - half : middle + half + 1]
    others = np.lib.stride_tricks.sliding_window_view(samples, 2 * half + 1)[middle + direction * lags - half]
    power = np.sqrt((others**2).sum(axis=1) * (own**2).sum())
    alike = (others @ own) / np.where(power > 0, power, 1)
    k = int(alike.argmax())
    if alike[k] < 0.3:
        return None
    shift = 0.0
    if 0 < k < len(lags) - 1 and 2 * alike[k] > alike[k - 1] + alike[k + 1]:
        shift = 0.5 * (alike[k + 1] - alike[k - 1]) / (2 * alike[k] - alike[k - 1] - alike[k + 1])
    return at + direction * (lags[k] + shift)


def period_marks(samples: np.ndarray, rate: int, track: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """Marks, in samples, one in each period: an array for each voiced stretch, begun at its loudest sample and followed both ways."""
    pitch, at = track or pitch_track(samples, rate)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (pitch > 0).astype(int), [0]])))
    out = []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        begin, end = int((at[a] - STEP / 2) * rate), int((at[b - 1] + STEP / 2) * rate)
        period = lambda place: rate / np.interp(place / rate, at[a:b], pitch[a:b])
        middle = (begin + end) // 2
        reach = int(period(middle))
        first = max(0, middle - reach) + int(np.abs(samples[max(0, middle - reach) : middle + reach + 1]).argmax())
        marks = [float(first)]
        for direction in (1, -1):
            place: float | None = float(first)
            while (place := _likest(samples, place, period(place), direction)) is not None and begin <= place <= end:
                marks.append(place)
        out.append(np.sort(marks))
    return out


def _peak(values: np.ndarray) -> float:
    """The height of the highest point, between samples as well."""
    k = int(values.argmax())
    if not 0 < k < len(values) - 1 or 2 * values[k] <= values[k - 1] + values[k + 1]:
        return float(values[k])
    before, here, after = values[k - 1 : k + 2]
    return float(here + (after - before) ** 2 / (8 * (2 * here - before - after)))


def measures(samples: np.ndarray, rate: int) -> dict[str, float | None]:
    """pitch_mean and pitch_median in Hz, jitter and shimmer (local, as shares), voiced frames; None where the sound has no voiced frame or too few periods."""
    samples = np.asarray(samples, dtype=np.float64)
    track = pitch_track(samples, rate)
    voiced = track[0][track[0] > 0]
    if not len(voiced):
        return {"pitch_mean": None, "pitch_median": None, "jitter": None, "shimmer": None, "voiced": 0}
    steps, lengths, jumps, peaks = [], [], [], []
    for marks in period_marks(samples, rate, track):
        own = np.diff(marks) / rate
        sound = (own >= SHORTEST) & (own <= LONGEST)
        height = np.array([_peak(np.abs(samples[max(0, int(m - p / 2)) : int(m + p / 2) + 1])) for m, p in zip(marks[:-1], np.diff(marks), strict=True)])
        near = sound[1:] & sound[:-1] & (np.maximum(own[1:], own[:-1]) <= PERIOD_FACTOR * np.minimum(own[1:], own[:-1]))
        steps += np.abs(np.diff(own))[near].tolist()
        lengths += own[sound].tolist()
        like = near & (np.maximum(height[1:], height[:-1]) <= PEAK_FACTOR * np.minimum(height[1:], height[:-1]))
        jumps += np.abs(np.diff(height))[like].tolist()
        peaks += height[sound].tolist()
    share = lambda a, b: float(np.mean(a) / np.mean(b)) if len(a) and np.mean(b) > 0 else None
    return {"pitch_mean": float(voiced.mean()), "pitch_median": float(np.median(voiced)), "jitter": share(steps, lengths), "shimmer": share(jumps, peaks), "voiced": len(voiced)}


def moved(samples: np.ndarray, rate: int, scale: float) -> np.ndarray:
    """The sound with its pitch times scale and its length kept: windowed periods laid down at new distances (overlap and add).

    Unvoiced stretches stay as they are. scale must be above 0.
    """
    if not scale > 0:
        raise ValueError("scale must be above 0")
    samples = np.asarray(samples, dtype=np.float64)
    out, weight = np.zeros(len(samples)), np.zeros(len(samples))
    for marks in period_marks(samples, rate):
        if len(marks) < 3:
            continue
        lengths = np.diff(marks)
        place = marks[0]
        while place <= marks[-1]:
            k = min(int(np.abs(marks - place).argmin()), len(lengths) - 1)
            half = int(round(lengths[k]))
            source, target = int(round(marks[k])), int(round(place))
            window = np.hanning(2 * half + 1)
            low = max(-half, -source, -target)
            high = min(half, len(samples) - 1 - source, len(samples) - 1 - target)
            if high > low:
                out[target + low : target + high + 1] += samples[source + low : source + high + 1] * window[low + half : high + half + 1]
                weight[target + low : target + high + 1] += window[low + half : high + half + 1]
            place += lengths[k] / scale
    return np.where(weight > 1e-3, out / np.maximum(weight, 0.5), np.where(weight > 0, out, samples))
