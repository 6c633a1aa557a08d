"""Sample arrays as Column expressions; recurrences and convolutions are Arrow pandas UDFs.

Sums are taken in double precision, in the order of the samples.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import let


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def fold(x: Column, step) -> Column:
    return F.aggregate(doubles(x), F.lit(0.0), step)


def energy(x: Column) -> Column:
    return fold(x, lambda a, v: a + v * v)


def rms(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sqrt(energy(x) / F.size(x))).otherwise(0.0)


def peak(x: Column) -> Column:
    return fold(x, lambda a, v: F.greatest(a, F.abs(v)))


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))


def to_mono(x: Column, channels: int) -> Column:
    """Mean of the first two channels at most, frame by frame; a broken last frame counts as it is."""
    used = min(channels, 2)
    frames = F.ceil(F.size(x) / F.lit(channels)).cast("int")
    part = lambda i: F.aggregate(F.slice(doubles(x), i * channels + 1, F.lit(used)), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), frames - 1), lambda i: part(i) / used)).otherwise(F.array().cast("array<double>"))


def range_normalize(x: Column) -> Column:
    """Divided by the peak if that is over 1; what isn't finite becomes 0; clamped."""
    finite = F.transform(doubles(x), lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))
    top = F.aggregate(finite, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    return let(top, lambda t: F.transform(finite, lambda v: clamp(F.when(t > 1, v / t).otherwise(v))))


def soft_clip_gain(x: Column, target_rms: float = 0.9, target_peak: float = 0.95, least: float = 1.5) -> Column:
    """Gain towards a level, at least `least`; beyond the target peak only a twentieth is added; silence stays."""
    level, top = rms(x), peak(x)
    gain = F.greatest(F.least(F.lit(target_rms) / level, F.lit(target_peak) / top), F.lit(least))

    def clip(v: Column, by: Column) -> Column:
        s = v * by
        return F.when(s > target_peak, target_peak + (s - target_peak) * 0.05).when(s < -target_peak, -target_peak + (s + target_peak) * 0.05).otherwise(s)

    return F.when((level == 0) | (top == 0), doubles(x)).otherwise(let(gain, lambda by: F.transform(doubles(x), lambda v: clip(v, by))))


def mix(mic: Column, system: Column, share: float = 0.7) -> Column:
    """mic + share * system, missing samples as 0; beyond 1 only the sign is left."""
    add = lambda m, s: F.coalesce(m, F.lit(0.0)) + share * F.coalesce(s, F.lit(0.0))
    return F.transform(F.zip_with(doubles(mic), doubles(system), add), lambda v: F.when(F.abs(v) > 1, F.signum(v)).otherwise(v))


def mix_ducking(mic: Column, system: Column, threshold: float = 0.01, ducked: float = 0.6) -> Column:
    """The system's share is lower while the microphone has speech; clamped."""
    gain = F.when(rms(mic) > threshold, ducked).otherwise(1.0)
    return let(gain, lambda by: F.zip_with(doubles(mic), doubles(system), lambda m, s: clamp(m + s * by)))


def frames(x: Column, size: int) -> Column:
    """Consecutive pieces of `size` samples; the last may be shorter."""
    starts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(x, i, F.lit(size)))


def quietest(x: Column, window: int, step: int) -> Column:
    """struct(rms, start): the first of the quietest windows, taken every `step` samples."""
    starts = F.sequence(F.lit(0), F.size(x) - window, F.lit(step))
    level = lambda i: F.sqrt(F.aggregate(F.slice(doubles(x), i + 1, F.lit(window)), F.lit(0.0), lambda a, v: a + v * v) / window)
    return F.array_min(F.transform(starts, lambda i: F.struct(level(i).alias("rms"), i.alias("start"))))


def louder_channel(a: Column, b: Column, ratio: float = 1.1) -> Column:
    total = lambda x: fold(x, lambda s, v: s + F.abs(v))
    return F.when(total(a) > ratio * total(b), "0").when(total(b) > ratio * total(a), "1").otherwise("?")


def argmax(x: Column) -> Column:
    """Position from 0 of the first largest value."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("long")


def to_decibel(v: Column) -> Column:
    return 20 * F.log10(v)


def from_decibel(v: Column) -> Column:
    return F.pow(F.lit(10.0), v / 20)


def resample_band(ratio: Column) -> Column:
    """Length of the filter for a ratio of rates."""
    return F.when(ratio >= 2, 512).when(ratio >= 1.5, 384).when(ratio > 1, 256).when(ratio <= 0.5, 512).otherwise(384).cast("long")


def each(f):
    """A pandas UDF array -> array of doubles from a numpy function; null stays null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.asarray(f(np.asarray(v, dtype=float)), dtype=float))

    return run


def recursive(x: np.ndarray, b: tuple[float, float, float], a: tuple[float, float], block: int = 256, carried: np.ndarray | None = None) -> np.ndarray:
    """y[n] = b0 x[n] + b1 x[n-1] + b2 x[n-2] - a1 y[n-1] - a2 y[n-2], in blocks.

    Within a block the answer to its samples is a product with the impulse response, and what came
    before enters through two numbers, so no loop runs over samples. `carried` are these numbers; they
    are brought up to date, so that samples can be filtered as they come.
    """
    if not len(x):
        return np.zeros(0)
    (b0, b1, b2), (a1, a2) = b, a
    # answers of the recursion to an impulse and to each of the two numbers it carries
    free = np.zeros((3, block + 2))
    free[0, 2], free[1, 2], free[2, 3] = 1.0, 1.0, 1.0
    for n in range(2, block + 2):
        free[:, n] += -a1 * free[:, n - 1] - a2 * free[:, n - 2]
    pure = free[0, 2:]
    impulse = b0 * pure + b1 * np.concatenate([[0], pure[:-1]]) + b2 * np.concatenate([[0, 0], pure[:-2]])
    at = np.arange(block)
    answer = np.where(at[:, None] >= at, impulse[np.maximum(at[:, None] - at, 0)], 0.0)
    first, second = free[1, 2:], free[2, 2:]
    out, (s1, s2) = np.empty(len(x)), (0.0, 0.0) if carried is None else carried
    for start in range(0, len(x), block):
        part = x[start : start + block]
        n = len(part)
        y = answer[:n, :n] @ part + s1 * first[:n] + s2 * second[:n]
        out[start : start + n] = y
        s1 = b1 * part[-1] - a1 * y[-1] + (b2 * part[-2] - a2 * y[-2] if n > 1 else s2)
        s2 = b2 * part[-1] - a2 * y[-1]
    if carried is not None:
        carried[:] = s1, s2
    return out


def highpass(x: np.ndarray, rate: float = 16_000, cutoff: float = 80.0) -> np.ndarray:
    """First-order high-pass: y = a * (y' + x - x')."""
    rc, dt = 1 / (2 * np.pi * cutoff), 1 / rate
    a = rc / (rc + dt)
    return recursive(x, (a, -a, 0.0), (-a, 0.0))


def linear_resample(x: np.ndarray, rate: float = 48_000, to: float = 16_000, reach: int = 2) -> np.ndarray:
    """Mean over `reach` samples to either side, then linear interpolation at the new rate."""
    if rate == to or not len(x):
        return x
    sums = np.concatenate([[0.0], np.cumsum(x)])
    at = np.arange(len(x))
    low, high = np.maximum(at - reach, 0), np.minimum(at + reach + 1, len(x))
    smooth = (sums[high] - sums[low]) / (high - low)
    where = np.arange(int(len(x) * to / rate)) * (rate / to)
    return np.interp(where, at, smooth)


#: From the ratio of the rates on: taps (also the phases between two samples) and whether phases are interpolated by a
#: cubic instead of a line; last what holds for small reductions. And the cutoff, as a share of the Nyquist frequency (fixed values).
UP_BANDS, DOWN_BAND, ELSE_BAND, CUTOFF = ((2.0, 512, True), (1.5, 384, True), (1.0, 256, False)), (0.5, 512, True), (384, False), 0.95
#: Blackman-Harris window, which is squared (fixed values).
WINDOW = (0.35875, 0.48829, 0.14128, 0.01168)


def resample_rule(ratio: float) -> tuple[int, bool]:
    """Taps and cubic interpolation for a ratio of rates, as `resample_band` has the taps."""
    for least, taps, cubic in UP_BANDS:
        if ratio >= least and ratio > 1:
            return taps, cubic
    return DOWN_BAND[1:] if ratio <= DOWN_BAND[0] else ELSE_BAND


def sinc_kernel(gap: np.ndarray, taps: int, cut: float) -> np.ndarray:
    """The windowed sinc at a distance of `gap` samples."""
    turn = np.pi * (gap / taps + 0.5) * 2
    window = sum(w * (-1) ** i * np.cos(i * turn) for i, w in enumerate(WINDOW))
    return np.where(np.abs(gap) < taps / 2, cut * np.sinc(cut * gap) * window * window, 0.0)


@lru_cache(maxsize=8)
def sinc_table(taps: int, cut: float) -> np.ndarray:
    """Weights of the taps for each phase, from one before 0 to two after the next sample; a constant stays what it is."""
    offsets = np.arange(taps) - taps // 2 + 1
    table = sinc_kernel(np.arange(-1, taps + 2)[:, None] / taps - offsets, taps, cut)
    return table / table[1:-2].sum(axis=1).mean()


def sinc_resample(x: np.ndarray, rate: float = 48_000, to: float = 16_000, block: int = 2048) -> np.ndarray:
    """Interpolation by a windowed sinc whose weights stand in a table of phases, made once for a ratio.

    The filter's length and the interpolation between phases follow the ratio of the rates; the cutoff lies under the
    lower of both Nyquist frequencies. Output and input begin together; outside there is silence.
    """
    if rate == to or not len(x):
        return x
    ratio = to / rate
    taps, cubic = resample_rule(ratio)
    table = sinc_table(taps, CUTOFF * min(1.0, ratio))
    padded = np.concatenate([np.zeros(taps // 2 - 1), x, np.zeros(taps // 2 + 1)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(int(len(x) * ratio))
    for first in range(0, len(out), block):
        where = np.arange(first, min(first + block, len(out))) / ratio
        base = np.floor(where).astype(int)
        phase = (where - base) * taps
        k = np.floor(phase).astype(int)
        mu = phase - k
        if cubic:  # through the phases k - 1 to k + 2
            shares = (-mu * (mu - 1) * (mu - 2) / 6, (mu + 1) * (mu - 1) * (mu - 2) / 2, -(mu + 1) * mu * (mu - 2) / 2, (mu + 1) * mu * (mu - 1) / 6)
        else:
            shares = (0 * mu, 1 - mu, mu)
        weights = sum(share[:, None] * table[k + i] for i, share in enumerate(shares))
        out[first : first + len(where)] = (rows[base] * weights).sum(axis=1)
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resampled(x: pd.Series, rate: pd.Series, to: pd.Series) -> pd.Series:
    """Arrays of samples at the rate `to`, each from its own rate."""
    return pd.Series([None if v is None else sinc_resample(np.asarray(v, dtype=float), r, t) for v, r, t in zip(x, rate, to)])


def chunked_resample(x: np.ndarray, rate: int = 48_000, to: int = 16_000, chunk: float = 60.0, overlap: float = 0.1, one=sinc_resample) -> np.ndarray:
    """Resampled in chunks that reach `overlap` seconds into the next one, with a linear fade from each to the next."""
    if rate == to or not len(x):
        return x
    size, more = int(rate * chunk), int(rate * overlap)
    fade = int(more * to / rate)
    done: list[np.ndarray] = []
    tail = np.zeros(0)  # of what is done, as it may still be faded
    for start in range(0, len(x), size):
        part = one(x[start : start + size + more], rate, to)
        n = min(fade, len(part), len(tail)) if start else 0
        if n:
            up = np.arange(n) / n
            tail = np.concatenate([tail[: len(tail) - n], tail[len(tail) - n :] * (1 - up) + part[:n] * up])
        tail = np.concatenate([tail, part[n:]])
        done.append(tail[: max(len(tail) - fade, 0)])
        tail = tail[max(len(tail) - fade, 0) :]
    return np.concatenate([*done, tail])


#: Decibel of the true-peak limit, milliseconds of look-ahead and of a gate window, target loudness, highest gain in decibel (fixed values).
PEAK_DB, AHEAD_MS, GATE_MS, TARGET, MOST_DB = -1.0, 10, 100, -23.0, 12.0
#: The two stages of K-weighting at 48 kHz (ITU-R BS.1770, fixed values).
SHELF = ((1.53512485958697, -2.69169618940638, 1.19839281085285), (-1.69065929318241, 0.73248077421585))
PASS = ((1.0, -2.0, 1.0), (-1.99004745483398, 0.99007225036621))


def ahead(rate: int) -> int:
    return max(rate * AHEAD_MS // 1000, 1)


def limiter(x: Column, limit: float = 10 ** (PEAK_DB / 20), rate: int = 48_000) -> Column:
    """Samples over the limit come down to it; the output is late by the look-ahead, less one sample, with zeros before it."""
    late = F.concat(F.array_repeat(F.lit(0.0), ahead(rate) - 1), F.transform(doubles(x), lambda v: F.when(F.abs(v) > limit, F.signum(v) * limit).otherwise(v)))
    return F.slice(late, F.lit(1), F.size(x))


def window_gains(x: np.ndarray, floor_db: float = -50.0, rate: int = 48_000) -> np.ndarray:
    """The gain after each full window: towards the target loudness of the last three seconds of windows that aren't below the floor.

    The two filters carry their state from window to window, and of a window only its energy is kept.
    """
    size, short = rate * GATE_MS // 1000, 3 * rate
    shelf, cut, energies = np.zeros(2), np.zeros(2), deque([0.0] * (3000 // GATE_MS), 3000 // GATE_MS)
    gain, out = 1.0, []
    for start in range(0, len(x) - size + 1, size):
        part = x[start : start + size]
        if np.sqrt(np.mean(part * part)) >= 10 ** (floor_db / 20):
            weighted = recursive(recursive(part, *SHELF, carried=shelf), *PASS, carried=cut)
            energies.append(float(weighted @ weighted))
            energy = sum(energies) / short
            level = -0.691 + 10 * np.log10(energy) if energy > 0 else -np.inf
            if np.isfinite(level) and level < 0:
                gain = min(10 ** ((TARGET - level) / 20), 10 ** (MOST_DB / 20))
        out.append(gain)
    return np.array(out)


def loudness(x: np.ndarray, floor_db: float = -50.0, rate: int = 48_000) -> np.ndarray:
    """Loudness normalisation as samples come: each gets the gain that the windows before it gave, then the limiter."""
    gains = np.repeat(np.concatenate([[1.0], window_gains(x, floor_db, rate)]), rate * GATE_MS // 1000)[: len(x)]
    limit, late = 10 ** (PEAK_DB / 20), ahead(rate) - 1
    return np.concatenate([np.zeros(late), np.clip(x * gains, -limit, limit)])[: len(x)]


def gain_readout(x: np.ndarray, floor_db: float = -50.0, rate: int = 48_000) -> np.ndarray:
    """After each full second the mean gain of the last three seconds of windows, in decibel."""
    each, decibel = 1000 // GATE_MS, 20 * np.log10(window_gains(x, floor_db, rate))
    return np.array([decibel[max(0, n - 3 * each) : n].mean() for n in range(each, len(decibel) + 1, each)])


def spectral_subtraction(x: np.ndarray, noise: float | None = None, window: int = 1600) -> np.ndarray:
    """Each bin of one window's spectrum loses the noise power (by default the mean power of the samples).

    Longer arrays are cut to the window, shorter ones filled with zeros; the way back isn't divided by
    the window's length.
    """
    if not len(x):
        return x
    noise = float(np.mean(x * x)) if noise is None else noise
    spectrum = np.fft.rfft(x[:window], window)
    power = np.abs(spectrum) ** 2
    share = np.divide(noise, power, out=np.full(len(power), np.inf), where=power > 0)
    return np.fft.irfft(spectrum * np.sqrt(np.maximum(1 - share, 0)), window) * window


def mix_dynamic(mic: Column, system: Column, window: int = 1024) -> Column:
    """Each source has the share of its level (of its last samples) in both, between a tenth and nine; silence has none."""
    level = lambda x: rms(F.slice(x, -F.least(F.size(x), F.lit(window)), F.lit(window)))
    m, s = F.when(F.size(mic) > 0, level(mic)).otherwise(0.0), F.when(F.size(system) > 0, level(system)).otherwise(0.0)
    share = F.when((m == 0) & (s == 0), 0.5).when(m == 0, 0.0).when(s == 0, 1.0).otherwise(F.greatest(F.least(m / (m + s), F.lit(0.9)), F.lit(0.1)))
    add = lambda by: F.zip_with(doubles(mic), doubles(system), lambda a, b: F.coalesce(a, F.lit(0.0)) * by + F.coalesce(b, F.lit(0.0)) * (1 - by))
    return let(share, add)


def energy_fallback(samples: Column, speech: Column, least: int = 1600, level: float = 0.2, top: float = 0.2) -> Column:
    """Speech that is too short gives way to all samples, if these are loud enough, or to nothing."""
    loud = (rms(samples) >= level) & (peak(samples) >= top)
    return F.when(F.size(speech) >= least, doubles(speech)).when(loud, doubles(samples)).otherwise(F.array().cast("array<double>"))


def first_cut(x: np.ndarray, most: int, window: int, radius: int, step: int, quiet: float, lead: int) -> int:
    """Where the first part of samples that are longer than `most` ends: in the middle of the quietest window near that limit.

    Where nothing is quiet, the part is `lead` samples longer; the next begins where it ends.
    """
    starts = np.arange(max(most - radius, lead), min(most + radius, len(x) - window) - window + 1, step)
    cut, level = most, np.inf
    if len(starts):
        squares = np.concatenate([[0.0], np.cumsum(x[: most + radius + window] ** 2)])
        levels = np.sqrt(np.maximum(squares[starts + window] - squares[starts], 0) / window)
        best = int(levels.argmin())
        cut, level = int(starts[best]) + window // 2, float(levels[best])
    return min(cut + lead, len(x)) if level > quiet else cut


def split_points(x: np.ndarray, most: int, window: int, radius: int, step: int, quiet: float, lead: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of a long segment, each cut by `first_cut`."""
    parts, pos = [], 0
    while len(x) - pos > most:
        end = pos + first_cut(x[pos:], most, window, radius, step, quiet, lead)
        parts.append((pos, end))
        pos = end
    if pos < len(x):
        parts.append((pos, len(x)))
    return parts


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType())))
def split_at_silence(x: pd.Series) -> pd.Series:
    """Parts of at most about 25 samples' worth of a short frame (the limits scale with the rate in use)."""
    return x.map(lambda v: [] if v is None else [{"start": a, "end": b} for a, b in split_points(np.asarray(v, dtype=float), 25, 4, 6, 1, 0.05, 4)])
