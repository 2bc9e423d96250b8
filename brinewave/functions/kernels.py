"""Numeric kernels on one block or window, called inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def arrow_function(result: str):
    """Like arrow_udf, but usable before there is a session."""

    def wrap(fn: Callable[..., pa.Array]) -> Callable[..., Column]:
        return lambda *columns: F.arrow_udf(fn, result)(*columns)

    return wrap


def rows_of(lists: pa.Array) -> Iterator[np.ndarray]:
    """The rows of an array<double> column as numpy views."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    for end in ends:
        yield values[start:end]
        start = end


def lists_from(rows: list[np.ndarray]) -> pa.Array:
    """numpy rows to an array<double> column."""
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.float64()))


def structs_from(lengths: list[int], **columns: list[np.ndarray]) -> pa.Array:
    """A column array<struct<...>>: one list per entry of `lengths`, its fields as flat numpy arrays."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    flat = [pa.array(np.concatenate(parts) if parts else np.zeros(0)) for parts in columns.values()]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(flat, names=list(columns)))


def fast_length(n: int) -> int:
    """Smallest length of the form 2^a 3^b 5^c that is at least n."""
    best = 1 << max(n - 1, 0).bit_length()
    for threes in range(32):
        for fives in range(32):
            odd = 3**threes * 5**fives
            if odd >= best:
                break
            twos = max(-(-n // odd) - 1, 0).bit_length()
            best = min(best, odd << twos)
    return best


def frame_length(seconds: float, fs: float) -> int:
    """Samples of a spectrum frame: the smallest length of the form 2^a 3^b 5^c 7^d that lasts at least so long."""
    n = int(np.ceil(seconds * fs - 1e-9))
    return min(7**k * fast_length(-(-n // 7**k)) for k in range(max(n, 1).bit_length()))


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    """Maximum of x[i : i + width] for every full window, in linear time."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0)
    padded = np.concatenate([x, np.full(-len(x) % width, -np.inf)]).reshape(-1, width)
    ahead = np.maximum.accumulate(padded, axis=1).ravel()
    behind = np.maximum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(behind[:n], ahead[width - 1 : width - 1 + n])


def local_peaks(x: np.ndarray, dist: int) -> np.ndarray:
    """Positions whose value is the maximum of dist samples on both sides, first of equals.

    Windows that are cut off at either end give no peak.
    """
    top = sliding_max(x, 2 * dist + 1)
    at = np.flatnonzero(x[dist : dist + len(top)] == top) + dist
    # an equal sample up to dist earlier already holds the maximum
    before = sliding_max(x, dist)
    return at[before[at - dist] < x[at]] if len(at) else at


def butterworth_gain(freq: np.ndarray, fs: float, low: float, high: float, order: int, stop: bool = False) -> np.ndarray:
    """Squared magnitude of a digital Butterworth filter (bilinear transform).

    This is the gain of forward and backward filtering. low = 0 or high = inf
    leave that end open; stop = True turns the band into a stop band.
    """
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        w = np.tan(np.pi * np.minimum(freq, fs / 2) / fs)
        w1 = np.tan(np.pi * low / fs)
        w2 = np.tan(np.pi * min(high, fs / 2) / fs)
        if low <= 0:
            ratio = w / w2
        elif np.isinf(high):
            ratio = w1 / w
        else:
            ratio = (w * w - w1 * w2) / ((w2 - w1) * w)
            ratio = np.where(freq == 0, np.inf, ratio)
            if stop:
                ratio = 1 / ratio
        return 1 / (1 + np.abs(ratio) ** (2 * order))


def pole_radius(fs: float, low: float, high: float, order: int, stop: bool = False) -> float:
    """Largest distance from zero of the poles of a digital Butterworth filter: how slowly it forgets."""
    k = np.arange(order)
    pole = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    w1, w2 = (np.tan(np.pi * min(max(f, 0.0), fs / 2 * (1 - 1e-12)) / fs) for f in (low, min(high, fs / 2)))
    if low <= 0:
        s = pole * w2
    elif np.isinf(high) or high >= fs / 2:
        s = w1 / pole
    else:
        half = (w2 - w1) / (2 * pole) if stop else pole * (w2 - w1) / 2
        root = np.sqrt(half**2 - w1 * w2)
        s = np.concatenate([half + root, half - root])
    return float(np.abs((1 + s) / (1 - s)).max())


SETTLED = 1e-6  # fixed value: the share of full scale that a filter may still ring with


def settling_length(fs: float, band, stops=(), order: int = 4) -> int:
    """Samples after which the slowest pole of a filter has decayed to SETTLED; 0 for an open band."""
    low, high = band
    radii = [pole_radius(fs, low, high, order)] if low > 0 or not np.isinf(high) else []
    radii += [pole_radius(fs, s[0], s[1], order, stop=True) for s in stops]
    return max((int(np.ceil(np.log(SETTLED) / np.log(r))) if 0 < r < 1 else 1 for r in radii), default=0)


def band_gain(freq, fs, band, stops, order) -> np.ndarray:
    gain = np.ones(len(freq))
    low, high = band
    if low > 0 or not np.isinf(high):
        gain = gain * butterworth_gain(freq, fs, low, high, order)
    for s in stops:
        gain = gain * butterworth_gain(freq, fs, s[0], s[1], order, stop=True)
    return gain


def zero_phase(x: np.ndarray, fs: float, band, stops=(), order: int = 4, envelope: bool = False, pad: int = 0) -> np.ndarray:
    """Filter along the last axis without phase shift; optionally the magnitude of the analytic signal of the result.

    As many zeros follow as there are samples, at least `pad`: a filter that rings longer comes round to the beginning.
    """
    n = x.shape[-1]
    if n == 0:
        return x
    size = fast_length(n + max(n, pad))
    gain = band_gain(np.fft.rfftfreq(size, 1 / fs), fs, band, stops, order)
    spectrum = np.fft.rfft(x, size) * gain
    if not envelope:
        return np.fft.irfft(spectrum, size)[..., :n]
    full = np.zeros((*x.shape[:-1], size), dtype=complex)
    full[..., : spectrum.shape[-1]] = spectrum
    full[..., 1 : (size + 1) // 2] *= 2
    return np.abs(np.fft.ifft(full)[..., :n])


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal of exactly these samples, along the last axis."""
    n = x.shape[-1]
    spectrum = np.fft.fft(x)
    step = np.zeros(n)
    step[0] = 1
    step[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        step[n // 2] = 1
    return np.abs(np.fft.ifft(spectrum * step))


def stacked(windows: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A column array<array<double>> (channels of samples) as blocks of equal shape: row numbers, and x[window, channel, sample]."""
    counts = windows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    lists = windows.flatten()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(counts) - counts
    length = np.where(counts > 0, sizes[np.minimum(first, max(len(sizes) - 1, 0))] if len(sizes) else 0, 0)
    place = np.cumsum(sizes) - sizes
    for shape in np.unique(np.stack([counts, length], axis=1), axis=0):
        k, n = (int(v) for v in shape)
        rows = np.flatnonzero((counts == k) & (length == n))
        if k and n:
            at = place[(first[rows, None] + np.arange(k))]
            yield rows, values[at[..., None] + np.arange(n)]


def delays(x: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """`delay` of every x[window, channel] after ref[window], all windows at once."""
    n, m = x.shape[-1], ref.shape[-1]
    size = fast_length(n + m - 1)
    full = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(ref, size))[:, None], size)
    lags = np.arange(-(m - 1), n)
    # in the order of preference among equal magnitudes: the first largest is the one
    lags = lags[np.lexsort((-lags, np.abs(lags)))]
    return lags[np.abs(full[..., lags % size]).round(9).argmax(axis=-1)]


def correlate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """sum_i x[i + lag] * y[i] for lag = -(len(y) - 1) .. len(x) - 1."""
    if min(len(x), len(y)) <= 128:
        return np.correlate(x, y, mode="full")
    size = fast_length(len(x) + len(y) - 1)
    spectrum = np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size))
    full = np.fft.irfft(spectrum, size)
    return np.concatenate([full[size - len(y) + 1 :], full[: len(x)]])


def delay(x: np.ndarray, y: np.ndarray) -> tuple[int, float]:
    """Delay of x after y and the size of the correlation peak.

    Magnitudes are compared at nine decimals; of equal ones the lag nearest to
    zero wins, then the larger lag.
    """
    c = np.abs(correlate(x, y)).round(9)
    top = c.max()
    lags = np.flatnonzero(c == top) - (len(y) - 1)
    best = lags[np.lexsort((-lags, np.abs(lags)))[0]]
    return int(best), float(top)


def frame_powers(x: np.ndarray, nfft: int, hop: int, fs: float, window: np.ndarray | None = None) -> np.ndarray:
    """One-sided power density of every full frame, one row per frame."""
    if len(x) < nfft:
        return np.zeros((0, nfft // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, nfft)[::hop]
    w = np.ones(nfft) if window is None else window
    power = np.abs(np.fft.rfft(frames * w, axis=1)) ** 2 / (fs * np.sum(w * w))
    last = power.shape[1] - (1 if nfft % 2 == 0 else 0)
    power[:, 1:last] *= 2
    return power


def haar_denoise(x: np.ndarray) -> np.ndarray:
    """Soft-threshold one Haar level at the universal threshold along the last axis, averaged over both shifts."""
    n = x.shape[-1]
    m = n // 2 * 2
    out = np.zeros(x.shape)
    for shift in (0, 1):
        y = np.roll(x, -shift, axis=-1)
        mean, diff = (y[..., 0:m:2] + y[..., 1:m:2]) / np.sqrt(2), (y[..., 0:m:2] - y[..., 1:m:2]) / np.sqrt(2)
        noise = np.median(np.abs(diff), axis=-1, keepdims=True) / 0.6745 if m else np.zeros((*x.shape[:-1], 1))
        limit = noise * np.sqrt(2 * np.log(max(n, 2)))
        diff = np.sign(diff) * np.maximum(np.abs(diff) - limit, 0)
        z = y.copy()
        z[..., 0:m:2], z[..., 1:m:2] = (mean + diff) / np.sqrt(2), (mean - diff) / np.sqrt(2)
        out += np.roll(z, shift, axis=-1)
    return out / 2
