"""Numpy kernels of the spectral and augmentation operators: one signal in, arrays out."""

from __future__ import annotations

import numpy as np

#: Frequency bands of accelerometer signals, Hz, open below and closed above.
BANDS = {"Low": (0.1, 1.0), "Medium": (1.0, 5.0), "High": (5.0, 20.0), "Very_High": (20.0, 50.0)}


def window(name: str, n: int) -> np.ndarray:
    """hann (periodic), hamming (symmetric), boxcar."""
    if name == "hann":
        return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    if name == "hamming":
        return np.hamming(n)
    if name == "boxcar":
        return np.ones(n)
    raise ValueError(f"unknown window: {name}")


def smooth(x: np.ndarray, size: int) -> np.ndarray:
    """Savitzky-Golay of order 2 over an odd `size`; both ends follow the parabola of the outermost window."""
    m = size // 2
    i = np.arange(-m, m + 1)
    weights = 3 * (3 * m * m + 3 * m - 1 - 5 * i * i) / ((2 * m - 1) * (2 * m + 1) * (2 * m + 3))
    out = np.empty(len(x))
    span = 1 << int(np.ceil(np.log2(len(x) + size)))
    full = np.fft.irfft(np.fft.rfft(x, span) * np.fft.rfft(weights, span), span)
    out[m : len(x) - m] = full[size - 1 : len(x)]
    t = i / max(m, 1)
    for part, inside, to in ((x[:size], slice(0, m), slice(0, m)), (x[-size:], slice(m + 1, None), slice(len(x) - m, None))):
        out[to] = np.polynomial.polynomial.polyval(t[inside], np.polynomial.polynomial.polyfit(t, part, 2))
    return out


def prepare(x: np.ndarray, fs: float, window_sec: float, step_sec: float, pad: bool, detrend: bool) -> tuple[np.ndarray, int]:
    """Baseline taken off (if its 30 s window fits), zeros put on both ends; how many seconds at each."""
    x = np.asarray(x, np.float64)
    size = int(fs * 15) * 2 + 1
    if detrend and size < len(x):
        x = x - smooth(x, size)
    seconds = int((window_sec - step_sec) // 2) if pad else 0
    return np.pad(x, int(fs * ((window_sec - step_sec) // 2))) if pad else x, seconds


def segments(x: np.ndarray, size: int, step: int) -> np.ndarray:
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::step]


def power(parts: np.ndarray, fs: float, win: np.ndarray, mode: str = "density", linear: bool = True) -> np.ndarray:
    """One-sided power of each row, its line of least squares taken off."""
    n = parts.shape[1]
    if linear and n > 1:
        t = np.arange(n) - (n - 1) / 2
        parts = parts - parts.mean(axis=1, keepdims=True) - (parts @ t / (t @ t))[:, None] * t
    spectrum = np.abs(np.fft.rfft(parts * win, axis=1)) ** 2
    spectrum *= 1 / (fs * (win**2).sum()) if mode == "density" else 1 / win.sum() ** 2
    spectrum[:, 1 : -1 if n % 2 == 0 else None] *= 2
    return spectrum


def stft(x, fs: float, window_sec: float, step_sec: float, win: str = "hann", pad: bool = True, detrend: bool = True, mode: str = "density"):
    """Frequencies, times and power (frequency by time)."""
    x, _ = prepare(x, fs, window_sec, step_sec, pad, detrend)
    size, step = int(window_sec * fs), int(step_sec * fs)
    shift = int(fs * ((window_sec - step_sec) // 2)) / fs if pad else 0.0
    parts = segments(x, size, step)
    times = (size / 2 + step * np.arange(len(parts))) / fs - shift
    return np.fft.rfftfreq(size, 1 / fs), times, power(parts, fs, window(win, size), mode).T


def stft_average(x, fs: float, count: int, window_sec: float, step_sec: float, **options):
    """stft averaged over `count` neighbouring frames."""
    f, t, s = stft(x, fs, window_sec, step_sec, **options)
    if len(t) < count:
        return f, t[:0], s[:, :0]
    mean = lambda a: np.lib.stride_tricks.sliding_window_view(a, count, axis=-1).mean(axis=-1)
    return f, mean(t), mean(s)


def welch(x, fs: float, frame_sec: float, frame_step_sec: float, window_sec: float, step_sec: float, win: str = "hann", pad: bool = True, detrend: bool = True, mode: str = "density"):
    """Frequencies, frame centres and the mean power of the segments of each frame (frequency by frame)."""
    x, _ = prepare(x, fs, frame_sec, frame_step_sec, pad, detrend)
    shift = int(fs * ((frame_sec - frame_step_sec) // 2)) / fs if pad else 0.0
    frame, hop, size, step = int(frame_sec * fs), int(frame_step_sec * fs), int(window_sec * fs), int(step_sec * fs)
    frames = segments(x, frame, hop)
    own = window(win, size)
    out = np.array([power(segments(p, size, step), fs, own, mode).mean(axis=0) for p in frames]).reshape(len(frames), size // 2 + 1)
    times = (frame / 2 + hop * np.arange(len(frames))) / fs - shift
    return np.fft.rfftfreq(size, 1 / fs), times, out.T


def simpson_weights(x: np.ndarray) -> np.ndarray:
    """Weights of the composite Simpson rule on an even grid; with an even number of points the last
    interval is taken from the parabola of the last three."""
    n = len(x)
    if n < 2:
        return np.zeros(n)
    h = (x[-1] - x[0]) / (n - 1)
    if n == 2:
        return np.full(2, h / 2)
    w = np.zeros(n)
    odd = n if n % 2 else n - 1
    w[:odd] = 2.0
    w[1:odd:2] = 4.0
    w[0] = w[odd - 1] = 1.0
    w[:odd] *= h / 3
    if odd < n:
        w[-3:] += np.array([-1.0, 8.0, 5.0]) * h / 12
    return w


def band_power(spectrum: np.ndarray, freqs: np.ndarray, bands: dict[str, tuple[float, float]] = BANDS) -> dict[str, np.ndarray]:
    """Power over each band for every frame; zeros where a band has no frequency."""
    out = {}
    for name, (low, high) in bands.items():
        inside = (freqs > low) & (freqs <= high)
        out[name] = simpson_weights(freqs[inside]) @ spectrum[inside] if inside.any() else np.zeros(spectrum.shape[1])
    return out


def spectrogram(x, fs: float = 100, size: int = 256, overlap: int = 128):
    """Plain spectrogram: symmetric Hamming window, no detrending, no padding."""
    parts = segments(np.asarray(x, np.float64), size, size - overlap)
    times = (size / 2 + (size - overlap) * np.arange(len(parts))) / fs
    return np.fft.rfftfreq(size, 1 / fs), times, power(parts, fs, window("hamming", size), linear=False).T


def bandpass_taps(fs: float = 80, low: float = 0.5, high: float = 10, count: int = 513) -> np.ndarray:
    """Hamming-windowed sinc, scaled to gain 1 at the middle of the band."""
    m = np.arange(count) - (count - 1) / 2
    a, b = 2 * low / fs, 2 * high / fs
    h = (b * np.sinc(b * m) - a * np.sinc(a * m)) * np.hamming(count)
    return h / (h * np.cos(np.pi * m * (a + b) / 2)).sum()


def fir(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Causal filter from a zero state."""
    return np.convolve(x, taps)[: len(x)]


def spline(xs: np.ndarray, ys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through the points, with the third derivative continuous at the second and last but one."""
    n = len(xs)
    if n < 4:
        return np.polynomial.polynomial.polyval(at, np.polynomial.polynomial.polyfit(xs, ys, n - 1))
    h, slope = np.diff(xs), np.diff(ys) / np.diff(xs)
    a, b = np.zeros((n, n)), np.zeros(n)  # second derivatives
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(xs, at, "right") - 1, 0, n - 2)
    t, u = at - xs[i], xs[i + 1] - at
    return (m[i] * u**3 + m[i + 1] * t**3) / (6 * h[i]) + (ys[i] / h[i] - m[i] * h[i] / 6) * u + (ys[i + 1] / h[i] - m[i + 1] * h[i] / 6) * t


def time_warp(axes: np.ndarray, noise: np.ndarray, factor: float = 0.1) -> np.ndarray:
    """Warps all axes alike: control points moved by noise (standard normal), a spline through them, values
    read back at even places. Where the spline turns back its running maximum counts."""
    size = axes.shape[1]
    if size < 2 or len(noise) < 2:
        return axes.copy()
    xs = np.linspace(0, size - 1, len(noise))
    ys = np.sort(xs + noise * 0.1 * factor * size)
    ys[0], ys[-1] = 0, size - 1
    warped = np.maximum.accumulate(np.clip(spline(xs, ys, np.arange(size, dtype=np.float64)), 0, size - 1))
    return np.array([np.interp(np.arange(size), warped, a) for a in axes])
