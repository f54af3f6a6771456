import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from triaxis.functions import kernels as k

RNG = np.random.default_rng(3)
T = np.arange(2000) / 100
SIGNAL = np.sin(4 * np.pi * T) + 0.5 * np.sin(16 * np.pi * T) + 0.3 * np.sin(50 * np.pi * T) + 0.1 * RNG.standard_normal(2000)


def test_shapes():
    f, t, s = k.stft(SIGNAL, 100, 3.0, 0.5)
    assert s.shape == (151, 39) == (len(f), len(t))
    f, t, s = k.stft_average(SIGNAL, 100, 3, 2.0, 0.25)
    assert s.shape == (101, 71) == (len(f), len(t))
    f, t, s = k.welch(SIGNAL, 100, 8, 1, 4, 2)
    assert s.shape == (201, 19) and t[0] == 1.0 and t[-1] == 19.0


def test_peaks():
    f, _, s = k.welch(SIGNAL, 100, 8, 1, 4, 2)
    mean = s.mean(axis=1)
    peaks = [i for i in range(1, len(f) - 1) if mean[i] > mean[i - 1] and mean[i] > mean[i + 1]]
    top = sorted(sorted(peaks, key=lambda i: -mean[i])[:3])
    assert [f[i] for i in top] == [2.0, 8.0, 25.0]


def test_power_is_a_plain_dft():
    x = RNG.standard_normal((3, 16))
    w = k.window("hann", 16)
    got = k.power(x, 8.0, w, linear=False)
    n = np.arange(16)
    for row, have in zip(x, got):
        for b in range(9):
            z = (row * w * np.exp(-2j * np.pi * n * b / 16)).sum()
            assert np.isclose(have[b], abs(z) ** 2 / (8 * (w**2).sum()) * (1 if b in (0, 8) else 2))


def test_smoothing_keeps_parabolas():
    x = np.arange(101.0)
    y = 3 + 2 * x - 0.5 * x * x
    assert np.allclose(k.smooth(y, 31), y)


def plain_frames(x, size, step, fs):
    """Power of each frame by least squares and a plain DFT."""
    w, n, out = k.window("hann", size), np.arange(size), []
    for a in range(0, len(x) - size + 1, step):
        part = x[a : a + size]
        part = (part - np.polyval(np.polyfit(n, part, 1), n)) * w
        z = np.array([(part * np.exp(-2j * np.pi * n * b / size)).sum() for b in range(size // 2 + 1)])
        row = np.abs(z) ** 2 / (fs * (w**2).sum())
        row[1 : -1 if size % 2 == 0 else None] *= 2
        out.append(row)
    return np.array(out).T


def plain_baseline(x, fs):
    """x without the parabola that fits the 30 s around each sample; at the ends that of the outermost 30 s."""
    m, n = int(fs * 15), len(x)
    out = np.empty(n)
    for i in range(n):
        lo = min(max(0, i - m), n - 2 * m - 1)
        at = np.arange(lo, lo + 2 * m + 1)
        out[i] = x[i] - np.polyval(np.polyfit(at - lo - m, x[at], 2), i - lo - m)
    return out


def test_spectra_with_padding_and_baseline():
    """The defaults of all three transforms against plain versions."""
    fs, x = 4, np.random.default_rng(5).standard_normal(300).cumsum()
    whole = np.pad(plain_baseline(x, fs), 12)
    f, t, s = k.stft(x, fs, 8, 2)
    want = plain_frames(whole, 32, 8, fs)
    assert np.allclose(s, want) and np.allclose(t, (16 + 8 * np.arange(want.shape[1]) - 12) / fs) and np.allclose(f, np.arange(17) / 8)
    _, t3, s3 = k.stft_average(x, fs, 3, 8, 2)
    assert np.allclose(s3, np.array([want[:, i : i + 3].mean(axis=1) for i in range(want.shape[1] - 2)]).T) and np.allclose(t3, t[1:-1])
    f, t, s = k.welch(x, fs, 8, 2, 4, 2)
    frames = [whole[a : a + 32] for a in range(0, len(whole) - 31, 8)]
    assert np.allclose(s, np.array([plain_frames(p, 16, 8, fs).mean(axis=1) for p in frames]).T)
    assert np.allclose(t, (16 + 8 * np.arange(len(frames)) - 12) / fs)


def test_short_signals_give_no_frames():
    assert k.stft(np.ones(5), 10, 2, 1)[2].shape == (11, 0)
    assert k.welch(np.ones(5), 10, 8, 2, 4, 2)[2].shape == (21, 0)
    assert k.stft_average(np.ones(30), 10, 50, 1, 0.5)[2].shape[1] == 0


def test_simpson():
    for n in (3, 4, 5, 8, 9):
        x = np.linspace(0, 2, n)
        assert np.isclose(k.simpson_weights(x) @ (1 + x + x * x), 2 + 2 + 8 / 3)
    assert k.simpson_weights(np.array([1.0])).tolist() == [0.0]


def test_bands_are_open_below_and_closed_above():
    f = np.array([0.0, 1.0, 2.0, 3.0])
    s = np.ones((4, 2))
    got = k.band_power(s, f, {"a": (0.0, 2.0), "none": (7.0, 9.0)})
    assert got["a"].tolist() == [1.0, 1.0] and got["none"].tolist() == [0.0, 0.0]


def test_bandpass():
    h = k.bandpass_taps()
    gain = lambda hz: abs((h * np.exp(-2j * np.pi * hz / 80 * np.arange(513))).sum())
    assert np.isclose(gain(5.25), 1, atol=1e-3) and gain(0.0) < 3e-3 and gain(30) < 3e-3
    x = np.zeros(20)
    x[0] = 1
    assert np.allclose(k.fir(x, h), h[:20])


def test_spline_goes_through_points_and_keeps_cubics():
    x = np.array([0.0, 1.0, 2.5, 4.0, 7.0])
    y = x**3 - 2 * x
    at = np.linspace(0, 7, 40)
    assert np.allclose(k.spline(x, y, at), at**3 - 2 * at)


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 60), st.integers(0, 99))
def test_time_warp_keeps_the_range(n, seed):
    a = np.random.default_rng(seed).standard_normal((3, n))
    out = k.time_warp(a, np.random.default_rng(seed + 1).standard_normal(5), 0.5)
    assert out.shape == a.shape
    assert (out >= a.min(axis=1, keepdims=True) - 1e-9).all() and (out <= a.max(axis=1, keepdims=True) + 1e-9).all()


def test_unknown_window():
    with pytest.raises(ValueError):
        k.window("bartlett", 4)


def test_plain_spectrogram():
    f, t, s = k.spectrogram(SIGNAL)
    assert s.shape == (129, 14) == (len(f), len(t)) and abs(f[s.mean(axis=1).argmax()] - 2.0) < 0.4
