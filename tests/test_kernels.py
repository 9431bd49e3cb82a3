import math

import numpy as np
import pytest

from strideway.functions import dsp
from strideway.functions.features import NAMES, extract
from strideway.functions.scalar import nan_int, resolve_path, seconds_of, spark_pattern
from strideway.operators.bouts import scan
from strideway.operators.hmm import decode, refit
from strideway.operators.prepare import sphere_fit
from strideway.plans.model import nelder_mead

RATE = 100
T = np.arange(0, 10, 1 / RATE)


def test_butterworth_response():
    sos = dsp.butterworth(4, None, 5.0, RATE)
    for f, want in ((0.0, 1.0), (5.0, 2**-0.5)):
        z = np.exp(2j * np.pi * f / RATE)
        h = np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, _, a1, a2 in sos])
        assert abs(h) == pytest.approx(want, abs=1e-9)
    band = dsp.butterworth(4, 1.0, 5.0, RATE)
    for f, want in ((1.0, 2**-0.5), (5.0, 2**-0.5), (0.0, 0.0)):
        z = np.exp(2j * np.pi * f / RATE)
        h = np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, _, a1, a2 in band])
        assert abs(h) == pytest.approx(want, abs=1e-6)


def test_filter_is_zero_phase():
    slow, fast = np.sin(2 * np.pi * 1 * T), np.sin(2 * np.pi * 20 * T)
    y = dsp.butterfilt(slow + fast, 5, RATE)
    assert np.abs(y - slow)[100:-100].max() < 0.01
    assert np.allclose(dsp.butterfilt(np.full(200, 3.0), 5, RATE), 3.0)
    both = dsp.butterfilt(np.stack([slow, fast]), 5, RATE, axis=-1)
    assert np.allclose(both[0], dsp.butterfilt(slow, 5, RATE))
    assert np.abs(dsp.butterfilt(slow + 5, (0.5, 5), RATE))[200:-200].max() < 1.1


def test_peaks():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 2, 5, 1.0])
    assert dsp.local_maxima(x).tolist() == [1, 4, 7, 10]
    assert dsp.prominences(x, np.array([1, 4, 7, 10])).tolist() == [1, 3, 2, 4]
    assert dsp.find_peaks(x, prominence=2.5)[0].tolist() == [4, 10]
    assert dsp.find_peaks(x, distance=4)[0].tolist() == [4, 10]
    assert dsp.local_maxima(np.zeros(9)).tolist() == []


def test_spectra():
    f, p = dsp.periodogram(np.sin(2 * np.pi * 2 * T), RATE)
    assert f[p.argmax()] == pytest.approx(2) and p.sum() * (f[1] - f[0]) == pytest.approx(0.5)
    w = dsp.welch_median(np.sin(2 * np.pi * 3 * T), RATE)
    assert w.argmax() == 3
    noise = np.random.default_rng(1).normal(size=60_000)
    assert dsp.welch_median(noise, RATE)[5:45].mean() == pytest.approx(2 / RATE, rel=0.05)
    acf = dsp.autocorrelation(np.sin(2 * np.pi * 2 * T), 100)
    assert acf[0] == 1 and acf[20:80].argmax() + 20 == 50
    assert dsp.autocorrelation(np.ones(50), 10).tolist() == [0] * 11


def test_features():
    walk = np.stack([0.3 * np.sin(2 * np.pi * 2 * T), 0 * T, 1 + 0.6 * np.sin(2 * np.pi * 2 * T)], 1)
    f = extract(walk, RATE)
    assert list(f) == NAMES and len(NAMES) == 32
    assert f["f1"] == pytest.approx(2, abs=0.11) and f["npeaks"] == pytest.approx(2, abs=0.21)
    assert f["acf_1st_max_loc"] == pytest.approx(0.5, abs=0.02) and f["min"] <= f["q25"] <= f["med"] <= f["q75"] <= f["max"]
    flat = extract(np.zeros((500, 3)), RATE)
    assert flat["std"] == 0 and flat["skew"] == 0 and flat["npeaks"] == 0 and flat["p1"] == 0
    assert extract(np.zeros((200, 3)), RATE) == {} and extract(np.full((500, 3), np.nan), RATE) == {}


def slow_bouts(flags, share, idle):
    """Tries every end of a bout from every start."""
    out, at = [], 0
    while at < len(flags):
        if flags[at] != 1:
            at += 1
            continue
        end = at
        while end + 1 < len(flags):
            since = end + 1 - max(i for i in range(at, end + 1) if flags[i] == 1)
            ones = sum(1 for f in flags[at : end + 1] if f == 1)
            if flags[end + 1] != 1 and (since > idle or ones / (end + 2 - at) < share):
                break
            end += 1
        last = max(i for i in range(at, end + 1) if flags[i] == 1)
        out.append((at, last - at + 1))
        at = end + 2
    return out


@pytest.mark.parametrize(("share", "idle"), [(0.8, 1), (0.8, 2), (0.8, 3), (0.5, 3), (0.6, 0), (0.1, 5)])
def test_bouts(share, idle):
    rng = np.random.default_rng(11)
    for n in (0, 1, 2, 7, 40):
        for p in (0.2, 0.5, 0.8, 1.0):
            flags = [float(x) if x or rng.random() < 0.5 else None for x in (rng.random(n) < p)]
            assert scan(flags, share, idle) == slow_bouts(flags, share, idle)


def test_decode_is_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(20):
        s, e, t = rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet([1, 1], 2)
        obs = rng.integers(0, 2, 7)

        def score(p):
            return math.log(s[p[0]] * e[p[0], obs[0]]) + sum(math.log(t[p[i - 1], p[i]] * e[p[i], obs[i]]) for i in range(1, 7))

        best = max(score([k >> i & 1 for i in range(7)]) for k in range(128))
        assert score(decode(obs, s, e, t)) == pytest.approx(best)
    assert decode(np.empty(0, int), s, e, t).tolist() == []


def test_refit_gains_likelihood():
    rng = np.random.default_rng(5)
    truth = np.repeat([0, 1, 0, 1], 60)
    obs = np.where(rng.random(240) < 0.9, truth, 1 - truth)
    start, emit, trans = np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.6, 0.4], [0.4, 0.6]])
    (s, e, t), score = refit([obs], 2, "st", start, emit, trans, n_iter=50, n_trials=0)
    assert t[0, 0] > 0.9 and t[1, 1] > 0.9 and e is not None
    assert (decode(obs, s, e, t) == truth).mean() > 0.95


def test_small_rules():
    assert seconds_of("12H") == 43200 and seconds_of("1.5h") == 5400 and seconds_of("30min") == 1800
    assert spark_pattern("%Y/%m/%d %H:%M:%S.%f") == "yyyy/MM/dd HH:mm:ss.SSSSSS" and spark_pattern("%dT%H") == "dd'T'HH"
    assert nan_int(2.9) == 2 and nan_int(float("nan")) is None
    assert resolve_path("/x/a.b.csv") == ("/x", "a", ".b")
    with pytest.raises(IndexError):
        resolve_path("/x/none")
    with pytest.raises(ValueError):
        seconds_of("soon")


def test_sphere_fit_and_simplex():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(400, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    raw = (p - [0.02, -0.03, 0.01]) / [1.05, 0.97, 1.02]
    scale, offset, before, after = sphere_fit(raw)
    assert after < before / 10 and np.allclose(scale, [1.05, 0.97, 1.02], atol=0.01) and np.allclose(offset, [0.02, -0.03, 0.01], atol=0.01)
    x, v = nelder_mead(lambda q: (q[0] - 0.8) ** 2 + (q[1] - 0.3) ** 2, [0.5, 0.5], [(0.2, 2), (0.15, 1)], 200, 1e-6)
    assert np.allclose(x, [0.8, 0.3], atol=0.01) and v < 1e-4
