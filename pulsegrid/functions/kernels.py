"""Numeric features of one series that need its order: small numpy helpers.

Each takes one item's hourly values, whose number the calendar bounds, and
returns ``None`` where a feature is undefined.
"""

from __future__ import annotations

import math

import numpy as np

_CHUNK_CELLS = 4_000_000


def _value(x) -> float | None:
    x = float(x)
    return x if math.isfinite(x) else None


# ---------------------------------------------------------------- spectrum

def welch_density(v: np.ndarray, longest: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density: Hann segments with half overlap, mean removed."""
    size = min(longest, len(v))
    hop = size - size // 2
    starts = np.arange((len(v) - size // 2) // hop) * hop
    seg = v[starts[:, None] + np.arange(size)]
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.abs(np.fft.rfft((seg - seg.mean(axis=1, keepdims=True)) * win)) ** 2 / (win @ win)
    power[:, 1:-1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size), power.mean(axis=0)


SPECTRAL = ("spectral_entropy", "dominant_freq", "spec_centroid", "spec_bandwidth", "low_freq_energy",
            "mid_freq_energy", "high_freq_energy", "low_high_ratio", "spec_skewness", "spec_kurtosis", "spec_flatness")


def spectral(v: np.ndarray) -> dict:
    out = dict.fromkeys(SPECTRAL)
    if len(v) < 4:
        return out
    f, p = welch_density(v)
    total = p.sum()
    if total <= 1e-18:
        return out
    share = p / total
    centre = (f * share).sum()
    width = math.sqrt(((f - centre) ** 2 * share).sum())
    low, high = share[f <= 0.1].sum(), share[f > 0.3].sum()
    out.update(
        spectral_entropy=_value(-(share * np.log2(share + 1e-12)).sum()),
        dominant_freq=_value(f[np.argmax(p)]), spec_centroid=_value(centre), spec_bandwidth=_value(width),
        low_freq_energy=_value(low), mid_freq_energy=_value(share[(f > 0.1) & (f <= 0.3)].sum()),
        high_freq_energy=_value(high), low_high_ratio=_value(low / high) if high > 0 else None,
        spec_skewness=_value(((f - centre) ** 3 * share).sum() / width**3) if width > 0 else None,
        spec_kurtosis=_value(((f - centre) ** 4 * share).sum() / width**4) if width > 0 else None,
        spec_flatness=_value(np.exp(np.log(p + 1e-10).mean()) / (p.mean() + 1e-10)),
    )
    return out


# ---------------------------------------------------------------- pair counts

def template_matches(v: np.ndarray, tol: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Matching template pairs of length 2 and 3, and per-template counts, self included.

    Templates are compared in slices of rows; only counts leave a slice.
    """
    n = len(v)
    n2, n3 = n - 1, n - 2
    c2, c3 = np.zeros(n2), np.zeros(n3)
    pairs2 = pairs3 = 0
    rows = max(1, _CHUNK_CELLS // n)
    for lo in range(0, n2, rows):
        i = np.arange(lo, min(lo + rows, n2))
        near = np.abs(v[i, None] - v[None, :n2]) <= tol
        near &= np.abs(v[i + 1, None] - v[None, 1:]) <= tol
        c2[i] = near.sum(axis=1)
        short = i[i < n3]
        part = near[: len(short), :n3]
        pairs2 += int(part.sum())
        third = part & (np.abs(v[short + 2, None] - v[None, 2:]) <= tol)
        c3[short] = third.sum(axis=1)
        pairs3 += int(third.sum())
    return (pairs2 - n3) // 2, (pairs3 - n3) // 2, c2, c3


def entropies(v: np.ndarray, factor: float = 0.2) -> dict:
    """Sample and approximate entropy, template length 2, tolerance ``factor`` deviations."""
    out = dict.fromkeys(("matches_2", "matches_3", "sample_entropy", "approx_entropy"))
    if len(v) < 4 or v.max() == v.min():
        return out
    a, b, c2, c3 = template_matches(v, factor * v.std())
    out["matches_2"], out["matches_3"] = a, b
    if a and b:
        out["sample_entropy"] = _value(-math.log(b / a))
    out["approx_entropy"] = _value(np.log(c2 / len(c2)).mean() - np.log(c3 / len(c3)).mean())
    return out


def correlation_radii(v: np.ndarray) -> np.ndarray:
    """Radii from 0.1 to 0.5 sample deviations, each 3 % above the last."""
    steps = int(math.floor(math.log(5.0) / math.log(1.03)))
    return 0.1 * v.std(ddof=1) * 1.03 ** np.arange(steps + 1)


def correlation_counts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radii and the pairs of 2-D delay vectors within each, by largest coordinate distance."""
    r = correlation_radii(v)
    n = len(v) - 1
    hits = np.zeros(len(r) + 1, dtype=np.int64)
    rows = max(1, _CHUNK_CELLS // len(v))
    for lo in range(0, n, rows):
        i = np.arange(lo, min(lo + rows, n))
        d = np.maximum(np.abs(v[i, None] - v[None, :n]), np.abs(v[i + 1, None] - v[None, 1:]))
        hits += np.bincount(np.searchsorted(r, d[np.arange(n)[None, :] > i[:, None]]), minlength=len(r) + 1)
    return r, np.cumsum(hits)[: len(r)]


# ---------------------------------------------------------------- scaling exponents

def _slope(x, y) -> float | None:
    x, y = np.asarray(x, float), np.asarray(y, float)
    ok = np.isfinite(x) & np.isfinite(y)
    if ok.sum() < 2 or np.ptp(x[ok]) == 0:
        return None
    return _value(np.polyfit(x[ok], y[ok], 1)[0])


def _expected_rs(n: int) -> float:
    i = np.arange(1, n)
    tail = np.sqrt((n - i) / i).sum()
    if n <= 340:
        mid = math.exp(math.lgamma((n - 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi)
    else:
        mid = 1 / math.sqrt(n * math.pi / 2)
    return (n - 0.5) / n * mid * tail


def hurst(v: np.ndarray, steps: int = 15) -> float | None:
    """Rescaled-range exponent, corrected by the range expected of noise."""
    if len(v) < 20 or v.max() == v.min():
        return None
    span = math.log(len(v))
    sizes = np.unique(np.round(np.exp(span * (0.375 + 0.25 * np.arange(steps) / steps))).astype(int))
    xs, ys = [], []
    for n in sizes[sizes > 2]:
        seg = v[: len(v) // n * n].reshape(-1, n)
        walk = np.cumsum(seg - seg.mean(axis=1, keepdims=True), axis=1)
        reach, dev = np.ptp(walk, axis=1), seg.std(axis=1, ddof=1)
        ok = (reach > 0) & (dev > 0)
        if ok.any():
            xs.append(math.log(n))
            ys.append(math.log((reach[ok] / dev[ok]).mean()) - math.log(_expected_rs(int(n))))
    s = _slope(xs, ys)
    return None if s is None else s + 0.5


def _detrended(seg: np.ndarray) -> np.ndarray:
    """Residuals of a straight line fitted to every row."""
    t = np.arange(seg.shape[1]) - (seg.shape[1] - 1) / 2
    mean = seg.mean(axis=1, keepdims=True)
    return seg - mean - (seg @ t / (t @ t))[:, None] * t


def dfa(v: np.ndarray) -> float | None:
    """Detrended fluctuation exponent over half-overlapping windows."""
    n = len(v)
    if n < 12 or v.max() == v.min():
        return None
    if n > 70:
        top = int(math.floor(math.log(0.1 * n / 4) / math.log(1.2)))
        sizes = sorted({int(math.floor(4 * 1.2**i)) for i in range(top + 1)})
    else:
        sizes = [4, 5, 6, 7, 8, 9]
    walk = np.cumsum(v - v.mean())
    xs, ys = [], []
    for s in sizes:
        seg = walk[np.arange(0, n - s, s // 2)[:, None] + np.arange(s)]
        f = np.sqrt((_detrended(seg) ** 2).mean(axis=1)).mean()
        if f > 0:
            xs.append(math.log(s))
            ys.append(math.log(f))
    return _slope(xs, ys)


# ---------------------------------------------------------------- canonical features

CANONICAL = (
    "DN_OutlierInclude_p_001_mdrmd", "DN_OutlierInclude_n_001_mdrmd", "CO_f1ecac", "CO_FirstMin_ac",
    "SP_Summaries_welch_rect_area_5_1", "SP_Summaries_welch_rect_centroid",
    "IN_AutoMutualInfoStats_40_gaussian_fmmi", "FC_LocalSimple_mean1_tauresrat",
    "CO_Embed2_Dist_tau_d_expfit_meandiff", "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1",
    "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1", "SB_TransitionMatrix_3ac_sumdiagcov",
    "PD_PeriodicityWang_th0_01",
)


def autocorrelation(y: np.ndarray) -> np.ndarray:
    size = 2 << max(1, int(len(y) - 1).bit_length())
    f = np.fft.rfft(y - y.mean(), size)
    ac = np.fft.irfft(f * np.conj(f), size)[: len(y)]
    return ac / ac[0]


def _first_below(ac: np.ndarray, level: float) -> int:
    below = np.flatnonzero(ac <= level)
    return int(below[0]) if below.size else len(ac)


def _outlier_timing(y: np.ndarray, step: float = 0.01) -> float:
    """How the median time of readings over a rising threshold departs from the middle."""
    if y.max() < step:
        return 0.0
    n, above = len(y), np.count_nonzero(y >= 0)
    timing, last_common, first_lonely = [], 0, None
    levels = np.arange(int(y.max() / step) + 1) * step
    for j, level in enumerate(levels):
        at = np.flatnonzero(y >= level) + 1
        timing.append(np.median(at) / (n / 2) - 1)
        if (len(at) - 1) * 100 / above > 2:
            last_common = j
        if len(at) < 2 and first_lonely is None:
            first_lonely = j
    stop = min(last_common, len(levels) - 1 if first_lonely is None else first_lonely)
    return float(np.median(timing[: stop + 1]))


def _first_dip(a: np.ndarray, otherwise: int) -> int:
    inner = (a[1:-1] < a[:-2]) & (a[1:-1] < a[2:])
    at = np.flatnonzero(inner)
    return int(at[0]) + 1 if at.size else otherwise


def _rect_spectrum(y: np.ndarray) -> tuple[float, float]:
    size = 1 << int(len(y) - 1).bit_length()
    p = np.abs(np.fft.rfft(y, size)) ** 2 / len(y)
    p[1:-1] *= 2
    w = 2 * np.pi * np.arange(len(p)) / size
    density = p / (2 * np.pi)
    running = np.cumsum(density)
    centre = w[np.argmax(running > running[-1] / 2)]
    return float(density[: len(p) // 5].sum() * (w[1] - w[0])), float(centre)


def _gaussian_ami_dip(y: np.ndarray, longest: int = 40) -> float:
    tau = min(longest, math.ceil(len(y) / 2))
    r = np.array([np.corrcoef(y[:-k], y[k:])[0, 1] for k in range(1, tau + 1) if len(y) - k > 2])
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(_first_dip(-0.5 * np.log(1 - r * r), tau))


def _embedding_fit(y: np.ndarray, ac: np.ndarray) -> float | None:
    n = len(y)
    tau = _first_below(ac, 0.0)
    if tau > n / 10:
        tau = n // 10
    if tau < 1:
        return None
    s = np.diff(y)
    d = np.sqrt(s[: n - tau - 1] ** 2 + s[tau:] ** 2)
    dev = d.std(ddof=1)
    if dev < 1e-3 or d.mean() == 0:
        return 0.0
    bins = max(1, math.ceil(np.ptp(d) / (3.5 * dev / len(d) ** (1 / 3))))
    counts, edges = np.histogram(d, bins=bins)
    centre = (edges[:-1] + edges[1:]) / 2
    fit = np.exp(-centre / d.mean()) / d.mean()
    return _value(np.abs(counts / len(d) - fit).mean())


def _fluctuation_split(y: np.ndarray, lag: int, ranged: bool) -> float:
    """Share of window sizes in the first of two straight regimes of log fluctuation."""
    n = len(y)
    sizes = np.unique(np.round(np.exp(np.linspace(math.log(5), math.log(n / 2), 50))).astype(int)) if n > 10 else []
    if len(sizes) < 12:
        return 0.0
    walk = np.cumsum(y[::lag])
    xs, ys = [], []
    for s in sizes:
        count = len(walk) // s
        if count == 0:
            continue
        res = _detrended(walk[: count * s].reshape(count, s))
        f = math.sqrt((np.ptp(res, axis=1) ** 2).mean()) if ranged else math.sqrt((res**2).mean())
        if f > 0:
            xs.append(math.log(s))
            ys.append(math.log(f))
    xs, ys = np.array(xs), np.array(ys)
    if len(xs) < 12:
        return 0.0

    def misfit(a, b):
        return np.linalg.norm(b - np.polyval(np.polyfit(a, b, 1), a))

    errors = [misfit(xs[:i], ys[:i]) + misfit(xs[i - 1:], ys[i - 1:]) for i in range(6, len(xs) - 5)]
    return float((int(np.argmin(errors)) + 6) / len(xs))


def _thirds(y: np.ndarray) -> np.ndarray:
    s, n = np.sort(y), len(y)

    def cut(q):
        at = min(max(n * q - 0.5, 0), n - 1)
        lo = int(at)
        return s[lo] + (at - lo) * (s[min(lo + 1, n - 1)] - s[lo])

    return (y > cut(1 / 3)).astype(int) + (y > cut(2 / 3))


def _transition_spread(y: np.ndarray, ac: np.ndarray) -> float | None:
    tau = max(1, _first_below(ac, 0.0))
    letters = _thirds(y[::tau])
    if len(letters) < 2:
        return None
    t = np.zeros((3, 3))
    np.add.at(t, (letters[:-1], letters[1:]), 1)
    return _value((t / (len(letters) - 1)).var(axis=0, ddof=1).sum())


def _wang_period(y: np.ndarray, margin: float = 0.01) -> float:
    """First autocovariance peak that rises clearly above the trough before it."""
    n = len(y)
    x = np.linspace(-1, 1, n)
    knee = x[max(n // 2 - 1, 0)]
    basis = np.stack([np.ones(n), x, x**2, x**3, np.clip(x - knee, 0, None) ** 3], axis=1)
    rest = y - basis @ np.linalg.lstsq(basis, y, rcond=None)[0]
    longest = math.ceil(n / 3)
    size = 2 << int(n - 1).bit_length()
    f = np.fft.rfft(rest, size)
    lags = np.arange(1, longest + 1)
    acv = np.fft.irfft(f * np.conj(f), size)[lags] / (n - lags)
    trough = None
    for i in range(1, len(acv) - 1):
        before, after = acv[i] - acv[i - 1], acv[i + 1] - acv[i]
        if before < 0 < after:
            trough = acv[i]
        elif before > 0 > after and trough is not None:
            if acv[i] - trough >= margin and acv[i] >= 0:
                return float(i)
    return 0.0


def canonical(v: np.ndarray) -> dict:
    out = dict.fromkeys(CANONICAL)
    if len(v) < 12 or v.max() == v.min():
        return out
    y = (v - v.mean()) / v.std(ddof=1)
    ac = autocorrelation(y)
    area, centre = _rect_spectrum(y)
    under = np.flatnonzero(ac[1:] < 1 / math.e)
    f1e = float(len(y))
    if under.size:
        i = int(under[0])
        f1e = i + (1 / math.e - ac[i]) / (ac[i + 1] - ac[i])
    step = np.diff(y)
    ratio = None
    if step.max() > step.min():
        own = _first_below(ac, 0.0)
        ratio = _first_below(autocorrelation(step), 0.0) / own if own else None
    values = (
        _outlier_timing(y), _outlier_timing(-y), f1e, float(_first_dip(ac, len(y))), area, centre,
        _gaussian_ami_dip(y), ratio, _embedding_fit(y, ac), _fluctuation_split(y, 2, False),
        _fluctuation_split(y, 1, True), _transition_spread(y, ac), _wang_period(y),
    )
    out.update({k: None if x is None else _value(x) for k, x in zip(CANONICAL, values)})
    return out
