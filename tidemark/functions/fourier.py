"""Batch Fourier helpers: Arrow in, NumPy on the stacked batch, Arrow out.

Spark has no transform of its own; everything around these (grouping, thresholds,
entropies, joins) is done with Spark expressions.  Signals are packed channel-major.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

_VEC = ArrayType(DoubleType())
_COMPLEX = StructType([StructField("re", _VEC), StructField("im", _VEC)])


def by_length(series, fn):
    """Apply fn to the stacked rows of each length, keeping row order."""
    out = [None] * len(series)
    groups = {}
    for k, v in enumerate(series):
        if v is not None and len(v):
            groups.setdefault(len(v), []).append(k)
    for idx in groups.values():
        for k, r in zip(idx, fn(np.stack([np.asarray(series.iloc[k], float) for k in idx]), idx)):
            out[k] = r
    return out


def _analytic(x, fs, band):
    n = x.shape[-1]
    h = np.zeros(n)
    h[0] = 1.0
    h[1:(n + 1) // 2] = 2.0
    if n % 2 == 0:
        h[n // 2] = 1.0
    if band is not None:
        f = np.fft.fftfreq(n, 1.0 / fs)
        h = np.where((f >= band[0]) & (f <= band[1]), h, 0.0)
    return np.fft.ifft(np.fft.fft(x, axis=-1) * h, axis=-1)


def welch(x, fs, nperseg, step):
    """One-sided density of Hann segments, segment means removed, averaged."""
    @F.pandas_udf(_VEC)
    def run(s: pd.Series) -> pd.Series:
        def psd(m, _):
            seg = min(nperseg, m.shape[1])
            w = np.hanning(seg + 1)[:-1]
            parts = np.stack([m[:, a:a + seg] for a in range(0, m.shape[1] - seg + 1, step)], axis=1)
            p = np.abs(np.fft.rfft((parts - parts.mean(-1, keepdims=True)) * w, axis=-1)) ** 2 / (fs * (w ** 2).sum())
            p[..., 1:p.shape[-1] - (seg % 2 == 0)] *= 2
            return p.mean(axis=1)
        return pd.Series(by_length(s, psd))
    return run(x)


def envelope(x, n_ch):
    """Hilbert amplitude per channel after removing the channel mean."""
    @F.pandas_udf(_VEC)
    def run(s: pd.Series) -> pd.Series:
        def env(m, _):
            c = m.reshape(len(m), n_ch, -1)
            return np.abs(_analytic(c - c.mean(-1, keepdims=True), 1.0, None)).reshape(len(m), -1)
        return pd.Series(by_length(s, env))
    return run(x)


def analytic(x, n_ch, fs, band=None):
    """Analytic signal per channel, limited to a frequency band by masking."""
    @F.pandas_udf(_COMPLEX)
    def run(s: pd.Series) -> pd.DataFrame:
        def z(m, _):
            c = m.reshape(len(m), n_ch, -1)
            return _analytic(c - c.mean(-1, keepdims=True), fs, band).reshape(len(m), -1)
        rows = by_length(s, z)
        return pd.DataFrame({"re": [None if r is None else r.real for r in rows], "im": [None if r is None else r.imag for r in rows]})
    return run(x)


def randomise_phases(x, phases, n_ch):
    """Same amplitude spectrum with the given phase added per frequency.

    `phases` holds one phase per frequency, shared by all channels; the first, and the
    last for even lengths, are ignored so the signal stays real.
    """
    @F.pandas_udf(_VEC)
    def run(s: pd.Series, p: pd.Series) -> pd.Series:
        def surr(m, idx):
            c = m.reshape(len(m), n_ch, -1)
            n = c.shape[-1]
            ph = np.stack([np.asarray(p.iloc[k], float) for k in idx])[:, None, :]
            ph[..., 0] = 0.0
            if n % 2 == 0:
                ph[..., -1] = 0.0
            return np.fft.irfft(np.fft.rfft(c, axis=-1) * np.exp(1j * ph), n=n, axis=-1).reshape(len(m), -1)
        return pd.Series(by_length(s, surr))
    return run(x, phases)
