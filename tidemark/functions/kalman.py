"""Batched two-state filter: many sessions and many parameter sets in lockstep.

One Arrow batch of packed sessions is filtered together, event by event, as arrays of
shape (sessions, parameter sets).  The drift is lower triangular, so the transition is
elementary and the step noise is P - F P F' with the stationary covariance P.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

NAMES = ("k_inh", "k_int", "k_d", "sigma_A", "sigma_Phi", "alpha", "beta", "r_A", "r_Phi", "r_Q", "rho")
# Nominal parameters of the deviation form.
NOMINAL = {"k_inh": 0.20, "k_int": 0.081, "k_d": 0.034, "sigma_A": 0.10, "sigma_Phi": 0.05,
           "alpha": 2.34, "beta": 1.87, "r_A": 0.10, "r_Phi": 0.10, "r_Q": 0.30, "rho": 0.0}
POSITIVE = ("k_inh", "k_d", "sigma_A", "sigma_Phi", "r_A", "r_Phi", "r_Q")
_VEC = ArrayType(DoubleType())
LANES = 16_000  # sessions x sets filtered together: their state stays in a core's cache
CELLS = 1_000_000  # events that are simulated together


def stationary(p):
    k, kap, kd = p["k_inh"], p["k_int"], p["k_d"]
    s00 = p["sigma_A"] ** 2 / (2 * k)
    s01 = -kap * s00 / (k + kd)
    return s00, s01, (p["sigma_Phi"] ** 2 - 2 * kap * s01) / (2 * kd)


def transition(p, dt):
    k, kap, kd = p["k_inh"], p["k_int"], p["k_d"]
    f00, f11 = np.exp(-k * dt), np.exp(-kd * dt)
    gap = kd - k
    same = np.abs(gap) < 1e-9
    f10 = -kap * np.where(same, dt * f00, (f00 - f11) / np.where(same, 1.0, gap))
    return f00, f10, f11


class _State:
    """Means, covariances, log-likelihood and (optionally) the chunk's dependence on an
    unknown start state: x_end = A x0 + .., evidence exp(eta x0 - x0' J x0 / 2)."""

    def __init__(self, shape, start, track):
        self.m0, self.m1, self.p00, self.p01, self.p11 = [np.broadcast_to(np.asarray(v, float), shape).copy() for v in start]
        self.ll = np.zeros(shape)
        self.track = track
        if track:
            z = lambda v=0.0: np.full(shape, v)
            self.a = [z(1.0), z(), z(), z(1.0)]
            self.eta, self.j = [z(), z()], [z(), z(), z()]

    def predict(self, f, s):
        f00, f10, f11 = f
        d00, d01, d11 = self.p00 - s[0], self.p01 - s[1], self.p11 - s[2]
        self.m0, self.m1 = f00 * self.m0, f10 * self.m0 + f11 * self.m1
        self.p00 = f00 * f00 * d00 + s[0]
        self.p01 = f00 * (f10 * d00 + f11 * d01) + s[1]
        self.p11 = f10 * f10 * d00 + 2 * f10 * f11 * d01 + f11 * f11 * d11 + s[2]
        if self.track:
            a = self.a
            self.a = [f00 * a[0], f00 * a[1], f10 * a[0] + f11 * a[2], f10 * a[1] + f11 * a[3]]

    def update(self, seen, y, h0, h1, r2):
        """Scalar observation y = h x + noise where `seen`; returns (mean, variance)."""
        g0, g1 = self.p00 * h0 + self.p01 * h1, self.p01 * h0 + self.p11 * h1
        s = h0 * g0 + h1 * g1 + r2
        mean = h0 * self.m0 + h1 * self.m1
        ok = np.broadcast_to(seen, s.shape)
        with np.errstate(invalid="ignore", divide="ignore"):
            e = np.where(ok, y - mean, 0.0)
            gain = np.where(ok, 1.0 / s, 0.0)
            self.ll += np.where(ok, np.where(s > 0, -0.5 * (np.log(2 * np.pi * s) + e * e / s), -np.inf), 0.0)
        if self.track:
            a = self.a
            w0, w1 = h0 * a[0] + h1 * a[2], h0 * a[1] + h1 * a[3]
            self.eta = [self.eta[0] + w0 * e * gain, self.eta[1] + w1 * e * gain]
            self.j = [self.j[0] + w0 * w0 * gain, self.j[1] + w0 * w1 * gain, self.j[2] + w1 * w1 * gain]
            self.a = [a[0] - g0 * gain * w0, a[1] - g0 * gain * w1, a[2] - g1 * gain * w0, a[3] - g1 * gain * w1]
        self.m0, self.m1 = self.m0 + g0 * gain * e, self.m1 + g1 * gain * e
        self.p00, self.p01, self.p11 = self.p00 - g0 * g0 * gain, self.p01 - g0 * g1 * gain, self.p11 - g1 * g1 * gain
        return mean, s


def _pad(series, size, fill=np.nan):
    out = np.full((len(series), size), fill)
    for k, v in enumerate(series):
        out[k, :len(v)] = np.asarray([np.nan if x is None else x for x in v], float) if v.dtype == object else v
    return out


def run_batch(t, kind, v0, v1, params, t_prev=None, start=None, track=False, use_eeg=True, use_rating=True, record=False):
    """Filter padded sessions; params maps names to (sessions, sets) arrays."""
    n, size = t.shape
    shape = (n, params["k_inh"].shape[1])
    s = stationary(params)
    st = _State(shape, start if start is not None else (0.0, 0.0, *s), track)
    prev = np.full(n, np.nan) if t_prev is None else t_prev.astype(float)
    c = params["rho"] * params["r_Phi"] / params["r_A"]
    rows = []
    for e in range(size):
        live = ~np.isnan(t[:, e])
        dt = np.where(live & ~np.isnan(prev), t[:, e] - prev, 0.0)
        if np.any(dt > 0):
            st.predict(transition(params, dt[:, None]), s)
        prev = np.where(live, t[:, e], prev)
        eeg, probe = live & (kind[:, e] == 0), live & (kind[:, e] == 1)
        a, b = v0[:, e][:, None], v1[:, e][:, None]
        has_a, has_b = (eeg & ~np.isnan(v0[:, e]))[:, None] & use_eeg, (eeg & ~np.isnan(v1[:, e]))[:, None] & use_eeg
        zero = np.zeros(shape)
        pa = st.update(has_a, a, zero + 1.0, zero, params["r_A"] ** 2)
        # With correlated noise the second channel is taken net of the first one's noise.
        both = (has_a & has_b) & (params["rho"] != 0)
        ch = np.where(both, -c, 0.0)
        with np.errstate(invalid="ignore"):
            yb = np.where(both, b - c * a, b)
        pb_ = st.update(has_b, yb, ch, zero + 1.0, np.where(both, (1 - params["rho"] ** 2), 1.0) * params["r_Phi"] ** 2)
        seen = (probe & ~np.isnan(v0[:, e]))[:, None] & use_rating
        pq = st.update(seen, a, -params["beta"] + zero, params["alpha"] + zero, params["r_Q"] ** 2)
        if record:
            with np.errstate(invalid="ignore"):
                rows.append([pq[0], pq[1], np.where(has_a, (a - pa[0]) / np.sqrt(pa[1]), np.nan), np.where(has_b, (yb - pb_[0]) / np.sqrt(pb_[1]), np.nan),
                             np.where(seen, (a - pq[0]) / np.sqrt(pq[1]), np.nan), st.m0, st.m1, st.p00, st.p01, st.p11])
    return st, rows


def evidence(t, kind, v0, v1, params, use_eeg=True, use_rating=True):
    """Log-likelihoods alone, as run_batch gives them, of padded sessions sorted by length.

    Finished sessions leave the work, and a channel's update only touches the sessions that show it. params maps names to (sessions, sets)
    or (1, sets) arrays.
    """
    n, size = t.shape
    gone = np.isnan(t).sum(axis=1)
    k, kap, kd = params["k_inh"], params["k_int"], params["k_d"]
    gap = kd - k
    if np.any(params["rho"] != 0) or np.any(np.abs(gap) < 1e-9) or np.any(np.diff(gone) > 0) or np.isnan(t[np.arange(size) < size - gone[:, None]]).any():
        return run_batch(t, kind, v0, v1, {c: np.broadcast_to(v, (n, v.shape[1])) for c, v in params.items()}, use_eeg=use_eeg, use_rating=use_rating)[0].ll
    # Sets by sessions: what differs by session alone is then added along the long axis.
    params = {c: np.ascontiguousarray(v.T) for c, v in params.items()}
    k, kap, kd = params["k_inh"], params["k_int"], params["k_d"]
    shape, s, lead = (len(k), n), stationary(params), -kap / (kd - k)

    def of(v, r):
        return v if v.shape[1] == 1 else v[:, r] if isinstance(r, slice) else v.take(r, axis=1)

    x = [np.zeros(shape), np.zeros(shape), *(np.broadcast_to(v, shape).copy() for v in s)]
    ll, r2 = np.zeros(shape), [params[c] ** 2 for c in ("r_A", "r_Phi", "r_Q")]
    alpha, beta = params["alpha"], params["beta"]

    def update(r, y, channel):
        m0, m1, p00, p01, p11 = (v[:, r] if isinstance(r, slice) else v.take(r, axis=1) for v in x)
        y = y[r]
        if channel == 0:
            g0, g1, e, v = p00, p01, y - m0, p00 + of(r2[0], r)
        elif channel == 1:
            g0, g1, e, v = p01, p11, y - m1, p11 + of(r2[1], r)
        else:
            a, b = of(alpha, r), of(beta, r)
            g0, g1, e = a * p01 - b * p00, a * p11 - b * p01, y - (a * m1 - b * m0)
            v = a * g1 - b * g0 + of(r2[2], r)
        k0, k1 = g0 / v, g1 / v
        with np.errstate(invalid="ignore", divide="ignore"):
            d = -0.5 * (np.log(2 * np.pi * v) + e * e / v)
        ll[:, r] += d if (v > 0).all() else np.where(v > 0, d, -np.inf)
        for at, c in zip(x, (m0 + k0 * e, m1 + k1 * e, p00 - k0 * g0, p01 - k0 * g1, p11 - k1 * g1)):
            at[:, r] = c

    first = np.searchsorted(-gone, -(size - 1 - np.arange(size)), side="left")  # of the sessions with an event e
    t, kind, v0, v1 = (np.ascontiguousarray(v.T) for v in (t, kind, v0, v1))
    for e in range(size):
        r = slice(int(first[e]), n)
        if e:
            dt = t[e, r] - t[e - 1, r]
            if np.any(dt > 0):
                f00, f11 = np.exp(-of(k, r) * dt), np.exp(-of(kd, r) * dt)
                f10 = of(lead, r) * (f00 - f11)
                m0, m1 = x[0][:, r], x[1][:, r]
                d00, d01, d11 = (v[:, r] - of(c, r) for v, c in zip(x[2:], s))
                u = f10 * d00 + f11 * d01
                m1 *= f11
                m1 += f10 * m0
                m0 *= f00
                x[4][:, r] = f10 * (u + f11 * d01) + f11 * f11 * d11 + of(s[2], r)
                x[3][:, r] = f00 * u + of(s[1], r)
                x[2][:, r] = f00 * f00 * d00 + of(s[0], r)
        seen, eeg = ~np.isnan(v0[e, r]), kind[e, r] == 0
        for channel, on, y, shown in ((0, use_eeg, v0, seen & eeg), (1, use_eeg, v1, ~np.isnan(v1[e, r]) & eeg), (2, use_rating, v0, seen & (kind[e, r] == 1))):
            if on and shown.any():
                update(r if shown.all() else np.flatnonzero(shown) + r.start, y[e], channel)
    return ll.T


def _batches(t, width):
    """Row slices whose lanes (rows x sets) stay bounded, sorted by length."""
    order = np.argsort([len(v) for v in t], kind="stable")
    step = max(1, LANES // max(width, 1))
    return [order[a:a + step] for a in range(0, len(order), step)]


def _padded(at, cols):
    size = max(len(cols[0].iloc[k]) for k in at)
    return [_pad(c.iloc[at], size) for c in cols]


def _inputs(at, cols, grids):
    every = grids.to_numpy()
    g = np.concatenate([r for k in at for r in every[k]]).astype(float).reshape(len(at), -1, len(NAMES))
    return *_padded(at, cols), {n: g[:, :, i] for i, n in enumerate(NAMES)}


def _width(grids):
    return len(grids.iloc[0]) if len(grids) else 1


def loglik(t, kind, v0, v1, sets, use_eeg=True, use_rating=True):
    """array<double>: log-likelihood of one packed session under each of `sets` (dicts), the same for all sessions."""
    g = np.array([[float(r[n]) for n in NAMES] for r in sets])
    params = {n: g[None, :, i] for i, n in enumerate(NAMES)}

    @F.pandas_udf(_VEC)
    def run(t: pd.Series, kind: pd.Series, v0: pd.Series, v1: pd.Series) -> pd.Series:
        out = [None] * len(t)
        for at in _batches(t, len(g)):
            for k, r in zip(at, evidence(*_padded(at, (t, kind, v0, v1)), params, use_eeg, use_rating)):
                out[k] = r
        return pd.Series(out)
    return run(t, kind, v0, v1)


def loglik_scaled(t, kind, v0, v1, theta, name, factors):
    """array<double>: log-likelihood of one packed session under its set `theta` with one parameter times each of `factors`."""
    at_name, f = NAMES.index(name), np.asarray(factors, float)

    @F.pandas_udf(_VEC)
    def run(t: pd.Series, kind: pd.Series, v0: pd.Series, v1: pd.Series, theta: pd.Series) -> pd.Series:
        out = [None] * len(t)
        for at in _batches(t, len(f)):
            g = np.stack(theta.iloc[at].to_list()).astype(float)
            params = {n: g[:, i, None] * (f if i == at_name else np.ones(len(f))) for i, n in enumerate(NAMES)}
            for k, r in zip(at, evidence(*_padded(at, (t, kind, v0, v1)), params)):
                out[k] = r
        return pd.Series(out)
    return run(t, kind, v0, v1, theta)


_ELEMENT = StructType([StructField(c, _VEC) for c in ("ll", "m", "p", "a", "eta", "j")])


def element(t, kind, v0, v1, grid, t_prev, use_eeg=True, use_rating=True):
    """A chunk's effect on an unknown start state, per parameter set (set-major)."""
    @F.pandas_udf(_ELEMENT)
    def run(t: pd.Series, kind: pd.Series, v0: pd.Series, v1: pd.Series, grid: pd.Series, t_prev: pd.Series) -> pd.DataFrame:
        out = {c: [None] * len(t) for c in ("ll", "m", "p", "a", "eta", "j")}
        for at in _batches(t, _width(grid)):
            st, _ = run_batch(*_inputs(at, (t, kind, v0, v1), grid), t_prev=t_prev.iloc[at].to_numpy(float), start=(0.0,) * 5, track=True, use_eeg=use_eeg, use_rating=use_rating)
            parts = {"ll": [st.ll], "m": [st.m0, st.m1], "p": [st.p00, st.p01, st.p11], "a": st.a, "eta": st.eta, "j": st.j}
            for c, v in parts.items():
                flat = np.stack(v, axis=-1).reshape(len(at), -1)
                for k, r in zip(at, flat):
                    out[c][k] = r
        return pd.DataFrame(out)
    return run(t, kind, v0, v1, grid, t_prev)


def chain(elements, grid):
    """Walk consecutive chunk elements (rows in order) from the stationary start.

    Yields (evidence, start mean, start covariance) of every chunk per parameter set.
    """
    p = {n: np.asarray(grid)[:, i] for i, n in enumerate(NAMES)}
    s = stationary(p)
    m = np.zeros((len(s[0]), 2))
    cov = np.stack([np.stack([s[0], s[1]], -1), np.stack([s[1], s[2]], -1)], -2)
    eye = np.eye(2)
    sym = lambda v: np.stack([np.stack([v[:, 0], v[:, 1]], -1), np.stack([v[:, 1], v[:, 2]], -1)], -2)
    for e in elements:
        b, c, a, eta, j = e["m"].reshape(-1, 2), sym(e["p"].reshape(-1, 3)), e["a"].reshape(-1, 2, 2), e["eta"].reshape(-1, 2), sym(e["j"].reshape(-1, 3))
        g = eta - np.einsum("pij,pj->pi", j, m)
        mix = np.linalg.inv(eye + cov @ j)
        ll = e["ll"] - 0.5 * np.linalg.slogdet(eye + cov @ j)[1] + 0.5 * np.einsum("pi,pij,pj->p", g, mix @ cov, g) + (eta * m).sum(-1) - 0.5 * np.einsum("pi,pij,pj->p", m, j, m)
        yield ll, m, cov
        m = np.einsum("pij,pj->pi", a @ mix, m + np.einsum("pij,pj->pi", cov, eta)) + b
        cov = a @ mix @ cov @ np.swapaxes(a, -1, -2) + c


_PATH = StructType([StructField(c, _VEC) for c in ("pred", "pred_var", "z_a", "z_p", "z_q", "m0", "m1", "p00", "p01", "p11")])


def path(t, kind, v0, v1, grid, t_prev, start, use_eeg=True, use_rating=True):
    """Per-event predictions, standardised innovations and filtered state (one set).

    `start` is [m0, m1, p00, p01, p11] at t_prev, or NULL for the stationary state.
    """
    @F.pandas_udf(_PATH)
    def run(t: pd.Series, kind: pd.Series, v0: pd.Series, v1: pd.Series, grid: pd.Series, t_prev: pd.Series, start: pd.Series) -> pd.DataFrame:
        out = {f.name: [None] * len(t) for f in _PATH}
        for at in _batches(t, _width(grid)):
            cols = _inputs(at, (t, kind, v0, v1), grid)
            begin = np.stack([np.broadcast_to(x, (len(at), 1)) for x in (0.0, 0.0, *stationary(cols[4]))])
            given = np.array([start.iloc[k] is not None for k in at])
            for q in np.flatnonzero(given):
                begin[:, q, 0] = np.asarray(start.iloc[at[q]], float)
            prev = np.where(given, t_prev.iloc[at].to_numpy(float), np.nan)
            _, rows = run_batch(*cols, t_prev=prev, start=begin, use_eeg=use_eeg, use_rating=use_rating, record=True)
            cube = np.stack([np.stack([np.broadcast_to(x, (len(at), 1))[:, 0] for x in r]) for r in rows])
            for i, f in enumerate(_PATH):
                for q, k in enumerate(at):
                    v = cube[:len(t.iloc[k]), i, q]
                    out[f.name][k] = [None if np.isnan(x) else float(x) for x in v]
        return pd.DataFrame(out)
    return run(t, kind, v0, v1, grid, t_prev, start)


_SIM = StructType([StructField(c, _VEC) for c in ("x0", "x1", "n0", "n1")])


def _normals(key, first, n):
    """Four standard normals for each of n events from number `first` on: a counter-based stream, so chunks do not change it."""
    u = np.random.Generator(np.random.Philox(key=int(key) % (1 << 64), counter=int(first))).random((n, 4))
    r, at = np.sqrt(-2.0 * np.log1p(-u[:, (0, 2)])), 2 * np.pi * u[:, (1, 3)]
    return np.concatenate([r * np.cos(at), r * np.sin(at)], axis=1)


def simulate(t, key, first, grid, t_prev):
    """Latent path on given times (one parameter set) and two standard-normal draws for the noise of every event.

    A first chunk starts from the stationary law; a later one starts from zero at
    t_prev, and the earlier chunks' contribution is added afterwards. All draws follow from `key` and
    the event's number in the session, `first` for the chunk's first event.
    """
    @F.pandas_udf(_SIM)
    def run(t: pd.Series, key: pd.Series, first: pd.Series, grid: pd.Series, t_prev: pd.Series) -> pd.DataFrame:
        out = {f.name: [None] * len(t) for f in _SIM}
        order = np.argsort([len(v) for v in t], kind="stable")
        cells = np.cumsum([len(t.iloc[k]) for k in order]) // CELLS
        for at in np.split(order, np.flatnonzero(np.diff(cells)) + 1):
            size = max(len(t.iloc[k]) for k in at)
            tt = _pad(t.iloc[at], size)
            z = np.zeros((len(at), size, 4))
            for q, k in enumerate(at):
                z[q, :len(t.iloc[k])] = _normals(key.iloc[k], first.iloc[k], len(t.iloc[k]))
            g = np.stack([np.asarray(grid.iloc[k][0], float) for k in at])
            p = {n: g[:, i] for i, n in enumerate(NAMES)}
            s = stationary(p)
            prev = t_prev.iloc[at].to_numpy(float)

            def noise(c, u, v):
                l00 = np.sqrt(np.maximum(c[0], 1e-15))
                l10 = c[1] / l00
                return l00 * u, l10 * u + np.sqrt(np.maximum(c[2] - l10 * l10, 0.0)) * v
            x0, x1 = np.zeros(len(at)), np.zeros(len(at))
            xs = np.empty((2, len(at), size))
            for k in range(size):
                dt = np.nan_to_num(tt[:, k] - (prev if k == 0 else tt[:, k - 1]))
                f00, f10, f11 = transition(p, dt)
                q = (s[0] - f00 * f00 * s[0], s[1] - f00 * (f10 * s[0] + f11 * s[1]), s[2] - (f10 * f10 * s[0] + 2 * f10 * f11 * s[1] + f11 * f11 * s[2]))
                n0, n1 = noise(q, z[:, k, 0], z[:, k, 1])
                moved = dt > 0
                x0, x1 = np.where(moved, f00 * x0 + n0, x0), np.where(moved, f10 * x0 + f11 * x1 + n1, x1)
                if k == 0:
                    z0, z1 = noise(s, z[:, 0, 0], z[:, 0, 1])
                    x0, x1 = np.where(np.isnan(prev), z0, x0), np.where(np.isnan(prev), z1, x1)
                xs[0, :, k], xs[1, :, k] = x0, x1
            for q, k in enumerate(at):
                n = len(t.iloc[k])
                for name, v in zip(out, (xs[0, q, :n], xs[1, q, :n], z[q, :n, 2], z[q, :n, 3])):
                    out[name][k] = v
        return pd.DataFrame(out)
    return run(t, key, first, grid, t_prev)


def _turns(k, kd, dt):
    """The transition over `dt`, its lower left cell for k_int = 1, and the slopes of that cell in k and kd; equal rates are no special case."""
    f00, f11, gap = np.exp(-k * dt), np.exp(-kd * dt), kd - k
    near = np.abs(gap) < 1e-4
    over = 1.0 / np.where(near, 1.0, gap)
    unit = (f11 - f00) * over
    by_k, by_kd = (unit + dt * f00) * over, -(unit + dt * f11) * over
    if near.any():
        x = gap * dt
        phi, bend = 1 - x / 2 + x * x / 6 - x ** 3 / 24, -0.5 + x / 3 - x * x / 8
        unit = np.where(near, -dt * f00 * phi, unit)
        by_k, by_kd = np.where(near, dt * dt * f00 * (phi + bend), by_k), np.where(near, -dt * dt * f00 * bend, by_kd)
    return f00, unit, f11, by_k, by_kd


SLOPES = ("k_inh", "k_int", "k_d", "sigma_A", "sigma_Phi", "alpha", "beta", "r_A", "r_Phi", "r_Q")


def slopes(t, kind, seen, y, params):
    """(log-likelihoods, their slopes in SLOPES) of copies of padded sessions, each copy under a set of its own or all under one, without rho.

    t, kind: (sessions, events); seen: two such masks; y: two arrays (events, sessions, copies); params: name -> (copies,) or (1,).
    One pass filters, one goes back over what it has left, so that all slopes together cost about as much as the filter.
    """
    n, size = t.shape
    k, kap, kd = params["k_inh"], params["k_int"], params["k_d"]
    alpha, beta, s = params["alpha"], params["beta"], stationary(params)
    r2 = [params[c] ** 2 for c in ("r_A", "r_Phi", "r_Q")]
    shape = (n, y[0].shape[2])
    x = [np.zeros(shape), np.zeros(shape), *(np.broadcast_to(v, (n, len(k))).copy() for v in s)]
    ll, tape = np.zeros(shape), []
    dts = np.nan_to_num(np.diff(t, axis=1, prepend=t[:, :1]))
    shown = (seen[0] & (kind == 0), seen[1] & (kind == 0), seen[0] & (kind == 1))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for e in range(size):
            if (dts[:, e] > 0).any():
                dt = dts[:, e, None]
                f00, unit, f11, by_k, by_kd = _turns(k, kd, dt)
                f10 = kap * unit
                m0, m1, d00, d01, d11 = x[0], x[1], x[2] - s[0], x[3] - s[1], x[4] - s[2]
                u, w = f10 * d00 + f11 * d01, f10 * d01 + f11 * d11
                tape.append((None, dt, f00, f10, f11, unit, by_k, by_kd, m0, m1, d00, d01, d11, u, w))
                x = [f00 * m0, f10 * m0 + f11 * m1, f00 * f00 * d00 + s[0], f00 * u + s[1], f10 * u + f11 * w + s[2]]
            for channel in range(3):
                r = np.flatnonzero(shown[channel][:, e])
                if not len(r):
                    continue
                whole = len(r) == n
                m0, m1, p00, p01, p11 = x if whole else (v[r] for v in x)
                obs = y[channel % 2][e]
                obs = obs if whole else obs[r]
                if channel == 0:
                    g0, g1, miss, v = p00, p01, obs - m0, p00 + r2[0]
                elif channel == 1:
                    g0, g1, miss, v = p01, p11, obs - m1, p11 + r2[1]
                else:
                    g0, g1, miss = alpha * p01 - beta * p00, alpha * p11 - beta * p01, obs - (alpha * m1 - beta * m0)
                    v = alpha * g1 - beta * g0 + r2[2]
                iv = 1.0 / v
                k0, k1 = g0 * iv, g1 * iv
                gain = np.where(v > 0, -0.5 * (np.log(2 * np.pi * v) + miss * miss * iv), -np.inf)
                tape.append((channel, None if whole else r, k0, k1, iv, miss, *((g0, g1, m0, m1, p00, p01, p11) if channel == 2 else ())))
                after = (m0 + k0 * miss, m1 + k1 * miss, p00 - k0 * g0, p01 - k0 * g1, p11 - k1 * g1)
                if whole:
                    ll += gain
                    x = list(after)
                else:
                    ll[r] += gain
                    for at, c in zip(x, after):
                        at[r] = c
        b = {c: np.zeros(shape) for c in ("k", "kap", "kd", "s0", "s1", "s2", "alpha", "beta", 0, 1, 2)}
        z = [np.zeros(shape) for _ in range(5)]
        while tape:
            channel, *held = tape.pop()
            if channel is None:
                dt, f00, f10, f11, unit, by_k, by_kd, m0, m1, d00, d01, d11, u, w = held
                a0, a1, a00, a01, a11 = z
                ub, wb = f10 * a11 + f00 * a01, f11 * a11
                h10 = a1 * m0 + a11 * u + ub * d00 + wb * d01
                b["kap"] += unit * h10
                h10 *= kap
                b["k"] += by_k * h10 - dt * f00 * (a0 * m0 + a01 * u + 2 * f00 * d00 * a00)
                b["kd"] += by_kd * h10 - dt * f11 * (a1 * m1 + a11 * w + ub * d01 + wb * d11)
                z = [f00 * a0 + f10 * a1, f11 * a1, f00 * f00 * a00 + f10 * ub, f11 * ub + f10 * wb, f11 * wb]
                b["s0"] += a00 - z[2]
                b["s1"] += a01 - z[3]
                b["s2"] += a11 - z[4]
                continue
            r, k0, k1, iv, miss, *rest = held
            a0, a1, a00, a01, a11 = z if r is None else (v[r] for v in z)
            ev = miss * iv
            lean = a0 * k0 + a1 * k1
            missed = lean - ev
            h0, h1 = a0 * ev - 2 * a00 * k0 - a01 * k1, a1 * ev - a01 * k0 - 2 * a11 * k1
            vb = (a00 * k0 + a01 * k1) * k0 + a11 * k1 * k1 - ev * lean + 0.5 * (ev * ev - iv)
            if channel == 0:
                before = (a0 - missed, a1, a00 + h0 + vb, a01 + h1, a11)
            elif channel == 1:
                before = (a0, a1 - missed, a00, a01 + h0, a11 + h1 + vb)
            else:
                g0, g1, m0, m1, p00, p01, p11 = rest
                h0, h1 = h0 - beta * vb, h1 + alpha * vb
                before = (a0 + beta * missed, a1 - alpha * missed, a00 - beta * h0, a01 + alpha * h0 - beta * h1, a11 + alpha * h1)
                by_alpha, by_beta = g1 * vb - missed * m1 + p01 * h0 + p11 * h1, missed * m0 - g0 * vb - p00 * h0 - p01 * h1
            at = slice(None) if r is None else r
            b[channel][at] += vb
            if channel == 2:
                b["alpha"][at] += by_alpha
                b["beta"][at] += by_beta
            if r is None:
                z = list(before)
            else:
                for into, c in zip(z, before):
                    into[r] = c
        # The stationary start, and through it the parameters that only act there and in the step noise.
        s2 = b["s2"] + z[4]
        s1 = b["s1"] + z[3] - s2 * kap / kd
        s0 = b["s0"] + z[2] - s1 * kap / (k + kd)
        moved = s1 * s[1] / (k + kd)
        out = {"k_inh": b["k"] - s0 * s[0] / k - moved, "k_int": b["kap"] - s1 * s[0] / (k + kd) - s2 * s[1] / kd, "k_d": b["kd"] - moved - s2 * s[2] / kd, "sigma_A": 2 * s0 * s[0] / params["sigma_A"],
               "sigma_Phi": s2 * params["sigma_Phi"] / kd, "alpha": b["alpha"], "beta": b["beta"],
               **{c: 2 * params[c] * b[i] for i, c in enumerate(("r_A", "r_Phi", "r_Q"))}}
    return ll, [out[c] for c in SLOPES]


def copied(t, kind, lengths, keys, params):
    """The observations that `simulate` draws for copies of whole padded sessions: two arrays (events, sessions, copies).

    keys: the streams of the copies, (sessions, copies); params: one set.
    """
    n, size = t.shape
    u = np.full((*keys.shape, size, 4), 0.5)
    stream = np.random.Philox(key=0)
    state, draw = stream.state, np.random.Generator(stream)
    for i, (length, row) in enumerate(zip(lengths, keys.astype(np.int64).view(np.uint64))):
        for j, key in enumerate(row):
            state["state"]["key"][0] = key
            stream.state = state
            draw.random(out=u[i, j, :length])
    u = np.ascontiguousarray(u.transpose(3, 2, 0, 1))
    r = np.sqrt(-2.0 * np.log1p(-u[::2]))
    at = 2 * np.pi * u[1::2]
    (z0, z1), (n0, n1) = r * np.cos(at), r * np.sin(at)
    s = stationary(params)
    dt = np.nan_to_num(np.diff(t, axis=1, prepend=t[:, :1]))
    f00, f10, f11 = (f[:, :, None] for f in transition(params, dt))
    moved = (dt > 0)[:, :, None]

    def root(c):
        l00 = np.sqrt(np.maximum(c[0], 1e-15))
        l10 = c[1] / l00
        return l00, l10, np.sqrt(np.maximum(c[2] - l10 * l10, 0.0))

    q = root((s[0] - f00 * f00 * s[0], s[1] - f00 * (f10 * s[0] + f11 * s[1]), s[2] - (f10 * f10 * s[0] + 2 * f10 * f11 * s[1] + f11 * f11 * s[2])))
    l = root(s)  # noqa: E741
    x0, x1 = l[0] * z0[0], l[1] * z0[0] + l[2] * z1[0]
    y = [np.empty((size, *keys.shape)) for _ in range(2)]
    for e in range(size):
        if e and moved[:, e].any():
            w0, w1 = q[0][:, e] * z0[e], q[1][:, e] * z0[e] + q[2][:, e] * z1[e]
            x0, x1 = np.where(moved[:, e], f00[:, e] * x0 + w0, x0), np.where(moved[:, e], f10[:, e] * x0 + f11[:, e] * x1 + w1, x1)
        np.add(x0, params["r_A"] * n0[e], out=y[0][e])
        asked = np.flatnonzero(kind[:, e] == 1)
        if len(asked):
            y[0][e, asked] = params["alpha"] * x1[asked] - params["beta"] * x0[asked] + params["r_Q"] * n0[e, asked]
        np.add(x1, params["r_Phi"] * n1[e], out=y[1][e])
    return y


def copy_slopes(frames, truth, sets, information):
    """Sums over packed whole sessions with the `keys` of their copies: (log-likelihoods, slopes (copies, SLOPES), information or None).

    The copies are drawn under `truth` and scored each under its own of `sets` (copies, NAMES). Slopes are on the log scale where a parameter is positive;
    the information is the sum of the outer products of the slopes over sessions and copies.
    """
    sets = np.asarray(sets, float)
    shared = (sets == sets[0]).all()
    scale = np.stack([sets[:, NAMES.index(c)] if c in POSITIVE else np.ones(len(sets)) for c in SLOPES])
    ll, g = np.zeros(len(sets)), np.zeros((len(SLOPES), len(sets)))
    outer = np.zeros((len(SLOPES), len(SLOPES))) if information else None
    for df in frames:
        lengths = df["t"].map(len).to_numpy()
        order = np.argsort(lengths, kind="stable")
        while len(order):
            # The longest that are left, as many as fit; of one that does not fit, a part of its copies at a time.
            size = int(lengths[order[-1]])
            at, order = order[-max(1, CELLS // 3 // (size * len(sets))):], order[:-max(1, CELLS // 3 // (size * len(sets)))]
            t, kind, v0, v1 = (_pad(df[c].iloc[at], size) for c in ("t", "kind", "v0", "v1"))
            keys, seen = np.stack(df["keys"].iloc[at].to_list()), (~np.isnan(v0), ~np.isnan(v1))
            step = max(1, CELLS // 3 // (size * len(at)))
            for a in range(0, len(sets), step):
                mine = sets[a:a + step]
                p = {c: mine[:1, i] if shared else mine[:, i] for i, c in enumerate(NAMES)}
                value, slope = slopes(t, kind, seen, copied(t, kind, lengths[at], keys[:, a:a + step], truth), p)
                slope = np.stack(slope) * scale[:, None, a:a + step]
                ll[a:a + step] += value.sum(axis=0)
                g[:, a:a + step] += slope.sum(axis=1)
                if information:
                    flat = slope.reshape(len(SLOPES), -1)
                    outer += flat @ flat.T
    return ll, g.T, outer
