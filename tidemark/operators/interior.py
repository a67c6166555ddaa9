"""One group's convex problem by a primal-dual interior point method (predictor and corrector, infeasible start).

Inside grouped maps only: a problem is as large as one date's candidates or one account's names.  Every answer comes with its
largest violation of the optimality conditions, so that a caller can see what it is worth.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

TOLERANCE = 1e-9
#: A name's specific variance counts as this share of its variance at least.
LEAST_SPECIFIC = 1e-3
STEPS = 80


class Answer(NamedTuple):
    x: np.ndarray
    residual: float

    @property
    def solved(self) -> bool:
        return self.residual < 1e-6


def _longest(v: np.ndarray, dv: np.ndarray) -> float:
    falls = dv < 0
    return min(1.0, float((v[falls] / -dv[falls]).min())) if falls.any() else 1.0


def solve(p, tolerance: float = TOLERANCE, steps: int = STEPS) -> Answer:
    """Minimises ``p``: a convex objective under equations ``p.a x = p.b`` and inequalities ``p.limits(x) <= 0``.

    The residual is the largest of: slope of the Lagrangian, violation of equations and inequalities, and complementarity,
    in units of the objective's largest coefficient.  The best point met is returned, converged or not.
    """
    with np.errstate(all="ignore"):  # a problem without a solution runs away, which the residual shows
        return _solve(p, tolerance, steps)


def _solve(p, tolerance: float, steps: int) -> Answer:
    x, y = p.start(), np.zeros(len(p.b))
    s = np.maximum(-p.limits(x), 0.1)
    z = np.ones(len(s))
    best = Answer(x, np.inf)
    for _ in range(steps):
        slope = p.slope(x) + p.a.T @ y + p.limits_t(x, z)
        equal, limit = p.a @ x - p.b, p.limits(x)
        residual = max(np.abs(slope).max(), np.abs(equal).max(), max(limit.max(), 0.0), np.abs(np.minimum(z, 1.0) * np.minimum(-limit, 1.0)).max(), (s * z).max())
        if not np.isfinite(residual):
            break
        if residual < best.residual:
            best = Answer(x.copy(), float(residual))
        if residual < tolerance:
            break
        slack, phi = limit + s, z / s
        try:
            newton, times = p.newton(x, z, phi)
        except np.linalg.LinAlgError:
            break

        def step(target):
            right = -slope - p.limits_t(x, phi * slack - target / s)
            dx, dy = np.zeros_like(x), np.zeros_like(y)
            for _ in range(3):  # what rounding has left is solved for again
                more, change = newton(right - times(dx) - p.a.T @ dy, -equal - p.a @ dx)
                dx, dy = dx + more, dy + change
            moved = p.limits_times(x, dx)
            return dx, dy, -slack - moved, phi * (slack + moved) - target / s

        gap = s @ z / len(s)
        dx, dy, ds, dz = step(s * z)
        ahead = (s + _longest(s, ds) * ds) @ (z + _longest(z, dz) * dz) / len(s)
        centre = (ahead / gap) ** 3 * gap
        dx, dy, ds, dz = step(s * z + ds * dz - centre)
        along = 0.995 * min(_longest(s, ds), _longest(z, dz))
        x, y, s, z = x + along * dx, y + along * dy, np.maximum(s + along * ds, 1e-30), np.maximum(z + along * dz, 1e-30)
    return best


class Boxed:
    """min x'Qx/2 + c'x with equations and bounds on every unknown; Q may be singular."""

    def __init__(self, q, c, a, b, low, high):
        unit = 1.0 / max(np.abs(q).max(initial=0.0), np.abs(c).max(initial=0.0), 1e-300)
        self.q, self.c = q * unit, c * unit
        self.a, self.b = np.atleast_2d(np.asarray(a, float)), np.atleast_1d(np.asarray(b, float))
        self.low, self.high = (np.broadcast_to(v, c.shape).astype(float) for v in (low, high))

    def start(self):
        return (self.low + self.high) / 2

    def slope(self, x):
        return self.q @ x + self.c

    def limits(self, x):
        return np.concatenate([self.low - x, x - self.high])

    def limits_times(self, x, dx):
        return np.concatenate([-dx, dx])

    def limits_t(self, x, z):
        n = len(self.c)
        return z[n:] - z[:n]

    def newton(self, x, z, phi):
        """Solves H dx + a'dy = r, a dx = gap for any r and gap; and H times a vector."""
        n = len(self.c)
        h = self.q + np.diag(phi[:n] + phi[n:])
        scale = 1 / np.sqrt(np.diag(h))
        inverse = np.linalg.inv(h * scale * scale[:, None] + 1e-15 * np.eye(n)) * scale * scale[:, None]
        cross = inverse @ self.a.T
        middle = np.linalg.pinv(self.a @ cross)

        def newton(r, gap):
            part = inverse @ r
            dy = middle @ (self.a @ part - gap)
            return part - cross @ dy, dy

        return newton, lambda v: h @ v


class Factored(Boxed):
    """The same with Q = B C C' B', which is never formed: ``parts`` are pairs (rows of B, their block of its columns), one
    after the other, and nothing else of B; a step costs names x columns of a block^2 and columns x rank^2."""

    def __init__(self, parts, root, c, a, b, low, high):
        ends = np.cumsum([block.shape[1] for _, block in parts])[:-1] if parts else []
        self.parts = [(rows, block, part) for (rows, block), part in zip(parts, np.split(root, ends))]
        variance = max((np.square(block @ part).sum(1).max(initial=0.0) for _, block, part in self.parts), default=0.0)
        super().__init__(np.full((1, 1), variance), c, a, b, low, high)
        unit = self.q[0, 0] / variance if variance > 0 else 0.0
        self.root = root * np.sqrt(unit)
        self.parts = [(rows, block, part * np.sqrt(unit)) for rows, block, part in self.parts]

    def _in(self, x):
        """C'B' times a vector (or a matrix)."""
        out = np.zeros((self.root.shape[1], *x.shape[1:]))
        for rows, block, part in self.parts:
            out += part.T @ (block.T @ x[rows])
        return out

    def _out(self, u):
        out = np.zeros((len(self.c), *u.shape[1:]))
        for rows, block, part in self.parts:
            out[rows] = block @ (part @ u)
        return out

    def slope(self, x):
        return self._out(self._in(x)) + self.c

    def newton(self, x, z, phi):
        n = len(self.c)
        d = phi[:n] + phi[n:]
        middle = np.vstack([(block.T @ (block / d[rows, None])) @ part for rows, block, part in self.parts]) if self.parts else self.root
        small = np.linalg.inv(np.eye(self.root.shape[1]) + self.root.T @ middle)

        def inverse(r):
            part = (r.T / d).T
            return part - (self._out(small @ self._in(part)).T / d).T

        cross = inverse(self.a.T)
        equal = np.linalg.pinv(self.a @ cross)

        def newton(r, gap):
            part = inverse(r)
            dy = equal @ (self.a @ part - gap)
            return part - cross @ dy, dy

        return newton, lambda v: d * v + self._out(self._in(v))


class Account:
    """One account's trades: purchases b (only of names that may be bought) and sales s, with weights w = w0 + b - s.

    min (w - bench)'(X F X' + D)(w - bench) + cost sum(b + s) - gain's (tax coefficient less penalty) times s, with sum(w) = 1, w, b, s >= 0,
    sum(b + s) <= turnover, at most ``cap`` in each capped sector, and a risk of at most ``ball`` (a variance).

    The Hessian is two by two blocks of a name's purchase and sale plus as many rank-one terms as there are factors, capped
    sectors and two more: solving costs names x (factors + sectors)^2, and no covariance of names is ever formed.
    """

    def __init__(self, w0, bench, x, f, d, cost, worth, no_buy, turnover, sectors, caps, ball=None):
        root = np.linalg.cholesky(f + 1e-15 * max(np.trace(f), 1e-300) * np.eye(len(f))) if len(f) else np.zeros((0, 0))
        self.w0, self.bench, self.load = w0, bench, x @ root if len(f) else np.zeros((len(w0), 0))
        total = np.square(self.load).sum(1) + np.maximum(d, 0.0)
        self.d = np.maximum(d, LEAST_SPECIFIC * np.maximum(total, total.mean()))
        # Only what is held can be sold; a name that can be neither bought nor sold is no unknown at all.
        self.may, self.own = np.flatnonzero(~no_buy), np.flatnonzero(w0 > 0)
        self.can_buy, self.can_sell = ~no_buy, w0 > 0
        self.nb, self.ns, self.n = len(self.may), len(self.own), len(w0)
        risk = 2 * (np.square(self.load).sum(1) + self.d).max()
        self.unit = 1.0 / max(risk, cost, np.abs(worth).max(initial=0.0), 1e-300)
        self.c = self.unit * np.concatenate([np.full(self.nb, cost), cost - worth[self.own]])
        self.a, self.b = np.concatenate([np.ones(self.nb), -np.ones(self.ns)])[None, :], np.array([1.0 - w0.sum()])
        self.turnover, self.sectors, self.caps = turnover, sectors, caps  # sectors: names x capped sectors, of zeros and ones
        self.ball = ball

    def _net(self, v):
        out = np.zeros(self.n)
        out[self.may] = v[: self.nb]
        out[self.own] -= v[self.nb :]
        return out

    def _back(self, g):
        return np.concatenate([g[self.may], -g[self.own]])

    def _spread(self, place, r):
        out = np.zeros((self.n, *r.shape[1:]))
        out[place] = r
        return out

    def trades(self, v):
        """Purchases and sales of every name."""
        buy, sell = np.zeros(self.n), np.zeros(self.n)
        buy[self.may], sell[self.own] = v[: self.nb], v[self.nb :]
        return buy, sell

    def weights(self, v):
        return self.w0 + self._net(v)

    def _pull(self, active):
        """Covariance times active weights."""
        return self.load @ (self.load.T @ active) + self.d * active

    def variance(self, v) -> float:
        active = self.weights(v) - self.bench
        return float(active @ self._pull(active))

    def start(self):
        return np.full(self.nb + self.ns, 0.1 / self.n)

    def slope(self, v):
        return self.unit * 2 * self._back(self._pull(self.weights(v) - self.bench)) + self.c

    def _ball(self, v):
        """Value and slope of the risk limit, in units of the limit."""
        active = self.weights(v) - self.bench
        pull = self._pull(active)
        return active @ pull / self.ball - 1.0, 2 * self._back(pull) / self.ball

    def limits(self, v):
        w = self.weights(v)
        out = [-v, -w[self.own], [v.sum() - self.turnover], self.sectors.T @ w - self.caps]
        return np.concatenate(out + ([[self._ball(v)[0]]] if self.ball is not None else []))

    def limits_times(self, v, dv):
        net = self._net(dv)
        out = [-dv, -net[self.own], [dv.sum()], self.sectors.T @ net]
        return np.concatenate(out + ([[self._ball(v)[1] @ dv]] if self.ball is not None else []))

    def _parts(self, z):
        ends = np.cumsum([self.nb, self.ns, self.ns, 1, len(self.caps)])
        return np.split(z, ends)

    def limits_t(self, v, z):
        zb, zs, zw, turn, sector, ball = self._parts(z)
        out = self._back(self.sectors @ sector - self._spread(self.own, zw)) - np.concatenate([zb, zs]) + turn[0]
        return out + ball[0] * self._ball(v)[1] if self.ball is not None else out

    def newton(self, v, z, phi):
        pb, ps, pw, turn, sector, ball = self._parts(phi)
        more = 2 * self.unit + (2 * z[-1] / self.ball if self.ball is not None else 0.0)
        q = more * self.d + self._spread(self.own, pw)
        wb, ws = self._spread(self.may, pb), self._spread(self.own, ps)
        both, only_b, only_s = self.can_buy & self.can_sell, self.can_buy & ~self.can_sell, self.can_sell & ~self.can_buy
        det = np.where(both, wb * (ws + q) + ws * q, 1.0)
        bb = np.where(both, (ws + q) / det, np.where(only_b, 1 / (wb + q), 0.0))
        bs = np.where(both, q / det, 0.0)
        ss = np.where(both, (wb + q) / det, np.where(only_s, 1 / (ws + q), 0.0))
        net = np.column_stack([self.load, self.sectors])
        rank = np.concatenate([np.full(self.load.shape[1], more), sector, turn])
        low = np.hstack([np.vstack([net[self.may], -net[self.own]]), np.ones((self.nb + self.ns, 1))])
        if self.ball is not None:
            low, rank = np.column_stack([low, self._ball(v)[1]]), np.append(rank, ball)

        def blocks(r):
            buy, sell = self._spread(self.may, r[: self.nb]), self._spread(self.own, r[self.nb :])
            up = lambda k: k if r.ndim == 1 else k[:, None]
            return np.concatenate([(up(bb) * buy + up(bs) * sell)[self.may], (up(bs) * buy + up(ss) * sell)[self.own]])

        # The rank-one terms are unknowns beside the equation's multiplier, with the inverse of their weight on the diagonal.
        side = np.column_stack([self.a.T, low])
        solved = blocks(side)
        small = side.T @ solved + np.diag(np.append(0.0, 1 / rank))
        scale = 1 / np.sqrt(np.maximum(np.diag(small), 1e-300))
        small = np.linalg.inv(small * scale * scale[:, None]) * scale * scale[:, None]

        def newton(r, gap):
            part = blocks(r)
            found = small @ (side.T @ part - np.append(gap, np.zeros(len(rank))))
            return part - solved @ found, found[:1]

        def times(v):
            own = self._back(q * self._net(v)) + np.concatenate([pb * v[: self.nb], ps * v[self.nb :]])
            return own + low @ (rank * (low.T @ v))

        return newton, times


class Accounts:
    """Many of ``Account`` at once, as arrays with the accounts in front: names are padded to the longest account, and what is no
    unknown or no limit of an account (``real`` is False, a NaN cap or ball) is masked.  ``solve_accounts`` makes the same steps."""

    FIELDS = "w0 bench load d can_buy can_sell real worth sectors caps ball turnover c unit var lim b".split()

    def __init__(self, w0, bench, x, f, d, cost, worth, no_buy, turnover, sectors, caps, ball, real):
        m, n = w0.shape
        root = np.linalg.cholesky(f + 1e-15 * max(np.trace(f), 1e-300) * np.eye(len(f))) if len(f) else np.zeros((0, 0))
        self.w0, self.bench, self.real, self.load = w0, bench, real, x @ root if len(f) else np.zeros((m, n, 0))
        total = np.where(real, np.square(self.load).sum(2) + np.maximum(d, 0.0), 0.0)
        mean = total.sum(1) / np.maximum(real.sum(1), 1)
        self.d = np.where(real, np.maximum(d, LEAST_SPECIFIC * np.maximum(total, mean[:, None])), 1.0)
        self.can_buy, self.can_sell = real & ~no_buy, real & (w0 > 0)
        risk = 2 * np.where(real, np.square(self.load).sum(2) + self.d, 0.0).max(1)
        self.unit = 1.0 / np.maximum(np.maximum(risk, np.abs(worth).max(1, initial=0.0)), max(cost, 1e-300))
        self.worth, self.var = worth, np.concatenate([self.can_buy, self.can_sell], 1)
        self.c = self.unit[:, None] * np.where(self.var, np.concatenate([np.full((m, n), cost), cost - worth], 1), 0.0)
        self.b = 1.0 - w0.sum(1)
        self.turnover, self.ball = np.broadcast_to(np.asarray(turnover, float), m), ball
        capped = ~np.isnan(caps)
        self.sectors, self.caps = np.where(capped[:, None, :], sectors, 0.0), np.where(capped, caps, 1.0)
        self.lim = np.concatenate([self.var, self.can_sell, np.ones((m, 1), bool), capped, ~np.isnan(ball)[:, None]], 1)
        self.ball = np.where(np.isnan(ball), 1.0, ball)

    def take(self, at):
        out = object.__new__(Accounts)
        for name in self.FIELDS:
            setattr(out, name, getattr(self, name)[at])
        return out

    def trades(self, v):
        n = self.w0.shape[1]
        return v[:, :n], v[:, n:]

    def net(self, v):
        buy, sell = self.trades(v)
        return buy - sell

    def back(self, g):
        return np.where(self.var, np.concatenate([g, -g], 1), 0.0)

    def pull(self, active):
        return (self.load @ (self.load.transpose(0, 2, 1) @ active[:, :, None]))[:, :, 0] + self.d * active

    def active(self, v):
        return self.w0 + self.net(v) - self.bench

    def variance(self, v):
        active = self.active(v)
        return (active * self.pull(active)).sum(1)

    def start(self):
        return np.where(self.var, 0.1 / self.real.sum(1)[:, None], 0.0)

    def slope(self, v):
        return self.unit[:, None] * 2 * self.back(self.pull(self.active(v))) + self.c

    def ball_of(self, v):
        active = self.active(v)
        pull = self.pull(active)
        there = self.lim[:, -1]
        return (active * pull).sum(1) / self.ball - 1.0, np.where(there[:, None], 2 * self.back(pull) / self.ball[:, None], 0.0)

    def _limits(self, v, net, turn, sector, ball):
        out = np.concatenate([-v, -net, turn[:, None], sector, ball[:, None]], 1)
        return np.where(self.lim, out, 0.0)

    def limits(self, v):
        w = self.w0 + self.net(v)
        return self._limits(v, w, v.sum(1) - self.turnover, self._in_sectors(w) - self.caps, self.ball_of(v)[0])

    def _in_sectors(self, w):
        return (self.sectors.transpose(0, 2, 1) @ w[:, :, None])[:, :, 0]

    def parts(self, z):
        n, k = self.w0.shape[1], self.caps.shape[1]
        return np.split(z, [n, 2 * n, 3 * n, 3 * n + 1, 3 * n + 1 + k], axis=1)

    def prepared(self, v, z, phi):
        """Functions for one step from v: limits' slopes both ways, Newton's equations, and the Hessian times a vector."""
        m, n = self.w0.shape
        ball_slope = self.ball_of(v)[1]
        zb, zs, zw, turn, sector, ball = self.parts(phi)
        more = 2 * self.unit + 2 * z[:, -1] / self.ball
        q = more[:, None] * self.d + zw
        both, only_b, only_s = self.can_buy & self.can_sell, self.can_buy & ~self.can_sell, self.can_sell & ~self.can_buy
        det = np.where(both, zb * (zs + q) + zs * q, 1.0)
        bb = np.where(both, (zs + q) / det, np.where(only_b, 1 / (zb + q), 0.0))
        bs = np.where(both, q / det, 0.0)
        ss = np.where(both, (zb + q) / det, np.where(only_s, 1 / (zs + q), 0.0))
        net = np.concatenate([self.load, self.sectors], 2)
        low = np.concatenate([np.concatenate([net, -net], 1), np.ones((m, 2 * n, 1)), ball_slope[:, :, None]], 2) * self.var[:, :, None]
        rank = np.concatenate([np.repeat(more[:, None], self.load.shape[2], 1), sector, turn, ball], 1)
        diagonal = np.where(rank > 0, 1 / np.where(rank > 0, rank, 1.0), 1.0)
        low = low * (rank > 0)[:, None, :]
        a = np.concatenate([np.ones((m, n)), -np.ones((m, n))], 1) * self.var

        def blocks(r):
            buy, sell = r[:, :n], r[:, n:]
            up = (lambda k: k) if r.ndim == 2 else (lambda k: k[:, :, None])
            out = np.concatenate([up(bb) * buy + up(bs) * sell, up(bs) * buy + up(ss) * sell], 1)
            return out * up(self.var)

        side = np.concatenate([a[:, :, None], low], 2)
        turned = side.transpose(0, 2, 1)
        solved = blocks(side)
        small = turned @ solved
        at = np.arange(small.shape[1])
        small[:, at[1:], at[1:]] += diagonal
        scale = 1 / np.sqrt(np.maximum(small[:, at, at], 1e-300))
        both_scales = scale[:, :, None] * scale[:, None, :]
        small = np.linalg.inv(small * both_scales) * both_scales

        def newton(r, gap):
            part = blocks(r)
            right = (turned @ part[:, :, None])[:, :, 0]
            right[:, 0] -= gap
            found = small @ right[:, :, None]
            return part - (solved @ found)[:, :, 0], found[:, 0, 0]

        def times(u):
            moved = self.net(u)
            return self.back(q * moved) + np.concatenate([zb, zs], 1) * u + (low @ (rank[:, :, None] * (low.transpose(0, 2, 1) @ u[:, :, None])))[:, :, 0]

        def limits_times(u):
            moved = self.net(u)
            return self._limits(u, moved, u.sum(1), self._in_sectors(moved), (ball_slope * u).sum(1))

        return a, newton, times, limits_times

    def limits_t(self, v, z):
        zb, zs, zw, turn, sector, ball = self.parts(z)
        out = self.back((self.sectors @ sector[:, :, None])[:, :, 0] - zw) - np.concatenate([zb, zs], 1) + turn + ball * self.ball_of(v)[1]
        return np.where(self.var, out, 0.0)


def solve_accounts(p: Accounts, tolerance: float = TOLERANCE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Trades and residual of every account, as ``solve`` finds them; those that are done leave the arrays."""
    with np.errstate(all="ignore"):
        return _solve_accounts(p, tolerance, steps)


def _solve_accounts(p, tolerance, steps):
    total = len(p.w0)
    best, least = p.start(), np.full(total, np.inf)
    ids, x, y = np.arange(total), p.start(), np.zeros(total)
    s, z = np.where(p.lim, np.maximum(-p.limits(x), 0.1), 1.0), np.where(p.lim, 1.0, 0.0)
    room = lambda v, dv: np.minimum(1.0, np.where(p.lim & (dv < 0), v / -dv, 1.0).min(axis=1))
    for _ in range(steps):
        n_lim = p.lim.sum(1)
        a = np.concatenate([p.can_buy, -1.0 * p.can_sell], 1)
        slope = p.slope(x) + a * y[:, None] + p.limits_t(x, z)
        equal, limit = (a * x).sum(1) - p.b, p.limits(x)
        most = [np.abs(slope).max(1), np.abs(equal), np.maximum(limit.max(1), 0.0), np.abs(np.where(p.lim, np.minimum(z, 1.0) * np.minimum(-limit, 1.0), 0.0)).max(1), (s * z).max(1)]
        residual = np.max(most, axis=0)
        better = residual < least[ids]
        best[ids[better]], least[ids[better]] = x[better], residual[better]
        go = np.isfinite(residual) & ~(residual < tolerance)
        if not go.any():
            break
        if not go.all():
            p, ids, x, y, s, z, slope, equal, limit, n_lim = p.take(go), ids[go], x[go], y[go], s[go], z[go], slope[go], equal[go], limit[go], n_lim[go]
        slack, phi = np.where(p.lim, limit + s, 0.0), np.where(p.lim, z / s, 0.0)
        try:
            a, newton, times, limits_times = p.prepared(x, z, phi)
        except np.linalg.LinAlgError:
            if len(ids) == 1:
                break
            for half in np.array_split(np.arange(len(ids)), 2):  # only an account whose own equations are singular stops
                part, worth = _solve_accounts(p.take(half), tolerance, steps)
                good = worth < least[ids[half]]
                best[ids[half][good]], least[ids[half][good]] = part[good], worth[good]
            break

        def step(target):
            right = -slope - p.limits_t(x, phi * slack - target / s)
            dx, dy = np.zeros_like(x), np.zeros_like(y)
            for _ in range(3):
                more, change = newton(right - times(dx) - a * dy[:, None], -equal - (a * dx).sum(1))
                dx, dy = dx + more, dy + change
            moved = limits_times(dx)
            return dx, dy, np.where(p.lim, -slack - moved, 0.0), np.where(p.lim, phi * (slack + moved) - target / s, 0.0)

        gap = (s * z).sum(1) / n_lim
        dx, dy, ds, dz = step(s * z)
        ahead = ((s + room(s, ds)[:, None] * ds) * (z + room(z, dz)[:, None] * dz) * p.lim).sum(1) / n_lim
        centre = (ahead / gap) ** 3 * gap
        dx, dy, ds, dz = step(np.where(p.lim, s * z + ds * dz - centre[:, None], 0.0))
        along = (0.995 * np.minimum(room(s, ds), room(z, dz)))[:, None]
        x, y = x + along * dx, y + along[:, 0] * dy
        s, z = np.where(p.lim, np.maximum(s + along * ds, 1e-30), 1.0), np.where(p.lim, np.maximum(z + along * dz, 1e-30), 0.0)
    return best, least
