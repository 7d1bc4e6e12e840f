"""Best columns and exp-sums of a block of test rows against a strip of train rows (numpy, inside one task).

The score is ``<x_test, x_train> * scale``.  With few dimensions neither needs every pair: boxes around
near train rows bound their scores, so only boxes that can hold one of the best rows are scored; and the
sum of exponentials over a box is a power series in the distance from its centre, taken to double
precision.  Both are exact whatever the rows are; where a bound does not help, all pairs are scored.
"""

from __future__ import annotations

import math

import numpy as np

from ctxtab.functions.spool import Spool

TILE, LEAF = 256, 256  # test rows scored at once, train rows of the smallest box
CELLS = 1 << 21  # scores held at once
WHOLE_CELLS = 1 << 19  # of them where all pairs are scored: a tile is held several times over while its best are sought
FEW = 512  # longest candidate lists for which boxes are sought; longer ones are handed on tile by tile
SERIES_DIMS, REACH = 4, 2.0  # widest vectors and largest exponent (from a box's centre) for the series
NOTHING = 80.0  # a score this far below the best one adds less than double precision holds, even 10^15 times
SAVING = 50  # multiply-adds that cost as much as one exponential and its sums
BOX_DIMS, PART = 8, 1 << 18  # widest vectors for which boxes of long contexts are made; train rows that are put into boxes together


def scores(Xt: np.ndarray, Xr: np.ndarray, scale: float) -> np.ndarray:
    """Few dimensions are summed one by one, so equal rows have equal scores wherever they stand."""
    if Xt.shape[1] > 8:
        return (Xt @ Xr.T) * scale
    S = np.zeros((len(Xt), len(Xr)))
    for a in range(Xt.shape[1]):
        S += np.multiply.outer(Xt[:, a], np.ascontiguousarray(Xr[:, a]))
    S *= scale
    return S


def best_columns(S: np.ndarray, K: int) -> np.ndarray:
    """Per row of the finite ``S``: its K highest columns, lower columns first among equals, in column order."""
    m, n = S.shape
    if K >= n:
        return np.broadcast_to(np.arange(n), (m, n))
    if K <= 0:
        return np.zeros((m, 0), dtype=np.int64)
    kth = np.partition(S, n - K, axis=1)[:, n - K, None].copy()  # not a view, which would hold all of the partition
    take = S >= kth
    many = take.sum(axis=1) > K
    if many.any():
        T, level = S[many], kth[many]
        above, equal = T > level, T == level
        take[many] = above | (equal & (np.cumsum(equal, axis=1) <= K - above.sum(axis=1, keepdims=True)))
    return np.nonzero(take)[1].reshape(m, K)


def boxes(X: np.ndarray, weight: np.ndarray, done) -> list[np.ndarray]:
    """Row numbers of boxes of near rows: halved along the widest (weighted) axis until ``done(n, half widths)``."""
    out, stack = [], [np.arange(len(X))]
    while stack:
        rows = stack.pop()
        P = X[rows]
        width = np.ptp(P, axis=0) / 2
        if len(rows) <= 1 or done(len(rows), width):
            out.append(rows)
            continue
        axis = int(np.argmax(width * weight))
        halves = np.argpartition(P[:, axis], len(rows) // 2)
        stack += [rows[halves[len(rows) // 2:]], rows[halves[:len(rows) // 2]]]
    return out


def _order(b: float) -> int:
    """Highest power of the series of exp(x), |x| <= b, for double precision."""
    p, term = 0, b
    while term > 1e-17:
        p += 1
        term *= b / (p + 1)
    return p


def _powers(x: np.ndarray, p: int) -> np.ndarray:
    return np.vander(x, p + 1, increasing=True)


def _moments(D: np.ndarray, orders: list[int]) -> np.ndarray:
    """Sums over the rows of ``D`` of all products of powers up to ``orders``, the last axis apart."""
    total = 0.0
    step = max(64, CELLS // math.prod(p + 1 for p in orders[:-1]))
    for a in range(0, len(D), step):
        part = D[a:a + step]
        W = np.ones((len(part), 1))
        for x, p in zip(part.T[:-1], orders[:-1]):
            W = (W[:, :, None] * _powers(x, p)[:, None, :]).reshape(len(part), -1)
        total = total + W.T @ _powers(part[:, -1], orders[-1])
    return total


def _series(U: np.ndarray, M: np.ndarray, orders: list[int]) -> np.ndarray:
    """Per row u of ``U``: the sum over a box's rows d of exp(<u, d>), from the box's moments."""
    E = [_powers(u, p) / np.array([math.factorial(k) for k in range(p + 1)], dtype=float) for u, p in zip(U.T, orders)]
    V = E[0] @ M.reshape(orders[0] + 1, -1)
    for e in E[1:]:
        V = np.einsum("ijk,ij->ik", V.reshape(len(U), e.shape[1], -1), e)
    return V[:, 0]


def exp_sums(Xt: np.ndarray, Xr: np.ndarray, scale: float, top: np.ndarray) -> np.ndarray:
    """Per test row: the sum over all train rows of exp(score - ``top``)."""
    U = Xt * scale
    reach = np.abs(U).max(axis=0)
    z = np.zeros(len(Xt))
    for rows in boxes(Xr, reach, lambda n, half: n <= LEAF or half @ reach <= REACH):
        P = Xr[rows]
        low, high = P.min(axis=0), P.max(axis=0)
        mid, half = (low + high) / 2, (high - low) / 2
        b = half * reach
        near = np.nonzero(U @ mid + np.abs(U) @ half >= top - NOTHING)[0]
        if not len(near):
            continue
        if len(near) < len(Xt):
            z[near] += _box_sums(Xt[near], U[near], P, mid, b, scale, top[near])
        else:
            z += _box_sums(Xt, U, P, mid, b, scale, top)
    return z


def _box_sums(Xt, U, P, mid, b, scale, top):
    """``exp_sums`` over the train rows ``P`` of one box with centre ``mid`` and largest exponents ``b`` by axis."""
    z = np.zeros(len(U))
    orders = [_order(x) for x in b] if b.sum() <= REACH else []
    terms = math.prod(p + 1 for p in orders)
    if orders and terms * (len(P) + len(U)) <= SAVING * len(P) * len(U):
        M = _moments(P - mid, orders)
        step = max(16, CELLS // terms)
        for a in range(0, len(U), step):
            u = U[a:a + step]
            z[a:a + step] += np.exp(u @ mid - top[a:a + step]) * _series(u, M, orders)
    else:
        step = max(1, CELLS // len(P))
        for a in range(0, len(U), step):
            z[a:a + step] += np.exp(scores(Xt[a:a + step], P, scale) - top[a:a + step, None]).sum(axis=1)
    return z


def _unordered(S: np.ndarray, K: int) -> np.ndarray:
    """As ``best_columns`` where scores may be no numbers: those come last."""
    return np.argsort(-S, axis=1, kind="stable")[:, :K]


def strip_scores(Xt: np.ndarray, Xr: np.ndarray, K: int, scale: float):
    """(test rows, best score, exp-sum, best columns, their scores) of all test rows, tile by tile.

    The train rows stand in the order in which ties are broken.
    """
    K = min(max(K, 0), len(Xr))
    finite = bool(np.isfinite(Xt).all() and np.isfinite(Xr).all())
    d = Xt.shape[1]
    if not finite or not 0 < d <= SERIES_DIMS or len(Xr) <= 4 * LEAF or K > FEW:
        step = max(1, min(TILE, WHOLE_CELLS // len(Xr)))
        for a in range(0, len(Xt), step):
            S = scores(Xt[a:a + step], Xr, scale)
            top = S.max(axis=1)
            cols = best_columns(S, K) if finite else _unordered(S, K)
            best = np.take_along_axis(S, cols, axis=1)
            S -= top[:, None]
            z = np.exp(S, out=S).sum(axis=1)
            yield np.arange(a, a + len(S)), top, z, cols, best
        return
    reach = np.abs(Xt).max(axis=0)
    wanted = max(K, 1)
    # of rows that are all the same, the first ones are enough
    cells = [np.sort(c)[:wanted] if (Xr[c] == Xr[c[0]]).all() else c
             for c in boxes(Xr, reach, lambda n, half: n <= LEAF or not half.any())]
    low, high = (np.array([f(Xr[c], axis=0) for c in cells]) for f in (np.min, np.max))
    mid, half = (low + high) / 2, (high - low) / 2
    sizes = np.array([len(c) for c in cells])
    slack = 1e-12 * (1 + abs(scale) * float(reach @ np.abs(Xr).max(axis=0)))
    # test rows that are the same have the same results
    Xt, back = np.unique(Xt, axis=0, return_inverse=True)
    back = back.ravel()
    asked = np.split(np.argsort(back, kind="stable"), np.cumsum(np.bincount(back))[:-1])
    top = np.empty(len(Xt))
    found = []
    for rows in boxes(Xt, np.ones(d), lambda n, half: n <= TILE):
        T = Xt[rows]
        bound = (T @ mid.T) * scale + (np.abs(T) @ half.T) * abs(scale) + slack
        first = np.argsort(-bound.max(axis=0), kind="stable")
        first = np.union1d(first[:int(np.searchsorted(np.cumsum(sizes[first]), min(wanted, len(Xr)))) + 1], bound.argmax(axis=1))
        S = scores(T, Xr[np.concatenate([cells[c] for c in first])], scale)
        kth = np.partition(S, S.shape[1] - wanted, axis=1)[:, S.shape[1] - wanted, None]
        near = np.sort(np.concatenate([cells[c] for c in np.nonzero((bound >= kth).any(axis=0))[0]]))
        step = max(1, CELLS // len(near))
        for a in range(0, len(T), step):
            S = scores(T[a:a + step], Xr[near], scale)
            top[rows[a:a + step]] = S.max(axis=1)
            cols = best_columns(S, K)
            found.append((rows[a:a + step], near[cols], np.take_along_axis(S, cols, axis=1)))
    z = exp_sums(Xt, Xr, scale, top)
    for rows, cols, best in found:
        at = np.repeat(np.arange(len(rows)), [len(asked[r]) for r in rows])
        yield np.concatenate([asked[r] for r in rows]), top[rows][at], z[rows][at], cols[at], best[at]


def ranking(s: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order of falling scores, lower ids first among equals, scores that are no numbers last."""
    down = np.where(np.isnan(s), np.inf, -s)
    order = np.argsort(down)
    level = down[order]
    same = level[1:] == level[:-1]
    if same.any():  # only what is tied is sorted by id
        tied = np.nonzero(np.append(same, False) | np.append(False, same))[0]
        part = order[tied]
        order[tied] = part[np.lexsort((ids[part], level[tied]))]
    return order


class BestOfStrips:
    """The ``K`` best train rows of each row of ``Xt`` and the log-sum-exp over all, strip after strip.

    Ties go to the lower train id, whatever the order of the strips; scores that are no numbers come last.
    """

    def __init__(self, Xt: np.ndarray, K: int, scale: float):
        self.Xt, self.K, self.scale, self.n = Xt, K, scale, 0
        m = len(Xt)
        self.top, self.z = np.full(m, -np.inf), np.zeros(m)
        self.best, self.ids, self.kept = np.empty((m, K)), np.empty((m, K), dtype=np.int64), 0

    def add(self, ids: np.ndarray, Xr: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        ids, Xr = ids[by_id], Xr[by_id]
        self.n += len(ids)
        kept = min(self.K, self.kept + len(ids))
        step = max(1, CELLS // max(1, len(ids)))
        with np.errstate(invalid="ignore"):
            for a in range(0, len(self.Xt), step):
                part = slice(a, min(a + step, len(self.Xt)))
                S = scores(self.Xt[part], Xr, self.scale)
                top = np.maximum(self.top[part], S.max(axis=1))
                old = np.where(self.z[part] > 0, self.z[part] * np.exp(self.top[part] - top), self.z[part])
                self.z[part] = old + np.exp(S - top[:, None]).sum(axis=1)
                self.top[part] = top
                if self.kept + len(ids) <= self.K:
                    self.best[part, self.kept:kept], self.ids[part, self.kept:kept] = S, ids
                else:
                    for i, s in zip(range(part.start, part.stop), S):
                        self._keep(i, s, ids, kept)
        self.kept = kept

    def _keep(self, i: int, s: np.ndarray, ids: np.ndarray, kept: int) -> None:
        if self.kept == self.K and self.K:
            low = self.best[i].min()
            if low == low:  # only what is no worse than the worst one held can enter
                near = np.nonzero(s >= low)[0]
                s, ids = s[near], ids[near]
        s = np.concatenate([self.best[i, :self.kept], s])
        ids = np.concatenate([self.ids[i, :self.kept], ids])
        down = np.where(np.isnan(s), np.inf, -s)
        if kept < len(s):
            level = np.partition(down, kept - 1)[kept - 1] if kept else -np.inf
            above, equal = np.nonzero(down < level)[0], np.nonzero(down == level)[0]
            more = kept - len(above)
            if len(equal) > more:
                equal = equal[np.argsort(ids[equal], kind="stable")[:more]]
            take = np.concatenate([above, equal])
            s, ids = s[take], ids[take]
        self.best[i, :kept], self.ids[i, :kept] = s, ids

    def ranked(self, t_ids: np.ndarray, k: int | None):
        """Per test id: (test id, train ids, scores, log-sum-exp, number of train rows), best first; rows that share an id count together."""
        at, rows = np.unique(t_ids, return_inverse=True)
        rows = np.split(np.argsort(rows, kind="stable"), np.cumsum(np.bincount(rows, minlength=len(at)))[:-1])
        for test_id, mine in zip(at, rows):
            if not self.n:
                continue
            s, ids = self.best[mine, :self.kept].ravel(), self.ids[mine, :self.kept].ravel()
            order = ranking(s, ids)[:k]
            with np.errstate(invalid="ignore", divide="ignore"):
                top = self.top[mine].max()
                lse = top + np.log((self.z[mine] * np.exp(self.top[mine] - top)).sum())
            yield int(test_id), ids[order], s[order], float(lse), self.n * len(mine)


class Voters:
    """Train rows of a task and what their ids vote for, in boxes of near rows; however many, they wait in spools.

    ``logits`` needs no normaliser over all train rows: it is the same for every class of a test row.
    """

    def __init__(self, Xt: np.ndarray, K: int, scale: float, classes: int):
        self.Xt, self.K, self.scale, self.classes = Xt, K, scale, classes
        self.X, self.ids, self.first, self.count, self.codes = (Spool() for _ in range(5))
        self.low, self.high, self.sizes = [], [], []
        self.waiting, self.held = [], 0
        self.finite, self.single = bool(np.isfinite(Xt).all()), True
        self.reach = np.abs(Xt).max(axis=0, initial=0)

    def add(self, ids: np.ndarray, valid: np.ndarray, X: np.ndarray, codes: np.ndarray) -> None:
        """All train rows of some ids: ``X`` has the vectors of the ``valid`` ones; rows that share an id vote together."""
        by_id = np.argsort(ids, kind="stable")
        known, mine = ids[by_id], ids[valid]
        first = np.searchsorted(known, mine, "left")
        count = np.searchsorted(known, mine, "right") - first
        self.single &= bool((count == 1).all())
        self.finite &= bool(np.isfinite(X).all())
        self.waiting.append((X, mine, first + self.codes.n, count))
        self.codes.add(codes[by_id].astype(np.int32))
        self.held += len(mine)
        if self.held >= PART:
            self._box()

    def _box(self) -> None:
        X, ids, first, count = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.held = [], 0
        if self.finite and 0 < X.shape[1] <= BOX_DIMS:
            # of rows that are all the same, the first ones are enough
            cells = [c[np.argsort(ids[c], kind="stable")[:self.K]] if len(c) > LEAF else c
                     for c in boxes(X, self.reach, lambda n, half: n <= max(LEAF, self.K // 16) or not half.any())]
        else:
            cells = [np.arange(len(X))] if len(X) else []
        for rows in cells:
            self.low.append(X[rows].min(axis=0))
            self.high.append(X[rows].max(axis=0))
            self.sizes.append(len(rows))
        order = np.concatenate(cells) if cells else np.zeros(0, np.int64)
        for spool, x in ((self.X, X), (self.ids, ids), (self.first, first), (self.count, count.astype(np.int32))):
            spool.add(x[order])

    def logits(self, t_ids: np.ndarray):
        """(test ids, test ids x classes: log of the summed weights, up to a number of each row's own; which classes voted)."""
        if self.waiting:
            self._box()
        if not self.X.n:
            return
        self.rows = [x.rows() for x in (self.X, self.ids, self.first, self.count, self.codes)]
        low, high, self.sizes = np.array(self.low), np.array(self.high), np.array(self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.mid, self.half = (low + high) / 2, (high - low) / 2
        most = abs(self.scale) * float(self.reach @ np.maximum(np.abs(low), np.abs(high)).max(axis=0))
        boxed = self.finite and 0 < self.Xt.shape[1] <= BOX_DIMS and math.isfinite(most)
        self.slack = 1e-12 * (1 + most)
        at, back, times = np.unique(t_ids, return_inverse=True, return_counts=True)
        alone = np.nonzero(times[back] == 1)[0]
        if len(alone):  # test rows that are the same have the same results
            U, place = np.unique(self.Xt[alone], axis=0, return_inverse=True)
            step = 1 if boxed else max(1, CELLS // self.X.n)
            found = [x for a in range(0, len(U), step) for x in ([self._near(U[a:a + 1])] if boxed else self._all(U[a:a + step]))]
            logit, voted = (np.array(x)[place.ravel()] for x in zip(*found))
            yield t_ids[alone], logit, voted
        for i in np.nonzero(times > 1)[0]:  # rows that share an id count together
            T = self.Xt[back == i]
            logit, voted = self._near(T) if boxed else self._votes(np.concatenate([self._scored(T[j:j + 1]) for j in range(len(T))]), slice(None))
            yield at[i:i + 1], logit[None], voted[None]

    def _near(self, T: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the boxes that can hold one of the best rows: scored by falling bounds until no other box reaches the worst row kept."""
        bound = ((T @ self.mid.T) * self.scale + (np.abs(T) @ self.half.T) * abs(self.scale)).max(axis=0) + self.slack
        order = np.argsort(-bound)
        ends, wanted = np.cumsum(self.sizes[order]), min(self.K, self.X.n)
        S, done, until, rows = np.empty((len(T), 0)), 0, len(order), wanted + wanted // 4
        while done < until:
            more = min(until, max(done, int(np.searchsorted(ends, rows))) + 1)
            S = np.concatenate([S, scores(T, self._taken(order[done:more], 0), self.scale)], axis=1)
            kth = np.partition(S.ravel(), S.size - wanted)[S.size - wanted]
            done, until, rows = more, max(more, int(np.searchsorted(-bound[order], -kth, "right"))), rows + rows // 2
        first = order[:done]
        return self._votes(S, np.arange(ends[done - 1]) + np.repeat(self.starts[first] - ends[:done] + self.sizes[first], self.sizes[first]))

    def _taken(self, cells: np.ndarray, what: int) -> np.ndarray:
        return np.concatenate([self.rows[what][a:a + n] for a, n in zip(self.starts[cells].tolist(), self.sizes[cells].tolist())])

    def _scored(self, T: np.ndarray) -> np.ndarray:
        S = np.empty((len(T), self.X.n))
        with np.errstate(invalid="ignore", over="ignore"):
            for b in range(0, self.X.n, LEAF * TILE):
                S[:, b:b + LEAF * TILE] = scores(T, np.asarray(self.rows[0][b:b + LEAF * TILE]), self.scale)
        return S

    def _all(self, T: np.ndarray):
        for s in self._scored(T):
            yield self._votes(s[None], slice(None))

    def _votes(self, S: np.ndarray, place) -> tuple[np.ndarray, np.ndarray]:
        """Logits from the best of ``S`` (test rows x train rows at ``place``), lower ids first among equals."""
        width, n = S.shape[1], self.classes
        S = S.ravel()
        K, ids = min(self.K, len(S)), self.rows[1][place]
        if np.isfinite(S).all():
            kth = np.partition(S, len(S) - K)[len(S) - K]
            best, equal = np.nonzero(S > kth)[0], np.nonzero(S == kth)[0]
            if len(best) + len(equal) > K:
                equal = equal[np.argsort(ids[equal % width], kind="stable")[:K - len(best)]]
            best = np.concatenate([best, equal])
        else:
            best = ranking(S, np.tile(ids, len(S) // width))[:K]
        s, best = S[best], best % width
        f = self.rows[2][place][best]
        if not self.single:
            times = self.rows[3][place][best]
            f = np.repeat(f - np.cumsum(times) + times, times) + np.arange(times.sum())
            s = np.repeat(s, times)
        code = self.rows[4][f]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            top = s.max()
            total, voted = np.bincount(code, np.exp(s - top), n), np.bincount(code, minlength=n) > 0
            logit = np.log(total)
            if not (total[voted] > 1e-280).all():  # classes far below the best row: relative to their own best row, so none underflows
                for c in np.nonzero(voted)[0]:
                    mine = s[code == c]
                    logit[c] = mine.max() - top + np.log(np.exp(mine - mine.max()).sum())
            if not S.max() < np.inf:  # a score that is no number leaves no normaliser
                logit[:] = np.nan
        return logit, voted
