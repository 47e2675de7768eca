"""Optimisers as coroutines: each yields a request for a pass over the data and gets its answer.

The driver loop gathers the requests of all running optimisers (folds, mixing parameters) and
answers them in one Spark job. A step asks for the deviance at several step lengths and for the
slope at the full one, so an accepted full step needs no job of its own.
"""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass, field

import numpy as np

from .moments import Answer, Coded, Request, evaluate

STEPS = (1.0, 0.5, 0.25, 0.125)
EPS = np.finfo(np.float64).eps


class ConvergenceWarning(UserWarning):
    """An optimiser stopped before its tolerances were met."""


@dataclass
class Space:
    """Standardised coordinates of the design: columns centred (with an intercept) and scaled."""

    mean: np.ndarray
    std: np.ndarray
    dense: list[int]
    intercept: bool

    def __post_init__(self):
        self.scale = 1.0 / np.where(self.std < 10 * np.sqrt(EPS), 1.0, self.std)
        self.mean = self.mean if self.intercept else np.zeros_like(self.mean)
        self.shift = self.mean.copy()
        self.shift[self.dense] = 0.0  # these are centred in the rows already

    def inward(self, beta: np.ndarray) -> np.ndarray:
        """Coefficients for the rows of the primitive."""
        slope = beta[1:] * self.scale
        return np.concatenate([[beta[0] - self.shift @ slope], slope])

    def gradient(self, g: np.ndarray) -> np.ndarray:
        out = np.concatenate([[g[0]], self.scale * (g[1:] - self.shift * g[0])])
        if not self.intercept:
            out[0] = 0.0
        return out

    def hessian(self, h: np.ndarray) -> np.ndarray:
        first = self.scale * (h[0, 1:] - self.shift * h[0, 0])
        inner = h[1:, 1:] - np.outer(self.shift, h[0, 1:]) - np.outer(h[0, 1:], self.shift) + h[0, 0] * np.outer(self.shift, self.shift)
        out = np.empty_like(h)
        out[0, 0], out[0, 1:], out[1:, 0], out[1:, 1:] = h[0, 0], first, first, inner * np.outer(self.scale, self.scale)
        if not self.intercept:
            out[0], out[:, 0], out[0, 0] = 0.0, 0.0, 1.0
        return out

    def outward(self, beta: np.ndarray) -> tuple[float, np.ndarray]:
        """Intercept and coefficients on the scale of the data."""
        slope = beta[1:] * self.scale
        return float(beta[0] - self.mean @ slope), slope

    def from_outward(self, intercept: float, coef: np.ndarray) -> np.ndarray:
        return np.concatenate([[intercept + self.mean @ coef if self.intercept else 0.0], coef / self.scale])


@dataclass
class Problem:
    space: Space
    weight: float
    p1: np.ndarray
    p2: np.ndarray
    lower: np.ndarray | None = None
    upper: np.ndarray | None = None
    a: np.ndarray | None = None
    b: np.ndarray | None = None
    fold: int | None = None
    gradient_tol: float = 1e-4
    step_size_tol: float | None = None
    max_iter: int = 100
    max_inner_iter: int = 100_000
    selection: str = "cyclic"
    seed: int | None = None
    quadratic: bool = False
    rows: int = 0
    diagnostics: list[dict] = field(default_factory=list)
    clock: float = field(default_factory=time.perf_counter)

    def penalty(self, beta):
        return float(self.p1 @ np.abs(beta[1:]) + 0.5 * beta[1:] @ self.p2 @ beta[1:])

    def ask(self, betas, slope="hessian"):
        return Request([self.space.inward(b) for b in betas], slope, self.fold)

    def objective(self, deviance, beta):
        return 0.5 * deviance / self.weight + self.penalty(beta)

    def score(self, answer: Answer, beta):
        """Gradient of minus the smooth part of the objective."""
        out = self.space.gradient(answer.gradient) / self.weight
        out[1:] -= self.p2 @ beta[1:]
        return out

    def curvature(self, answer: Answer):
        out = self.space.hessian(answer.hessian) / self.weight
        if not self.space.intercept:
            out[0, 0] = 1.0
        out[1:, 1:] += self.p2
        return out

    def subgradient(self, score, beta):
        """The minimum-norm subgradient, 0 where a bound holds the coefficient."""
        w, s = beta[1:], score[1:]
        out = np.where(w == 0, np.sign(s) * np.maximum(np.abs(s) - self.p1, 0.0), s - self.p1 * np.sign(w))
        if self.lower is not None:
            out = np.where((w <= self.lower) & (out < 0) | (w >= self.upper) & (out > 0), 0.0, out)
        return np.concatenate([[score[0]], out])


def _solve(h, g):
    try:
        np.linalg.cholesky(h)
        return np.linalg.solve(h, g)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(h, g, rcond=None)[0]


def _descent(problem: Problem, beta, score, h, tol):
    """Coordinate descent on the quadratic model with soft thresholds and bounds: the step."""
    w, q = beta.copy(), -score
    active = [0] * problem.space.intercept + [1 + int(j) for j in np.flatnonzero((beta[1:] != 0) | (np.abs(score[1:]) >= problem.p1 - np.abs(problem.subgradient(score, beta)).max()))]
    rng = np.random.default_rng(problem.seed)
    cycles = 0
    for cycles in range(1, problem.max_inner_iter + 1):
        biggest = 0.0
        for j in rng.choice(active, len(active)) if problem.selection == "random" else active:
            curve = h[j, j]
            if curve <= 16 * EPS:
                continue
            t = q[j] - w[j] * curve
            new = -t / curve if j == 0 else -np.sign(t) * max(abs(t) - problem.p1[j - 1], 0.0) / curve
            if j and problem.lower is not None:
                new = min(max(new, problem.lower[j - 1]), problem.upper[j - 1])
            if new != w[j]:
                q += (new - w[j]) * h[j]
                biggest = max(biggest, abs(new - w[j]))
                w[j] = new
        if biggest <= tol * max(np.abs(w).max(), 1e-300) or biggest == 0:
            inner = problem.subgradient(-q, w)
            if np.abs(inner[active]).sum() <= tol or biggest == 0:
                break
    return w - beta, cycles, len(active)


def _constrained(problem: Problem, beta, score, h):
    """The step of the quadratic model under ``A beta <= b``: dual ascent with an active set."""
    a = np.column_stack([np.zeros(len(problem.a)), problem.a])
    inverse = np.linalg.pinv(h, hermitian=True)
    free, room = inverse @ score, problem.b - a @ beta
    m, c = a @ inverse @ a.T, a @ free - room
    dual = np.zeros(len(a))
    for _ in range(20_000):
        before = dual.copy()
        for i in range(len(a)):
            if m[i, i] > 1e-14:
                dual[i] = max(0.0, dual[i] + (c[i] - m[i] @ dual) / m[i, i])
        if np.abs(dual - before).max() <= 1e-14 * max(1.0, np.abs(dual).max()):
            break
    held = np.flatnonzero(dual > 0)
    step = free - inverse @ a.T @ dual
    if len(held):  # polish: the held constraints exactly
        exact = np.linalg.lstsq(m[np.ix_(held, held)], c[held], rcond=None)[0]
        polished = free - inverse @ a[held].T @ exact
        if (exact >= -1e-10).all() and (a @ polished - room <= 1e-12).all():
            return polished, dual
    return step, dual


def irls(problem: Problem, start: np.ndarray, inner: str):
    """Iteratively reweighted least squares; ``inner`` is ``ls``, ``cd`` or ``qp``."""
    p, beta = problem, start
    answer = yield [p.ask([beta])]
    answer = answer[0]
    objective = p.objective(answer.deviances[0], beta)
    score = p.score(answer, beta)
    tol = p.gradient_tol
    inner_tol = tol if p.quadratic else max(1e-3 * np.abs(p.subgradient(score, beta)).sum(), tol)
    limit = 1 if p.quadratic else p.max_iter
    converged, n = False, 0
    norm = np.abs(p.subgradient(score, beta)).sum()
    p.diagnostics.append(_row(p, 0, norm, objective, beta, None, 0, 0, 0))
    if inner != "qp" and not p.quadratic and norm < tol:
        return beta, 0, True
    while n < limit and not converged:
        n += 1
        h = p.curvature(answer)
        cycles, active, dual = 0, len(beta), None
        if inner == "cd":
            step, cycles, active = _descent(p, beta, score, h, inner_tol)
        elif inner == "qp":
            step, dual = _constrained(p, beta, score, h)
        else:
            step = _solve(h, score) if p.space.intercept else np.concatenate([[0.0], _solve(h[1:, 1:], score[1:])])
        gain = -score @ step + p.p1 @ (np.abs((beta + step)[1:]) - np.abs(beta[1:]))
        factor, tries, scale = None, 0, 1.0
        # From a point that breaks a constraint the way back may raise the objective.
        restoring = inner == "qp" and bool((p.a @ beta[1:] > p.b + 1e-12).any())
        while factor is None and tries < 20:
            factors = [scale * f for f in STEPS]
            tried = (yield [p.ask([beta + f * step for f in factors])])[0]
            for k, f in enumerate(factors):
                tries += 1
                change = p.objective(tried.deviances[k], beta + f * step) - objective
                if tried.largest[k] == 0 and (restoring or change <= f * 1e-4 * gain or abs(change) <= 16 * EPS * max(abs(objective), 1.0)):
                    factor = f
                    break
            scale *= 1 / 16
        if factor is None:
            warnings.warn("Line search failed. Next iteration will be very close to current iteration.", ConvergenceWarning, stacklevel=2)
            factor = factors[-1]
        beta = beta + factor * step
        answer = tried if factor == factors[0] else (yield [p.ask([beta])])[0]
        objective = p.objective(answer.deviances[0], beta)
        score = p.score(answer, beta)
        if inner == "qp":
            free = score - np.concatenate([[0.0], p.a.T @ dual]) if dual is not None else score
            norm = np.abs(free).sum()
        else:
            norm = np.abs(p.subgradient(score, beta)).sum()
        converged = norm < tol or (p.step_size_tol is not None and np.linalg.norm(factor * step) < p.step_size_tol) or (inner == "qp" and np.abs(factor * step).max() < 1e-10)
        if not p.quadratic:
            inner_tol = max(1e-3 * norm, tol)
        p.diagnostics.append(_row(p, n, norm, objective, beta, factor * step, active, cycles, tries))
    if not converged and not p.quadratic:
        warnings.warn(f"IRLS failed to converge. Increase the maximum number of iterations max_iter (currently {p.max_iter})", ConvergenceWarning, stacklevel=2)
    return beta, n, converged


def _row(p, n, norm, objective, beta, step, active, cycles, tries):
    """What is recorded of an iteration; its seconds are those since the one before, with the passes it waited for."""
    before, p.clock = p.clock, time.perf_counter()
    return {
        "n_iter": n, "convergence": float(norm), "objective_fct": float(objective), "coef_l1": float(np.abs(beta).sum()), "coef_l2": float(np.linalg.norm(beta)),
        "step_l2": 0.0 if step is None else float(np.linalg.norm(step)), "first_coef": float(beta[0]), "n_coef_updated": 0 if step is None else int((step != 0).sum()),
        "n_active_cols": int(active), "n_active_rows": int(p.rows), "iteration_runtime": p.clock - before, "n_cycles": int(cycles), "n_line_search": int(tries),
    }


def closed_form(problem: Problem, start: np.ndarray):
    """Least squares with a quadratic penalty: one pass."""
    beta = np.zeros_like(start)
    answer = (yield [problem.ask([beta])])[0]
    score, h = problem.score(answer, beta), problem.curvature(answer)
    beta = _solve(h, score) if problem.space.intercept else np.concatenate([[0.0], _solve(h[1:, 1:], score[1:])])
    return beta, 1, True


def lbfgs(problem: Problem, start: np.ndarray, memory: int = 10):
    """Limited-memory BFGS with Armijo steps: passes return gradients of the design's width only."""
    p, beta = problem, start
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    answer = (yield [p.ask([beta], "gradient")])[0]
    objective, g = p.objective(answer.deviances[0], beta), -p.score(answer, beta)
    n, converged = 0, np.abs(g).max() < p.gradient_tol
    while n < p.max_iter and not converged:
        n += 1
        d, used = g.copy(), []
        for s, y in reversed(pairs):
            c = s @ d / (s @ y)
            used.append(c)
            d -= c * y
        if pairs:
            d *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1])
        else:
            d /= max(1.0, np.linalg.norm(g))
        for (s, y), c in zip(pairs, reversed(used)):
            d += s * (c - y @ d / (s @ y))
        factor, scale = None, 1.0
        while factor is None and scale > 1e-12:
            factors = [scale * f for f in STEPS]
            tried = (yield [p.ask([beta - f * d for f in factors], "gradient")])[0]
            for k, f in enumerate(factors):
                change = p.objective(tried.deviances[k], beta - f * d) - objective
                if tried.largest[k] == 0 and change <= -1e-4 * f * (g @ d) + 16 * EPS * abs(objective):
                    factor = f
                    break
            scale /= 16
        if factor is None:
            break
        new = beta - factor * d
        answer = tried if factor == factors[0] else (yield [p.ask([new], "gradient")])[0]
        fresh = -p.score(answer, new)
        if (new - beta) @ (fresh - g) > 1e-14:
            pairs = [*pairs[1 - memory :], (new - beta, fresh - g)]
        beta, g, objective = new, fresh, p.objective(answer.deviances[0], new)
        converged = np.abs(g).max() < p.gradient_tol
        p.diagnostics.append(_row(p, n, np.abs(g).max(), objective, beta, factor * d, len(beta), 0, 0))
    if not converged:
        warnings.warn(f"L-BFGS failed to converge within {p.max_iter} iterations", ConvergenceWarning, stacklevel=2)
    return beta, n, converged


def trust_region(problem: Problem, start: np.ndarray):
    """Newton steps no longer than a radius that follows how well the quadratic model predicts.

    A step solves (H + shift) d = score with the least shift that keeps it inside the radius, by
    the eigenvalues of H; each step costs one pass, and rejected ones shrink the radius only.
    """
    p, beta = problem, start
    own = slice(0 if p.space.intercept else 1, len(start))
    answer = (yield [p.ask([beta])])[0]
    objective, score, h = p.objective(answer.deviances[0], beta), p.score(answer, beta), p.curvature(answer)
    radius, n, converged = 1.0, 0, np.abs(score[own]).max() < p.gradient_tol
    while n < p.max_iter and not converged and radius > 1e-14:
        n += 1
        values, vectors = np.linalg.eigh(h[own, own])
        along_ = vectors.T @ score[own]
        length = lambda shift: np.linalg.norm(along_ / np.maximum(values + shift, EPS))
        shift = max(0.0, -values[0] + EPS)
        if length(shift) > radius:
            low, high = shift, shift + np.linalg.norm(along_) / radius
            for _ in range(100):
                shift = (low + high) / 2
                low, high = (shift, high) if length(shift) > radius else (low, shift)
            shift = high
        step = np.zeros_like(beta)
        step[own] = vectors @ (along_ / np.maximum(values + shift, EPS))
        promised = score @ step - 0.5 * step @ h @ step
        tried = (yield [p.ask([beta + step])])[0]
        gain = objective - p.objective(tried.deviances[0], beta + step) if tried.largest[0] == 0 else -np.inf
        ratio = gain / promised if promised > 16 * EPS * abs(objective) else float(gain >= -16 * EPS * abs(objective))
        size = np.linalg.norm(step)
        radius = size / 4 if ratio < 0.25 else max(radius, 2 * size) if ratio > 0.75 else radius
        if ratio > 1e-4:
            beta = beta + step
            objective, score, h = p.objective(tried.deviances[0], beta), p.score(tried, beta), p.curvature(tried)
            converged = np.abs(score[own]).max() < p.gradient_tol or (p.step_size_tol is not None and size < p.step_size_tol)
        p.diagnostics.append(_row(p, n, np.abs(score[own]).max(), objective, beta, step if ratio > 1e-4 else None, len(beta), 0, 0))
    if not converged:
        warnings.warn(f"the trust-region steps failed to converge within {p.max_iter} iterations", ConvergenceWarning, stacklevel=2)
    return beta, n, converged


def solver(name: str, problem: Problem, start: np.ndarray):
    if name == "closed-form":
        return closed_form(problem, start)
    if name == "lbfgs":
        return lbfgs(problem, start)
    if name == "trust-constr" and problem.a is None and problem.lower is None and not problem.p1.any():
        return trust_region(problem, start)
    inner = {"irls-ls": "ls", "irls-cd": "cd", "trust-constr": "qp" if problem.a is not None else "cd", "irls-ls-monotonic": "qp"}[name]
    return irls(problem, start, inner)


def along(name: str, problems: list[Problem], start: np.ndarray):
    """A path of problems, each started from the solution before it."""
    out = []
    for problem in problems:
        start, n, _ = yield from solver(name, problem, start)
        out.append((start, n))
    return out


def run(coded: Coded, family, link, coroutines: list) -> list:
    """Run optimisers together, one Spark job for each round of their requests."""
    results: list = [None] * len(coroutines)
    waiting, rounds = {}, 0
    for k, c in enumerate(coroutines):
        try:
            waiting[k] = next(c)
        except StopIteration as end:
            results[k] = end.value
    while waiting:
        flat = [(k, r) for k, rs in waiting.items() for r in rs]
        rounds += 1
        coded.table.sparkSession.sparkContext.setJobDescription(f"fit: pass {rounds} for {len(flat)} requests")
        answers = evaluate(coded, family, link, [r for _, r in flat])
        by: dict[int, list[Answer]] = {}
        for (k, _), answer in zip(flat, answers):
            by.setdefault(k, []).append(answer)
        again = {}
        for k, got in by.items():
            try:
                again[k] = coroutines[k].send(got)
            except StopIteration as end:
                results[k] = end.value
        waiting = again
    coded.table.sparkSession.sparkContext.setJobDescription(None)
    return results
