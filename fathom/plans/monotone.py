"""Coefficients that rise or fall along a variable, as linear inequalities on a design.

A term's columns are a grid with one axis for each of its factors. To rise with a variable means
that along its axis, whatever the place on the other axes, no coefficient is below the one
before it; an axis of one column has no other to compare with, so its sign is bound instead.
"""

from __future__ import annotations

import math

import numpy as np

from .design import Design, Factor

#: The sign of ``before - after`` in ``A coefficients <= 0``.
SIGNS = {"increasing": 1.0, "decreasing": -1.0}


def rows(design: Design, wanted: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """``A`` and ``b`` of ``A coefficients <= b`` for ``{variable: direction}``."""
    for variable, direction in wanted.items():
        if direction not in SIGNS:
            raise ValueError(f"monotonic_constraints of {variable} must be 'increasing' or 'decreasing'")
    width = len(design.feature_names())
    before, after, signs = [], [], []
    missing = dict.fromkeys(wanted)
    for term, grid, factors in _grids(design):
        for axis, factor in enumerate(factors):
            if factor.variable not in wanted:
                continue
            if sum(f.variable == factor.variable for f in factors) > 1:
                raise ValueError(f"{factor.variable} interacts with itself in {term}")
            if not factor.ordered:
                raise ValueError(f"monotonic constraints do not apply to {term}")
            missing.pop(factor.variable, None)
            lanes = np.moveaxis(grid, axis, -1)[..., _order(factor, grid.shape[axis], design.missing_name)]
            # An axis of one column is compared with the 0 that ``width`` stands for.
            pairs = (lanes[..., :-1], lanes[..., 1:]) if lanes.shape[-1] > 1 else (np.full_like(lanes, width), lanes)
            before.append(pairs[0].ravel())
            after.append(pairs[1].ravel())
            signs.append(np.full(pairs[0].size, SIGNS[wanted[factor.variable]]))
    if missing:
        raise ValueError(f"no column of the model belongs to {', '.join(missing)}")
    low, high, sign = np.concatenate(before), np.concatenate(after), np.concatenate(signs)
    unit = np.vstack([np.eye(width), np.zeros(width)])
    return sign[:, None] * (unit[low] - unit[high]), np.zeros(len(sign))


def _grids(design: Design):
    """Each term with its column numbers as a grid, and the factors of the grid's axes.

    Numeric factors vary slowest, then the categorical ones, each in the term's order.
    """
    start = 0
    for term, factors, reduced in design.terms:
        numeric = [(f, len(f.columns)) for f in factors if not f.categorical]
        coded = [(f, len(f.labels(design.missing_name)) - r) for f, r in zip(factors, reduced) if f.categorical]
        shape = [n for _, n in numeric + coded]
        yield term, start + np.arange(math.prod(shape)).reshape(shape), [f for f, _ in numeric + coded]
        start += math.prod(shape)


def _order(factor: Factor, size: int, missing_name: str) -> list[int]:
    """The places of an axis from low to high: numbers by value, then other levels by name."""
    if not factor.categorical:
        return list(range(size))
    labels = factor.labels(missing_name)[-size:] if size else []
    return sorted(range(size), key=lambda k: _rank(labels[k]))


def _rank(label: str) -> tuple:
    try:
        return 0, float(label), ""
    except ValueError:
        return 1, math.inf, label
