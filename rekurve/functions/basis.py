"""Vectorized basis functions of the fitters and the registry of fittable models (V2)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from rekurve.functions.models import I0_LARGE, I0_SMALL, I1_LARGE, I1_SMALL, geometric


def rise(t, tau):
    return -np.expm1(-t / tau)


def kernel(z):
    """exp(-z) (I0(z) + I1(z))."""
    s = np.minimum(z, 3.75)
    q = (s / 3.75) ** 2
    small = np.exp(-s) * (np.polyval(I0_SMALL[::-1], q) + s * np.polyval(I1_SMALL[::-1], q))
    g = np.maximum(z, 3.75)
    r = 3.75 / g
    large = (np.polyval(I0_LARGE[::-1], r) + np.polyval(I1_LARGE[::-1], r)) / np.sqrt(g)
    return np.where(z <= 3.75, small, large)


def _pos(t):
    return np.maximum(t, 1e-12)


def _power(t, p, unit=1.0):
    """(t / unit) ** p from logarithms, which take a fraction of the time; zero for no or a negative time."""
    with np.errstate(divide="ignore"):
        return np.exp(p * (np.log(np.maximum(t, 0)) - np.log(unit)))


@dataclass(frozen=True)
class Model:
    """Linear in one amplitude (and an offset) once the nonlinear parameters are given."""

    name: str
    basis: Callable  # (t, *parameters) -> values, broadcasting
    grid: Callable[[float, float], list[list[float]]]  # (shortest, longest time) -> first candidates per parameter
    log: tuple[bool, ...] = (True,)
    limits: tuple[tuple[float, float], ...] = ((1e-12, 1e12),)


MODELS: dict[str, Model] = {}


def register(m: Model) -> Model:
    """Add a model; user models work like the built-in ones."""
    MODELS[m.name] = m
    return m


TWO = ((1e-12, 1e12), (0.05, 1.0))
register(Model("single", rise, lambda lo, hi: [geometric(lo, 20 * hi, 40)]))
register(Model("soumpasis", lambda t, tau: kernel(2 * tau / _pos(t)), lambda lo, hi: [geometric(lo / 4, 20 * hi, 40)]))
register(Model("soumpasis_reference", lambda t, tau: kernel(tau / (2 * _pos(t))), lambda lo, hi: [geometric(lo, 80 * hi, 40)]))
register(Model("anomalous", lambda t, tau, beta: -np.expm1(-_power(t, beta, tau)), lambda lo, hi: [geometric(lo, 20 * hi, 24), [0.2, 0.35, 0.5, 0.65, 0.8, 1.0]], (True, False), TWO))
register(Model("power_law", lambda t, d, alpha: -np.expm1(-d * _power(t, alpha)), lambda lo, hi: [geometric(0.05 / hi, 1 / lo, 24), [0.25, 0.5, 0.75, 1.0, 1.4, 1.8]], (True, False), ((1e-12, 1e12), (0.05, 2.0))))
register(Model("sigmoid", lambda t, rate, lag: 1 / (1 + np.exp(np.clip(-rate * (t - lag), -700, 700))), lambda lo, hi: [geometric(0.5 / hi, 1 / lo, 16), [hi * f for f in (0.0, 0.1, 0.2, 0.35, 0.5, 0.75)]], (True, False), ((1e-12, 1e12), (0.0, 1e12))))
register(Model("expansion_exponential", lambda t, k: -np.expm1(-k * t), lambda lo, hi: [geometric(0.05 / hi, 1 / lo, 40)]))
register(Model("expansion_linear", lambda t, one: t * one, lambda lo, hi: [[1.0, 1.0 + 1e-9]], (False,), ((1.0, 1.0),)))
register(Model("expansion_power", lambda t, p: np.maximum(t, 0) ** p, lambda lo, hi: [[0.1 * i for i in range(1, 21)]], (False,), ((0.01, 2.0),)))
register(Model("decay", lambda t, k: np.exp(-k * t), lambda lo, hi: [geometric(0.05 / hi, 1 / lo, 40)]))
