"""Recovery models as SQL expressions of a time expression (section 2.9)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Polynomial coefficients of the modified Bessel functions I0 and I1 (Abramowitz & Stegun 9.8.1-9.8.4).
I0_SMALL = [1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813]
I1_SMALL = [0.5, 0.87890594, 0.51498869, 0.15084934, 0.02658733, 0.00301532, 0.00032411]
I0_LARGE = [0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377]
I1_LARGE = [0.39894228, -0.03988024, -0.00362018, 0.00163801, -0.01031555, 0.02282967, -0.02895312, 0.01787654, -0.00420059]


def horner(coefs: list[float], x: str) -> str:
    out = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = f"({c!r} + ({x}) * {out})"
    return out


def bessel_kernel(z: str) -> str:
    """exp(-z) * (I0(z) + I1(z)) for z >= 0."""
    s, q = f"power(({z}) / 3.75, 2)", f"(3.75 / ({z}))"
    small = f"exp(-({z})) * ({horner(I0_SMALL, s)} + ({z}) * {horner(I1_SMALL, s)})"
    large = f"({horner(I0_LARGE, q)} + {horner(I1_LARGE, q)}) / sqrt({z})"
    return f"(CASE WHEN ({z}) <= 3.75 THEN {small} ELSE {large} END)"


def rise(t: str, tau: str) -> str:
    return f"(1 - exp(-({t}) / ({tau})))"


def single(t, m, tau, b):
    return f"({b} + {m} * {rise(t, tau)})"


def double(t, a1, tau1, a2, tau2, b):
    return f"({b} + {a1} * {rise(t, tau1)} + {a2} * {rise(t, tau2)})"


def triple(t, a1, tau1, a2, tau2, a3, tau3, b):
    return f"({b} + {a1} * {rise(t, tau1)} + {a2} * {rise(t, tau2)} + {a3} * {rise(t, tau3)})"


def plateau_form(t, plateau, amp, k):
    return f"({plateau} - {amp} * exp(-({k}) * ({t})))"


def soumpasis(t: str, tau: str, m: str, b: str, parametrization: str = "default") -> str:
    """Circular spot, pure diffusion.  ``default`` uses z = 2 tau / t (= w^2 / 2Dt), ``reference`` z = tau / 2t."""
    safe = f"greatest({t}, 1e-12)"
    z = f"(2 * ({tau}) / {safe})" if parametrization == "default" else f"(({tau}) / (2 * {safe}))"
    return f"({b} + {m} * {bessel_kernel(z)})"


def reaction_diffusion(t, m, k_on, k_off, k_d, b):
    s = f"greatest({k_on} + {k_off}, 1e-12)"
    return f"({b} + {m} * (1 - ({k_off}) / {s} * exp(-{s} * ({t})) - ({k_on}) / {s} * exp(-({k_d}) * ({t}))))"


def two_rate_binding(t, a_diff, k_diff, a_bind, k_off, c):
    return f"({a_diff} * (1 - exp(-({k_diff}) * ({t}))) + {a_bind} * (1 - exp(-({k_off}) * ({t}))) + {c})"


def three_rate_binding(t, a_diff, k_diff, a1, k1, a2, k2, c):
    return f"({two_rate_binding(t, a_diff, k_diff, a1, k1, c)} + {a2} * (1 - exp(-({k2}) * ({t}))))"


def stretched(t, a, tau, beta, c):
    return f"({a} * (1 - exp(-power(greatest({t}, 0) / ({tau}), {beta}))) + {c})"


def double_stretched(t, a1, tau1, beta1, a2, tau2, beta2, c):
    return f"({stretched(t, a1, tau1, beta1, c)} + {stretched(t, a2, tau2, beta2, '0')})"


def power_law(t, a, c, d0, alpha):
    return f"({a} * (1 - exp(-({d0}) * power({t}, {alpha}))) + {c})"


def reaction_diffusion_simple(t, f_imm, f_b, f_f, k_eff, d, w):
    return f"({f_imm} + {f_f} * (1 - exp(-4 * {d} / ({w} * {w}) * ({t}))) + {f_b} * (1 - exp(-({k_eff}) * ({t}))))"


def reaction_diffusion_full(t, f_imm, f_mobile, k_on, k_off, d, w):
    bound = f"(({k_on}) / ({k_on} + {k_off}))"
    return f"({f_imm} + {f_mobile} * ((1 - {bound}) * (1 - exp(-4 * {d} / ({w} * {w}) * ({t}))) + {bound} * (1 - exp(-({k_on} + {k_off}) * ({t})))))"


def reaction_dominant(t, a, c, k_off):
    return f"({a} * (1 - exp(-({k_off}) * ({t}))) + {c})"


def sigmoid(t, a, rate, lag, b):
    return f"({b} + {a} / (1 + exp(-({rate}) * (({t}) - ({lag})))))"


def expansion(t, kind, a0, a1, p):
    if kind == "exponential":
        return f"({a0} + {a1} * (1 - exp(-({p}) * ({t}))))"
    return f"({a0} + {a1} * ({t}))" if kind == "linear" else f"({a0} + {a1} * power({t}, {p}))"


def random_walk(t, depth, mobile, tau, alpha):
    """Heavy-tailed recovery with the stretched-exponential form of the relaxation function."""
    x = f"power(greatest(({t}) / ({tau}), 0), {alpha})"
    return f"(1 - {mobile} * (1 - {depth}) * exp(-power({x}, {alpha})))"


def huber(r: Column, delta: float = 1.0) -> Column:
    return F.when(F.abs(r) <= delta, 0.5 * r * r).otherwise(delta * (F.abs(r) - 0.5 * delta))


def tukey(r: Column, c: float = 4.685) -> Column:
    u2 = (r / c) * (r / c)
    return F.when(F.abs(r) <= c, c * c / 6 * (1 - F.pow(1 - u2, 3))).otherwise(c * c / 6)


def soft_l1(r: Column, scale: float = 0.1) -> Column:
    z = (r / scale) * (r / scale)
    return 2 * scale * scale * (F.sqrt(1 + z) - 1)


def huber_weight(r: Column, delta: float = 1.0) -> Column:
    return F.when(F.abs(r) <= delta, 1.0).otherwise(delta / F.abs(r))


def tukey_weight(r: Column, c: float = 4.685) -> Column:
    u2 = (r / c) * (r / c)
    return F.when(F.abs(r) <= c, (1 - u2) * (1 - u2)).otherwise(0.0)


def soft_l1_weight(r: Column, scale: float = 0.1) -> Column:
    return 1 / F.sqrt(1 + (r / scale) * (r / scale))


def geometric(lo: float, hi: float, n: int) -> list[float]:
    return [lo * (hi / lo) ** (i / (n - 1)) for i in range(n)]
