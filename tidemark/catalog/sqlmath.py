"""SQL snippets for tail probabilities, used only in the comparison statements."""

from __future__ import annotations

_LIMIT = 300


def gamma_tail(a: str, x: str) -> str:
    """Upper tail of the gamma distribution by its power series; 0 far out."""
    terms = f"list_transform(range(0, 900), lambda k: exp(-({x}) + (({a}) + k) * ln({x}) - lgamma(({a}) + k + 1)))"
    return f"CASE WHEN ({x}) <= 0 THEN 1.0 WHEN ({x}) > {_LIMIT} THEN 0.0 ELSE greatest(0.0, 1 - list_sum({terms})) END"


def chi2_tail(x: str, dof: str) -> str:
    return gamma_tail(f"({dof}) / 2.0", f"({x}) / 2.0")


def normal_two_sided(z: str) -> str:
    return gamma_tail("0.5", f"({z}) * ({z}) / 2.0")


def f_tail(f: str, d1: str, d2: str) -> str:
    """Upper tail of the F distribution by the series of the incomplete beta function."""
    a, b = f"(({d1}) / 2.0)", f"(({d2}) / 2.0)"
    y = f"(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2})))"
    term = f"exp({a} * ln({y}) + {b} * ln(1 - {y}) + lgamma({a} + {b} + k) - lgamma({b}) - lgamma({a} + 1 + k) + k * ln({y}))"
    return (
        f"CASE WHEN ({f}) <= 0 THEN 1.0 WHEN ({d1}) * ({f}) / 2 > {_LIMIT} THEN 0.0 "
        f"ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 900), lambda k: {term}))) END"
    )


def t_two_sided(t: str, dof: str) -> str:
    return f_tail(f"(({t}) * ({t}))", "1", dof)


def t_quantile_975(dof: str) -> str:
    """Expansion of the 97.5 % point around the normal one, for many degrees of freedom."""
    z = 1.959963984540054
    c1 = (z**3 + z) / 4
    c2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    c3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return f"({z!r} + {c1!r} / ({dof}) + {c2!r} / ({dof})**2 + {c3!r} / ({dof})**3)"
