"""Special functions of single numbers: Bessel functions, by their array forms, and the Jacobi symbol of integers of any size."""

from __future__ import annotations

import numpy as np

from meetspark.functions import arrays


def bessel_j(n: int, x: float) -> float:
    """J_n(x)."""
    return float(arrays.bessel_j(n, np.array([x]))[0])


def bessel_y(n: int, x: float) -> float:
    """Y_n(x); -inf at 0, NaN below."""
    return float(arrays.bessel_y(n, np.array([x]))[0])


def jacobi(a: int, b: int) -> int:
    """The Jacobi symbol (a/b) for odd b; a negative b contributes the sign of a."""
    if b % 2 == 0:
        raise ValueError("the second argument must be odd")
    sign = 1
    if b < 0:
        b = -b
        sign = -1 if a < 0 else 1
    a %= b
    while a:
        while a % 2 == 0:
            a //= 2
            if b % 8 in (3, 5):
                sign = -sign
        a, b = b, a
        if a % 4 == 3 and b % 4 == 3:
            sign = -sign
        a %= b
    return sign if b == 1 else 0
