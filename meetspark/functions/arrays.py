"""Special functions over numpy arrays, for Arrow batches: error functions, gamma, Bessel functions and the Jacobi symbol."""

from __future__ import annotations

import numpy as np

EULER = 0.57721566490153286060651209008240243
#: Where Bessel functions change from backward recurrence to Hankel's expansion; terms of the expansion.
FAR, HANKEL_TERMS = 30.0, 40


def erf(x: np.ndarray) -> np.ndarray:
    """2/sqrt(pi) exp(-x^2) sum of 2^n x^(2n+1) / (2n+1)!!, whose terms have one sign; from 6 on 1 to the last place."""
    x = np.asarray(x, np.float64)
    size = np.minimum(np.abs(x), 6.0)
    term = total = size
    for n in range(1, 160):
        term = term * (2 * size * size / (2 * n + 1))
        total = total + term
    near = 2 / np.sqrt(np.pi) * np.exp(-size * size) * total
    return np.copysign(np.where(np.abs(x) >= 6, 1.0, np.minimum(near, 1.0)), x)


def erfc(x: np.ndarray) -> np.ndarray:
    """Its continued fraction from 1 on, else 1 - erf(x)."""
    x = np.asarray(x, np.float64)
    big = np.maximum(x, 1.0)
    tail = big
    for k in range(240, 0, -1):
        tail = big + (k / 2) / tail
    head = np.trunc(big * 16) / 16  # exp(-x^2) in two steps, as the square loses the last bits
    far = np.exp(-head * head) * np.exp(-(big - head) * (big + head)) / (np.sqrt(np.pi) * tail)
    return np.where(x >= 1, far, 1 - erf(np.minimum(x, 1.0)))


def gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series from 34 on, reached by the recurrence; reflected below one half. NaN at the poles."""
    x = np.asarray(x, np.float64)
    mirrored = x < 0.5
    y = np.where(mirrored, 1 - x, x)
    product = np.ones_like(y)
    z = y.copy()
    for _ in range(34):
        low = z < 34
        product = np.where(low, product * z, product)
        z = np.where(low, z + 1, z)
    w = 1 / z
    series = 1 + w * (1 / 12 + w * (1 / 288 - w * (139 / 51840 + w * (571 / 2488320 - w * 163879 / 209018880))))
    half = np.power(np.minimum(z, 200.0), 0.5 * np.minimum(z, 200.0) - 0.25)
    out = np.sqrt(2 * np.pi) * half * np.exp(-np.minimum(z, 200.0)) * half * series / product
    whole = (y == np.floor(y)) & (y < 24)  # factorials below 2^53 are exact
    out = np.where(whole, np.round(out), out)
    out = np.where(z > 199, np.inf, out)
    reflected = np.pi / (_sin_pi(x) * out)
    return np.where(mirrored, np.where(x == np.floor(x), np.nan, reflected), out)


def _sin_pi(x: np.ndarray) -> np.ndarray:
    rest = x - 2 * np.round(x / 2)
    return np.sin(np.pi * rest)


def _order(n: int | np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, argument and sign with both not negative for J: J_-n(x) = J_n(-x) = (-1)^n J_n(x)."""
    n = np.broadcast_to(np.asarray(n), x.shape).astype(np.int64)
    odd = np.abs(n) % 2 == 1
    sign = np.where(odd & (n < 0), -1.0, 1.0) * np.where(odd & (x < 0), -1.0, 1.0)
    return np.abs(n), np.abs(x), sign


def _backward(n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """J_n, J_0, J_1, Y_0, Y_1 for x > 0 by Miller's recurrence downwards, and Neumann's series for Y in the J found."""
    top = int(max(n.max(initial=0), x.max(initial=0))) + 70
    top += top % 2
    above, here = np.zeros_like(x), np.full_like(x, 1e-250)
    wanted, total, even, odd = (np.zeros_like(x) for _ in range(4))
    one = zero = here
    for k in range(top, -1, -1):  # here is J_k, up to a common factor
        wanted = np.where(n == k, here, wanted)
        if k % 2 == 0:
            total = total + (2 * here if k else here)
            if k:
                even = even + (-1) ** (k // 2) * here / (k // 2)
        elif k > 1:
            m = (k - 1) // 2
            odd = odd + (-1) ** m * here * (2 * m + 1) / (m * (m + 1))
        if k == 1:
            one = here
        if k == 0:
            zero = here
            break
        above, here = here, 2 * k / x * here - above
        big = np.abs(here) > 1e150
        if big.any():
            above, here, wanted, total, even, odd, one = (np.where(big, v * 1e-200, v) for v in (above, here, wanted, total, even, odd, one))
    wanted, zero, one, even, odd = (v / total for v in (wanted, zero, one, even, odd))
    log = np.log(x / 2) + EULER
    y0 = 2 / np.pi * (log * zero - 2 * even)
    y1 = 2 / np.pi * ((log - 1) * one - odd - zero / x)
    return wanted, zero, one, y0, y1


def _hankel(order: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """J and Y of order 0 or 1 for large x; the terms are added as long as they fall."""
    p, q, term, last = np.ones_like(x), np.zeros_like(x), np.ones_like(x), np.full_like(x, np.inf)
    for k in range(1, HANKEL_TERMS):
        term = term * ((4 * order * order - (2 * k - 1) ** 2) / (8 * k * x))
        size = np.abs(term)
        some = np.where(size < last, term, 0.0)
        last = np.minimum(size, last)
        if k % 2:
            q = q + (-1) ** (k // 2) * some
        else:
            p = p + (-1) ** (k // 2) * some
    # The phase x - order pi/2 - pi/4, by the sum formulas, as the difference itself loses bits.
    c, s = np.cos(x), np.sin(x)
    cos, sin = ((c + s, s - c) if order == 0 else (s - c, -(s + c)))
    scale = 1 / np.sqrt(np.pi * x)
    return scale * (p * cos - q * sin), scale * (p * sin + q * cos)


def _raised(n: np.ndarray, x: np.ndarray, zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """From orders 0 and 1 up to n by the recurrence."""
    out = np.where(n == 0, zero, one)
    low, high = zero, one
    for k in range(1, int(n.max(initial=0))):
        low, high = high, 2 * k / x * high - low
        out = np.where(n == k + 1, high, out)
    return out


def bessel_j(n: int | np.ndarray, x: np.ndarray) -> np.ndarray:
    """J_n(x) for integer n."""
    n, size, sign = _order(n, np.asarray(x, np.float64))
    size = np.where(np.isnan(size), 0.0, size)
    out = np.where(n == 0, 1.0, 0.0)  # at 0, and far above x below the least double
    near = (size > 0) & ((size < FAR) | (n > size)) & (n < 2 * size + 400)
    far = (size >= FAR) & (n <= size) & np.isfinite(size)
    if near.any():
        out[near] = _backward(n[near], size[near])[0]
    if far.any():
        out[far] = _raised(n[far], size[far], _hankel(0, size[far])[0], _hankel(1, size[far])[0])
    return np.where(np.isinf(size), 0.0, np.where(np.isnan(x), np.nan, sign * out))


def bessel_y(n: int | np.ndarray, x: np.ndarray) -> np.ndarray:
    """Y_n(x) for integer n and x > 0; -inf at 0, NaN below. Upwards the recurrence is stable."""
    x = np.asarray(x, np.float64)
    n, _, sign = _order(n, np.abs(x))
    out = np.full(x.shape, np.nan)
    near, far = (x > 0) & (x < FAR), (x >= FAR) & np.isfinite(x)
    if near.any():
        _, _, _, y0, y1 = _backward(np.zeros(int(near.sum()), np.int64), x[near])
        out[near] = _raised(n[near], x[near], y0, y1)
    if far.any():
        out[far] = _raised(n[far], x[far], _hankel(0, x[far])[1], _hankel(1, x[far])[1])
    return np.where(x == 0, -np.inf, np.where(np.isposinf(x), 0.0, sign * out))


def jacobi(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Jacobi symbol (a/b), and whether b is odd, as it must be; a negative b contributes the sign of a."""
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    odd = b % 2 == 1
    sign = np.where((b < 0) & (a < 0), -1, 1)
    n = np.where(odd, np.abs(b), 1)
    m = a % n
    while (m != 0).any():
        even = (m != 0) & (m % 2 == 0)
        while even.any():
            sign = np.where(even & np.isin(n % 8, (3, 5)), -sign, sign)
            m = np.where(even, m // 2, m)
            even = (m != 0) & (m % 2 == 0)
        live = m != 0
        sign = np.where(live & (m % 4 == 3) & (n % 4 == 3), -sign, sign)
        m, n = np.where(live, n % np.where(live, m, 1), 0), np.where(live, m, n)
    return np.where(n == 1, sign, 0), odd
