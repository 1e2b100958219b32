"""Exact discrete noise for private releases, from integers alone (Canonne, Kamath and Steinke 2020).

No logarithm, exponential or floating-point number is taken: every step is a fair draw below a whole number, so the
probabilities are those of the discrete Laplace distribution and not of a rounded one. Only the standard library is used;
tasks get these functions by value.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from fractions import Fraction

Below = Callable[[int], int]


def bernoulli_exp(n: int, d: int, below: Below = secrets.randbelow) -> bool:
    """True with probability exp(-n / d), for 0 <= n <= d.

    k counts up while draws of chance n / (d * k) come true; it stops at an odd k with probability 1 - g + g^2/2 - ..., g = n / d.
    """
    k = 1
    while below(d * k) < n:
        k += 1
    return k % 2 == 1


def discrete_laplace(epsilon: Fraction, below: Below = secrets.randbelow) -> int:
    """x with probability proportional to exp(-epsilon * abs(x))."""
    s, t = epsilon.numerator, epsilon.denominator
    while True:
        u = below(t)
        if not bernoulli_exp(u, t, below):
            continue
        v = 0
        while bernoulli_exp(1, 1, below):
            v += 1
        size = (u + t * v) // s
        if below(2):
            return size
        if size:  # a negative zero would count zero twice
            return -size
