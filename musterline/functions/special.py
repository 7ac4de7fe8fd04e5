"""The digamma function, as an SQL expression and for numpy arrays."""

from __future__ import annotations

import numpy as np

# psi(x) = psi(x + SHIFT) - sum of 1 / (x + i), then the asymptotic
# series ln(y) - 1 / 2y - sum of coefficient / y^power.
SHIFT = 6
SERIES = ((2, 1 / 12), (4, -1 / 120), (6, 1 / 252), (8, -1 / 240), (10, 1 / 132))


def digamma(x):
    """psi(x) for x > 0.

    The steps below SHIFT are added in pairs from both ends, the series from its last term:
    few divisions and no powers."""
    inverse = 1.0 / (x + SHIFT)
    square = inverse * inverse
    series = 0.0
    for _, coefficient in reversed(SERIES):
        series = square * (coefficient + series)
    last = SHIFT - 1
    ends = x * (x + last)
    below = sum(1.0 / (ends + step * (last - step)) for step in range(SHIFT // 2))
    return np.log(x + SHIFT) - 0.5 * inverse - series - (2 * x + last) * below


def digamma_sql(name: str) -> str:
    """psi of a positive double column."""
    inverse_square = f"(1D / (({name} + {SHIFT}) * ({name} + {SHIFT})))"
    series = "0D"
    for _, coefficient in reversed(SERIES):
        series = f"({inverse_square} * ({coefficient!r}D + {series}))"
    below = " + ".join(f"1D / ({name} + {step})" for step in range(SHIFT))
    return f"(ln({name} + {SHIFT}) - 0.5D / ({name} + {SHIFT}) - {series} - ({below}))"
