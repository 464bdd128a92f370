"""What an exact quantile is: share and rule. See `plans.counted_quantiles` for how they are found."""

from __future__ import annotations

from dataclasses import dataclass

LINEAR, ORDINAL, DISCRETE = "linear", "ordinal", "discrete"


@dataclass(frozen=True)
class Quantile:
    """`linear` interpolates at p*(n-1); `ordinal` is the value at floor(p*n);
    `discrete` is the first value that a share p of the rows does not exceed."""

    name: str
    p: float
    rule: str = LINEAR


QUARTILES = (Quantile("median_value", 0.5), Quantile("q1_value", 0.25), Quantile("q3_value", 0.75))
