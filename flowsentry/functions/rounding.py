"""Decimal rounding of doubles by their exact binary value.

``round(x, 2)`` in Python looks at the exact value of the double and breaks true
ties to the even digit; Spark's ``round`` works on the printed decimal.  The
smallest double that rounds to ``k`` units is found once per ``k`` while the plan
is built (a table of at most a few hundred numbers) and enters the plan as an
array literal, so the rounding itself is plain arithmetic inside codegen.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=None)
def cut_points(top: int, digits: int) -> tuple[float, ...]:
    """``cut_points[k]`` is the smallest double >= 0 that rounds to at least
    ``k / 10**digits``, for k = 0 .. top + 1."""
    scale = 10 ** digits
    cuts = [0.0]
    for k in range(1, top + 2):
        goal, x = k / scale, (k - 0.5) / scale
        while round(x, digits) >= goal:
            x = math.nextafter(x, -math.inf)
        while round(x, digits) < goal:
            x = math.nextafter(x, math.inf)
        cuts.append(x)
    return tuple(cuts)


def units_sql(x: str, top: int, digits: int) -> str:
    """Spark SQL text: the number of ``10**-digits`` units that the column ``x``
    (0 <= x <= top units) rounds to."""
    cuts = "array(" + ", ".join(f"{c!r}D" for c in cut_points(top, digits)) + ")"
    near = f"least(greatest(cast(floor({x} * {float(10 ** digits)!r}D + 0.5D) as int), 0), {top})"
    return (f"{near} + CASE WHEN {x} < element_at({cuts}, {near} + 1) THEN -1 "
            f"WHEN {x} >= element_at({cuts}, {near} + 2) THEN 1 ELSE 0 END")


def round2_sql(x: str) -> str:
    """Python's ``round(x, 2)`` for a column in [0, 1]."""
    return f"({units_sql(x, 100, 2)}) / 100.0D"


def fixed1(c: Column, top: float) -> Column:
    """Python's ``'%.1f' % x`` for |x| < ``top``; below ``-top`` (no flow has such
    an average, as packets are counts) the platform's own formatting."""
    size = F.abs(c)
    last = int(math.ceil(top * 10))
    cuts = F.array(*[F.lit(v) for v in cut_points(last, 1)])
    near = F.least(F.floor(size * 10 + 0.5).cast("int"), F.lit(last))
    units = near + F.when(size < F.get(cuts, near), -1).when(size >= F.get(cuts, near + 1), 1).otherwise(0)
    text = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.floor(units / 10).cast("string"),
                    F.lit("."), (units % 10).cast("string"))
    return F.when(size <= top, text).otherwise(F.format_string("%.1f", c))
