"""Fixed-point display formatting with Python's rules.

Python formats a float from its exact binary value, rounding half to even;
``format_number`` (DecimalFormat, HALF_EVEN on the exact value) does the
same on the JVM, so only the grouping commas need removing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_fixed(c, digits: int) -> Column:
    """f"{x:.{digits}f}" as a Column (inf -> 'inf', nan -> 'nan')."""
    x = _c(c)
    s = F.regexp_replace(F.format_number(x, digits), ",", "")
    return (F.when(x.isNull(), F.lit(None))
             .when(F.isnan(x), F.lit("nan"))
             .when(x == float("inf"), F.lit("inf"))
             .when(x == float("-inf"), F.lit("-inf"))
             .otherwise(s))


def py_percent(c, digits: int = 1) -> Column:
    """f"{x:.{digits}%}": x * 100 in double, then fixed format and '%'."""
    return F.concat(py_fixed(_c(c) * F.lit(100.0), digits), F.lit("%"))
