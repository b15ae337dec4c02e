"""Reproducible randomness.

``rand()`` depends on how rows are partitioned, so a retried task may draw
another number. A hash of a seed and the row's own key does not.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 52


def uniform(seed: str, *parts) -> Column:
    """A number in (0, 1) that depends only on the seed and the given values."""
    text = F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    head = F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("double")
    return (head + 0.5) / float(2**_BITS)


def exponential(seed: str, *parts) -> Column:
    """A unit-rate exponential variate; divided by a weight it is a race key."""
    return -F.log(uniform(seed, *parts))
