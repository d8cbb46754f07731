"""A deterministic position for a key, the same on every run and every engine.

Unlike `rand()` or a row position it survives the loss of an executor: a task that
is run again picks the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_HEX_DIGITS = 12


def hash_fraction(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that depends only on the key columns and the seed."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    digits = F.substring(F.md5(text), 1, _HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**_HEX_DIGITS))
