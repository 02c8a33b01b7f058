"""Equi-joins that stay splittable when one key holds a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HASH = "__key_hash"


def skew_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
    null_safe: Sequence[str] = (), also: Column | None = None,
) -> DataFrame:
    """Join on ``keys`` so that adaptive execution can split a hot key of ``left``.

    Adaptive skew handling only splits a join whose two inputs both arrive straight from a
    shuffle. When ``right`` is an aggregate or a window over the same keys it is already
    partitioned and no shuffle is planned for it. Adding the hash of the keys as one more join
    column leaves the result as it is and makes both inputs shuffle for this join. ``right`` should have
    few rows per key, as it is repeated for each split of ``left``.

    Keys named in ``null_safe`` match NULL with NULL; for the others NULL matches nothing.
    ``also`` is one more condition, over columns that only one side has.
    """
    hashed = F.xxhash64(*keys)
    right_key = {key: f"__right_{key}" for key in [*keys, _HASH]}
    hashed_left = left.withColumn(_HASH, hashed)
    hashed_right = right.withColumn(_HASH, hashed).withColumnsRenamed(right_key)
    condition = F.lit(True)
    for key, other in right_key.items():
        match = F.col(key).eqNullSafe(F.col(other)) if key in null_safe else F.col(key) == F.col(other)
        condition = match if key == keys[0] else condition & match
    if also is not None:
        condition = condition & also
    return hashed_left.join(hashed_right, condition, how).drop(_HASH, *right_key.values())
