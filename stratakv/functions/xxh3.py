"""XXH3-64 (seed 0) of keys: Spark's own ``xxhash64`` is another function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def xxh3(data: bytes | str) -> int:
    """Unsigned 64-bit hash."""
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


@F.pandas_udf(T.DecimalType(20, 0))
def xxh3_64(keys: pd.Series) -> pd.Series:
    from decimal import Decimal

    return keys.map(lambda k: None if k is None else Decimal(xxh3(k)))


def normalize_key(key: Column) -> Column:
    """Without one leading slash."""
    return F.regexp_replace(key, "^/", "")
