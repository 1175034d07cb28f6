"""A Bloom filter of ids for thinning out a large side before its shuffle. It may only let too much through, so joins behind it stay exact."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHES = 4
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 26


def _places(column, bits: int) -> list:
    return [F.pmod(F.xxhash64(F.lit(k), column), F.lit(bits)) for k in range(HASHES)]


def thin(df: DataFrame, column: str, ids: DataFrame, key: str, count: int) -> DataFrame:
    """Rows of df whose long `column` may be among ids[key]. The filter has about 16 bits an id, but at most MOST_BITS (8 MB), whatever ids hold."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, count) - 1).bit_length()))
    place = ids.select(F.explode(F.array(*_places(F.col(key), bits))).alias("p"))
    words = place.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(table)

    def maybe(a, b, c, d):
        own, out = shared.value, True
        for p in (a.to_numpy(), b.to_numpy(), c.to_numpy(), d.to_numpy()):
            out &= (own[p >> 6] >> (p & 63)) & 1 == 1
        return pd.Series(out)

    maybe.__annotations__ = {**dict.fromkeys("abcd", pd.Series), "return": pd.Series}
    maybe = F.pandas_udf(maybe, "boolean")
    return df.filter(F.col(column).isNotNull()).filter(maybe(*_places(F.col(column), bits)))
