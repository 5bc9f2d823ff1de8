"""Equi-joins in which one key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import fresh

#: Keys dealt over SALTS tasks: those of more than HOT_ROWS rows, the TOP most frequent of them. TOP bounds what is
#: broadcast; a key beyond it holds at most one in TOP of all rows.
HOT_ROWS, TOP, SALTS = 500, 10_000, 64


def join_spread(left: DataFrame, right: DataFrame, keys: str | Sequence[str], count: str, how: str = "inner") -> DataFrame:
    """left joined to right on keys, without the column count of right: how many rows of left have that key.

    right has one row a key. Rows of left under a hot key are dealt by the hash of all their columns, and that key's
    row of right is given to each part. Null keys match nothing; a left join keeps them. Any count gives the same rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    taken = [*left.columns, *right.columns]
    salt, hot = fresh(taken, "salt"), fresh(taken, "hot")
    most = right.filter(F.col(count) > HOT_ROWS).orderBy(F.desc(count)).limit(TOP).select(*keys, F.lit(True).alias(hot))
    parts = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    a = left.join(F.broadcast(most), keys, "left").withColumn(salt, F.when(F.col(hot), parts).otherwise(0)).drop(hot)
    copies = F.when(F.col(count) > HOT_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    b = right.withColumn(salt, F.explode(copies)).drop(count)
    return a.join(b, [*keys, salt], how).drop(salt)
