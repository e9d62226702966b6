"""Join helpers for lookups keyed by words, tags or symbols.

Word keys are Zipf-distributed: one word may own a third of all rows.
``skew_join`` spreads such keys: the K values carrying most rows of the big
side (counted with map-side combining; a bounded top-K, broadcast) are
marked; their rows get a salt from a hash of the row and their lookup rows
(at most K) are copied once per salt, other keys use salt 0.  One shuffle
join on (key, salt) follows, so a hot key spreads over ``salts`` tasks and
no other key holds more than 1/K of the rows.  Null keys, which match nothing,
are spread like hot ones.  The salt is deterministic (a
hash, no random numbers), so a recomputed task sends every row to the same
place.  AQE (see ``lexspark.session``) still applies to the join.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000
SALTS = 32


def top_keys(df: DataFrame, col: str, k: int = HOT_KEYS) -> DataFrame:
    """The ``k`` most frequent non-null values of ``col`` (column ``__hv``), ties by value."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("__hv")).agg(F.count("*").alias("__n"))
            .orderBy(F.desc("__n"), F.col("__hv")).limit(k).select("__hv"))


def skew_join(big: DataFrame, small: DataFrame, keys, how: str = "left", hot_col: Optional[str] = None,
              hot: Optional[DataFrame] = None, salts: int = SALTS) -> DataFrame:
    """``big`` joined with ``small`` (at most one row per key) on the columns ``keys`` of both.

    ``hot_col`` (default: the last key) is the skewed column; ``hot`` its
    hot values (default: ``top_keys`` of ``big``).  In a chain of lookups pass
    one ``hot`` computed from the chain's input: it keeps the plan linear.
    """
    k = list(keys)
    hc = hot_col or k[-1]
    hv = (hot if hot is not None else top_keys(big, hc)).withColumn("__hot", F.lit(True))
    hb = F.broadcast(hv)  # at most HOT_KEYS rows
    b = big.join(hb, F.col(hc) == F.col("__hv"), "left").drop("__hv")
    spread = F.coalesce(F.col("__hot"), F.lit(False)) | F.col(hc).isNull()  # a null key matches nothing: any place will do
    b = b.withColumn("__salt", F.when(spread, F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]),
                                                            F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    sm = small.join(hb, F.col(hc) == F.col("__hv"), "left").drop("__hv")
    sm = sm.withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                           .otherwise(F.array(F.lit(0))))).drop("__hot")
    return b.drop("__hot").join(sm, k + ["__salt"], how).drop("__salt")


def flag_member(df: DataFrame, key_col: str, members: DataFrame, member_col: str, flag: str,
                hot: Optional[DataFrame] = None) -> DataFrame:
    """Add BOOLEAN ``flag``: ``df[key_col]`` is among ``members[member_col]``; null -> false."""
    s = members.select(F.col(member_col).alias("__k")).where(F.col("__k").isNotNull()).distinct() \
        .withColumn("__hit", F.lit(True))
    out = skew_join(df.withColumn("__k", F.col(key_col)), s, ["__k"], "left", hot=hot)
    return out.withColumn(flag, F.coalesce(F.col("__hit"), F.lit(False))).drop("__k", "__hit")
