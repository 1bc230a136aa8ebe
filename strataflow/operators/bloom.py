"""Bloom filters as ordinary columns, built and probed inside the JVM.

A filter has at most MAX_BITS bits. Where the keys need more, they are spread by hash over several filters and each key asks its own one. All
filters together are at most MAX_FILTERS * MAX_BITS bits (64 MB), which is what a task may be sent; callers with more keys than that go in rounds
over ranges of the hash (see ``rounds_for``), so the filters keep their power and their bound at any number of keys.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, functions as F

from strataflow.storage import stage

#: Bits of one filter (8 MB, the most that the engine's aggregate allows), filters in use at once, and bits a key.
MAX_BITS = 1 << 26
MAX_FILTERS = 8
BITS_PER_KEY = 12


def filters_for(rows: int) -> int:
    """Filters needed for so many keys."""
    return max(1, math.ceil(rows * BITS_PER_KEY / MAX_BITS))


def rounds_for(rows: int) -> int:
    """Rounds over the data in which so many keys can be asked for with filters of full power."""
    return math.ceil(filters_for(rows) / MAX_FILTERS)


def in_round(key: Column, number: int, rounds: int) -> Column:
    """Whether a key belongs to that round."""
    return F.lit(True) if rounds == 1 else F.pmod(F.hash(F.lit("round"), key), F.lit(rounds)) == number


def _filter_of(key: Column, filters: int) -> Column:
    return F.pmod(F.hash(key), F.lit(filters))


def _parts(df: DataFrame):
    """The JVM's expressions, or None where this Spark lacks them."""
    jvm = df.sparkSession._jvm
    try:
        to, pkg = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions
        to.expression, pkg.BloomFilterMightContain, getattr(pkg, "aggregate").BloomFilterAggregate  # noqa: B018
        return to, pkg
    except Exception:  # py4j raises several kinds
        return None


def bloom_filter(keys: DataFrame, key: Column, rows: int | None = None) -> list[Column]:
    """Scalar subqueries that hold Bloom filters of the non-null keys; a key is in the one that its hash picks.

    ``rows`` is an upper bound of the number of keys (counted where it isn't given). Without the JVM's filter expressions the list is empty, and
    might_contain() lets everything pass to the exact check that follows it.
    """
    parts = _parts(keys)
    if parts is None:
        warnings.warn("no Bloom filter expressions in this Spark: all keys go to the exact check", stacklevel=2)
        return []
    to, pkg = parts
    rows = keys.count() if rows is None else rows
    filters = min(MAX_FILTERS, filters_for(rows))
    each = math.ceil(rows / filters)
    bits = max(64, min(MAX_BITS, each * BITS_PER_KEY))
    number = lambda n: to.expression(F.lit(n).cast("long")._jc)
    build = getattr(pkg, "aggregate").BloomFilterAggregate(to.expression(F.col("_h")._jc), number(max(1, each)), number(bits))
    bloom = Column(to.column(build.toAggregateExpression())).alias("bloom")
    hashes = keys.where(key.isNotNull()).select(F.xxhash64(key).alias("_h"), _filter_of(key, filters).alias("_part"))
    if filters == 1:
        return [hashes.agg(bloom).scalar()]
    # Only hashes are shuffled, and each filter is built whole by one task of a bounded number of keys.
    built = stage(hashes.repartition(filters, "_part").groupBy("_part").agg(bloom), "filters")
    return [built.where(F.col("_part") == i).select("bloom").scalar() for i in range(filters)]


def might_contain(df: DataFrame, blooms: list[Column], key: Column) -> Column:
    """False: the key is certainly not among the filters' keys. Empty filters hold nothing."""
    if not blooms:
        return F.lit(True)
    to, pkg = _parts(df)
    ask = lambda bloom: F.coalesce(Column(to.column(pkg.BloomFilterMightContain(to.expression(bloom._jc), to.expression(F.xxhash64(key)._jc)))), F.lit(False))
    if len(blooms) == 1:
        return ask(blooms[0])
    part, answer = _filter_of(key, len(blooms)), F.lit(False)
    for i, bloom in enumerate(blooms):
        answer = F.when(part == i, ask(bloom)).otherwise(answer)
    return answer
