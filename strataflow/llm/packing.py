"""Filling containers of fixed capacity: first-fit decreasing over a tournament tree, in randomised groups of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Tokens a container holds, and the items a group has on average.
CAPACITY, GROUP = 2048, 4096


class Tournament:
    """A binary tree whose inner nodes hold the largest free capacity below them; the first bin with room is one descent."""

    def __init__(self, capacity: int, most: int) -> None:
        self.leaves = 1
        while self.leaves < max(1, most):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Puts an item into the first bin with room and returns its number."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        at = node - self.leaves
        free[node] -= size
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
        return at


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item. Sizes are at most the capacity; of equal ones the earlier is placed first."""
    bins = np.zeros(len(sizes), np.int64)
    tree = Tournament(capacity, len(sizes))
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i] = tree.place(int(sizes[i]))
    return bins


def pack(items: DataFrame, key: str, size: str, rows: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(key, copy_no, piece_no, first_token, n_tokens, container_id): every item in a container, whole unless longer than one.

    rows: the number of items or an upper bound; it sets the number of groups and thereby their expected size, whatever the
    table's size. Items are spread over the groups by a hash. Rows with the same key and size are copies, counted before the shuffle
    and numbered from 1, so a repeated key spreads over the groups too. An item longer than the capacity is cut into pieces
    of the capacity and a rest. Items of size 0 (null and empty texts) take a place in the first container of their group; a null size is 0.
    An empty table gives no rows.
    """
    groups = max(1, -(-rows // group))
    kind = dict(items.dtypes)[key]
    items = items.groupBy(key, F.coalesce(F.col(size), F.lit(0)).cast("int").alias("_size")).agg(F.count("*").alias("_copies"))
    items = items.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    last = F.greatest(F.ceil(F.col("_size") / F.lit(capacity)).cast("int") - 1, F.lit(0))
    items = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("piece_no") * capacity
    items = items.select(
        key, "copy_no", "piece_no", first.alias("first_token"), F.least(F.col("_size") - first, F.lit(capacity)).alias("n_tokens"),
        F.pmod(F.xxhash64(key, "copy_no", "piece_no"), F.lit(groups)).cast("int").alias("_group"),
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "copy_no", "piece_no"], ignore_index=True)
        bins = first_fit_decreasing(pdf["n_tokens"].to_numpy(), capacity)
        return pdf.assign(container_id=pdf["_group"].astype("int64") * (1 << 24) + bins).drop(columns="_group")

    return items.groupBy("_group").applyInPandas(fill, f"`{key}` {kind}, copy_no int, piece_no int, first_token int, n_tokens int, container_id bigint")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens and the share of the capacity in use (null where there are no containers)."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    whole = each.agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"))
    return whole.withColumn("fill_rate", F.round(F.col("n_tokens") / (F.col("n_containers") * F.lit(capacity)), 6))
