"""Exact, reproducible stratified splits and per-class samples.

Rows are ordered inside a class by a seeded hash of their key, which no partitioning
can change.  Instead of ranking every row (two classes would mean two tasks), the
hash value standing at each quota boundary is looked up: count rows per hash prefix, then
per longer prefix within the few cells a boundary falls into, until these are small
enough to rank.  Assigning rows is then a comparison with a handful of literals,
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.constants import DEMO_PER_CLASS, PRIVATE_COLUMNS, SEED

STEP_DIGITS = 4         # a level counts at most 16^4 cells per class
CELL_ROWS = 10_000      # a cell of more rows is split by the next digits
HASH_DIGITS = 32        # digits of the hash; beyond them the key itself decides


def hash_order(key: str, salt: str) -> Column:
    """Total order over keys: seeded hash first, key as tie-break."""
    return F.concat(F.md5(F.concat(F.lit(f"{salt}:"), F.col(key))), F.lit(":"), F.col(key))


def largest_remainder(sizes: Mapping, take: int) -> dict:
    """Share ``take`` over the classes in proportion to their sizes, summing exactly."""
    total = sum(sizes.values())
    quota = {c: take * n // total for c, n in sizes.items()}
    by_remainder = sorted(sizes, key=lambda c: (-(take * sizes[c] % total), c))
    for c in by_remainder[: take - sum(quota.values())]:
        quota[c] += 1
    return quota


def split_quotas(sizes: Mapping) -> dict[str, dict]:
    """Rows per class for test, validation and train (15 / 15 / 70, held-out rounded up)."""
    if len(sizes) < 2 or min(sizes.values()) < 2:
        raise ValueError("A stratified split needs two classes with at least two rows each.")
    total = sum(sizes.values())
    held_total = (3 * total + 9) // 10
    held = largest_remainder(sizes, held_total)
    if min(held.values()) < 2:
        raise ValueError("Too few rows to give every class a validation and a test row.")
    test = largest_remainder(held, (held_total + 1) // 2)
    validation = {c: held[c] - test[c] for c in held}
    train = {c: sizes[c] - held[c] for c in sizes}
    return {"test": test, "validation": validation, "train": train}


def prefix_counts(df: DataFrame, group: str, order: Column) -> dict:
    """{class: {hash prefix: rows}}; bounded by classes x 16^STEP_DIGITS cells."""
    cells = (
        df.groupBy(F.col(group).alias("g"), F.substring(order, 1, STEP_DIGITS).alias("p"))
        .count().collect()
    )
    out: dict = {}
    for cell in sorted(cells, key=lambda r: r["p"]):
        out.setdefault(cell["g"], {})[cell["p"]] = cell["count"]
    return out


def _cells_of(cells: Mapping, ranks: Mapping) -> dict:
    """{(class, prefix): (rows, {rank inside the cell: wanted rank})}."""
    wanted: dict = {}
    for c, positions in ranks.items():
        for rank in positions:
            before = 0
            for prefix, n in sorted(cells[c].items()):
                if before + n >= rank:
                    wanted.setdefault((c, prefix), (n, {}))[1][rank - before] = rank
                    break
                before += n
    return wanted


def _inside(wanted, prefix: Column) -> Column:
    return reduce(or_, [(F.col("g") == c) & (prefix == p) for c, p in wanted])


def order_keys_at(df: DataFrame, group: str, order: Column, cells: Mapping,
                  ranks: Mapping, cell_rows: int = CELL_ROWS) -> dict:
    """Order key at the wanted 1-based ranks: {class: {rank: key}}.

    At most one cell per wanted rank is looked into; one with more than ``cell_rows``
    rows is counted by its next digits first, so no task ranks more than that (unless
    rows share a whole hash, which only equal keys do).
    """
    keys = df.select(F.col(group).alias("g"), order.alias("k"))
    wanted = _cells_of(cells, ranks)
    small: dict = {}
    digits = STEP_DIGITS
    while wanted:
        small |= {k: v for k, v in wanted.items() if v[0] <= cell_rows or digits >= HASH_DIGITS}
        large = {k: v for k, v in wanted.items() if k not in small}
        wanted = {}
        if not large:
            break
        at, digits = F.substring("k", 1, digits), digits + STEP_DIGITS
        finer: dict = {}
        for r in (keys.where(_inside(large, at)).groupBy("g", F.substring("k", 1, digits).alias("p"))
                  .count().collect()):
            parent = (r["g"], r["p"][: digits - STEP_DIGITS])
            if parent in large:
                finer.setdefault(parent, {})[r["p"]] = r["count"]
        for parent, parts in finer.items():
            local = large[parent][1]
            for (_, p), (n, spots) in _cells_of({parent: parts}, {parent: set(local)}).items():
                cell = wanted.setdefault((parent[0], p), (n, {}))
                cell[1].update({here: local[rank] for here, rank in spots.items()})
    out: dict = {}
    for length in sorted({len(p) for _, p in small}):
        level = {k: v for k, v in small.items() if len(k[1]) == length}
        cell = keys.withColumn("p", F.substring("k", 1, length)).where(
            _inside(level, F.col("p")))
        position = F.row_number().over(Window.partitionBy("g", "p").orderBy("k"))
        at_cut = reduce(or_, [
            (F.col("g") == c) & (F.col("p") == p) & F.col("n").isin(*local)
            for (c, p), (_, local) in level.items()
        ])
        for r in cell.withColumn("n", position).where(at_cut).collect():
            out.setdefault(r["g"], {})[level[(r["g"], r["p"])][1][r["n"]]] = r["k"]
    return out


def stratified_split(df: DataFrame, seed: int = SEED, label: str = "label",
                     key: str = "account_id") -> DataFrame:
    """Add ``split`` (train / validation / test).

    Reads ``key`` and ``label`` twice in small jobs before the final pass, so hand in
    a stored or staged table.
    """
    order = hash_order(key, str(seed))
    cells = prefix_counts(df, label, order)
    quotas = split_quotas({c: sum(p.values()) for c, p in cells.items()})
    test_end = quotas["test"]
    held_end = {c: test_end[c] + quotas["validation"][c] for c in test_end}
    cuts = order_keys_at(
        df, label, order, cells, {c: {test_end[c], held_end[c]} for c in test_end}
    )
    side = F.lit("train")
    for c in test_end:
        side = F.when(
            F.col(label) == c,
            F.when(F.col("_order") <= cuts[c][test_end[c]], "test")
            .when(F.col("_order") <= cuts[c][held_end[c]], "validation")
            .otherwise("train"),
        ).otherwise(side)
    return df.withColumn("_order", order).withColumn("split", side).drop("_order")


def class_sample(df: DataFrame, per_class: int, seed: int = SEED, label: str = "label",
                 key: str = "account_id") -> DataFrame:
    """``min(per_class, available)`` rows of each class, without replacement.

    Reads ``key`` and ``label`` in small jobs first, like ``stratified_split``; an empty
    table gives an empty sample.
    """
    # one seed per class: seed + label
    salted = F.concat(
        (F.lit(seed) + F.col(label)).cast("string"), F.lit(":sample:"), F.col(key)
    )
    order = F.concat(F.md5(salted), F.lit(":"), F.col(key))
    cells = prefix_counts(df, label, order)
    ranks = {c: {min(per_class, sum(p.values()))} for c, p in cells.items()}
    cuts = order_keys_at(df, label, order, cells, ranks)
    inside = reduce(or_, [
        (F.col(label) == c) & (F.col("_order") <= k)
        for c, at in cuts.items() for k in at.values()
    ], F.lit(False))
    return df.withColumn("_order", order).where(inside).drop("_order")


def demo_accounts(test: DataFrame, per_class: int = DEMO_PER_CLASS,
                  seed: int = SEED) -> DataFrame:
    """Label-free sample of the test split."""
    demo = class_sample(test, per_class, seed).drop(*PRIVATE_COLUMNS)
    if "label" in demo.columns:
        raise AssertionError("A demo sample has no label column.")
    return demo
