"""Per-feature contributions of a boosted-tree score (path-dependent tree SHAP).

Lundberg et al., "Consistent Individualized Feature Attribution for Tree Ensembles",
2018.  Each leaf's share of every feature depends on a row only through which of the
path's at most ``depth`` features the row satisfies, so the shares are tabulated once
per leaf and looked up per Arrow batch.  The model's capacity bounds the tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class LeafTable:
    features: np.ndarray   # distinct features on the path
    above: np.ndarray      # a row passes feature j if above[j] < x <= upto[j]
    upto: np.ndarray
    shares: np.ndarray     # [2^d patterns of passed features, d features]
    expected: float        # the leaf's part of the average margin


def _shares(value: float, ratios: Sequence[float]) -> np.ndarray:
    """Shapley shares of one leaf for every pattern of passed features."""
    d = len(ratios)
    table = np.zeros((1 << d, d))
    for pattern in range(1 << d):
        passed = [(pattern >> j) & 1 for j in range(d)]
        for i in range(d):
            others = [j for j in range(d) if j != i]
            total = 0.0
            for size in range(d):
                weight = factorial(size) * factorial(d - size - 1) / factorial(d)
                for chosen in combinations(others, size):
                    term = weight
                    for j in others:
                        term *= passed[j] if j in chosen else ratios[j]
                    total += term
            table[pattern, i] = value * total * (passed[i] - ratios[i])
    return table


def leaf_tables(nodes: Sequence, tree_weights: dict[int, float],
                scale: float = 2.0) -> list[LeafTable]:
    """Tables for all leaves of a saved ensemble; ``scale`` turns margins to log-odds."""
    trees: dict[int, dict] = {}
    for row in nodes:
        trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]

    tables: list[LeafTable] = []

    def visit(tree: dict, node, weight: float, path: dict) -> None:
        if node["leftChild"] < 0:
            value = scale * weight * node["prediction"]
            names = sorted(path)
            ratios = [path[f][2] for f in names]
            tables.append(LeafTable(
                np.array(names, dtype=int),
                np.array([path[f][0] for f in names]),
                np.array([path[f][1] for f in names]),
                _shares(value, ratios),
                value * float(np.prod(ratios)),
            ))
            return
        feature = node["split"]["featureIndex"]
        cut = node["split"]["leftCategoriesOrThreshold"][0]
        above, upto, ratio = path.get(feature, (-np.inf, np.inf, 1.0))
        cover = node["impurityStats"][0]
        for child_id, bounds in (
            (node["leftChild"], (above, min(upto, cut))),
            (node["rightChild"], (max(above, cut), upto)),
        ):
            child = tree[child_id]
            share = child["impurityStats"][0] / cover
            visit(tree, child, weight, {**path, feature: (*bounds, ratio * share)})

    for tree_id, tree in sorted(trees.items()):
        visit(tree, tree[0], tree_weights[tree_id], {})
    return tables


def read_leaf_tables(spark: SparkSession, model_path: str) -> list[LeafTable]:
    """Leaf tables of a saved boosted model (rows <= rounds x 2^(depth + 1))."""
    nodes = spark.read.parquet(f"{model_path}/data").collect()
    weights = read_tree_weights(spark, model_path)
    return leaf_tables(nodes, weights)


def read_tree_weights(spark: SparkSession, model_path: str) -> dict[int, float]:
    rows = spark.read.parquet(f"{model_path}/treesMetadata").collect()
    return {r[0]: r[2] for r in rows}


def batch_explainer():
    """Function of (batch [rows, features], plain leaf tables) -> contributions.

    Defined inside, so that it travels with the plan and executors need no copy of
    this package.
    """

    def contributions(x, tables):
        n, width = x.shape
        out = np.zeros((width, n))
        columns = np.ascontiguousarray(x.T)
        picked = np.empty(n)
        for features, above, upto, shares in tables:
            pattern = np.zeros(n, dtype=np.intp)
            for bit, f in enumerate(features):
                inside = columns[f] <= upto[bit]
                if above[bit] > -np.inf:
                    inside &= columns[f] > above[bit]
                pattern += inside * (1 << bit)
            for j, f in enumerate(features):
                np.take(shares[j], pattern, out=picked, mode="clip")
                out[f] += picked
        return out.T

    return contributions


def plain(tables: Sequence[LeafTable]) -> list[tuple]:
    """Leaf tables as tuples of arrays (shares by feature), free of this package's classes."""
    return [(t.features, t.above, t.upto, np.ascontiguousarray(t.shares.T)) for t in tables]


def contributions(x: np.ndarray, tables: Sequence[LeafTable]) -> np.ndarray:
    """Contribution matrix of a batch, [rows, features], on the log-odds scale."""
    return batch_explainer()(x, plain(tables))


def expected_margin(tables: Sequence[LeafTable]) -> float:
    return float(sum(leaf.expected for leaf in tables))


def contribution_column(tables: Sequence[LeafTable],
                        columns: Sequence[str]) -> Column:
    """ARRAY<DOUBLE> of contributions in the order of ``columns``, by Arrow batch.

    NULL for a batch whose explanation fails: the scores survive without it.  The tables,
    bounded by the model's size, travel with the function.
    """
    held = plain(tables)
    batch_contributions = batch_explainer()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def explain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.column_stack([s.to_numpy(dtype=float) for s in batch])
            try:
                found = list(batch_contributions(x, held))
            except Exception:
                found = [None] * len(x)
            yield pd.Series(found)

    return explain(*[F.col(c) for c in columns])


def linear_contributions(columns: Sequence[str], coefficients: dict[str, float]) -> Column:
    """Contributions of a linear score: coefficient times transformed value."""
    return F.array(*[F.col(c) * F.lit(coefficients[c]) for c in columns])
