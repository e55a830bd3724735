"""Shapley values of boosted trees: what each feature adds to a row's margin, exact for the trees given how a sample runs through them.

A tree is a sum over its leaves. Along the path to a leaf each feature is one player: for a row, it
either lets the row pass (all its conditions on the path hold) or not; if the feature is left out,
the row passes by the share of the sample that does. The Shapley value of a product over players is
a weighted sum of the coefficients of a polynomial, so no subsets are listed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.panel import AT, ID
from . import modeling
from .features import Meta

#: Rows that are explained, drawn by least hash: the values are means over them.
SAMPLE = 4000

_TREE = re.compile(r"\s*Tree \d+ \(weight (\S+)\):")
_TEST = re.compile(r"( *)(If|Else) \(feature (\d+) (<=|>|in|not in) (.*)\)")
_LEAF = re.compile(r"( *)Predict: (\S+)")

Test = Callable[[np.ndarray], np.ndarray]


@dataclass
class Leaf:
    """A leaf's value, times the weight of its tree, and the tests on the way to it: column, and what passes."""

    value: float
    path: list[tuple[int, Test]]


def _test(sign: str, bound: str) -> Test:
    if sign in ("<=", ">"):
        limit = float(bound)
        return (lambda x: x <= limit) if sign == "<=" else (lambda x: x > limit)
    levels = [float(v) for v in bound.strip("{}").split(",") if v]
    return (lambda x: np.isin(x, levels)) if sign == "in" else (lambda x: ~np.isin(x, levels))


def leaves(text: str) -> list[list[Leaf]]:
    """The leaves of each tree, from the model's description."""
    trees: list[list[Leaf]] = []
    weight, path = 1.0, []
    for line in text.splitlines():
        if found := _TREE.match(line):
            weight, path = float(found[1]), []
            trees.append([])
        elif found := _TEST.match(line):
            depth, column = len(found[1]), int(found[3])
            path = [p for p in path if p[0] < depth] + [(depth, column, _test(found[4], found[5]))]
        elif found := _LEAF.match(line):
            trees[-1].append(Leaf(weight * float(found[2]), [(c, t) for d, c, t in path if d < len(found[1])]))
    return trees


def _weights(players: int) -> np.ndarray:
    """Share of the orders of all players in which `before` given ones, and no other, precede one: by number."""
    return np.array([math.factorial(t) * math.factorial(players - 1 - t) / math.factorial(players) for t in range(players)])


def values(trees: list[list[Leaf]], x: np.ndarray, owner: np.ndarray, features: int) -> np.ndarray:
    """Shapley values (rows x features) of the trees' sum at the rows of x; owner tells the feature of each column of x."""
    out = np.zeros((len(x), features))
    for tree in trees:
        for leaf in tree:
            passed: dict[int, np.ndarray] = {}
            left_out: dict[int, float] = {}
            reached = np.ones(len(x), bool)
            for column, test in leaf.path:
                own, ok = int(owner[column]), test(x[:, column])
                here = reached.sum()
                reached = reached & ok
                share = reached.sum() / here if here else 0.5
                left_out[own] = left_out.get(own, 1.0) * share
                passed[own] = passed.get(own, True) & ok
            players = list(passed)
            weight = _weights(len(players)) if players else ()
            for one in players:
                terms = [np.ones(len(x))]
                for other in players:
                    if other != one:
                        o = passed[other].astype(float)
                        z = left_out[other]
                        terms = [(terms[t] * z if t < len(terms) else 0) + (terms[t - 1] * o if t else 0) for t in range(len(terms) + 1)]
                out[:, one] += leaf.value * (passed[one] - left_out[one]) * sum(w * t for w, t in zip(weight, terms, strict=True))
    return out


def importance(model: PipelineModel, frame: DataFrame, meta: dict[str, Meta], sample: int = SAMPLE, seed: int = 42) -> dict[str, float]:
    """Mean absolute Shapley value of each feature, a number and its indicator being one, over a bounded sample of rows."""
    numeric, categorical = modeling.split_names(meta)
    some = frame.orderBy(F.xxhash64(ID, AT, F.lit(seed)), ID, AT).limit(sample)
    ready = PipelineModel(model.stages[:-1]).transform(modeling.tree_inputs(some, numeric, categorical))
    rows = ready.select(vector_to_array("inputs").alias("x")).toArrow().column("x")
    if not len(rows):
        return dict.fromkeys(meta, 0.0)
    names = [*numeric, *numeric, *categorical]
    place = {n: i for i, n in enumerate(meta)}
    found = values(leaves(model.stages[-1].toDebugString), np.array(rows.to_pylist()), np.array([place[n] for n in names]), len(meta))
    return dict(zip(meta, np.abs(found).mean(axis=0).tolist(), strict=True))
