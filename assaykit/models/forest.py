"""Forests with bootstrap weights from the row, out-of-bag votes, and the usual limits on growth.

All trees grow together. A pass sums (node, candidate feature, bin) statistics of as many open nodes as its width allows, so
many trees share one reading of the rows, and only those sums travel.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.models.hist_tree import MAX_BINS, MISSING, Binning, Tree, TreeEnsemble, _mix, fit_binning
from assaykit.operators import evaluate
from assaykit.operators.blocks import pack, sum_blocks
from assaykit.operators.sums import balanced, fan_out
from assaykit.table import c

SUM_WIDTH = 2_000_000
SLOTS = MAX_BINS + 1
CRITERIA = {"regression": ("squared_error", "friedman_mse", "poisson"), "classification": ("gini", "entropy", "log_loss")}
TREE_SEED = 7919


def bootstrap_weights(h: np.ndarray, seed: int, tree: int, rate: float) -> np.ndarray:
    """How often a row is drawn for a tree: Poisson with the given mean, by inverse, from the hash of the row."""
    terms = [math.exp(-rate)]
    while sum(terms) < 1 - 1e-12 and len(terms) < 60:
        terms.append(terms[-1] * rate / len(terms))
    return np.searchsorted(np.cumsum(terms), _mix(h, seed + TREE_SEED * tree)).astype(np.float64)


def candidates(seed: int, tree: int, path: int, d: int, m: int) -> np.ndarray:
    """The features a node may cut, drawn by its tree and its path from the root."""
    return np.sort(np.random.default_rng([seed, tree, path]).permutation(d)[:m])


def feature_number(max_features: str | int | float | None, d: int) -> int:
    if max_features in (None, "all"):
        return d
    if max_features == "sqrt":
        return max(1, int(math.sqrt(d)))
    if max_features == "log2":
        return max(1, int(math.log2(d)))
    return max(1, min(d, int(max_features) if isinstance(max_features, int) else int(max_features * d)))


def impurity(s: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity of statistics along the last axis: class weights, or weight, sum and sum of squares of the target."""
    if criterion in CRITERIA["regression"]:
        n = np.maximum(s[..., 0], 1e-300)
        mean = s[..., 1] / n
        if criterion == "poisson":  # up to a term that no cut changes
            return np.where(mean > 0, -mean * np.log(np.maximum(mean, 1e-300)), 0.0)
        return np.maximum(s[..., 2] / n - mean * mean, 0.0)
    share = s / np.maximum(s.sum(axis=-1, keepdims=True), 1e-300)
    if criterion == "gini":
        return 1.0 - (share * share).sum(axis=-1)
    return -(share * np.log2(np.maximum(share, 1e-300))).sum(axis=-1)


def weight_of(s: np.ndarray, criterion: str) -> np.ndarray:
    return s[..., 0] if criterion in CRITERIA["regression"] else s.sum(axis=-1)


def gains(left: np.ndarray, right: np.ndarray, criterion: str) -> np.ndarray:
    """Weighted fall of impurity of cuts into ``left`` and ``right``."""
    nl, nr = weight_of(left, criterion), weight_of(right, criterion)
    if criterion == "friedman_mse":
        gap = left[..., 1] / np.maximum(nl, 1e-300) - right[..., 1] / np.maximum(nr, 1e-300)
        return nl * nr / np.maximum(nl + nr, 1e-300) * gap * gap
    both = left + right
    return weight_of(both, criterion) * impurity(both, criterion) - nl * impurity(left, criterion) - nr * impurity(right, criterion)


def choose_cut(hist: np.ndarray, chosen: np.ndarray, edges: Sequence[Sequence[float]], criterion: str, min_leaf: float, draw: np.random.Generator | None):
    """(gain, feature, bin, statistics left of it) of the best cut, or of the best of one random cut a feature; None if there is none.

    Missing values go left. Gains that differ by rounding only keep the first feature and the lowest cut.
    """
    best = None
    for q, j in enumerate(chosen):
        whole = hist[q].sum(axis=0)
        known = np.cumsum(hist[q, : len(edges[j])], axis=0) + hist[q, MAX_BINS]
        if not len(known):
            continue
        rest = whole - known
        ok = (weight_of(known, criterion) >= max(min_leaf, 1e-9)) & (weight_of(rest, criterion) >= max(min_leaf, 1e-9))
        if draw is not None:
            there = np.flatnonzero(weight_of(hist[q, :MAX_BINS], criterion) > 0)
            u = draw.random()  # drawn also where nothing can be cut, so other features' cuts do not depend on it
            if len(there) < 2:
                continue
            at = there[0] + int(u * (there[-1] - there[0]))
            ok &= np.arange(len(known)) == at
        if not ok.any():
            continue
        gain = np.where(ok, gains(known, rest, criterion), -np.inf)
        top = float(gain.max())
        b = int(np.flatnonzero(gain >= top - 1e-9 * abs(top))[0])
        if best is None or gain[b] > best[0] + 1e-9 * abs(best[0]):
            best = float(gain[b]), int(j), b, known[b]
    return best


@dataclass(frozen=True)
class Forest(TreeEnsemble):
    """A forest that knows how its rows were drawn."""

    seed: int = 42
    draw_rate: float = 0.0  # 0: every tree has every row once
    criterion: str = "squared_error"
    impurities: tuple = ()

    def out_of_bag(self, df: DataFrame, row_id: str) -> DataFrame:
        """``df`` with ``oob_trees``, the trees that never drew the row, and their mean vote: ``oob_prediction`` and, for classes, ``oob_probability``.

        Rows that every tree drew have a null vote.
        """
        if self.draw_rate <= 0:
            raise ValueError("every tree has drawn every row: there is no out-of-bag vote without a bootstrap")
        model, features = self, self.binning.features

        kind = "double" if self.classes is None else "array<double>"

        @F.pandas_udf(f"trees int, vote {kind}")
        def votes(h: pd.Series, *cols: pd.Series) -> pd.DataFrame:
            bins = model.binning.codes(np.column_stack([x.to_numpy(dtype=float) for x in cols]))
            rows = h.to_numpy(np.int64)
            number, total = np.zeros(len(rows), np.int32), np.zeros((len(rows), len(model.base)))
            for t, (tree,) in enumerate(model.trees):
                free = bootstrap_weights(rows, model.seed, t, model.draw_rate) == 0
                number += free
                total[free] += np.asarray(tree.value, dtype=float)[tree.leaves(bins[free])].reshape(int(free.sum()), -1)
            mean = total / np.maximum(number, 1)[:, None]
            if model.classes is None:  # one number a row, not a list
                return pd.DataFrame({"trees": number, "vote": np.where(number > 0, mean[:, 0], np.nan)})
            return pd.DataFrame({"trees": number, "vote": [v if k else None for v, k in zip(mean, number)]})

        out = df.withColumn("_oob", votes(F.xxhash64(c(row_id)), *[c(f).cast("double") for f in features]))
        out = out.withColumn("oob_trees", F.col("_oob.trees"))
        if self.classes is None:
            return out.withColumn("oob_prediction", F.col("_oob.vote")).drop("_oob")
        at = F.array_position("oob_probability", F.array_max("oob_probability")).cast("int")
        out = out.withColumn("oob_probability", F.col("_oob.vote")).drop("_oob")
        return out.withColumn("oob_prediction", F.when(F.col("oob_probability").isNotNull(), F.element_at(F.array(*[F.lit(v) for v in self.classes]), at)))

    def oob_score(self, df: DataFrame, target: str, row_id: str) -> float | None:
        """R2, or the share of right classes, of the out-of-bag votes."""
        voted = self.out_of_bag(df, row_id).filter(F.col("oob_prediction").isNotNull() & c(target).isNotNull())
        if self.classes is None:
            return evaluate.regression_scores(voted, target, "oob_prediction").first()["r2"]
        return voted.agg(F.avg((c(target) == F.col("oob_prediction")).cast("double"))).first()[0]

    def nodes(self, spark) -> DataFrame:
        """One row a node: ids, cut, impurity, weight, gain and value."""
        rows = []
        for t, (tree,) in enumerate(self.trees):
            for i, f in enumerate(tree.feature):
                cut = float(self.binning.edges[f][tree.cut[i]]) if f >= 0 else None
                value = [float(v) for v in np.atleast_1d(np.asarray(tree.value[i], dtype=float))]
                rows.append((
                    t, i, self.binning.features[f] if f >= 0 else None, cut, tree.left[i], tree.right[i], float(self.impurities[t][i]), float(tree.count[i]),
                    float(tree.gain[i]), value,
                ))
        return spark.createDataFrame(
            rows, "tree int, node int, feature string, cut double, left int, right int, impurity double, weight double, gain double, value array<double>"
        )


def grow_forest(
    df: DataFrame, features: Sequence[str], target: str, row_id: str, trees: int = 100, criterion: str | None = None, splitter: str = "best",
    max_depth: int | None = None, min_split: float = 2, min_leaf: float = 1, max_features: str | int | float | None = "sqrt", max_leaf_nodes: int | None = None,
    min_decrease: float = 0.0, bootstrap: bool = True, max_samples: float | None = None, bins: int = 64, seed: int = 42, classes: Sequence | None = None,
) -> Forest:
    """A forest over binned features; ``trees=1, bootstrap=False, max_features=None`` is a decision tree.

    ``splitter="random"`` draws one cut a candidate feature between the node's lowest and highest bin (extremely randomised
    trees). With ``bootstrap`` a row weighs as often as it is drawn, in the mean ``max_samples`` times. ``max_leaf_nodes``
    keeps the cuts with the greatest gain, the greatest reachable first. Without ``max_depth`` trees grow to 20 levels. Rows
    without a target are left out; missing features go left of every cut.
    """
    task = "regression" if classes is None else "classification"
    criterion = criterion or CRITERIA[task][0]
    if criterion not in CRITERIA[task] or splitter not in ("best", "random"):
        raise ValueError(f"criterion must be one of {CRITERIA[task]} and splitter best or random")
    d, depth_limit = len(features), 20 if max_depth is None else max_depth
    m = feature_number(max_features, d)
    stats = 3 if classes is None else len(classes)
    rate = (max_samples or 1.0) if bootstrap else 0.0
    binning = fit_binning(df, features, bins)
    base = df.select(F.xxhash64(c(row_id)).alias("h"), c(target).cast("double").alias("y"), *[c(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    labels = None if classes is None else np.asarray([float(v) for v in classes])

    def make(columns):
        x = np.column_stack([columns[f"x{i}"] for i in range(d)]).astype(np.float64)
        y = columns["y"].astype(np.float64)
        return {"h": columns["h"].astype(np.int64), "y": y if labels is None else np.searchsorted(labels, y).astype(np.float64), "codes": binning.codes(x)}

    blocks = pack(balanced(base.filter("y is not null")), make, ["h", "y", "codes"]).persist()
    fan = fan_out(blocks)
    grown = [Tree() for _ in range(trees)]
    impurities: list[list[float]] = [[0.0] for _ in range(trees)]
    path = {(t, 0): 1 for t in range(trees)}
    open_nodes = [(t, 0) for t in range(trees)]

    def read(n, parts):
        y = np.frombuffer(parts["y"], np.float64)
        code = np.frombuffer(parts["codes"], np.uint8).reshape(n, d)
        return np.frombuffer(parts["h"], np.int64), y, np.where(code == MISSING, MAX_BINS, code).astype(np.int64), code

    def settle(t, node, s):
        tree, w = grown[t], float(weight_of(s, criterion))
        tree.count[node] = w
        tree.value[node] = (s[1] / w if w else 0.0) if classes is None else list(s / w) if w else [0.0] * stats
        while len(impurities[t]) <= node:
            impurities[t].append(0.0)
        shown = "squared_error" if criterion in ("friedman_mse",) else criterion
        impurities[t][node] = float(impurity(s, shown))

    try:
        per_pass = max(1, SUM_WIDTH // (m * SLOTS * stats))
        for depth in range(depth_limit + (depth_limit == 0)):
            after = []
            for start in range(0, len(open_nodes), per_pass):
                batch = open_nodes[start : start + per_pass]
                chosen = {s: candidates(seed, s[0], path[s], d, m) for s in batch}
                slots: dict[int, dict[int, int]] = {}
                for i, (t, node) in enumerate(batch):
                    slots.setdefault(t, {})[node] = i
                pick = np.array([chosen[s] for s in batch])
                width = len(batch) * m * SLOTS * stats

                def add(n, parts, slots=slots, pick=pick, width=width):
                    h, y, slot_code, code = read(n, parts)
                    out = np.zeros((len(batch) * m * SLOTS, stats))
                    for t, mine in slots.items():
                        # nodes of a tree are neighbours in the batch, so a tree's rows are counted among its own sums only
                        first = min(mine.values())
                        own = out[first * m * SLOTS : (max(mine.values()) + 1) * m * SLOTS]
                        table = np.full(len(grown[t].feature), -1)
                        table[list(mine)] = list(mine.values())
                        at = table[grown[t].leaves(code)]
                        w = bootstrap_weights(h, seed, t, rate) if rate else np.ones(n)
                        rows = np.flatnonzero((at >= 0) & (w > 0))
                        if not len(rows):
                            continue
                        place, weight, target_ = at[rows], w[rows], y[rows]
                        for q in range(m):
                            flat = ((place - first) * m + q) * SLOTS + slot_code[rows, pick[place, q]]
                            if classes is None:
                                for k, v in enumerate((weight, weight * target_, weight * target_ * target_)):
                                    own[:, k] += np.bincount(flat, weights=v, minlength=len(own))
                            else:
                                flat = flat * stats + target_.astype(np.int64)
                                own += np.bincount(flat, weights=weight, minlength=own.size).reshape(own.shape)
                    return out.ravel()

                hist = sum_blocks(blocks, add, width, fan).reshape(len(batch), m, SLOTS, stats)
                if classes is None:
                    hist[..., 0] = np.rint(hist[..., 0])  # weights are whole numbers
                else:
                    hist = np.rint(hist)
                for i, (t, node) in enumerate(batch):
                    whole = hist[i, 0].sum(axis=0)
                    settle(t, node, whole)
                    size = float(weight_of(whole, criterion))
                    flat_enough = impurities[t][node] <= 1e-12 if classes is not None else whole[2] * size - whole[1] ** 2 <= 1e-12 * abs(whole[2]) * size
                    if size < min_split or flat_enough or depth_limit == 0:
                        continue
                    draw = np.random.default_rng([seed, t, path[(t, node)], 1]) if splitter == "random" else None
                    best = choose_cut(hist[i], chosen[(t, node)], binning.edges, criterion, min_leaf, draw)
                    if best is None or best[0] <= 1e-12 * size or best[0] < min_decrease * grown[t].count[0]:
                        continue
                    kids = grown[t].split(node, best[1], best[2], True, best[0])
                    for side, kid in enumerate(kids):
                        settle(t, kid, best[3] if side == 0 else whole - best[3])
                        path[(t, kid)] = 2 * path[(t, node)] + side
                        after.append((t, kid))
            open_nodes = after
            if not open_nodes:
                break
    finally:
        blocks.unpersist()
    if max_leaf_nodes is not None:
        for tree in grown:
            keep_best_leaves(tree, max_leaf_nodes)
    outputs = 1 if classes is None else len(classes)
    return Forest(
        binning, [[t] for t in grown], "forest", np.zeros(outputs), 1.0, tuple(classes) if classes is not None else None, (), seed, rate, criterion, tuple(map(tuple, impurities)),
    )


def keep_best_leaves(tree: Tree, most: int) -> None:
    """Turn back cuts so that at most ``most`` leaves are left; of the reachable cuts the one with the greatest gain comes first."""
    queue = [(-tree.gain[0], 0)] if tree.feature[0] >= 0 else []
    kept: set[int] = set()
    while queue and len(kept) + 1 < most:
        _, node = heapq.heappop(queue)
        kept.add(node)
        for kid in (tree.left[node], tree.right[node]):
            if tree.feature[kid] >= 0:
                heapq.heappush(queue, (-tree.gain[kid], kid))
    for node in range(len(tree.feature)):
        if tree.feature[node] >= 0 and node not in kept:
            tree.feature[node], tree.left[node], tree.right[node], tree.gain[node] = -1, -1, -1, 0.0


def decision_tree(df, features, target, row_id, classes=None, **kw) -> Forest:
    return grow_forest(df, features, target, row_id, **({"trees": 1, "bootstrap": False, "max_features": None, "classes": classes} | kw))


def random_forest(df, features, target, row_id, classes=None, **kw) -> Forest:
    return grow_forest(df, features, target, row_id, **({"classes": classes} | kw))


def extra_trees(df, features, target, row_id, classes=None, **kw) -> Forest:
    """Random cuts of every row once; ``bootstrap=True`` draws rows as a forest does, so that rows have out-of-bag votes."""
    return grow_forest(df, features, target, row_id, **({"splitter": "random", "bootstrap": False, "classes": classes} | kw))
