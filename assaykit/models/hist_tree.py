"""Level-wise histogram trees: second-order boosting, random-cut forests and robust boosting.

Rows are binned once into one byte per feature and kept in blocks of arrays with their running scores. Growing one level
is one pass, or several where its sums are wide: every task adds its rows to (node, feature, bin) sums and only those sums
travel. Of two siblings the smaller is read and the larger follows from their parent. Scores move on by a tree as the next
tree's first pass reads the blocks. Bin edges weigh rows alike: at the first tree all curvatures are equal.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.blocks import each, pack, sum_blocks, update
from assaykit.operators.split import class_counts
from assaykit.operators.sums import balanced, fan_out
from assaykit.table import c, cut_lineage

MISSING = 255
MAX_BINS = 64
SUM_WIDTH = 2_000_000
# sums of one level that the driver keeps for the next; wider levels read both siblings
KEPT_SUMS = 20_000_000
# rounds between reliable checkpoints of the scores
FOLD_EVERY = 20


@dataclass
class Tree:
    """Arrays by node; feature -1 marks a leaf. ``bins <= cut`` goes left, missing goes ``default_left``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    default_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    count: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, default_left: bool, gain: float) -> tuple[int, int]:
        kids = []
        for _ in range(2):
            for name, blank in (("feature", -1), ("cut", 0), ("default_left", True), ("left", -1), ("right", -1), ("value", 0.0), ("gain", 0.0), ("count", 0.0)):
                getattr(self, name).append(blank)
            kids.append(len(self.feature) - 1)
        self.feature[node], self.cut[node], self.default_left[node], self.gain[node] = feature, cut, default_left, gain
        self.left[node], self.right[node] = kids
        return kids[0], kids[1]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), dtype=np.int64)
        f, cut, dl = np.array(self.feature), np.array(self.cut), np.array(self.default_left)
        left, right = np.array(self.left), np.array(self.right)
        while True:
            rows = np.flatnonzero(f[node] >= 0)
            if not len(rows):
                return node
            at = node[rows]
            b = bins[rows, f[at]]
            goes = np.where(b == MISSING, dl[at], b <= cut[at])
            node[rows] = np.where(goes, left[at], right[at])


@dataclass(frozen=True)
class Binning:
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(np.array(e), x[:, j], side="left")
            out[np.isnan(x[:, j]), j] = MISSING
        return out


def fit_binning(df: DataFrame, features: Sequence[str], bins: int = 32) -> Binning:
    if not 2 <= bins <= MAX_BINS:
        raise ValueError(f"bins must be 2..{MAX_BINS}")
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(c(f).cast("double"), probs, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return Binning(tuple(features), tuple(tuple(sorted(set(row[f"e{i}"] or []))) for i in range(len(features))))


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    """Uniform [0, 1) per row and seed from the row hash (splitmix finaliser)."""
    z = (h.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53


def _poisson1(u: np.ndarray) -> np.ndarray:
    """Bootstrap multiplicity: Poisson(1) by inverse."""
    table = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(table, u).astype(float)


@dataclass(frozen=True)
class TreeEnsemble:
    binning: Binning
    trees: list
    kind: str
    base: np.ndarray
    rate: float
    classes: tuple | None
    history: tuple[float, ...] = ()

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self.binning.codes(x)
        out = np.tile(self.base, (len(x), 1)).astype(float)
        for group in self.trees:
            for k, tree in enumerate(group):
                values = np.asarray(tree.value, dtype=float)
                if self.kind == "forest":
                    out += values[tree.leaves(bins)].reshape(len(x), -1) / len(self.trees)
                else:
                    out[:, k] += self.rate * values[tree.leaves(bins)]
        return out

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """``prediction`` and, for classes, ``probability`` (array in class order)."""
        from pyspark.sql.functions import pandas_udf

        model = self
        columns = [c(f).cast("double") for f in self.binning.features]
        if self.classes is None:  # one number a row, not a list

            @pandas_udf("double")
            def value(*cols: pd.Series) -> pd.Series:
                return pd.Series(model.raw(np.column_stack([col.to_numpy(dtype=float) for col in cols]))[:, 0])

            return df.withColumn(output, value(*columns))

        @pandas_udf("array<double>")
        def score(*cols: pd.Series) -> pd.Series:
            return pd.Series(list(model.probabilities(np.column_stack([col.to_numpy(dtype=float) for col in cols]))))

        out = df.withColumn("probability", score(*columns))
        at = F.array_position("probability", F.array_max("probability")).cast("int")
        return out.withColumn(output, F.element_at(F.array(*[F.lit(v) for v in self.classes]), at))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if self.classes is None or self.kind == "forest":
            return raw
        if raw.shape[1] == 1:
            p = 1.0 / (1.0 + np.exp(-np.clip(raw[:, 0], -500, 500)))
            return np.column_stack([1 - p, p])
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def importance(self, spark, kind: str = "gain") -> DataFrame:
        """Mean gain per split, or number of splits (``weight``), as shares."""
        d = len(self.binning.features)
        gain, weight = np.zeros(d), np.zeros(d)
        for group in self.trees:
            for t in group:
                for f, g in zip(t.feature, t.gain):
                    if f >= 0:
                        gain[f] += g
                        weight[f] += 1
        value = weight if kind == "weight" else np.divide(gain, weight, out=np.zeros(d), where=weight > 0)
        total = value.sum() or 1.0
        rows = [(n, float(v / total)) for n, v in zip(self.binning.features, value)]
        return spark.createDataFrame(rows, "feature string, importance double")

    def structure(self, spark) -> DataFrame:
        """One row per node of every tree."""
        rows = []
        for r, group in enumerate(self.trees):
            for k, t in enumerate(group):
                for i in range(len(t.feature)):
                    f = t.feature[i]
                    e = self.binning.edges[f] if f >= 0 else ()
                    cut = float(e[t.cut[i]]) if f >= 0 and t.cut[i] < len(e) else None
                    rows.append((r, k, i, self.binning.features[f] if f >= 0 else None, cut, t.left[i], t.right[i], float(t.gain[i]), float(t.count[i])))
        return spark.createDataFrame(
            rows, "round int, output int, node int, feature string, cut double, left int, right int, gain double, count double"
        )


def _slopes(kind: str, y: np.ndarray, score: np.ndarray, quantile: float, delta: float):
    """Slope, curvature and loss per output."""
    if kind == "squared_error":
        g = score[:, 0] - y
        return g[:, None], np.ones((len(y), 1)), 0.5 * g * g
    if kind == "absolute_error":
        r = score[:, 0] - y
        return np.sign(r)[:, None], np.ones((len(y), 1)), np.abs(r)
    if kind == "huber":
        r = score[:, 0] - y
        return np.clip(r, -delta, delta)[:, None], np.ones((len(y), 1)), np.where(np.abs(r) <= delta, 0.5 * r * r, delta * np.abs(r) - 0.5 * delta**2)
    if kind == "quantile":
        r = y - score[:, 0]
        return np.where(r > 0, -quantile, 1 - quantile)[:, None], np.ones((len(y), 1)), np.where(r > 0, quantile * r, (quantile - 1) * r)
    if kind == "exponential":
        t = 2 * y - 1
        e = np.exp(-np.clip(t * score[:, 0], -50, 50))
        return (-t * e)[:, None], e[:, None], e
    if score.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-np.clip(score[:, 0], -500, 500)))
        return (p - y)[:, None], np.maximum(p * (1 - p), 1e-16)[:, None], -np.log(np.where(y > 0.5, p, 1 - p) + 1e-300)
    e = np.exp(score - score.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    hot = np.zeros_like(p)
    hot[np.arange(len(y)), y.astype(int)] = 1.0
    return p - hot, np.maximum(2 * p * (1 - p), 1e-16), -np.log(p[np.arange(len(y)), y.astype(int)] + 1e-300)


def boost(
    df: DataFrame, features: Sequence[str], target: str, row_id: str, loss: str = "squared_error", rounds: int = 100, rate: float = 0.3,
    max_depth: int = 6, subsample: float = 1.0, colsample: float = 1.0, l1: float = 0.0, l2: float = 1.0, min_child: float = 1.0,
    gamma: float = 0.0, bins: int = 32, quantile: float = 0.9, seed: int = 42, classes: Sequence | None = None, binning: Binning | None = None,
) -> TreeEnsemble:
    """Second-order boosting. Missing values have their own bin, tried on both sides of every cut.

    Several fits on one table can share the ``binning`` of its features (``fit_binning``).

    The slopes of the absolute and the quantile loss say only on which side of the score a target lies, so with these a
    finished tree gets the median (or quantile) of the residuals in each leaf as its values, in one more pass.
    """
    if classes is not None and list(classes) != list(range(len(classes))):
        raise ValueError("class labels have to be 0..K-1")
    outputs = 1 if classes is None or len(classes) == 2 else len(classes)
    binning = binning or fit_binning(df, features, bins)
    if binning.features != tuple(features):
        raise ValueError("the binning is one of other features")
    d = len(features)
    base, delta = np.zeros(outputs), 1.0
    # only a subsample asks for the rows' hashes
    rows = df.select(
        (F.xxhash64(c(row_id)) if subsample < 1 else F.lit(0).cast("long")).alias("h"), c(target).cast("double").alias("y"), *[c(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    ).filter("y is not null")
    if classes is None:
        share = quantile if loss == "quantile" else 0.5
        start = F.avg("y") if loss == "squared_error" else F.percentile_approx("y", share, 10_000)
        row = rows.agg(start.alias("m"), F.stddev_pop("y").alias("s")).first()
        base, delta = np.array([row["m"]]), 1.35 * (row["s"] or 1.0)

    def make(columns):
        x = np.column_stack([columns[f"x{i}"] for i in range(d)]).astype(np.float64)
        return {
            "h": columns["h"].astype(np.int64), "y": columns["y"].astype(np.float64), "codes": binning.codes(x),
            "score": np.tile(base.astype(np.float64), (len(x), 1)),
        }

    blocks = pack(balanced(rows), make, ["h", "y", "codes", "score"]).persist()
    fan = fan_out(blocks)
    trees: list[list[Tree]] = []
    history, held = [], [blocks]
    width = MAX_BINS + 1
    rng = np.random.default_rng(seed)

    def keep_of(h: np.ndarray, step: int) -> np.ndarray:
        return np.ones(len(h)) if subsample >= 1 else (_mix(h, seed + step) < subsample).astype(float)

    try:
        for step in range(rounds):
            group = [Tree() for _ in range(outputs)]
            chosen = [np.sort(rng.permutation(d)[: max(1, math.ceil(colsample * d))]) for _ in range(outputs)]
            open_nodes = [(k, 0) for k in range(outputs)]
            known: dict[tuple[int, int], np.ndarray] = {}  # sums of open nodes that follow from their parent and sibling
            for depth in range(max_depth):
                if not open_nodes:
                    break
                asked = [s for s in open_nodes if s not in known]
                per_pass = max(1, SUM_WIDTH // (d * width * 3))
                for begin in range(0, len(asked), per_pass):
                    part = asked[begin : begin + per_pass]
                    sums = _level_sums(blocks, group, part, chosen, d, outputs, loss, quantile, delta, keep_of, step, fan)
                    if depth == 0 and begin == 0:
                        history.append(float(sums[-2] / sums[-1]))
                    for s, hist in zip(part, sums[:-2].reshape(len(part), d, width, 3)):
                        hist[..., 2] = np.rint(hist[..., 2])  # the library's sums pass through a mean; counts are whole numbers
                        known[s] = hist
                for s, (parent, sibling) in list(_siblings(open_nodes, known).items()):
                    known[s] = parent - known[sibling]
                after, parents = [], {}
                for k, n in open_nodes:
                    tree, hist = group[k], known[k, n]
                    G, H, N = hist[chosen[k][0]].sum(axis=0)
                    tree.value[n], tree.count[n] = _leaf(G, H, l1, l2), float(N)
                    best = _best_cut(hist, chosen[k], G, H, N, binning, l1, l2, min_child, gamma)
                    if best is not None:
                        # both children are known from the cut, so the last level needs no pass of its own
                        cut, (gl, hl, nl) = best
                        kids = tree.split(n, *cut)
                        for kid, (g, h, m) in zip(kids, ((gl, hl, nl), (G - gl, H - hl, N - nl))):
                            tree.value[kid], tree.count[kid] = _leaf(g, h, l1, l2), float(m)
                            after.append((k, kid))
                        parents[k, n] = (kids, hist)
                open_nodes = after
                # the sums of the smaller child are read, those of the larger one are what is left of the parent's
                known = {}
                if len(parents) * d * width * 3 <= KEPT_SUMS:
                    for (k, _), (kids, hist) in parents.items():
                        small, large = sorted(kids, key=lambda x: group[k].count[x])
                        known[k, large] = (hist, (k, small))
            if loss in ("absolute_error", "quantile"):
                _refill(blocks, group[0], d, 0.5 if loss == "absolute_error" else quantile, subsample, seed + step)
            trees.append(group)
            if step < rounds - 1:
                blocks = _next_scores(blocks, group, rate, d, outputs)
                if (step + 1) % FOLD_EVERY == 0:
                    blocks = cut_lineage(blocks)
                blocks = blocks.persist()  # filled by the first pass of the next round
                held.append(blocks)
                while len(held) > 2:
                    held.pop(0).unpersist()
    finally:
        for one in held:
            one.unpersist()
    return TreeEnsemble(binning, trees, "boost", base, rate, tuple(classes) if classes is not None else None, tuple(history))


def _siblings(open_nodes: list, known: dict) -> dict:
    """Open nodes whose sums are still to be taken from (sums of the parent, sibling)."""
    return {s: known[s] for s in open_nodes if isinstance(known[s], tuple)}


def _arrays(n: int, parts: dict, d: int, outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.frombuffer(parts["h"], np.int64), np.frombuffer(parts["y"], np.float64), np.frombuffer(parts["codes"], np.uint8).reshape(n, d),
        np.frombuffer(parts["score"], np.float64).reshape(n, outputs),
    )


def _level_sums(blocks, group, nodes, chosen, d, outputs, loss, quantile, delta, keep_of, step, fan) -> np.ndarray:
    """Sums of slope, curvature and rows by (node, feature, bin), then the summed loss and the number of rows."""
    width = MAX_BINS + 1

    def add(n, parts):
        h, y, code, score = _arrays(n, parts, d, outputs)
        g, curve, value = _slopes(loss, y, score, quantile, delta)
        keep = keep_of(h, step)
        out = np.zeros((len(nodes), d, width, 3))
        slot_code = np.where(code == MISSING, MAX_BINS, code).astype(np.int64)
        for k, tree in enumerate(group):
            mine = [(i, node) for i, (kk, node) in enumerate(nodes) if kk == k]
            if not mine:
                continue
            table = np.full(len(tree.feature), -1)
            for i, node in mine:
                table[node] = i
            at = table[tree.leaves(code)]
            live = np.flatnonzero(at >= 0)
            parts_ = [w[live] for w in (g[:, k] * keep, curve[:, k] * keep, keep)]
            for j in chosen[k]:
                flat = at[live] * width + slot_code[live, j]
                for s, weight in enumerate(parts_):
                    out[:, j, :, s] += np.bincount(flat, weights=weight, minlength=len(nodes) * width).reshape(len(nodes), width)
        return np.concatenate([out.ravel(), [value.sum(), float(n)]])

    return sum_blocks(blocks, add, len(nodes) * d * width * 3 + 2, fan)


def _refill(blocks: DataFrame, tree: Tree, d: int, share: float, subsample: float, seed: int) -> None:
    """Set each leaf to the ``share`` quantile of its residuals, within 1e-5 in rank; one row a leaf comes back."""

    def residuals(batches):
        for batch in batches:
            for n, parts in each(batch):
                h, y, code, score = _arrays(n, parts, d, 1)
                keep = slice(None) if subsample >= 1 else _mix(h, seed) < subsample
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaves(code)[keep].astype(np.int32)), pa.array((y - score[:, 0])[keep])], ["leaf", "r"])

    rows = blocks.mapInArrow(residuals, "leaf int, r double").groupBy("leaf").agg(F.percentile_approx("r", share, 100_000).alias("v")).collect()
    for r in rows:
        tree.value[r["leaf"]] = r["v"]


def _next_scores(blocks: DataFrame, group: list, rate: float, d: int, outputs: int) -> DataFrame:
    """Move a finished group of trees into the running scores."""

    def change(n, parts):
        _, _, code, score = _arrays(n, parts, d, outputs)
        out = score.copy()
        for k, tree in enumerate(group):
            out[:, k] += rate * np.asarray(tree.value)[tree.leaves(code)]
        return {"score": out}

    return update(blocks, change)


def _leaf(g: float, h: float, l1: float, l2: float) -> float:
    return -math.copysign(max(abs(g) - l1, 0.0), g) / (h + l2) if h + l2 > 0 else 0.0


def _best_cut(hist, chosen, G, H, N, binning, l1, l2, min_child, gamma):
    def strength(g, h):
        t = np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)
        return t * t / np.maximum(h + l2, 1e-300)

    parent = strength(np.array(G), np.array(H))
    best = None
    for j in chosen:
        n_edges = len(binning.edges[j])
        if n_edges == 0:
            continue
        known = np.cumsum(hist[j, :MAX_BINS], axis=0)[:n_edges]
        missing = hist[j, MAX_BINS]
        for default_left in ((True, False) if missing[2] > 0 else (True,)):
            left = known + (missing if default_left else 0.0)
            gl, hl, nl = left[:, 0], left[:, 1], left[:, 2]
            gr, hr, nr = G - gl, H - hl, N - nl
            ok = (hl >= min_child) & (hr >= min_child) & (nl > 0) & (nr > 0)
            gain = np.where(ok, 0.5 * (strength(gl, hl) + strength(gr, hr) - parent) - gamma, -np.inf)
            b = int(gain.argmax())
            if gain[b] > 1e-12 and (best is None or gain[b] > best[0][3]):
                best = (int(j), b, default_left, float(gain[b])), (gl[b], hl[b], nl[b])
    return best


def random_cut_forest(
    df: DataFrame, features: Sequence[str], target: str, row_id: str, trees: int = 100, max_depth: int = 8, max_features: int | None = None,
    min_split: int = 2, min_leaf: int = 1, bins: int = 64, bootstrap: bool = False, seed: int = 42, classes: Sequence | None = None,
) -> TreeEnsemble:
    """Extremely randomised trees: one random cut per candidate feature, the best of them is kept.

    All trees grow together, level by level; a pass sums left and right statistics of the drawn cuts only.
    """
    d = len(features)
    stats = 3 if classes is None else len(classes)
    binning = fit_binning(df, features, bins)
    rows = df.select(
        (F.xxhash64(c(row_id)) if bootstrap else F.lit(0).cast("long")).alias("h"), c(target).cast("double").alias("y"),
        *[c(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
    ).filter("y is not null")

    def make(columns):
        x = np.column_stack([columns[f"x{i}"] for i in range(d)]).astype(np.float64)
        return {"h": columns["h"].astype(np.int64), "y": columns["y"].astype(np.float64), "codes": binning.codes(x)}

    blocks = pack(balanced(rows), make, ["h", "y", "codes"]).persist()
    fan = fan_out(blocks)
    m = max_features or (d if classes is None else max(1, int(math.sqrt(d))))
    forest = [Tree() for _ in range(trees)]
    spans = {(t, 0): [(0, max(0, len(e) - 1)) for e in binning.edges] for t in range(trees)}
    path = {(t, 0): 1 for t in range(trees)}
    open_nodes = [(t, 0) for t in range(trees)]

    def statistics(y):
        if classes is None:
            return np.column_stack([np.ones(len(y)), y, y * y])
        hot = np.zeros((len(y), stats))
        for k, v in enumerate(classes):
            hot[:, k] = y == float(v)
        return hot

    try:
        for depth in range(max_depth):
            next_open = []
            per_pass = max(1, SUM_WIDTH // ((m + 1) * stats))
            for start in range(0, len(open_nodes), per_pass):
                batch = open_nodes[start : start + per_pass]
                cuts = {}
                for s in batch:
                    # drawn per tree and path, so no node's cuts depend on what other nodes did
                    rng = np.random.default_rng([seed, s[0], path[s]])
                    movable = [j for j in rng.permutation(d) if spans[s][j][1] >= spans[s][j][0] and binning.edges[j]][:m]
                    cuts[s] = [(int(j), int(rng.integers(spans[s][j][0], spans[s][j][1] + 1))) for j in movable]
                index = {s: i for i, s in enumerate(batch)}

                def add(n, parts, batch=batch, cuts=cuts, index=index):
                    y = np.frombuffer(parts["y"], np.float64)
                    code = np.frombuffer(parts["codes"], np.uint8).reshape(n, d)
                    base = statistics(y)
                    out = np.zeros((len(batch), m + 1, stats))
                    for t in sorted({s[0] for s in batch}):
                        mine = [(i, node) for (tt, node), i in index.items() if tt == t]
                        # nodes of a tree are neighbours in the batch; (feature, bin) of every node's cuts, feature -1 for none
                        first, last = mine[0][0], mine[-1][0]
                        place = np.full(len(forest[t].feature), -1)
                        cut = np.full((last - first + 1, m, 2), -1)
                        for i, node in mine:
                            place[node] = i - first
                            for q, pair in enumerate(cuts[(t, node)]):
                                cut[i - first, q] = pair
                        at = place[forest[t].leaves(code)]
                        live = np.flatnonzero(at >= 0)
                        at, w = at[live], base[live]
                        if bootstrap:
                            w = w * _poisson1(_mix(np.frombuffer(parts["h"], np.int64)[live], seed + 7919 * t))[:, None]
                        for q in range(m + 1):
                            if q < m:
                                feature, bin_ = cut[at, q, 0], cut[at, q, 1]
                                col = code[live, feature]
                                side = np.flatnonzero((feature >= 0) & ((col <= bin_) | (col == MISSING)))
                            else:
                                side = slice(None)
                            for k in range(stats):
                                out[first : last + 1, q, k] += np.bincount(at[side], weights=w[side, k], minlength=last - first + 1)
                    return out.ravel()

                sums = sum_blocks(blocks, add, len(batch) * (m + 1) * stats, fan).reshape(len(batch), m + 1, stats)
                # the library's sums pass through a mean; counts are whole numbers
                counts = slice(0, 1) if classes is None else slice(None)
                sums[..., counts] = np.rint(sums[..., counts])
                for s, i in index.items():
                    t, n = s
                    tree, total = forest[t], sums[i, m]
                    size = _settle(tree, n, total, classes)
                    whole = _impurity(total, classes)
                    if size < min_split or whole <= 1e-9 * (1.0 if classes is not None else 1.0 + (total[1] / size) ** 2):
                        continue
                    best = None
                    for q, (j, b) in enumerate(cuts[s]):
                        left, right = sums[i, q], total - sums[i, q]
                        nl = left[0] if classes is None else left.sum()
                        if nl < min_leaf or size - nl < min_leaf:
                            continue
                        gain = whole * size - _impurity(left, classes) * nl - _impurity(right, classes) * (size - nl)
                        if best is None or gain > best[3] + 1e-6 * whole * size:
                            best = (j, b, True, float(gain), q)
                    if best is not None:
                        kids = tree.split(n, *best[:4])
                        for side, kid in enumerate(kids):
                            _settle(tree, kid, sums[i, best[4]] if side == 0 else total - sums[i, best[4]], classes)
                            span = list(spans[s])
                            lo, hi = span[best[0]]
                            span[best[0]] = (lo, best[1] - 1) if side == 0 else (best[1] + 1, hi)
                            spans[(t, kid)] = span
                            path[(t, kid)] = 2 * path[s] + side
                            next_open.append((t, kid))
            open_nodes = next_open
            if not open_nodes:
                break
    finally:
        blocks.unpersist()
    outputs = 1 if classes is None else len(classes)
    for t in forest:
        t.value = [v if classes is None else (v if isinstance(v, list) else [0.0] * outputs) for v in t.value]
    return TreeEnsemble(binning, [[t] for t in forest], "forest", np.zeros(outputs), 1.0, tuple(classes) if classes is not None else None)


def _settle(tree: Tree, node: int, total: np.ndarray, classes) -> float:
    """Write size and value of a node from its statistics; returns the size."""
    size = total[0] if classes is None else total.sum()
    tree.count[node] = float(size)
    if classes is None:
        tree.value[node] = total[1] / size if size else 0.0
    else:
        tree.value[node] = list(total / size) if size else [0.0] * len(total)
    return float(size)


def _impurity(s: np.ndarray, classes) -> float:
    if classes is None:
        return float(s[2] / s[0] - (s[1] / s[0]) ** 2) if s[0] > 0 else 0.0
    n = s.sum()
    return float(1.0 - ((s / n) ** 2).sum()) if n > 0 else 0.0


def xgb_regression(df, features, target, row_id, **kw) -> TreeEnsemble:
    return boost(df, features, target, row_id, **kw)


def xgb_classification(df, features, target, row_id, **kw) -> TreeEnsemble:
    """Labels must be the codes 0..K-1; two classes use the logistic loss, more use softmax."""
    found = sorted(int(k) for k in class_counts(df, target))
    return boost(df, features, target, row_id, loss="log_loss", classes=found, **kw)


def gradient_boosting_regression(df, features, target, row_id, loss="squared_error", rate=0.1, max_depth=3, **kw) -> TreeEnsemble:
    return boost(df, features, target, row_id, loss=loss, rate=rate, max_depth=max_depth, l2=0.0, min_child=1e-6, **kw)


def gradient_boosting_classification(df, features, target, row_id, loss="log_loss", rate=0.1, max_depth=3, **kw) -> TreeEnsemble:
    found = sorted(int(k) for k in class_counts(df, target))
    return boost(df, features, target, row_id, loss=loss, rate=rate, max_depth=max_depth, l2=0.0, min_child=1e-6, classes=found, **kw)
