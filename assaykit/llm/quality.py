"""Quality: a linear-chain conditional random field labels lines, its marginals grade documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the classifier is fitted on at most this many labelled documents, those with the smallest hashes
TRAIN_DOCUMENTS = 6000
# training sequences are cut at this many lines, which bounds the passes of one step
TRAIN_LINES = 48
# whole documents are drawn for training until they hold this many lines
TRAIN_TOTAL_LINES = 120_000
# lines are described in groups of about this many code points, so a very long text needs bounded memory
GROUP_CHARS = 1 << 20
ACCEPT = 0.3
STEPS = 120

# classes of code points below 128; everything beyond is class 0
CLASSES = ("other", "upper", "lower", "digit", "space", "stop", "bar", "mark")
_TABLE = np.full(128, 7, np.uint8)
_TABLE[65:91], _TABLE[97:123], _TABLE[48:58] = 1, 2, 3
for _x in " \t\r\x0b\x0c\n":
    _TABLE[ord(_x)] = 4
for _x in ".,;:?'\"()-":
    _TABLE[ord(_x)] = 5
_TABLE[ord("|")] = 6

N_LINE = 16


def _group_features(lines: list[str]) -> np.ndarray:
    """One row of ``N_LINE`` numbers for each line."""
    n = len(lines)
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.zeros(len(codes), np.uint8)
    ascii_ = codes < 128
    kinds[ascii_] = _TABLE[codes[ascii_]]
    lengths = np.fromiter(map(len, lines), np.int64, n)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    padded = np.append(kinds, np.uint8(4))
    share = np.empty((n, 8))
    for k in range(8):
        share[:, k] = np.add.reduceat((padded == k).astype(np.uint32), starts) - (k == 4)
    size = np.maximum(lengths, 1)
    out = np.empty((n, N_LINE))
    out[:, :8] = share / size[:, None]
    for i, line in enumerate(lines):
        words = line.split()
        m = len(words)
        distinct = len(set(words))
        again = sum(map(eq, words, islice(words, 1, None)))
        out[i, 8:13] = (m, distinct / (m or 1), again / (m or 1), len(line) / (m or 1), line[:1].islower())
    out[:, 13] = np.minimum(out[:, 11], 30) / 10
    out[:, 8] = np.log1p(out[:, 8]) / 5
    out[:, 11] = np.log1p(out[:, 11]) / 3
    out[:, 14] = np.log1p(lengths) / 6
    out[:, 15] = out[:, 1] / (out[:, 1] + out[:, 2] + out[:, 0] + 1e-9)
    return out


def line_table(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of the non-blank lines; blank lines say nothing and are passed over."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    if not lines:
        return np.empty((0, N_LINE)), np.empty(0)
    out, group, size = [], [], 0
    for line in lines:
        group.append(line)
        size += len(line)
        if size > GROUP_CHARS:
            out.append(_group_features(group))
            group, size = [], 0
    if group:
        out.append(_group_features(group))
    return np.concatenate(out), np.fromiter(map(len, lines), np.float64, len(lines))


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros beyond the ends), squares of the own ones, and one."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    return np.hstack([x, x * x, before, after, np.ones((len(x), 1))])


@dataclass(frozen=True)
class LineField:
    """Weights of the field and of the document grade on top of it."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of "good" against "bad"
    step: np.ndarray  # 2 x 2 transition scores
    grade: np.ndarray  # slopes on the two means, intercept, share of label 1

    def node(self, x: np.ndarray) -> np.ndarray:
        return (with_neighbours(x) - self.mean) / self.scale @ self.weights

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Probability of "good" of each line by the forward-backward sums."""
        p, _, _ = forward_backward(self.node(x)[None, :], np.array([len(x)]), self.step)
        return p[0]

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Length-weighted means of the marginals and of their log-odds; NaN for texts without lines."""
        x, size = line_table(text)
        return weighted(self.marginals(x), size) if len(x) else (float("nan"), float("nan"))

    def score(self, text: str | None) -> float:
        a, b = self.evidence(text)
        if a != a:
            return float(self.grade[3])
        return float(1 / (1 + np.exp(-np.clip(self.grade[0] * (a - 0.5) + self.grade[1] * b + self.grade[2], -30, 30))))


def weighted(good: np.ndarray, size: np.ndarray) -> tuple[float, float]:
    """Length-weighted means of marginals and of their log-odds (within 12)."""
    near = np.clip(good, 1e-12, 1 - 1e-12)
    odds = np.clip(np.log(near) - np.log1p(-near), -12, 12)
    return float(good @ size / size.sum()), float(odds @ size / size.sum())


def forward_backward(node: np.ndarray, lengths: np.ndarray, step: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of "good" (rows x lines), pair marginals (2 x 2) summed with the rows' weights, and log normalisers of padded sequences."""
    rows, longest = node.shape
    move = np.exp(step)
    # state 0 is "bad" with score zero, state 1 is "good" with the node's score; shifted against overflow
    top = np.maximum(node, 0)
    emit = np.stack([np.exp(-top), np.exp(node - top)], axis=2)
    forward, scale = np.empty((rows, longest, 2)), np.ones((rows, longest))
    live = np.arange(longest)[None, :] < lengths[:, None]
    state = emit[:, 0]
    for t in range(longest):
        if t:
            state = np.where(live[:, t, None], (state @ move) * emit[:, t], state)
        total = state.sum(axis=1)
        scale[:, t] = np.where(live[:, t], total, 1.0)
        state = state / total[:, None]
        forward[:, t] = state
    back = np.ones((rows, 2))
    good, pairs = np.zeros((rows, longest)), np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        both = forward[:, t] * back
        both /= both.sum(axis=1, keepdims=True)
        good[:, t] = both[:, 1] * live[:, t]
        if t:
            ahead = emit[:, t] * back / scale[:, t, None]
            joint = forward[:, t - 1, :, None] * move[None] * ahead[:, None, :]
            pairs += (joint * (live[:, t] if weight is None else live[:, t] * weight)[:, None, None]).sum(axis=0)
            back = np.where(live[:, t, None], ahead @ move.T, back)
    return good, pairs, (np.log(scale) + top * live).sum(axis=1)


def likelihood(theta: np.ndarray, batches: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], total: int) -> tuple[float, np.ndarray]:
    """Mean log likelihood of the line labels over documents, less a small ridge, and its gradient.

    A batch holds features of padded sequences, their lengths, labels and weights; a document's sequences weigh one over its lines.
    """
    dims = len(theta) - 4
    w, move = theta[:dims], theta[dims:].reshape(2, 2)
    value, grad = -5e-4 * float(theta @ theta), -1e-3 * theta
    for block, lengths, y, weight in batches:
        live = np.arange(block.shape[1])[None, :] < lengths[:, None]
        node = block @ w
        good, pairs, norm = forward_backward(node, lengths, move, weight)
        grad[:dims] += np.tensordot((y[:, None] - good) * live * weight[:, None], block, 2) / total
        stay = np.diag([(weight * (1 - y) * (lengths - 1)).sum(), (weight * y * (lengths - 1)).sum()])
        grad[dims:] += ((stay - pairs) / total).ravel()
        value += float((weight * (y * (node * live).sum(axis=1) - norm)).sum() + (stay * move).sum()) / total
    return value, grad


def fit_field(tables: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = STEPS) -> LineField:
    """Fit by gradient ascent (Adam) on the likelihood of line labels, every line carrying its document's label.

    Documents weigh alike. The grade is then a logistic curve over the length-weighted means of marginals and of their log-odds.
    With one class only, or without documents, the score is the share of that class.
    """
    y_all = np.asarray(labels, np.float64)
    prior = float((y_all.sum() + 1) / (len(y_all) + 2)) if len(y_all) else 0.5
    dims = 4 * N_LINE + 1
    used = [(x, s, y) for (x, s), y in zip(tables, labels) if len(x)]
    if not used or len({y for _, _, y in used}) < 2:
        flat = np.log(prior / (1 - prior))
        return LineField(np.zeros(dims), np.ones(dims), np.zeros(dims), np.zeros((2, 2)), np.array([0.0, 0.0, flat, prior]))
    wide = [with_neighbours(x) for x, _, _ in used]
    every = np.concatenate(wide)
    mean, scale = every.mean(axis=0), every.std(axis=0)
    mean[-1], scale[scale < 1e-6], scale[-1] = 0.0, 1.0, 1.0
    cuts = [(w[i : i + TRAIN_LINES], y, 1.0 / len(w)) for w, (_, _, y) in zip(wide, used) for i in range(0, len(w), TRAIN_LINES)]
    cuts.sort(key=lambda c: -len(c[0]))
    batches = []
    for i in range(0, len(cuts), 512):
        part = cuts[i : i + 512]
        lengths = np.array([len(c[0]) for c in part])
        block = np.zeros((len(part), lengths[0], dims))
        for r, c in enumerate(part):
            block[r, : len(c[0])] = (c[0] - mean) / scale
        batches.append((block, lengths, np.array([c[1] for c in part], np.float64), np.array([c[2] for c in part])))
    total = len(used)
    theta = np.zeros(dims + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        _, grad = likelihood(theta, batches, total)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta = theta + 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    field = LineField(mean, scale, theta[:dims], theta[dims:].reshape(2, 2), np.zeros(4))
    seen = []
    for x, size, y in used:
        mean_good, mean_odds = weighted(field.marginals(x), size)
        seen.append((mean_good - 0.5, mean_odds, 1.0, y))
    a = np.array(seen)
    x, y, grade = a[:, :3], a[:, 3], np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ grade, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1.0, 0.1, 0.01])
        grade = grade + np.linalg.solve(hessian, x.T @ (y - p) - np.array([1.0, 0.1, 0.01]) * grade)
    return LineField(mean, scale, theta[:dims], theta[dims:].reshape(2, 2), np.append(grade, prior))


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves no rest divided by 5; labels of such rows are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(labels: DataFrame, label: str, key: str = "doc_id", limit: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(key, y) of at most ``limit`` labelled keys that are not held out, by smallest hash; repeated labels are averaged."""
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    rows = rows.groupBy(key).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64(key), key).limit(limit)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = TRAIN_DOCUMENTS) -> LineField:
    """Fit on whole documents of a bounded sample of labelled ones; their lines are described by tasks, not on the driver."""
    chosen = training_rows(labels, label, key, limit).select(F.col(key).alias("__key"), "y")
    rows = docs.select(F.col(key).alias("__doc"), F.col(text).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__key"))
    # of rows that repeat a key one text is learned from, so the sample keeps its bound
    rows = rows.groupBy("__doc", "y").agg(F.min("__text").alias("__text"))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [line_table(t) for t in batch["__text"]]
            yield pd.DataFrame({
                "doc": batch["__doc"], "y": batch["y"],
                "x": [x.astype(np.float32).ravel() for x, _ in made], "s": [s.astype(np.float32) for _, s in made],
            })

    rows = rows.withColumn("lines", F.size(F.split(F.coalesce("__text", F.lit("")), "\n")))
    known = rows.select(F.xxhash64("__doc").alias("h"), F.col("__doc").cast("string").alias("d"), "lines").collect()  # at most ``limit`` rows
    # in hash order every document that still fits into the total; one of more lines than all of it is not learned from
    held, taken = 0, []
    for r in sorted(known, key=lambda r: (r["h"], r["d"])):
        if held + r["lines"] <= TRAIN_TOTAL_LINES:
            held += r["lines"]
            taken.append((r["d"],))
    rows = rows.withColumn("__doc", F.col("__doc").cast("string"))
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "__doc string")), "__doc") if len(taken) < len(known) else rows
    found = rows.select("__doc", "__text", "y").mapInPandas(describe, "doc string, y int, x array<float>, s array<float>").toPandas()
    found = found.assign(order=[(str(d), len(s)) for d, s in zip(found["doc"], found["s"])]).sort_values("order")
    tables = [(np.asarray(x, np.float64).reshape(-1, N_LINE), np.asarray(s, np.float64)) for x, s in zip(found["x"], found["s"])]
    return fit_field(tables, list(found["y"]))


def score_column(field: LineField, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(field.score, na_action=None).astype("float64")

    return scored(text)


def grade_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``held_out``, ``score`` (likeness of quality 1) and ``predicted`` at ``ACCEPT``.

    Every line of the whole text is labelled. Null, empty and blank texts score the share of label 1 among the training
    rows; null keys are never held out. No labels give a flat score; an empty table gives an empty result.
    """
    field = train(docs, labels, key, text)
    out = docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), score_column(field, F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accept(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents whose score is below ``ACCEPT``; columns stay as they are.

    Null, empty and blank texts have the score of ``grade_documents``; rows without a key are judged like any other, repeated
    rows alike, and an empty table gives an empty result. Columns go by their places, so their names cannot clash.
    """
    field = train(docs, labels, key, text)
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    scored = rows.withColumn("score", score_column(field, F.col(f"c{names.index(text)}")))
    return scored.filter(F.col("score") >= ACCEPT).drop("score").toDF(*names)
