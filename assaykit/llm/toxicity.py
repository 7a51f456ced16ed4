"""Toxicity: disguised spellings are decoded as a noisy channel, restored text is scored."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.quality import held_out, training_rows
from assaykit.table import cut_lineage

# labels are learned from at most this many documents, those with the smallest hashes
TRAIN_DOCUMENTS = 12000
# spellings kept as evidence, and how sure of each the training rows must be (likelihood ratio)
MAX_FEATURES = 20000
LEAST_RATIO = 30.0
TOXIC = 0.5

# symbols of the character model: 0 anything between words, 1-26 a-z, from 28 on the letters of EXTRA, 27 any other letter
SYMBOLS = 28
EXTRA = "ßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
ALL_SYMBOLS = SYMBOLS + len(EXTRA)


def _table(symbols: int) -> np.ndarray:
    """Symbol of each code point up to 0xFFFF; those beyond share the last entry."""
    out = np.zeros(0x10001, np.int32)
    for i in range(0x10000):
        low = chr(i).lower()
        if low.isalpha():
            out[i] = ord(low) - 96 if "a" <= low <= "z" else 27
            if symbols > SYMBOLS and low in EXTRA:
                out[i] = SYMBOLS + EXTRA.index(low)
    return out


_TABLES = {n: _table(n) for n in (SYMBOLS, ALL_SYMBOLS)}
# Letters that a written character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "а": "a", "е": "e", "о": "o", "с": "c", "р": "p", "і": "i",
}
# characters that may stand for any letter
BLANKS = "*#%"
COST_LEET, COST_BLANK, COST_FOLD, COST_SKIP, COST_KEEP = 1.0, 3.5, 2.0, 0.7, 4.0

_LETTERED = "0-9@$!|+(<€£¡*#%"
# a second reading: a doubled letter, or a character that may stand for a letter
_SECOND = re.compile(rf"([^\W\d_])\1|[{_LETTERED}аеосрі]")
# single written characters with one separator between each
_SPACED = re.compile(rf"(?<![^\s\"'\[{{])(?:[^\W_]|[{_LETTERED}])(?:[ .\-_*](?:[^\W_]|[{_LETTERED}]))+(?=[^\w\s]*(?:\s|$))")
# edges that offer no letter, and all edges
_EDGE = re.compile(rf"^[^a-z{_LETTERED}\w]+|[^a-z{_LETTERED}\w]+$")
_RIM = re.compile(r"^[\W_]+|[\W_]+$")
_WORD = re.compile(r"[^\W\d_]+")


def trigram_codes(text: str, symbols: int = SYMBOLS) -> np.ndarray:
    """Codes of the symbol triples of a text, with a gap at both ends."""
    points = np.frombuffer(("\0\0" + text + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = _TABLES[symbols][np.minimum(points, 0x10000)]
    return (at[:-2] * symbols + at[1:-1]) * symbols + at[2:]


def count_trigrams(text: str, symbols: int = SYMBOLS) -> np.ndarray:
    """Counts of symbol triples of a text, with a gap at both ends."""
    return np.bincount(trigram_codes(text, symbols), minlength=symbols**3)


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities of a symbol after two others, from the triples of all whole texts.

    Tasks add up counts and only sums travel, at most ``ALL_SYMBOLS`` cubed whatever the input.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n**3, np.int64)
        for batch in batches:
            held, size = [], 0
            for t in batch["t"]:
                if t:
                    held.append(trigram_codes(t, n))
                    size += len(held[-1])
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=n**3)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=n**3)
        at = np.flatnonzero(total)
        if len(at):
            yield pd.DataFrame({"code": at.astype(np.int32), "n": total[at]})

    n = ALL_SYMBOLS
    rows = docs.select(F.col(text).alias("t")).mapInPandas(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(n**3)
    counts[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    counts = counts.reshape(n, n, n)
    pairs = counts.sum(axis=0)
    low = (pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * n)
    return np.log((counts + 20.0 * low[None]) / (counts.sum(axis=2, keepdims=True) + 20.0))


States = dict[tuple[int, int], tuple[float, tuple | None]]


class Decoder:
    """Exact Viterbi over the last two symbols of a spelling.

    Each written character offers what it may have been: itself, the letters it may stand for, any letter for a blank,
    nothing for a separator or for the third and later of a run of one letter (the second may fold or stay), nothing or a
    gap between words for a space. What it offers has a cost, and the character model prices the letters in their order.
    With ``whole`` no character that may stand for a letter is left out. No state is pruned: a blank after many states takes
    its step as an array, and the best letters of a run of blanks at the end are known for every pair of symbols before it.
    """

    DENSE = 32

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.symbol = _TABLES[len(model)]
        # best cost of a run of blanks and the closing gap after two symbols, and the letter the run starts with
        self.ends, self.letters = [-model[:, :, 0]], []

    def _offers(self, char: str, repeated: int, whole: bool) -> list[tuple[str, float]]:
        if char.isalpha():
            if repeated >= 2:
                return [("", 0.0)]
            offers = [(char, 0.0)] + [(c, COST_LEET) for c in LEET.get(char, "") if not char.isascii()]
            return offers + [("", COST_FOLD)] if repeated == 1 else offers
        if char in LEET:
            return [(c, COST_LEET) for c in LEET[char]] + ([] if whole else [("", COST_KEEP + COST_LEET)])
        if char in BLANKS:
            return [(chr(97 + i), COST_BLANK) for i in range(26)] + ([] if whole else [("", COST_SKIP)])
        return [("", COST_SKIP), (" ", 0.0)] if char == " " else [("", COST_SKIP)]

    def _blank(self, states: States, whole: bool) -> States:
        """One blank after many states, as an array over (symbol before last, last symbol, letter)."""
        cost = np.full(self.model.shape[:2], np.inf)
        for (a, b), (price, _) in states.items():
            cost[a, b] = price
        last = np.flatnonzero(np.isfinite(cost).any(axis=0))
        step = cost[:, last, None] - self.model[:, last, 1:27]
        best = step.argmin(axis=0)
        price = np.take_along_axis(step, best[None], axis=0)[0] + COST_BLANK
        after: States = {
            (b, s + 1): (p, (states[a, b][1], chr(97 + s)))
            for b, row, back in zip(last.tolist(), price.tolist(), best.tolist()) for s, (p, a) in enumerate(zip(row, back))
        }
        if not whole:
            for state, (price_, spelt) in states.items():
                if state not in after or price_ + COST_SKIP < after[state][0]:
                    after[state] = (price_ + COST_SKIP, spelt)
        return after

    def forward(self, written: str, whole: bool) -> States:
        """(last two symbols) -> (cost, spelling as a chain of letters) after a lower-case written form."""
        symbol, price_of = self.symbol, self.model.item
        states: States = {(0, 0): (0.0, None)}
        last, repeated = "", 0
        for char in written:
            repeated = repeated + 1 if char == last else 0
            last = char
            if char in BLANKS and len(states) > self.DENSE:
                states = self._blank(states, whole)
                continue
            offered = [(c, cost, int(symbol[min(ord(c), 0x10000)]) if c else -1) for c, cost in self._offers(char, repeated, whole)]
            after: States = {}
            for (a, b), (price, spelt) in states.items():
                for c, cost, s in offered:
                    if c:
                        new, state = price + cost - price_of(a, b, s), (b, s)
                    else:
                        new, state = price + cost, (a, b)
                    if state not in after or new < after[state][0]:
                        after[state] = (new, (spelt, c) if c else spelt)
            states = after
        return states

    def finish(self, states: States, blanks: int = 0) -> str:
        """The cheapest spelling, with a letter for each of ``blanks`` more blanks, and a gap after it."""
        while len(self.ends) <= blanks:
            costs = COST_BLANK - self.model[:, :, 1:27] + self.ends[-1][None, :, 1:27]
            self.letters.append(costs.argmin(axis=2))
            self.ends.append(costs.min(axis=2))
        end = self.ends[blanks].item
        (a, b), (_, spelt) = min(states.items(), key=lambda x: x[1][0] + end(*x[0]))
        out = []
        while spelt is not None:
            spelt, c = spelt
            out.append(c)
        out.reverse()
        for k in range(blanks, 0, -1):
            s = int(self.letters[k - 1][a, b])
            out.append(chr(97 + s))
            a, b = b, s + 1
        return "".join(out)

    def decode(self, written: str, whole: bool = False) -> str:
        front = written.rstrip(BLANKS) if whole else written
        return self.finish(self.forward(front, whole), len(written) - len(front))


def decode(written: str, model: np.ndarray, whole: bool = False) -> str:
    """Most likely spelling behind a lower-case written form."""
    return Decoder(model).decode(written, whole)


class Restorer:
    """Restores words of texts; decoded forms are remembered up to a bound."""

    LIMIT = 50_000

    def __init__(self, model: np.ndarray) -> None:
        self.decoder = Decoder(model)
        self.known: dict[str, frozenset[str]] = {}

    def _readings(self, token: str) -> frozenset[str]:
        """Words of a token or of characters set apart: as written between its marks, restored without its edges, and restored in whole."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            bare, core = _EDGE.sub("", token), _RIM.sub("", token)
            made = set(_WORD.findall(bare))
            second = core and (not core.isalpha() or _SECOND.search(core) is not None)
            blanks = len(bare) - len(core)
            if bare == core + bare[len(core) :] and core.isalpha() and not bare[len(core) :].strip(BLANKS):
                # letters and then blanks: one pass over the letters serves both readings
                states = self.decoder.forward(core, True)
                if second:
                    made.update(self.decoder.finish(states).split())
                if blanks:
                    made.update(self.decoder.finish(states, blanks).split())
            else:
                if second:
                    made.update(self.decoder.decode(core).split())
                if bare != core:
                    made.update(self.decoder.decode(bare, True).split())
            found = self.known[token] = frozenset(made)
        return found

    def words(self, text: str | None) -> set[str]:
        """Distinct lower-case words of a text, as written and, if a character has a second reading, in their restored spelling."""
        low = (text or "").lower()
        out: set[str] = set()
        for m in _SPACED.finditer(low):
            out |= self._readings(m.group())
        for token in set(low.split()):
            if token.isalpha() and not _SECOND.search(token):
                out.add(token)
            else:
                out |= self._readings(token)
        return out


def evidence(words: set[str]) -> set[str]:
    """Words, and their beginnings of four to six letters (marked by a dash), as evidence."""
    out = set(words)
    for w in words:
        for n in (4, 5, 6):
            if len(w) > n:
                out.add(w[:n] + "-")
    return out


@dataclass(frozen=True)
class ToxicModel:
    """Weights of spellings, and a logistic curve over the two strongest ones and their number."""

    weights: dict[str, float]
    curve: np.ndarray

    def summary(self, words: set[str]) -> tuple[float, float, float]:
        weights, found = self.weights, []
        for w in words:
            best = weights.get(w, 0.0)
            for n in (4, 5, 6):
                if len(w) > n:
                    x = weights.get(w[:n] + "-")
                    if x is not None and x > best:
                        best = x
            if best > 0.0:
                found.append(best)
        found.sort(reverse=True)
        return (found[0] if found else 0.0), (found[1] if len(found) > 1 else 0.0), math.log1p(len(found))

    def score(self, words: set[str]) -> float:
        z = float(self.curve[:3] @ np.array(self.summary(words)) + self.curve[3])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def likelihood_ratio(k: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """How much better a spelling's own share of label 1 explains its documents than the share of all; 0 if its share is lower."""
    share = k / n
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(n > k, (n - k) * np.log(np.where(n > k, 1 - share, 1.0) / (1 - base)), 0.0)
        found = 2 * (k * np.log(share / base) + rest)
    return np.where(share > base, found, 0.0)


def fit_curve(summaries: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic curve with a small ridge; the flat share of label 1 if only one class is there."""
    positive, n = float(labels.sum()), len(labels)
    prior = (positive + 1) / (n + 2)
    if positive in (0.0, float(n)):
        return np.array([0.0, 0.0, 0.0, math.log(prior / (1 - prior))])
    x, y = np.hstack([summaries, np.ones((n, 1))]), labels.astype(np.float64)
    curve, ridge = np.zeros(4), np.array([0.05, 0.05, 0.05, 0.01])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        curve = curve + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (y - p) - ridge * curve)
    return curve


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = TRAIN_DOCUMENTS) -> ToxicModel:
    """Fit on a bounded sample of labelled documents.

    Weights are smoothed log ratios of document shares, for spellings that the likelihood ratio finds typical of
    label 1. Tasks restore words and count; only typical spellings and three numbers a document reach the driver.
    """
    chosen = training_rows(labels, label, key, limit).select(F.col(key).alias("__key"), "y")
    rows = docs.select(F.col(key).alias("__doc"), F.col(text).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__key"))
    # of rows that repeat a key one text is learned from, so the sample keeps its bound
    rows = rows.groupBy("__doc", "y").agg(F.min("__text").alias("t"))

    def restored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = Restorer(model)
        for batch in batches:
            yield pd.DataFrame({"words": [sorted(restore.words(t)) for t in batch["t"]], "y": batch["y"].to_numpy()})

    rows = cut_lineage(rows.select("t", F.col("y").cast("int").alias("y")).mapInPandas(restored, "words array<string>, y int"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    n, positive = size["n"], size["y"]
    if positive == 0 or positive == n:
        return ToxicModel({}, fit_curve(np.zeros((n, 3)), np.array([positive > 0] * n)))
    base = positive / n

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_, hits = Counter(), Counter()
        for batch in batches:
            for words, y in zip(batch["words"], batch["y"]):
                found = evidence(set(words))
                all_.update(found)
                if y:
                    hits.update(found)
        if all_:
            yield pd.DataFrame({"w": pd.Series(list(all_), dtype=object), "n": list(all_.values()), "k": [hits[w] for w in all_]})

    counts = rows.mapInPandas(count, "w string, n long, k long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # the ratio is largest where every document is positive, so fewer hits than this never reach it
    least = math.ceil(LEAST_RATIO / (2 * math.log(1 / base)))
    typical = counts.filter((F.col("k") >= least) & (F.col("k") > base * F.col("n")))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k, m = batch["k"].to_numpy(np.float64), batch["n"].to_numpy(np.float64)
            weight = np.log((k + 0.5) / (positive + 1)) - np.log((m - k + 0.5) / (n - positive + 1))
            sure = likelihood_ratio(k, m, base) >= LEAST_RATIO
            if sure.any():
                yield pd.DataFrame({"w": pd.Series(batch["w"].to_numpy(object)[sure], dtype=object), "weight": weight[sure]})

    kept = typical.mapInPandas(weigh, "w string, weight double").orderBy(F.desc("weight"), "w").limit(MAX_FEATURES).toPandas()
    found = ToxicModel(dict(zip(kept["w"], kept["weight"])), np.zeros(4))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [found.summary(set(words)) for words in batch["words"]]
            if made:
                yield pd.DataFrame(made, columns=["a", "b", "c"]).assign(y=batch["y"].to_numpy())

    seen = rows.mapInPandas(summarise, "a double, b double, c double, y int").orderBy("y", "a", "b", "c").toPandas()
    return ToxicModel(found.weights, fit_curve(seen[["a", "b", "c"]].to_numpy(), seen["y"].to_numpy()))


def grade_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``held_out``, ``score`` (likeness of toxic 1) and ``predicted`` at ``TOXIC``.

    The character model is counted over all whole texts. Null and empty texts score what texts without evidence score;
    null keys are never held out. No labels give a flat score; an empty table gives an empty result.
    """
    model = character_model(docs, text)
    toxic = train(docs, labels, model, key, text)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restore = Restorer(model)
        for texts in batches:
            yield pd.Series([toxic.score(restore.words(t)) for t in texts], dtype="float64")

    scored: Column = F.pandas_udf(score, "double")(F.col(text))
    out = docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), scored.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
