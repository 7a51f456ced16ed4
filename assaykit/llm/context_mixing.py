"""Language-model scoring by online logistic context mixing over the bits of a word code.

A token is coded as the path to its class in a Huffman tree (classes are word hashes, and one escape for words never seen in
training), then as the word inside its class, or, after an escape, spelled as paths of its bytes. Each bit of a path is predicted by
several hashed contexts; their log-odds are combined by weights chosen by a gate and learned online, and the result is refined by
an adaptive table. All of it adds up to the log probability of the text.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.table import cut_lineage

CLASSES = 1 << 12
# hashed slots of each context; the tables, and so what is broadcast, do not grow with the input
SLOT_BITS = 20
# contexts of a token: the word before, the two before, the most frequent of the last few
TOKEN_CONTEXTS = 3
# contexts of a byte: how many bytes before it, the two that choose the gate first
BYTE_ORDERS = (3, 2, 4)
# words this frequent are scored where they are read, at most so many and of at most so many bytes; the others by a join
TOP_WORDS = 1 << 18
TOP_BYTES = 64
# one training text in so many teaches the mixer from the counts of the others
MIXER_SHARE = 8
# the topic is the most frequent of the last words, among so many
TOPIC_WORDS = 8
TOPIC_RANKS = 256
# bits of one step of the online mixer, and its rate
STEP_BITS = 2048
RATE = 0.02
GATES = 64
# rows and columns of the adaptive refinement, and the bits each cell starts with
REFINE_ROWS, REFINE_COLUMNS, REFINE_PRIOR = 16, 33, 32.0
# tokens worked on at once, and bytes of a piece of a long text
BATCH_TOKENS = 1 << 13
PIECE_BYTES = 1 << 20
CHUNK = 1 << 16
END = b""
BYTES = 256
HASH_SEED = 42
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hash(word: bytes) -> int:
    """The hash that the JVM's xxhash64 gives the same bytes."""
    return xxhash.xxh64_intdigest(word, HASH_SEED)


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, a bounded piece at a time, then the end."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    start, end = 0, len(data)
    while end - start > PIECE_BYTES:
        stop = start + PIECE_BYTES
        while stop < end and not data[stop : stop + 1].isspace():
            stop += 1
        yield data[start:stop].split()
        start = stop
    yield data[start:].split() + [END]


@dataclass(frozen=True)
class Codebook:
    """The Huffman tree over classes and the escape: the inner nodes and bits of every symbol's path, and log-odds of the bare tree."""

    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    level: np.ndarray
    bare: np.ndarray
    class_total: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.start)


def huffman(counts: np.ndarray, escape: float) -> Codebook:
    """Codebook of class counts; classes without words get short shrift but a code, so every token has one."""
    n = len(counts) + 1
    truth = np.append(counts.astype(np.float64), escape)
    weight = np.append(truth * 64 + 1, np.zeros(n - 1))
    mass = np.append(truth, np.zeros(n - 1))
    parent, side = np.full(2 * n - 1, -1, np.int64), np.zeros(2 * n - 1, np.uint8)
    heap = [(float(w), i) for i, w in enumerate(weight[:n])]
    heapq.heapify(heap)
    ones, zeros = np.zeros(n - 1), np.zeros(n - 1)
    for k in range(n, 2 * n - 1):
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = k
        side[b] = 1
        weight[k], mass[k] = wa + wb, mass[a] + mass[b]
        zeros[k - n], ones[k - n] = mass[a], mass[b]
        heapq.heappush(heap, (wa + wb, k))
    owner, path, bits, current = [], [], [], np.arange(n)
    alive = np.arange(n)
    while len(alive):
        up = parent[current[alive]]
        go = up >= 0
        alive, up = alive[go], up[go]
        owner.append(alive), path.append(up - n), bits.append(side[current[alive]])
        current[alive] = up
    who, node, bit = np.concatenate(owner), np.concatenate(path), np.concatenate(bits)
    depth = np.repeat(np.arange(len(owner)), [len(o) for o in owner])
    order = np.lexsort((-depth, who))  # from the root down
    start = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))])
    level = np.arange(len(who)) - np.repeat(start[:-1], np.diff(start))
    bare = np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)
    return Codebook(start.astype(np.int64), node[order].astype(np.uint32), bit[order], np.minimum(level, REFINE_ROWS - 1).astype(np.uint8), bare, counts.astype(np.int64))


def contexts(hashes: np.ndarray, ranks: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """One hash per token and context. ``first`` holds how many tokens of its text precede each one."""

    def back(k: int) -> np.ndarray:
        out = np.zeros_like(hashes)
        out[k:] = hashes[:-k]
        out[first < k] = np.uint64(k)
        return out

    one, two = back(1), back(2)
    topic = np.full(len(ranks), TOPIC_RANKS, np.int16)
    for k in range(1, TOPIC_WORDS + 1):
        before = ranks[:-k].copy()
        before[first[k:] < k] = TOPIC_RANKS
        np.minimum(topic[k:], before, out=topic[k:])
    return [one, one * _ONE + two, (topic.astype(np.uint64) + np.uint64(7)) * _TWO]


def path_bits(book: Codebook, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bits each token has, and where in the codebook every bit of the tokens' paths is, in order."""
    size = book.lengths[symbols]
    ends = np.cumsum(size)
    shift = (book.start[symbols] - (ends - size)).astype(np.int32)
    return size, np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(shift, size)


def folded(context: np.ndarray, which: int) -> np.ndarray:
    """32 bits of a context's hash, other ones for each context."""
    mixed = (context + np.uint64(which + 1)) * _ONE
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(16)).astype(np.uint32)


def slots(context: np.ndarray, size: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Slot of every bit: the token's folded context with the bit's spread node."""
    mixed = np.repeat(context, size)
    mixed ^= spread
    mixed *= np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    mixed >>= np.uint32(32 - SLOT_BITS)
    return mixed


def spread(node: np.ndarray) -> np.ndarray:
    return node * np.uint32(0xC2B2AE3D)


def learned(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-odds in 1/256, and in the last two bits how sure they are (0 to 3)."""
    odds = np.clip(np.round(256 * np.log((ones + 0.4) / (zeros + 0.4))), -8191, 8191).astype(np.int16)
    n = zeros + ones
    return odds * np.int16(4) + ((n > 0).astype(np.int16) + (n > 2) + (n > 30))


@dataclass(frozen=True)
class Mixer:
    """Weights by gate, and the refinement's probability of a one."""

    weights: np.ndarray
    refine: np.ndarray


def first_refinement() -> np.ndarray:
    middle = 1 / (1 + np.exp(-(np.arange(REFINE_COLUMNS) - REFINE_COLUMNS // 2) / 2.0))
    return np.tile(middle, (REFINE_ROWS, 1))


def _inputs(book: Codebook, tables: np.ndarray, ctx: list[np.ndarray], symbols: np.ndarray):
    """(bits of each token, bit, inputs by context, gate, refinement row) of every bit."""
    size, at = path_bits(book, symbols)
    node = book.node[at]
    x = np.empty((len(ctx) + 1, len(at)), np.float32)
    x[0] = book.bare[node]
    node_spread = spread(node)
    gate = np.minimum(book.level[at] >> 2, 3).astype(np.uint8)
    for i, c in enumerate(ctx):
        value = tables[i][slots(folded(c, i), size, node_spread)]
        if i < 2:
            gate += (value.view(np.uint8)[::2] & np.uint8(3)) << np.uint8(2 if i else 4)
        # the two bits that say how sure a slot is move its log-odds by less than 1/256
        np.multiply(value, np.float32(1 / 1024), out=x[i + 1])
    return size, book.bit[at], x, gate, book.level[at]


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cell(z: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Cell of the refinement: the row and the log-odds in halves."""
    column = np.clip(np.rint(z * 2), -(REFINE_COLUMNS // 2), REFINE_COLUMNS // 2).astype(np.int16) + np.int16(REFINE_COLUMNS // 2)
    return row.astype(np.int16) * np.int16(REFINE_COLUMNS) + column


def _mixed(x: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Log-odds of a one: the inputs with the weights of each bit's gate."""
    z = weights[0][gate] * x[0]
    for i in range(1, len(x)):
        z += weights[i][gate] * x[i]
    return z


def bit_costs(book: Codebook, tables: np.ndarray, mixer: Mixer, ctx: list[np.ndarray], symbols: np.ndarray) -> np.ndarray:
    """Log probability (base e) of each token's path."""
    if not len(symbols):
        return np.empty(0)
    size, bit, x, gate, row = _inputs(book, tables, ctx, symbols)
    z = _mixed(x, mixer.weights.astype(np.float32), gate)
    p = (_squash(z) + mixer.refine.ravel().astype(np.float32)[_cell(z, row)]) * np.float32(0.5)
    p = np.log(np.maximum(np.where(bit == 1, p, np.float32(1) - p), np.float32(1e-7)))
    return np.add.reduceat(p, np.cumsum(size) - size, dtype=np.float64)


class OnlineMixer:
    """Learns from bits as they come: a prediction first, then a step of every gate towards the bits seen."""

    def __init__(self, inputs: int) -> None:
        self.weights = np.full((inputs, GATES), 1.0 / inputs)
        self.squares = np.full((inputs, GATES), 1e-2)
        self.bits = np.zeros(GATES, np.int64)
        self.seen = np.zeros(REFINE_ROWS * REFINE_COLUMNS, np.int64)
        self.ones = np.zeros(REFINE_ROWS * REFINE_COLUMNS, np.int64)

    def learn(self, book: Codebook, tables: np.ndarray, ctx: list[np.ndarray], symbols: np.ndarray) -> None:
        _, bit, x, gate, row = _inputs(book, tables, ctx, symbols)
        for s in range(0, len(bit), STEP_BITS):
            part = slice(s, s + STEP_BITS)
            xs, gs, bs = x[:, part], gate[part], bit[part]
            z = _mixed(xs, self.weights, gs)
            wrong = bs - _squash(z)
            n = np.bincount(gs, minlength=GATES)
            mean = np.stack([np.bincount(gs, weights=wrong * one, minlength=GATES) for one in xs]) / np.maximum(n, 1)
            self.squares += mean * mean
            self.weights += RATE * mean / np.sqrt(self.squares) * (n > 0)
            self.bits += n
            cell = _cell(z, row[part])
            self.seen += np.bincount(cell, minlength=self.seen.size)
            self.ones += np.bincount(cell[bs == 1], minlength=self.seen.size)


class Reader:
    """Turns texts into batches of tokens with their hashes, ranks and contexts; long texts come in several batches."""

    def __init__(self, top: dict[bytes, int], top_hash: np.ndarray) -> None:
        self.top, self.top_hash = top, top_hash

    def batches(self, texts: Iterator[str | None]):
        """(owner of each token, ids, words beyond the top, hashes, contexts); ids from ``len(top)`` on number those words."""
        owner, words, seen = [], [], []
        keep = max(3, TOPIC_WORDS)
        held = 0
        tail: list[bytes] = []
        for doc, text in enumerate(texts):
            before, tail = 0, []
            for piece in pieces(text):
                for start in range(0, len(piece), BATCH_TOKENS):
                    part = piece[start : start + BATCH_TOKENS]
                    # a text that goes on in a new batch brings its last tokens along, for contexts only
                    lead = tail if before and not held else []
                    words += lead + part
                    owner.append((doc, len(lead), len(part)))
                    seen.append(np.arange(before - len(lead), before + len(part)))
                    before += len(part)
                    held += len(part)
                    tail = (tail + part)[-keep:]
                    if held >= BATCH_TOKENS:
                        yield self._finish(owner, words, seen)
                        owner, words, seen, held = [], [], [], 0
        if held:
            yield self._finish(owner, words, seen)

    def _finish(self, owner, words, seen):
        n_top = len(self.top)
        ids = np.fromiter(map(self.top.get, words, repeat(-1)), np.int64, len(words))
        rare: dict[bytes, int] = {}
        unknown = np.flatnonzero(ids < 0)
        ids[unknown] = np.fromiter((rare.setdefault(words[i], n_top + len(rare)) for i in unknown.tolist()), np.int64, len(unknown))
        hashes = np.concatenate([self.top_hash, np.fromiter(map(word_hash, rare), np.uint64, len(rare))])[ids]
        ctx = contexts(hashes, np.minimum(ids, TOPIC_RANKS if n_top >= TOPIC_RANKS else n_top).astype(np.int16), np.concatenate(seen))
        doc = np.concatenate([np.r_[np.full(lead, -1), np.full(n, d)] for d, lead, n in owner])
        own = doc >= 0
        return doc[own], ids[own], list(rare), hashes[own], [c[own] for c in ctx]


class Speller:
    """Turns words into batches of bytes, and an end each, with their contexts."""

    def batches(self, words: Iterator[bytes]):
        """(owner of each symbol, symbols, contexts)."""
        held, size, reach = [], 0, max(BYTE_ORDERS)
        for i, w in enumerate(words):
            for start in range(0, len(w) + 1, BATCH_TOKENS):
                stop = start + BATCH_TOKENS
                held.append((i, w[max(0, start - reach) : stop], min(start, reach), stop > len(w)))
                size += min(stop, len(w)) - start + 1
                if size >= BATCH_TOKENS:
                    yield self._finish(held)
                    held, size = [], 0
        if held:
            yield self._finish(held)

    def _finish(self, held):
        symbols = np.concatenate([np.append(np.frombuffer(w, np.uint8).astype(np.int64), np.full(int(ends), BYTES)) for _, w, _, ends in held])
        sizes = np.array([len(w) + ends for _, w, _, ends in held])
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        back = []
        for k in range(1, max(BYTE_ORDERS) + 1):
            x = np.zeros(len(symbols), np.uint64)
            x[k:] = symbols[:-k]
            x[place < k] = np.uint64(300)  # before the word
            back.append(x)
        ctx, mixed = [], np.zeros(len(symbols), np.uint64)
        for x in back:
            mixed = (mixed + x + np.uint64(1)) * _TWO
            ctx.append(mixed)
        own = place >= np.repeat([lead for _, _, lead, _ in held], sizes)
        owner = np.repeat([i for i, _, _, _ in held], sizes)
        return owner[own], symbols[own], [ctx[k - 1][own] for k in BYTE_ORDERS]


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 divided by 7; such rows are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(w, c) of the words of all texts and of their ends (empty)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for t in batch["t"]:
                for piece in pieces(t):
                    held.update(piece)
                if len(held) > 400_000:
                    yield pd.DataFrame({"w": list(held), "c": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"w": list(held), "c": list(held.values())})

    return docs.select(F.col(text).alias("t")).mapInPandas(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def byte_book(counts: DataFrame) -> Codebook:
    """Codebook of the bytes of all distinct training words; the end of a word is its escape."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = np.bincount(np.frombuffer(b"".join(batch["w"]), np.uint8), minlength=BYTES + 1)
            total[BYTES] = len(batch)
            yield pd.DataFrame({"at": np.arange(BYTES + 1, dtype=np.int32), "n": total})

    total = np.zeros(BYTES + 1, np.int64)
    for r in counts.select("w").mapInPandas(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 257 rows
        total[r["at"]] = r["n"]
    return huffman(total[:BYTES], float(total[BYTES]))


@dataclass(frozen=True)
class Words:
    """Frequent training words by rank with their counts, the totals of all, and the codebook."""

    top: dict[bytes, int]
    top_hash: np.ndarray
    top_count: np.ndarray
    tokens: int
    distinct: int
    book: Codebook
    letters: Codebook


def learn_words(counts: DataFrame) -> Words:
    """Totals, frequent words and codebooks from (w, c); at most ``TOP_WORDS`` words and 65 536 class counts are collected."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("c") == 1, 1)), F.lit(0)).alias("once")).first()
    short = counts.filter(F.length("w") <= TOP_BYTES)
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")  # at most a thousand levels
    levels = sorted(((r["l"], r["n"]) for r in short.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for value, n in levels:
        held += n
        if held > TOP_WORDS:
            break
        least = value
    rows = [] if least is None else short.filter(level >= least).collect()
    rows.sort(key=lambda r: (-r["c"], bytes(r["w"])))
    top = {bytes(r["w"]): i for i, r in enumerate(rows)}
    classes = np.zeros(CLASSES, np.int64)
    by_class = counts.groupBy(F.xxhash64("w").bitwiseAND(CLASSES - 1).cast("int").alias("k")).agg(F.sum("c").alias("c"))
    for r in by_class.collect():
        classes[r["k"]] = r["c"]
    book = huffman(classes, total["once"] + 1.0)
    hashes = np.fromiter(map(word_hash, top), np.uint64, len(top))
    return Words(top, hashes, np.array([r["c"] for r in rows], np.int64), total["n"], total["v"], book, byte_book(counts))


def _symbols(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CLASSES - 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4 if counts.max() < 1 << 32 else 8
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def symbols_of(words: Words, spell: bool):
    """What turns items into batches of (symbols, contexts), and the codebook: texts into classes, or words into bytes."""
    if spell:
        speller = Speller()
        return (lambda items: ((symbols, ctx) for _, symbols, ctx in speller.batches(items))), words.letters
    reader = Reader(words.top, words.top_hash)
    return (lambda items: ((_symbols(hashes), ctx) for _, _, _, hashes, ctx in reader.batches(items))), words.book


def learn_contexts(items: DataFrame, sent, spell: bool) -> tuple[np.ndarray, np.ndarray]:
    """Tables of slots without and with the mixer's share of ``items(item, part)``, from the bits of all of them.

    ``part`` is 1 for items that only count, 2 for the mixer's. Tasks add up counts of slots and pass them on in packed
    chunks; each chunk is summed in one place as its pieces stream by, so what comes back has the size of the tables.
    """
    size, contexts_ = 2 << SLOT_BITS, len(BYTE_ORDERS) if spell else TOKEN_CONTEXTS

    def counted(side: int) -> DataFrame:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            read, book = symbols_of(sent.value, spell)
            total = None
            twice = spread(book.node), book.bit.astype(np.uint32)
            for batch in batches:
                total = np.zeros((contexts_, size), np.uint32) if total is None else total
                for symbols, ctx in read(batch["item"]):
                    bits, at = path_bits(book, symbols)
                    node_spread, bit = twice[0][at], twice[1][at]
                    for i, c in enumerate(ctx):
                        np.add.at(total[i], (slots(folded(c, i), bits, node_spread) << np.uint32(1)) + bit, np.uint32(1))
            if total is not None:
                flat = total.reshape(-1, CHUNK)
                for chunk in np.flatnonzero(flat.any(axis=1)):
                    yield pd.DataFrame({"side": [side], "chunk": [chunk], "data": [_packed(flat[chunk])]})

        return items.filter(F.col("part") == side).select("item").mapInPandas(count, "side int, chunk int, data binary")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for side, chunk, data in zip(batch["side"], batch["chunk"], batch["data"]):
                if chunk not in sums:
                    sums[chunk] = np.zeros((2, CHUNK), np.int64)
                sums[chunk][side - 1] += _unpacked(data)
        for chunk, (base, more) in sums.items():
            for full, counts in ((False, base), (True, base + more)):
                yield pd.DataFrame({"chunk": [chunk], "whole": [full], "slots": [learned(counts[0::2], counts[1::2]).tobytes()]})

    chunks = contexts_ * size // CHUNK
    summed = counted(1).unionByName(counted(2)).repartition(chunks // 4, "chunk")
    tables = np.zeros((2, contexts_ << SLOT_BITS), np.int16)
    half = CHUNK // 2
    for r in summed.mapInPandas(fold, "chunk int, whole boolean, slots binary").collect():  # two rows a chunk
        tables[int(r["whole"]), r["chunk"] * half : (r["chunk"] + 1) * half] = np.frombuffer(r["slots"], np.int16)
    return tuple(t.reshape(contexts_, 1 << SLOT_BITS) for t in tables)


def learn_mixer(items: DataFrame, sent, spell: bool, tables) -> Mixer:
    """Weights and refinement from the mixer's share of the items. Every task learns online from its own; weights are
    averaged by the bits of each gate, the refinement adds up counts."""
    inputs = 1 + (len(BYTE_ORDERS) if spell else TOKEN_CONTEXTS)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, book = symbols_of(sent.value, spell)
        mixer = OnlineMixer(inputs)
        for batch in batches:
            for symbols, ctx in read(batch["item"]):
                mixer.learn(book, tables.value, ctx, symbols)
        if mixer.bits.any():
            bits = np.tile(mixer.bits, inputs)
            yield pd.DataFrame({"kind": 0, "at": np.arange(len(bits), dtype=np.int32), "v": mixer.weights.ravel() * bits, "n": bits})
            yield pd.DataFrame({"kind": 1, "at": np.arange(mixer.seen.size, dtype=np.int32), "v": mixer.ones.astype(float), "n": mixer.seen})

    weights, refine = np.full(GATES * inputs, 1.0 / inputs), first_refinement().ravel()
    found = items.filter("part = 2").select("item").mapInPandas(learn, "kind int, at int, v double, n long").groupBy("kind", "at")
    for r in found.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():  # one row a weight or cell
        if r["kind"] == 0 and r["n"]:
            weights[r["at"]] = round(r["v"] / r["n"], 9)
        elif r["kind"] == 1:
            refine[r["at"]] = (r["v"] + REFINE_PRIOR * refine[r["at"]]) / (r["n"] + REFINE_PRIOR)
    return Mixer(weights.reshape(inputs, GATES), refine.reshape(REFINE_ROWS, REFINE_COLUMNS))


@dataclass(frozen=True)
class BitModel:
    """Predictors and mixer of one codebook."""

    tables: np.ndarray
    mixer: Mixer


def learn_bits(items: DataFrame, sent, spell: bool) -> BitModel:
    part, whole = learn_contexts(items, sent, spell)
    first = items.sparkSession.sparkContext.broadcast(part)
    mixer = learn_mixer(items, sent, spell, first)
    first.destroy()
    return BitModel(whole, mixer)


def spelled(words: list[bytes], book: Codebook, model: BitModel) -> np.ndarray:
    """Log probability (base e) of each word's bytes and end."""
    out = np.zeros(len(words))
    for owner, symbols, ctx in Speller().batches(words):
        out += np.bincount(owner, weights=bit_costs(book, model.tables, model.mixer, ctx, symbols), minlength=len(words))
    return out


def _score_rows(texts: list, maybe_new: np.ndarray, words: Words, model: BitModel, letters: BitModel) -> pd.DataFrame:
    """Per text: tokens, known ones, base and model log probabilities (base e) of frequent words, and the other words with what they
    cost as a class and, in texts that may hold words never learned from, as an escape."""
    n = len(texts)
    n_top = len(words.top)
    tokens, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    rare: list[tuple[list, list, list, list]] = [([], [], [], []) for _ in range(n)]
    unseen = math.log(words.tokens + words.distinct + 1)
    for doc, ids, names, hashes, ctx in Reader(words.top, words.top_hash).batches(texts):
        symbols = _symbols(hashes)
        cost = bit_costs(words.book, model.tables, model.mixer, ctx, symbols)
        tokens += np.bincount(doc, minlength=n)
        top = ids < n_top
        count = words.top_count[ids[top]]
        known += np.bincount(doc[top], minlength=n)
        base += np.bincount(doc[top], weights=np.log(count + 1.0) - unseen, minlength=n)
        inside = np.log(count / words.book.class_total[symbols[top]])
        score += np.bincount(doc[top], weights=cost[top] + inside, minlength=n)
        rest = np.flatnonzero(~top)
        if not len(rest):
            continue
        which, as_escape = ids[rest] - n_top, np.zeros(len(rest))
        new = np.flatnonzero(maybe_new[doc[rest]])
        if len(new):
            some, back = np.unique(which[new], return_inverse=True)
            spelling = spelled([names[i] for i in some], words.letters, letters)[back]
            as_escape[new] = spelling + bit_costs(words.book, model.tables, model.mixer, [c[rest[new]] for c in ctx], np.full(len(new), CLASSES))
        key, at = np.unique(doc[rest] * np.int64(len(names)) + which, return_inverse=True)
        sums = (np.bincount(at), np.bincount(at, weights=cost[rest]), np.bincount(at, weights=as_escape))
        texts_, which = np.divmod(key, len(names))
        edges = np.flatnonzero(np.diff(texts_)) + 1  # keys ascend, so the words of a text are together
        for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(key)]):
            held = rare[int(texts_[first])]
            held[0].extend([names[i] for i in which[first:last].tolist()])
            for column, x in zip(held[1:], sums):
                column.extend(x[first:last].tolist())
    return pd.DataFrame({"n_tokens": tokens, "known": known, "base": base, "score": score, **{f"rare_{c}": [r[i] for r in rare] for i, c in enumerate("wnab")}})


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    Counts, codebook, predictors and mixer are learned from all texts that are not held out. Frequent words are scored where
    they are read, all others are joined with their counts. Scores are log10 probabilities; a null or empty text is its end
    token alone; null keys are learned from; repeated rows have their own results. With no text to learn from every token
    is spelled by an even code. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    # copies of a text are on one side, so the mixer never sees counts of the text it learns from
    side = lambda x: F.when(F.pmod(F.xxhash64(x, F.lit("mixer")), MIXER_SHARE) == 0, 2).otherwise(1)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"), held_out(F.col(key)).alias("held_out"))
    train = rows.filter(~F.col("held_out")).select(F.col("t").alias("item"), side("t").alias("part"))
    counts = cut_lineage(word_counts(train, "item"))
    words = learn_words(counts)
    sent = spark.sparkContext.broadcast(words)
    model = learn_bits(train, sent, spell=False)
    letters = learn_bits(counts.select(F.col("w").alias("item"), side("w").alias("part")), sent, spell=True)
    models = spark.sparkContext.broadcast((model, letters))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 512):
                some = batch.iloc[s : s + 512].reset_index(drop=True)
                made = _score_rows(list(some["t"]), some["held_out"].to_numpy(bool), sent.value, *models.value)
                made.insert(0, "held_out", some["held_out"])
                made.insert(0, "size", [len((t or "").encode("utf-8", "surrogatepass")) for t in some["t"]])
                made.insert(0, "key", some["key"])
                yield made

    schema = f"key {dict(rows.dtypes)['key']}, size long, held_out boolean, n_tokens long, known long, base double, score double, rare_w array<binary>, rare_n array<long>, rare_a array<double>, rare_b array<double>"
    scored = rows.select("key", "t", "held_out").mapInPandas(score, schema)
    # the checkpoint fixes the row numbers that bring the joined words back
    scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()))
    class_total = F.xxhash64("w").bitwiseAND(CLASSES - 1).cast("int")
    other = scored.select("row", F.explode(F.arrays_zip(*[F.col(f"rare_{x}").alias(x) for x in "wnab"])).alias("r")).select("row", "r.*").join(counts, "w", "left")
    totals = counts.groupBy(class_total.alias("k")).agg(F.sum("c").cast("double").alias("all"))  # at most 65536 rows
    other = other.withColumn("k", class_total).join(F.broadcast(totals), "k", "left")
    c = F.coalesce("c", F.lit(0)).cast("double")
    other = other.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("more_known"), F.sum(F.col("n") * (F.log(c + 1) - math.log(words.tokens + words.distinct + 1))).alias("more_base"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("a") + F.col("n") * F.log(F.col("c") / F.col("all"))).otherwise(F.col("b"))).alias("more_score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    full = scored.drop(*[f"rare_{x}" for x in "wnab"]).join(other, "row", "left")
    model = plus("score", "more_score")
    return full.select(
        F.col("key").alias(key), "held_out", "n_tokens", plus("known", "more_known").alias("n_known"), F.lit(int(words.tokens)).cast("long").alias("train_tokens"),
        F.round(plus("base", "more_base") / math.log(10), 9).alias("base_score"), F.round(model / math.log(10), 9).alias("score"),
        F.round(-model / math.log(2) / F.greatest("size", F.lit(1)), 9).alias("bits_per_byte"),
    )
