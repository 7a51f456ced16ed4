"""Line deduplication: exact copies by hash, near copies by a segment-partition edit join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.table import cut_lineage

MAX_EDITS = 2
# shorter lines (bullets, brackets, single words) are left alone: a few edits would join unrelated ones
MIN_CHARS = 16
# sides of a join up to these sizes are broadcast; beyond them both sides shuffle
BROADCAST_LINES = 300_000
BROADCAST_BYTES = 64 << 20
SECOND_SEED = 7
# letters whose counts in two lines are compared before the lines are; any set is right, frequent ones tell most apart
COUNTED = "eaionrstdluh"
COUNT_BITS = 5


def _bind(value: Column, then) -> Column:
    """``then(value)`` with the value computed once for a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def banded_distance(a: Column, b: Column, limit: int = MAX_EDITS) -> Column:
    """Edit distance of two texts of at least ``limit`` code points if it is within ``limit``, else some larger number.

    One column of the distance table is a word of ``2 * limit + 1`` bits around the diagonal: bits say where the
    distance rises or falls from row to row, one addition carries matches down the column, and the distance is
    followed down the band's lower edge and then along the last row (Myers 1999, Hyyrö 2003). Columns after the
    distance can no longer come back within the limit cost nothing.
    """
    full = (1 << (2 * limit + 1)) - 1
    flip = lambda x: x.bitwiseXOR(F.lit(full)).bitwiseAND(F.lit(full))
    bit = lambda x, at: F.call_function("shiftright", x, at).bitwiseAND(F.lit(1))

    def compare(left: Column, right: Column) -> Column:
        m, n = F.size(left), F.size(right)

        def step(state: Column, j: Column) -> Column:
            char = F.get(right, j - 1)
            same = F.lit(0)
            for k in range(2 * limit + 1):
                same = same + F.when(F.get(left, j - 1 - limit + k) == char, F.lit(1 << k)).otherwise(F.lit(0))

            def after_match(x: Column) -> Column:
                vp, vn = state["vp"], state["vn"]
                sums = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp)
                return _bind(sums.bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full)), after_diagonal)

            def after_diagonal(d0: Column) -> Column:
                vp, vn = state["vp"], state["vn"]
                hp, hn = vn.bitwiseOR(flip(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
                down = F.shiftright(d0, 1)
                row = m - j + limit
                edge = F.when(j + limit <= m, F.lit(1) - bit(d0, F.lit(2 * limit))).otherwise(bit(hp, row) - bit(hn, row))
                return F.struct(
                    hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (state["d"] + edge).alias("d")
                )

            return F.when(state["d"] > 3 * limit, state).otherwise(_bind(same, after_match))

        start = F.struct(F.lit(full ^ ((1 << limit) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(limit).alias("d"))
        return F.when(F.abs(m - n) > limit, F.lit(limit + 1)).otherwise(F.aggregate(F.sequence(F.lit(1), n), start, step)["d"])

    chars = lambda text: F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return _bind(chars(a), lambda left: _bind(chars(b), lambda right: compare(left, right)))


def _lines(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(doc, text_hash, at, line, size, h1, h2) of every line long enough; two hashes of 64 bits name a line."""
    # hash and split before the lines are unfolded, else they are computed for every line
    whole = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"), F.split(F.col(text), "\n").alias("parts"))
    rows = whole.select("doc", "text_hash", F.posexplode("parts").alias("at", "line")).withColumn("size", F.length("line"))
    rows = rows.filter(F.col("size") >= min_chars)
    return rows.select("doc", "text_hash", "at", "line", "size", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(SECOND_SEED)).alias("h2"))


def _segment(line: Column, i: int, shift: int, size: Column, edits: int) -> Column:
    """Hash of the ``i``-th of ``edits + 1`` segments of a line of ``size`` code points, read ``shift`` further right in ``line``."""
    n = edits + 1
    short, longer = F.floor(size / n).cast("int"), F.pmod(size, F.lit(n))
    first_long = n - longer  # the last ``longer`` segments hold one code point more
    begin = short * i + F.greatest(F.lit(i) - first_long, F.lit(0))
    length = short + F.when(F.lit(i) >= first_long, 1).otherwise(0)
    return F.xxhash64(F.substring(line, begin + shift + 1, length), F.lit(i), size)


def _probes(line: Column, chars: Column, edits: int) -> tuple[list[Column], list[int], int]:
    """Hashes a line looks up, which of them are also its own index entries, and how many (the first) are for its own length.

    For each length up to ``edits`` shorter and each segment only the starts that a cheapest alignment can use are
    looked up: with d more code points than the indexed line, the i-th segment can be shifted by at most i before
    it and must leave enough edits for what follows.
    """
    out, own, same = [], [], 0
    for d in range(edits + 1):
        if d == 1:
            same = len(out)
        size = chars - d
        for i in range(edits + 1):
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                if d == 0 and shift == 0:
                    own.append(len(out))
                out.append(_segment(line, i, shift, size, edits))
    return out, own, same or len(out)


def letter_counts(line: Column) -> Column:
    """Counts of the letters of ``COUNTED``, each modulo 32, packed in one long."""
    out = F.lit(0).cast("long")
    for i, letter in enumerate(COUNTED):
        n = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("long")
        out = out.bitwiseOR(F.shiftleft(n, COUNT_BITS * i))
    return out


def counts_apart(a: Column, b: Column) -> Column:
    """A lower bound of twice the edits between two lines: each edit changes two counts by one at most."""
    top = (1 << COUNT_BITS) - 1
    out = F.lit(0)
    for i in range(len(COUNTED)):
        d = F.abs(F.shiftright(a, COUNT_BITS * i).bitwiseAND(F.lit(top)) - F.shiftright(b, COUNT_BITS * i).bitwiseAND(F.lit(top)))
        out = out + F.least(d, F.lit(top + 1) - d)
    return out


def near_line_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, edits: int = MAX_EDITS) -> DataFrame:
    """(a, b): pairs of different lines within ``edits``, each a struct (doc, text_hash, at, h1, h2) of its first place; a comes first.

    A line is indexed by the hashes of its segments with its length; within ``edits`` edits one segment of the shorter
    line stays whole in the longer one, so looking up the longer line's substrings misses no pair. Copies of a line
    are one entry before anything is joined. Lines whose letter counts are too far apart are not candidates: variants
    of one long line share most segments, and this keeps their pairs from leaving the join. Candidates are
    compared with ``banded_distance``.
    """
    rows = _lines(docs, key, text, min_chars)
    probes, own, same = _probes(F.col("line"), F.col("size"), edits)
    place = F.struct("doc", "text_hash", "at", F.array(*probes).alias("keys"), letter_counts(F.col("line")).alias("counts"))
    lines = rows.select("h1", "h2", place.alias("place")).groupBy("h1", "h2").agg(F.min("place").alias("place"))
    lines = lines.select("h1", "place.keys", "place.counts")
    entries = lines.select("h1", "counts", F.explode(F.transform("keys", lambda k, i: F.struct(k.alias("key"), i.isin(own).alias("own"), (i < same).alias("same")))).alias("e"))
    looked = entries.select(F.col("h1").alias("p"), F.col("counts").alias("p_counts"), F.col("e.same").alias("same"), F.col("e.key").alias("key"))
    index = entries.filter("e.own").select(F.col("h1").alias("q"), F.col("counts").alias("q_counts"), F.col("e.key").alias("key"))
    # of two lines of one length each finds the other; one of the two finds is enough
    near = (F.col("p") != F.col("q")) & (~F.col("same") | (F.col("p") < F.col("q"))) & (counts_apart(F.col("p_counts"), F.col("q_counts")) <= 2 * edits)
    maybe = looked.join(index, "key").filter(near).select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    maybe = cut_lineage(maybe)
    wanted = maybe.select(F.col("p").alias("h1")).union(maybe.select("q")).distinct()
    small = wanted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    lines = rows.join(F.broadcast(wanted) if small else wanted, "h1", "left_semi")
    lines = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "text_hash", "at", "line")).alias("f"))
    lines = cut_lineage(lines.select("h1", F.struct("f.doc", "f.text_hash", "f.at", "h1", "h2").alias("place"), "f.line"))
    left = lines.select(F.col("h1").alias("p"), F.col("place").alias("x"), F.col("line").alias("x_line"))
    right = lines.select(F.col("h1").alias("q"), F.col("place").alias("y"), F.col("line").alias("y_line"))
    pairs = maybe.join(left, "p").join(right, "q").filter(banded_distance(F.col("x_line"), F.col("y_line"), edits) <= edits)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, edits: int = MAX_EDITS) -> DataFrame:
    """(doc, text_hash, kept): places of the long lines that stay in a document; documents without any have no row."""
    near = near_line_pairs(docs, key, text, min_chars, edits).select(F.col("b.h1").alias("h1"), F.col("b.h2").alias("h2")).distinct()
    first = _lines(docs, key, text, min_chars).groupBy("h1", "h2").agg(F.min(F.struct("doc", "text_hash", "at")).alias("f"))
    stays = first.join(near, ["h1", "h2"], "left_anti")
    return stays.groupBy("f.doc", "f.text_hash").agg(F.collect_list("f.at").alias("kept"))


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, edits: int = MAX_EDITS, counts: bool = True,
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, plus, with ``counts``, ``n_lines`` and ``n_removed``.

    In the order of key, text and place a line of ``min_chars`` or more stays if no earlier line equals it or is
    within ``edits`` edits. Shorter lines stay, and so does every row: a document all of whose lines came earlier is
    left with its short lines or an empty text. A null text stays null with no lines; null keys sort first; of
    identical rows with one key, places repeat and all of them keep the line. An empty table gives an empty result. Columns
    that are called ``n_lines`` or ``n_removed`` already are replaced by the counts; all others stay.
    """
    kept = cut_lineage(kept_lines(docs, key, text, min_chars, edits))
    size = kept.agg(F.coalesce(F.sum(F.size("kept") * 4 + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    # the columns go by their places, so none can clash with a name used here
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key_, text_ = (F.col(f"c{names.index(x)}") for x in (key, text))
    rows = rows.join(F.broadcast(kept) if size <= BROADCAST_BYTES else kept, key_.eqNullSafe(F.col("doc")) & (F.xxhash64(text_) == F.col("text_hash")), "left")
    parts = F.split(text_, "\n")
    long_ = F.filter(F.transform(parts, lambda line, at: F.when(F.length(line) >= min_chars, at)), lambda at: at.isNotNull())
    gone = F.array_except(long_, F.coalesce("kept", F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    rows = rows.withColumn("parts", parts).withColumn("stay", F.when(text_.isNotNull(), stay))
    left = F.array_join(F.transform("stay", lambda at: F.get(F.col("parts"), at)), "\n")
    number = lambda x: F.when(text_.isNull(), 0).otherwise(x).cast("long")
    new = {"n_lines": number(F.size("parts")), "n_removed": number(F.size("parts") - F.size("stay"))} if counts else {}
    old = [left.alias(x) if x == text else F.col(f"c{i}").alias(x) for i, x in enumerate(names) if x not in new]
    return rows.select(*old, *[column.alias(x) for x, column in new.items()])
