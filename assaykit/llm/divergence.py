"""Source divergence audit: every two sources of a language compared over the terms of that language, in a cube of cells."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.table import cut_lineage

LEAST_DOCUMENTS = 30
SMOOTH = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
# languages up to so many are broadcast, each with its number of sources and terms; more are joined
BROADCAST_LANGS = 100_000
# a cell of the cube holds about so many sources on either side, and so many terms
GROUP_BLOCK = 32
TERM_BLOCK = 4096
# counts held in a task before they are passed on
HELD_TERMS = 400_000
# very long texts are cut between terms into pieces of about this many bytes
PIECE_BYTES = 1 << 20

# terms are runs of ASCII letters and of code points beyond ASCII; A-Z are lower-cased, every other byte is a gap
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text, as UTF-8, a bounded piece at a time; a null text has none."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    start = 0
    while len(data) - start > PIECE_BYTES:
        stop = data.find(b" ", start + PIECE_BYTES)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop
    yield data[start:].split()


def count_terms(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents. A group also has a row with a null term, so none is lost."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0

        def rows() -> pd.DataFrame:
            out: tuple[list, ...] = ([], [], [], [], [])
            for (lang_, source_), (n, d) in held.items():
                for column, values in zip(out, ([lang_] * (len(n) + 1), [source_] * (len(n) + 1), [None, *n], [0, *n.values()], [0, *map(d.__getitem__, n)])):
                    column.extend(values)
            held.clear()
            return pd.DataFrame(dict(zip(("lang", "source", "term", "n", "d"), out)))

        for batch in batches:
            for lang_, source_, t in zip(batch["lang"], batch["source"], batch["t"]):
                n, d = held[lang_, source_]
                size -= len(n)
                once: set[bytes] = set()
                for found in term_lists(t):
                    n.update(found)
                    once.update(found)
                d.update(once)
                size += len(n)
                if size > HELD_TERMS:
                    yield rows()
                    size = 0
        if held:
            yield rows()

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "t"))])
    counted = read.mapInPandas(count, "lang string, source string, term binary, n long, d long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), in decimals and so exact."""
    whole = lambda x: x.cast("decimal(20,0)")
    over = (whole(count) + SMOOTH).cast("decimal(21,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", over, (whole(total) + F.lit(SMOOTH) * whole(terms)).cast("decimal(22,0)"))


def _cell_sums(cell: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of one cell: every source of its first block with every source of its second, over its terms."""
    lang, a, b, part = (cell[c].iloc[0] for c in ("lang", "a", "b", "part"))
    marks = cell[cell["term"].isna()]
    terms = cell[cell["term"].notna()]
    codes, found = pd.factorize(terms["term"])
    names = marks["source"].to_numpy()
    at = {s: i for i, s in enumerate(names)}
    flat = marks["p"].to_numpy(np.int64)  # of a term that does not occur in the source
    block = marks["block"].to_numpy()
    p = np.repeat(flat[:, None], len(found), axis=1)
    p[terms["source"].map(at).to_numpy(np.int64), codes] = terms["p"].to_numpy(np.int64)
    nowhere = int(marks["terms"].iloc[0]) - len(found)  # terms of the cell that neither block has
    left = np.flatnonzero(block == a)
    right = np.flatnonzero(block == b)
    one, two, value = [], [], []
    for i in left:
        others = right[names[right] > names[i]] if a == b else right
        one += [names[i]] * len(others)
        two += list(names[others])
        value.append(np.abs(p[others] - p[i]).sum(axis=1) + nowhere * np.abs(flat[others] - flat[i]))
    v = np.concatenate(value) if value else np.empty(0, np.int64)
    return pd.DataFrame({"lang": pd.Series([lang] * len(one), dtype=object), "one": pd.Series(one, dtype=object), "two": pd.Series(two, dtype=object), "value": v})


def pair_divergences(groups: DataFrame, terms: DataFrame, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, one, two, value) of every two sources of a language, ``one`` < ``two``.

    ``groups(lang, source, flat, terms)`` has the share of an absent term and the number of kept terms of the language,
    ``terms(lang, source, term, p)`` the others. Sources and terms are dealt into blocks whose number follows theirs. A task owns
    cells (block of sources, block of sources, block of terms), gets the slices of both blocks, and returns sums over its
    terms; those are added along the term axis. A slice travels once for each block of sources.
    """
    sizes = groups.groupBy("lang").agg(F.count("*").alias("g"), F.max("terms").alias("v"))
    sizes = cut_lineage(sizes.select("lang", "v", F.ceil(F.col("g") / group_block).cast("int").alias("gb"), F.greatest(F.lit(1), F.ceil(F.col("v") / term_block)).cast("int").alias("tb")))
    if sizes.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS:
        sizes = F.broadcast(sizes)
    block = F.pmod(F.xxhash64("source"), F.col("gb")).cast("int")
    part = F.pmod(F.xxhash64("term"), F.col("tb")).cast("int")
    kept = terms.select("lang", "term").distinct().join(sizes, "lang").groupBy("lang", part.alias("part")).agg(F.count("*").alias("terms"))
    marks = groups.join(sizes, "lang").withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("tb") - 1)))
    marks = marks.drop("terms").join(kept, ["lang", "part"], "left").select(
        "lang", "source", "block", "part", "gb", F.lit(None).cast("binary").alias("term"), F.col("flat").alias("p"), F.coalesce("terms", F.lit(0)).alias("terms")
    )
    rows = terms.join(sizes, "lang").select("lang", "source", block.alias("block"), part.alias("part"), "gb", "term", "p", F.lit(0).cast("long").alias("terms"))
    both = rows.unionByName(marks).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("gb") - 1)))
    cells = both.select("lang", F.least("block", "x").alias("a"), F.greatest("block", "x").alias("b"), "part", "source", "block", "term", "p", "terms")
    sums = cells.groupBy("lang", "a", "b", "part").applyInPandas(_cell_sums, "lang string, one string, two string, value long")
    return sums.groupBy("lang", F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS,
    group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far every source of a language is from the others, and its own terms.

    Part ``pair``: every other source of the language and the summed distance of shares over all kept terms. Part ``term``:
    the ``top`` kept terms that the source has more of than its language. A language keeps terms of at least
    ``least_documents`` of its documents. Null text, language and source count as empty; a source without terms has its rows;
    repeated rows are documents of their own; a language with one source has no pairs; an empty table gives an empty result.
    Other columns are ignored. All numbers are whole and exact.
    """
    counts = cut_lineage(count_terms(docs, text, lang, source))
    known = counts.filter(F.col("term").isNotNull())
    kept = known.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("d").alias("d")).filter(F.col("d") >= least_documents)
    kept = cut_lineage(kept.select("lang", "term", "all"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("total"))
    rows = cut_lineage(known.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"))
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = counts.filter(F.col("term").isNull()).select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("own", "terms", "total")])
    none = F.lit(0).cast("long")
    groups = cut_lineage(groups.withColumn("flat", F.when(F.col("terms") > 0, share(none, F.col("own"), F.greatest("terms", F.lit(1)))).otherwise(F.lit(1))))
    totals = groups.select("lang", "source", "own", "terms", "total")
    shares = rows.join(totals, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("own"), F.col("terms")).alias("p"), share(F.col("all"), F.col("total"), F.col("terms")).alias("q")
    )
    shares = cut_lineage(shares)
    pairs = cut_lineage(pair_divergences(groups.select("lang", "source", "flat", "terms"), shares.select("lang", "source", "term", "p"), group_block, term_block))
    pairs = pairs.select("lang", F.col("one").alias("source"), F.col("two").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("two").alias("source"), F.col("one").alias("item"), "value")
    )
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    own_terms = shares.filter("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    # the limit on ranks is met in every task before rows of a group come together
    best = own_terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return ranked.unionByName(best).select("lang", "source", "part", "item", "value", "rank")
