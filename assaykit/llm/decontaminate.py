"""Benchmark decontamination by winnowing: shared fingerprints find aligned passages, words confirm them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.table import cut_lineage

WINDOW_WORDS = 10
GRAM_WORDS = 5
# words are runs of letters, digits and everything beyond ASCII; A-Z are lower-cased when words are compared. Cutting at what
# is between them is several times faster than matching the words themselves.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# the benchmark side of a join is broadcast up to this many rows of (long, int, int); beyond it both sides shuffle
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text in their own case; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def exact_words(text: Column) -> Column:
    """Words with A-Z (and no other letter) in lower case."""
    return words_of(F.translate(text, UPPER, LOWER))


def _bind(value: Column, then) -> Column:
    """``then(value)`` with the value computed once for a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


# a fingerprint is one long: a hash of 34 bits above the place of its first word, counted down from the top of 30 bits
PLACE_BITS = 30
_TOP = (1 << PLACE_BITS) - 1


def _grams(hashes: Column, size: int) -> Column:
    """Fingerprint of each run of ``size`` words."""

    def mixed(i):
        value = F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])
        return value.bitwiseAND(F.lit(-_TOP - 1)).bitwiseOR((F.lit(_TOP) - i).cast("long"))

    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), mixed)).otherwise(F.array().cast("array<bigint>"))


def fingerprints(words: Column, size: int, window: int) -> Column:
    """Winnowed ``array<bigint>``: in every window of ``window`` consecutive grams the one with the smallest hash, rightmost on ties.

    Any run of ``size + window - 1`` words shared by two texts gives both the same hash inside that run, because the
    choice depends on the run alone. Words are hashed in full lower case, so hashes find at least every run that agrees
    with A-Z lowered. As places count down, the smallest long of a window is its hash and names its place.
    """

    def pick(grams):
        if window == 1:
            return grams
        lowest = F.transform(F.sequence(F.lit(0), F.size(grams) - window), lambda i: F.least(*[F.get(grams, i + k) for k in range(window)]))
        return F.when(F.size(grams) >= window, F.array_distinct(lowest)).otherwise(F.array().cast("array<bigint>"))

    return _bind(F.transform(words, lambda w: F.xxhash64(F.lower(w))), lambda h: _bind(_grams(h, size), pick))


def print_hash(fingerprint: Column) -> Column:
    return F.shiftright(fingerprint, PLACE_BITS)


def print_place(fingerprint: Column) -> Column:
    return (F.lit(_TOP) - fingerprint.bitwiseAND(F.lit(_TOP))).cast("int")


def _items(bench: DataFrame, item_key: str, item_text: str, window: int) -> DataFrame:
    """Items that have words, with the words and the length of their windows."""
    words = exact_words(F.col(item_text))
    items = bench.select(F.col(item_key).alias("item"), words.alias("item_words")).filter(F.size("item_words") > 0)
    return items.withColumn("span", F.least(F.lit(window), F.size("item_words")))


def passages(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """Item windows that occur in documents: ``key, text_hash, start, span, item``, each once.

    ``start`` is the document word (from zero) where a window of ``span`` words begins. Fingerprints of both
    sides are joined; a hit fixes how far the item is shifted against the document, and on that alignment every
    window whose words all agree is reported, so the hit is extended to both sides. Items shorter than a window
    are one window, and all runs of their length are fingerprints on both sides. With a benchmark of a bounded size documents
    are scanned once and not shuffled; beyond it fingerprints alone are shuffled, and words are brought for texts that are
    hit. Null keys and items are values like any other; repeated rows give a passage once; an empty table gives none.
    """
    items = cut_lineage(_items(bench, item_key, item_text, window))
    sizes = sorted(r["span"] for r in items.select("span").distinct().collect())  # at most ``window`` numbers

    def prints(words: Column, span: int) -> Column:
        k = min(gram, span)
        return fingerprints(words, k, span - k + 1) if span == window else fingerprints(words, span, 1)

    if not sizes:
        sizes = [window]
    per_item = F.lit(None)
    for span in sizes:
        per_item = F.when(F.col("span") == span, prints(F.col("item_words"), span)).otherwise(per_item)
    right = cut_lineage(
        items.select("item", "item_words", "span", F.explode(per_item).alias("p"))
        .select("item", "item_words", "span", print_hash(F.col("p")).alias("h"), print_place(F.col("p")).alias("item_at"))
    )
    size = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("item_words")), F.lit(0)).alias("words")).first()
    whole = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"), words_of(F.col(text)).alias("words"))
    place = [print_hash(F.col("p")).alias("h"), print_place(F.col("p")).alias("at")]
    left = whole.select("doc", "text_hash", "words", F.explode(F.concat(*[prints(F.col("words"), s) for s in sizes])).alias("p"))
    if size["n"] <= BROADCAST_ROWS and size["words"] <= 20 * BROADCAST_ROWS:
        hits = left.select("doc", "text_hash", "words", *place).join(F.broadcast(right), "h")
    else:
        # fingerprints meet without any words; then the words of a text that is hit come once, and those of an item
        met = left.select("doc", "text_hash", *place).join(right.select("h", "item", "item_at", "span"), "h")
        met = met.select("doc", "text_hash", "item", "span", (F.col("at") - F.col("item_at")).alias("by")).distinct()
        met = cut_lineage(met)
        texts = cut_lineage(met.select("doc", "text_hash").distinct()).select(F.col("doc").alias("d"), F.col("text_hash").alias("t"))
        same = whole["doc"].eqNullSafe(texts["d"]) & (whole["text_hash"] == texts["t"])
        words = whole.join(texts, same, "left_semi").groupBy("doc", "text_hash").agg(F.first("words").alias("words"))  # repeated rows hold the same
        words = words.select(F.col("doc").alias("d"), F.col("text_hash").alias("t"), "words")
        hits = met.join(words, met["doc"].eqNullSafe(words["d"]) & (met["text_hash"] == words["t"])).drop("d", "t")
        known = items.select(F.col("item").alias("i"), "item_words", F.col("span").alias("s")).distinct()
        hits = hits.join(known, F.col("item").eqNullSafe(F.col("i")) & (F.col("span") == F.col("s")))
        hits = hits.select("doc", "text_hash", "words", "item", "item_words", "span", F.col("by").alias("at"), F.lit(0).alias("item_at"))
    shift = F.col("at") - F.col("item_at")
    agrees = F.transform(
        F.col("item_words"),
        lambda w, j: F.when(F.translate(F.get(F.col("words"), F.when(shift + j >= 0, shift + j).otherwise(F.size("words"))), UPPER, LOWER) == w, F.lit("1")).otherwise(F.lit("0")),
    )
    every = F.repeat(F.lit("1"), F.col("span"))
    starts = _bind(
        F.array_join(agrees, ""),
        lambda bits: F.filter(F.sequence(F.lit(1), F.size("item_words") - F.col("span") + 1), lambda j: F.substring(bits, j, F.col("span")) == every),
    )
    found = hits.select("doc", "text_hash", "item", "span", F.explode(F.transform(starts, lambda j: j - 1 + shift)).alias("start"))
    return found.distinct().select(F.col("doc").alias(key), "text_hash", "start", "span", "item")


def contamination(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """One row per row of ``docs``: words, words hit, items with occurring windows, and whether any word is hit.

    Null and empty texts have no words and are never hit; a null item id counts for hits and is not listed.
    Rows that repeat a key are told apart by their text; repeated rows give repeated results. An empty table of documents gives
    an empty result, an empty benchmark no hit; other columns are ignored.
    """
    found = passages(docs, bench, key, text, item_key, item_text, window).groupBy(F.col(key).alias("doc"), "text_hash").agg(
        F.collect_set(F.struct("start", "span")).alias("at"), F.collect_set(F.col("item").cast("string")).alias("ids")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["start"], x["start"] + x["span"] - 1)))))
    found = found.select("doc", "text_hash", covered.cast("long").alias("hit"), F.array_sort("ids").alias("ids"))
    base = docs.select(F.col(key), F.xxhash64(F.col(text)).alias("text_hash"), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    joined = base.join(found, base[key].eqNullSafe(found["doc"]) & (base["text_hash"] == found["text_hash"]), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        base[key], "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"),
        F.coalesce(F.col("hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without the documents that hold any window of an item; all columns stay as they are.

    Null and empty texts stay; a null key is told apart by its text. Columns go by their places, so their names cannot clash.
    """
    bad = passages(docs, bench, key, text, item_key, item_text, window).select(F.col(key).alias("doc"), F.col("text_hash").alias("hash")).distinct()
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key_, text_ = (F.col(f"c{names.index(x)}") for x in (key, text))
    return rows.join(bad, key_.eqNullSafe(F.col("doc")) & (F.xxhash64(text_) == F.col("hash")), "left_anti").toDF(*names)
