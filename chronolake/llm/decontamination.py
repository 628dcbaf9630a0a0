"""Benchmark decontamination by SimHash over item-sized windows, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fence, small, spare

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Fingerprints of two windows that are at least SIMILARITY alike differ in 10 bits on average; 20 is 3.6 deviations above.
RADIUS = 20
#: Bit ranges (start, length) of the blocks. Of 20 differing bits some block of seven has at most two.
BLOCKS = tuple((9 * i, 9 if i < 6 else 10) for i in range(7))
BALL = RADIUS // len(BLOCKS)
KEY = ("t1", "t2")


def _text_key() -> list[Column]:
    """96 bits that name a text; copies share them, so that every text is worked on once."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.hash(text).alias("t2")]


def _words(text: Column) -> Column:
    """Hashes of the lower-cased words; none for a null or blank text."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))


def _shingles(h: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words, in order."""
    starts = F.sequence(F.lit(0), F.size(h) - n)
    return F.when(F.size(h) >= n, F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))).otherwise(F.array().cast("array<bigint>"))


def _own_shingles(h: Column) -> Column:
    """Shingles of SHINGLE_WORDS words; a shorter sequence is one shingle."""
    out = _shingles(h, SHINGLE_WORDS)
    for n in range(1, SHINGLE_WORDS):
        out = F.when(F.size(h) == n, _shingles(h, n)).otherwise(out)
    return out


def _fingerprint(sh: Column) -> Column:
    def bit(b):
        ones = F.aggregate(sh, F.lit(0), lambda n, x: n + F.getbit(x, b).cast("int"))
        return F.when(2 * ones > F.size(sh), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def _similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of shingle lists; a shingle weighs as often as it occurs."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, v: n + F.least(count(a, v), count(b, v)))
    return shared / (F.size(a) + F.size(b) - shared)


def _block(fp: Column, block: int) -> Column:
    start, length = BLOCKS[block]
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << length) - 1))


def _balls() -> Column:
    """(block, value) of every value within BALL bits of a block of ``fp``."""
    keys = []
    for b, (_, length) in enumerate(BLOCKS):
        near = [0, *(1 << i for i in range(length)), *(1 << i | 1 << j for i in range(length) for j in range(i))]
        masks = F.array(*[F.lit(m).cast("long") for m in near if m.bit_count() <= BALL])
        keys.append(_tagged(_flipped(_block(F.col("fp"), b), masks), b))
    return F.concat(*keys)


def _flipped(value: Column, masks: Column) -> Column:
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def _tagged(values: Column, block: int) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(block).alias("block"), v.alias("value")))


def items(bench: DataFrame) -> DataFrame:
    """(item_id, n, sh, fp) of every benchmark item that has words."""
    hashed = bench.select("item_id", _words(F.col("text")).alias("h")).where(F.size("h") > 0)
    shingled = hashed.select("item_id", F.size("h").alias("n"), _own_shingles(F.col("h")).alias("sh"))
    return fence(shingled.withColumn("fp", _fingerprint(F.col("sh"))))


def _positions(h: Column, lengths: list[int]) -> Column:
    """(shingle, position) of all shingles of the lengths that items have."""
    parts = [F.transform(_shingles(h, n), lambda x, i: F.struct(x.alias("sh"), i.alias("p"))) for n in lengths]
    return F.concat(*parts)


def _starts(p: Column, n: Column, size: Column) -> Column:
    """Where the windows start that may be SIMILARITY like an item of ``n`` words, in a text of ``size`` with shared shingles at ``p``.

    Such a window shares at least SIMILARITY / (1 + SIMILARITY) = 4/9 of the sum
    of both numbers of shingles. With k the least such number, it holds some k
    shared shingles in a row; a start counts for the first such row only.
    """
    width = F.least(n, size)
    own, whole = (F.greatest(x - (SHINGLE_WORDS - 1), F.lit(1)) for x in (width, n))
    k = F.ceil(4 * (own + whole) / 9).cast("int")
    last = size - width

    def of(i):
        after = F.when(i > 0, F.get(p, i - 1) + 1).otherwise(F.lit(0))
        low, high = F.greatest(F.get(p, i + k - 1) - own + 1, after, F.lit(0)), F.least(F.get(p, i), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    rows = F.when(F.size(p) >= k, F.sequence(F.lit(0), F.size(p) - k)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(rows, of))


def matches(docs: DataFrame, bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t1, t2) of documents to look at, and the best match of each of their texts with an item.

    1. A window at least SIMILARITY like an item shares shingles with it. Texts
       that share none with any item are left out, by a join with the items'
       shingles; this loses nothing.
    2. In the others all windows of an item's size are taken, up to the edges of
       the text, in which enough shingles are shared; a text shorter than the
       item is one window. This loses nothing. Equal windows are worked on once.
    3. A window's fingerprint meets the items of its size in one of seven
       blocks, each looked up in the Hamming ball around the item's block: every
       pair within RADIUS bits is found.
    4. The shingles of the pairs are compared exactly.
    """
    table = items(bench)
    lengths = sorted(r[0] for r in table.select(F.least("n", F.lit(SHINGLE_WORDS))).distinct().collect()) or [SHINGLE_WORDS]
    places = table.select("n", F.explode("sh").alias("sh")).distinct()
    known = small(places.select("sh").distinct())
    hashed = docs.select("doc_id", *_text_key(), _words(F.col("text")).alias("h"))  # a step of its own: the lambdas below read h again and again
    keyed = hashed.select("doc_id", *KEY, F.explode(F.concat(*(_shingles(F.col("h"), n) for n in lengths))).alias("sh"))
    hit = fence(keyed.join(known, "sh", "left_semi").select("doc_id", *KEY).distinct())
    texts = docs.select(*_text_key(), "text").join(small(hit.select(*KEY).distinct()), list(KEY), "left_semi")
    texts = fence(texts.groupBy(*KEY).agg(F.first("text").alias("text")).select(*KEY, _words(F.col("text")).alias("h")))

    found = texts.select(*KEY, F.size("h").alias("size"), F.explode(_positions(F.col("h"), lengths)).alias("x")).select(*KEY, "size", "x.sh", "x.p")
    shared = found.join(small(places), "sh").groupBy(*KEY, "size", "n").agg(F.array_sort(F.collect_set("p")).alias("p"))
    starts = shared.select(*KEY, "n", F.explode(_starts(F.col("p"), F.col("n"), F.col("size"))).alias("s"))
    starts = starts.groupBy(*KEY).agg(F.collect_list(F.struct("n", "s")).alias("at"))
    cut = F.transform("at", lambda w: F.struct(w["n"].alias("n"), w["s"].alias("s"), F.slice("h", w["s"] + 1, w["n"]).alias("h")))
    windows = fence(texts.join(starts, list(KEY)).select(*KEY, F.explode(cut).alias("w")).select(*KEY, "w.n", "w.s", "w.h"))

    distinct = windows.select("n", "h").distinct().withColumn("sh", _own_shingles(F.col("h"))).withColumn("fp", _fingerprint(F.col("sh")))
    blocks = F.array(*(F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("value")) for b in range(len(BLOCKS))))
    probes = distinct.select("n", "h", "sh", "fp", F.explode(blocks).alias("k"))
    # numbers alone, so that a long item doesn't weigh more than a short one; its shingles follow for the pairs that are left
    balls = small(table.select("item_id", "n", F.col("fp").alias("item_fp"), F.explode(_balls()).alias("k")))
    pairs = probes.join(balls, ["n", "k"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = pairs.join(small(table.select("item_id", "n", F.col("fp").alias("item_fp"), F.col("sh").alias("item_sh")).distinct()), ["item_id", "n", "item_fp"])
    alike = pairs.withColumn("similarity", _similarity(F.col("sh"), F.col("item_sh"))).where(F.col("similarity") >= SIMILARITY)
    alike = alike.groupBy("n", "h", "item_id").agg(F.max("similarity").alias("similarity"))
    best = windows.join(alike, ["n", "h"]).groupBy(*KEY, "item_id").agg(F.max(F.struct("similarity", (-F.col("s")).alias("s"), F.size("h").alias("n"))).alias("b"))
    return hit, fence(best.select(*KEY, "item_id", "b.similarity", (-F.col("b.s")).alias("start"), F.col("b.n").alias("n_words")))


def contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Matches of documents with benchmark items: doc_id, item_id, similarity, start (a word's number), n_words.

    One row per document and item, the most similar window and of equal ones the
    first. Null and blank texts match nothing, nor do such items; very long
    texts are read whole; rows that are equal in doc_id and text count once;
    empty tables give no rows; other columns are ignored.
    """
    hit, best = matches(docs, bench)
    return hit.join(best, list(KEY)).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start", "n_words")


def remove_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item; columns, whatever their names, null texts and repeated rows stay."""
    _, best = matches(docs, bench)
    names = spare(docs.columns, *KEY)
    marked = docs.withColumns(dict(zip(names, _text_key(), strict=True)))
    bad = small(best.select(*(F.col(k).alias(v) for k, v in zip(KEY, names, strict=True))).distinct())
    return marked.join(bad, names, "left_anti").drop(*names).select(*(F.col(f"`{c}`") for c in docs.columns))
