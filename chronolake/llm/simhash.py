"""Near-duplicate documents by SimHash and multi-index hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fence, per_text, spare
from .components import connected_components
from .nearcopies import near_copies

RADIUS = 2
SHINGLE_WORDS = 3
#: Bit ranges (start, length) of the two segments of a fingerprint, and the pieces that each splits into.
LOW, HIGH = (0, 32), (32, 32)
THIRDS = ((0, 11), (11, 11), (22, 10))
HALVES = ((0, 16), (16, 16))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of ``text``, A-Z lower-cased.

    A bit is 1 if it is 1 in over half of the shingles' XXH64 hashes (seed 42),
    repeats included. Fewer words than a shingle has make one shingle; no words,
    as in a null text, give 0.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), words: int = SHINGLE_WORDS) -> DataFrame:
    """``columns`` of every document and its fingerprint ``fp`` as a signed long."""

    def work(texts):
        return (np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64),)

    return per_text(docs, columns, "fp long", lambda: work)


def _key(kind: int, segment: str, rest: str, piece: tuple[int, int]) -> str:
    """SQL of a bucket's name: 3 bits of kind, 32 of a segment, up to 16 of a piece of the rest."""
    start, length = piece
    return f"{kind}L << 52 | ({segment}) << 16 | shiftright({rest}, {start}) & {(1 << length) - 1}L"


def near_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of different values of ``fp`` that differ in at most RADIUS = 2 bits, all of them.

    A fingerprint has two segments of 32 bits. Of two differing bits either both
    lie in one segment, so that the other segment matches as it is, or one lies
    in each. For the second case the ball of radius 1 around the low segment is
    enumerated, by clearing bits only: of two segments that differ in one bit,
    one has it set. Every bucket's name also holds a piece of the other segment
    that must agree then (one of three pieces where that may differ in two bits,
    one of two where in one), which keeps large groups of near copies apart. The
    join verifies the whole distance of the rows it fetches. A fingerprint has at
    most 2,080 others within two bits, so links stay linear in their number.
    """
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    same = [_key(i, low, high, p) for i, p in enumerate(THIRDS)] + [_key(3 + i, high, low, p) for i, p in enumerate(THIRDS)]
    one = [_key(6 + i, low, high, p) for i, p in enumerate(HALVES)]
    ball = f"transform(filter(sequence(0, 31), i -> getbit(fp, i) = 1), i -> ({low}) ^ (1L << i))"
    balls = [f"transform({ball}, x -> {_key(6 + i, 'x', high, p)})" for i, p in enumerate(HALVES)]
    table = distinct.select(F.col("fp").alias("b"), F.expr(f"explode(array({', '.join(same + one)}))").alias("key"))
    probes = distinct.select(F.col("fp").alias("a"), F.expr(f"explode(concat(array({', '.join(same)}), {', '.join(balls)}))").alias("key"))
    return probes.join(table, "key").where(f"bit_count(a ^ b) <= {RADIUS} AND a <> b AND (a < b OR key >= 6L << 52)").select("a", "b")


def near_duplicates(fps: DataFrame) -> DataFrame:
    """Add ``component_id``, the smallest doc_id reachable by links, to (doc_id, fp, ...).

    Works on distinct fingerprints, so exact copies never meet. A component of
    null ids only has a null component_id.
    """
    distinct = fence(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_pairs(distinct)).withColumnRenamed("node", "fp")
    joined = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = fence(joined)
    ids = fence(joined.groupBy("root").agg(F.min("least").alias("component_id")))  # cut off, so that a very large component can be split
    return fps.join(joined.join(ids, "root").select("fp", "component_id"), "fp")


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and link like others; repeated
    rows give repeated rows; an empty table gives none; other columns are
    ignored.
    """
    rows = near_duplicates(fence(fingerprints(docs)))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id.

    Near copies are texts whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more, all pairs of them, each checked on the whole
    sets, not on fingerprints; a group is what such pairs connect. A null id
    sorts last; of repeated rows with one id the one with the smallest text
    digest stays, and of equal rows one. Null and blank texts are one group;
    very long texts are read whole; an empty table gives no rows. All columns are
    kept, whatever their names.
    """
    key, one, two, other = spare(docs.columns, "near_id", "near_text1", "near_text2", "near_other")
    marked = docs.withColumns({key: F.col("doc_id"), one: F.xxhash64("doc_id", "text"), two: F.hash("doc_id", "text", F.lit(1))})
    groups = near_copies(marked, (key, one, two), (one, two))
    best = groups.groupBy("root").agg(F.min(F.struct(F.col(key).isNull(), key, F.xxhash64(one, two), one, two)).alias("best"))
    best = fence(best.select(f"best.{one}", f"best.{two}"))
    # joined and numbered by the same key, so that texts are dealt once
    first = Window.partitionBy(one, two).orderBy(F.lit(1))
    kept = marked.join(best, [one, two], "left_semi").withColumn(other, F.row_number().over(first)).where(F.col(other) == 1)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
