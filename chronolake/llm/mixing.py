"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fence

#: Ranges of the sampling key for each unit of it; only rows of one range are ordered together. With weights of at most 1 a range holds at most one row in so many of a source.
KEY_RANGES = 16_384
#: Weight of a document of quality zero.
LEAST_WEIGHT = 1e-3


def quality_weight(text: Column) -> Column:
    """Weight in (0, 1]: 1 for plain prose, falling with the share of ASCII digits and symbols."""
    marks = F.regexp_count(text, F.lit(r"[!-@\[-`{-~]"))
    return F.coalesce(1 / (1 + 4 * marks / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """Exponential key -ln(u)/weight with u in (0, 1] drawn from the id's digest."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return -F.log((digits.cast("double") + 1) / F.lit(2.0**52)) / weight


def _targets(sizes: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """Add ``target`` to (no_source, src, source_size): weighted shares of the whole, capped.

    Sources are ranked in code point order without gathering them in one task.
    """
    spread = fence(sizes.repartitionByRange("no_source", "src").withColumn("pid", F.spark_partition_id()))
    counts = sorted((r["pid"], r["count"]) for r in spread.groupBy("pid").count().collect())
    offset, start = F.lit(0), 0
    for pid, n in counts:
        offset, start = F.when(F.col("pid") == pid, start).otherwise(offset), start + n
    rank = offset + F.row_number().over(Window.partitionBy("pid").orderBy("no_source", "src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = fence(spread.withColumn("w", weight).withColumn("cap", most * F.col("source_size")).drop("pid"))
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    unit, full = None, None
    while True:  # each round sets aside the sources that reach their cap
        over = F.lit(False) if unit is None else F.col("w") * unit >= F.col("cap")
        row = ranked.agg(F.sum(F.when(~over, F.col("w"))).alias("w"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(over.cast("long")).alias("n")).first()
        if row["n"] == full or not row["w"]:
            break
        full, unit = row["n"], (total - (row["cap"] or 0.0)) / row["w"]
    target = F.lit(0.0) if unit is None else F.round(F.least(F.col("w") * unit, F.col("cap")), 6)
    return ranked.select("no_source", "src", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0, quality: str | None = None) -> DataFrame:
    """Decide how many words of each document a mix takes.

    Sources in code point order (null last) get ``weights`` in turn and divide
    ``share`` times all words; a target stops at ``most`` times its source's
    words and the excess goes to the others. Of each source, complete epochs
    come first; the rest is filled by documents in the order of their
    Efraimidis-Spirakis keys, and the last one is cut so that the target is met
    to within one word. ``quality`` names a column of document weights in (0, 1],
    such as the scores of the quality classifier (null or out of range: the
    nearest bound); without it quality_weight of the text is taken.

    Result: doc_id, size, source_size, target, taken. A null text has size 0, an
    empty table gives no rows, equal rows are kept apart and share a key (ties
    go to the smaller size), very long texts count whole, other columns are
    ignored. Keys come from ids, so
    reruns agree.

    Rows of a source are split over ranges of the key: sums of a range are
    aggregated before the shuffle, only their running totals are taken within a
    source, and rows are ordered within a range. No source meets in one task.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    weight = quality_weight(F.col("text")) if quality is None else F.coalesce(F.greatest(F.least(F.col(f"`{quality}`").cast("double"), F.lit(1.0)), F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    base = docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("src"),
        size.alias("size"),
        sampling_key(F.col("doc_id"), weight).alias("key"),
    )
    base = fence(base.withColumn("part", F.floor(KEY_RANGES * F.col("key"))))
    own = ["no_source", "src"]
    parts = fence(base.groupBy(*own, "part").agg(F.sum("size").alias("part_size")))
    targets = _targets(parts.groupBy(*own).agg(F.sum("part_size").alias("source_size")), weights, share, most)
    before = Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("part_size").over(before), F.lit(0))).join(targets, own)
    within = Window.partitionBy(*own, "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0)
    rest = F.round("target").cast("long") - epochs * F.col("source_size") - F.col("start") - F.coalesce(F.sum("size").over(within), F.lit(0))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return base.join(starts, [*own, "part"]).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE)
           / coalesce(1 / (1 + 4 * length(regexp_replace(text, '[^!-@\[-`{-~]', '', 'g'))::DOUBLE / greatest(length(text), 1)), 1.0) AS key
  FROM documents),
s AS (
  SELECT no_source, src, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY no_source, src) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY no_source, src),
o AS (
  SELECT *, 2.0 * source_size AS cap,
         coalesce(sum(2.0 * source_size) OVER (ORDER BY source_size / w, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY source_size / w, no_source, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         1.5 * sum(source_size) OVER () AS total,
         row_number() OVER (ORDER BY source_size / w, no_source, src) AS nth
  FROM s),
u AS (SELECT arg_min((total - capped) / open_w, nth) FILTER (WHERE (total - capped) / open_w * w < cap) AS unit FROM o),
t AS (SELECT no_source, src, source_size, round(least(w * (SELECT unit FROM u), cap), 6)::DOUBLE AS target FROM o),
r AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END::BIGINT AS epochs,
         coalesce(sum(size) OVER (PARTITION BY no_source, src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t USING (no_source, src))
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken
FROM r
"""
