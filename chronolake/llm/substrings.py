"""Repeated-substring removal by merged Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bwt import BYTE, VOID, repeated
from .common import fence, small, stored

LENGTH = 400
#: Length of the strings whose hashes choose anchors; every LENGTH bytes hold SPAN of them.
GRAM = 64
#: Window starts of one piece, counted from its anchor.
BLOCK = 32
#: A core with more different surroundings is settled by counting windows instead of one transform.
MOST_PIECES = 4096
#: Strings that are transformed and merged at once.
BATCH = 8192
KEY = ("t1", "t2")


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes (a power of two), by doubling."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        factor, step = np.uint64(0xD6E8FEB86659FD93), 1
        while step < size:
            h = h[:-step] * factor + h[step:]
            factor, step = factor * factor, step * 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(30)
    return h


def _sliding_min(h: np.ndarray, span: int) -> np.ndarray:
    """Least value of every ``span`` neighbours."""
    padded = np.concatenate((h, np.full(-len(h) % span, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, span)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(h) - span + 1
    return np.minimum(right[:m], left[span - 1 : span - 1 + m])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): for each run of window starts the anchor that they share.

    A window of ``length`` bytes has the leftmost of its least gram hashes as
    its anchor, so equal windows have equal anchors at the same distance.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    h = _gram_hashes(np.frombuffer(data, np.uint8), gram)
    least = _sliding_min(h, length - gram + 1)
    at = np.flatnonzero(np.isin(h, np.unique(least)))
    # the next place at or after a start that holds the start's least hash
    place, order = np.empty(len(least), np.int64), np.lexsort((at, h[at]))
    values, where = h[at][order], at[order]
    starts = np.arange(len(least))
    change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    low, high = np.searchsorted(values, least[change], "left"), np.searchsorted(values, least[change], "right")
    for c, e, lo, hi in zip(change.tolist(), np.append(change[1:], len(least)).tolist(), low.tolist(), high.tolist(), strict=True):
        own = where[lo:hi]
        place[c:e] = own[np.searchsorted(own, starts[c:e])] if hi - lo > 1 else own[0]
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (least[1:] != least[:-1]))))
    return least[first], place[first], first, np.append(first[1:], len(least)) - 1


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _raw(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def of(batches):
        for pdf in batches:
            for a, b, text in zip(pdf["t1"], pdf["t2"], pdf["text"], strict=True):
                data = _raw(text)
                h, place, first, last = anchors(data)
                if len(h):
                    c = [xxhash.xxh3_64_intdigest(data[s : e + LENGTH]) for s, e in zip(first.tolist(), last.tolist(), strict=True)]
                    yield pd.DataFrame({"t1": a, "t2": b, "h": _signed(h), "c": _signed(np.array(c, np.uint64)), "place": place, "first": first, "last": last})

    def gathered(batches):
        held, rows = [], 0
        for part in of(batches):
            held.append(part)
            rows += len(part)
            if rows >= 50_000:
                yield pd.concat(held, ignore_index=True)
                held, rows = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return docs.select(*KEY, "text").mapInPandas(gathered, "t1 long, t2 int, h long, c long, place int, first int, last int")


def _pieces(data: bytes, h: int, place: int, first: int, last: int):
    """Pieces of a run of window starts: (key, start, low, high, left, right).

    A piece is BLOCK possible starts at fixed distances from the anchor, from
    ``start`` on; ``low`` to ``high`` of them are the run's. All its windows hold
    one core, whose hash with the anchor's and the distance makes the key; equal
    windows so have equal keys. Bytes outside the run are left out.
    """
    for block in range((place - last) // BLOCK, (place - first) // BLOCK + 1):
        start = place - block * BLOCK - (BLOCK - 1)
        low, high = max(first, start), min(last, start + BLOCK - 1)
        core = data[start + BLOCK - 1 : start + LENGTH]
        key = xxhash.xxh3_64_intdigest(core, (h + block * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        yield key, start, low - start, high - start, data[low : start + BLOCK - 1], data[start + LENGTH : high + LENGTH]


def _piece_rows(docs: DataFrame) -> DataFrame:
    """(h, c, n, rel, key, low, high, left, right) of the runs in ``runs`` of each text; rel counts from the anchor."""

    def of(batches):
        for pdf in batches:
            rows = []
            for text, runs in zip(pdf["text"], pdf["runs"], strict=True):
                data = _raw(text)
                for r in runs:
                    for key, start, low, high, left, right in _pieces(data, r["h"], r["place"], r["first"], r["last"]):
                        rows.append((r["h"], r["c"], r["n"], start - r["place"], key - (1 << 64) if key >> 63 else key, low, high, left, right))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["h", "c", "n", "rel", "key", "low", "high", "left", "right"]
    return docs.select("text", "runs").mapInPandas(of, "h long, c long, n long, rel int, key long, low int, high int, left binary, right binary")


def _strings(pdf: pd.DataFrame) -> np.ndarray:
    """A string of 2 * BLOCK - 1 symbols for each piece: bytes before the core, the core's number, bytes after it."""
    out = np.full((len(pdf), 2 * BLOCK - 1), VOID, np.int32)
    _, core = np.unique(pdf["key"].to_numpy(), return_inverse=True)
    out[:, BLOCK - 1] = BYTE + 256 + core
    for k, (low, left, right) in enumerate(zip(pdf["low"], pdf["left"], pdf["right"], strict=True)):
        out[k, low : low + len(left)] = np.frombuffer(left, np.uint8).astype(np.int32) + BYTE
        out[k, BLOCK : BLOCK + len(right)] = np.frombuffer(right, np.uint8).astype(np.int32) + BYTE
    return out


def _bits(flags: np.ndarray) -> np.ndarray:
    return (flags.astype(np.int64) << np.arange(BLOCK, dtype=np.int64)).sum(axis=1)


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Add ``mask``: the starts of each piece whose windows occur more than once among these pieces.

    A window is BLOCK symbols of its string, the core being one of them, so
    windows are equal if their suffixes fall in one block of the merged transform.
    """
    owner, place, block = repeated(_strings(pdf), BLOCK)
    low, high, n = (pdf[c].to_numpy() for c in ("low", "high", "n"))
    real = (place < BLOCK) & (place >= low[owner]) & (place <= high[owner])
    owner, place, block = owner[real], place[real], block[real]
    twice = np.bincount(block, n[owner])[block] >= 2 if len(block) else np.zeros(0, bool)
    flags = np.zeros((len(pdf), BLOCK), bool)
    flags[owner[twice], place[twice]] = True
    return pdf[["key", "c2"]].assign(mask=_bits(flags))


def _transformed(contents: DataFrame) -> DataFrame:
    """Masks of pieces by key and content, whole keys together, a bounded number of pieces at a time."""

    def of(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat((held, pdf), ignore_index=True)
            if len(held) < BATCH:
                continue
            keys = held["key"].to_numpy()
            cut = int(np.searchsorted(-(keys[::-1] == keys[-1]).astype(np.int8), 0, "left"))
            whole = len(held) - cut
            if whole:
                yield _settle(held.iloc[:whole].reset_index(drop=True))
                held = held.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield _settle(held)

    return contents.repartition("key").sortWithinPartitions("key").mapInPandas(of, "key long, c2 long, mask long")


def _counted(contents: DataFrame) -> DataFrame:
    """The same for cores with very many surroundings: equal windows of a core are counted, combined before the shuffle."""
    each = contents.select("key", "c2", "n", "low", "left", "right", F.explode(F.sequence("low", "high")).alias("at"))
    window = F.xxhash64(F.substr("left", F.col("at") - F.col("low") + 1), F.substr("right", F.lit(1), F.col("at"))).alias("w")
    each = fence(each.select("key", "c2", "n", "at", window, F.hash(F.substr("left", F.col("at") - F.col("low") + 1), F.substr("right", F.lit(1), F.col("at"))).alias("w2")))
    twice = each.groupBy("key", "at", "w", "w2").agg(F.sum("n").alias("all")).where(F.col("all") >= 2)
    hit = each.join(twice, ["key", "at", "w", "w2"], "left_semi")
    return hit.groupBy("key", "c2").agg(F.sum(F.expr("1L << at")).alias("mask"))


def _masks(pieces: DataFrame) -> DataFrame:
    """(key, c2, mask) of pieces that have repeated windows."""
    contents = pieces.groupBy("key", "c2").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("low", "high", "left", "right")))
    contents = fence(contents)
    sizes = fence(contents.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where(F.col("all") >= 2))
    sized = fence(contents.join(sizes, "key"))
    alone = sized.where("kinds = 1").select("key", "c2", F.expr("(1L << (high + 1)) - (1L << low)").alias("mask"))
    met = _transformed(sized.where(F.col("kinds").between(2, MOST_PIECES)).select("key", "c2", "n", "low", "high", "left", "right"))
    many = _counted(sized.where(F.col("kinds") > MOST_PIECES))
    return alone.unionByName(met).unionByName(many).where("mask <> 0")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(t1, t2, first, last): runs of starts of repeated windows in each text.

    1. Every window has an anchor that equal windows share; anchors that occur
       once can't be in repeated windows. Counting them is one aggregation over
       about one row per 170 bytes, and loses nothing.
    2. Where all runs around an anchor are equal, all their windows repeat. Of
       other equal runs one is worked on, with their number, so copies cost as
       much as one text.
    3. These are cut into pieces, strings in which a core that all windows of a
       piece hold is one symbol; a core with equal surroundings only needs no
       order. Transforms of shards of the others are merged, and the blocks of
       the merged order are the repeated windows.
    4. The runs found count for every equal run.
    """
    found = stored(_anchor_rows(docs))
    seen = found.groupBy("h").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("several")).where("n >= 2").select("h", "several")
    # cut off, so that both sides of the join are dealt anew and a very common anchor can be split
    kept = stored(found.join(fence(seen), "h"))
    same = kept.where("NOT several").select(*KEY, "first", "last")
    kept = kept.where("several").drop("several")
    one = kept.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "place", "first", "last")).alias("r")).select("h", "c", "n", "r.*")
    tasks = fence(one.groupBy(*KEY).agg(F.collect_list(F.struct("h", "c", "n", "place", "first", "last")).alias("runs")))
    some = docs.join(small(tasks.select(*KEY)), list(KEY), "left_semi")
    texts = some.groupBy(*KEY).agg(F.first("text").alias("text")).join(tasks, list(KEY))
    pieces = stored(_piece_rows(texts).withColumn("c2", F.xxhash64("low", "high", "left", "right")))
    masks = fence(_masks(pieces))
    hit = pieces.select("h", "c", "rel", "key", "c2").join(masks, ["key", "c2"])
    bits = hit.select("h", "c", "rel", F.explode(F.expr("filter(sequence(0, 31), i -> getbit(mask, i) = 1 AND (i = 0 OR getbit(mask, i - 1) = 0))")).alias("at"), "mask")
    # zeros above the run's first bit: adding one at it carries over the ones
    end = F.expr("CAST(log2((((mask >> at) ^ ((mask >> at) + 1L)) + 1L) >> 1) AS INT)")
    starts = F.struct((F.col("rel") + F.col("at")).alias("first"), (F.col("rel") + F.col("at") + end - 1).alias("last"))
    runs = fence(bits.groupBy("h", "c").agg(F.collect_list(starts).alias("starts")))
    every = kept.select(*KEY, "h", "c", "place").distinct().join(runs, ["h", "c"]).select(*KEY, "place", F.explode("starts").alias("s"))
    runs = every.select(*KEY, (F.col("place") + F.col("s.first")).alias("first"), (F.col("place") + F.col("s.last")).alias("last"))
    return same.unionByName(runs).distinct()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Cut every byte covered by a LENGTH-byte string that also starts elsewhere.

    Result: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the
    remaining bytes). Texts are UTF-8, of any length; null counts as empty;
    matches stay within a document, and repeated rows are each other's copies; an
    empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"))
    starts = repeated_starts(keyed.where(F.octet_length("text") >= LENGTH))
    spans = fence(starts.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs")))
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").fields])

    def of(batches):
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, kept, at, n = _raw(text), [], 0, 0
                for r in runs:
                    first, end = r["first"], r["last"] + LENGTH
                    if first > at or n == 0:
                        kept.append(data[at:first])
                        n += 1
                    at = max(at, end)
                rest = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest))
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=schema.names)

    marked = keyed.join(spans, list(KEY), "left").withColumn("runs", F.coalesce("runs", F.expr("cast(array() as array<struct<first:int,last:int>>)")))
    cut = marked.where(F.size("runs") > 0).select("doc_id", "text", "runs").mapInArrow(of, schema)
    clean = marked.where(F.size("runs") == 0).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(clean)


def kept_text() -> Column:
    """``kept`` as text; a character that a cut runs through becomes U+FFFD."""
    return F.make_valid_utf8(F.col("kept").cast("string"))
