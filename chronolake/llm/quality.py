"""Quality classifier: boosted trees over statistics of a document's text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, per_text
from .gbt import Forest, fit

#: The classifier is fitted on at most this many labelled rows, those with the smallest id hashes.
MAX_LABELLED = 12_000
THRESHOLD = 0.7
MODULUS, REST = 4, 2

_CLASS = np.zeros(256, dtype=np.int64)  # 0: other; below, one number per class of byte
_CLASS[[9, 11, 12, 13, 32]] = 1
_CLASS[10] = 2
_CLASS[48:58] = 3
_CLASS[65:91] = 4
_CLASS[97:123] = 5
_CLASS[[44, 46]] = 6  # comma and full stop
_CLASS[[x for x in range(33, 127) if _CLASS[x] == 0]] = 7
_CLASS[128:] = 8

NAMES = (
    "log_bytes", "log_words", "word_bytes", "space", "newline", "digit", "upper", "lower", "stop", "symbol", "high",
    "distinct_words", "top_word", "distinct_bigrams", "distinct_lines", "words_a_line", "symbol_words", "plain_words", "run",
)


def statistics(text: str | None) -> list[float]:
    """The statistics named in NAMES of a whole text; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    n = max(1, len(raw))
    kinds = np.zeros(9)
    counts = np.bincount(data, minlength=256)
    np.add.at(kinds, _CLASS, counts)
    words = raw.split()
    w = max(1, len(words))
    lines = raw.split(b"\n")
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    bigrams = len(set(zip(words, words[1:], strict=False)))
    marked = sum(c for x, c in seen.items() if x[-1] in b"#$%&*!|<>{}@^~=_\\/+")
    plain = sum(c for x, c in seen.items() if x.isalpha())
    same = np.flatnonzero(np.diff(data)) if len(data) > 1 else np.zeros(0, dtype=np.int64)
    longest = int(np.diff(np.concatenate(([-1], same, [len(data) - 1]))).max()) if len(data) else 0
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / w, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[8] / n,
        len(seen) / w, max(seen.values(), default=0) / w, bigrams / w, len(set(lines)) / len(lines), w / len(lines), marked / w, plain / w, float(min(longest, 1000)),
    ]


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(NAMES))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Forest:
    """Fit on labelled rows that are not held out; at most ``max_labelled``, of the smallest id hashes."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), MODULUS, REST))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def of(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["quality"], "x": list(_matrix(pdf["text"]))})

    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("quality", "text")
    # an id that many rows repeat doesn't bring more rows to the driver
    rows = texts.mapInPandas(of, "y int, x array<double>").orderBy(F.xxhash64("x", "y"), "y").limit(max_labelled).toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(NAMES))
    order = np.lexsort((*x.T, rows["y"].to_numpy()))  # the same forest whatever order rows arrive in
    return fit(x[order], rows["y"].to_numpy(dtype=np.float64)[order])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (score >= 0.7).

    Null texts score as empty ones, very long ones are read whole, repeated rows
    are scored each, an empty table gives no rows, other columns are ignored.
    Without any usable label every score is 0.5.
    """
    scored = scores(docs, labels, ("doc_id",), "score")
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def scores(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """``columns`` of ``docs`` with the score of each text as ``name``."""
    forest = train(docs, labels)
    return per_text(docs, columns, f"`{name}` double", lambda: lambda texts: (forest.predict(_matrix(texts)),))
