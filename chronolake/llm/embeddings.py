"""Near-duplicate embeddings by cross-polytope hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fence, small, stored
from .components import connected_components

COSINE = 0.95
TABLES = 6
#: Hash functions of a table, joined into a bucket's number.
FUNCTIONS = 3
#: A bucket with more vectors is cut into blocks, and every two blocks meet in a task of their own.
BLOCK = 2048
SEED = 20_240_117


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-random rotations of rows: three rounds of random signs and a fast Hadamard transform.

    x: (rows, size), size a power of two; signs: (rotations, 3, size). Returns
    (rows, rotations, size), up to a common scale.
    """
    y = np.broadcast_to(x[:, None, :], (len(x), *signs.shape[::2])).copy()
    for r in range(signs.shape[1]):
        y *= signs[None, :, r, :]
        h = 1
        while h < y.shape[-1]:
            z = y.reshape(*y.shape[:2], -1, 2, h)
            y = np.stack((z[..., 0, :] + z[..., 1, :], z[..., 0, :] - z[..., 1, :]), axis=-2).reshape(y.shape)
            h *= 2
    return y


def _size(dimensions: int) -> int:
    """Length of rotated vectors: the next power of two."""
    return 1 << max(1, int(dimensions - 1).bit_length())


def vertices(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """(rows, 2, TABLES, FUNCTIONS) vertices of the cross-polytope: the nearest one of each function, and its runner-up."""
    size = _size(x.shape[1])
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (TABLES * FUNCTIONS, 3, size))
    y = rotate(padded, signs)
    rows = np.arange(len(x))[:, None], np.arange(y.shape[1])[None, :]
    magnitude = np.abs(y)
    found = []
    for _ in range(2):
        at = magnitude.argmax(axis=2)
        found.append(at + size * (y[(*rows, at)] < 0))
        magnitude[(*rows, at)] = -1
    return np.stack(found, axis=1).reshape(-1, 2, TABLES, FUNCTIONS)


def numbers(found: np.ndarray, dimensions: int) -> np.ndarray:
    """(rows, TABLES, 1 + FUNCTIONS) bucket numbers of vertices: the home first, then those where one function takes its runner-up."""
    power = (2 * _size(dimensions)) ** np.arange(FUNCTIONS, dtype=np.int64)
    vertex, other = found[:, 0], found[:, 1]
    home = (vertex * power).sum(axis=2)
    return np.concatenate((home[:, :, None], home[:, :, None] + (other - vertex) * power), axis=2)


def buckets(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Bucket numbers of vectors."""
    return numbers(vertices(x, seed), x.shape[1])


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors as rows, each divided by a power of two, which keeps directions as they are and squares finite."""
    x = np.stack(vectors).astype(np.float64)
    return x / np.exp2(np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True))))


def _coded(classes: DataFrame) -> DataFrame:
    """Classes with their vertices f."""

    def of(batches):
        for pdf in batches:
            for _, part in pdf.groupby(pdf["v"].map(len)):
                for at in range(0, len(part), 1024):
                    some = part.iloc[at : at + 1024]
                    f = vertices(_scaled(some["v"].to_numpy())).reshape(len(some), -1)
                    yield some.assign(f=list(f.astype(np.int32)))

    return classes.mapInPandas(of, T.StructType([*classes.schema.fields, T.StructField("f", T.ArrayType(T.IntegerType()))]))


def _spread(coded: DataFrame) -> DataFrame:
    """A row for every class, table and bucket it is at home in or probes, without its vector.

    A table's number holds the vectors' length, as lengths don't meet.
    """

    def of(batches):
        for pdf in batches:
            for d, part in pdf.groupby("d"):
                b = numbers(np.stack(part["f"].to_numpy()).astype(np.int64).reshape(-1, 2, TABLES, FUNCTIONS), int(d))
                each = b[0].size
                yield pd.DataFrame(
                    {
                        "rep": np.repeat(part["rep"].to_numpy(), each),
                        "ck": np.repeat(part["ck"].to_numpy(), each),
                        "table": np.tile(np.repeat(np.arange(TABLES) + int(d) * TABLES, 1 + FUNCTIONS), len(part)),
                        "bucket": b.reshape(-1),
                        "home": np.tile(np.arange(each) % (1 + FUNCTIONS) == 0, len(part)),
                    }
                )

    return coded.select("rep", "ck", F.size("v").alias("d"), "f").mapInPandas(of, "rep long, ck long, table long, bucket long, home boolean")


def _owned(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """True for pairs that this bucket counts: the first table, and in it the smallest bucket, in which they meet.

    Two classes meet in the home bucket of one of them if the other one is at home there or probes it.
    """
    a, b = codes[i], codes[j]  # (pairs, tables, 1 + functions)
    in_a, in_b = (b == a[:, :, :1]).any(axis=2), (a == b[:, :, :1]).any(axis=2)
    first = (in_a | in_b).argmax(axis=1)
    k = np.arange(len(i))
    far = np.iinfo(np.int64).max
    least = np.minimum(np.where(in_a[k, first], a[k, first, 0], far), np.where(in_b[k, first], b[k, first, 0], far))
    return (first == table) & (least == bucket)


def _verify(group: dict[str, np.ndarray], table: int, bucket: int, p: int, q: int, cosine: float) -> tuple[list, list]:
    """Counts (rep, ck, links) and spanning links (a, b) of the verified pairs of a bucket, or of two blocks of it."""
    x = _scaled(group["v"])
    norm = np.sqrt((x * x).sum(axis=1))
    codes = numbers(np.stack(group["f"]).astype(np.int64).reshape(-1, 2, TABLES, FUNCTIONS), x.shape[1])
    table %= TABLES
    home = codes[:, table, 0] == bucket
    rep, n, block = group["rep"], group["n"], group["block"]
    links, parent = np.zeros(len(x), dtype=np.int64), list(range(len(x)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for at in range(0, len(x), 512):
        rows = slice(at, min(at + 512, len(x)))
        near = (x[rows] @ x.T) / (norm[rows, None] * norm) >= cosine
        near &= np.arange(len(x)) > np.arange(rows.start, rows.stop)[:, None]
        near &= home[rows, None] | home
        if p != q:
            near &= block[rows, None] != block
        i, j = np.nonzero(near)
        i += at
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(i):
            own = _owned(codes, i, j, table, bucket)
            np.add.at(links, i[own], n[j[own]])
            np.add.at(links, j[own], n[i[own]])
    some = np.flatnonzero(links)
    tree = [(int(rep[k]), int(rep[r])) for k in range(len(x)) if (r := root(k)) != k and rep[k] != rep[r]]
    return list(zip(rep[some].tolist(), group["ck"][some].tolist(), links[some].tolist(), strict=True)), tree


def _meet(coded: DataFrame, cosine: float) -> DataFrame:
    """Verified results of all buckets: (rep, ck, links) with other = null, or links (rep, other).

    Buckets are counted by numbers alone; vectors go only to buckets in which two
    classes meet.
    """
    spread = _spread(coded)
    counted = spread.groupBy("table", "bucket").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes")).where("rows > 1 AND homes > 0")
    busy = small(stored(counted.select("table", "bucket", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))))
    cut = spread.drop("home").join(busy, ["table", "bucket"])
    cut = cut.withColumn("block", F.pmod(F.xxhash64("ck", "rep"), F.col("blocks")).cast("int"))
    cut = cut.join(coded, ["rep", "ck"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cut = cut.select("table", "bucket", "rep", "ck", "n", "v", "f", "block", other)
    cut = cut.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("other")
    key = ["table", "bucket", "p", "q"]

    def of(batches):
        held, names = None, None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat((held, pdf), ignore_index=True)
            ends = np.flatnonzero((pdf[key].to_numpy()[1:] != pdf[key].to_numpy()[:-1]).any(axis=1)) + 1
            whole = int(ends[-1]) if len(ends) else 0
            yield from results(pdf.iloc[:whole], ends)
            held = pdf.iloc[whole:]
        if held is not None and len(held):
            yield from results(held, np.array([len(held)]))

    def results(pdf, ends):
        counts, tree, start = [], [], 0
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        for end in ends.tolist():
            if end - start > 1:
                group = {c: values[start:end] for c, values in columns.items()}
                table, bucket, p, q = (int(group[k][0]) for k in key)
                c, t = _verify(group, table, bucket, p, q, cosine)
                counts += c
                tree += t
            start = end
        # columns with gaps are made as nullable integers at once: floats would round the 64-bit ck
        rows = [*((*c, None) for c in counts), *((a, None, None, b) for a, b in tree)]
        yield pd.DataFrame({c: pd.array([r[k] for r in rows], dtype="Int64") for k, c in enumerate(("rep", "ck", "links", "other"))})

    return cut.repartition(*key).sortWithinPartitions(*key).mapInPandas(of, "rep long, ck long, links long, other long")


def near_embeddings(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links of vectors with at least ``cosine``: vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components, and rows
    without an id, link with nothing; vectors of different lengths don't link.
    Equal vectors are one class with a count; only classes are hashed. A pair
    that the hash tables bring together is verified in double precision and
    counted in one bucket, so no list of all pairs is made; for components each
    bucket gives a spanning forest of its links. Repeated rows count as vectors
    of their own; an empty table gives no rows; other columns are ignored.
    """
    v = F.col("embedding") if dict(rows.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    keyed = rows.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), v).alias("v")).withColumns({"ck": F.xxhash64("v"), "ch": F.hash("v")})
    valid = keyed.where(F.col("v").isNotNull())
    classes = valid.groupBy("ck", "ch").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    coded = stored(_coded(classes))
    classes = coded.select("rep", "ck", "ch", "n")
    met = fence(_meet(coded.drop("ch"), cosine))
    counts = met.where("other IS NULL").groupBy("rep", "ck").agg(F.sum("links").alias("links"))
    roots = connected_components(met.where("other IS NOT NULL"), "rep", "other").withColumnRenamed("node", "rep")
    known = classes.join(counts, ["rep", "ck"], "left").join(roots, "rep", "left")
    known = known.select("ck", "ch", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = valid.join(known, ["ck", "ch"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
