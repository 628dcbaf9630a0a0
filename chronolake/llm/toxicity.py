"""Toxicity: undo obfuscation by a noisy channel, then score the restored text."""

from __future__ import annotations

import re
from itertools import groupby
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fence, held_out, per_text, spare
from .gbt import Forest, fit

#: The classifier is fitted on at most this many labelled rows, those with the smallest id hashes.
MAX_LABELLED = 12_000
#: Regulariser: a word weighs nothing unless it is so many times likelier in toxic documents.
MIN_RATIO = 4.5
THRESHOLD = 0.7
MODULUS, REST = 3, 1
#: Beginnings of words that are weighed too, for forms that no labelled document holds.
BEGINNINGS = (3, 4, 5)
#: Parts of the labelled rows; trees learn from words weighed without a row's own part.
FOLDS = 3

#: The letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
#: Characters that may stand between the letters of a word.
SEPARATORS = ".-_*~'’,:;/\\#%&^=\"`·•"

_EDGE = re.compile(r"^[^\w@$!|]+|(?:[^\w@$]|([@$_])\1\1+)+$")
_CLEAN = re.compile(r"(?:([^\W\d_])(?!\1))*")
_TRIPLED = re.compile(r"([^\W\d_])\1\1")
_STRETCHED = re.compile(r"(?:([^\W\d_])\1+){3,}")
#: Costs of taking out a boundary or leaving it: between lone characters, and between other fragments of words; of putting one in.
LONE, OTHER, INSERT = (0.0, 0.5), (2.5, 0.0), 7.0
#: Words of at most this many characters may be parts of a word. Those with a smaller share of all words are suspicious.
FRAGMENT, RARE = 3, 2e-5
#: Entries of each cache of a task; a full one starts anew.
CACHED = 200_000
CODES = 64
#: A reading, the channel's cost of it, and its symbols.
Step = tuple[str, float, tuple[int, ...]]
#: Steps between the characters of a long fragment, and at the end.
HIDDEN: list[Step] = [("", 0.0, ()), (" ", INSERT, (0,))]
EDGE: list[Step] = [(" ", 0.0, (0,))]


def code(points: np.ndarray) -> np.ndarray:
    """Symbol of each code point of lower-cased text: 0 for what is no letter, 1-26, or 27-63 for other letters by remainder."""
    out = 27 + points % (CODES - 27)
    out[points < 0xC0] = 0
    latin = (points >= 97) & (points <= 122)
    out[latin] = points[latin] - 96
    return out


def _codes(text: str) -> np.ndarray:
    return code(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32))


def _symbols(text: str) -> tuple[int, ...]:
    """The same of a short text."""
    return tuple(0 if n < 97 or 122 < n < 0xC0 else n - 96 if n <= 122 else 27 + n % (CODES - 27) for n in map(ord, text))


def character_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all whole texts of symbol trigrams, and of words of up to three symbols. Tasks count first; 2 * CODES**3 sums at most reach the driver."""

    def chunks(batches):
        held, size = [], 0
        for pdf in batches:
            for text in pdf["text"]:
                held.append((text or "").lower())
                size += len(held[-1])
                if size >= 1 << 20:
                    yield " ".join(held)
                    held, size = [], 0
        yield " ".join(held)

    def count(batches):
        total = np.zeros(2 * CODES**3, dtype=np.int64)
        for chunk in chunks(batches):
            c = _codes(f" {chunk} ")
            c = np.concatenate(([0], c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]))  # one boundary between words
            total[: CODES**3] += np.bincount((c[:-2] * CODES + c[1:-1]) * CODES + c[2:], minlength=CODES**3)
            ends = np.flatnonzero(c == 0)
            for n in range(1, FRAGMENT + 1):
                at = ends[:-1][np.diff(ends) == n + 1] + 1
                key = np.zeros(len(at), dtype=np.int64)
                for k in range(FRAGMENT):
                    key = key * CODES + (c[at + k] if k < n else 0)
                total[CODES**3 :] += np.bincount(key, minlength=CODES**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at.astype(np.int32), "n": total[at]})

    found = docs.select("text").mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(2 * CODES**3)
    counts[found["gram"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    return counts[: CODES**3], counts[CODES**3 :]


def _keep(cache: dict, key, value):
    if len(cache) >= CACHED:
        cache.clear()
    cache[key] = value
    return value


class Channel:
    """Restores obfuscated words: the likeliest reading under a character model and channel costs."""

    def __init__(self, counts: np.ndarray, short: np.ndarray | None = None):
        c = counts.reshape(CODES, CODES, CODES)
        pair, single = c.sum(axis=0), c.sum(axis=(0, 1))
        uni = (single + 1) / (single.sum() + CODES)
        bi = (pair + 8 * uni) / (pair.sum(axis=1, keepdims=True) + 8)
        self.cost = (-np.log((c + 8 * bi[None]) / (c.sum(axis=2, keepdims=True) + 8))).astype(np.float32)
        self.flat = memoryview(self.cost.ravel())
        rare = np.zeros(CODES**FRAGMENT) if short is None else short
        self.common = set(np.flatnonzero(rare > RARE * single[0]).tolist()) if single[0] else set()
        self.coded: dict[tuple[str, int], list[Step]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("flat", "coded")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.flat = memoryview(self.cost.ravel())  # reads single costs much faster than the array; doesn't travel
        self.coded = {}

    def _step(self, ch: str, n: int) -> list[Step]:
        if ch in LEET:
            found = [(x * k, 1.0 + 0.5 * (k != n)) for x in LEET[ch] for k in {1, min(n, 2)}] + [("", 25.0 if ch.isdigit() else 9.0)]
        elif ch.isalpha():
            found = [(ch, 0.0)] if n == 1 else [(ch, 1.5 if n == 2 else 0.2), (ch * 2, 0.0 if n == 2 else 1.0)]
        else:
            found = [("", 0.5 if ch in SEPARATORS else 3.0)]
        return _keep(self.coded, (ch, n), [(reading, extra, _symbols(reading)) for reading, extra in found])

    def readings(self, word: str) -> list[list[Step]]:
        """For each run of one character its readings, each with the channel's cost and its symbols."""
        steps, get = [], self.coded.get
        for ch, run in groupby(word):
            n = len([*run])
            steps.append(get((ch, n)) or self._step(ch, n))
        return steps

    def lattice(self, parts: tuple[str, ...]) -> list[list[Step]]:
        """Steps of fragments: what stands between two may be a boundary or nothing, and long ones may hide a boundary."""
        steps: list[list[Step]] = []
        for k, part in enumerate(parts):
            if k:
                out, kept = LONE if len(part) == len(parts[k - 1]) == 1 else OTHER
                steps.append([("", out, ()), (" ", kept, (0,))])
            own = self.readings(part)
            if len(part) > 2 * FRAGMENT:
                steps.append(own[0])
                for step in own[1:]:
                    steps += (HIDDEN, step)
            else:
                steps += own
        return steps

    def decode(self, *parts: str) -> str:
        """Viterbi over the lattice; a state is the last two symbols, with the cost and the chain of readings so far."""
        flat, last = self.flat, CODES * CODES - 1
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for step in [*self.lattice(parts), EDGE]:
            after: dict[int, tuple[float, tuple | None]] = {}
            get = after.get
            for state, (cost, chain) in states.items():
                for reading, extra, symbols in step:
                    to, total = state, cost + extra
                    for s in symbols:
                        at = to * CODES + s
                        total += flat[at]
                        to = at & last
                    old = get(to)
                    if old is None or total < old[0]:
                        after[to] = (total, (chain, reading) if reading else chain)
            states = after
        chain, out = min(states.values(), key=lambda v: v[0])[1], []
        while chain:
            chain, reading = chain
            out.append(reading)
        return "".join(reversed(out)).strip()

    def length(self, word: str) -> float:
        """Cost of a word under the character model alone."""
        x, y, total = 0, 0, 0.0
        for s in (*_symbols(word), 0):
            total += self.flat[(x * CODES + y) * CODES + s]
            x, y = y, s
        return total

    def restore(self, token: str) -> str:
        """The words behind a lower-cased token: edge punctuation goes, and what isn't clean is decoded.

        A word with doubled letters is clean if it isn't likelier with single
        ones.
        """
        if token.isalpha():
            if _CLEAN.fullmatch(token):
                return token
            if not _STRETCHED.fullmatch(token) and not _TRIPLED.search(token) and self.length(token) <= self.length("".join(ch for ch, _ in groupby(token))) + 1.0:
                return token
        core = _EDGE.sub("", token)
        if _STRETCHED.fullmatch(core):
            return "".join(ch for ch, _ in groupby(core))
        if _CLEAN.fullmatch(core) and core:
            return core
        plain = not any(ch.isalpha() or (ch in LEET and not ch.isdigit()) for ch in core)
        return core if plain or not any(ch.isalpha() or ch in LEET for ch in core) else self.decode(core)

    def fragment(self, token: str) -> tuple[str, bool] | None:
        """A possible part of a word, and whether it is suspicious; nothing if the token is no part of one; an empty part for marks alone."""
        core = token if token.isalnum() else _EDGE.sub("", token) or ("" if len(token) <= FRAGMENT and not any(map(str.isalnum, token)) else token)
        if len(core) > FRAGMENT or len(core) > 1 and core.isdigit() or not all(ch.isalpha() or ch in LEET for ch in core):
            return None
        if not core:
            return "", False
        if any(ch in LEET for ch in core):
            return core, not core.isdigit()
        key = 0
        for k in [*_codes(core).tolist(), 0, 0][:FRAGMENT]:
            key = key * CODES + k
        return core, key not in self.common


class Reader:
    """Restored words of texts, with caches that live as long as a task."""

    def __init__(self, channel: Channel):
        self.channel = channel
        #: Words that are read as they are and aren't short; the others are in ``known``.
        self.plain: set[str] = set()
        self.known: dict[str, str | tuple[str, ...]] = {}
        self.parts: dict[str, tuple[str, bool] | None] = {}
        self.runs: dict[tuple[str, ...], tuple[str, ...]] = {}

    def _restored(self, token: str) -> str | tuple[str, ...]:
        found = self.channel.restore(token).split()
        if found == [token] and (len(token) > 2 * FRAGMENT or self._part(token) is None):
            if len(self.plain) >= CACHED:
                self.plain.clear()
            self.plain.add(token)
            return token
        return _keep(self.known, token, found[0] if len(found) == 1 else tuple(found))

    def _part(self, token: str) -> tuple[str, bool] | None:
        return _keep(self.parts, token, self.channel.fragment(token))

    def _run(self, run: list[str]) -> tuple[str, ...]:
        key = tuple(run)
        value = self.runs.get(key)
        if value is None:
            value = _keep(self.runs, key, tuple(self.channel.decode(*key).split()))
        return value

    def words(self, text: str | None) -> set[str]:
        """Distinct restored words of a whole text. Runs of short fragments are also decoded as a whole, if they hold a suspicious one or three lone characters."""
        tokens = (text or "").lower().split()
        different, short, odd = set(tokens), {}, False
        known, parts = self.known, self.parts
        found = different & self.plain
        for t in different - found:
            w = known.get(t)
            if w is None:
                w = self._restored(t)
            if type(w) is str:
                found.add(w)
            else:
                found.update(w)
            if len(t) <= 2 * FRAGMENT:
                part = parts[t] if t in parts else self._part(t)
                if part is not None:
                    short[t] = part
                    odd = odd or part[1] or len(part[0]) == 1
        if odd:
            for is_short, group in groupby(tokens, short.__contains__):
                if not is_short:
                    continue
                run: list[str] = []
                odd, lone = False, 0
                for core, suspicious in map(short.__getitem__, group):
                    if core:
                        run.append(core)
                        odd, lone = odd or suspicious, lone + (len(core) == 1)
                if len(run) > 1 and (odd or lone >= 3):
                    found.update(self._run(run))
                    if lone == len(run) > 3:  # a word of one letter may stand before or after
                        found.update(self._run(run[1:]), self._run(run[:-1]))
        found.discard("")
        return found


def features(word: str) -> list[str]:
    """A word, and its beginnings of BEGINNINGS letters."""
    return [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)]


def summary(found: set[str], weights: dict[str, float], known: dict[str, float]) -> list[float]:
    """Largest and summed log-odds of the words, number of strong ones, also against the text's length.

    A word that is known to weigh nothing does so, whatever its beginnings weigh.
    """
    new = {}
    for w in found.difference(known):
        own, *beginnings = map(weights.get, features(w))
        new[w] = 0.0 if own == 0.0 else max(own or 0.0, *(b or 0.0 for b in beginnings), 0.0)
    hits = [*filter(None, map(known.get, found)), *filter(None, new.values())]
    if len(known) + len(new) > CACHED:
        known.clear()
    if len(new) <= CACHED:
        known.update(new)
    hits.sort(reverse=True)
    return [hits[0] if hits else 0.0, sum(hits[:3]), float(len(hits)), len(hits) / (1 + len(found)), float(sum(x > 3 for x in hits))]


def _weigh(t: np.ndarray, n: np.ndarray, toxic: int, rows: int) -> np.ndarray:
    """Lower bounds of the log-odds of features in ``n`` of ``rows`` documents, ``t`` of them toxic."""
    odds = np.log((t + 0.5) / (toxic + 1)) - np.log((n - t + 0.5) / (rows - toxic + 1))
    return np.where(t >= 2, odds - 2 / np.sqrt(t + 0.5), 0.0)


def _clean_words(seen: DataFrame, beginnings: list[str]) -> pd.DataFrame:
    """Rows of ``seen`` of words that begin with one of ``beginnings`` and that no toxic document holds, or none outside one fold."""
    alone = F.lit(False)
    for k in range(FOLDS):
        alone = alone | ((F.col("t") == F.col(f"t{k}")) & (F.col("n") > F.col(f"n{k}")))
    begins = F.lit(False)
    for n in BEGINNINGS:
        begins = begins | F.concat(F.lit("^"), F.substring("f", 2, n)).isin([f for f in beginnings if len(f) == n + 1])
    return seen.where(F.col("f").startswith("=")).where(begins & ((F.col("t") == 0) | alone)).toPandas()


def train(docs: DataFrame, labels: DataFrame, channel: Channel, max_labelled: int = MAX_LABELLED) -> tuple[dict[str, float], Forest]:
    """Word weights of all usable labelled rows, and trees over their summaries.

    The summaries that the trees learn from weigh words without the row's own
    fold. Rows that are held out are never read; at most ``max_labelled``
    others, of the smallest id hashes, are.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), MODULUS, REST))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic", fold)

    def spread(batches):
        reader = Reader(channel)
        for pdf in batches:
            yield pdf[["toxic", "fold"]].assign(w=[sorted(reader.words(t)) for t in pdf["text"]])

    found = fence(texts.mapInPandas(spread, "toxic int, fold int, w array<string>"))
    sizes = {r["fold"]: (r["t"], r["n"]) for r in found.groupBy("fold").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()}
    toxic, rows = sum(t for t, _ in sizes.values()), sum(n for _, n in sizes.values())

    def expand(batches):
        for pdf in batches:
            sets = [list({f for w in ws for f in features(w)}) for ws in pdf["w"]]
            yield pdf[["toxic", "fold"]].assign(f=sets)

    each = found.mapInPandas(expand, "toxic int, fold int, f array<string>").select("toxic", "fold", F.explode("f").alias("f"))
    sums = [F.sum(F.when(F.col("fold") == k, x).otherwise(0)).alias(f"{name}{k}") for k in range(FOLDS) for name, x in (("t", F.col("toxic")), ("n", F.lit(1)))]
    seen = fence(each.groupBy("f").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"), *sums))
    ratio = (F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5)
    kept = seen.where("t >= 2").where(ratio > MIN_RATIO * (toxic + 1) / (rows - toxic + 1)).toPandas()  # at most the words of the labelled rows
    kept = kept.sort_values("f", ignore_index=True)
    clean = _clean_words(seen, [f for f in kept["f"] if f[0] == "^"])
    names = kept["f"].tolist()
    every = _weigh(kept["t"].to_numpy(float), kept["n"].to_numpy(float), toxic, rows)
    weights = {f: w for f, w in zip(names, every.tolist(), strict=True) if w > 0} | dict.fromkeys(clean["f"][clean["t"] == 0].tolist(), 0.0)
    without = {}
    for k, (t, n) in sizes.items():
        part = _weigh((kept["t"] - kept[f"t{k}"]).to_numpy(float), (kept["n"] - kept[f"n{k}"]).to_numpy(float), toxic - t, rows - n)
        known_clean = clean["f"][(clean["t"] == clean[f"t{k}"]) & (clean["n"] > clean[f"n{k}"])]
        without[k] = {f: w for f, w in zip(names, part.tolist(), strict=True) if w > 0} | dict.fromkeys(known_clean.tolist(), 0.0)

    def summed(batches):
        scores: dict[int, dict[str, float]] = {k: {} for k in without}
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["toxic"].to_numpy(), "x": [summary(set(w), without[k], scores[k]) for w, k in zip(pdf["w"], pdf["fold"], strict=True)]})

    # an id that many rows repeat doesn't bring more rows to the driver
    got = found.mapInPandas(summed, "y int, x array<double>").orderBy(F.xxhash64("x", "y"), "y").limit(max_labelled).toPandas()
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), 5)
    y = got["y"].to_numpy(dtype=np.float64)
    order = np.lexsort((*x.T, y))
    return weights, fit(x[order], y[order], trees=40, depth=3)


def scored(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """``columns`` of ``docs`` with the score as ``name``."""
    channel = Channel(*character_counts(docs))
    weights, forest = train(docs, labels, channel)

    def make():
        reader, known = Reader(channel), {}

        def work(texts):
            x = np.array([summary(reader.words(t), weights, known) for t in texts], dtype=np.float64).reshape(len(texts), 5)
            return (forest.predict(x),)

        return work

    return per_text(docs, columns, f"`{name}` double", make)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (score >= 0.7).

    Null texts score as empty ones, very long ones are read whole, repeated rows
    are scored each, an empty table gives no rows, other columns are ignored.
    Without any usable label every score is 0.5.
    """
    out = scored(docs, labels, ("doc_id",), "score")
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic; columns, whatever their names, and repeated rows stay, null texts count as empty."""
    (name,) = spare(docs.columns, "toxicity")
    return scored(docs, labels, tuple(docs.columns), name).where(F.col(name) < THRESHOLD).drop(name)
