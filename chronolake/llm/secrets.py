"""Secret scans: credential patterns and a randomness test battery, with built-in functions only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fence

#: Pattern, group whose length counts, least length; in the order in which kinds are listed.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Runs that may be encoded random bytes; shorter ones carry too little evidence for any test.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Encodings from the narrowest alphabet to the widest.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: All symbols of a token, in either case.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789+/-_="
#: Words that the model of structured text is learned from, if they occur more than once.
LEARNED = r"[a-z0-9+/_=-]{4,}"
#: Share of structured tokens among those reported, and of random tokens that the battery may reject.
FALSE_DISCOVERY, REJECTED = 0.05, 0.01
#: Before any word is seen, a symbol is followed by one of its group (letters, digits, marks) so often; this counts as so many words.
STAY, PRIOR = 0.85, 10.0
#: Matches of a text whose positions are summed up together.
CHUNK = 256


_NO_SPANS = "cast(array() as array<struct<start:int,end:int,kind:string,value:string>>)"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, end, kind, value) of the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches themselves give every position:
    a match starts where all pieces up to it and all matches before it end.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("found"), values.alias("value"))

    def step(acc, part):
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["found"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    def placed(acc, chunk):
        return F.struct((acc["at"] + chunk["at"]).alias("at"), F.concat(acc["offsets"], F.array(acc["at"])).alias("offsets"))

    zero = F.struct(F.lit(0).alias("at"), F.expr(_NO_SPANS).alias("spans"))
    firsts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(CHUNK))
    chunks = F.transform(firsts, lambda i: F.aggregate(F.slice(parts, i, CHUNK), zero, step))

    def joined(chunks):
        offsets = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("offsets")), placed)["offsets"]
        moved = F.zip_with(chunks, offsets, lambda c, o: F.transform(c["spans"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
        return F.filter(F.flatten(moved), lambda s: F.length(s["value"]) >= least)

    # through a list of one, so that the chunks are worked out once
    spans = F.flatten(F.transform(F.array(chunks), joined))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(_NO_SPANS))


def structure(docs: DataFrame) -> str:
    """Costs -ln P(b | a) of a symbol after another, case aside, in words that occur at least twice, over all texts, as a list in text form.

    Words are counted first, so that random tokens, which don't recur, teach the
    model nothing; one number for each pair of SYMBOLS reaches the driver.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(LEARNED), F.lit(0))).alias("w"))
    words = words.groupBy("w").agg(F.count("*").alias("n")).where("n >= 2")
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substr("w", i, F.lit(2)))).alias("ab"), "n")
    groups = [SYMBOLS[:26], SYMBOLS[26:36], SYMBOLS[36:]]
    own = {a: g for g in groups for a in g}
    seen = [[PRIOR * (STAY / len(own[a]) if b in own[a] else (1 - STAY) / (len(groups) - 1) / len(own[b])) for b in SYMBOLS] for a in SYMBOLS]
    for r in pairs.groupBy("ab").agg(F.sum("n").alias("n")).collect():
        seen[SYMBOLS.index(r["ab"][0])][SYMBOLS.index(r["ab"][1])] += r["n"]
    return ",".join(f"{-log(n / sum(row)):.4f}" for row in seen for n in row)


def _tail(z: Column) -> Column:
    """Two-sided normal tail of z, by a logistic approximation (Bowling and others, 2009)."""
    a = F.least(F.abs(z), F.lit(30.0))
    return 2 / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a))


def _with_p(candidates: Column, costs: str) -> Column:
    """Spans with ``random``, the battery's p-value, ``p`` against structured text, and ``class``, the log2 of the length.

    The encoding is the narrowest whose alphabet holds every symbol. The battery
    tests its symbol values for uniform frequencies (chi-squared, by the
    cube-root normal approximation, both tails), for runs above and below the
    middle, and for correlation with the next symbol; ``random`` is three times
    the least p-value. ``p`` is for the hypothesis that the token, case aside,
    comes from the model of structured text: the likelihood ratio of uniform
    symbols to that model has an expectation of 1 under it, so its inverse, times
    the number of encodings tried, is a valid p-value whatever the length.
    """
    alphabet = lambda v: F.coalesce(*(F.when(v.rlike(f"^[{a.replace('-', chr(92) + '-')}]+$"), F.lit(a)) for _, a in ENCODINGS), F.lit(ENCODINGS[-2][1] + "-_"))
    core = F.transform(candidates, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_replace(s["value"], "=+$", "").alias("v")))
    core = F.filter(core, lambda s: (F.length(s["v"]) >= 20) & s["v"].rlike("[A-Za-z]"))
    core = F.transform(core, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["v"].alias("v"), alphabet(s["v"]).alias("a")))
    places = lambda v, a: F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.position(F.substr(v, i, F.lit(1)), a).cast("double") - 1)
    core = F.transform(
        core,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.length(s["a"]).cast("double").alias("k"), places(s["v"], s["a"]).alias("x"), places(F.lower(s["v"]), F.lit(SYMBOLS)).alias("y")
        ),
    )
    # symbols of the encoding, case aside, by its size
    folded = F.create_map(*(F.lit(float(x)) for size, f in {len(a): len(set(a.lower())) for _, a in (*ENCODINGS, ("", ENCODINGS[-2][1] + "-_"))}.items() for x in (size, f)))
    cost = F.split(F.lit(costs), ",").cast("array<double>")

    def total(values, f):
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + f(v))

    def follow(x):
        return F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x) - 1).alias("b"))

    def measured(s):
        x, k, n = s["x"], s["k"], F.size(s["x"]).cast("double")
        mid, var = (k - 1) / 2, (k * k - 1) / 12
        squares = total(F.sequence(F.lit(0), k.cast("int") - 1), lambda a: F.pow(F.size(F.filter(x, lambda v: v == a)).cast("double"), 2.0))
        ups = total(x, lambda v: (v > mid).cast("double"))
        turns = total(follow(x), lambda f: ((f["a"] > mid) != (f["b"] > mid)).cast("double"))
        serial = total(follow(x), lambda f: (f["a"] - mid) * (f["b"] - mid)) / ((n - 1) * var)
        ratio = total(follow(s["y"]), lambda f: F.get(cost, (f["a"] * len(SYMBOLS) + f["b"]).cast("int"))) - (n - 1) * F.log(folded[k])
        found = {"start": s["start"], "end": s["end"], "k": k, "n": n, "chi": squares * k / n - n, "up": ups, "turns": turns, "serial": serial, "ratio": ratio}
        return F.struct(*(v.alias(c) for c, v in found.items()))

    def judged(s):
        n, up, df = s["n"], s["up"], s["k"] - 1
        z_chi = (F.pow(F.greatest(s["chi"], F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        mean = 2 * up * (n - up) / n
        z_runs = F.when((up > 0) & (up < n) & (mean > 1), (s["turns"] - mean) / F.sqrt(mean * (mean - 1) / (n - 1))).otherwise(30.0)
        random = F.least(F.lit(1.0), 3 * F.least(_tail(z_chi), _tail(z_runs), _tail(s["serial"] * F.sqrt(n - 1))))
        p = F.least(F.lit(1.0), len(ENCODINGS) * F.exp(F.greatest(-s["ratio"], F.lit(-700.0))))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), random.alias("random"), p.alias("p"), F.floor(F.log2(n)).cast("int").alias("class"))

    return F.transform(F.transform(core, measured), judged)


def _limits(found: DataFrame, rate: float) -> dict[int, float]:
    """For each length class the largest p-value that is a discovery of something that isn't structured.

    Benjamini-Hochberg within a class, over p-values rounded up to one of 200
    steps a decade; a class and step is one row, whatever the input's size.
    """
    step = F.ceil(F.log10(F.greatest(F.col("c.p"), F.lit(1e-30))) * 200).cast("int").alias("step")
    counted = found.select(F.explode("candidates").alias("c")).groupBy(F.col("c.class").alias("class"), step).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("class").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("rank", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("class")))
    passed = ranked.where(F.pow(F.lit(10.0), F.col("step") / 200) <= rate * F.col("rank") / F.col("all")).groupBy("class").agg(F.max("step").alias("step"))
    return {r["class"]: 10.0 ** (r["step"] / 200) for r in passed.collect()}


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY, rejected: float = REJECTED) -> DataFrame:
    """One row per document: doc_id, ``base`` and ``spans``, arrays of (start, order, end, kind) by start and kind.

    Base spans are those of KINDS; ``spans`` also holds kind "random": tokens
    clear of base spans that are discoveries against the model of structured
    text, with the false ones among them controlled at ``rate`` in each length
    class, and that the battery doesn't reject at ``rejected``. Null texts are
    empty, very long ones are read whole, repeated rows are judged each, an empty
    table gives no rows, other columns are ignored. The text is read twice, for
    the model and for the spans; only a number for each pair of symbols and each
    length class reaches the driver.
    """
    text = F.coalesce("text", F.lit(""))
    base = [_spans(text, kind, *rest) for kind, rest in KINDS.items()]
    order = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int")
    plain = F.transform(F.concat(*base), lambda s: F.struct(s["start"].alias("start"), order(s).alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    found = fence(docs.select("doc_id", F.array_sort(plain).alias("base"), _with_p(_spans(text, "random", TOKEN, 0, 20), structure(docs)).alias("candidates")))
    limits = _limits(found, rate)
    table = F.create_map(*(F.lit(y) for k, v in sorted(limits.items()) for y in (k, v))) if limits else F.expr("map(-1, 0D)")
    taken = lambda c: F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    random = F.filter("candidates", lambda c: (c["p"] <= F.coalesce(table[c["class"]], F.lit(-1.0))) & (c["random"] > rejected) & ~taken(c))
    added = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS) + 1).alias("order"), c["end"].alias("end"), F.lit("random").alias("kind")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find_secrets: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = map(count, KINDS)
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
