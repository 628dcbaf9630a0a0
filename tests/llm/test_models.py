import math
import random
import zlib

import numpy as np
import pytest

from chronolake.llm import embeddings, gbt, pii, quality, toxicity

from .conftest import SCHEMA, prose, rows_of


def labelled(spark, docs, **columns):
    rows = [(i, *(c[i] for c in columns.values())) for i in range(len(docs))]
    return spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{n} int" for n in columns))


# Boosted trees and quality


def test_forest_learns_and_is_flat():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    forest = gbt.fit(x[:1500], y[:1500])
    assert ((forest.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert forest.feature.shape == (60, 15) and forest.leaf.shape == (60, 16)
    assert np.allclose(gbt.fit(np.zeros((0, 4)), np.zeros(0)).predict(x[:3]), 0.5)
    one = gbt.fit(np.zeros((5, 4)), np.ones(5)).predict(np.zeros((1, 4)))
    assert one[0] > 0.8


def test_quality(spark, awkward, empty):
    texts = [prose(k, 80) if k % 4 else " ".join(f"{w}%%%" for w in prose(k, 80).upper().split()) for k in range(400)]
    docs = spark.createDataFrame(rows_of([(i, t, "s") for i, t in enumerate(texts)]), SCHEMA)
    labels = labelled(spark, texts, quality=[int(k % 4 > 0) for k in range(400)], toxic=[0] * 400)
    rows = quality.classify(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert quality.classify(awkward, labels).count() == awkward.count() and quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(awkward, labels.limit(0)).collect()} == {0.5}
    assert all(map(math.isfinite, quality.statistics(None) + quality.statistics("\n") + quality.statistics("x")))


# Toxicity

RUDE = "idiot moron loser clown".split()


@pytest.fixture(scope="module")
def rude_documents():
    r = random.Random(1)
    texts = []
    for k in range(600):
        words = prose(k, 60).split()
        if k % 3 == 0:
            words[r.randrange(60)] = r.choice(RUDE)
            words[r.randrange(60)] = r.choice(RUDE)
        texts.append(" ".join(words))
    return texts


def test_toxicity(spark, awkward, empty, rude_documents):
    hidden = ["1d10t", "m0r0n", "l0$er", "c-l-o-w-n", "idiooot", "l o s e r"]
    texts = rude_documents + [f"{prose(900 + k, 40)} {h} {prose(950 + k, 30)}" for k, h in enumerate(hidden)]
    docs = spark.createDataFrame(rows_of([(i, t, "s") for i, t in enumerate(texts)]), SCHEMA)
    labels = labelled(spark, rude_documents, toxic=[int(k % 3 == 0) for k in range(600)], quality=[1] * 600)
    rows = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    held = [r for i, r in rows.items() if r["held_out"] and i < 600]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) > 0.97
    assert all(rows[600 + k]["predicted"] for k in range(len(hidden))), [rows[600 + k]["score"] for k in range(len(hidden))]
    left = toxicity.reject(docs, labels)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, r in rows.items() if not r["predicted"]}
    out = toxicity.classify(awkward, labels).collect()
    assert len(out) == awkward.count() and not any(r["predicted"] for r in out)
    assert toxicity.classify(empty, labels).count() == 0 and {r["score"] for r in toxicity.classify(awkward, labels.limit(0)).collect()} == {0.5}


def test_lattice_decoding():
    counts = np.zeros(toxicity.CODES**3)
    for word in ("the", "idiot", "clown", "stupid", "of", "and") * 20:
        c = [0, 0, *toxicity._codes(word).tolist(), 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            counts[(a * 64 + b) * 64 + d] += 1
    channel = toxicity.Channel(counts)
    for hidden, word in {"1d10t": "idiot", "id!ot": "idiot", "c.l.o.w.n": "clown", "stuuuupid": "stupid", "$tup1d!": "stupid", "iiddiioott": "idiot", "clown,": "clown", "5678": "5678"}.items():
        assert channel.restore(hidden) == word
    for hidden in ("1d107", "!d!07", "i---d---i---o---t", "1d!0t", "iddiot"):
        assert channel.restore(hidden) == "idiot", hidden
    for hidden, word in {"a c l o w n .": "clown", "c l o w n": "clown", "i - d - i - o - t": "idiot", "i. d. i. o. t.": "idiot", "id iot": "idiot", "1d 10t": "idiot", "st up id": "stupid", "the id iot of": "idiot", "t h e i d i o t": "idiot"}.items():
        assert word in toxicity.Reader(channel).words(hidden), hidden
    assert toxicity.Reader(channel).words("the clown of and 1234 56") == {"the", "clown", "of", "and", "1234", "56"}


def test_steps_are_coded_once_and_plain_words_looked_up_together(monkeypatch):
    channel = toxicity.Channel(np.ones(toxicity.CODES**3))
    text = "wonderful readings of 1d10t, stuuuupid c l o w n and wonderful st up id"
    coded, symbols = [], toxicity._symbols
    monkeypatch.setattr(toxicity, "_symbols", lambda reading: coded.append(reading) or symbols(reading))
    assert channel.decode("1d10t") and coded
    coded.clear()
    assert channel.decode("1d10t", "0t1d") and not coded  # all runs are known by now
    reader = toxicity.Reader(channel)
    found = reader.words(text)
    assert {"wonderful", "readings"} <= reader.plain & found and not reader.plain & reader.known.keys()
    # caches that are always full change nothing
    monkeypatch.setattr(toxicity, "CACHED", 1)
    assert toxicity.Reader(toxicity.Channel(np.ones(toxicity.CODES**3))).words(text) == found
    known, weights = {}, {"=wonderful": 2.0, "^rea": 1.0}
    assert [toxicity.summary(found, weights, known) for _ in range(2)] == [toxicity.summary(found, weights, {})] * 2 and len(known) <= 1


# Personal data


def test_surrogates_are_distinct_and_never_their_own():
    s, r = pii.Surrogates(b"key"), random.Random(2)
    makers = {
        "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        "card": lambda: "".join(r.choice("0123456789") for _ in range(16)),
        "phone": lambda: f"+1 ({r.randrange(1000):03d}) 555-{r.randrange(10000):04d}",
        "email": lambda: f"{prose(r.randrange(999), 1)}.{r.randrange(100):02d}@mail{r.randrange(9)}.example.com",
        "ssn": lambda: f"{r.randrange(1000):03d}-{r.randrange(100):02d}-{r.randrange(10000):04d}",
        "surname": lambda: prose(r.randrange(999), 1).title(),
    }
    for kind, make in makers.items():
        values = {make() for _ in range(800)}
        new = {v: s.of(kind, v) for v in values}
        assert len(set(new.values())) == len(values) and all(k != v for k, v in new.items())
        assert all([c.isalpha() for c in k] == [c.isalpha() for c in v] for k, v in new.items() if kind != "ip")
        if kind == "card":
            assert all(pii.luhn(k) == pii.luhn(v) for k, v in new.items())
    for kind, names in pii.GIVEN.items():
        assert sorted(map(s.given, names)) == sorted(names) and all(s.given(n) != n for n in names), kind
    # a tiny domain is one cycle
    assert sorted(s.shift([k], [10], "x")[0] for k in range(10)) == list(range(10))


def test_anonymise(spark, awkward, empty):
    text = "Mr. Smith and Mary Jones: a.b@m.example.com, A.B@M.EXAMPLE.COM, +1 (017) 555-7713, 4111 1111 1111 1111, 240.56.125.154, DE89 3704 0044 0532 0130 00, 078-05-1120. Jones, Anna Smith, Анна. v2.0 2020-01-02"
    docs = spark.createDataFrame(rows_of([(1, text, "s"), (2, "Call +1-017-555-7713", "s"), (3, "clean 3.5 text", "s"), (4, None, "s")]), SCHEMA)
    rows = {r["doc_id"]: r for r in pii.anonymise(docs, b"k").collect()}
    new = rows[1]["text"]
    for value in ("Smith", "Jones", "Mary", "a.b@m", "555-7713", "4111 1111", "240.56.125.154", "DE89 3704", "078-05-1120", "Анна"):
        assert value not in new
    assert "v2.0 2020-01-02" in new and new.startswith("Mr. ") and rows[3]["text"] == "clean 3.5 text" and rows[4]["text"] is None
    mails = [w.strip(",").lower() for w in new.split() if "@" in w]
    assert mails[0] == mails[1] and rows[1]["n_distinct"] == rows[1]["n_surrogates"]
    digits = lambda t: "".join(c for c in t if c.isdigit())
    assert digits(rows[2]["text"]) in digits(new)
    out = pii.anonymise_documents(docs, b"k")
    assert out.columns == docs.columns and {r["doc_id"]: r["n_chars"] for r in out.collect()}[1] == len(new)
    assert pii.collisions(docs, b"k").where("n > 1").count() == 0
    values = ["DE19370400440532013000", "DE89370400440532013000", "+1 (017) 555-7713", "+1(017) 555-7713", "+10175557713", "Mary Smith", "Ann Smith met Bob Miller"]
    assert pii.collisions(spark.createDataFrame(rows_of([(k, v, "s") for k, v in enumerate(values)]), SCHEMA), b"k").where("n > 1").count() == 0
    assert pii.anonymise(awkward).where("n_entities > 0").count() == 0 and pii.anonymise(awkward).count() == awkward.count() and pii.anonymise(empty).count() == 0


def test_nothing_found_is_left(spark):
    """Entities in all sorts of surroundings, in texts of over 65,536 characters too, are gone from the output; one entity has one surrogate."""
    r = random.Random(9)
    seen = [
        "Mary.Jones@example.com", "John@corp.example.org", "anna@Mail.example.NET", "+33 6 12 34 56 78", "06 12 34 56 78", "+34 612 34 56 78", "030/1234567", "+1(017) 555-7713", "(017) 555-7713",
        "4111 1111 1111 1111", "240.56.125.154", "DE89 3704 0044 0532 0130 00", "078-05-1120", "Анна", "Δήμητρα",
    ]
    s = pii.Surrogates(b"k")
    for size in (3, 12_000):
        parts = [f"{prose(k, r.randrange(1, size))} {x}{r.choice([',', '', '.', ')'])}" for k, x in enumerate(seen * 2)]
        text = "\n".join([*parts, "Call 4155552671 now. Ann Smith met Bob Miller. Wei Zhang wrote to Priya Patel."])
        new, mentions, different, surrogates = pii.replace(text, s, {})
        for value in (*seen, "4155552671", "Ann ", "Smith", "Bob ", "Miller", "Zhang", "Priya", "Patel"):
            assert value not in new, value
        assert mentions >= 2 * len(seen) and different == surrogates
        assert len(text.split()) == len(new.split())
    for clean in ("on 01.02.2020, 2020-01-02 and v2.0 of 12345678", "Of the People. New York was here", prose(1, 100)):
        assert pii.replace(clean, s, {})[0] == clean
    assert s.of("phone", "+1 (017) 555-7713").replace(" ", "") == s.of("phone", "+1(017) 555-7713").replace(" ", "")
    valid = s.of("iban", "DE89370400440532013000")
    assert pii.mod97(valid[4:] + valid[:4]) == 1 and valid != s.of("iban", "DE19370400440532013000")


# Embeddings


def clustered(seed, groups, size, dim=48):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        c = r.normal(size=dim)
        c /= np.linalg.norm(c)
        for _ in range(size):
            e = r.normal(size=dim)
            e -= (e @ c) * c
            out.append(c + e / np.linalg.norm(e) * r.uniform(0.05, 0.3))
    return np.array(out).astype(np.float32)


def brute_links(x):
    x = x.astype(float)
    n = np.sqrt((x * x).sum(axis=1))
    near = (x @ x.T) / (n[:, None] * n) >= 0.95
    np.fill_diagonal(near, False)
    return near


def test_embeddings(spark, monkeypatch):
    x = clustered(3, 60, 8)
    x = np.concatenate((x, x[:5], x[:5], np.repeat(x[200:201], 30, axis=0)))
    rows = [(i, v.tolist(), "label", 1) for i, v in enumerate(x)]
    odd = [(9001, None, "l", 1), (9002, [0.0] * 48, "l", 1), (9003, [1.0] * 47 + [float("nan")], "l", 1), (9004, [None] + [1.0] * 47, "l", 1), (9005, [1.0, 2.0], "l", 1), (9006, [], "l", 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label string, n long")
    want = brute_links(x)
    for block in (embeddings.BLOCK, 7):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got = embeddings.near_embeddings(table).toPandas().set_index("vec_id")
        links = got.n_links.reindex(range(len(x))).to_numpy()
        assert (links <= want.sum(axis=1)).all() and links.sum() >= 0.97 * want.sum()
        assert (got.loc[9001:9006, "n_links"] == 0).all() and got.loc[9001:9006, "kept"].all()
        assert (got.kept == (got.index == got.component_id)).all() and len(got) == len(rows) + len(odd)
        assert got.component_id[len(x) - 1] == got.component_id[200] and got.n_links[len(x) - 1] >= 30
    assert embeddings.near_embeddings(table.limit(0)).count() == 0
    wide = spark.createDataFrame([(k, [1.0 + k] + [0.5] * (n - 1)) for k, n in enumerate((24, 24, 1048, 1048))], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["component_id"] for r in embeddings.near_embeddings(wide, 0.5).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    far = spark.createDataFrame([(k, [f * c for c in (1.0, 0.5, 0.25, 2.0)]) for k, f in enumerate((1.0, 1e300, 1e-300, -1.0))], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_embeddings(far).collect()} == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3)}


def test_recall_near_the_threshold():
    """Pairs of cosine 0.95 to 0.96 in 64 dimensions share a bucket nine times in ten at least."""
    r = np.random.default_rng(5)
    a = r.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e = r.normal(size=a.shape)
    e -= (e * a).sum(axis=1, keepdims=True) * a
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    c = r.uniform(0.95, 0.96, size=(1500, 1))
    x, y = embeddings.buckets(a), embeddings.buckets(c * a + np.sqrt(1 - c * c) * e)
    met = ((y == x[:, :, :1]).any(axis=2) | (x == y[:, :, :1]).any(axis=2)).any(axis=1)
    assert met.mean() >= 0.9


def test_known_clean_words_weigh_nothing():
    weights = {"^idi": 2.0, "=idiot": 3.0, "=idiom": 0.0}
    assert toxicity.summary({"idiom"}, weights, {}) == [0.0] * 5
    assert toxicity.summary({"idiotic"}, weights, {})[0] == 2.0
    assert toxicity.summary({"idiot", "idiom"}, weights, {})[:3] == [3.0, 3.0, 1.0]


def test_words_of_clean_labelled_documents_outweigh_their_beginnings(spark):
    texts = [(k, f"{prose(7000 + k, 40)} {('idiot idiots' if k % 2 else 'idiom idiosyncrasy')}", "a") for k in range(240)]
    known = spark.createDataFrame([(k, 1, k % 2) for k in range(240)], "doc_id long, quality int, toxic int")
    new = [(9000, f"{prose(8000, 40)} idiom", "a"), (9001, f"{prose(8001, 40)} idiosyncrasy", "a"), (9002, f"{prose(8002, 40)} idiot idiots", "a")]
    docs = spark.createDataFrame(rows_of(texts + new), SCHEMA)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, known).where("doc_id >= 9000").collect()}
    assert found == {9000: 0, 9001: 0, 9002: 1}
