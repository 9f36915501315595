import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from varlens.llm import language, queries


def test_held_out_accuracy(spark, sf01):
    rows = queries.op3_language(spark, sf01).join(spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(odd_docs):
    filters = language.fit(odd_docs, queries.id_remainder(5) != 9)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.predict(odd_docs, filters).collect()}
    assert language.predict(odd_docs, filters).count() == odd_docs.count()
    for (_, text), (lang, score) in got.items():
        if not text or not any(map(str.isalpha, text)):
            assert (lang, score) == ("und", 0.0)
        else:
            assert lang in filters.langs


def test_nothing_to_learn_and_empty(odd_docs, no_docs):
    assert language.fit(no_docs, queries.id_remainder(5) != 0) is None
    assert {r.lang_pred for r in language.predict(odd_docs, None).collect()} == {"und"}
    assert language.predict(no_docs, language.fit(odd_docs, queries.id_remainder(5) != 9)).count() == 0


def plain(docs, held_out, texts):
    """Predictions by sets of n-grams, without filters: (language, share) of each text."""
    grams = lambda t: [tuple(low[k : k + 4]) for low in [bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in (t or "").encode().lower())] for k in range(len(low) - 3) if low[k + 1 : k + 3] != b"  "]
    by, size = {}, Counter()
    for r in docs:
        if r.lang is not None and not held_out(r):
            size[r.lang] += 1
            by.setdefault(r.lang, Counter()).update(set(grams(r.text)))
    typical = {l: {g for g, n in c.items() if n >= max(1, language.SHARE * size[l])} for l, c in by.items()}
    out = []
    for t in texts:
        g = grams(t)
        count = {l: sum(x in typical[l] for x in g) for l in sorted(typical)}
        best = max(count, key=lambda l: (count[l], [-ord(c) for c in l]))
        out.append((best, count[best] / max(1, sum(count.values()))) if any(map(str.isalpha, t or "")) else ("und", 0.0))
    return out


def test_predictions_equal_plain_sets(spark, sf01):
    """The query against n-gram sets looked up one by one: corrected popcounts stand for the true counts."""
    docs = spark.read.parquet(f"{sf01}/documents.parquet").orderBy("doc_id").collect()
    want = plain(docs, lambda r: zlib.crc32(str(r.doc_id).encode()) % 5 == 0, [r.text for r in docs])
    rows = {r.doc_id: r for r in queries.op3_language(spark, sf01).collect()}
    for r, (lang, share) in zip(docs, want):
        assert rows[r.doc_id].lang_pred == lang and abs(rows[r.doc_id].score - share) < 0.02


def test_more_languages_than_bits_of_a_word(spark):
    """150 invented languages, each with an alphabet of its own, some with as few as one document."""
    alphabet = [chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) for k in range(150)]
    rows = [(1000 * k + j, " ".join((a * (2 + (i + j) % 3) for i in range(12))), f"l{k:03d}") for k, a in enumerate(alphabet) for j in range(1 + k % 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.fit(docs, F.lit(True))
    assert len(filters.langs) == 150 and filters.table.shape[1] == 3
    assert all(r.lang_pred == r.lang and r.score > 0.9 for r in language.predict(docs, filters).collect())


def test_repeated_rows_and_ties(spark):
    docs = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a"), (2, "same words here", "a")], "doc_id long, text string, lang string")
    got = language.predict(docs, language.fit(docs, F.lit(True))).collect()
    assert [r.lang_pred for r in got] == ["a"] * 3 and len({r.score for r in got}) == 1  # of equal ones the first by name


def test_one_lookup_gives_all_languages_of_a_gram():
    g = np.array([0x61626364, 0x62636465], np.uint32)
    table = np.zeros(language.ROWS, np.uint64)
    for p in language.positions(g[:1]):
        table[p] |= np.uint64(0b101)
    for p in language.positions(g[1:]):
        table[p] |= np.uint64(0b010)
    found = np.full(2, np.uint64(2**64 - 1))
    for p in language.positions(g):
        found &= table[p]
    assert found.tolist() == [0b101, 0b010]
    assert [language.bit(found, i).tolist() for i in range(3)] == [[1, 0], [0, 1], [1, 0]]


def test_grams_are_those_of_the_bytes():
    raw = "Ab1 é, xyz".encode()
    g, doc = language.grams(np.frombuffer(raw, np.uint8), np.array([0, 4, len(raw)]))
    low = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in raw.lower())
    want = [(int.from_bytes(low[k : k + 4], "big"), d) for a, b, d in ((0, 4, 0), (4, len(raw), 1)) for k in range(a, b - 3) if low[k + 1 : k + 3] != b"  "]
    assert list(zip(g.tolist(), doc.tolist())) == want
