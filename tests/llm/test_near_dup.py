import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from varlens.llm import near_dup, scratch


def plain_classes(rows):
    """class_id of each row by comparing all pairs of texts that share a shingle."""
    texts = sorted({r.text or "" for r in rows})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append(set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set())
    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    common = Counter((a, b) for own in by.values() for i, b in enumerate(own) for a in own[:i])
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = {}
    for r in rows:
        c = find(texts.index(r.text or ""))
        least[c] = min(least.get(c, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    return Counter((r.doc_id, (lambda x: None if x[0] else x[1])(least[find(texts.index(r.text or ""))])) for r in rows)


def check(docs):
    rows = near_dup.classes(docs).collect()
    want = plain_classes(docs.collect())
    assert Counter((r.doc_id, r.class_id) for r in rows) == want
    return rows


def test_documents(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_odd_texts(odd_docs):
    check(odd_docs)
    kept = near_dup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({c for _, c in plain_classes(odd_docs.collect())})


def test_empty_table(no_docs):
    assert near_dup.classes(no_docs).count() == 0
    assert near_dup.deduplicated(no_docs).count() == 0


@pytest.mark.parametrize("most", [2, 128])
def test_a_group_of_near_copies_around_the_threshold(spark, monkeypatch, most):
    """Edited copies of one text, some similar and some not: leaders alone can't tell, blocks do."""
    monkeypatch.setattr(near_dup, "MEMBERS", most)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 7)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_registers_agree_as_often_as_weighted_texts_are_similar():
    rng = np.random.default_rng(3)
    agree, want = [], []
    for _ in range(60):
        key = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))
        wa, wb = rng.integers(0, 4, 40).astype(float), rng.integers(0, 4, 40).astype(float)
        sig = [near_dup.signatures(key[w > 0], np.zeros((w > 0).sum(), np.int64), w[w > 0], 1)[0] for w in (wa, wb)]
        agree.append((sig[0] == sig[1]).mean())
        both = np.flatnonzero((wa > 0) & (wb > 0))
        want.append(sum(1 / np.maximum(wa / wa[d], wb / wb[d]).sum() for d in both))
    assert abs(np.mean(agree) - np.mean(want)) < 0.01


def test_pairs_that_differ_in_how_often_a_line_repeats_are_found(spark):
    rng = random.Random(11)
    rows = []
    for k in range(60):
        words, line = ([f"w{rng.randrange(10**9)}" for _ in range(n)] for n in ((60, 20) if k % 2 else (100, 40)))
        rows += [(2 * k, " ".join(words + line)), (2 * k + 1, " ".join(words + line * (50 if k % 2 else 100)))]
    assert {(r.doc_id, r.class_id) for r in check(spark.createDataFrame(rows, "doc_id long, text string"))} == {(k, k - k % 2) for k in range(120)}


def test_shuffled_joins_repeated_rows_and_clashing_names(spark, odd_docs, monkeypatch):
    """The branch of large tables, without broadcasts, gives the same rows; columns may be named as those in use inside."""
    docs = odd_docs.selectExpr("*", *[f"doc_id AS {c}" for c in ("node", "hash", "text_hash", "id", "many", "at", "row", "key", "kept", "comp")])
    key = lambda df: sorted(map(str, df.collect()))
    one, classes_ = key(near_dup.deduplicated(docs)), key(near_dup.classes(docs))
    monkeypatch.setattr(scratch, "MOST_ROWS", 0)
    assert one == key(near_dup.deduplicated(docs)) and classes_ == key(near_dup.classes(docs))
    assert len(one) == len(classes_) - 3  # a repeated row, and of an empty and two null texts one stays
    assert near_dup.deduplicated(docs).columns == docs.columns


@pytest.mark.parametrize("similarity, least", [(0.8, 0.99), (0.85, 0.999), (0.9, 0.9999)])
def test_recall_of_the_bands(similarity, least):
    """Pairs of a given Jaccard similarity that share a bucket: the share is that of the formula, or more."""
    rng = np.random.default_rng(4)
    n, common = 200, round(2 * 200 * similarity / (1 + similarity))
    keys = [np.sort(rng.integers(0, 2**63, 2 * n - common).astype(np.uint64)) for _ in range(400)]
    sides = []
    for cut in (slice(0, n), slice(-n, None)):
        key = np.concatenate([k[cut] for k in keys])
        sides.append(near_dup.bands(near_dup.signatures(key, np.repeat(np.arange(400), n), np.ones(len(key)), 400)))
    assert (sides[0] == sides[1]).any(1).mean() >= least


def test_equal_halves_of_two_shingles_are_not_common():
    """Sets hold whole 64-bit shingles: values that agree in 32 bits alone count as different."""
    import pyarrow as pa

    x = np.arange(1, 11, dtype=np.uint64) << np.uint64(32)
    pair = lambda a, b: pa.record_batch([pa.array([1]), pa.array([2]), pa.array([a.astype("<u8").tobytes()]), pa.array([b.astype("<u8").tobytes()])], list("abcd"))
    assert next(near_dup._similar(iter([pair(x, x)]))).num_rows == 1
    assert next(near_dup._similar(iter([pair(x, x + np.uint64(1))]))).num_rows == 0
