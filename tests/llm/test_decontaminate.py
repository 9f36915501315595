import itertools
import random

import numpy as np
import pytest

from varlens.llm import decontaminate as d
from varlens.llm import scratch

WORDS = [f"w{k}" for k in range(4000)]


def text(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def tables(spark):
    rng = random.Random(1)
    items = [text(rng, n) for n in (15, 20, 40, 60, 9)]
    docs, want = [], set()
    for k in range(80):
        words = text(rng, 80)
        if k % 4 == 0:
            item = k // 4 % 4
            passage = list(items[item])
            if k % 8 == 0:  # one word in eight replaced
                for at in range(rng.randrange(8), len(passage), 8):
                    passage[at] = "other"
            words[30:30] = [w.upper() + "," if k % 16 == 0 else w for w in passage]
            want.add((k, item))
        docs.append((k, " ".join(words)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"), want


def test_passages_with_substitutions(spark):
    docs, items, want = tables(spark)
    rows = d.overlaps(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert all(r.n_equal >= min(d.LEAST_EQUAL, r.item_tokens) and r.n_equal >= 0.8 * r.n_tokens for r in rows)
    assert all(r.first_token >= 25 for r in rows)
    assert {r.doc_id for r in d.decontaminated(docs, items).collect()} == {k for k in range(80)} - {k for k, _ in want}


def test_exact_passages_of_documents(spark, sf01):
    """Every 12-gram that a document and an item share is found, as brute force finds it."""
    docs, items = spark.read.parquet(f"{sf01}/documents.parquet"), spark.read.parquet(f"{sf01}/benchmark.parquet")
    import re

    split = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for r in items.collect():
        w = split(r.text)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(r.item_id)
    want = {(r.doc_id, i) for r in docs.collect() for w in [split(r.text)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    assert {(r.doc_id, r.item_id) for r in d.overlaps(docs, items).collect()} == want


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, "plain words for everyone here and some more of it to fill"), (4, "A short text of nine plain words for everyone HERE")], "item_id long, text string")
    rows = d.overlaps(odd_docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 4)}  # whole, though short
    assert d.overlaps(no_docs, items).count() == 0 and d.overlaps(odd_docs, items.limit(0)).count() == 0
    kept = d.decontaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.where("doc_id IS NULL OR doc_id <> 1").count()


@pytest.mark.parametrize("tokens, others", [(12, 0), (13, 1), (14, 2), (15, 3), (20, 4), (25, 5)])
def test_masks_see_every_placement_of_substitutions(tokens, others):
    """The least stretches that count; longer ones hold one of these (30 tokens and more: a half with three others at most)."""
    equal = np.array([(1 << tokens) - 1 - sum(1 << x for x in c) for c in itertools.combinations(range(tokens), others)])
    seen = np.zeros(len(equal), bool)
    for mask in d.MASKS:
        bits = sum(1 << k for k, c in enumerate(mask) if c == "1")
        for at in range(tokens - len(mask) + 1):
            seen |= (equal & (bits << at)) == bits << at
    assert seen.all()


def plain_overlap(same):
    """By all stretches: the most equal tokens, of several the shortest, then the first."""
    best = (0, 0, 0)
    for i in range(len(same)):
        for j in range(i + 1, len(same) + 1):
            n = sum(same[i:j])
            if n and 5 * n >= 4 * (j - i) and (n, i - j, -i) > (best[0], -best[1], -best[2]):
                best = (n, j - i, i)
    return best


def test_overlap_equals_a_search_of_all_stretches():
    rng = np.random.default_rng(5)
    for k in range(300):
        same = rng.random(rng.integers(1, 45)) < (0.3, 0.6, 0.75, 0.85)[k % 4]
        x = np.arange(len(same))
        assert d.overlap(x, np.where(same, x, -1)) == plain_overlap(same.tolist()), same.tolist()


def test_random_substitutions_equal_brute_force(spark):
    """Passages of many lengths and rates, short items among them, against all diagonals of all pairs: recall is 1 at every rate."""
    rng = random.Random(3)
    items = [text(rng, n) for n in (1, 2, 3, 4, 5, 6, 8, 9, 11, 12, 15, 20, 25, 40, 90)]
    docs = [list(items[0]), list(items[2]), [*items[1], "more"]]
    for k in range(240):
        item = items[3 + k % 12]
        rate = (0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.5)[k % 8]
        docs.append([*text(rng, rng.randrange(30)), *(rng.choice(WORDS) if rng.random() < rate else w for w in item), *text(rng, rng.randrange(30))])
    want = set()
    for i, x in enumerate(docs):
        for j, y in enumerate(items):
            if len(y) < d.FREE:
                if x == y:
                    want.add((i, j))
                continue
            for at in range(1 - len(y), len(x)):
                a, b = max(0, at), min(len(x), at + len(y))
                if plain_overlap([p == q for p, q in zip(x[a:b], y[a - at :])])[0] >= min(d.LEAST_EQUAL, len(y)):
                    want.add((i, j))
    table = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], f"{name} long, text string")
    assert {(r.doc_id, r.item_id) for r in d.overlaps(table(docs, "doc_id"), table(items, "item_id")).collect()} == want
    assert len(want) > 120


def test_a_short_stretch_is_not_hidden_by_a_long_poor_one(spark):
    """60 equal tokens in a row, then 340 of which 70 % are equal: all in all under 80 %."""
    rng = random.Random(8)
    item = text(rng, 400)
    doc = [w if k < 60 or k % 10 < 7 else "other" for k, w in enumerate(item)]
    rows = d.overlaps(spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert len(rows) == 1 and rows[0].n_equal >= 60 and rows[0].n_equal >= 0.8 * rows[0].n_tokens


def test_short_items(spark):
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Yes"), (3, "no way out")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so what is the capital of france then"), (2, "yes it is"), (3, "YES!"), (4, "no way"), (5, "No way out."), (6, "what is the capital of Spain")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.overlaps(docs, items).collect()} == {(1, 1), (3, 2), (5, 3)}


def test_shuffled_joins_and_clashing_names(spark, monkeypatch):
    """Without broadcasts, and with columns named as the ones in use inside, rows stay the same."""
    docs, items, want = tables(spark)
    docs = docs.selectExpr("*", *[f"doc_id AS {c}" for c in ("node", "hash", "text_hash", "id", "many", "at", "row", "key")])
    keep = d.decontaminated(docs, items)
    one = sorted(map(tuple, keep.collect()))
    monkeypatch.setattr(scratch, "MOST_ROWS", 0)
    assert one == sorted(map(tuple, d.decontaminated(docs, items).collect())) and keep.columns == docs.columns
    assert len(one) == 80 - len({k for k, _ in want})


def test_overlap():
    x = np.arange(30)
    y = x.copy()
    y[[5, 20]] = -1
    assert d.overlap(x, y) == (28, 30, 0)
    y[:12] = -1
    assert d.overlap(x, y) == (17, 18, 12)
