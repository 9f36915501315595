import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from varlens.llm import hmm, queries


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def base(rows, held):
    count = Counter(w for r in rows if not held(r) for w in words(r.text))
    n, v = sum(count.values()), len(count)
    return {(r.doc_id, r.text): (len(words(r.text)), sum(count[w] > 0 for w in words(r.text)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(r.text))) for r in rows}


def test_base_scores_and_better_held_out(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet").collect()
    want = base(docs, lambda r: zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    want = {k[0]: v for k, v in want.items()}
    rows = queries.op9_hidden_markov(spark, sf01).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and abs(r.base_score - want[r.doc_id][3]) < 1e-6
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.96 * sum(r.base_score for r in held)


def test_small_head_gives_the_same_sums(spark, sf_dir, monkeypatch):
    """With nearly all words in the joined table instead of the tasks' head, base sums stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = {r.doc_id: r for r in hmm.score(docs, queries.id_remainder(7) != 2).collect()}
    monkeypatch.setattr(hmm, "HEAD", 50)
    for r in hmm.score(docs, queries.id_remainder(7) != 2).collect():
        assert (r.n_tokens, r.n_known) == (one[r.doc_id].n_tokens, one[r.doc_id].n_known) and abs(r.base_score - one[r.doc_id].base_score) < 1e-6


def model(rng):
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(norm(rng.random(hmm.STATES), 0), norm(rng.random((hmm.STATES, hmm.STATES)), 1), norm(rng.random((hmm.CLASSES, hmm.STATES)), 0))


def batch(seqs):
    raw = [np.array(s, "<u2").tobytes() for s in seqs]
    return pa.record_batch([pa.array(raw, pa.binary())], ["classes"])


def test_forward_equals_the_sum_over_state_paths():
    rng = np.random.default_rng(1)
    m = model(rng)
    seqs = [rng.integers(0, hmm.CLASSES, n) for n in (3, 1, 4)]
    want = []
    for s in seqs:
        total = 0.0
        for path in np.ndindex(*[hmm.STATES] * len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.step[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
        want.append(np.log10(total))
    got = np.zeros(3)
    for rows, cls, alive, first in hmm.chunks(batch(seqs)):
        scale, _ = hmm.forward(m, cls, alive, first, False)
        text = np.concatenate([np.arange(n) for n in alive])
        got[rows] = np.bincount(text, weights=np.log10(scale))
    assert np.allclose(got, want)


def test_baum_welch_counts_equal_those_of_plain_posteriors():
    rng = np.random.default_rng(2)
    m, seqs = model(rng), [rng.integers(0, 5, n) for n in (4, 2, 1)]
    start, step, emit = np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros((hmm.CLASSES, hmm.STATES))
    for s in seqs:
        n = len(s)
        a, b = np.zeros((n, hmm.STATES)), np.ones((n, hmm.STATES))
        a[0] = m.start * m.emit[s[0]]
        for t in range(1, n):
            a[t] = a[t - 1] @ m.step * m.emit[s[t]]
        for t in range(n - 2, -1, -1):
            b[t] = m.step @ (m.emit[s[t + 1]] * b[t + 1])
        z = a[-1].sum()
        start += a[0] * b[0] / z
        for t in range(n):
            emit[s[t]] += a[t] * b[t] / z
            if t + 1 < n:
                step += a[t][:, None] * m.step * (m.emit[s[t + 1]] * b[t + 1])[None] / z
    got = next(iter(hmm._expect(m)(iter([batch(seqs)]))))
    sums = np.zeros(hmm.STATES * (1 + hmm.STATES + hmm.CLASSES) + 1)
    sums[np.asarray(got.column(0))] = np.asarray(got.column(1))
    assert np.allclose(sums[:-1], np.concatenate([start, step.ravel(), emit.ravel()]))


def test_words_of_a_class_share_its_probability(spark, sf_dir):
    lex = hmm.count_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.lit(True))
    tail = lex.words[hmm.OWN :] & np.uint64(hmm.TAIL - 1)
    known = np.bincount(tail.astype(int), weights=lex.counts[hmm.OWN :] + 1, minlength=hmm.TAIL)
    assert np.allclose((known + 1) / (lex.tail_tokens + lex.tail_words + 1), 1)


def test_odd_rows(odd_docs, no_docs):
    rows = hmm.score(odd_docs, F.lit(True)).collect()
    want = base(odd_docs.collect(), lambda r: False)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == sorted((want[r.doc_id, r.text][0], want[r.doc_id, r.text][1], round(want[r.doc_id, r.text][3], 6)) for r in odd_docs.collect())
    assert all(np.isfinite(r.score) for r in rows)
    assert hmm.score(no_docs, F.lit(True)).count() == 0
    assert all(np.isfinite(r.score) and r.n_known == 0 for r in hmm.score(odd_docs, F.lit(False)).collect())
