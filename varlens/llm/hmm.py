"""A hidden Markov language model over word classes.

The OWN most frequent words are classes of their own; the others fall into TAIL classes by hash, within
which a word has its share of the counts. States emit classes, so a text's probability is the forward
sum over states times each word's share of its class: exact, and normalised over all words, one
unseen word a class included. Baum-Welch counts are made where the texts are, summed by Spark, and
re-estimate a model of fixed size. Counts of all words stay a table; only the HEAD most frequent ones go
to every task, the rest meets the table in a join.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import LOWER, Hasher, Lookup, blocks, mix, ranges, word_spans

STATES, OWN, TAIL, HEAD = 6, 8192, 1024, 1 << 18
CLASSES = OWN + TAIL + 1  # the last is the end of a text
END = CLASSES - 1
#: Rounds go over all training texts until one lifts their log10 likelihood by less than this for each token. That
#: can't be lifted for ever, so they end; their number follows the texts.
LEAST_GAIN = 0.0005
#: Texts, the lowest by hash, from which the states' starting points are picked; all that is counted is from all texts.
SAMPLE = 300
PRIOR, SEED = 200.0, 11
#: The end token's key among word hashes.
END_KEY = int(mix(np.full(1, 0xE0D, np.uint64))[0].view(np.int64))
CHUNK = 300_000


def lower_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and each text's first one."""
    low = LOWER[buf]
    ws, we, wo = word_spans(low, off)
    return Hasher(low)(ws, we), wo


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def merged(held):
        h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        key, of = np.unique(h, return_inverse=True)
        return key, np.bincount(of, weights=n, minlength=len(key)).astype(np.int64)

    held, size = [], 0
    for batch in batches:
        for lo, hi, buf, off in blocks(batch, "text"):
            h, _ = lower_words(buf, off)
            held.append(np.unique(h, return_counts=True))
            held.append((np.array([END_KEY]).view(np.uint64), np.array([hi - lo])))
            size += len(held[-2][0])
            if size > 1 << 19:
                key, n = merged(held)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n)], ["word", "n"])
                held, size = [], 0
    if held:
        key, n = merged(held)
        yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n)], ["word", "n"])


@dataclass
class Lexicon:
    """The counts of all training tokens as a table (word, n), and what every task needs of them."""

    table: DataFrame
    tokens: int
    distinct: int
    ends: int
    words: np.ndarray  # of the HEAD most frequent words, by falling count
    counts: np.ndarray
    tail_tokens: np.ndarray  # tokens and distinct words of each tail class
    tail_words: np.ndarray


def count_words(docs: DataFrame, training: Column) -> Lexicon:
    table = docs.where(training).select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    table = written(table, "word-counts")
    tokens, distinct, ends = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END_KEY, F.col("n"))), F.lit(0))).first()
    words = table.where(F.col("word") != END_KEY)
    bin_ = F.floor(F.log2("n") * 64)  # at most 64 * 64 bins
    bins, least, held = sorted(((r.b, r.k) for r in words.groupBy(bin_.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True), 2**31, 0
    for b, k in bins:  # whole bins, the most frequent first, as long as they fit in HEAD
        held += k
        if held > HEAD:
            break
        least = b
    head = words.where(bin_ >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    key, n = head["word"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64)
    total, kinds = np.zeros(TAIL), np.zeros(TAIL)
    for r in words.groupBy(F.col("word").bitwiseAND(F.lit(TAIL - 1)).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        total[r.c], kinds[r.c] = r.n, r.k
    own = (key[:OWN] & np.uint64(TAIL - 1)).astype(int)
    total -= np.bincount(own, weights=n[:OWN], minlength=TAIL)
    kinds -= np.bincount(own, minlength=TAIL)
    return Lexicon(table, tokens, distinct, ends, key, n, total, kinds)


ENCODED = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, share double, classes binary, tail array<long>"


def encode(docs: DataFrame, held_out: Column, lex: Lexicon) -> DataFrame:
    """Each text's classes, its sums over end and head words, and the words that aren't in the head."""
    words, counts, tail_tokens, tail_words, tokens, distinct, ends = lex.words, lex.counts, lex.tail_tokens, lex.tail_words, lex.tokens, lex.distinct, lex.ends
    rest = np.log10(tail_tokens + tail_words + 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(words, 21)
        base = np.log10((counts + 1) / (tokens + distinct + 1))
        kind = (words & np.uint64(TAIL - 1)).astype(np.int64)
        share = np.log10(counts + 1) - rest[kind]
        share[:OWN] = 0.0
        head_class = np.where(np.arange(len(words)) < OWN, np.arange(len(words)), OWN + kind).astype("<u2")
        end_base = np.log10((ends + 1) / (tokens + distinct + 1))
        for batch in batches:
            for lo, hi, buf, off in blocks(batch, "text"):
                h, wo = lower_words(buf, off)
                at = find(h)
                known = at >= 0
                cls = (OWN + (h & np.uint64(TAIL - 1)).astype(np.int64)).astype("<u2")
                cls[known] = head_class[at[known]]
                sums = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(np.where(known, v[at], 0.0) if len(v) else np.zeros(len(at)))])[wo])
                n = np.diff(wo)
                cls = np.insert(cls, wo[1:], END)
                upto = np.concatenate([[0], np.cumsum(2 * (n + 1))]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(upto), pa.py_buffer(cls.tobytes())])
                far = np.flatnonzero(~known)
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(far, wo), pa.int32()), pa.array(h[far].view(np.int64)))
                seen = np.diff(np.concatenate([[0], np.cumsum(known)])[wo]) + (ends > 0)
                cols = [*(batch.column(k)[lo:hi] for k in range(3)), *map(pa.array, (n + 1, seen, sums(base) + end_base, sums(share))), binary, tail]
                yield pa.record_batch(cols, [x.split()[0] for x in ENCODED.split(", ")])

    rows = docs.select("doc_id", held_out.alias("held_out"), F.monotonically_increasing_id().alias("row"), "text")
    return written(rows.mapInArrow(task, ENCODED), "encoded")


@dataclass
class Model:
    start: np.ndarray  # [STATES]
    step: np.ndarray  # [STATES, STATES]
    emit: np.ndarray  # [CLASSES, STATES]


def chunks(batch: pa.RecordBatch):
    """Texts of like length together: (rows, classes by time, texts at each time, first place of each time)."""
    col = batch.column(batch.schema.get_field_index("classes"))
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) // 2
    cls = np.frombuffer(col.buffers()[2], "<u2")
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(size[order[lo:]]), CHUNK, "right")))
        rows = order[lo:hi]
        length = size[rows]  # falling
        alive = np.searchsorted(-length, -np.arange(length[0]), "left")  # texts longer than t
        first = np.concatenate([[0], np.cumsum(alive)])
        at = np.repeat(np.arange(length[0]), alive) + off[rows][ranges(np.zeros(len(alive), np.int64), alive)]
        yield rows, cls[at].astype(np.int64), alive, first
        lo = hi


def forward(m: Model, cls: np.ndarray, alive: np.ndarray, first: np.ndarray, keep: bool):
    """Scaled forward recursion: each place's scale, and with keep each place's state probabilities."""
    seen = m.emit[cls]
    scale = np.empty(len(cls))
    alpha = seen if keep else None
    a = None
    for t in range(len(alive)):
        i, j = first[t], first[t + 1]
        a = seen[i:j] * (m.start if a is None else a[: j - i] @ m.step)
        s = a.sum(1)
        a /= s[:, None]
        scale[i:j] = s
        if keep:
            alpha[i:j] = a
    return scale, alpha


def _expect(m: Model):
    """Baum-Welch counts of a partition, as rows (k, n): k numbers the entries of start, step and emit."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, step, emit, total = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES)), 0.0
        for batch in batches:
            for _, cls, alive, first in chunks(batch):
                scale, alpha = forward(m, cls, alive, first, True)
                total += np.log10(scale).sum()
                reach = m.emit[cls] / scale[:, None]  # becomes emission times backward value over scale
                gamma = np.empty_like(alpha)
                for t in range(len(alive) - 1, -1, -1):
                    i, j = first[t], first[t + 1]
                    g = gamma[i:j]
                    g[:] = alpha[i:j]
                    if t + 1 < len(alive):
                        k, l = first[t + 1], first[t + 2]
                        back = reach[k:l] @ m.step.T
                        g[: l - k] *= back
                        reach[i : i + l - k] *= back
                start += gamma[: first[1]].sum(0)
                later = np.arange(first[1], len(cls))
                if len(later):
                    t = np.repeat(np.arange(1, len(alive)), alive[1:])
                    step += m.step * (alpha[later - first[t] + first[t - 1]].T @ reach[later])
                for s in range(STATES):
                    emit[:, s] += np.bincount(cls, weights=gamma[:, s], minlength=CLASSES)
        all_ = np.concatenate([start, step.ravel(), emit.ravel(), [total]])
        k = np.flatnonzero(all_)
        yield pa.record_batch([pa.array(k), pa.array(all_[k])], ["k", "n"])

    return task


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, class, n) of each text's frequent words: as many rows as there are such classes at most."""
    for batch in batches:
        for row, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            n = np.bincount(np.frombuffer(raw.as_buffer(), "<u2"), minlength=CLASSES)[:OWN]
            c = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(c), row)), pa.array(c), pa.array(n[c])], ["row", "c", "n"])


def first_model(rows: DataFrame, usual: np.ndarray) -> Model:
    """States that start half at the usual class shares and half at those of far-apart texts of a bounded sample.

    What comes to the driver is counts, SAMPLE * OWN of them at most, and no text.
    """
    picked = [r.row for r in rows.where("n_tokens >= 20").select("h", "row").orderBy(F.xxhash64("h", F.lit(SEED)), "row").limit(SAMPLE).collect()]
    at = {row: i for i, row in enumerate(sorted(picked))}
    shares = np.zeros((max(1, len(picked)), CLASSES))
    if picked:
        for r in rows.where(F.col("row").isin(picked)).select("row", "classes").mapInArrow(_shares, "row long, c long, n long").toLocalIterator():
            shares[at[r.row], r.c] = r.n
    unit = np.sqrt(shares / np.maximum(1, shares.sum(1, keepdims=True)))
    picked = [0]
    near = unit @ unit[0]
    while len(picked) < STATES:  # each next one is the least like those before
        picked.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[picked[-1]])
    like = unit @ unit[picked].T
    group = like.argmax(1)
    emit = np.stack([shares[group == s].sum(0) + 1e-9 for s in range(STATES)], 1)
    emit = 0.5 * usual[:, None] + 0.5 * emit / emit.sum(0)
    step = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
    return Model(np.full(STATES, 1 / STATES), step, emit / emit.sum(0))


def again(rows: DataFrame, m: Model, usual: np.ndarray) -> tuple[Model, float]:
    """One Baum-Welch round; the counts that come to the driver are as many as the model has entries."""
    sums = np.zeros(STATES * (1 + STATES + CLASSES) + 1)
    for r in rows.select("classes").mapInArrow(_expect(m), "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas().itertuples():
        sums[r.k] = r.n
    if not sums.any():  # no texts
        return m, 0.0
    start, step, emit = sums[:STATES], sums[STATES : STATES * (1 + STATES)].reshape(STATES, STATES), sums[STATES * (1 + STATES) : -1].reshape(CLASSES, STATES)
    start, step, emit = start + 1, step + 1, emit + PRIOR * usual[:, None]
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0)), float(sums[-1])


def fit(encoded: DataFrame, lex: Lexicon) -> Model:
    usual = np.ones(CLASSES)
    usual[: min(OWN, len(lex.counts))] += lex.counts[:OWN]
    usual[OWN:END] += np.maximum(lex.tail_tokens, 0)
    usual[END] += lex.ends
    usual /= usual.sum()
    training = encoded.where(~F.col("held_out")).select(F.xxhash64("doc_id", "n_tokens").alias("h"), "row", "n_tokens", "classes")
    m, before = first_model(training, usual), -np.inf
    while True:
        following, likelihood = again(training, m, usual)  # the likelihood under m
        if likelihood - before < LEAST_GAIN * max(1, lex.tokens):
            return following
        m, before = following, likelihood


SCORED = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, share double, forward double"


def _forward(m: Model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch))
            for rows, cls, alive, first in chunks(batch):
                scale, _ = forward(m, cls, alive, first, False)
                text = ranges(np.zeros(len(alive), np.int64), alive)
                out[rows] = np.bincount(text, weights=np.log10(scale), minlength=len(rows))
            yield pa.record_batch([*batch.columns[:7], pa.array(out)], [x.split()[0] for x in SCORED.split(", ")])

    return task


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and row, for each row of docs.

    Learns from the rows where training holds; a null or empty text is the end token alone. Repeated rows
    are scored each; an empty table gives no rows, and with nothing to learn from every word is unseen.
    """
    lex = count_words(docs, training)
    encoded = encode(docs, ~training, lex)
    m = fit(encoded, lex)
    scored = encoded.drop("tail").mapInArrow(_forward(m), SCORED)
    rest = F.array(*[F.lit(float(x)) for x in np.log10(lex.tail_tokens + lex.tail_words + 1)])
    tail = encoded.select("row", F.explode("tail").alias("word")).join(lex.table, "word", "left")
    n = F.coalesce("n", F.lit(0))
    share = F.log10(n + 1) - F.get(rest, F.col("word").bitwiseAND(F.lit(TAIL - 1)).cast("int"))
    tail = tail.groupBy("row").agg(F.sum(F.log10((n + 1) / F.lit(float(lex.tokens + lex.distinct + 1)))).alias("b"), F.sum(F.when(n > 0, 1).otherwise(0)).alias("k"), F.sum(share).alias("s"))
    rows = scored.join(tail, "row", "left")
    add = lambda x, y: F.col(x) + F.coalesce(y, F.lit(0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", add("n_known", "k").alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"), add("base", "b").alias("base_score"), (add("share", "s") + F.col("forward")).alias("score"), "row",
    )
