"""Benchmark decontamination with spaced seeds.

A seed is a window of tokens of which a fixed mask selects some; the others may differ. The masked
windows of all documents are hashed, a Bloom filter of fixed size lets those through that some test item
may have, and an equi-join with the test items' seeds says where. Around each hit the two token
sequences are compared along their common diagonal, substitutions allowed.

Tokens are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased, so
punctuation, line breaks and case don't matter.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, small, written
from .words import LOWER, STEP, Hasher, blocks, mix, ranges, released, word_spans

#: Fixed masks: each selects six tokens. Every stretch of LEAST_EQUAL equal tokens at LEAST_SHARE has a window in which one of
#: them meets equal tokens alone, wherever the others lie (a test goes through all placements), so no overlap goes unseen.
MASKS = ("111111", "1111011", "11101011", "101100100011")
#: An overlap counts from this many equal tokens (a shorter item: all of its own), with this share of equal ones.
LEAST_EQUAL, LEAST_SHARE = 12, 0.8
#: Items of fewer tokens than any mask selects: from FREE on all their tokens in a row are one seed; shorter ones
#: match documents that have no other tokens.
SHORT, FREE = 6, 4
BLOOM_BITS, BLOOM_HASHES = 1 << 24, 3

OUTSIDE = np.ones(256, bool)
OUTSIDE[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = False


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token, and for each text the index of its first token."""
    marked = np.where(OUTSIDE[buf], np.uint8(32), LOWER[buf])
    ws, we, wo = word_spans(marked, off)
    return Hasher(marked)(ws, we), wo


def seeds(h: np.ndarray, wo: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of every window under a mask."""
    return _seeds(h, wo, MASKS[mask], mask + 1)


def _seeds(h: np.ndarray, wo: np.ndarray, shape: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    at = ranges(wo[:-1], np.maximum(np.diff(wo) - (len(shape) - 1), 0))
    x = np.full(len(at), salt, np.uint64)
    for k, c in enumerate(shape):
        if c == "1":
            x = x * np.uint64(STEP) + h[at + k]
    return at, mix(x)


def _short_seeds(h: np.ndarray, wo: np.ndarray, n: int, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of n tokens in a row: of all windows, or with alone of the texts that have n tokens."""
    at, x = _seeds(h, wo, "1" * n, len(MASKS) + n)
    size = np.diff(wo)
    if alone and len(at):
        own = np.repeat(size == n, np.maximum(size - (n - 1), 0))
        return at[own], x[own]
    return at, x


def _bits(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(20 * k)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64) for k in range(BLOOM_HASHES)]


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in blocks(batch, "text"):
            h, wo = tokens(buf, off)
            words = pa.ListArray.from_arrays(pa.array(wo, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.record_batch([batch.column(0)[lo:hi], words], ["item_id", "words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in blocks(batch, "text"):
            h, wo = tokens(buf, off)
            item = np.repeat(np.arange(lo, hi), np.diff(wo))
            for at, x in [*(seeds(h, wo, m) for m in range(len(MASKS))), *(_short_seeds(h, wo, n, True) for n in range(1, SHORT))]:
                of = item[at]
                yield pa.record_batch([batch.column(0).take(pa.array(of)), pa.array(x.view(np.int64)), pa.array((at - wo[of - lo]).astype(np.int32))], ["item_id", "seed", "item_pos"])


def _bloom_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = np.concatenate(_bits(np.asarray(b.column(0)).view(np.uint64)))
        yield pa.record_batch([pa.array(p >> 6), pa.array((np.uint64(1) << (p & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])


SEGMENTS = "doc_id long, text_hash long, first_token int, words array<long>, hits array<struct<seed:long,pos:int>>"


def _segments(bloom: np.ndarray, margin: int, short: list[int]):
    """Stretches of documents around possible hits, `margin` tokens to either side; overlapping ones are one.

    short: the numbers of tokens, below SHORT, that some item has.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hint = np.packbits((bloom != 0).reshape(1 << 18)).astype(bool).repeat(8)  # by the top bits of a position
        for batch in batches:
            for lo, hi, buf, off in blocks(batch, "text"):
                h, wo = tokens(buf, off)
                seed, pos = [], []
                for at, x in [*(seeds(h, wo, m) for m in range(len(MASKS))), *(_short_seeds(h, wo, n, n < FREE) for n in short)]:
                    p = _bits(x)
                    may = np.flatnonzero(hint[p[0] >> 6])
                    for k in range(BLOOM_HASHES):
                        b = p[k][may]
                        may = may[(bloom[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1]
                    seed.append(x[may])
                    pos.append(at[may])
                seed, pos = np.concatenate(seed), np.concatenate(pos)
                if not len(pos):
                    continue
                order = np.argsort(pos, kind="stable")
                seed, pos = seed[order], pos[order]
                doc = np.searchsorted(wo, pos, "right") - 1
                start, end = np.maximum(pos - margin, wo[doc]), np.minimum(pos + margin, wo[doc + 1])
                new = np.ones(len(pos), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > np.maximum.accumulate(end)[:-1])
                first = np.flatnonzero(new)
                a, b, d = start[first], end[np.append(first[1:], len(pos)) - 1], doc[first]
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(b - a)]), pa.int32()), pa.array(h[ranges(a, b - a)].view(np.int64)))
                begin = np.repeat(a, np.diff(np.append(first, len(pos))))
                hit = pa.StructArray.from_arrays([pa.array(seed.view(np.int64)), pa.array((pos - begin).astype(np.int32))], ["seed", "pos"])
                hits = pa.ListArray.from_arrays(pa.array(np.append(first, len(pos)), pa.int32()), hit)
                rows = pa.array(d + lo)
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array((a - wo[d]).astype(np.int32)), words, hits], ["doc_id", "text_hash", "first_token", "words", "hits"])
        released()

    return task


def overlap(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """(equal tokens, tokens, first place) of the stretch of two sequences of equal length with the most equal tokens
    among all of which LEAST_SHARE or more are equal; of several the shortest, then the first. (0, 0, 0) if none is equal.
    """
    same = x == y
    n = len(same)
    if not same.any():
        return 0, 0, 0
    equal = np.concatenate([[0], np.cumsum(same)])
    score = 5 * equal - 4 * np.arange(n + 1)  # a stretch from i to j has the share if score[j] >= score[i]
    start = np.searchsorted(-np.minimum.accumulate(score), -score, "left")  # the first such i for each j
    most = equal - equal[start]
    ends = np.flatnonzero(most == most.max())
    starts = start[ends]
    at = np.flatnonzero(same)
    first, last = at[equal[starts]], at[equal[ends] - 1] + 1  # without unequal tokens at either end
    k = np.lexsort((first, last - first))[0]
    return int(most.max()), int(last[k] - first[k]), int(first[k])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch.column(k) for k in range(batch.num_columns)]
        first, diag = np.asarray(cols[3]), np.asarray(cols[4])
        keep, out = [], ([], [], [], [])
        for i in range(len(batch)):
            x, y = np.asarray(cols[5][i].values), np.asarray(cols[6][i].values)
            a, d = max(0, int(diag[i])), int(diag[i])
            n = min(len(x), d + len(y)) - a
            equal, size, start = overlap(x[a : a + n], y[a - d : a - d + n])
            if equal >= min(LEAST_EQUAL, len(y)) > 0:
                keep.append(i)
                for column, v in zip(out, (equal, size, int(first[i]) + a + start, len(y))):
                    column.append(v)
        at = pa.array(keep, pa.int64())
        yield pa.record_batch([cols[0].take(at), cols[1].take(at), cols[2].take(at), *(pa.array(v, pa.int64()) for v in out)], ["doc_id", "text_hash", "item_id", "n_equal", "n_tokens", "first_token", "item_tokens"])


def text_hash() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, n_equal, n_tokens, first_token, item_tokens: the best overlap of each pair that has one.

    Items of fewer than LEAST_EQUAL tokens match where all of theirs stand in a row; those of fewer than FREE
    tokens match documents that have the same tokens and no others. Null and empty texts on either side, and
    texts without tokens, match nothing. Repeated rows of either table give the pair once; very long texts are
    compared whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    items = written(items.select("item_id", "text"), "items")
    stored = written(items.mapInArrow(_item_seeds, "item_id long, seed long, item_pos int"), "item-seeds")
    words = items.mapInArrow(_item_tokens, "item_id long, words array<long>")
    sizes = words.select(F.size("words").alias("n")).groupBy(F.least("n", F.lit(SHORT)).alias("n")).agg(F.max("n").alias("most")).collect()  # SHORT + 1 rows at most
    margin = max((r.most for r in sizes), default=0) + max(map(len, MASKS))
    short = sorted(r.n for r in sizes if 0 < r.n < SHORT)
    bloom = np.zeros(BLOOM_BITS >> 6, np.uint64)
    for r in stored.select("seed").mapInArrow(_bloom_words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bloom[r.word] = np.uint64(r.bits % 2**64)
    found = docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(_segments(bloom, margin, short), SEGMENTS)
    found = written(found, "segments")
    key = ["doc_id", "text_hash", "first_token"]
    hits = found.select(*key, F.explode("hits").alias("h")).select(*key, "h.seed", "h.pos")
    diagonals = hits.join(small(stored.distinct()), "seed").select(*key, "item_id", (F.col("pos") - F.col("item_pos")).alias("diag")).distinct()
    found = found.groupBy(*key).agg(F.first("words").alias("words"))
    named = words.groupBy("item_id", "words").agg(F.lit(1)).select("item_id", F.col("words").alias("item_words"))
    same = (diagonals["doc_id"].eqNullSafe(found["doc_id"])) & (diagonals["text_hash"] == found["text_hash"]) & (diagonals["first_token"] == found["first_token"])
    rows = diagonals.join(found, same).select(diagonals["doc_id"], diagonals["text_hash"], "item_id", diagonals["first_token"], "diag", "words")
    rows = rows.withColumnRenamed("item_id", "i").join(small(named), F.col("i").eqNullSafe(F.col("item_id")))
    rows = rows.select("doc_id", "text_hash", "item_id", "first_token", "diag", "words", "item_words").mapInArrow(_verify, "doc_id long, text_hash long, item_id long, n_equal long, n_tokens long, first_token long, item_tokens long")
    best = F.max(F.struct("n_equal", -F.col("n_tokens"), -F.col("first_token"), "item_tokens")).alias("b")
    return rows.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "b.n_equal", (-F.col("b.col2")).alias("n_tokens"), (-F.col("b.col3")).alias("first_token"), "b.item_tokens")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that overlap no item, with the columns of docs.

    Rows of null or empty texts stay, repeated rows go or stay together; empty tables of items leave all rows.
    Columns of docs may have any names.
    """
    id_, text, hash_ = fresh(docs, "id", "text_hash", "hash")
    found = written(overlaps(docs, items).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(text)).distinct(), "contaminated")
    rows = docs.withColumn(hash_, text_hash())
    return rows.join(small(found), rows["doc_id"].eqNullSafe(F.col(id_)) & (rows[hash_] == F.col(text)), "left_anti").drop(hash_)
