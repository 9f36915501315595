"""Language identification by n-grams in bit-sliced Bloom filters.

A filter per language holds the byte 4-grams typical of it. The filters are bit-sliced: row i of one
table, a word for each 64 languages, has bit l set if position i of language l's filter is set, so that
one look-up (the AND of HASHES rows) gives all languages that contain an n-gram. A text's languages are weighed by the
popcounts of its n-grams, less what the filters' false positives account for.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import LOWER, blocks, mix, ranges, released

GRAM, HASHES, ROWS, WORD = 4, 3, 1 << 18, 64
#: An n-gram is typical of a language if it is in this share of the language's documents.
SHARE = 0.02
#: Labelled documents that the filters are fitted on, for each language: those of lowest hash.
SAMPLE = 4000

#: ASCII letters and all bytes of other characters count; the rest becomes a space.
FOLD = LOWER.copy()
FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text as 32-bit numbers (those of spaces alone left out) and their texts."""
    x = FOLD[buf].astype(np.uint32)
    n = np.maximum(np.diff(off) - (GRAM - 1), 0)
    at = ranges(off[:-1], n)
    g = np.zeros(max(0, len(x) - (GRAM - 1)), np.uint32)
    for k in range(GRAM):
        g = (g << np.uint32(8)) | x[k : len(x) - (GRAM - 1) + k]
    g = g[at] if len(at) != len(g) else g
    doc = np.repeat(np.arange(len(off) - 1), n)
    worth = (g & np.uint32(0x00FFFF00)) != np.uint32(0x00202000)
    return g[worth], doc[worth]


def positions(g: np.ndarray) -> list[np.ndarray]:
    h = mix(g)
    return [((h >> np.uint64(20 * k)) & np.uint64(ROWS - 1)).astype(np.int64) for k in range(HASHES)]


def _doc_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, documents) counts of each batch."""
    for batch in batches:
        lang = np.asarray(batch.column(batch.schema.get_field_index("l")), np.int64)
        for lo, hi, buf, off in blocks(batch, "text"):
            g, doc = grams(buf, off)
            once = np.unique((doc.astype(np.uint64) << np.uint64(32)) | g)
            key = (lang[lo:hi][(once >> np.uint64(32)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (once & np.uint64(0xFFFFFFFF))
            key, n = np.unique(key, return_counts=True)
            yield pa.record_batch([pa.array((key >> np.uint64(32)).astype(np.int32)), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["l", "g", "n"])


@dataclass
class Filters:
    langs: list[str]
    table: np.ndarray  # uint64[ROWS, words]: a bit for each language, WORD of them a word
    false_rate: np.ndarray  # of each language's filter
    usual: int  # the language of most training documents


def fit(docs: DataFrame, training: Column, sample: int = SAMPLE) -> Filters | None:
    """Filters of every language in the rows where training holds and lang isn't null; None if there are none.

    The filters are fitted on a bounded sample, `sample` whole documents a language or all it has. What
    comes to the driver is the table, ROWS words for each WORD languages, and a row a language. All
    languages are learned. Rows of null texts count as documents without n-grams, repeated rows count
    each, very long texts are taken whole.
    """
    rows = docs.where(training & F.col("lang").isNotNull()).select("lang", F.col("text"), F.xxhash64("doc_id").alias("h"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    upto = lambda l: min(2**63 - 1, 2**64 * sample // sizes[l] - 2**63)  # noqa: E731  a hash below this is in the sample
    each = F.create_map(*[x for i, l in enumerate(langs) for x in (F.lit(l), F.struct(F.lit(i).alias("l"), F.lit(upto(l)).alias("upto")))])
    picked = rows.withColumn("at", each[F.col("lang")]).where(F.col("h") <= F.col("at.upto")).select(F.col("at.l").alias("l"), "text")
    counts = picked.mapInArrow(_doc_grams, "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    floor = F.create_map(*[x for i, l in enumerate(langs) for x in (F.lit(i), F.lit(max(1.0, SHARE * min(sample, sizes[l]))))])
    typical = counts.where(F.col("n") >= floor[F.col("l")]).select("g", "l")
    table = np.zeros((ROWS, -(-len(langs) // WORD)), np.uint64)
    for r in typical.mapInArrow(_rows, "p long, word int, bit long").groupBy("p", "word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        table[r.p, r.word] = np.uint64(r.bits % 2**64)
    fill = [bit(table[:, i // WORD], i).mean() for i in range(len(langs))]
    return Filters(langs, table, np.array(fill) ** HASHES, max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        g, l = np.asarray(b.column(0)).astype(np.uint32), np.asarray(b.column(1))
        bits = (np.uint64(1) << (l % WORD).astype(np.uint64)).view(np.int64)
        cols = [np.concatenate(positions(g)), np.tile((l // WORD).astype(np.int32), HASHES), np.tile(bits, HASHES)]
        yield pa.record_batch([*map(pa.array, cols)], ["p", "word", "bit"])


def bit(words: np.ndarray, language: int) -> np.ndarray:
    """A language's bits of words of the table."""
    return (words >> np.uint64(language % WORD)) & np.uint64(1)


def weigh(f: Filters, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text the index of the best language, its share of all corrected popcounts, coverage and margin.

    Coverage is the best language's corrected popcount over all n-grams of the text, those that no filter
    holds among them; margin is how much of that the second language lacks. Neither falls or rises with
    the number of languages as such.
    """
    docs = len(off) - 1
    g, doc = grams(buf, off)
    total, counts, at = np.bincount(doc, minlength=docs), np.zeros((docs, len(f.langs))), positions(g)
    for w in range(f.table.shape[1]):
        found = np.full(len(g), np.uint64(2**64 - 1))
        for p in at:
            found &= f.table[p, w]
        some = np.flatnonzero(found)
        found, own = found[some], doc[some]
        for i in range(w * WORD, min((w + 1) * WORD, len(f.langs))):
            counts[:, i] = np.bincount(own[bit(found, i) == 1], minlength=docs)
    right = np.maximum(0, (counts - total[:, None] * f.false_rate) / (1 - np.minimum(f.false_rate, 0.999)))
    best = right.argmax(1)
    top, whole = right[np.arange(docs), best], right.sum(1)
    others = right.copy()
    others[np.arange(docs), best] = 0
    share, every = np.where(whole > 0, top / np.maximum(whole, 1e-9), 0.0), np.maximum(total, 1)
    return np.where(top > 0, best, f.usual), share, top / every, (top - others.max(1)) / every


def lettered(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    plain = np.diff(np.searchsorted(np.flatnonzero((FOLD[buf] != 32) & (buf < 128)), off)) > 0
    for i in np.flatnonzero(~plain & (np.diff(np.searchsorted(np.flatnonzero(buf >= 128), off)) > 0)):
        plain[i] = any(map(str.isalpha, buf[off[i] : off[i + 1]].tobytes().decode(errors="replace")))
    return plain


#: The columns that predict() adds.
ADDED = ("lang_pred", "score", "coverage", "margin")


def predict(docs: DataFrame, f: Filters | None) -> DataFrame:
    """docs with lang_pred, score, coverage and margin (0 to 1), which depend on the text alone and replace columns of these names.

    `und` with 0 in all three for a null text or one without a letter, and for all if nothing was learned. A
    text whose n-grams no filter holds gets the most frequent language with score 0; between equal
    languages the first by name is taken. score is relative to the learned languages; whether a text is in
    any of them is told by coverage. Repeated rows are predicted each, very long texts whole; an empty
    table gives no rows.
    """
    if f is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "coverage": F.lit(0.0), "margin": F.lit(0.0)})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, scores = [np.zeros(0, np.int64)], [np.zeros((3, 0))]
            for _, _, buf, off in blocks(batch, "text"):
                b, *s = weigh(f, buf, off)
                ok = lettered(buf, off)
                best.append(np.where(ok, b, -1))
                scores.append(np.where(ok, s, 0.0))
            best, scores = np.concatenate(best), np.concatenate(scores, 1)
            lang = pa.array([f.langs[i] if i >= 0 else "und" for i in best], pa.string())
            yield pa.record_batch([*batch.columns, lang, *(pa.array(s, pa.float64()) for s in scores)], [*batch.schema.names, *ADDED])
        released()

    keep = docs.drop(*ADDED)
    return keep.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields) + ", lang_pred string, score double, coverage double, margin double")
