"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document. The ledger keeps the measurements and one bit a failed
rule; policies are masks over those bits with a version, so a new policy or an ablation reads the
ledger and never the texts.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Hasher, blocks, member, mix, ranges, repeated, windows, word_spans

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measures(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of a block of texts."""
    docs = len(off) - 1
    ws, we, wo = word_spans(buf, off)
    size = np.concatenate([[0], np.cumsum(we - ws)])
    count = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), off))
    out = {"n_words": np.diff(wo), "word_chars": np.diff(size[wo]) - count((buf & 0xC0) == 0x80), "n_symbols": count(SYMBOL[buf])}
    hashed = Hasher(buf)

    breaks = np.flatnonzero(buf == 10)
    own = np.diff(np.searchsorted(breaks, off)) + 1  # lines of each text
    line_doc = np.repeat(np.arange(docs), own)
    at = np.cumsum(own) - own
    starts, ends = np.zeros(len(line_doc), np.int64), np.zeros(len(line_doc), np.int64)
    later = np.ones(len(line_doc), bool)
    later[at] = False
    starts[at], starts[later] = off[:-1], breaks + 1
    last = np.zeros(len(line_doc), bool)
    last[at + own - 1] = True
    ends[last], ends[~last] = off[1:], breaks
    worded = np.searchsorted(ws, ends) > np.searchsorted(ws, starts)
    line_doc, starts, ends = line_doc[worded], starts[worded], ends[worded]
    out["n_lines"] = np.bincount(line_doc, minlength=docs)
    key = mix(hashed(starts, ends) ^ mix(line_doc + 1))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[first], minlength=docs)

    at, tri = windows(hashed(ws, we), wo, 3)
    word_doc = np.repeat(np.arange(docs), out["n_words"])
    key = mix(tri ^ mix(word_doc[at] + 1))
    hit = at[member(key, repeated(key))]
    cover = np.zeros(len(ws), bool)
    for k in range(3):
        cover[hit + k] = True
    out["n_repeat_words"] = np.bincount(word_doc[cover], minlength=docs)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [measures(buf, off) for _, _, buf, off in blocks(batch, "text")]
        cols = [np.concatenate([p[m] for p in parts] or [np.zeros(0)]).astype(np.int64) for m in MEASURES]
        yield pa.record_batch([batch.column(0), *map(pa.array, cols)], ["doc_id", *MEASURES])


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, a condition over the measurements, holds. Bits are never reused."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeat_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(5, "huge", "n_words > 1000000"),
)
#: Version -> names of the rules that reject. Old versions stay, so that any past verdict can be told again.
POLICIES = {1: ("few_words", "repeat_words"), 2: ("few_words", "repeat_words", "symbols", "dup_lines", "word_length")}


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits, a row for each row of docs (doc_id, text and any other columns).

    A null text has no words and fails few_words, as an empty one does. Null ids and repeated rows stay
    as they are; an empty table gives an empty ledger.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0) for r in RULES]
    total: Column = F.lit(0)
    for b in bits:
        total = total.bitwiseOR(b)
    return rows.withColumn("fail_bits", total.cast("long"))


def apply_policy(rows: DataFrame, version: int) -> DataFrame:
    """The ledger with policy_version, rejected_by (the bits that decide) and kept."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long"))
    return rows.withColumns({"policy_version": F.lit(version).cast("long"), "rejected_by": bits, "kept": bits == 0})


def ablation(rows: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that stay without it.

    The ledger is first counted by bit pattern, of which there are at most 2**rules, so the rest is tiny.
    """
    names, whole = POLICIES[version], mask(POLICIES[version])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in names])).alias("r")
    hit, rest = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    add = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long")
    return patterns.select("bits", "n", rules).groupBy("r.rule").agg(add(hit).alias("n_fail"), add(F.col("bits") == F.col("r.bit")).alias("n_only"), add(rest == 0).alias("n_kept_without"))
