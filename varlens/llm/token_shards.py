"""Token ids in binary shard files with keyed access.

A shard file holds the documents of one range of keys in ascending key order:

    ids      little-endian u16 (u32 for vocabularies above 65,536), all documents one after another
    rows     u64[n_rows + 1], where each document's ids begin
    seeds    u32[n_buckets]   of a minimal perfect hash of the distinct keys
    prints   u32[n_keys]      a fingerprint for each cell
    first    u64[n_keys]      first row of the cell's key
    count    u32[n_keys]      rows of that key
    footer   magic, version, id width, salt, n_rows, n_nulls, n_keys, n_buckets, n_ids

The first n_nulls rows are those without a key. The manifest has a row for each shard: its file, key range
and totals. A key's shard comes from the manifest, its cell from the hash, its ids from the cell: constant
time at any size. Each attempt of a task writes a file of its own, and the manifest, which Spark commits,
names the one that counts; so a task may run twice, or two at once, on any file system.
"""

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import mph
from .scratch import new_path, written
from .words import Hasher, blocks, ranges, word_spans

MAGIC, VERSION = b"VLTS", 2
FOOTER = "<4sIIIQQQQQ"
SLOTS = 1 << 21
MANIFEST = "shard int, path string, min_key long, max_key long, n_nulls long, n_rows long, n_ids long"
_coders: dict[str, "WordCoder"] = {}


class WordCoder:
    """Ids of whole texts from the ids of their words.

    Right for tokenizers whose normaliser and splitter never look across ASCII white space and drop it,
    as the word-level BPE does. A distinct word is encoded by the tokenizers library when it is first met
    and kept in a table of SLOTS slots, two for each hash; a word that finds both taken is encoded again
    in each block that has it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.key, self.entry = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.ids, self.off = np.zeros(0, f"<u{self.width}"), np.zeros(1, np.int64)

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h & np.uint64(SLOTS - 1)).astype(np.int64), (h >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 for one that isn't kept."""
        a, b = self._slots(h)
        return np.where(self.key[a] == h, self.entry[a], np.where(self.key[b] == h, self.entry[b], -1)).astype(np.int64)

    def _keep(self, h: np.ndarray) -> np.ndarray:
        """Claim a free slot for each of the distinct hashes; which ones got one."""
        got = np.zeros(len(h), bool)
        for slot in self._slots(h):
            free = np.flatnonzero(~got & (self.key[slot] == 0))
            self.key[slot[free]] = h[free]
            got[free] = self.key[slot[free]] == h[free]
        return got

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block of texts, and each text's number of ids."""
        ws, we, wo = word_spans(buf, off)
        h = Hasher(buf)(ws, we)
        entry = self._find(h)
        missing = np.flatnonzero(entry < 0)
        ids, upto = self.ids, self.off
        if len(missing):
            new, first, of = np.unique(h[missing], return_index=True, return_inverse=True)
            kept = self._keep(new)
            order = np.argsort(~kept, kind="stable")
            raw, at = buf.tobytes(), missing[first[order]]
            words = [raw[a:b].decode() for a, b in zip(ws[at].tolist(), we[at].tolist())]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(found), ids.dtype, int(size.sum()))])
            upto = np.concatenate([upto, upto[-1] + np.cumsum(size)])
            rank = np.empty(len(new), np.int64)
            rank[order] = len(self.off) - 1 + np.arange(len(new))
            entry[missing] = rank[of]
            for slot in self._slots(new):
                own = np.flatnonzero(self.key[slot] == new)
                self.entry[slot[own]] = rank[own]
            self.off = upto[: len(self.off) + int(kept.sum())]
            self.ids = ids[: self.off[-1]]
        size = upto[entry + 1] - upto[entry]
        whole = np.concatenate([[0], np.cumsum(size)])
        return ids[ranges(upto[entry], size)], np.diff(whole[wo])


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def _write(base: str, tokenizer: str, end_id: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(base)
        code, keys, sizes, nulls, out, path = coder(tokenizer), [], [], 0, None, f"{root}/shard-{shard:06d}-{attempt}.vlts"
        for batch in batches:
            nulls += batch.column(0).null_count  # they come before all others
            keys.append(np.asarray(batch.column(0).drop_null(), np.int64))
            for _, _, buf, off in blocks(batch, "text"):
                ids, size = code.encode(buf, off)
                ids = np.insert(ids, np.cumsum(size), end_id)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path)
                out.write(ids.astype(f"<u{code.width}").tobytes())
                sizes.append(size + 1)
        if out is None:
            return
        key, rows = np.concatenate(keys), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        distinct, first, count = np.unique(key, return_index=True, return_counts=True)
        salt, seeds = mph.build(distinct)
        cell = np.argsort(mph.find(distinct, salt, seeds, len(distinct)))
        for x, kind in ((rows, "<u8"), (seeds, "<u4"), (mph.fingerprints(distinct)[cell], "<u4"), (nulls + first[cell], "<u8"), (count[cell], "<u4")):
            out.write(x.astype(kind).tobytes())
        out.write(struct.pack(FOOTER, MAGIC, VERSION, code.width, salt, len(rows) - 1, nulls, len(distinct), len(seeds), int(rows[-1])))
        out.close()
        ends = (int(key[0]), int(key[-1])) if len(key) else (None, None)
        types = [pa.int32(), pa.string(), *[pa.int64()] * 5]
        yield pa.record_batch([pa.array([v], t) for v, t in zip((shard, path, *ends, nulls, len(rows) - 1, int(rows[-1])), types)], [c.split()[0] for c in MANIFEST.split(", ")])

    return task


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, shards: int | None = None) -> tuple[str, DataFrame]:
    """Encode all texts, append end_id to each, write the shard files; gives their folder and the manifest.

    A null text is empty. Rows of a null doc_id come before all others. Rows of one doc_id, or of none, stay
    together in order of their texts' hashes, in more than one shard where they are many. Very long texts are
    encoded whole; an empty table has an empty manifest.
    """
    spark = docs.sparkSession
    base = new_path(spark, "token-shards")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(n, "key", "h").sortWithinPartitions("key", "h").select("key", "text")
    return base, written(rows.mapInArrow(_write(base, tokenizer, end_id), MANIFEST), "token-manifest")


class Shard:
    """One shard file, open for keyed reads."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        end = self.file.size() - struct.calcsize(FOOTER)
        magic, version, self.width, self.salt, self.n_rows, self.n_nulls, self.n_keys, buckets, self.n_ids = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), end))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path} is no token shard")
        at = self.n_ids * self.width
        raw = self.file.read_at(end - at, at)
        take = lambda kind, n, start: np.frombuffer(raw, kind, n, start)
        at = 0
        self.rows, at = take("<u8", self.n_rows + 1, at).astype(np.int64), at + 8 * (self.n_rows + 1)
        self.seeds, at = take("<u4", buckets, at), at + 4 * buckets
        self.prints, at = take("<u4", self.n_keys, at), at + 4 * self.n_keys
        self.first, at = take("<u8", self.n_keys, at).astype(np.int64), at + 8 * self.n_keys
        self.count = take("<u4", self.n_keys, at).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; no rows for a key that isn't here."""
        if not self.n_keys:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        cell = mph.find(keys, self.salt, self.seeds, self.n_keys)
        here = self.prints[cell] == mph.fingerprints(keys)
        return np.where(here, self.first[cell], 0), np.where(here, self.count[cell], 0)

    def ids(self, row: int, rows: int = 1) -> np.ndarray:
        a, b = int(self.rows[row]), int(self.rows[row + rows])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")


def _read(base: str, files: dict[int, tuple[str, int]], most: int = 4 << 20):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(base)
        got = pa.Table.from_batches(batches, pa.schema([("shard", pa.int32()), ("key", pa.int64())]))  # keys alone, of a few shards
        shards, null, keys = np.asarray(got["shard"]), np.asarray(got["key"].is_null()), np.asarray(got["key"].fill_null(0))
        for s in np.unique(shards):
            path, start = files[int(s)]
            shard = Shard(fs, path)
            own, none = keys[(shards == s) & ~null], ((shards == s) & null).any()
            first, count = shard.find(own)
            row, key = ranges(first, count), np.repeat(own, count)
            order = np.argsort(row)
            row, key = row[order], key[order]
            nulls = shard.n_nulls if none else 0
            row, key, unkeyed = np.concatenate([np.arange(nulls), row]), np.concatenate([np.zeros(nulls, np.int64), key]), np.arange(nulls + len(row)) < nulls
            a, b = shard.rows[row], shard.rows[row + 1]
            crc, lo = np.zeros(len(row), np.int64), 0
            while lo < len(row):  # neighbouring documents in one read
                hi = max(lo + 1, int(np.searchsorted(b, a[lo] + most, "right")))
                ids = shard.ids(row[lo], int(row[hi - 1] - row[lo]) + 1).astype("<u4")
                for i in range(lo, hi):
                    crc[i] = zlib.crc32(ids[a[i] - a[lo] : b[i] - a[lo]])
                lo = hi
            shard.file.close()
            yield pa.record_batch([pa.array(key, mask=unkeyed), pa.array(a + start), pa.array(b - a), pa.array(crc), pa.array(np.full(len(row), s, np.int32))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return task


def read_keys(keys: DataFrame, base: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and shard of every stored document whose key is in keys (column doc_id).

    The manifest, a row for each shard and never more than the partitions of the write, goes to the
    driver; documents do not. A key that no shard holds gives no row, a repeated one gives its rows once.
    """
    spark = keys.sparkSession
    ordered = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    table = manifest.select("shard", "path", "min_key", "max_key", "n_nulls", F.coalesce(F.sum("n_ids").over(ordered), F.lit(0)).alias("base")).orderBy("shard").collect()
    files, keyed = {r.shard: (r.path, r.base) for r in table}, [r for r in table if r.min_key is not None]
    low, high = np.array([r.min_key for r in keyed], np.int64), np.array([r.max_key for r in keyed], np.int64)
    number, unkeyed = np.array([r.shard for r in keyed], np.int32), np.array([r.shard for r in table if r.n_nulls], np.int32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column(0).null_count:
                yield pa.record_batch([pa.array(unkeyed), pa.nulls(len(unkeyed), pa.int64())], ["shard", "key"])
            key = np.asarray(b.column(0).drop_null(), np.int64)
            lo, hi = np.searchsorted(high, key, "left"), np.searchsorted(low, key, "right")
            n = np.maximum(hi - lo, 0)
            yield pa.record_batch([pa.array(number[ranges(lo, n)], pa.int32()), pa.array(np.repeat(key, n))], ["shard", "key"])

    wanted = keys.select(F.col("doc_id").cast("long").alias("key")).distinct().mapInArrow(place, "shard int, key long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return wanted.repartition(n, "shard").mapInArrow(_read(base, files), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
