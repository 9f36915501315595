"""Near-duplicate documents by ProbMinHash.

Each distinct shingle of five words weighs 1, however often it occurs, and is a Poisson process of that
rate whose arrivals fall on random registers; a register keeps the earliest arrival's shingle. Two texts
agree in a register with the chance of their probability Jaccard similarity, which with equal weights is
the Jaccard similarity of the shingle sets that links are decided by. A shingle stops as soon as its next
arrival is later than all registers, so a text of n shingles takes about n + REGISTERS ln(REGISTERS)
arrivals. Bands of ROWS registers give buckets, and pairs from buckets are verified on the shingle sets.

A bucket is not expanded into all its pairs. In each turn every bucket draws a leader, and members of
other components are compared with it. What then is left in different components is compared in full,
block by block, so that any two texts of a bucket that are similar end in one class.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, small, written
from .words import STEP, Hasher, blocks, mix, ranges, released, windows, word_spans

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares a band with a chance of 1 - (1 - 0.8**7)**36 = 0.9998.
BANDS, ROWS = 36, 7
REGISTERS = BANDS * ROWS
BLOCK = 1 << 20
#: Turns of comparing with leaders go on, TURNS at most, while each leaves GAIN of the pairs apart or fewer.
TURNS, GAIN = 4, 0.7
MEMBERS, COLUMNS = 128, 1 << 13
_G = np.uint64(0x9E3779B97F4A7C15)


def shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, their texts and counts.

    A text of one to four words has one shingle, of all its words; one without words has none.
    """
    ws, we, wo = word_spans(buf, off)
    h = Hasher(buf)(ws, we)
    at, key = windows(h, wo, SHINGLE)
    words = np.diff(wo)
    doc = np.repeat(np.arange(len(words)), np.maximum(words - (SHINGLE - 1), 0))
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    if len(short):
        x = np.full(len(short), 1, np.uint64)
        for k in range(SHINGLE - 1):
            has = words[short] > k
            x[has] = x[has] * np.uint64(STEP) + h[wo[short[has]] + k]
        key, doc = np.concatenate([key, mix(x)]), np.concatenate([doc, short])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return key[first], doc[first], np.diff(np.append(first, len(key)))


def signatures(key: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """uint64[docs, REGISTERS]: the shingle of each register's earliest arrival (0 in texts without any)."""
    time, sig = np.full(docs * REGISTERS, np.inf), np.zeros(docs * REGISTERS, np.uint64)
    latest = np.full(docs, np.inf)
    now, state = np.zeros(len(key)), mix(key ^ np.uint64(0x5EED))
    while len(key):
        state = state + _G
        z = mix(state)
        now = now - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        alive = np.flatnonzero(now < latest[doc])
        if len(alive) < len(key):
            key, doc, weight, now, state, z = (x[alive] for x in (key, doc, weight, now, state, z))
        register = doc * REGISTERS + (mix(z) % np.uint64(REGISTERS)).astype(np.int64)
        earlier = np.flatnonzero(now < time[register])
        order = earlier[np.argsort(-now[earlier], kind="stable")]
        time[register[order]] = now[order]  # the earliest is written last
        sig[register[order]] = key[order]
        open_ = np.unique(doc) if len(doc) < docs else np.flatnonzero(np.bincount(doc, minlength=docs))
        latest[open_] = time.reshape(docs, REGISTERS)[open_].max(1)
    return sig.reshape(docs, REGISTERS)


def bands(sig: np.ndarray) -> np.ndarray:
    """uint64[docs, BANDS]: a hash of each band's registers and number."""
    x = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    parts = sig.reshape(len(sig), BANDS, ROWS)
    for k in range(ROWS):
        x = x * np.uint64(STEP) + parts[:, :, k]
    return mix(x)


SIGNED = "doc_id long, node long, n_shingles int, shingle_set binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in blocks(batch, "text", BLOCK):
            key, doc, _ = shingles(buf, off)
            docs = hi - lo
            b = bands(signatures(key, doc, np.ones(len(key)), docs))
            n = np.bincount(doc, minlength=docs)
            upto = np.concatenate([[0], np.cumsum(8 * n)]).astype(np.int64)
            binary = pa.Array.from_buffers(pa.large_binary(), docs, [None, pa.py_buffer(upto), pa.py_buffer(key.astype("<u8").tobytes())]).cast(pa.binary())
            held = n > 0  # texts without words have no bands
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(BANDS * held)]), pa.int32()), pa.array(b[held].ravel().view(np.int64)))
            yield pa.record_batch([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(n, pa.int32()), binary, lists], ["doc_id", "node", "n_shingles", "shingle_set", "bands"])
    released()


def text_hash() -> F.Column:
    """The node of a row: its text's 64-bit hash, a null text counting as an empty one."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def signed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_hash().alias("node"), "text").mapInArrow(_sign, SIGNED)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, sa, sb = batch.columns
        keep = []
        for x, y in zip(sa, sb):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = np.sort(np.concatenate([x, y]), kind="stable")  # of two sorted runs of distinct values
            common = int((both[1:] == both[:-1]).sum())
            keep.append(common >= SIMILARITY * (len(both) - common))
        yield pa.record_batch([a, b], ["ca", "cb"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The components (ca, cb) of those pairs (a, b, ca, cb) whose shingle sets have a Jaccard similarity of SIMILARITY or more."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = rows.join(small(wanted), "node", "left_semi").groupBy("node").agg(F.first("shingle_set").alias("s"))
    sets = written(sets, "shingle-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return written(both.select("ca", "cb", "sa", "sb").mapInArrow(_similar, "ca long, cb long").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of edges (two columns): comp is the component's least node.

    Alternating large-star and small-star steps. Each step's edges are a written table, so a lost
    executor costs that step alone; no component is ever gathered in one task but as a grouped minimum.
    """
    edges = written(edges.select(F.greatest(*edges.columns).alias("a"), F.least(*edges.columns).alias("b")).where("a <> b").distinct(), "edges")
    while True:
        ways = edges.union(edges.select("b", "a"))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # greater neighbours to the least
        large = written(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a")
        following = star.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(star.select("a", F.col("m").alias("b"))).distinct()
        following = written(following, "small-star")
        same = following.exceptAll(edges).isEmpty() and edges.exceptAll(following).isEmpty()
        edges = following
        if same:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select("b", "b")).distinct()


def beside_leaders(placed: DataFrame, turn: int) -> DataFrame:
    """For each bucket one pseudo-random leader, and each member of another component beside it: (a, b, ca, cb)."""
    draw = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("b"), F.col("comp").alias("cb"))).alias("l")
    leaders = placed.groupBy("key").agg(draw, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key", "l.b", "l.cb")
    pairs = placed.join(leaders, "key").where("comp <> cb").select(F.col("node").alias("a"), "b", F.col("comp").alias("ca"), "cb")
    return written(pairs.distinct(), "leader-pairs")


def left_apart(placed: DataFrame) -> int:
    """Pairs within a bucket whose components differ, counted without listing them."""
    each = placed.groupBy("key", "comp").agg(F.count("*").cast("double").alias("n"))
    pairs = each.groupBy("key").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("p"))
    return int(pairs.agg(F.sum("p")).first()[0] or 0)


PAIRED = "key long, i int, j int, side int, comp long, shingle_set binary"


def _block_links(table: pa.Table) -> pa.Table:
    """The components of similar pairs between two blocks of a bucket's members (or within one).

    The common shingles of all pairs are counted as products of 0/1 matrices, some columns at a time.
    """
    side, comp = np.asarray(table["side"].combine_chunks()), np.asarray(table["comp"].combine_chunks())
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table["shingle_set"].combine_chunks()]
    size = np.array([len(x) for x in sets])
    every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    column = np.cumsum(np.concatenate([[False], every[1:] != every[:-1]]))
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side != 0 if (side > 0).any() else side <= 0)
    common = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[of[a:b], column[a:b] - c] = 1
        common += m[left] @ m[right].T
    x, y = np.nonzero((common >= SIMILARITY * (size[left][:, None] + size[right][None, :] - common)) & (comp[left][:, None] != comp[right][None, :]))
    pairs = np.unique(np.stack([comp[left][x], comp[right][y]], 1), axis=0)
    return pa.table({"ca": pa.array(pairs[:, 0]), "cb": pa.array(pairs[:, 1])})


def across(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """The components (ca, cb) of all similar pairs within the buckets that hold more than one component.

    A bucket's members are dealt into blocks of about MEMBERS, and each pair of blocks is one group: no
    pair of members is ever a row, and no task holds a bucket.
    """
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low <> high")
    some = written(placed.join(mixed.select("key", "n"), "key"), "mixed-buckets")
    sets = rows.join(small(some.select("node").distinct()), "node", "left_semi").groupBy("node").agg(F.first("shingle_set").alias("shingle_set"))
    blocks_ = F.ceil(F.col("n") / MEMBERS).cast("int")
    some = some.withColumn("blocks", blocks_).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    some = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 0).when(F.col("own") == low, -1).otherwise(1)
    some = some.select("key", low.alias("i"), high.alias("j"), side.alias("side"), "comp", "node").join(sets, "node").drop("node")
    return written(some.groupBy("key", "i", "j").applyInArrow(_block_links, "ca long, cb long").distinct(), "links")


def joined(placed: DataFrame, links: DataFrame) -> DataFrame:
    """placed with the components that links (ca, cb) join put together."""
    if links.isEmpty():
        return placed
    roots = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    return written(placed.join(roots, "comp", "left").select("key", "node", F.coalesce("root", "comp").alias("comp")), "bucket-members")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id (least doc_id of the class), class_size and kept for each row of docs.

    Rows of equal texts are one node, null and empty texts among them; texts are told apart by a 64-bit
    hash. Texts without words are similar to nothing but their equals. One row of each class is kept:
    that of the least doc_id, of the least hash among equal ids, of which a repeated row is one more
    copy. A null doc_id counts as greater than any other. An empty table gives no rows.
    """
    rows = written(signed(docs), "signatures")
    members = rows.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    placed = written(members.join(buckets, "key", "left_semi").distinct().withColumn("comp", F.col("node")), "bucket-members")
    ahead = left_apart(placed)
    for turn in range(TURNS):
        placed, before = joined(placed, verified(beside_leaders(placed, turn), rows)), ahead
        ahead = left_apart(placed)
        if ahead > GAIN * before or not ahead:
            break
    if ahead:
        placed = joined(placed, across(placed, rows))
    comp = placed.select("node", "comp").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("first")
    nodes = rows.groupBy("node").agg(first, F.count("*").alias("n"))  # copies are counted before anything is dealt by class
    nodes = nodes.join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "first", "n")
    nodes = written(nodes, "nodes")
    heads = nodes.groupBy("comp").agg(F.min(F.struct("first", "node")).alias("head"), F.sum("n").alias("class_size"))
    placed = written(nodes.select("node", "comp").join(heads, "comp").select("node", F.col("head.first.id").alias("class_id"), F.col("head.node").alias("kept_node"), "class_size"), "classes")
    out = rows.select("doc_id", "node").join(placed, "node")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("kept_node"))
    return out.select("doc_id", "node", "class_id", "class_size", kept.alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that classes() keeps, one of each class, with the columns of docs.

    What joins with the texts is the ids and hashes of the rows to drop, and of those that are there more
    than once; few enough, they are broadcast and no text is shuffled. Null and empty texts are texts like
    others, so one row of each stays; an empty table stays empty. Columns of docs may have any names.
    """
    id_, node, many, hash_ = fresh(docs, "id", "node", "many", "hash")
    key = [F.col("doc_id").alias(id_), F.col("node").alias(node)]
    pairs = classes(docs).groupBy(*key).agg(F.max("kept").alias("kept"), F.count("*").alias(many)).where(~F.col("kept") | (F.col(many) > 1))
    pairs = written(pairs, "rows-to-drop")
    rows = docs.withColumn(hash_, text_hash())
    same = rows["doc_id"].eqNullSafe(F.col(id_)) & (rows[hash_] == F.col(node))
    out = rows.join(small(pairs.select(id_, node)), same, "left_anti")
    again = pairs.where("kept").select(id_, node)
    if not again.isEmpty():
        out = out.unionByName(rows.join(small(again), same, "left_semi").dropDuplicates(["doc_id", hash_]))
    return out.drop(hash_)
