"""Sampled SentencePiece segmentations without replacement, by perturbed A* search over the lattice.

The lattice of a text has a node at each byte and an edge for each vocabulary piece that fits (for a
character that is no piece, an edge of its byte pieces). Backward sums make it locally normalised, so a
path's probability is the product of its edges' and a random walk samples from all segmentations.
The search gives each node the maximum of Gumbel-perturbed log-probabilities below it: the best child
inherits its parent's value, the other children together get a Gumbel value truncated by it. Popping
the best open node K times gives K distinct segmentations, as Gumbel top-k does, without listing any
others; the next open value is the threshold of the inclusion probabilities.

Pieces never cross the start of a run of spaces or a line feed, so edges and sums are found once for
each distinct unit between those and used at all its places. A walk is one array pass for all texts of
a block. Random numbers depend on the row's key, the sample and the byte alone.

The model file is a BPE vocabulary, whose scores are ranks; a piece's weight is taken by Zipf's law as
-ln(rank + 2) - ln(the sum of 1 / (rank + 2)).
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import GOLDEN, Hasher, Lookup, blocks, mix, ranges, released

K, BLOCK = 3, 1 << 18
#: Nodes of units kept between blocks, and slots to find the units by.
KEEP, SLOTS = 600_000, 1 << 19
#: The weight of a byte piece; units of SHORT bytes have sums above the least double.
BYTE_WEIGHT, SHORT = -12.0, 48
#: Open nodes draw from 32-bit uniforms, for which -ln(-ln(u)) never exceeds TOP; so a node with a log-mass
#: below an open value - TOP can't beat it. What is left beside an edge is 1 - its likelihood, and below LEAST, where
#: that difference loses its digits, the sum of the other edges'.
TOP, DEEP, LEAST = 23.0, -34.0, 1e-9
_models: dict[str, "Vocabulary"] = {}


def uniform(seed: np.ndarray, sample: int, at: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 53 bits of a hash of (seed, sample, place)."""
    z = mix(seed + ((at.astype(np.uint64) << np.uint64(8)) + np.uint64(sample)) * GOLDEN)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def prefix(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A place in 0..2**18-1 for three bytes."""
    x = (a.astype(np.uint32) << np.uint32(16)) | (b.astype(np.uint32) << np.uint32(8)) | c
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int64)


class Vocabulary:
    """Pieces by the hash of their bytes, a space standing for the word mark."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.bytes = [b""] * n
        plain = []
        for i in range(n):
            if m.is_byte(i):
                self.bytes[i] = bytes([int(m.id_to_piece(i)[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.bytes[i] = m.id_to_piece(i).replace("▁", " ").encode()
                plain.append(i)
        self.byte_id = np.zeros(256, np.int32)
        self.byte_id[[self.bytes[i][0] for i in range(n) if m.is_byte(i)]] = [i for i in range(n) if m.is_byte(i)]
        rank = np.minimum(-np.array([m.get_score(i) for i in plain]), n)
        weight = -np.log(rank + 2) - np.log((1 / (rank + 2)).sum())
        size = np.array([len(self.bytes[i]) for i in plain])
        ends = np.cumsum(size)
        key = Hasher(np.frombuffer(b"".join(self.bytes[i] for i in plain), np.uint8))(ends - size, ends)
        self.lengths = np.unique(size)
        self.find = Lookup(key)
        self.id, self.weight = np.array(plain, np.int32), weight
        #: The length of the longest piece by the hash of its first three bytes.
        self.reach = np.zeros(1 << 18, np.uint8)
        long_ = np.flatnonzero(size >= 3)
        text = np.frombuffer(b"".join(self.bytes[plain[i]][:3] for i in long_), np.uint8).reshape(-1, 3)
        np.maximum.at(self.reach, prefix(text[:, 0], text[:, 1], text[:, 2]), size[long_].astype(np.uint8))
        self.out = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.out_size = np.array([len(b) for b in self.bytes], np.int32)
        self.out_at = np.cumsum(self.out_size, dtype=np.int32) - self.out_size
        self.lattice = Lattice(self)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a text's ids, with the space put before it."""
        size = self.out_size[ids]
        ends = np.cumsum(size, dtype=np.int32)
        place = np.repeat(self.out_at[ids] - (ends - size), size)
        place += np.arange(len(place), dtype=np.int32)
        return self.out[place]


def vocabulary(path: str) -> Vocabulary:
    if path not in _models:
        _models[path] = Vocabulary(path)
    return _models[path]


class Lattice:
    """Edges of distinct units by node, longest first; byte-fallback edges have id -1.

    Units met more than once in a block are kept for later blocks, up to KEEP nodes; the others' nodes
    come after them and are dropped with the block.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.key, self.base = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.kept = 0
        self.first, self.degree = np.zeros(1, np.int32), 0
        self.length, self.id = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.logp, self.upto = np.zeros(0), np.zeros(0)

    def place(self, buf: np.ndarray, hashed: Hasher, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first node of each unit (bytes start..end), whose edges are built if they aren't there."""
        self._cut(self.kept)
        h = hashed(start, end)
        slot = (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        node = np.where(self.key[slot] == h, self.base[slot], -1).astype(np.int64)
        missing = np.flatnonzero(node < 0)
        new, at, of, many = np.unique(h[missing], return_index=True, return_inverse=True, return_counts=True)
        at = missing[at]
        size = end[at] - start[at]
        keep = (many > 1) & (self.key[slot[at]] == 0)
        keep &= self.kept + np.cumsum(size * keep) <= KEEP
        self.key[slot[at[keep]]] = new[keep]  # of several that want a slot the last has it
        keep &= self.key[slot[at]] == new
        order = np.argsort(~keep, kind="stable")
        base = np.empty(len(at), np.int64)
        base[order] = self.kept + np.cumsum(size[order]) - size[order]
        self.base[slot[at[keep]]] = base[keep]
        self._build(buf, hashed, start[at[order]], end[at[order]])
        self.kept += int(size[keep].sum())
        node[missing] = base[of]
        return node

    def _cut(self, nodes: int) -> None:
        edges = int(self.first[nodes])
        self.first = self.first[: nodes + 1]
        self.length, self.id, self.logp, self.upto = self.length[:edges], self.id[:edges], self.logp[:edges], self.upto[:edges]

    def _build(self, buf: np.ndarray, hashed: Hasher, start: np.ndarray, end: np.ndarray) -> None:
        if not len(start):
            return
        v, size = self.v, end - start
        at = ranges(start, size)  # the byte of each node
        left = np.repeat(end, size) - at
        head = (buf[at] & 0xC0) != 0x80
        head[np.cumsum(size) - size] = True
        heads = np.flatnonzero(head)
        char = np.zeros(len(at), np.int64)
        char[heads] = np.minimum(np.diff(heads, append=len(at)), left[heads])
        three = heads[left[heads] >= 3]
        reach = np.minimum(left, 2)
        reach[three] = np.clip(v.reach[prefix(buf[at[three]], buf[at[three] + 1], buf[at[three] + 2])], 2, left[three])
        parts, degree, one, open_ = [], np.zeros(len(at), np.int64), np.zeros(len(at), bool), heads
        for n in v.lengths.tolist():
            open_ = open_[reach[open_] >= n]
            piece = v.find(hashed(at[open_], at[open_] + n))
            hit = piece >= 0
            hit, piece = open_[hit], piece[hit]
            parts.append((hit, n, v.id[piece], v.weight[piece]))
            degree[hit] += 1
            one[hit[char[hit] == n]] = True
        bare = heads[~one[heads]]
        parts.append((bare, char[bare], -1, BYTE_WEIGHT * char[bare]))
        degree[bare] += 1
        first = np.concatenate([[0], np.cumsum(degree)])
        place, edges = first[:-1].copy(), int(first[-1])
        length, ids, weight = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges)
        for hit, n, i, w in parts[::-1]:
            to = place[hit]
            length[to], ids[to], weight[to] = n, i, w
            place[hit] = to + 1
        node = np.repeat(np.arange(len(at)), degree)
        total = self._backward(left, node, length, weight)
        after = node + length
        logp = np.minimum(weight + np.where(left[node] == length, 0.0, total[np.minimum(after, len(at) - 1)]) - total[node], 0.0)
        self.degree = max(self.degree, int(degree.max()))
        run = np.concatenate([[0.0], np.cumsum(np.exp(logp))])
        upto = run[1:] - np.repeat(run[first[:-1]], degree)
        upto[(first[1:] - 1)[degree > 0]] = 2.0  # rounding never leads past a node's edges
        self.first = np.concatenate([self.first, (first[1:] + len(self.id)).astype(np.int32)])
        self.length, self.id = np.concatenate([self.length, length]), np.concatenate([self.id, ids])
        self.logp, self.upto = np.concatenate([self.logp, logp]), np.concatenate([self.upto, upto])

    @staticmethod
    def _backward(left: np.ndarray, node: np.ndarray, length: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """ln of the summed weights of all ways from each node to the end of its unit: nearest nodes first."""
        total = np.full(len(left), -np.inf)
        far = left[node]
        order = np.argsort(far.astype(np.uint16) if far.max(initial=0) < 1 << 16 else far, kind="stable")
        node, length, weight, far = node[order], length[order], weight[order], far[order]
        cuts = np.flatnonzero(np.diff(far, prepend=-1)).tolist()
        plain, share = np.zeros(len(left)), np.exp(weight)
        for a, b in zip(cuts, [*cuts[1:], len(far)]):
            n, size = node[a:b], length[a:b]
            done = size == far[a]
            new = np.flatnonzero(np.diff(n, prepend=-1))
            to = np.where(done, n, n + size)
            if far[a] <= SHORT:  # sums that can't underflow
                plain[n[new]] = np.add.reduceat(share[a:b] * np.where(done, 1.0, plain[to]), new)
                total[n[new]] = np.log(plain[n[new]])
                continue
            x = weight[a:b] + np.where(done, 0.0, total[to])
            top = np.maximum.reduceat(x, new)
            total[n[new]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(new, append=b - a))), new))
        return total

    def others(self, node: np.ndarray, taken: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
        """The probability of a node's edges that aren't taken (bits); with share, the edge where that part of it is reached."""
        total, chosen = np.zeros(len(node)), np.full(len(node), -1)
        for k in range(self.degree):
            e = self.first[node] + k
            open_ = np.flatnonzero((e < self.first[node + 1]) & ((taken >> np.uint64(k)) & np.uint64(1) == 0))
            if share is not None:  # the last edge that begins before the share is reached
                reached = open_[(total[open_] < share[open_]) | (chosen[open_] < 0)]
                chosen[reached] = e[reached]
            total[open_] += np.exp(self.logp[e[open_]])
        return total if share is None else chosen


NODE = np.dtype([("doc", "i8"), ("value", "f8"), ("byte", "i8"), ("taken", "u8"), ("path", "i8")])


class Path:
    """A sample's edges (at the byte where each begins, else -1) in the texts that have it, their values,
    and where it left an earlier path by an edge other than those taken there."""

    def __init__(self, edge, docs, value, left, taken):
        self.edge, self.docs, self.value, self.left, self.taken = edge, docs, value, left, taken


class Block:
    """The search in a block of texts (buf: each text that isn't empty has a space put before it)."""

    def __init__(self, v: Vocabulary, buf: np.ndarray, off: np.ndarray, seed: np.ndarray):
        self.v, self.buf, self.off, self.seed = v, buf, off, seed
        space, feed = buf == 32, buf == 10
        cut = np.zeros(len(buf), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
        cut[off[:-1][off[1:] > off[:-1]]] = True
        self.start = np.flatnonzero(cut)
        self.end = np.append(self.start[1:], len(buf))
        hashed = Hasher(buf)
        self.lattice = v.lattice
        self.shift = v.lattice.place(buf, hashed, self.start, self.end) - self.start  # from a byte to its node, for each unit
        self.first_unit = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first_unit))

    def unit(self, byte: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, byte, "right") - 1

    def walk(self, sample: int, edge: np.ndarray, at: np.ndarray, unit: np.ndarray) -> None:
        """Take random edges from bytes `at` of units `unit` to the units' ends."""
        g = self.lattice
        shift, end, doc = self.shift[unit], self.end[unit], self.doc[unit]
        seed, begin = self.seed[doc], self.off[doc]
        while len(at):
            u = uniform(seed, sample, at - begin)
            e = g.first[at + shift]
            more = np.flatnonzero(u > g.upto[e])
            while len(more):
                e[more] += 1
                more = more[u[more] > g.upto[e[more]]]
            edge[at] = e
            at = at + g.length[e]
            on = np.flatnonzero(at < end)
            at, shift, end, seed, begin = at[on], shift[on], end[on], seed[on], begin[on]

    def search(self, k: int):
        """Yields (texts, their edges, ln p of each text, value of each text) for each sample, best first;
        last (texts, None, None, value of each text's next open node)."""
        docs = len(self.off) - 1
        value = -np.log(-np.log(uniform(self.seed, 255, np.zeros(docs, np.int64))))
        edge = np.full(len(self.buf), -1, np.int32)
        self.walk(0, edge, self.start, np.arange(len(self.start)))
        path = Path(edge, np.arange(docs), value, self.off[:-1], np.zeros(docs, np.uint64))
        paths, frontier = [path], np.zeros(0, NODE)
        for sample in range(k):
            at = np.flatnonzero(path.edge >= 0)
            run = np.concatenate([[0.0], np.cumsum(self.lattice.logp[path.edge[at]])])
            fall = -run
            bound = np.searchsorted(at, self.off)
            yield path.docs, path.edge, (run[bound[1:]] - run[bound[:-1]])[path.docs], path.value
            frontier = np.concatenate([frontier, self.beside(path, sample, at, run, fall, bound, k - sample)])
            frontier = frontier[np.lexsort((-frontier["value"], frontier["doc"]))]
            head = np.diff(frontier["doc"], prepend=-1) != 0
            best, frontier = frontier[head], frontier[~head]
            if sample + 1 == k or not len(best):
                yield best["doc"], None, None, best["value"]
                return
            path = self.branch(best, sample + 1, paths)
            paths.append(path)

    def beside(self, path: Path, sample: int, at: np.ndarray, run: np.ndarray, fall: np.ndarray, bound: np.ndarray, need: int) -> np.ndarray:
        """Open nodes off a new path, from where it left its parent: at each step, all edges it didn't take.

        Steps that lie deeper than DEEP are looked at where fewer than `need` nodes above beat what they
        could reach; so nothing that may be popped is left out.
        """
        first, last, base = np.searchsorted(at, path.left), bound[1:][path.docs], run[bound[:-1][path.docs]]
        n = np.maximum(last - first, 0)
        near = np.clip(np.searchsorted(fall, -(base + DEEP), "right") - first, 1, None)
        rows = self.nodes(path, sample, at, run, first, np.minimum(n, near), base)
        rows = rows[rows["value"] >= DEEP + TOP]  # what steps that are left out could reach, too
        good = np.bincount(rows["doc"], minlength=len(self.off) - 1)[path.docs]
        again = good < need
        if again.any():
            rows = np.concatenate([rows[~np.isin(rows["doc"], path.docs[again])], self.nodes(path, sample, at, run, first, n * again, base)])
        rows = rows[np.lexsort((-rows["value"], rows["doc"]))]
        return rows[np.arange(len(rows)) - np.searchsorted(rows["doc"], rows["doc"]) < need]

    def nodes(self, path, sample, at, run, first, n, base) -> np.ndarray:
        g, own = self.lattice, np.repeat(np.arange(len(n)), n)
        step = ranges(first, n)
        byte, doc = at[step], path.docs[own]
        node = byte + self.shift[self.unit(byte)]
        taken = np.uint64(1) << (path.edge[byte] - g.first[node]).astype(np.uint64)
        taken = np.where(byte == path.left[own], taken | path.taken[own], taken)
        rest = -np.expm1(g.logp[path.edge[byte]])
        several = (taken & (taken - np.uint64(1))) != 0  # more than one edge taken
        forks = g.first[node + 1] - g.first[node] > 1
        rest[~forks] = 0
        again = np.flatnonzero((several | (rest <= LEAST)) & forks)
        rest[again] = g.others(node[again], taken[again])
        some = np.flatnonzero(rest > 0)
        own, byte, doc = own[some], byte[some], doc[some]
        phi = run[step[some]] - base[own] + np.log(rest[some])
        u = np.floor(uniform(self.seed[doc], 128 + sample, byte - self.off[doc]) * 2.0**32) * 2.0**-32 + 2.0**-33
        out = np.zeros(len(some), NODE)
        out["doc"], out["byte"], out["taken"], out["path"] = doc, byte, taken[some], sample
        out["value"] = phi - np.log(np.exp(np.minimum(phi - path.value[own], 700)) - np.log(u))
        return out

    def branch(self, popped: np.ndarray, sample: int, paths: list[Path]) -> Path:
        """The best path below each popped node: an edge that isn't taken there, then a fresh walk."""
        g, doc, byte = self.lattice, popped["doc"], popped["byte"]
        edge = np.full(len(self.buf), -1, np.int32)
        for q, earlier in enumerate(paths):
            own = popped["path"] == q
            same = ranges(self.off[doc[own]], byte[own] - self.off[doc[own]])
            edge[same] = earlier.edge[same]
        unit = self.unit(byte)
        node = byte + self.shift[unit]
        u = uniform(self.seed[doc], sample, byte - self.off[doc])
        edge[byte] = e = g.others(node, popped["taken"], u * g.others(node, popped["taken"]))
        at = byte + g.length[e]
        inside = at < self.end[unit]
        later = ranges(unit + 1, self.first_unit[doc + 1] - unit - 1)
        self.walk(sample, edge, np.concatenate([at[inside], self.start[later]]), np.concatenate([unit[inside], later]))
        return Path(edge, doc, popped["value"], byte, popped["taken"])

    def ids(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a sample, and each text's number of them."""
        at = np.flatnonzero(edge >= 0)
        e = edge[at]
        ids, size = self.lattice.id[e], np.ones(len(e), np.int64)
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            size[bare] = self.lattice.length[e[bare]]
            ids = np.repeat(ids, size)
            ids[ids < 0] = self.v.byte_id[self.buf[ranges(at[bare], size[bare])]]
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(upto[np.searchsorted(at, self.off)])


def spaced(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty."""
    full = off[1:] > off[:-1]
    return np.insert(buf, off[:-1][full], 32), off + np.concatenate([[0], np.cumsum(full)])


def samples(v: Vocabulary, buf: np.ndarray, off: np.ndarray, seed: np.ndarray, k: int):
    """For each sample of a block: texts, ids, each text's number of ids, ln p, value, ln of the inclusion probability."""
    block = Block(v, *spaced(buf, off), seed)
    *found, (docs, _, _, following) = list(block.search(k))
    threshold = np.full(len(off) - 1, -np.inf)
    threshold[docs] = following
    for docs, edge, logp, value in found:
        x = logp - threshold[docs]
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(x))))
        ids, size = block.ids(edge)
        yield docs, ids, size[docs], logp, value, inclusion


def _task(model: str, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            key = np.asarray(batch.column(0).fill_null(0), np.int64).astype(np.uint64)
            for lo, hi, buf, off in blocks(batch, "text", BLOCK):
                for number, (docs, ids, size, logp, value, inclusion) in enumerate(samples(v, buf, off, mix(key[lo:hi] + np.uint64(1)), k)):
                    text, raw = v.decode(ids).tobytes(), ids.astype("<u4").tobytes()
                    ends = np.cumsum(size)
                    chars = np.concatenate([[0], np.cumsum(v.out_size[ids])])
                    a, b = chars[ends - size].tolist(), chars[ends].tolist()
                    cut = list(zip((4 * (ends - size)).tolist(), (4 * ends).tolist()))
                    crc = [zlib.crc32(raw[x:y]) for x, y in cut]
                    back = [zlib.crc32(text[x + 1 : y]) for x, y in zip(a, b)]  # without the space put before
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                    rows = [pa.array(np.full(len(docs), number, np.int32)), lists, *map(pa.array, (size, np.array(crc, np.int64), np.array(back, np.int64), logp, value, inclusion))]
                    yield pa.record_batch([batch.column(0)[lo:hi].take(pa.array(docs)), *rows], ["doc_id", *SAMPLE])
        v.lattice = Lattice(v)
        released()

    return task


SAMPLE = {"sample": "int", "ids": "array<int>", "n_tokens": "long", "ids_crc32": "long", "decoded_crc32": "long", "log_prob": "double", "gumbel": "double", "log_inclusion": "double"}


def sample_segmentations(docs: DataFrame, model: str, k: int = K) -> DataFrame:
    """Up to k rows for each row of docs: distinct sampled segmentations, best perturbed value first.

    ids are the segmentation's piece ids, n_tokens their number; decoded() gives their text. ids_crc32 (of
    the ids as little-endian u32) and decoded_crc32 (of the bytes they decode to, the text's own) are
    digests of them for checks. log_inclusion is ln of the chance that the segmentation is
    among the k (0 where all there are were given). A null or empty text has one empty segmentation, a very
    long one is searched whole; rows of equal doc_id and text get equal samples; a null doc_id draws as 0
    does; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_task(model, k), "doc_id long, " + ", ".join(f"{c} {t}" for c, t in SAMPLE.items()))


def decoded(rows: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with the text that their ids decode to, without the space that is put before; null where ids is null."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            texts = [None if not x.is_valid else v.decode(np.asarray(x.values, np.int64)).tobytes()[1:].decode(errors="replace") for x in col]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    keep = rows.drop(name)
    return keep.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields) + f", `{name}` string")
