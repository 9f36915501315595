import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from varlens.llm import queries, segment
from varlens.llm.words import blocks, mix

MODEL = queries.PIECE_MODEL


def every(text):
    """ln p of all segmentations of a text."""
    v = segment.vocabulary(MODEL)
    weight = dict(zip(v.id.tolist(), v.weight.tolist()))
    piece = {v.bytes[i]: i for i in weight}
    raw = f" {text}".encode() if text else b""
    out = {}

    def go(at, ids, w):
        if at == len(raw):
            out[tuple(ids)] = w
            return
        n = len(raw[at:].decode()[0].encode())
        for size in range(1, len(raw) - at + 1):
            if (i := piece.get(raw[at : at + size])) is not None:
                go(at + size, [*ids, i], w + weight[i])
        if raw[at : at + n] not in piece:
            go(at + n, [*ids, *v.byte_id[list(raw[at : at + n])].tolist()], w + segment.BYTE_WEIGHT * n)

    go(0, [], 0.0)
    whole = np.logaddexp.reduce(list(out.values()))
    return {k: w - whole for k, w in out.items()}


def drawn(texts, k, salt=1):
    out = [[] for _ in texts]
    for lo, hi, buf, off in blocks(pa.record_batch([pa.array(texts)], ["text"]), "text"):
        for docs, ids, size, logp, value, inclusion in segment.samples(segment.vocabulary(MODEL), buf, off, mix(np.arange(lo, hi).astype(np.uint64) + np.uint64(salt)), k):
            ends = np.cumsum(size)
            for d, a, b, *rest in zip(docs.tolist(), (ends - size).tolist(), ends.tolist(), logp, value, inclusion):
                out[lo + d].append((tuple(ids[a:b].tolist()), *rest))
    return out


@pytest.mark.parametrize("text", ["ab", "the cat", "Hé 😀\nx", "  a b ", "", "▁x", "a\n\nb"])
def test_samples_are_distinct_segmentations(text):
    want, got = every(text), drawn([text], 6)[0]
    assert len(got) == len({g[0] for g in got}) == min(6, len(want))
    assert all(abs(want[ids] - logp) < 1e-9 for ids, logp, *_ in got)
    values = [g[2] for g in got]
    assert values == sorted(values, reverse=True)
    if len(want) <= 6:
        assert all(g[3] == 0 for g in got)


def test_draws_without_replacement_have_their_chances():
    """First and second draws, and inverse inclusion chances, against the exact ones."""
    n, p = 20_000, {s: np.exp(x) for s, x in every("the cat").items()}
    got = drawn(["the cat"] * n, 2)
    first, second = Counter(g[0][0] for g in got), Counter(g[1][0] for g in got)
    then = {s: sum(p[q] * p[s] / (1 - p[q]) for q in p if q != s) for s in p}
    for want, seen in ((p, first), (then, second)):
        assert all(abs(seen[s] / n - x) < 4.5 * np.sqrt(x * (1 - x) / n) + 1e-4 for s, x in want.items())
    assert abs(np.mean([sum(np.exp(x[1] - x[3]) for x in g) for g in got]) - 1) < 0.05


def test_blocks_and_seeds_do_not_matter_but_keys_do(spark, odd_docs, monkeypatch):
    shown = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in segment.sample_segmentations(df, MODEL).collect())
    one = shown(odd_docs)
    monkeypatch.setattr(segment, "BLOCK", 64)
    assert one == shown(odd_docs.repartition(3))


def test_decoding_gives_the_text_back(odd_docs):
    want = {(r.doc_id, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect()}
    rows = segment.sample_segmentations(odd_docs, MODEL).collect()
    assert {(r.doc_id, r.decoded_crc32) for r in rows} == want
    assert len({(r.doc_id, r.decoded_crc32, r.ids_crc32) for r in rows if r.doc_id == 4}) == segment.K


def test_unlikely_edges_are_drawn_where_there_are_no_others():
    """A word whose other segmentations have chances far below 1e-15 still gives as many samples as it has segmentations."""
    v = segment.vocabulary(MODEL)
    lattice = segment.Lattice(v)
    buf = np.frombuffer(b" the", np.uint8)
    lattice.place(buf, segment.Hasher(buf), np.array([0]), np.array([4]))
    rest = [-np.expm1(x) for x in lattice.logp]
    assert len(rest) > 4
    own = v.weight.copy()
    try:
        piece = v.find(segment.Hasher(buf)(np.array([0]), np.array([4])))[0]
        v.weight = np.where(np.arange(len(own)) == piece, 40.0, own)  # the whole word outweighs all else by e**40 and more
        v.lattice = segment.Lattice(v)
        got = drawn(["the"], 6)[0]
        assert len(got) == len({g[0] for g in got}) == 6
        assert got[0][1] > -1e-15 and all(g[1] < -36 for g in got[1:])
    finally:
        v.weight, v.lattice = own, segment.Lattice(v)


def test_library_decodes_the_documents(spark, sf01):
    """The ids that the operator gives for all documents, decoded by the library, are the texts."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = segment.sample_segmentations(docs, MODEL).select("doc_id", "sample", "ids").collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(m.decode(list(r.ids)) == texts[r.doc_id] for r in rows)
    assert len({(r.doc_id, tuple(r.ids)) for r in rows}) == len(rows)


def test_library_decodes_the_samples():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("Hello  world\nnew\tline", " lead", "日本😀x y", "naïve"):
        assert {m.decode(list(g[0])) for g in drawn([text], 4)[0]} == {text}


def test_empty_table(no_docs):
    assert segment.sample_segmentations(no_docs, MODEL).count() == 0


def test_ids_leave_the_operator_and_decode_to_the_text(odd_docs, no_docs):
    rows = segment.decoded(segment.sample_segmentations(odd_docs, MODEL), MODEL).collect()
    assert {(r.doc_id, r.decoded) for r in rows} == {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    assert all(len(r.ids) == r.n_tokens and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert segment.decoded(segment.sample_segmentations(no_docs, MODEL), MODEL).count() == 0


def test_pipeline_ends_in_ids(spark, odd_docs, sf_dir):
    name, stage = pipeline.STAGES[-1]
    assert dict(stage(spark, odd_docs, sf_dir).dtypes)["ids"] == "array<int>"
    assert "ids" not in queries.op6_gumbel_segments(spark, sf_dir).columns
