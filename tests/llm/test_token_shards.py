import zlib
from pathlib import Path

import numpy as np
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from varlens.llm import mph, queries, scratch, token_shards
from varlens.sources import scratch as tables

PATH = queries.WORD_MODEL


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n))
    salt, seeds = mph.build(keys)
    assert sorted(mph.find(keys, salt, seeds, len(keys))) == list(range(len(keys)))


def expected(rows):
    t = Tokenizer.from_file(PATH)
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    out, at = [], 0
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        out.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def test_odd_texts_round_trip(odd_docs):
    base, manifest = token_shards.write_shards(odd_docs, PATH, shards=3)
    rows = token_shards.read_keys(odd_docs, base, manifest).orderBy("start").collect()
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows))) == sorted(map(str, expected(odd_docs.collect())))
    ends = np.cumsum([r.n_tokens for r in rows])
    assert [r.start for r in rows] == [0, *ends[:-1]]
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys)


def test_keyed_access_and_unknown_keys(spark, odd_docs):
    base, manifest = token_shards.write_shards(odd_docs.where("doc_id > 2"), PATH, shards=2)
    wanted = spark.createDataFrame([(4,), (99,), (9,), (9,)], "doc_id long")
    assert sorted(r.doc_id for r in token_shards.read_keys(wanted, base, manifest).collect()) == [4, 9]
    path = manifest.orderBy("shard").first().path
    shard = token_shards.Shard(pafs.LocalFileSystem(), path)
    first, count = shard.find(np.array([3, 12345]))
    assert count.tolist() == [1, 0] and shard.ids(int(first[0])).tolist() == [2]


def test_empty_table(no_docs):
    base, manifest = token_shards.write_shards(no_docs, PATH, shards=2)
    assert token_shards.read_keys(no_docs, base, manifest).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(), st.sampled_from(" \t\n'.,<|endoftext|>́  ")), max_size=40), min_size=1, max_size=6))
def test_words_give_the_texts_ids(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, size = token_shards.coder(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), off)
    t = Tokenizer.from_file(PATH)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert size.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_the_least_key_is_no_null(spark):
    docs = spark.createDataFrame([(-(2**63), "least"), (None, "none"), (None, "none at all"), (5, "five")], "doc_id long, text string")
    for shards in (1, 4):
        base, manifest = token_shards.write_shards(docs, PATH, shards=shards)
        rows = token_shards.read_keys(docs, base, manifest).orderBy("start").collect()
        assert [r.doc_id for r in rows] == [None, None, -(2**63), 5]
        one = token_shards.read_keys(docs.where("doc_id IS NOT NULL"), base, manifest).orderBy("start").collect()
        assert [(r.doc_id, r.start) for r in one] == [(r.doc_id, r.start) for r in rows[2:]]


def test_a_repeated_task_leaves_the_file_of_the_first_alone(spark, odd_docs, monkeypatch):
    """Two attempts of a task write two files; what the manifest names is read, whatever lies beside it."""
    base, manifest = token_shards.write_shards(odd_docs, PATH, shards=1)
    path = manifest.first().path
    assert path.rsplit("-", 1)[1].split(".")[0].isdigit()  # the attempt's number
    before = Path(path).read_bytes()
    Path(path.rsplit("-", 1)[0] + "-999999999.vlts").write_bytes(before[: len(before) // 2])  # of an attempt that was lost
    rows = token_shards.read_keys(odd_docs, base, manifest).collect()
    assert len(rows) == odd_docs.count() and Path(path).read_bytes() == before


def test_runs_side_by_side_and_no_local_folder_on_a_cluster(spark, monkeypatch):
    table = scratch.written(spark.range(5), "mine")
    monkeypatch.setattr(tables, "RUN", "varlens-other")
    other = scratch.written(spark.range(7), "theirs")
    scratch.drop_paths(spark)
    assert table.count() == 5
    with pytest.raises(Exception):
        other.count()

    class Cluster:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = type("Conf", (), {"get": staticmethod(lambda name, default: None)}), Cluster

    with pytest.raises(ValueError):
        scratch.shared_dir(Session)


def test_a_session_keeps_its_own_batch_size(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    scratch.small_batches(spark)
    assert spark.conf.get(name) == "10000"
    spark.conf.set(name, before)
