"""Window, fold and streaming replay agree with a plain sequential one."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from varlens.functions import rules, wire
from varlens.operators import logstore, replay, views, workset
from varlens.plans import mutation_log as ml
from varlens.streaming import replay as stream


def sequential(rows):
    state, outcomes = {}, []
    for r in sorted(rows, key=lambda r: (r.image_id, r.seq)):
        key = (r.image_id, r.guid, r.name)
        word, data = state.get(key, (None, None))
        error = rules.judge(r.op, r.attributes, len(r.data), word)
        if error == "OK" and not (r.op == "APPEND" and not r.data):
            if r.op == "DELETE":
                del state[key]
            else:
                state[key] = (r.attributes & ~64, data + r.data if r.op == "APPEND" and word is not None else r.data)
        outcomes.append((*key, r.seq, error))
    return state, outcomes


def test_fold_and_window(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for log in (ml.base_log(events), ml.rules_log(events)):
        state, outcomes = sequential(log.collect())
        folded = replay.fold(log)
        assert {tuple(r[:3]): tuple(r[3:5]) for r in replay.fold_live(folded).select(*replay.KEY, "attributes", "data").collect()} == state
        assert Counter(map(tuple, replay.fold_outcomes(folded).collect())) == Counter(outcomes)
    state, outcomes = sequential(ml.base_log(events).collect())
    live = replay.window_live(ml.base_log(events)).collect()
    assert {(r.image_id, r.guid, r.name): (r.attributes, r.data) for r in live} == state
    accepted = {(r.image_id, r.guid, r.name, r.seq): r.accepted for r in replay.window_verdicts(ml.base_log(events)).collect()}
    assert accepted == {o[:4]: o[4] == "OK" for o in outcomes}


def log(spark, *rows):
    return spark.createDataFrame([(0, k, 1, n, d, op, 7 | 64 * (op == "APPEND")) for k, (op, n, d) in enumerate(rows)], "image_id long, seq long, guid long, name string, data string, op string, attributes int")


def test_append_to_nothing_and_order(spark):
    df = log(spark, ("SET", "a", "1"), ("APPEND", "b", ""), ("APPEND", "a", "2"), ("SET", "c", "x"), ("DELETE", "a", ""), ("DELETE", "b", ""), ("APPEND", "a", "3"), ("SET", "c", "y"))
    live = {r.name: (r.data, r.ordinal) for r in views.stored_order(replay.window_live(df)).collect()}
    assert live == {"c": ("y", 1), "a": ("3", 2)}
    assert {r.seq for r in replay.window_verdicts(df).where("NOT accepted").collect()} == {5}
    assert {r.name: r.data for r in replay.fold_live(replay.fold(df)).collect()} == {"c": "y", "a": "3"}


def test_resolution_prefers_first_added_then_last_in_transition(spark):
    rows = [(0, 1, "a", o, s) for o, s in ((1, 62), (2, 63), (3, 63), (4, 62))] + [(0, 1, "b", 1, 62), (0, 1, "b", 5, 62), (0, 1, "c", 1, 61)]
    df = spark.createDataFrame(rows, "image_id long, guid long, name string, rec_offset long, state int")
    assert {(r.name, r.rec_offset) for r in views.resolve(df).collect()} == {("a", 2), ("b", 5)}


def test_chain_ends_at_the_first_break(spark):
    for broken in range(5):
        rows = [(0, k, f"h{k}", "x" if k == broken else f"h{k - 1}" if k else "cp") for k in range(5)]
        df = views.chain_checked(spark.createDataFrame(rows, "image_id long, seq long, hash string, prev_hash string"), F.lit("cp"))
        assert df.where("kept").count() == broken


@pytest.fixture(scope="module")
def image(spark, sf_dir):
    """One image with 40 mutations of the rules log, and its records."""
    log = ml.rules_log(spark.read.parquet(f"{sf_dir}/events.parquet")).where("image_id = 0 AND seq < 40")
    rows = log.select("image_id", F.col("seq").alias("place"), "op", "attributes", F.unhex(F.md5(F.col("guid").cast("string"))).alias("guid"), wire.name_bytes(F.col("name")).alias("name_wire"), F.encode("data", "UTF-8").alias("data"))
    images = logstore.encode_images(rows.limit(0).drop("op"), rows, 1 << 16, 8192)
    parts = logstore.parts(images)
    records = logstore.log_records(parts.select("image_id", F.col("log").alias("data")))
    fields = ["image_id", "sequence", "prev_hash", "hash", "hash_ok", "op", "attributes", "guid", "name_wire", "data"]
    return log.collect(), stream.checkpoints(parts).select(*fields), records.where("rec_no >= 0").select(*fields[:1], F.col("sequence").cast("long").alias("sequence"), *fields[2:])


def streamed(spark, tmp_path, name, files):
    source = str(tmp_path / "in")
    for rows in files:
        rows.coalesce(1).write.mode("append").parquet(source)
    query = stream.outcomes(spark.readStream.schema(files[0].schema).option("maxFilesPerTrigger", 1).parquet(source)).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_stream_equals_batch_for_any_split(spark, image, tmp_path):
    rows, start, records = image
    _, want = sequential(rows)
    out = streamed(spark, tmp_path, "whole", [start, *(records.where(f"sequence >= {a} AND sequence < {b}") for a, b in ((0, 14), (14, 15), (15, 40)))])
    assert [r.error for r in out.where("name_wire IS NOT NULL").orderBy("sequence").collect()] == [o[4] for o in sorted(want, key=lambda o: o[3])]


def test_a_gap_tears_the_log_until_a_checkpoint(spark, image, tmp_path):
    rows, start, records = image
    again = start.withColumn("sequence", F.lit(0).cast("long"))
    out = streamed(spark, tmp_path, "torn", [start, records.where("sequence < 5"), records.where("sequence > 5 AND sequence < 9"), records.where("sequence = 5"), again.unionByName(records.where("sequence < 3"))])
    errors = {}
    for r in out.where("name_wire IS NOT NULL").collect():
        errors.setdefault(r.sequence, []).append(r.error)
    assert all(e == ["Record"] for k, e in errors.items() if k >= 5)  # what is missing is not waited for
    assert all(len(errors[k]) == 2 and "Record" not in errors[k] for k in range(3))


def test_authenticated_times_rise_and_appends_keep_the_later(spark):
    def signed(year, value):
        return bytes([year % 256, year // 256, 1, 1, 0, 0, 0]) + bytes(9) + (32).to_bytes(4, "little") + bytes(28) + value

    w = workset.WorkingSet(4096, rules.with_keys, lambda guid, name, attributes, payload: payload[-1:] != b"!")
    key = (bytes(16), "k".encode("utf-16-le"))
    say = lambda op, year, value: w.apply(op, 39 | 64 * (op == "APPEND"), *key, signed(year, value))
    assert say("SET", 2020, b"a") == "OK" and say("SET", 2020, b"b") == "SecurityViolation" and say("SET", 2021, b"b") == "OK"
    assert say("APPEND", 2019, b"c") == "OK" and workset.time_key(w.values[key].time)[0] == 2021
    assert say("SET", 2030, b"forged!") == "SecurityViolation" and w.values[key].data == b"bc" and w.authenticated == 3
    assert w.apply("SET", 7, *key, b"plain") == "InvalidParameter" and say("DELETE", 2031, b"") == "OK" and not w.values
    assert workset.WorkingSet(4096).apply("SET", 39, *key, signed(2020, b"a")) == "SecurityViolation"  # the default policy
