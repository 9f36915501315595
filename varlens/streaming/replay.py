"""Incremental replay of store logs with Structured Streaming.

State is kept for each image: its working set, the sequence number and hash that the next record must
name, and whether the log is torn. A record out of sequence or with a wrong link is never waited for: the
log ends there, and what follows is refused until a checkpoint row starts the image anew. Spark's state
store repeats a micro-batch from the state before it, so a retry sees no record twice, and a record that
comes again is a torn log as any other.

A checkpoint row (op CHECKPOINT, data the checkpoint's bytes, sequence its next one) is how a stream starts
from a compacted image, and how it goes on after one is compacted.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.logstore import checkpoint_head, checkpoint_rows
from ..operators.workset import Variable, WorkingSet

OUT = "image_id string, sequence long, error string, guid binary, name_wire binary, attributes long, data binary"
STATE = "next_sequence long, previous string, torn boolean, capacity long, authenticated long, variables string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    following, previous, torn, capacity, authenticated, held = state.get if state.exists else (0, "", True, 0, 0, "[]")
    w = WorkingSet(capacity, authenticated=authenticated)
    for attributes, *parts in json.loads(held):
        guid, name, data, time = map(bytes.fromhex, parts)
        w.put(guid, name, attributes, data, time)
    rows = pd.concat(list(batches))  # one image's part of one micro-batch
    rows = rows.assign(later=rows["op"] != "CHECKPOINT").sort_values(["sequence", "later"], kind="stable")
    out = []
    for r in rows.itertuples():
        if r.op == "CHECKPOINT":
            status, found = checkpoint_rows(bytes(r.data))
            following, previous, authenticated = checkpoint_head(bytes(r.data))
            torn, w = status != "OK", WorkingSet(len(r.data), authenticated=authenticated)
            for _, attributes, name, data, guid, time in found:
                w.put(guid, name, attributes, data, time)
            out.append((key[0], r.sequence, status, None, None, None, None))
            continue
        name, guid = bytes(r.name_wire), bytes(r.guid)
        torn = torn or not r.hash_ok or r.sequence != following or bytes(r.prev_hash).hex() != previous
        error = "Record" if torn else w.apply(r.op, int(r.attributes), guid, name, bytes(r.data))
        if not torn:
            following, previous = following + 1, bytes(r.hash).hex()
        now = w.values.get((guid, name), Variable(None, None))
        out.append((key[0], r.sequence, error, guid, name, now.attributes, now.data))
    variables = json.dumps([(v.attributes, g.hex(), n.hex(), v.data.hex(), v.time.hex()) for (g, n), v in w.values.items()])
    state.update((int(following), previous, bool(torn), w.capacity, w.authenticated, variables))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
    yield frame.astype({"attributes": "Int64"})


def outcomes(records: DataFrame) -> DataFrame:
    """A row for each record of streaming logs: its error (or OK) and its key's state after it.

    records: image_id, sequence, prev_hash, hash, hash_ok, op, attributes, guid, name_wire, data, as
    logstore.log_records gives them; an image's first row is a checkpoint row.
    """
    rows = records.withColumns({"image_id": F.col("image_id").cast("string"), "sequence": F.col("sequence").cast("long")})
    return rows.groupBy("image_id").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def checkpoints(images: DataFrame) -> DataFrame:
    """The checkpoint rows that streams of images (logstore.parts) start from."""
    from ..functions import wire

    null = lambda kind: F.lit(None).cast(kind)
    return images.select(
        "image_id", wire.uint("checkpoint", 16, 8).cast("long").alias("sequence"), null("binary").alias("prev_hash"), null("binary").alias("hash"), F.lit(True).alias("hash_ok"), F.lit("CHECKPOINT").alias("op"),
        null("long").alias("attributes"), null("binary").alias("guid"), null("binary").alias("name_wire"), F.col("checkpoint").alias("data"),
    )


def live(outcome_rows: DataFrame) -> DataFrame:
    """Live variables that collected outcomes leave beside those of the checkpoints: each key's last state."""
    last = outcome_rows.where("error <> 'Record' AND name_wire IS NOT NULL").groupBy("image_id", "guid", "name_wire").agg(F.max_by(F.struct("attributes", "data"), "sequence").alias("s"))
    return last.select("image_id", "guid", "name_wire", "s.attributes", "s.data").where("attributes IS NOT NULL")
