"""Broadcasts go by counted rows and bytes."""

from varlens.llm import scratch


def test_broadcasts_are_bounded_in_rows_and_bytes(spark, monkeypatch):
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) AS text", "array_repeat(id, 50) AS ids")
    hinted = lambda: "broadcast" in scratch.small(df)._jdf.queryExecution().logical().toString().lower()
    assert hinted()
    assert df.select(scratch.row_bytes(df.schema).alias("b")).first().b == 8 + 1000 + 8 * 50
    monkeypatch.setattr(scratch, "MOST_BYTES", 100_000)
    assert not hinted()
    monkeypatch.setattr(scratch, "MOST_BYTES", 200_000)
    monkeypatch.setattr(scratch, "MOST_ROWS", 99)
    assert not hinted()
