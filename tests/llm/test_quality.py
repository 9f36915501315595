import re
from collections import Counter

import duckdb
import pytest

from varlens.llm import quality, queries


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    many = Counter(zip(w, w[1:], w[2:]))
    cover = {k + d for k in range(len(w) - 2) if many[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(cover)


def test_measures_of_odd_texts(odd_docs):
    rows = quality.ledger(odd_docs)
    assert sorted(tuple(r[m] for m in quality.MEASURES) for r in rows.collect()) == sorted(plain(r.text) for r in odd_docs.collect())


def test_empty_table(no_docs):
    assert quality.apply_policy(quality.ledger(no_docs), 2).count() == 0


def test_ablation_by_bits(spark):
    rows = spark.createDataFrame([(1, 1), (2, 5), (3, 4), (4, 0), (5, 32), (6, 4)], "doc_id long, fail_bits long")
    got = {r.rule: (r.n_fail, r.n_only, r.n_kept_without) for r in quality.ablation(rows, 2).collect()}
    assert got == {"few_words": (2, 1, 3), "repeat_words": (0, 0, 2), "symbols": (3, 2, 4), "dup_lines": (0, 0, 2), "word_length": (0, 0, 2)}
    assert quality.apply_policy(rows, 1).where("kept").count() == 4


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.OP1_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op1_quality_ledger(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got == want[got.columns]).all().all()


def test_policy_keeps_good_documents(spark, sf01):
    rows = queries.op1_quality_ledger(spark, sf01).join(spark.read.parquet(f"{sf01}/labels.parquet"), "doc_id")
    assert rows.where("quality = 1 AND NOT base_failed AND NOT kept").count() == 0
    assert rows.where("quality = 0 AND kept").count() == 0


@pytest.mark.parametrize("text", ["a a a a a", "x\nx\n\nx", "é|é", "a b c a b c"])
def test_small_texts(spark, text):
    row = quality.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(row[m] for m in quality.MEASURES) == plain(text)
