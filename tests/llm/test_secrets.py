import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from varlens.llm import scratch, secrets

SECRET = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.labelled_findings(spark))


def test_labelled_findings_are_learned(spark):
    rows = secrets.labelled_findings(spark)
    train, test = rows.where(F.pmod(F.xxhash64("candidate", "before"), F.lit(4)) > 0), rows.where(F.pmod(F.xxhash64("candidate", "before"), F.lit(4)) == 0)
    from pyspark.ml.feature import VectorAssembler

    got = secrets.train(train).transform(VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(secrets.features(test)))
    assert got.where("prediction = label").count() / got.count() > 0.97


def test_scan_and_redaction(spark, model):
    docs = spark.createDataFrame(
        [
            (1, f'ein = und token = "{SECRET}" der 4785380592391139 und', "src1", 0), (2, f"commit {SECRET} fixes it", "src1", 0), (3, "see getUserAccountByIdentifier2 in https://host/a/b/index_of_files_2024.html", "docs/x.md", 0),
            (4, f'api_key: "{SECRET}", api_key: "{SECRET[::-1]}"\nend', None, 0), (5, None, None, None), (6, "", "s", 0),
        ],
        "doc_id long, text string, source string, n_chars long",
    )
    found = secrets.scan(docs, model=model)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found.collect():
        assert texts[r.doc_id][r.start : r.start + len(r.candidate)] == r.candidate
    assert sorted((r.doc_id, r.candidate) for r in found.where("is_secret").collect()) == [(1, SECRET), (4, SECRET), (4, SECRET[::-1])]
    out = {r.doc_id: r for r in secrets.redacted(docs, model=model).collect()}
    assert out[1].text == texts[1].replace(SECRET, "[SECRET]") and out[1].n_chars == len(out[1].text)
    assert out[4].text == 'api_key: "[SECRET]", api_key: "[SECRET]"\nend'
    assert {k: out[k].text for k in (2, 3, 5, 6)} == {k: texts[k] for k in (2, 3, 5, 6)}


def plain_candidates(text):
    """(ordinal, start, candidate) by Python's own search."""
    return [(k + 1, m.start(2 if m[2] is not None else 3), m[2] if m[2] is not None else m[3]) for k, m in enumerate(re.finditer(secrets.CANDIDATE, text or ""))]


def test_candidates_equal_a_plain_search(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    want = sorted((r.doc_id, *c) for r in docs.collect() for c in plain_candidates(r.text))
    assert sorted((r.doc_id, r.ordinal, r.start, r.candidate) for r in secrets.candidates(docs).collect()) == want


def test_values_of_any_length_under_a_name_are_candidates(spark):
    cases = {
        'password = "hunter2x9"': "hunter2x9", "pwd: s3cr!t@1, then": "s3cr!t@1", "API_KEY=abcdefghijkl": "abcdefghijkl", '{"client_secret": "kqzv"}': "kqzv", "DB_PASSWORD=allsmallletters": "allsmallletters",
        "NAME=abcdef0123456789ABCD": "abcdef0123456789ABCD", "no names here": None, "password: ": None,
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.candidate for r in secrets.candidates(docs).collect()}
    assert [got.get(k) for k in range(len(cases))] == list(cases.values())


def test_hand_labelled_lines(spark, model):
    """Findings written by hand, apart from the generator: each is a candidate, precision and recall are as the README says."""
    lines = [line.rstrip("\n").split("\t") for line in (Path(__file__).parent / "secret_lines.tsv").open()]
    docs = spark.createDataFrame([(k, text, path) for k, (_, path, _, text) in enumerate(lines)], "doc_id long, text string, source string")
    found = {(r.doc_id, r.candidate): r.is_secret for r in secrets.scan(docs, model=model).collect()}
    hits = [(label == "1", found.get((k, value), False)) for k, (label, _, value, _) in enumerate(lines)]
    both = sum(a and b for a, b in hits)
    print([lines[k][3] for k, (a, b) in enumerate(hits) if a != b])
    assert both / sum(a for a, _ in hits) >= 0.85 and both / sum(b for _, b in hits) >= 0.85


def test_control_characters_stay(spark, model):
    text = f"a\u0001b\u0002c\u0003d\u0003\u0004e token = \"{SECRET}\" \u0001\u0002\u0003\u0005"
    docs = spark.createDataFrame([(1, text), (2, text.replace(SECRET, "x"))], "doc_id long, text string")
    found = secrets.scan(docs, model=model).where("is_secret").collect()
    assert [(r.doc_id, text[r.start : r.start + 40]) for r in found] == [(1, SECRET)]
    assert {r.doc_id: r.text for r in secrets.redacted(docs, model=model).collect()} == {1: text.replace(SECRET, "[SECRET]"), 2: text.replace(SECRET, "x")}


def test_words_of_the_corpus_are_in_the_dictionary(spark):
    docs = spark.createDataFrame([(k, f"the zarnok came {k}") for k in range(secrets.LEAST_DOCS)] + [(90, "a blimfot came"), (91, "password: zarnokBlimfot1")], "doc_id long, text string")
    assert [(r.candidate, r.in_corpus) for r in secrets.with_words(secrets.candidates(docs), docs).collect()] == [("zarnokBlimfot1", 6)]


def test_clashing_names_and_shuffled_joins(spark, odd_docs, monkeypatch, model):
    docs = odd_docs.selectExpr("*", *[f"doc_id AS {c}" for c in ("node", "hash", "text_hash", "id", "many", "at", "row", "key", "path", "word", "candidate")])
    key = lambda df: sorted(map(str, df.collect()))
    one = key(secrets.redacted(docs, model=model))
    monkeypatch.setattr(scratch, "MOST_ROWS", 0)
    assert one == key(secrets.redacted(docs, model=model))


def test_secrets_of_the_documents(spark, sf01, model):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    want = sorted(r.x for r in docs.select(F.explode(F.expr("regexp_extract_all(text, '(?i)token = \"([0-9a-f]{40})\"', 1)")).alias("x")).collect())
    assert sorted(r.candidate for r in secrets.scan(docs, model=model).where("is_secret").collect()) == want


def test_odd_rows(odd_docs, no_docs, model):
    out = secrets.redacted(odd_docs, model=model)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert [r.text for r in out.where("doc_id = 8").collect()] == ['key = "token = "[SECRET]" and more']
    assert secrets.scan(no_docs, model=model).count() == 0 and secrets.redacted(no_docs, model=model).count() == 0
