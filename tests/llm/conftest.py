import pytest

#: What stages and operators must bear: nulls, empty and very long texts, ties, repeated rows, clashing names.
LONG = " ".join(f"word{k % 977} of{k % 31}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        (1, "A short text of nine plain words for everyone here", "en", "s", 50, 7), (1, "A short text of nine plain words for everyone here", "en", "s", 50, 7),
        (2, None, None, None, None, None), (3, "", "en", "s", 0, 1), (None, "a text without an id, of eleven plain words or so", "en", "s", 1, 1), (None, None, None, None, None, None),
        (4, LONG, "en", "s", len(LONG), 1), (5, "1234 5678 !!", None, "s", 12, 1), (6, " \n\t \x0b ", "en", "s", 6, 1), (7, "dés été naïve 😀 ▁ <|endoftext|> \u0001\u0002 end", "fr", "s", 9, 1),
        (8, 'key = "token = "0123456789abcdef0123456789abcdef01234567" and more', "en", "s", 3, 1), (9, "x" * 5000, "de", "s", 5000, 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf01():
    return "/root/testdata/sf0.01"
