import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, `_key` int, found int"


def row(doc_id, text, lang="en", source="a"):
    """A document with extra columns named like results."""
    return (doc_id, text, lang, source, None if text is None else len(text), 0.5, "x", 1, 2)


@pytest.fixture(scope="session")
def hard_rows():
    """Missing values everywhere, empty and long texts, ties, repeated rows, characters beyond ASCII."""
    rng = random.Random(4)
    words = ["the", "of", "ñandú", "ÉTÉ", "b1", "x", "übér", "42", "don't", "e-mail", "İs"]
    line = " ".join(words)
    passage = " ".join(f"p{i}" for i in range(60))
    runs = "first line here\n\n second line \nthird one\tends\n"
    long_text = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(30000))
    texts = ["", " \n\t ", "!!! ---", line, line.upper(), passage, f"{line} {passage} tail", f"start\n{passage}\nend " * 2,
             runs + "own words", "other head\n" + runs, runs, "a a a a\n" * 6, long_text, long_text + " end", "x" * 5000]
    rows = [row(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "ß", None])) for i, t in enumerate(texts)]
    rows += [row(None, passage), row(None, None, None, None), row(90, None), row(91, passage, None), row(5, "same id, other text")]
    rows += [rows[3], rows[5], rows[5], rows[8]]
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
