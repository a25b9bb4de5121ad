import pytest

EDGE = [
    (0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "one two three four five six"), (5, "ONE two three\tfour five six"), (6, "été Ünïcode 日本語 \U0001f600 don't <|endoftext|> x"),
    (7, "a" * 30_000), (8, "7" * 20_000), (9, "word " * 20_000), (10, "mail a.b@c.example.org or 10.0.0.1 or +1 (555) 123-4567 or 4111 1111 1111 1111."), (10, "mail a.b@c.example.org or 10.0.0.1 or +1 (555) 123-4567 or 4111 1111 1111 1111."),
    (None, "no id at all"), (12, "This work is licensed under the GNU General Public License, version 3."),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, blanks, long runs, ties, repeated rows and columns whose names clash with results."""
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None, "x", 1, 2.0) for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string, n_tokens int, score double").repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")
