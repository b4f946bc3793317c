"""Rows, a word maker and a fixture for the tests beside."""

import random

import pytest


def words(seed, n, stock=2000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (5, "one two three four"),
    (None, "one two three four"), (6, "%%% !!! 123"), (7, "ünï\u3000cödé \x1c\x85 ß 你好 \U0001f600"),
    (8, words(1, 30000)), (None, None), (9, "one two three four"),
]

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from ``(doc_id, text)`` or longer tuples, with columns whose names clash."""

    def make(rows):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, COLUMNS)
        for name in ("score", "shard", "slot", "rep", "node", "key", "ids", "terms", "component"):
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
