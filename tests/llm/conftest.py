import random

import pytest
from pyspark.sql import functions as F


def prose(rnd: random.Random, n: int, words: int = 300) -> str:
    return " ".join(f"w{rnd.randint(0, words)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared passages, odd texts, and columns whose names operators use inside."""
    rnd = random.Random(11)
    rows: list[tuple] = []
    for i in range(60):
        rows.append((i, prose(rnd, rnd.randint(5, 120)), rnd.choice(["en", "de", None])))
    for i in range(60, 75):  # exact and near copies of document 3 and of each other
        base = rows[3 + (i % 2)][1].split()
        for _ in range(rnd.randint(0, 2)):
            base[rnd.randrange(len(base))] = f"new{rnd.randint(0, 9)}"
        rows.append((i, " ".join(base), "en"))
    passage = prose(rnd, 30)
    for i in range(75, 85):
        rows.append((i, f"{prose(rnd, 12)} {passage}\n{prose(rnd, 9)}", "de"))
    odd = [None, "", " \t\n", "one", "two words", "Two Words", "a b c d", "a  b\u00a0c\x0bd", "x " * 200, "stupid " * 30, "é" * 700, "1 2 3\n1 2 3\n1 2 3\n", "don't can't\u3000全角 文字"]
    rows += [(100 + i, t, None if i % 3 else "en") for i, t in enumerate(odd)]
    rows += [(None, "null id", "en"), (None, passage, "en"), (5, rows[5][1], "en"), (101, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # names that the operators use on the way
    return df.withColumns({n: F.lit("x") for n in ("id", "key", "_key", "_bucket", "n", "score", "component", "shard", "y", "word")}).repartition(3)


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.where("false")
