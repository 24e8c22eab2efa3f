import random

import pytest

WORDS = "the of and to in red blue stone river cloud wind lamp tree door wall song bird path rain leaf".split()


def prose(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "s", "ed", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): copies, near copies, shared passages, nulls, empty and long texts."""
    draw = random.Random(3)
    passage = prose(draw, 30)
    made = [(i, prose(draw, draw.randrange(1, 120))) for i in range(60)]
    made += [(100 + i, made[i][1].upper()) for i in range(0, 20, 2)]
    made += [(200 + i, made[i][1] + " " + passage + "\t\n" + prose(draw, 5)) for i in range(12)]
    made += [(300, None), (301, ""), (302, "  \n"), (303, passage), (304, prose(draw, 30_000)), (305, "é ê 漢字 " * 40)]
    made += [(306, passage + " " + passage), (307, "a a a a a a a a a a a a a a a a a a a a"), (308, "x")]
    draw.shuffle(made)
    return made


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows over several partitions, with columns named like those operators make."""
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return table.selectExpr("*", "'other' as part", "1 as fp", "2 as key", "'s' as spans", "null as __n")


@pytest.fixture(scope="session")
def odd(spark):
    """Rows without an id, rows that repeat an id, and rows that repeat all."""
    texts = [(None, "one two three four"), (None, "one two three four"), (None, "five"), (None, None)]
    texts += [(7, "one two three four"), (7, "One Two three four"), (7, "six"), (7, "six"), (3, "six"), (9, None), (9, "")]
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
