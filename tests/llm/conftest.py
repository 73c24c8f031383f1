import random

import pytest
from llm_texts import prose


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): originals, exact and near copies, repeated passages, nulls, empties, short and long texts, and repeated rows."""
    rng = random.Random(4)
    out = [(i, prose(rng, rng.randrange(20, 120))) for i in range(40)]
    for i in range(40, 70):
        words = out[rng.randrange(40)][1].split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = "zz" + str(i)
        out.append((i, " ".join(words)))
    passage = prose(rng, 30)
    out += [(70 + i, prose(rng, 10) + "\n" + passage + "\n" + prose(rng, 10)) for i in range(6)]
    out += [(80, None), (81, ""), (82, "  \n\t "), (83, "two words"), (84, "Two  WORDS"), (85, "é́ ünïcödé 😀 " * 20), (86, "x " * 3000), (87, "a" * 5000), (88, prose(rng, 4000))]
    out += [(90, out[3][1]), (90, out[3][1])]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names clash with results."""
    df = spark.createDataFrame([(i, t, "x", 1.0, "y") for i, t in rows], "doc_id long, text string, kept string, score double, component_id string")
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
