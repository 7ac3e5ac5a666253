import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice(["the", "of", "and", "on", "er", "ti", "wh"]) + rng.choice(["an", "ed", "ion", "or", "is", "ly"]) * rng.randint(0, 3) for _ in range(n)]


def corpus(seed=1):
    """Texts with exact copies, near copies, shared passages, one very common line, odd white space and one long text."""
    rng, out = random.Random(seed), []
    passage = " ".join(words(rng, 60))
    line = "one very common line of words that many of the documents have"
    base = words(rng, 90)
    for i in range(60):
        kind = i % 6
        if kind == 0:
            text = " ".join(words(rng, rng.randint(1, 60)))
        elif kind == 1:
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(90)] = f"edit{rng.randrange(1000)}"
            text = " ".join(near)
        elif kind == 2:
            text = " ".join(words(rng, 10)) + "\n" + passage + "\n" + " ".join(words(rng, 12))
        elif kind == 3:
            text = line + "\n" + " ".join(words(rng, 30))
        elif kind == 4:
            text = out[rng.randrange(len(out))][1].replace(" ", "\t", 2)
        else:
            text = "ha " * rng.randint(1, 50)
        out.append((i, text))
    out += [(100, None), (101, ""), (102, " \t\n\r\x0b\x0c "), (103, " ".join(words(rng, 4000))), (104, passage), (105, "Ça été 日本語 🎉 ﬁn  ")]
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null keys, repeated rows and ties, with a column whose name operators use themselves."""
    text = "some words are here and some more words are there as well to make a text of more than twenty words in all so it counts"
    data = [(None, text), (1, text), (1, text), (2, text), (3, None), (None, None)]
    return spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, name string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
