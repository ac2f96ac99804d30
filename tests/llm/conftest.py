"""Small tables with all that may go wrong."""

import random

import pytest

from graphloom.llm.shared import table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, grp string, body string, votes string, score double, node bigint, part int"


def rows_of(texts):
    return [(i, t, lang, source, 1, False, "x", "y", "+", 0.5, 7, 3) for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "delta", "eps", "zeta!", "eta", "theta", "iota.", "kappa"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    long, twin = "\n".join(prose(30) for _ in range(2500)), prose(60)
    texts = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t\n", None, "a"), (4, long, "en", None), (5, twin, "en", "a"), (6, twin, "en", "a"), (7, twin, "en", "a"), (7, twin, "en", "a"), (None, prose(40), "de", "b"), (None, None, None, None), (9, "one two", "de", "b"), (10, "\x00odd ßÄ İ " + prose(30), "tr", "b")]
    texts += [(20 + k, prose(50 + k), "en", "a") for k in range(20)]
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")
