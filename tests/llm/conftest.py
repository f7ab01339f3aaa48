import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, row long, id string, size int, __mark string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ko", "ti", "re", "su", "ma", "ne"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, near copies, and clashing extra columns."""
    rows = [(i, prose(i, 30 + i * 3), ["en", "de", None][i % 3], ["a", "b", None, "é"][i % 4]) for i in range(40)]
    rows += [(100, "", "en", "a"), (101, None, "en", "a"), (102, None, None, None), (None, prose(5, 45), "en", "a"), (103, prose(5, 45).upper(), "en", "b")]
    rows += [(104, prose(6, 4000), "en", "a"), (105, " \n\t ", "en", "a"), (106, "one two", "en", "a"), (107, "One  two", "en", "b")]
    rows += [(7, prose(7, 51), "de", "é")] * 3  # three equal rows, and one more of that id
    base = prose(77, 200).split()
    rows += [(200 + k, " ".join(base[: 100 + k] + ["xx"] + base[101 + k :]), "en", "a") for k in range(12)]
    return spark.createDataFrame([(*r, None, 1, "x", None, "m") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
