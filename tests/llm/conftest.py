import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, p long, n int, base string, extra string, _place long"


def words(r, n, vocabulary=300):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward_texts():
    """Null, empty, blank, very long, repeated, near and exact copies, odd characters."""
    r = random.Random(3)
    long = words(r, 30_000, 5000)
    base = words(r, 120)
    near = base.split()
    near[60] = "CHANGED"
    shared = words(r, 40)
    return [
        None,
        "",
        "   \n\t ",
        "one",
        "one two",
        "One TWO",
        long,
        long + " tail",
        base,
        base,
        " ".join(near),
        base.upper(),
        shared + " " + words(r, 50),
        words(r, 30) + " " + shared,
        "a " * 200,
        " x y K İ \x1c z",
        words(r, 60) + " " + shared + " " + shared,
        "éàü ñ 漢字 🙂 " * 30,
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with every trouble: null ids, one row twice, columns with clashing names."""
    rows = [(i * 3 + 1, t) for i, t in enumerate(awkward_texts())]
    rows += [rows[8], rows[0], (None, "null id text " * 9), (None, None)]
    return spark.createDataFrame([(i, t, None, "s", None, 0.5, 1, 2, 3, "b", "e", 9) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
