import random

import pytest

SCHEMA = "doc_id long, text string, source string, th string, row int, key int, start int, n_bytes string"
EXTRA = ("x", 1, 2, 3, "y")


def passage(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgiéñ") for _ in range(r.randint(2, 8))) for _ in range(n))


def edge_rows():
    """Nulls, empty, wordless, short, long, periodic, copies, shared passages, equal rows, extra columns."""
    p, q = passage(1), passage(2)
    texts = [
        (1, p), (2, p), (3, f"{passage(3, 10)} {p} {passage(4, 10)}"), (4, f"{p[:250]} {q}"), (5, q.upper()), (6, None), (7, ""), (8, " \n\t "), (9, "one"),
        (10, "Und " * 300), (11, "und " * 250), (12, "a" * 700), (13, passage(5, 4000)), (14, f"{q} {q}"), (15, p + "."), (None, q), (None, passage(6)), (16, passage(7)), (16, passage(7)), (17, passage(8) + "\x0b\x1c " + p),
    ]
    return [(i, t, ("s1", "s2", None)[k % 3], *EXTRA) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(i, t or "") for i, t, *_ in edge_rows()]
