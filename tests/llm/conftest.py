import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, block int, fp string, features int, `row` string, site string, tokens int"


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, nulls in every column, empty and long texts, ties, repeated rows, a null id."""
    base = words(1, 160)
    near = [*base[:100], "changed", *base[101:]]
    texts = {
        1: " ".join(base),
        2: " ".join(base),
        3: " ".join(near),
        4: None,
        5: "",
        6: " \n\t ",
        7: "one two",
        8: "x " + " ".join(base[20:120]) + " y",
        9: "line one here\nshared boilerplate line\n\nlast",
        10: " ".join(words(2, 3000)),
        11: "ONE two",
        12: "é ü 漢字 <|endoftext|> \x1c tab\there  double",
        13: "shared boilerplate line\nown text",
    }
    out = [(k, t, "en", f"s{k % 3}", len(t or ""), "x", 1, "y", 2, "z", "q", 3) for k, t in texts.items()]
    out += [out[6], (None, " ".join(base), None, None, None, None, None, None, None, None, None, None)]
    out += [(20 + k, "shared boilerplate line\nbody " + str(k), "de", f"site{k}", 5, "x", 1, "y", 2, "z", "q", 3) for k in range(12)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
