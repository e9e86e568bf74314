import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rest int, kid int, block int"


def word(rnd):
    return "".join(rnd.choice(("th", "an", "re", "ion", "ed", "ß", "lo", "wei")) for _ in range(rnd.randint(1, 4)))


def make_rows(seed=3):
    """Texts with copies, near copies, shared passages and lines, empty, null and long texts, repeated rows and null ids."""
    rnd = random.Random(seed)
    words = [word(rnd) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = []
    base, passage, line = text(120), text(60), "A line that many documents share, and more."
    for i in range(60):
        t = text(rnd.randint(1, 150))
        if i % 4 == 0:
            t = f"{t} {passage} {text(20)}"
        if i % 3 == 0:
            t = f"{t}\n{line if i % 2 else '  ' + line.upper()}\n{text(4)}"
        rows.append((i, t))
    for i in range(60, 90):
        near = base.split()
        for _ in range(rnd.randint(0, 4)):
            near[rnd.randrange(len(near))] = word(rnd) + "x"
        rows.append((i, " ".join(near)))
    rows += [(90, ""), (91, None), (92, "one two"), (93, "one two"), (94, "a " * 3000), (95, "x" * 5000), (96, "\n\n"), (97, "é" * 300), (None, "one two three four five six"), (98, rows[5][1]), (98, rows[5][1]), (99, rows[7][1]), (99, rows[8][1])]
    for i in range(100, 130):
        few = [f"w{j}" for j in range(rnd.choice((6, 7, 8, 9, 10)))]
        few[rnd.randrange(len(few))] = rnd.choice(("w0", "v", "u"))
        rows.append((i, " ".join(few)))
    return [(i, t, rnd.choice(("en", "de", None)), f"src{rnd.randrange(3)}", None if t is None else len(t), 7, 8, 9) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
