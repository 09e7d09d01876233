import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents frame from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def mixed_rows():
    """Prose with repeated passages, runs of one word, exact and near copies, repeated rows, nulls and empties."""
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(40)] + ["Der", "der", "ñandú", "x,", "…"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long_one = say(60), say(400)
    rows = [(k, say(rng.randint(0, 120))) for k in range(40)]
    rows += [(100 + k, say(20) + "\n" + passage + "\t" + say(20)) for k in range(6)]
    rows += [(200, "der " * 90), (201, "der " * 34), (202, "der " * 35), (203, None), (204, ""), (205, " \t\n"), (None, say(50))]
    rows += [(300, long_one), (301, long_one), (302, long_one.replace("w3 ", "W3 ", 1)), (303, long_one + " tail"), (304, "a " + long_one)]
    rows += [(400, say(50))] * 2 + [(401, "one"), (402, "ONE"), (403, "one two three"), (None, say(50))]
    return rows
