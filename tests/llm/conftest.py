import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    syllables = ["the", "on", "er", "thing", "re", "ly", "ié", "ü", "st", "an"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def rows(words):
    """Plain, copied, nearly copied, repeated, empty, null and very long texts; repeated rows and a null id."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, out = text(120), text(60), []
    for i in range(60):
        out.append((i, text(rng.randint(1, 150))))
    for i in range(60, 90):  # copies that differ in blanks only
        out.append((i, base.replace(" ", "\n" if i % 2 else "  ")))
    for i in range(90, 120):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = f"new{i}"
        out.append((i, " ".join(w)))
    for i in range(120, 140):
        out.append((i, text(30) + " " + passage + " " + text(30)))
    out += [(140, ""), (141, None), (142, " \t\n"), (143, "one"), (144, "one"), (145, text(6000)), (146, "x " * 3000), (None, text(50)), (147, base), (147, base), (148, "a" * 3000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
