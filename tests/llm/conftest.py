import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, v string, row int"


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, very long, tied and repeated rows with extra columns whose names clash with inner ones."""
    rng = random.Random(7)
    words = [f"w{i}é" for i in range(40)]
    prose = [" ".join(rng.choices(words, k=rng.randrange(60, 400))) for _ in range(24)]
    page = "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(20))
    texts = [None, "", " \n\t ", "one", "one", "two words", page, page + " more", page, "menu line\n" + prose[0], "menu line\n" + prose[1], "menu line\n" + prose[2], "menu line\n" + prose[3], "menu line\n" + prose[4], "x" * 30_000, " ".join(prose) * 3, *prose]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), "v", i) for i, t in enumerate(texts)]
    rows += [(None, "a null id", "en", "s1", 9, None, None), (None, None, None, None, None, None, None), rows[6], rows[6], (3, "a repeated id", "en", "s0", 13, "", 1)]
    rows += [(2**60 + i, t, "en", "s2", len(t), "v", i) for i, t in ((1, "an id that no float holds"), (2, page), (3, "an id that no float holds"))]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
