import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = ("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor " * 2500).strip()
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 66),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 66),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 66),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t\n ", "en", "b", 5),
    (6, LONG, "la", "a", len(LONG)),
    (7, "x" * 120_000, "en", "a", 120_000),
    (8, "é日本🙂\x00 ﻿ ﬁ ß İ   end", "xx", "c", 20),
    (None, "a row without an id, with more than thirty characters in it", "en", "a", 60),
    (None, "a row without an id, with more than thirty characters in it", "en", "a", 60),
    (9, "one line of a text that is long enough\n\n- item\n- item\none line of a text that is long enouhg", None, None, 1),
]
#: Names that operators use inside.
CLASH = (
    "row _row id tag at line h1 h2 key own place class text_ fp group component_id dropped x y h share k slot "
    "block digest range number kept stratum _text _words score predicted held_out spans ids n part_i part_j _n"
).split()


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clash(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(12)] + [(1, None, None), (None, 1, 0), (2, 7, 0), (4, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def same_rows(a, b):
    order = lambda rows: sorted(map(str, rows))
    assert order(a.collect()) == order(b.collect())
