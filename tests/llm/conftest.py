import random

import pytest

import __spark_entry__ as entry

#: Columns whose names the operators also use.
CLASH = ("tokens", "digest", "component_id", "length", "row", "slice", "range", "score", "key", "text_a", "pii_base")


@pytest.fixture(scope="session", autouse=True)
def package_on_workers(spark):
    entry._with_package(lambda session, sf_dir: None)(spark, "")


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def messy_rows(words):
    """(doc_id, text): nulls, empties, blanks, long texts, ties and repeated rows."""
    rng = random.Random(9)
    def prose(n):
        return " ".join(rng.choice(words) + (". " if rng.random() < .1 else "") for _ in range(n))
    long = prose(15_000)
    near = long.replace(words[3], words[4], 3)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, prose(60)), (9, prose(300)), (7, long), (8, near),
            (12, "4111 1111 1111 1111 é😀 a@b.co ŰÑ"), (15, "x" * 30_000), (20, "line one.\nline two.\nline one.\n"),
            (21, "released under the MIT License, cc by"), (None, "no id here"), (None, None)]
    rows += [(30, prose(40))] * 3 + [(31, rows[4][1]), (32, rows[4][1].upper())]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """A documents table of them, with other columns null or named like the operators' own."""
    data = [(d, t, None, None, None if t is None else len(t), *["x"] * len(CLASH)) for d, t in messy_rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame(data, schema).repartition(5)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
