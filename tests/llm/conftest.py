import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must come through untouched.
CLASHING = ["_key", "_tag", "_maybe", "_lines", "_d", "_t", "_gone", "_keep", "_text_key", "n_lines", "n_removed",
            "node", "h", "size", "shard", "slot", "key", "pos", "score", "keep", "root", "_w", "_m", "_at", "copies"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def messy_rows():
    """NULLs in every column, empty and very long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(7)
    base = words(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    passage = words(rng, 40)
    lines = [words(rng, 14) for _ in range(8)]
    edited = lines[2].split(" ")
    edited[3] = edited[3] + "q"
    rows = [
        (1, base, "en", "a", len(base)), (2, base, "en", "b", None), (3, " ".join(near), "fr", "a", 5),
        (4, None, None, None, None), (5, "", "en", "a", 0), (6, "   \n\t ", None, "a", 6),
        (7, words(rng, 60) + " " + passage + " " + words(rng, 30), "en", "a", 1),
        (8, passage + "\n" + words(rng, 50), "en", None, 1),
        (9, "one two three", "en", "a", 13), (10, "one two three", "en", "a", 13),
        (11, words(rng, 20000), "en", "a", 1),                        # very long
        (11, words(rng, 30), "en", "a", 1),                           # one id, two texts
        (12, "\n".join(lines), "de", "a", 1), (12, "\n".join(lines), "de", "a", 1),  # a repeated row
        (13, "\n".join([lines[0], " ".join(edited), words(rng, 12)]), "de", "a", 1),
        (None, words(rng, 25), "en", "a", 1), (None, None, None, None, None), (None, base, "en", "a", 1),
        (15, "x " * 300, "en", "a", 600), (16, "été ñandú 漢字 " * 30, "es", "a", 1),
        (17, "12 34 ... !!", "en", "a", 12), (18, lines[5] + " \n" + lines[5].upper(), "de", "a", 1)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(messy):
    return messy.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def same_columns(out, docs):
    return [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
