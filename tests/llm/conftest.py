"""Documents with every awkward case, and small helpers."""

from __future__ import annotations

import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, secrets string, value double"


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, exact and near copies, repeated rows, ties."""
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "délta", "ñandu", "ström", "it's", "x", "##", "12"]
    prose = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    rows += [(100 + i, prose[0], "en", "hot", len(prose[0])) for i in range(40)]
    rows += [(200, prose[1] + " tail", None, "hot", None), (201, prose[1], "fr", None, 1)]
    rows += [(300, None, "en", "s1", None), (301, "", None, None, 0), (302, " \t\n ", "de", "s2", 4), (303, "one two", "en", "s0", 7)]
    rows += [(304, "<|endoftext|> <|im_end|> <|startoftext|>", "en", "s0", 30), (305, "日本語 text　wide 😀 ok", "ja", "s0", 20)]
    rows += [(400, " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(40_000)), "en", "s0", 1)]
    rows += [(None, prose[2], "en", "s1", 3), (None, None, None, None, None), (500, prose[3], "en", "s1", 3), (500, prose[3], "en", "s1", 3)]
    return [(*row, 7, "mine", 0.5) for row in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOC_SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str]]:
    return [(row[0], row[1] or "") for row in awkward_rows()]
