"""Document fixtures with the odd cases that every operator must take."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Null columns, empty and blank texts, a very long text, ties and repeated rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 120))), "en", f"s{i % 4}", 1) for i in range(60)]
    rows += [(100, None, "en", "s1", 0), (101, "", None, None, None), (102, " \n\t ", "en", "s1", 3), (None, "no id here", "en", "s2", 10), (None, None, None, None, None)]
    rows += [(103, " ".join(rng.choices(words, k=60_000)), "en", "s0", 1), (104, "Ünïcode ß 漢字 \U0001f600 text", "de", "ß", 1), (105, "x", "en", None, 1)]
    rows += [rows[3], rows[3], (106, rows[3][1], "en", "s9", 1), (107, rows[4][1] + " tail", "en", "s9", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names clash with those of results."""
    extra = "fp long, score double, shard int, component_id long, size long, node long, label int, contaminated boolean, copies long, _doc long, _text long, key long, row_key long, virtual_slot int"
    names = [x.split()[0] for x in extra.split(", ")]
    rows = [(*r, *[None] * len(names)) for r in odd_rows()]
    return spark.createDataFrame(rows, f"{SCHEMA}, {extra}").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    """A document table without rows."""
    return spark.createDataFrame([], SCHEMA)
