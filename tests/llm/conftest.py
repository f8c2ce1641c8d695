"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import random

import pytest
from llm_rows import make, words

@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts, languages and sources; empty, blank, very long and repeated texts; extra columns."""
    rng = random.Random(3)
    long = words(rng, 20_000)
    same = words(rng, 80)
    rows = [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, "   \n\t ", None, None), (None, same, "en", "s"), (None, None, None, None),
        (5, same, "en", "s"), (6, same.upper(), "fr", None), (6, same.upper(), "fr", None), (7, long, "en", "s"),
        (8, long + " one more", "en", "t"), (9, "x" * 50_000, None, "t"), (10, "1234567890 " * 3000, "en", "t"),
        (11, "\x00 ﻿ é😀 ß İstanbul   end", "de", "t"),
    ]
    return make(spark, rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def pages_sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
