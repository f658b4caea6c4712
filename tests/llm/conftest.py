from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with every odd case: null columns, empty and long texts, repeated rows, a clashing extra column."""
    random.seed(11)
    words = ["the", "Sun", "rises,", "over", "a", "quiet", "Harbour.", "boats", "wait", "éclair", "and", "gulls", "cry", "|", "42"]
    base = [" ".join(random.choice(words) for _ in range(n)) for n in (120, 90, 60, 45, 30)]
    rows = []
    for i, text in enumerate(base):
        rows += [(10 * i, text), (10 * i + 1, text.replace("over", "under", 1)), (10 * i + 2, text)]
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "one"), (94, "one two three"), (95, "one two three"), (96, " ".join(base) * 40)]
    rows += [(97, base[0] + " " + base[1]), (97, base[0] + " " + base[1]), (97, base[2]), (None, base[0]), (None, None)]
    rows = [(i, t, ["en", "fr", None][k % 3], ["a", "b", "b", None][k % 4], len(t) if t is not None else None, f"row{k}", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, number int").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark, messy):
    return spark.createDataFrame([], messy.schema)
