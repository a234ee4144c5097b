from __future__ import annotations

import pytest

SF_SMALL = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


#: (doc_id, text, lang): nulls, empty and blank texts, repeated rows, one very long text, a repeated id, near copies.
EDGE_ROWS = [
    (1, prose(1, 120), "en"), (2, prose(1, 120), "en"), (2, prose(1, 120), "en"), (3, prose(1, 119) + " changed", None),
    (4, None, "en"), (5, "", "de"), (6, "   \n\t ", "de"), (7, "1234 !!", "fr"), (None, prose(2, 60), "fr"), (None, None, None),
    (8, prose(3, 4000) + "\n\n" + "a" * 3000 + " " + prose(1, 100), "en"), (9, "ein Wort", None), (10, "é" * 150 + "\x00" * 60, "fr"),
    (10, "ab" * 400, "fr"), (11, prose(1, 60) + " middle " + prose(2, 60), "de"),
]
SCHEMA = "doc_id long, text string, lang string, component_id string, n_words int, hits string, TEXT_ long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge rows, with extra columns named like results."""
    return spark.createDataFrame([(*row, "x", 1, "y", 2) for row in EDGE_ROWS], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
