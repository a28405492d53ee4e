import string

import pytest

LONG = ("lorem ipsum dolor sit amet " * 4000).strip()
TEXTS = {
    1: "The quick brown fox jumps over the lazy dog near the river bank today",
    2: "The quick brown fox jumps over the lazy dog near the river bank today",
    3: "the QUICK brown fox jumps over the lazy dog near the river bank today",
    4: "Une phrase en français avec des mots étranges et une adresse jean.dupont@mail.example.com ici",
    5: None,
    6: "",
    7: "   \n\t ",
    8: LONG,
    9: "12345 67890 !!! ??? 192.168.0.1 and 4111 1111 1111 1111 or +1 (212) 555-0199",
    10: "Released under the MIT License.",
    11: "word",
    12: "WORD",
}


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, None if i == 7 else "fr" if i == 4 else "en", None if i == 8 else f"s{i % 2}", len(t or ""), "x", i) for i, t in TEXTS.items()]
    rows.append(rows[0])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, node long")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


def lower(text):
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
