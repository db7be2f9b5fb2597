import pytest

ROWS = [
    (1, None), (2, ""), (3, "   "), (4, "short line"), (5, "same text of some length here"),
    (6, "same text of some length here"), (6, "same text of some length here"), (None, "a b c d e f g"),
    (7, "A shared line of twenty chars\nown line of document seven"),
    (8, "  a SHARED line of twenty chars \nother\na shared line of twenty chars"),
    (9, "a shared line of twenty chars\n"), (10, "x" * 50_000), (11, "word " * 20_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, very long and repeated texts, and columns whose names could clash."""
    rows = [(i, t, "s" if (i or 0) % 3 else None, 1.0, "d", 0) for i, t in ROWS]
    schema = "doc_id bigint, text string, source string, score double, digest string, doc_key int"
    return spark.createDataFrame(rows, schema)
