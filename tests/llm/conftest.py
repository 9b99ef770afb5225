import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A small corpus with nulls, empties, ties, repeated rows and a clashing extra column."""
    base = " ".join(f"word{i}" for i in range(120))
    other = " ".join(f"term{i}" for i in range(90))
    rows = [(1, base, "a", 9), (2, base + " more", "a", 9), (3, other, "b", 9), (4, None, None, 9), (5, "", "b", 9), (6, "one two", "a", 9),
            (7, "ONE two", "c", 9), (8, "x " + other, "b", 9), (9, base, "a", 9), (9, base, "a", 9), (None, other, None, 9),
            (10, "ünïcödé " * 40, "c", 9), (11, " \n\t ", "c", 9), (12, "y" * 300, "c", 9), (13, other[:200] + " tail", "a", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_shingles int")
