import pytest
from llm_helpers import frame, prose


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and blank texts, a very long one, repeated rows and ids, clashing names."""
    long_text = prose(99, 30_000)
    rows = [(1, prose(1)), (2, prose(2)), (2, prose(2)), (2, prose(3)), (3, None), (4, ""), (5, " \n\t "), (None, prose(1)),
            (None, None), (6, long_text), (7, long_text), (8, "Ünï çødé. Ελληνικά кириллица 中文 words"), (9, "one"),
            (10, prose(1), None, None)]
    df = frame(spark, rows, clash=True)
    return df, rows


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [], clash=True)
