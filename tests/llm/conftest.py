import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows, other columns."""
    long = " ".join(f"word{i % 977} and then more." for i in range(6000))
    rows = [
        (1, "The cat sat on the mat and looked at the moon for a while.", "en", "a", 1.0),
        (1, "The cat sat on the mat and looked at the moon for a while.", "en", "a", 1.0),
        (2, "", "en", None, None), (3, None, None, "a", 2.0), (None, "Le chat est sur le tapis et regarde la lune.", "fr", "b", None),
        (4, long, "en", "b", 0.0), (5, "   \n\t ", "de", "b", 0.0), (6, "123 456 !!", "en", None, 0.0), (7, "Le chat est sur le tapis et regarde la lune.", "fr", "b", 0.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
