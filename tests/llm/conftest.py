import pytest


@pytest.fixture
def docs(spark):
    """Documents from texts; ids count from 0. Extra columns have names the operators use inside."""
    def build(texts, source="a", extra=True):
        rows = [(i, t, "en", source if isinstance(source, str) else source[i], len(t or ""), 1, "x") for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, size int, h string")
        return df if extra else df.drop("size", "h")
    return build


AWKWARD = [None, "", " \n\t", "a", "word " * 30000, "x" * 200000, "same text here", "same text here", "é ñ 漢 🙂 <|endoftext|> \x1c ok",
           "1 2 3 " * 2000, "a@b.co +1 (132) 555-0271 10.0.0.1 4111111111111111"]


@pytest.fixture
def awkward():
    return list(AWKWARD)
