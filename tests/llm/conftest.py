import pytest


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns that bear names of results."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
    part = " ".join(f"p{i}" for i in range(80))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. " * 20, "en", "a"), (2, None, None, None), (3, "", "en", None), (4, " \n\t ", None, "a"), (5, long, "en", "a"),
        (6, part, "de", "b"), (7, "start here " + part + " and an end", "de", "b"), (7, "start here " + part + " and an end", "de", "b"), (None, part, "en", "a"), (None, None, "en", "a"),
        (8, "one", "fr", "b"), (9, "ONE", "fr", "b"), (10, "é" * 300 + " 日本語 🙂 <|endoftext|> x", "fr", "b"), (11, "a b", "fr", "c"), (12, "a b", "fr", "c"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or ""), "clash", 7, True, 0.5, "t", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept_text string, n_words long, kept boolean, score double, topic string, component_id int")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
