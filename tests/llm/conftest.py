import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs; further columns carry names that operators use inside."""
    def make(rows):
        full = [(i, t, "en", "src0", len(t or ""), "x", 7, "y", 1.5) for i, t in rows]
        return spark.createDataFrame(full, TEXT + ", digest string, batch int, vertex string, score double").repartition(3)

    return make


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path / "scratch")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    return [(1, "one two three four five six seven"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long), (7, "one two three four five six seven"), (7, "one two three four five six seven"),
            (8, "É ﬁ 漢字 \x1c x"), (None, "one two three four five six seven"), (None, None), (9, "x")]
