import pytest

from jobcast.llm.common import ship


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang) rows, with further columns that operators must carry or ignore."""
    ship(spark)

    def make(rows):
        full = [(i, t, lang, "src", len(t) if t is not None else None) for i, t, lang in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make


#: Nulls in every column, empty texts, repeated rows and a text far longer than the others.
@pytest.fixture(scope="session")
def odd_rows():
    words = "the cat and the dog went over hills of green and blue to see what the river brings today".split()
    long = " ".join(words[(i * i + i // 7) % len(words)] + str(i % 97) for i in range(20_000))
    return [(1, "Hello big wide world, how are you today? " * 4, "en"), (2, "Hello big wide world, how are you today? " * 4, "en"),
            (3, None, "en"), (4, "", None), (None, "une phrase sans numéro", "fr"), (5, long, "en"), (6, long + " end", "en"),
            (6, long + " end", "en"), (7, " \t\n", "de"), (8, "Ünïcödé ß 日本語 текст", "de")]
