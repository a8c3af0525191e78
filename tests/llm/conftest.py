import pytest

PROSE = ("the quick brown fox jumps over the lazy dog while seven small ships sail slowly past the old stone harbour "
         "and nobody on the quiet shore counts the grey birds that follow them home before the evening rain begins "
         "to fall on every roof and every narrow street of the sleeping town below the hill where wind turns mills")
CLASHES = ("id string, words string, n int, pos int, key string, print string, row string, ledger string, node string, "
           "score string, label string, window int, piece int, batch int, row_number int")


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls in any column, empty, blank, wordless and very long texts, ties and repeated rows."""
    long_text = "\n".join(f"{PROSE} line {i}" for i in range(1500))
    texts = [(1, PROSE), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r"), (5, "!!! --- ..."), (6, long_text), (7, PROSE), (7, PROSE),
             (7, "another text of the same id"), (None, PROSE + " more"), (None, None), (None, PROSE + " more"),
             (8, "Ünïcödé ÀÉÎ 日本語 \x00 nul 😀 123 abc"), (9, "one"), (10, "a b c"), (11, "x" * 50_000), (12, PROSE.upper())]
    return [(i, t, None if i in (4, 9) else "en" if (i or 0) % 2 else "xx") for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    extra = tuple([None] * 15)
    return spark.createDataFrame([r + extra for r in odd_rows], "doc_id bigint, text string, lang string, " + CLASHES).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
