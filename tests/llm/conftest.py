import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "doc long, id string, kept boolean, fp long, count long, label int"
)
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def messy_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""
    texts = [
        (1, "a b c d"), (2, "a  b\tc d"), (3, None), (4, ""), (5, " \n\t "), (6, "ab c\nd"),
        (7, LONG), (8, LONG + " end"), (9, "Ünï cödé 中文 😀 é"), (9, "Ünï cödé 中文 😀 é"),
        (10, "same id, one text"), (10, "same id, another text"), (None, "no id"), (None, None),
        (11, "x"), (12, "line\nline\nline\nother # $ %"), (-5, "a b c d"), (13, "▁ mark \x00 zero"),
    ]
    rows = []
    for i, (doc, text) in enumerate(texts):
        lang = (None, "en", "de")[i % 3]
        source = (None, "src1", "src2", "", "odd")[i % 5]
        rows.append((doc, text, lang, source, None, i, "z", i % 2 == 0, i, i, None))
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
