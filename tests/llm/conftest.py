import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int"


def edge_rows():
    """Nulls, empty and blank texts, short texts, exact copies, a repeated row, and a long text; two columns clash with results'."""
    long = " ".join(f"w{(i * 7919) % 5003}" for i in range(30000))
    para = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", " \n\t\r ", "one two", "One two", "a b c d e", "x " * 200, long, long, f"intro here\n{para}\nend of it", f"other start\n{para}\nother end", f"{para}\nx\n{para}", "déjà vu <|endoftext|> ▁ 日本 ©", "A" * 3000]
    rows = [(100 + i, t, None if i == 1 else "en", None if i == 2 else "s", 0, "k", 1) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "lone row with a null id", "en", "s", 0, "k", 1)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
