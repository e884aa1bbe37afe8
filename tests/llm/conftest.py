import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    """All documents of a small folder, with rows that hurt."""
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()]
    long = " ".join(f"wort{i % 977}" for i in range(40_000))
    odd = [None, "", " \n\t ", "ein wort", "a\n b  c d\x1fe  f<|endoftext|> g <|startoftext|>h", long, "9" * 50_000,
           "x" * 50_000 + "@y.de", "naïve Ça va? ①②³ \U0001f600\U0001f600 é İstanbul", rows[3][1], rows[3][1], "a.b " * 30]
    return rows + [(10_000 + i, t, None if i % 2 else "en") for i, t in enumerate(odd)] + [rows[5]]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
