import pytest


@pytest.fixture
def docs(spark):
    """Documents with every awkward case: nulls, blanks, a long text, ties, repeats, extra columns."""
    long = " ".join(f"word{i % 700} w{i * i % 991}" for i in range(6000))
    base = " ".join(f"term{i}" for i in range(60))
    rows = [
        (1, base), (2, base), (3, base.replace("term7 ", "other ")), (4, None), (5, ""), (6, " \n\t "),
        (7, long), (8, "One two"), (9, "one TWO"), (10, "single"), (11, "Ünïcode ßtraße don't, stop. É"),
        (None, "a text without a name of its own"), (12, "same row"), (12, "same row"),
    ]
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), 0.5, 1) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, score double, n long",
    )


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture
def sample_folder():
    import os

    return os.environ.get("SAMPLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def sample(spark, sample_folder):
    return lambda name: spark.read.parquet(f"{sample_folder}/{name}.parquet")
