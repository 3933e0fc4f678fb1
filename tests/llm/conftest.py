import pytest

#: Texts with nothing, only spaces, odd characters, ties and repeats.
ODD = [
    (0, "The cat sat on the mat. The cat sat on the mat."),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "naïve café 日本語 🙂 x\x85y ՘ \x1c z"),
    (5, "The cat sat on the mat. The cat sat on the mat."),
    (5, "The cat sat on the mat. The cat sat on the mat."),
    (None, "token = \"abcdef123456\" and <|endoftext|> more"),
    (7, "word " * 3000),
    (8, "Released under the MIT license.\nlicensed under the APACHE License version 2.0"),
    (9, "  two   spaces ▁▁ and </s><0x41> pieces\r\n"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with extra columns named like results."""
    rows = [(i, t, "x", i, 1.5, "k") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string, component_id long, score double, kept string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_words string, score double")


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
