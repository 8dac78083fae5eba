import pytest

#: Rows with what every operator must bear: nulls, an empty and a long text, ties, repeated rows, and columns with clashing names.
ODD = [(1, "same words here", "x"), (2, "same words here", None), (2, "same words here", None), (None, "lone text", "y"), (3, None, "z"), (4, "", "z"),
       (5, "long " * 20_000, "w"), (6, "Ünïcode ſ 日本 \x1c\x85 end", "v"), (7, " \n\t ", None)]
SCHEMA = ("doc_id long, text string, source string, rest string, row long, word string, fp long, n long, group long, digit string, part int, "
          "_id long, _toxic int, _keep_id long, id long, labelled long, toxic int, hash long, component long, component_id long, doc long, _row long")


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, s, "r", 1, "w", 2, 3, 4, "d", 5, *[6] * 11) for i, t, s in ODD], SCHEMA)


@pytest.fixture
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    """A small table of documents, as it is supplied."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
