import pyarrow.parquet as pq
import pytest

#: Texts that every operator must take.
EXTRA = [None, "", "   \n\t ", "x", "1234 !!", "é ü \U0001f600 ñ", "a " * 400, "word", "word"]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang): documents of the smallest tables, and odd ones; some ids are null or repeated."""
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    found = [(d["doc_id"], d["text"], d["lang"]) for d in docs]
    found += [(5000 + k, t, None) for k, t in enumerate(EXTRA)]
    found += [found[3], (None, found[7][1], "en"), (found[9][0], "another text for an id that is taken", "en")]
    return found


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as a frame, with columns whose names clash with what operators make."""
    frame = spark.createDataFrame([(*r, "s", 1, 2, "x") for r in rows], "doc_id long, text string, lang string, fp string, hash int, words int, spans string")
    return frame.repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
