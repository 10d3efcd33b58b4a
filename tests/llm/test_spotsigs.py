import hashlib

from pyspark.sql import functions as F

from strandlake.llm import queries, spotsigs


def expected(rows):
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        yield str((i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))


def test_edited_texts_equal_brute_force(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    made = queries.op9_spotsigs(spark, "").collect()
    assert sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in made) == sorted(expected(rows))
    texts = {}
    for r in made:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        texts.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert texts[5007] == texts[5008]
    long = [r["near_edited"] for r in made if r["n_chars"] > 500]
    other = [r["near_next"] for r in made if r["n_chars"] > 500]
    assert sum(long) / len(long) > 0.2 > sum(other) / len(other)


def test_likeness_equals_jaccard(spark):
    sets = [([1, 2, 3], [2, 3, 4]), ([1], [1]), ([1], [2]), (list(range(300)), [1]), (list(range(20)), list(range(10)))]
    frame = spark.createDataFrame(sets, "a array<long>, b array<long>").select("a", "b", spotsigs.likeness(F.col("a"), F.col("b")).alias("n"))
    for r in frame.collect():
        a, b = set(r["a"]), set(r["b"])
        exact = len(a & b) / len(a | b)
        assert r["n"] == (exact if min(len(a), len(b)) >= spotsigs.FLOOR * max(len(a), len(b)) else 0.0)


def test_signatures(spark):
    rows = spark.createDataFrame([("The cat of the big house ran",), ("cat house",), ("",)], "t string").select("t", F.size(spotsigs.signatures(F.col("t"))).alias("n")).collect()
    assert [r["n"] for r in rows] == [2, 1, 1]


def test_one_row_and_none(spark, empty):
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    [row] = spotsigs.edited_and_next(one).collect()
    assert row["edited"] == "abab" and row["near_next"] == 1.0
    assert spotsigs.edited_and_next(empty).count() == 0


def test_likeness_of_a_short_text_to_a_long_one_is_exact(spark):
    long = " ".join(f"the cat{k} ran" for k in range(40))
    rows = spotsigs.edited_and_next(spark.createDataFrame([(2, long), (1, "the cat7 ran")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["near_next"] for r in rows} == {1: 1 / 40, 2: 1 / 40}


def test_texts_in_other_scripts_are_alike(spark):
    words = [f"слово{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words[:30], "другое", *words[31:]]), " ".join(reversed(words))]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", spotsigs.signatures(F.col("t")).alias("s"))
    signs = {r["k"]: set(r["s"]) for r in frame.collect()}
    assert len(signs[0] & signs[1]) / len(signs[0] | signs[1]) > 0.7 > 0.2 > len(signs[0] & signs[2]) / len(signs[0] | signs[2])
