import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import language_id, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    made = queries.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in made)
    held = [r for r in made if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in made)


def test_odd_texts_and_no_labels(docs, rows, empty):
    model = language_id.learn(docs)
    out = sorted(str((r["doc_id"], r["lang_pred"] == "und")) for r in language_id.identify(docs, model).collect())
    assert out == sorted(str((i, not any(c.isalpha() for c in t or ""))) for i, t, _ in rows)
    none = language_id.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0
    with pytest.raises(ValueError):
        language_id.identify(docs.withColumn("score", F.lit(1)), model)


def test_scores_equal_the_kernel_expansion():
    """Scoring by one product is the expansion of kernel ridge regression over landmarks, by kernels of sets."""
    texts = ["the cat sat on the mat", "der hund und die katze", "the dog and the fox", "das ist nicht gut", "a fox is not a dog", "die maus frisst"] * 3
    labels, asked = ["en", "de", "en", "de", "en", "de"] * 3, ["the fox and the cat", "die katze ist gut", None, "123", "xyz"]

    def places(text):
        row = np.zeros(language_id.FEATURES, np.uint8)
        language_id.mark(text, row)
        return row

    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    held, wanted = ([set(np.flatnonzero(places(t or "")).tolist()) for t in ts] for ts in (texts, asked))
    marks = np.sort(np.random.default_rng(7).permutation(len(texts))[: language_id.LANDMARKS])
    inner = np.array([[kernel(held[i], held[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = np.array([[kernel(s, held[j]) for j in marks] for s in held]) @ root
    target = np.array([[label == name for name in ("de", "en")] for label in labels], float)
    solved = np.linalg.solve(mapped.T @ mapped + language_id.RIDGE * len(texts) / 100 * np.eye(mapped.shape[1]), mapped.T @ target)
    want = np.array([[kernel(s, held[j]) for j in marks] for s in wanted]) @ root @ solved
    model = language_id.fit([np.packbits(places(t)).tobytes() for t in texts], labels)
    langs, scores = model.predict(asked)
    assert langs[2:4] == ["und", "und"] and scores[2:4] == [0.0, 0.0]
    for k in (0, 1, 4):
        assert langs[k] == ("de", "en")[int(want[k].argmax())] and abs(scores[k] - min(1, max(0, want[k].max()))) < 1e-3


def test_ties_many_languages_and_very_long_texts(spark):
    rows = [(k, f"same words for all of them {k % 3}", f"l{k % 400:03d}") for k in range(1200)] + [(5000, "die katze " * 100_000, "l000"), (5001, None, "l001")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.learn(frame)
    assert 0 < len(model.languages) <= language_id.SAMPLE // language_id.LEAST
    assert language_id.identify(frame, model).where("lang_pred is not null").count() == len(rows)
    assert language_id.KernelModel(("a", "b"), np.ones((language_id.FEATURES, 2), np.float32)).predict(["tie"])[0] == ["a"]
