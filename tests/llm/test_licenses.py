import math
import random
import re

from strandlake.llm import licenses, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if c < "\x7f" else c for c in text)


def expected(text):
    words = WORD.findall(lowered(text or ""))
    found = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), sorted({label for _, label in found})


def test_base_equals_brute_force(spark, docs, rows):
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    made = sorted(map(str, ((r["doc_id"], *(r[n] for n in names)) for r in licenses.scan(docs).collect())))
    assert made == sorted(str((i, *expected(t))) for i, t, _ in rows)


def test_phrases_and_templates(spark):
    texts = [
        "The MIT License the mit license. THE-MIT  License", "é the mit licenseé cc by nc", "CC BY-NC 4.0 and Apache License, Version 2.0",
        "x y " + licenses.TEMPLATES[0][1].title() + " more", "gnu general public license", "permission is hereby granted free of charge, without restriction",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan(frame).collect()}
    for i, text in enumerate(texts):
        assert (out[i]["n_words"], out[i]["n_base"], out[i]["first_word"], out[i]["last_word"], out[i]["base_labels"]) == expected(text)
        assert set(out[i]["base_labels"]) <= set(out[i]["labels"]) and 0 <= out[i]["score"] <= 1
    assert out[3]["labels"] == ["mit"] and out[3]["score"] > 0.9
    assert out[0]["n_base"] == 3 and out[0]["last_word"] == 6


def brute(texts):
    """Labels and scores by trying every place of every template in every text."""
    words = [WORD.findall(lowered(t or "")) for t in texts]
    idf = {w: max(1e-9, math.log((1 + len(texts)) / (1 + sum(w in set(ws) for ws in words)))) for w in licenses.vocabulary()}
    for held in words:
        labels, best = set(), 0.0
        for label, notice, keys in licenses.TEMPLATES:
            template = notice.split()
            rare = set(sorted(set(template), key=lambda w: (-idf[w], w))[: licenses.ANCHORS])
            whole = sum(idf[w] for w in template if w in rare)
            for start in range(-len(template), len(held)):
                met = [w for k, w in enumerate(template) if w in rare and 0 <= start + k < len(held) and held[start + k] == w]
                share = min(1.0, sum(idf[w] for w in met) / whole)
                stretch = " " + " ".join(held[max(0, start - licenses.SLACK) :][: len(template) + 2 * licenses.SLACK]) + " "
                if share >= licenses.LEAST_SHARE and len(set(met)) >= licenses.LEAST_WORDS and all(f" {k} " in stretch for k in keys):
                    labels.add(label)
                    best = max(best, share)
        yield labels, best


def test_labels_and_scores_equal_brute_force(spark):
    rng, texts = random.Random(5), [None, "", "the the the", "license " * 400]
    notices = [t[1].split() for t in licenses.TEMPLATES]
    for k in range(150):
        body = [rng.choice(rng.choice(notices)) if rng.random() < 0.3 else f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):  # notices, whole or with words lost or changed
            part = [w if rng.random() < (1, 0.9, 0.7)[k % 3] else f"w{rng.randrange(500)}" for w in rng.choice(notices)]
            if k % 5 == 0:
                del part[rng.randrange(len(part))]
            at = rng.randrange(len(body))
            body[at:at] = part
        texts.append(" ".join(body))
    texts += [texts[9], texts[9], " ".join(texts[4:40])]  # ties, repeated rows, a very long text
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made = {r["doc_id"]: (set(r["labels"]) - set(r["base_labels"]), r["base_labels"], r["score"]) for r in licenses.scan(frame).collect()}
    found = 0
    for k, (labels, best) in enumerate(brute(texts)):
        extra, base, score = made[k]
        assert extra == labels - set(base), k
        assert abs(score - (1.0 if base else best)) < 1e-9, k
        found += bool(labels)
    assert found > 60


def test_empty(empty):
    assert licenses.scan(empty).count() == 0


def test_query_counts_the_places_of_its_own_phrases(spark, docs, rows, tmp_path):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    texts = ["the mit license", "Released under the MIT License", "under the MIT License under the mit-license", "cc by nc, the mit license: Apache License, Version 2.0", "under the mit licenses"]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(7000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in [*((i, t) for i, t, _ in rows), *((7000 + k, t) for k, t in enumerate(texts))]:
        words = WORD.findall(lowered(text or ""))
        found = [(k, label) for phrase, label in phrases.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in found]
        want.append(str((i, len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found})))))
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    made = queries.op3_license_scan(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r[n] for n in names)) for r in made) == sorted(want)
    assert {r["doc_id"]: r["n_base"] for r in made if r["doc_id"] and r["doc_id"] >= 7000} == {7000: 0, 7001: 1, 7002: 2, 7003: 2, 7004: 0}
