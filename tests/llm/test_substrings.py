import re
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import substrings

WORD = re.compile("[^\x20\x09-\x0d]+")
BASE = " ".join(f"w{i}" for i in range(34))
MORE = [BASE, BASE + " x y", BASE + " x z", "pre " + BASE + " x q", " ".join(["a b c"] * 40), "a " * 35 + "b", "a " * 100, " ".join(f"u{i}\x85\xa0k" for i in range(50)) + "\x1c"]


def brute(rows, window=35):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    for i, words in split:
        gone = {p for k in range(len(words) - window + 1) if seen[tuple(words[k : k + window])] > 1 for p in range(k, k + window)}
        yield i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize(("group", "common"), [(50_000, 16), (2, 1), (20, 1)])
def test_equals_brute_force(spark, rows, group, common):
    given = [(i, t) for i, t, _ in rows] + [(9000 + k, t) for k, t in enumerate(MORE)]
    frame = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    made = [tuple(r) for r in substrings.remove_repeats(frame, group=group, common=common).collect()]
    assert sorted(made, key=str) == sorted(brute(given), key=str)


def test_heavy_prefixes_are_lengthened(spark, rows):
    # One opening with many continuations, each of which comes twice: no group of the opening's eight words.
    opening = " ".join(f"o{k}" for k in range(20))
    given = [(k, f"{opening} {' '.join(f'c{k // 2}_{j}' for j in range(30))}") for k in range(60)]
    frame = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    _, heavy = substrings.shared_anchors(frame.selectExpr("doc_id AS id", "xxhash64(text) AS doc", "text AS body"), 35, 10, 1)
    assert {p: len(h) for p, h in heavy.items()} == {8: 13, 16: 5}
    assert sorted(map(tuple, substrings.remove_repeats(frame, group=10, common=1).collect())) == sorted(brute(given))


def test_a_very_long_text(spark):
    words = [f"w{k % 5000}_{k % 7}" for k in range(60_000)]
    given = [(1, " ".join(words)), (2, None), (3, " ".join(words[100:180]))]
    made = [tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(given, "doc_id long, text string")).collect()]
    assert sorted(made) == sorted(brute(given))


def test_clashing_columns_and_empty(docs, empty):
    assert substrings.remove_repeats(docs).count() == docs.count()
    assert substrings.remove_repeats(empty).count() == 0


def test_anchor_windows():
    values = np.random.default_rng(1).integers(0, 99, 200).astype(np.uint64)
    for span in (1, 2, 5, 28):
        assert substrings.window_anchors(values, span).tolist() == [min(values[k : k + span].tolist()) for k in range(200 - span + 1)]
    words = np.array([3, 4, 5, 3, 4, 5, 3], np.uint64)
    for length in (1, 2, 3):
        hashes = substrings.prefix_hashes(words, length)
        assert len(hashes) == 8 - length and hashes[0] == hashes[3] and len(set(hashes.tolist())) == 3
