import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from strandlake.llm import decontaminate as dc

WORDS = [a + b for a in "ba do ki mu re sa to vi ne lo".split() for b in "lan ter mos ring pel dun sik vor".split()]


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.4 else "") for _ in range(rng.randrange(16, 60))) + ".") for k in range(12)]
    filler = lambda n: [rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.4 else "") for _ in range(n)]
    docs, planted = [], set()
    for i in range(n):
        words = filler(rng.randrange(30, 300))
        if i % 10 == 0:
            key, text = items[(i // 10) % len(items)]
            part = text.split()
            if i % 20 == 0:  # a paraphrase: every seventh word is another
                part = [rng.choice(WORDS) if k % 7 == 3 else w for k, w in enumerate(part)]
            at = rng.randrange(len(words))
            words[at:at] = part
            planted.add((i, key))
        docs.append((i, " ".join(words)))
    return docs, items, planted


def plain_words(text):
    return [dc.plain(w) for w in text.lower().split()]


def passages_of(text):
    """The passages of an item as texts."""
    words = text.split()
    starts = list(range(0, max(1, len(words) - dc.PASSAGE + 1), dc.PASSAGE // 2))
    if starts[-1] + dc.PASSAGE < len(words):
        starts.append(len(words) - dc.PASSAGE)
    return [" ".join(words[s : s + dc.PASSAGE]) for s in starts]


def brute(docs, items):
    """Items whose every passage-sized stretch is held against all windows of all documents."""
    found = set()
    for i, text in docs:
        words = plain_words(text)
        for key, item in items:
            for passage in map(plain_words, passages_of(item)):
                if any(dc.lcs_length(passage, words[s : s + len(passage) + 8]) >= dc.LCS * len(passage) for s in range(0, len(words), 4)):
                    found.add((i, key))
    return found


def test_recall_against_brute_force_and_planted_cases(spark):
    docs, items, planted = corpus()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.matches(frame, bench).collect()}
    truth = brute(docs, items)
    assert len(found & planted) >= 0.9 * len(planted)
    assert len(found & truth) >= 0.9 * len(truth)
    assert found <= truth | planted
    kept = {r["doc_id"] for r in dc.without_items(frame, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in found}


def test_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert dc.lcs_length(a, b) == t[-1][-1]


def test_items_in_blocks_and_odd_rows(spark, docs, empty, monkeypatch):
    items = spark.createDataFrame([(1, "alpha beta gamma delta " * 5), (2, None), (None, "x y"), (3, " ")], "item_id long, text string")
    monkeypatch.setattr(dc, "ITEMS", 1)
    assert dc.matches(docs, items).count() == 0
    assert dc.matches(empty, items).count() == 0
    assert dc.without_items(docs, items).columns == docs.columns


def planted(texts, items, share, seed, first):
    """Each item in a document of its own, with a share of its words replaced by words of the documents."""
    rng, out = random.Random(seed), []
    long = [t.split() for t in texts if len((t or "").split()) > 100]
    for key, text in items:
        part, body = text.split(), rng.choice(long)[:2000]
        for at in rng.sample(range(len(part)), round(share * len(part))):
            part[at] = rng.choice(rng.choice(long))
        at = rng.randrange(len(body))
        out.append((first + key, " ".join(body[:at] + part + body[at:])))
    return out


def test_no_planted_item_of_the_test_tables_is_lost(spark):
    sf = "/root/testdata/sf0.1"
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()
    verbatim = [d for k in range(5) for d in planted(texts, items, 0, k, 1_000_000 + 1000 * k)]
    changed = [d for k in range(5) for d in planted(texts, items, 0.3, k, 2_000_000 + 1000 * k)]
    parsed, want = dict(items), {(i, i % 1000) for i, _ in verbatim}
    for i, text in changed:  # brute force: the windows of a passage's length and a quarter more, and the answer in the whole text
        words, passages = plain_words(text), [plain_words(p) for p in passages_of(parsed[i % 1000])]
        answer = Counter(plain_words([s for s in re.split(r"(?<=[.?!:])\s+", parsed[i % 1000].lower().strip()) if s][-1]))
        covered = max(dc.lcs_length(p, words[s : s + len(p) * 5 // 4]) / len(p) for p in passages for s in range(len(words)) if set(p) & set(words[s : s + 8]))
        if covered >= dc.LCS and not answer - Counter(words):
            want.add((i, i % 1000))
    frame = spark.createDataFrame(verbatim + changed, "doc_id long, text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    found = {(r["doc_id"], r["item_id"]) for r in dc.matches(frame.repartition(4), spark.createDataFrame(items, "item_id long, text string")).where("doc_id >= 1000000").collect()}
    lost = want - found
    print(len(verbatim), len(want) - len(verbatim), sum(i < 2_000_000 for i, _ in lost), sum(i >= 2_000_000 for i, _ in lost))
    assert not lost


def test_directions_are_those_of_all_documents(spark):
    rng = random.Random(9)
    # More documents than any bounded sample of some thousands, most of them of one word each.
    docs = [(k, " ".join(rng.choices(WORDS, k=40)) if k % 20 == 0 else WORDS[k % len(WORDS)]) for k in range(8000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    written, counts, total = dc.counted_places(frame, "text")
    idf = np.log((1 + total) / (1 + counts))
    assert total == len(docs) and counts.max() <= total
    gram = np.zeros((dc.FEATURES, dc.FEATURES))
    for _, text in docs:
        places = np.array(dc.features(text))
        for start in range(0, len(places), dc.PASSAGE):
            part = places[start : start + dc.PASSAGE]
            weights = idf[part] / np.sqrt((idf[part] ** 2).sum())
            np.add.at(gram, (np.repeat(part, len(part)), np.tile(part, len(part))), np.outer(weights, weights).ravel())
    held = np.flatnonzero(counts)
    values, vectors = np.linalg.eigh(gram[np.ix_(held, held)])
    made, want = dc.latent_table(written, idf)[held], vectors[:, ::-1][:, : dc.RANK] / np.sqrt(values[::-1][: dc.RANK]) * idf[held, None]
    # All places of this corpus fit into the rank, so the directions are exact up to their signs.
    assert made.shape == want.shape or len(held) <= dc.RANK
    assert np.allclose(made @ made.T, want @ want.T, atol=0.02 * np.abs(want @ want.T).max())


def test_odd_ids_ties_and_a_very_long_text(spark):
    item = " ".join(WORDS[:40]) + "."
    items = spark.createDataFrame([("a", item), (None, item), ("a", item), ("b", "")], "item_id string, text string")
    long = " ".join(random.Random(1).choices([w + "x" for w in WORDS], k=400_000)) + " " + item
    docs = spark.createDataFrame([(1, long, 5), (None, item, 6), (2, item, 7), (2, item, 7), (3, "", 8), (4, None, 9)], "doc_id int, text string, cosine int")
    found = sorted((str(r["doc_id"]), str(r["item_id"]), r["lcs"]) for r in dc.matches(docs, items).collect())
    assert found == sorted((i, k, 1.0) for i in ("1", "None", "2", "2") for k in ("a", "None"))
    assert sorted(r["doc_id"] for r in dc.without_items(docs, items).collect()) == [3, 4]


def test_hashes_of_words_tell_words_apart():
    words = [a + b + str(n) for a in WORDS[:50] for b in ("", "x", "é") for n in range(50)]
    hashes, ends = dc.hashed_words(pa.array([" ".join(words), None, "  \t", " «A1» a1! ### "]))
    assert len(set(hashes[: ends[1]].tolist())) == len(words) and ends.tolist() == [0, len(words), len(words), len(words), len(words) + 3]
    assert hashes[-3] == hashes[-2] != hashes[-1]
