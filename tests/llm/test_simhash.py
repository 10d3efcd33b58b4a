import random
import re

import numpy as np
import pytest
import xxhash

from strandlake.llm import linking, simhash
from strandlake.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def fingerprint(text, width=3):
    words = WORD.findall("".join(c.lower() if c < "\x7f" else c for c in text or ""))
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def labels(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def brute(rows, bits=2):
    prints = [fingerprint(t) for _, t, _ in rows]
    at = labels([(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits], range(len(rows)))
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[at[k]] = min(i, least.get(at[k], i))
    return sorted(str((i, f"{prints[k]:016x}", least.get(at[k]))) for k, (i, _, _) in enumerate(rows))


def test_equals_brute_force(docs, rows):
    made = simhash.near_duplicates(docs).collect()
    assert sorted(str((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"])) for r in made) == brute(rows)


def test_posting_links_join_what_pairs_join():
    rng = random.Random(4)
    for size in (5, 60, 400):
        base = rng.getrandbits(64)
        values = list({base ^ sum(1 << b for b in rng.sample(range(16), rng.randrange(5))) for _ in range(size)})
        signed = [v - (1 << 64) if v >> 63 else v for v in values]
        want = labels([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2], signed)
        made = labels(simhash.posting_links(signed, 2), signed)
        assert len(set(want.values())) == len(set(made.values()))
        assert all((want[a] == want[b]) == (made[a] == made[b]) for a in signed for b in signed)


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 80)]
    random.Random(1).shuffle(pairs)
    made = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect()}
    assert {made[k] for k in range(1, 61)} == {0} and {made[100 + k] for k in range(1, 80)} == {100}


def test_without_copies(spark, docs, empty):
    text = " ".join(f"w{k % 60}x{k % 7}" for k in range(300))
    frame = spark.createDataFrame([(3, text), (1, text), (1, text), (2, "something else entirely that stands alone here"), (None, "no id but a text of its own, quite different")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in simhash.without_copies(frame).collect()) == ["1", "2", "None"]
    assert simhash.without_copies(docs).columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    rows, near = [], {}
    for k in range(60):
        text = [rng.choice(words) for _ in range(300)]
        rows.append((k, " ".join(text)))
        if k % 3 == 0:  # three words of 300 are others: a similarity of about 0.9
            for at in rng.sample(range(300), 3):
                text[at] = rng.choice(words)
            near[1000 + k] = k
            rows.append((1000 + k, " ".join(text)))
    made = {r["doc_id"]: r["root"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(made[a] == made[b] for a, b in near.items()) >= 0.95 * len(near)
    assert len({made[k] for k in range(60)}) == 60


class Bits:
    """Near are numbers that differ in at most 41 bits."""

    def prepared(self, bodies):
        return [int.from_bytes(b, "big") for b in bodies]

    def part(self, prepared, at):
        return [prepared[i] for i in at]

    def near(self, one, k, many):
        return np.array([(one[k] ^ v).bit_count() <= 41 for v in many], bool)


def test_reached_joins_a_large_group_without_pairs():
    rng = random.Random(7)
    base = rng.getrandbits(256)
    group = [(base ^ sum(1 << b for b in rng.sample(range(256), 6))).to_bytes(32, "big") for _ in range(2000)]
    links = linking.reached(np.arange(2000), group, Bits())
    assert len(links) == 1999 and {a for a, _ in links} == {0}


def test_reached_joins_what_pairs_join():
    rng = random.Random(8)
    for size in (3, 4, 40, 300):
        # Members may be near each other though no member is near both first ones.
        values = [sum(1 << b for b in rng.sample(range(256), rng.randrange(45))) for _ in range(size)]
        pairs = [(i, j) for j in range(size) for i in range(j) if (values[i] ^ values[j]).bit_count() <= 41]
        made = linking.reached(np.arange(size), [v.to_bytes(32, "big") for v in values], Bits())
        assert len(made) < size and labels(made, range(size)) == labels(pairs, range(size))


@pytest.mark.parametrize("limit", [1, 7, 60, 1000])
def test_links_within_groups_of_any_size(spark, limit):
    rng = random.Random(limit)
    rows, pairs = [], []
    for group in range(3):
        size = (150, 40, 2)[group]
        # Chains: a member is near the one before it, and few are near the first.
        values = [rng.getrandbits(256)]
        while len(values) < size:
            values.append(rng.getrandbits(256) if rng.random() < 0.1 else rng.choice(values[-3:]) ^ sum(1 << b for b in rng.sample(range(256), 30)))
        rows += [(group, 1000 * group + k, v.to_bytes(simhash.SKETCH, "big")) for k, v in enumerate(values)]
        pairs += [(1000 * group + i, 1000 * group + j) for j in range(size) for i in range(j) if (values[i] ^ values[j]).bit_count() <= 41]
    rng.shuffle(rows)
    made = linking.links_within(spark.createDataFrame(rows, "group long, node long, body binary").repartition(3), simhash.Sketches(41), limit)
    nodes = [r[1] for r in rows]
    assert labels([tuple(r) for r in made.collect()], nodes) == labels(pairs, nodes)


def test_the_tally_drops_pairs_of_a_posting():
    # Five shared bytes of eight meet in a posting, but don't reach the minimum; six do, and then the bits decide.
    base, five, six, bits = 0x1122334455667788, 0x6EDDCC4455667788, 0x6EDD334455667788, 0x1122334455667789
    assert simhash.posting_links([base, five], 2) == [] == simhash.posting_links([base, six], 2)
    assert simhash.posting_links([base, bits], 2) == [(bits, base)]
    assert list(simhash._near(np.array([base, six], np.uint64), 2)) == []


def test_near_copies_equal_brute_force_at_the_limit(spark, rows):
    def shingles(text, width=5):
        words = WORD.findall("".join(c.lower() if c < "\x7f" else c for c in text or ""))
        return frozenset(" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()

    docs, near = [(k, t) for k, (_, t, _) in enumerate(rows)], []
    sets = [shingles(t) for _, t in docs]
    for seed in range(300):  # pairs of a similarity around 0.8
        rng = random.Random(seed)
        text = [f"w{rng.randrange(20000)}" for _ in range(rng.choice((80, 200, 300)))]
        other = list(text)
        for at in rng.sample(range(len(text)), max(1, round(len(text) * rng.uniform(0.015, 0.03)))):
            other[at] = f"w{rng.randrange(20000)}"
        for words in (text, other):
            docs.append((len(docs), " ".join(words)))
            sets.append(shingles(docs[-1][1]))
        a, b = sets[-2:]
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            near.append((len(docs) - 2, len(docs) - 1))
    holders = {}
    for k, s in enumerate(sets):
        for x in s or {None}:
            holders.setdefault(x, []).append(k)
    met = {(i, j) for held in holders.values() for j in held for i in held if i < j}
    pairs = [(i, j) for i, j in met if not sets[i] | sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    want = labels(pairs, range(len(docs)))
    made = {r["doc_id"]: r["root"] for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert len(near) > 60 and all(made[a] == made[b] for a, b in near)
    least = {}
    for k in range(len(docs)):
        least.setdefault(made[k], k)
    assert {k: least[made[k]] for k in made} == want
