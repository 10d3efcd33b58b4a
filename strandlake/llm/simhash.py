"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most d bits share
at least 8 - d of them: the guaranteed minimum of matches. The postings of single positional bytes
hold a 256th of all fingerprints each, so tallying over them would grow with the square of the input.
But of any PREFIX positions a pair that reaches the minimum shares at least PREFIX - d, so the index posts
every set of PREFIX - d of the first PREFIX positions. In a posting the shared positional bytes of each pair
are tallied over all eight positions, pairs that don't reach 8 - d are dropped, and the differing bits of
the others are verified. A posting with more members than there are values within d bits looks these
values up instead of forming all its pairs. Links leave a posting as stars, at most one a member, which
keeps its components and never writes all its pairs.

Equal texts have equal fingerprints; the index holds each distinct fingerprint once, so copies cost
nothing. A fingerprint of very many rows is dealt to several tasks where rows get their component.

Texts that are similar without near fingerprints (the pipeline's five-word shingles, from a Jaccard similarity
of 0.8 on) are found by near_copies(), which posts sets of positional bytes of a longer sketch.

Components are those of the link graph. Defined results: a null text counts as the empty
text; a text with no words has fingerprint zero, which links like any other; repeated rows give
repeated results; null ids are kept, and are never a component's id unless it has no other; very long
texts are fingerprinted whole; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, cut, map_arrow, partitions, spread_join
from .components import components
from .linking import links_within

#: The words of a text are cut at ASCII white space.
_WORDS = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Positions of a fingerprint whose bytes are posted.
PREFIX = 6
#: Sets of bytes of a sketch that are posted, bytes of each, and bytes of a sketch.
POSTINGS, GROUP = 26, 5
SKETCH = POSTINGS * GROUP


def simhash(text: str, width: int = 3) -> int:
    """The fingerprint: a bit is set if more than half of the shingles' XXH64 values have it."""
    words = _WORDS.findall(text.lower() if text.isascii() else text.translate(_LOWER))
    if not words:
        return 0
    shingles = map(" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [" ".join(words)]
    digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
    bits = np.zeros(64, np.int64)
    n = len(digests) // 8
    for start in range(0, len(digests), 8 << 16):
        part = np.frombuffer(digests[start : start + (8 << 16)], np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Columns `key`, text_hash and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts):
                made = np.array([simhash(t, width) for t in texts[a:b]], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(made)], [key, "text_hash", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    whole = F.coalesce(docs[text], F.lit(""))
    return map_arrow(docs.select(key, F.xxhash64(whole).alias("text_hash"), whole.alias("__text")), run, f"`{key}` {kind}, text_hash bigint, fp bigint")


def _near(values: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of distinct values that share 8 - bits bytes and differ in at most `bits` bits."""
    apart = values[0] ^ values
    open_bits = [k for k in range(64) if np.bitwise_or.reduce(apart) >> np.uint64(k) & np.uint64(1)]
    flips = [sum(1 << k for k in chosen) for n in range(1, bits + 1) for chosen in combinations(open_bits, n)]
    if len(values) <= len(flips):
        for i in range(len(values) - 1):
            apart = values[i + 1 :] ^ values[i]
            tally = np.count_nonzero(apart[:, None].view(np.uint8) == 0, axis=1)
            for j in np.flatnonzero(tally >= 8 - bits):
                if int(apart[j]).bit_count() <= bits:
                    yield i, i + 1 + int(j)
        return
    # So few bits can't differ in more than as many bytes, so all that is looked up reaches the minimum.
    order = np.argsort(values)
    for flip in flips:
        wanted = values ^ np.uint64(flip)
        at = np.minimum(np.searchsorted(values, wanted, sorter=order), len(values) - 1)
        found = order[at]
        for i in np.flatnonzero((values[found] == wanted) & (values < wanted)):
            yield int(i), int(found[i])


def posting_links(values: list[int], bits: int) -> list[tuple[int, int]]:
    """Star links that join the members of a posting as its verified pairs do."""
    v = np.unique(np.array(values, np.int64)).view(np.uint64)
    root = list(range(len(v)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in _near(v, bits):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    signed = v.view(np.int64)
    return [(int(signed[i]), int(signed[find(i)])) for i in range(len(v)) if find(i) != i]


def links(distinct: DataFrame, *, bits: int = 2) -> DataFrame:
    """Columns a and b: links between distinct fingerprints (column fp) that join what is within `bits` bits."""
    masks = []
    for kept in combinations(range(max(PREFIX, bits + 1)), max(PREFIX, bits + 1) - bits):
        mask = sum(0xFF << 8 * k for k in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    # Dealt to a set number of tasks, since each row becomes as many as there are sets.
    posted = distinct.repartition(partitions(distinct.sparkSession), "fp").select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("which", "part"))
    # Most postings have one member and end here, as sums.
    crowded = posted.groupBy("which", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("which", "part")
    met = posted.join(crowded, ["which", "part"], "left_semi").repartition(partitions(distinct.sparkSession), "which", "part").sortWithinPartitions("which", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fps = None, []
        for batch in batches:
            for fp, *posting in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if posting != held:
                    yield _linked(fps, bits)
                    held, fps = posting, []
                fps.append(fp)
        yield _linked(fps, bits)

    return map_arrow(met.select("fp", "which", "part"), run, "a bigint, b bigint").distinct()


def _linked(fps: list[int], bits: int) -> pa.RecordBatch:
    found = posting_links(fps, bits) if len(fps) > 1 else []
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """Columns `key`, text_hash (XXH64), fp and component_id (the least id of the component) of every row."""
    made = cut(fingerprints(docs, key=key, text=text, width=width))
    distinct = made.groupBy("fp").agg(F.min(key).alias("least"))
    rooted = distinct.join(components(links(distinct.select("fp"), bits=bits), "a", "b"), F.col("fp") == F.col("node"), "left")
    rooted = rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return spread_join(made, named, "fp").select(key, "text_hash", "fp", "root", "component_id")


def shingle_hashes(text: str, width: int = 5) -> np.ndarray:
    """The set of word shingles as sorted XXH3-64 values; a shorter text is one shingle, no words are none."""
    words = _WORDS.findall(text.lower() if text.isascii() else text.translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64))


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """A multiplier and an offset for each byte of a sketch: orders of the 32-bit numbers."""
    rng = np.random.default_rng(3)
    return rng.integers(0, 1 << 31, SKETCH, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, SKETCH, np.uint32)


_TIMES, _PLUS = _orders()


def sketch(hashes: np.ndarray) -> bytes:
    """SKETCH positional bytes: each is of the least member of the set in an order of its own, so two sets share a byte as often as they are alike."""
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(low), 1024):
        np.minimum(least, (low[start : start + 1024, None] * _TIMES + _PLUS).min(0), out=least)
    # The least numbers have few high bits, so they are mixed before a byte is taken.
    mixed = (least ^ least >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return ((mixed ^ mixed >> np.uint32(12)) * np.uint32(0x297A2D39) >> np.uint32(24)).astype(np.uint8).tobytes()


def differing_bits(similarity: float) -> int:
    """Bits in which sketches of sets of this Jaccard similarity differ, and four deviations more; half the bits of a byte that isn't shared do."""
    n, p = SKETCH, 1 - similarity
    return int(4 * n * p + 4 * math.sqrt(16 * n * p * (1 - p) + 2 * n * p))


class Sketches:
    """Near are sketches that differ in at most `most` bits."""

    def __init__(self, most: int):
        self.most = most

    def prepared(self, bodies: list[bytes]) -> np.ndarray:
        whole = np.zeros((len(bodies), -(-SKETCH // 8) * 8), np.uint8)
        whole[:, :SKETCH] = np.frombuffer(b"".join(bodies), np.uint8).reshape(len(bodies), SKETCH)
        return whole.view(np.uint64)

    def part(self, prepared: np.ndarray, at: np.ndarray) -> np.ndarray:
        return prepared[at]

    def near(self, one: np.ndarray, k: int, many: np.ndarray) -> np.ndarray:
        return np.bitwise_count(many ^ one[k]).sum(1, dtype=np.int32) <= self.most


class Shingles:
    """Near are texts whose sets of word shingles have a Jaccard similarity of at least `similarity`: by sketch and size first, then exactly."""

    def __init__(self, similarity: float, width: int):
        self.similarity, self.width, self.sketches = similarity, width, Sketches(differing_bits(similarity))

    def prepared(self, bodies: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        sets = [shingle_hashes(body, self.width) for body in bodies]
        return sets, np.array([len(s) for s in sets]), self.sketches.prepared([sketch(s) for s in sets])

    def part(self, prepared: tuple, at: np.ndarray) -> tuple:
        sets, sizes, sketches = prepared
        return [sets[i] for i in at], sizes[at], sketches[at]

    def near(self, one: tuple, k: int, many: tuple) -> np.ndarray:
        ours, sizes = one[0][k], many[1]
        close = self.sketches.near(one[2], k, many[2])
        close &= np.minimum(sizes, len(ours)) >= self.similarity * np.maximum(sizes, len(ours)) - 1e-9
        for at in np.flatnonzero(close):
            other = many[0][at]
            found = np.searchsorted(ours, other)
            shared = int((ours[np.minimum(found, len(ours) - 1)] == other).sum()) if len(ours) else 0
            close[at] = shared >= self.similarity * (len(other) + len(ours) - shared) - 1e-9
        return close


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Columns `key`, text_hash and root (one number for each component of texts of at least this similarity).

    Texts that differ in some of their words differ in more bits of a fingerprint than a guaranteed minimum of
    positional bytes allows, so the sketch is longer and its bytes are those of least shingles: a byte is shared
    with a chance of the Jaccard similarity. POSTINGS sets of GROUP bytes are posted, and a pair of similarity s
    meets with a chance of 1 - (1 - s ** GROUP) ** POSTINGS: over 0.9999 at 0.8. Members of a posting are
    compared by sketch, with a limit that 0.8 passes by four deviations; the groups that these links form
    get their texts, once a text, and are linked by the exact similarity of their shingles. Both comparisons
    take groups of any size (links_within).
    """
    kind = docs.schema[key].dataType.simpleString()
    session = docs.sparkSession

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts):
                made = [(xxhash.xxh3_64_intdigest(h.tobytes()), sketch(h)) for h in (shingle_hashes(t, width) for t in texts[a:b])]
                nodes = pa.array(np.array([m[0] for m in made], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), nodes, pa.array([m[1] for m in made], pa.binary())], [key, "text_hash", "node", "sketch"])

    whole = F.coalesce(docs[text], F.lit(""))
    made = cut(map_arrow(docs.select(key, F.xxhash64(whole).alias("text_hash"), whole.alias("__text")), fingerprint, f"`{key}` {kind}, text_hash bigint, node bigint, sketch binary"))
    distinct = made.select("node", "sketch").dropDuplicates(["node"])
    # Dealt to a set number of tasks, since each row becomes as many as there are postings.
    dealt = distinct.repartition(partitions(session), "node")
    posted = dealt.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(POSTINGS - 1)), lambda k: F.xxhash64(k, F.substring("sketch", k * GROUP + 1, F.lit(GROUP))))).alias("group"))
    # Most postings have one member and end here, as sums, before any sketch is sent.
    crowded = posted.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    met = posted.join(crowded, "group", "left_semi").join(distinct, "node").select("group", "node", F.col("sketch").alias("body"))
    linked = components(links_within(met, Sketches(differing_bits(similarity))), "a", "b")
    candidates = linked.select("node", F.col("root").alias("group")).union(linked.select("root", "root").distinct())
    # One text of each node that is in a group is sent to the group.
    wanted = made.join(candidates, "node").groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.min("group").alias("group"))
    texts = docs.select(F.xxhash64(whole).alias("text_hash"), whole.alias("body")).join(wanted, "text_hash").dropDuplicates(["node"]).select("group", "node", "body")
    found = components(links_within(texts, Shingles(similarity, width)), "a", "b")
    return spread_join(made, found.select("node", "root"), "node").select(key, "text_hash", F.coalesce("root", "node").alias("root"))


def without_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, one of each component: that of the least id (ties: the least hash of the text, then of the row)."""
    found = near_copies(docs, key=key, text=text, width=width, similarity=similarity)
    keepers = found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("null"), F.col(key).alias("id"), F.col("text_hash").alias("hash"))).alias("k"))
    keepers = keepers.select(F.xxhash64(F.coalesce(F.col("k.id").cast("string"), F.lit("")), "k.hash").alias("__row")).distinct()
    rows = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.xxhash64(F.coalesce(F.col(text), F.lit("")))))
    first = Window.partitionBy("__row").orderBy(F.xxhash64(*[F.to_json(F.struct(c)) for c in docs.columns if c != text]))
    return rows.join(keepers, "__row", "left_semi").withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__row", "__nth")
