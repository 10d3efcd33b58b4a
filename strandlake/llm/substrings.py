"""Repeated passages by prefix-partitioned suffix trees.

A suffix begins at a word; only its first WINDOW words matter. It is known by hashes of its prefixes of
PREFIXES and WINDOW words, which are the levels of the suffix tree that are kept.

1. Sparing. A window's anchor is the least of its hashed GRAM-word grams. Equal windows have equal
   anchors, so a window whose anchor stands only once in all documents cannot repeat. Each text sends
   its distinct anchors (about 7 % of its words); anchors are counted with map-side sums. This is an
   exact filter: it only lets go what cannot repeat.
2. Prefix partition. A suffix goes to the group of its shortest prefix that stands no more than GROUP
   times (or a HEAVY-th of all words, if that is more, so that a table of the others is bounded): the prefix
   of very common words is lengthened until its group fits. The same pass counts prefixes, batch by batch those
   that a batch holds COMMON times. Suffixes whose whole window stands that often are a group of one leaf
   each; map-side sums count it however often it repeats, so no task gets all copies of a passage.
3. Subtrees. Each group is sorted by its prefixes, which lays out the group's subtree: the depth of the node
   that joins neighbours is the longest prefix that they share. Below a node at least WINDOW words deep a
   maximal repeat starts; its leaves are the suffixes that repeat. Groups are streamed.
4. Each text gets its repeated starts back and loses the words that they cover. Texts are dealt by
   their key once; both joins with them use that exchange.

Windows are told apart by 96 bits: 32 of each of three prefixes, or 64 of the window and 32 of a prefix.

Defined results: a null text has no words; a text of fewer than WINDOW words loses none; repeated rows
are repeats of each other and are all reported; a null id is kept; a very long text is cut into words at
once, as a batch of its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, partitions
from .words import hashes, slices, split_words

WINDOW, GRAM = 35, 8
#: Words of the prefixes that part suffixes into groups, and suffixes of a group beyond which the prefix is lengthened.
PREFIXES, GROUP = (8, 16), 50_000
#: Prefixes of a batch are counted from so many places on; frequent prefixes of a length, at most.
COMMON, HEAVY = 16, 100_000
#: Bytes of texts that are cut into words together.
BYTES = 4_000_000

_MIX, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def documents_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of the words of each text, cut at the six ASCII white-space bytes."""
    for part in slices(texts, BYTES):
        words, ends = split_words(pc.fill_null(part, "").cast(pa.large_string()), pc.ascii_split_whitespace)
        found = hashes(words)
        for start, end in pairwise(ends):
            yield found[start:end]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(29)) * _MIX
    return values ^ values >> np.uint64(32)


def prefix_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` words from each word on, by doubling."""
    out = np.zeros(max(0, len(words) - length + 1), np.uint64)
    if not len(out):
        return out
    at, size, power, run = 0, 1, words, length
    while run:
        if run & 1:
            out = _mixed(out * _MIX + power[at : at + len(out)] + np.uint64(size))
            at += size
        run >>= 1
        if run:
            power = _mixed(power[:-size] * np.uint64(0xC2B2AE3D27D4EB4F) + power[size:] + np.uint64(size))
            size *= 2
    return out


def window_anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` neighbouring grams."""
    least, size = grams, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(least) - (span - size)], least[span - size :]) if span > size else least


def _anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    gram = min(GRAM, window)
    grams = prefix_hashes(words, gram)
    return grams, window_anchors(grams, window - gram + 1)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _rowed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns id, doc (a hash of id and text), body, dealt by doc."""
    body = docs[text]
    rows = docs.select(docs[key].alias("id"), F.xxhash64(F.coalesce(docs[key].cast("string"), F.lit("")), F.coalesce(body, F.lit(""))).alias("doc"), body.alias("body"))
    return rows.repartition(partitions(docs.sparkSession), "doc")


def _met(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join on the hash; rows whose hashes collide are told apart by their ids."""
    found = found.withColumnsRenamed({"id": "found_id", "doc": "found_doc"})
    return rows.join(found, (F.col("doc") == F.col("found_doc")) & (F.size(F.array_distinct(F.array("id", "found_id"))) == 1), how)


def _prefixes(window: int) -> tuple[int, ...]:
    return tuple(sorted({min(p, window) for p in PREFIXES}))


def _common(words: list[np.ndarray], window: int, common: int) -> dict[int, dict[int, int]]:
    """Of some texts, the prefixes of each length that stand `common` times, and how often; longer ones below common ones only."""
    found: dict[int, dict[int, int]] = {}
    places = [np.arange(max(0, len(w) - window + 1)) for w in words]
    for length in _prefixes(window):
        made = [prefix_hashes(w, length)[at] for w, at in zip(words, places, strict=True) if len(at)]
        if not made:
            return found
        values, counts = np.unique(np.concatenate(made), return_counts=True)
        values, counts = values[counts >= common], counts[counts >= common]
        found[length] = dict(zip(values.view(np.int64).tolist(), counts.tolist(), strict=True))
        places = [at[_among(prefix_hashes(w, length)[at], values)] for w, at in zip(words, places, strict=True)]
        words, places = zip(*[(w, at) for w, at in zip(words, places, strict=True) if len(at)], strict=True) if any(map(len, places)) else ((), ())
    return found


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among some sorted ones."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def counted(docs: DataFrame, window: int, common: int) -> DataFrame:
    """Columns id, doc, length, value, n: of each text its anchors (length 0) and how often they stand in it; of batches
    their common prefixes (of `length` words, without id) and their words (length -1)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "doc", "length", "value", "n"]
        for batch in batches:
            texts = list(documents_words(batch.column(2)))
            found, counts, sizes = [], [], []
            for words in texts:
                if len(words) < window:
                    sizes.append(0)
                    continue
                grams, anchors = _anchors(words, window)
                anchors = np.unique(anchors)
                grams = np.sort(grams)
                found.append(anchors)
                counts.append(np.searchsorted(grams, anchors, "right") - np.searchsorted(grams, anchors, "left"))
                sizes.append(len(anchors))
            if not found:
                continue
            at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.zeros(len(at), np.int32)), _signed(np.concatenate(found)), pa.array(np.concatenate(counts).astype(np.int64))], names)
            rows = [(length, v, n) for length, held in _common([w for w in texts if len(w) >= window], window, common).items() for v, n in held.items()]
            rows.append((-1, 0, sum(map(len, texts))))
            nulls = [pa.nulls(len(rows), batch.column(k).type) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*nulls, *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64())))], names)

    return map_arrow(docs, run, f"id {kind}, doc bigint, length int, value bigint, n bigint")


def shared_anchors(docs: DataFrame, window: int, group: int, common: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Columns id, doc, anchors (those of each text that stand at least twice in all texts); and by length the prefixes
    that stand too often for one group, at most HEAVY of each length."""
    stands = counted(docs, window, common)
    # A text that has an anchor twice shares it by itself.
    sums = cut(stands.groupBy("length", "value").agg(F.sum("n").alias("n")).where("length = -1 or n > 1"))
    words = sums.where("length = -1").agg(F.sum("n")).first()[0] or 0
    frequent = sums.where((F.col("length") > 0) & (F.col("n") > max(group, words // HEAVY))).select("length", "value").collect()
    heavy = {p: np.sort(np.array([r["value"] for r in frequent if r["length"] == p], np.int64).view(np.uint64)) for p in _prefixes(window)}
    kept = stands.where("length = 0").select("id", "doc", "value").join(sums.where("length = 0").select("value"), "value")
    return kept.groupBy("id", "doc").agg(F.collect_set("value").alias("anchors")), heavy


def suffixes(rows: DataFrame, anchors: DataFrame, heavy, window: int, whole_windows: bool) -> DataFrame:
    """Columns id, doc, pos, part, path: suffixes whose window has a shared anchor.

    `part` names the group: it is of the shortest prefix that is not among the heavy ones. `path` leads on through the
    tree: its upper half is of the next longer prefix, its lower half of the window. With `whole_windows` the
    suffixes all of whose prefixes are heavy, whose path is of the window alone, else all others.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _prefixes(window)
        for batch in batches:
            sizes, made = [], [[], [], []]
            flat, ends = batch.column(3).flatten().to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy()
            for k, words in enumerate(documents_words(batch.column(2))):
                shared = np.sort(flat[ends[k] - ends[0] : ends[k + 1] - ends[0]].astype(np.int64).view(np.uint64))
                at = np.flatnonzero(_among(_anchors(words, window)[1], shared))
                levels = [prefix_hashes(words, p)[at] for p in (*lengths, window)]
                crowded = np.ones(len(at), bool)
                part, path = levels[-2].copy(), levels[-1].copy()
                depth = np.zeros(len(at), np.int64)
                for p, level in zip(lengths, levels, strict=False):
                    crowded &= _among(level, heavy.value[p])
                    depth += crowded
                for d in range(len(lengths)):
                    here = depth == d
                    part[here] = levels[d][here]
                    if d + 1 < len(lengths):
                        path[here] = levels[d + 1][here] >> _HALF << _HALF | levels[-1][here] >> _HALF
                keep = np.flatnonzero(crowded == whole_windows)
                sizes.append(len(keep))
                for out, values in zip(made, (at.astype(np.int32), (part >> _HALF).astype(np.uint32).view(np.int32), path.view(np.int64)), strict=True):
                    out.append(values[keep])
            at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.concatenate(m)) for m in made)], ["id", "doc", "pos", "part", "path"])

    joined = _met(rows, anchors, "inner").select("id", "doc", "body", "anchors")
    return map_arrow(joined, run, f"id {kind}, doc bigint, pos int, part int, path bigint")


def deep_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sorted suffixes of subtrees (id, doc, pos, part, path), the leaves below internal nodes as deep as a window.

    Levels of the node that joins neighbours: 0 none (another group), 1 the group's prefix, 2 the next longer one, 3 the window.
    """
    held, met = None, False
    for batch in batches:
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        if not rows.num_rows:
            continue
        part, path = rows.column(3).to_numpy(), rows.column(4).to_numpy()
        same = [c[1:] == c[:-1] for c in (part, path >> 32, path)]
        level = same[0].astype(np.int8) * (1 + same[1].astype(np.int8) * (1 + same[2].astype(np.int8)))
        deep = np.concatenate((level == 3, [False])) | np.concatenate(([met], level == 3))
        # The last suffix waits for its next neighbour.
        out = np.flatnonzero(deep[:-1])
        if len(out):
            yield rows.take(pa.array(out)).select(["id", "doc", "pos"])
        held, met = rows.slice(rows.num_rows - 1), bool(deep[-1])
    if held is not None and met:
        yield held.select(["id", "doc", "pos"])


def repeated_starts(docs: DataFrame, rows: DataFrame, window: int, group: int, common: int) -> DataFrame:
    """Columns id, doc, pos: the suffixes whose window starts anywhere else too."""
    anchors, heavy = shared_anchors(docs, window, group, common)
    # Numbers only, some percent of the words; what follows reads the written rows.
    anchors = cut(anchors)
    shared = docs.sparkSession.sparkContext.broadcast(heavy)  # at most HEAVY numbers a length
    dealt = suffixes(rows, anchors, shared, window, False).repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "path")
    kind = rows.schema["id"].dataType.simpleString()
    found = map_arrow(dealt, deep_leaves, f"id {kind}, doc bigint, pos int")
    if all(len(h) for h in heavy.values()):
        crowd = suffixes(rows, anchors, shared, window, True)
        nodes = crowd.groupBy("part", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part", "path")
        found = found.union(crowd.join(nodes, ["part", "path"]).select("id", "doc", "pos"))
    return found


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP, common: int = COMMON) -> DataFrame:
    """Columns `key`, n_words, n_removed, kept (the words left, joined by blanks) of every row."""
    rows = _rowed(docs, key, text)
    plain = docs.select(docs[key].alias("id"), F.xxhash64(F.coalesce(docs[key].cast("string"), F.lit("")), F.coalesce(docs[text], F.lit(""))).alias("doc"), docs[text].alias("body"))
    starts = repeated_starts(plain, rows, window, group, common).groupBy("id", "doc").agg(F.collect_list("pos").alias("starts"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.encode().split() if text else []
                totals.append(len(words))
                if not starts.is_valid:
                    removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                edges, at = np.zeros(len(words) + 1, np.int64), starts.values.to_numpy()
                np.add.at(edges, at, 1)
                np.add.at(edges, at + window, -1)
                left = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
                removed.append(len(words) - len(left))
                kept.append(b" ".join([words[i] for i in left]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [key, "n_words", "n_removed", "kept"])

    return map_arrow(_met(rows, starts, "left").select("id", "body", "starts"), run, f"`{key}` {kind}, n_words bigint, n_removed bigint, kept string")
