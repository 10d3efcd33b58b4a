"""Benchmark decontamination by latent semantic retrieval and subsequence checks.

1. Words are white-space runs in lower case without the punctuation around them, known by 64-bit hashes, and
   hashed to FEATURES places; a place's IDF is counted over all documents.
2. A distributed randomised SVD of the TF-IDF matrix A of passages: one product of A'A with random directions,
   one pass over all documents, from which the driver has the leading RANK latent directions (A'A has no
   negative values, so one product gives both its range and its core), whitened by their singular values.
3. Candidates come from two retrievals, and neither takes from the other. By meaning: every document's words
   are summed in blocks of STRIDE words and windows of each width at every block; an item is cut into passages
   of at most PASSAGE words, each is compared by cosine with the windows just wider than itself, and windows of
   at least COSINE are candidates. By words: a subsequence of LCS of a passage has some of any of its words but
   the few that may be left out, so the windows with enough of the passage's rarest words are found by their
   postings; no window that can hold the passage is lost. Candidates of either kind go if the window and the
   blocks around it hold too few of the passage's words for the subsequence that is asked for (an exact bound).
4. A candidate holds if the longest common subsequence of the passage and the window's surroundings
   covers LCS of the passage, and, unless it covers VERBATIM of it, at least ANSWER of the words of the
   item's answer (its last sentence) stand near.

Every pass covers every document and whole texts. The items are a stated query set: they are held against all
documents in blocks of about ITEMS passages, by one scan of the texts, and are what the driver holds. Nothing of
a document leaves its task but its places (two bytes a word, for the two passes of the fit) and matches.

Defined results: a null or blank text matches nothing, and so does a null or blank item; repeated rows
give repeated results; a null id, of a document or an item, is kept; of several matches of an item in one
text the best one counts (ties: the first); a very long text is searched whole, as a block of its own; other
columns are not read.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, map_arrow
from .words import hashes, slices, split_words

PLACE_BITS = 14
FEATURES, RANK, EXTRA = 1 << PLACE_BITS, 96, 16
STRIDE, WIDTHS, PASSAGE = 16, (32, 48), 32
COSINE, LCS, VERBATIM, ANSWER = 0.4, 0.6, 0.9, 0.5
#: Passages of one block of items, and words of one product.
ITEMS, WORDS = 2_000, 1_024
#: Characters of texts that are searched together.
CHARACTERS = 400_000
#: Presence bits that bound a subsequence.
BITS = 512
#: Tasks that the products are dealt to, at least.
GRAM_TASKS = 6
#: Rows of the latent table that are summed apart.
ROWS = 256

_EDGES = string.punctuation + "«»„“”‘’…"


def plain(word: str) -> str:
    return word.strip(_EDGES) or word


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the plain words of some texts, and where each text's begin (and the end of the last)."""
    words, ends = split_words(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), pc.utf8_split_whitespace)
    trimmed = pc.utf8_trim(words, _EDGES)
    return hashes(pc.if_else(pc.equal(pc.binary_length(trimmed), 0), words, trimmed)), ends


def words_of(text: str) -> np.ndarray:
    return hashed_words(pa.array([text], pa.large_string()))[0]


def places(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - PLACE_BITS)).astype(np.int32)


def features(text: str) -> list[int]:
    return places(words_of(text)).tolist()


def counted_places(docs: DataFrame, text: str) -> tuple[DataFrame, np.ndarray, int]:
    """The places of all texts as written rows, in how many texts each stands, and how many texts there are.

    Two bytes a word are written; FEATURES numbers come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES + 1, bool)
        for batch in batches:
            for part in slices(batch.column(0), CHARACTERS):
                words, ends = hashed_words(part)
                held = places(words).astype("<u2")
                for start, end in pairwise(ends):
                    seen[:] = False
                    seen[held[start:end]] = True
                    seen[FEATURES] = True
                    counts += seen
                rows = pa.array([held[start:end].tobytes() for start, end in pairwise(ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows, pa.nulls(len(rows), pa.binary())], ["places", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["places", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts += np.frombuffer(raw, np.int64)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held])], ["place", "n"])

    written = cut(map_arrow(docs.select(text), run, "places binary, counts binary"))
    rows = map_arrow(written.where("counts is not null").select("counts"), total, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(FEATURES + 1)
    for r in rows:
        counts[r["place"]] = r["n"]
    return written.where("places is not null").select("places"), counts[:FEATURES], int(counts[FEATURES])


def _passages(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and starts of the passages (rows of the TF-IDF matrix) of some texts, about WORDS words at a time."""
    held, starts, size = [], [], 0
    for text in texts:
        places = np.frombuffer(text, "<u2").astype(np.int32)
        for start in range(0, len(places), WORDS):
            part = places[start : start + WORDS]
            held.append(part)
            starts.append(np.arange(0, len(part), PASSAGE) + size)
            size += len(part)
            if size >= WORDS:
                yield np.concatenate(held), np.concatenate(starts)
                held, starts, size = [], [], 0
    if size:
        yield np.concatenate(held), np.concatenate(starts)


class Gram:
    """A'A times basis, summed over passages; what a few passages hold is multiplied as a dense matrix of their own places."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray):
        self.idf, self.basis, self.out = idf, basis, np.zeros((FEATURES, basis.shape[1]), np.float32)
        self.met, self.slot = np.zeros(FEATURES, bool), np.zeros(FEATURES, np.int64)

    def add(self, places: np.ndarray, starts: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(places))))
        # Repeated words of a passage are few; their products are left out of the norm.
        weights = self.idf[places]
        norms = np.sqrt(np.add.reduceat(weights**2, starts))
        weights /= np.maximum(norms, 1e-9)[owner]
        self.met[places] = True
        held = np.flatnonzero(self.met)
        self.met[held] = False
        self.slot[held] = np.arange(len(held))
        table = np.bincount(owner * len(held) + self.slot[places], weights, len(starts) * len(held)).astype(np.float32).reshape(len(starts), -1)
        self.out[held] += table.T @ (table @ self.basis[held])


def _gram_product(rows: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A times basis, for the passages of all documents: partial products are summed by blocks of rows in Spark."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((idf, basis.astype(np.float32)))  # of fixed size
    width = basis.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = Gram(*shared.value)
        for batch in batches:
            for places, starts in _passages(batch.column(0).to_pylist()):
                gram.add(places, starts)
        yield pa.RecordBatch.from_arrays([pa.array(range(0, FEATURES, ROWS), pa.int64()), pa.array([gram.out[k : k + ROWS].tobytes() for k in range(0, FEATURES, ROWS)], pa.binary())], ["row", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[row] = sums.get(row, 0) + np.frombuffer(raw, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["row", "sums"])

    # As many tasks as cores: each sends a partial table of fixed size.
    dealt = rows.coalesce(max(GRAM_TASKS, context.defaultParallelism))
    rows = map_arrow(map_arrow(dealt, part, "row bigint, sums binary").repartition("row"), total, "row bigint, sums binary").collect()
    out = np.zeros((FEATURES, width))
    for r in rows:
        out[r["row"] : r["row"] + ROWS] = np.frombuffer(bytes(r["sums"])).reshape(ROWS, width)
    return out


def latent_table(rows: DataFrame, idf: np.ndarray, *, rank: int = RANK) -> np.ndarray:
    """The whitened latent vector of each place, times its IDF, of written places (counted_places)."""
    basis, _ = np.linalg.qr(np.random.default_rng(11).standard_normal((FEATURES, rank + EXTRA)))
    product = _gram_product(rows, idf, basis)
    # A'A is close to product @ inverse(core) @ product.T; with core = l @ l.T its root is product @ inverse(l.T).
    core = basis.T @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-7 * max(values.max(), 1e-300)
    left, singular, _ = np.linalg.svd(product @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    good = singular[:rank] > 1e-4 * max(singular.max(initial=0.0), 1e-150)
    return (left[:, :rank][:, good] / singular[:rank][good] * idf[:, None]).astype(np.float32)


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        if m := masks.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Item:
    """An item, its words and passages (as hashes of words) and the words of its answer."""

    def __init__(self, key, text: str):
        self.key = key
        self.words = words_of(text)
        sentences = [s for s in re.split(r"(?<=[.?!:])\s+", text.strip()) if s]
        self.answer = Counter(words_of(sentences[-1]).tolist()) if sentences else Counter()
        starts = list(range(0, max(1, len(self.words) - PASSAGE + 1), PASSAGE // 2))
        if len(self.words) > PASSAGE and starts[-1] + PASSAGE < len(self.words):
            starts.append(len(self.words) - PASSAGE)
        self.passages = [self.words[s : s + PASSAGE] for s in starts] if len(self.words) else []


def presence(words: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """BITS bits for each of n rows: those of its words."""
    out = np.zeros((n, BITS), bool)
    out[rows, (words % np.uint64(BITS)).astype(np.intp)] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


class Searcher:
    """Windows of whole texts against the passages of a block of items."""

    def __init__(self, table: np.ndarray, items: list[Item], idf: np.ndarray):
        self.table, self.items = np.vstack([table, np.zeros((1, table.shape[1]), np.float32)]), items
        self.by_width: dict[int, tuple[np.ndarray, list[tuple[int, list[int]]]]] = {}
        self.bits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        owners: dict[int, list[tuple[int, np.ndarray]]] = {w: [] for w in WIDTHS}
        for k, item in enumerate(items):
            for passage in item.passages:
                owners[next((w for w in WIDTHS if w - STRIDE + 1 >= len(passage)), WIDTHS[-1])].append((k, passage))
        for width, held in owners.items():
            if held:
                vectors = np.stack([table[places(p)].sum(0) for _, p in held])
                # A passage has at most so many words in common as bits, and those that share a bit with an earlier one.
                lengths = np.array([len(p) for _, p in held])
                bits = presence(np.concatenate([p for _, p in held]), np.repeat(np.arange(len(held)), lengths), len(held))
                least = np.ceil(LCS * lengths - 1e-9) - (lengths - np.bitwise_count(bits).sum(1, dtype=np.int64))
                self.bits[width] = bits, least
                self.index[width] = self._index([p for _, p in held], idf)
                self.by_width[width] = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).T.copy(), [(k, p.tolist()) for k, p in held]

    @staticmethod
    def _index(rows: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Postings of each passage's rarest words: the words, where a word's begin, the passages, and how many must be met.

        A subsequence that covers LCS of a passage leaves out at most `free` of its words, so it has two at least of
        any free + 2 of them.
        """
        held, need = [], []
        for j, row in enumerate(rows):
            least = int(np.ceil(LCS * len(row) - 1e-9))
            need.append(min(2, least))
            rarest = sorted(zip((-idf[places(row)]).tolist(), row.tolist(), strict=True))[: len(row) - least + need[-1]]
            held += [(w, j) for w in {w for _, w in rarest}]
        held.sort()
        words, begin = np.unique(np.array([w for w, _ in held], np.uint64), return_index=True)
        return words, np.append(begin, len(held)), np.array([j for _, j in held]), np.array(need)

    def _met(self, words: np.ndarray, blocks: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Every (block, passage) where the window that begins there and the blocks around it may hold LCS of the passage."""
        known, begin, passages, need = self.index[width]
        n = width // STRIDE
        slot = np.zeros(1 << 18, bool)
        slot[known & np.uint64(0x3FFFF)] = True
        at = np.flatnonzero(slot[words & np.uint64(0x3FFFF)])
        found = np.minimum(np.searchsorted(known, words[at]), len(known) - 1)
        at, found = at[same := known[found] == words[at]], found[same]
        counts = begin[found + 1] - begin[found]
        of = np.repeat(np.arange(len(at)), counts)
        j = passages[begin[found][of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)]
        first = at[of] // STRIDE
        # A window is heard from a block before its first to a block after its last.
        spread = (first[:, None] + np.arange(-n, 2)).ravel()
        j = np.repeat(j, n + 2)
        inside = (spread >= 0) & (spread < blocks)
        pairs, hits = np.unique(spread[inside] * len(need) + j[inside], return_counts=True)
        pairs = pairs[hits >= need[pairs % len(need)]]
        return pairs // len(need), pairs % len(need)

    def candidates(self, found: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, list[int], float]]:
        """(text, first word, width, item, passage, cosine) of windows that are near a passage and hold enough of its words.

        `found` has the hashes of the words of all texts, `ends` the bounds of each text in it.
        """
        lengths = np.diff(ends)
        sizes = -(-lengths // STRIDE)
        # Texts are filled up to whole blocks with a word whose vector is zero.
        at = np.arange(len(found)) + np.repeat((np.cumsum(sizes) - sizes) * STRIDE - ends[:-1], lengths)
        hashes = np.zeros(sizes.sum() * STRIDE, np.uint64)
        hashes[at] = found
        words = np.full(len(hashes), FEATURES, np.int32)
        words[at] = places(found)
        words = words.reshape(-1, STRIDE)
        sums = self._sums(words)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        present = presence(found, at // STRIDE, len(words))
        for width, (vectors, held) in self.by_width.items():
            n = width // STRIDE
            window, around = sums.copy(), present.copy()
            for k in range(1, n):
                same = owner[k:] == owner[:-k]
                window[:-k] += sums[k:] * same[:, None]
                around[:-k] |= np.where(same[:, None], present[k:], np.uint64(0))
            # What is verified reaches a block further on either side.
            same = owner[1:] == owner[:-1]
            around[1:] |= np.where(same[:, None], present[:-1], np.uint64(0))
            if len(owner) > n:
                around[:-n] |= np.where((owner[n:] == owner[:-n])[:, None], present[n:], np.uint64(0))
            whole = (index == 0) | (index + n <= sizes[owner])
            begins = np.flatnonzero(whole)
            row_of = np.cumsum(whole) - 1
            met, passage = self._met(hashes, len(words), width)
            met, passage = row_of[met[whole[met]]], passage[whole[met]]
            window = window[begins]
            window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-9)
            bits, least = self.bits[width]
            around = around[begins]
            for start in range(0, len(window), 4096):
                near = window[start : start + 4096] @ vectors
                # Windows near in meaning, and all that hold enough of a passage's rare words.
                hit = near >= COSINE
                a, b = np.searchsorted(met, (start, start + len(near)))
                hit[met[a:b] - start, passage[a:b]] = True
                i, j = np.nonzero(hit)
                # A subsequence has no more words than the passage has in common with the surroundings.
                common = np.bitwise_count(around[start + i] & bits[j]).sum(1, dtype=np.int16)
                for i, j in zip(i[kept := common >= least[j]].tolist(), j[kept].tolist(), strict=True):
                    at = begins[start + i]
                    yield int(owner[at]), int(index[at]) * STRIDE, width, *held[j], float(near[i, j])

    def _sums(self, words: np.ndarray) -> np.ndarray:
        """The sum of the vectors of each block of words."""
        out = np.empty((len(words), self.table.shape[1]), np.float32)
        for start in range(0, len(words), 1024):
            part = words[start : start + 1024]
            total = self.table[part[:, 0]]
            for k in range(1, STRIDE):
                total += self.table[part[:, k]]
            out[start : start + 1024] = total
        return out

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, cosine, covered, answer) of each item found in each text; texts and items by their number."""
        found, ends = hashed_words(texts)
        if not len(found) or not self.by_width:
            return
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for row, first, width, k, passage, cosine in self.candidates(found, ends):
            words, item = found[ends[row] : ends[row + 1]], self.items[k]
            around = words[max(0, first - STRIDE) : first + width + STRIDE].tolist()
            different = set(passage)
            if len(different.intersection(around)) + len(passage) - len(different) < LCS * len(passage) - 1e-9:
                continue
            covered = lcs_length(passage, around) / len(passage)
            if covered < LCS - 1e-9:
                continue
            reach = len(item.words)
            near = Counter(words[max(0, first - reach) : first + width + reach].tolist())
            answer = sum((item.answer & near).values()) / max(1, sum(item.answer.values()))
            if covered < VERBATIM and answer < ANSWER:
                continue
            if (row, k) not in best or best[row, k][1] < covered:
                best[row, k] = (cosine, covered, answer)
        for (row, k), values in sorted(best.items()):
            yield row, k, *values


def item_blocks(items: DataFrame, key: str, text: str) -> list[list[tuple]]:
    """The distinct items, as ids and texts, in blocks of about ITEMS passages."""
    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").distinct().orderBy("k", "t").collect()
    out, size = [[]], 0
    for r in rows:
        passages = 1 + 2 * len(r["t"].split()) // PASSAGE
        if out[-1] and size + passages > ITEMS:
            out.append([])
            size = 0
        out[-1].append((r["k"], r["t"]))
        size += passages
    return out


#: The searchers of the last table and items that this worker has met.
_SEARCHERS: dict[int, list[Searcher]] = {}


def _searchers(shared) -> list[Searcher]:
    if shared.id not in _SEARCHERS:
        _SEARCHERS.clear()
        table, idf, found = shared.value
        _SEARCHERS[shared.id] = [Searcher(table, [Item(*row) for row in block], idf) for block in found]
    return _SEARCHERS[shared.id]


class Shared:
    """A broadcast and its number, by which a worker knows what it has made of it."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def _shared(docs: DataFrame, items: DataFrame, text: str, item_key: str, item_text: str) -> Shared:
    """The latent table (of fixed size) and the items, for all tasks."""
    written, counts, total = counted_places(docs, text)
    idf = np.log((1 + total) / (1 + counts))
    found = item_blocks(items, item_key, item_text)
    return Shared(docs.sparkSession.sparkContext.broadcast((latent_table(written, idf), idf, found)))


def _found(shared: Shared, texts: pa.Array) -> Iterator[tuple[int, object, float, float, float]]:
    """(row, item id, cosine, lcs, answer) of each item found in some texts."""
    start = 0
    for part in slices(texts, CHARACTERS):
        for searcher in _searchers(shared):
            for row, k, *values in searcher.matches(part):
                yield start + row, searcher.items[k].key, *values
        start += len(part)


def matches(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns `key`, item_id, cosine, lcs, answer: one row for each item found in a row of docs."""
    kind, item_kind = docs.schema[key].dataType, items.schema[item_key].dataType
    schema = f"`{key}` {kind.simpleString()}, item_id {item_kind.simpleString()}, cosine double, lcs double, answer double"
    types = [to_arrow_type(item_kind), *[pa.float64()] * 3]
    shared = _shared(docs, items, text, item_key, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := list(_found(shared, batch.column(1))):
                columns = [pa.array([r[k + 1] for r in found], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in found], pa.int64())), *columns], [key, "item_id", "cosine", "lcs", "answer"])

    return map_arrow(docs.select(key, docs[text].alias("__text")), run, schema)


def without_items(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no item is found; no shuffle."""
    at = docs.columns.index(text)
    shared = _shared(docs, items, text, item_key, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {r[0] for r in _found(shared, batch.column(at))}
            yield batch.take(pa.array([k for k in range(batch.num_rows) if k not in found], pa.int64())) if found else batch

    return map_arrow(docs, run, docs.schema)
