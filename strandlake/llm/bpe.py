"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

Encoding. A text is cut into pre-tokens by the tokenizer's pattern. The distinct pre-tokens of a
batch that the worker has not met before become token-position rows; a recursive query joins
neighbouring rows with the merge table and contracts each pre-token's leftmost pair of minimum rank
until no pair of it is in the table. Decoding joins the ids with the vocabulary and concatenates the
bytes by an ordered aggregation; the ids of a pre-token that comes again are decoded once.

One pair a round would take a pre-token of n letters n rounds over n rows. In a pre-token of more than
LONG bytes a round therefore contracts every pair whose rank no pair within reach of it undercuts: a
merge that starts further away can't arrive before it, since a token that had eaten its way there would
be longer than any token of the vocabulary that stands in the pre-token. The ids are the same.

Defined results: a null text counts as the empty text, which has no ids and decodes to no bytes;
repeated rows give repeated results; a null id is kept; other columns are not read. A very long text is
encoded like any other: its pre-tokens are found in pieces of PIECE characters, cut where a pre-token
is sure to begin. Memory is bounded by the batch, by twice WORDS_HELD cached pre-tokens, by DECODE_ROWS
ids a query, and by the longest pre-token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import KEPT, blocks, map_arrow, trim

#: Unicode white space, as the tokenizer's pattern understands \s.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cached pre-tokens of a worker: when there are more, those not met since the last time are forgotten.
WORDS_HELD = 120_000
#: Pre-tokens of one recursive query, and ids of one decoding query.
ENCODE_WORDS = 40_000
DECODE_ROWS = 1_000_000
#: Bytes beyond which a pre-token is contracted at many places a round, and characters of a piece of a text.
LONG, PIECE = 192, 500_000

_CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")

_CONTRACT = """
WITH RECURSIVE state AS (
    SELECT word, list(token ORDER BY pos) AS tokens, CAST(0 AS BIGINT) AS best FROM start GROUP BY word
  UNION ALL
    SELECT open.word,
           CASE WHEN chosen.best IS NULL THEN open.tokens
                ELSE open.tokens[:chosen.spot - 1] || [chosen.merged] || open.tokens[chosen.spot + 2:] END,
           chosen.best
    FROM (SELECT word, tokens FROM state WHERE best IS NOT NULL) AS open
    LEFT JOIN (
        SELECT word, min(merged * 4294967296 + spot) AS best,
               CAST(min(merged * 4294967296 + spot) % 4294967296 AS INTEGER) AS spot,
               CAST(min(merged * 4294967296 + spot) // 4294967296 AS INTEGER) AS merged
        FROM (
            SELECT word, unnest(tokens[:-2]) AS first, unnest(tokens[2:]) AS second, generate_subscripts(tokens[2:], 1) AS spot
            FROM state WHERE best IS NOT NULL AND len(tokens) > 1
        ) AS pairs JOIN merges USING (first, second)
        GROUP BY word
    ) AS chosen ON open.word = chosen.word
)
SELECT word, token
FROM (SELECT word, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS spot FROM state WHERE best IS NULL)
ORDER BY word, spot
"""


#: One round of a long pre-token: pairs of the least rank within reach, every other one of neighbours of equal rank.
_CONTRACT_LONG = """
WITH pairs AS (
    SELECT pos, token, merged FROM (SELECT pos, token AS first, lead(token) OVER (ORDER BY pos) AS second, token FROM long) LEFT JOIN merges USING (first, second)
), near AS (
    SELECT *, coalesce(merged = min(merged) OVER (ORDER BY pos ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING), false) AS least,
           CASE WHEN merged IS NOT DISTINCT FROM lag(merged) OVER (ORDER BY pos) THEN 0 ELSE 1 END AS begins
    FROM pairs
), chains AS (
    SELECT *, sum(begins) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chain FROM near
), chosen AS (
    SELECT pos, token, merged, bool_and(least) OVER upto AND (row_number() OVER upto) % 2 = 1 AS joins
    FROM chains WINDOW upto AS (PARTITION BY chain ORDER BY pos ROWS UNBOUNDED PRECEDING)
), met AS (
    SELECT pos, CASE WHEN joins THEN CAST(merged AS INTEGER) ELSE token END AS token, coalesce(lag(joins) OVER (ORDER BY pos), false) AS eaten FROM chosen
)
SELECT row_number() OVER (ORDER BY pos) AS pos, token FROM met WHERE NOT eaten
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file, whose lines are a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class DuckBpe:
    """One worker's encoder and decoder over an in-memory DuckDB connection."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        #: Ids (little-endian unsigned 32-bit integers) and decoded bytes of each pre-token: met lately, and before.
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.former: dict[str, tuple[bytes, bytes]] = {}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens: dict[int, set[bytes]] = {}
        for token in ranks:
            self.tokens.setdefault(len(token), set()).add(token)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        first, second, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    first.append(a), second.append(b), merged.append(rank)
        self._table("merges", first=pa.array(first, pa.int32()), second=pa.array(second, pa.int32()), merged=pa.array(merged, pa.int64()))
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]
        self._table("vocabulary", token=pa.array(ranks.values(), pa.int32()), hex=pa.array([t.hex() for t in ranks]))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(r) for r in words], np.int64)
        ends = np.cumsum(sizes)
        self._table(
            "start",
            word=pa.array(np.repeat(np.arange(len(words), dtype=np.int32), sizes)),
            pos=pa.array(np.arange(ends[-1], dtype=np.int64) - np.repeat(ends - sizes, sizes)),
            token=pa.array(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]),
        )
        out = self.db.execute(_CONTRACT).fetchnumpy()
        ids = np.ascontiguousarray(out["token"], "<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(out["word"], minlength=len(words)))).tolist()
        return [ids[start:end] for start, end in zip([0, *ends], ends, strict=False)]

    def longest_token(self, word: bytes) -> int:
        """Bytes of the longest token that stands in a pre-token."""
        for size in sorted(self.tokens, reverse=True):
            if size <= len(word) and not self.tokens[size].isdisjoint(word[k : k + size] for k in range(len(word) - size + 1)):
                return size
        return 1

    def _contract_long(self, word: bytes) -> bytes:
        self._table("long", pos=pa.array(np.arange(len(word))), token=pa.array(self.byte_ids[np.frombuffer(word, np.uint8)]))
        step, size = _CONTRACT_LONG.format(reach=3 * self.longest_token(word)), len(word)
        while True:
            self.db.execute(f"CREATE OR REPLACE TABLE long AS {step}")
            left = self.db.execute("SELECT count(*) FROM long").fetchall()[0][0]
            if left == size:
                return np.ascontiguousarray(self.db.execute("SELECT token FROM long ORDER BY pos").fetchnumpy()["token"], "<u4").tobytes()
            size = left

    def _learn(self, words: set[str]) -> None:
        """Encode and decode pre-tokens that are not known. Those of like length share a query, so that few rounds run for one long word."""
        new = sorted(words, key=len)
        raw = [w.encode() for w in new]
        ids: list[bytes] = []
        while len(ids) < len(new):
            start = end = len(ids)
            size = 0
            while end < len(new) and end - start < ENCODE_WORDS and len(raw[end]) <= LONG and size <= 8 * ENCODE_WORDS:
                size += len(raw[end])
                end += 1
            ids += self._contract(raw[start:end]) if end > start else [self._contract_long(raw[start])]
        self.words.update(zip(new, zip(ids, self.decode(ids), strict=True), strict=True))

    def encode(self, texts: list[str]) -> list[list[tuple[bytes, bytes]]]:
        """Each text's pre-tokens in order, as their ids and the bytes that these decode to; joined, they are the text's."""
        if len(self.words) > WORDS_HELD:
            self.former, self.words = self.words, {}
        found = [self._pre_tokens(t) for t in texts]
        new = set().union(*found) - self.words.keys()
        known = new & self.former.keys()
        self.words.update((w, self.former[w]) for w in known)
        if new := new - known:
            self._learn(new)
        return [list(map(self.words.__getitem__, ws)) for ws in found]

    def _pre_tokens(self, text: str) -> list[str]:
        if len(text) <= PIECE:
            return self.pattern.findall(text)
        # White space after anything else begins a pre-token, whatever stands before.
        found, start = [], 0
        while start < len(text):
            cut = _CUT.search(text, start + PIECE)
            end = cut.start() if cut else len(text)
            found += self.pattern.findall(text[start:end])
            start = end
        return found

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each row of ids: all ids in order are decoded in blocks and cut by the tokens' lengths."""
        ids = np.frombuffer(b"".join(encoded), "<u4")
        text = b"".join([self._decoded(ids[k : k + DECODE_ROWS]) for k in range(0, len(ids), DECODE_ROWS)])
        upto = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        ends = upto[np.cumsum([len(raw) // 4 for raw in encoded], dtype=np.int64)].tolist()
        return [text[start:end] for start, end in zip([0, *ends], ends, strict=False)]

    def _decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of a block of ids, by one ordered aggregation."""
        self.db.register("ids", pa.table({"pos": np.arange(len(ids), dtype=np.int32), "token": ids.astype(np.int32)}))
        found = self.db.execute("SELECT string_agg(hex, '' ORDER BY pos) FROM ids JOIN vocabulary USING (token)").fetchall()
        self.db.unregister("ids")
        return bytes.fromhex(found[0][0])


_ENCODERS: dict[str, DuckBpe] = {}
KEPT["bpe"] = _ENCODERS.clear


def worker_bpe(file: bytes, pattern: str) -> DuckBpe:
    """The encoder of this worker process; it outlives a task, with its caches, until the worker is given to another operator."""
    key = hashlib.sha256(file + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line.strip())}
        _ENCODERS[key] = DuckBpe(ranks, pattern)
    return _ENCODERS[key]


def byte_bpe(docs: DataFrame, path: str, pattern: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep`, then ids (array<int>) and decoded (binary) of every whole text.

    The vocabulary file is read on the driver and broadcast; its size is that of the tokenizer (about
    1 MB) and does not depend on the documents.
    """

    def columns(ids: list[bytes], decoded: list[bytes]) -> list[pa.Array]:
        ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))), pa.array(decoded, pa.binary())]

    return _mapped(docs, path, pattern, keep, text, {"ids": "array<int>", "decoded": "binary"}, columns)


def byte_bpe_digests(docs: DataFrame, path: str, pattern: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep`, then n_tokens, ids_sha256 and decoded_sha256, digested where the ids are made."""

    def columns(ids: list[bytes], decoded: list[bytes]) -> list[pa.Array]:
        return [pa.array([len(i) // 4 for i in ids], pa.int64()), *(pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string()) for rows in (ids, decoded))]

    return _mapped(docs, path, pattern, keep, text, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, columns)


def _mapped(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...], text: str, kinds: dict[str, str], columns) -> DataFrame:
    with open(path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [docs.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {t}" for n, t in kinds.items()])
    names = [f.name for f in kept] + list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(file.value, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in blocks(texts, 2_000_000):
                made = columns(*zip(*((b"".join([p[0] for p in row]), b"".join([p[1] for p in row])) for row in bpe.encode(texts[a:b])), strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), *made], names)
                del made
                trim()

    return map_arrow(docs.select(*keep, docs[text].alias("__text")), run, schema, keeps="bpe")
