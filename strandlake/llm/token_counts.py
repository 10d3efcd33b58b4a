"""Token counts by a finite-state tokenizer: transducers with counts, chunk state maps and a prefix scan.

Two deterministic machines count the tokens of a byte-level BPE without making them.

1. The chunk machine cuts texts into pre-tokens. Its symbols are kinds of characters (with what must be
   known of the next two), its STATES say what kind of pre-token is open, and a transition tells whether
   a pre-token begins. The texts of a block are one tape, on which each text and each added token ends in
   the symbol that leads every state to the first. The tape is dealt into chunks of CHUNK characters,
   whatever the lengths of the texts; for each chunk the map of all STATES entry states to exit states
   is computed, all chunks side by side; the maps are composed by a parallel prefix scan (in each round
   a map is composed with the one 1, 2, 4, ... chunks before it), which gives each chunk its entry
   state; then the begins are written, again all chunks side by side.
2. The word transducer reads the bytes of a pre-token; a transition carries the change of the token
   count. The tokens of each prefix of a word are those of a shorter prefix and one more token, so a
   state holds, for each place where a token that may still grow began, its node in the trie of the
   vocabulary, the last token before the place and the count up to there, relative to the count so far.
   Transitions are compiled when first reached and kept, at most STATES_HELD states of them; after that
   the table starts anew. Sums of counted words between two places of the tape are differences of one
   prefix sum.

Special strings of the tokenizer's file (added tokens) count as one token each, as its library does by
default. Defined results: a null text counts as the empty text with 0 bytes and 0 tokens; repeated rows
give repeated results; a null id is kept; other columns are not read; a very long text takes the same
way as any other and is a block of its own. No shuffle; memory is bounded by the block (about 2 million
characters, or the longest text), by the two tables and by twice WORDS_HELD counted words.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import blocks, map_arrow

#: Kept states of the word transducer, kept checks of neighbouring tokens, and counted words of a worker.
STATES_HELD, FITS_HELD, WORDS_HELD = 150_000, 600_000, 250_000
#: Characters of a chunk of the tape, and words that are cut out at a time.
CHUNK, CUT_OUT = 128, 200_000

#: The pattern of the byte-level pre-tokenizer of the public GPT-2 format, which the chunk machine follows.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Symbols: the end of a text; a blank before a word; other white space before a word; white space before
# white space or the end; an apostrophe; another sign; a number; a letter; a letter that is a short ending
# by itself (s, t, m, d); a letter that begins an ending of two (re, ve, ll).
END, BLANK, LAST, SPACE, QUOTE, SIGN, NUMBER, LETTER, SHORT, PAIR = range(10)
# States: nothing open; letters, numbers, signs, white space; a blank that joins what follows; an apostrophe
# that begins a pre-token; the first letter of an ending of two; a closed ending.
FRESH, IN_LETTERS, IN_NUMBERS, IN_SIGNS, IN_SPACE, JOINED, QUOTED, HALF, CLOSED = range(9)
STATES = 9


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Exit state and begin flag of each symbol and state (index symbol * STATES + state)."""
    exits, begins = np.zeros((10, STATES), np.uint8), np.ones((10, STATES), np.uint8)
    begins[END] = 0
    exits[BLANK], exits[LAST], exits[SPACE] = JOINED, FRESH, IN_SPACE
    begins[SPACE, IN_SPACE] = 0
    for symbol, state in ((SIGN, IN_SIGNS), (NUMBER, IN_NUMBERS), (LETTER, IN_LETTERS), (SHORT, IN_LETTERS), (PAIR, IN_LETTERS)):
        exits[symbol] = state
        begins[symbol, [state, JOINED]] = 0
    exits[QUOTE] = QUOTED
    exits[QUOTE, [IN_SIGNS, JOINED, QUOTED]] = IN_SIGNS
    begins[QUOTE, [IN_SIGNS, JOINED, QUOTED]] = 0
    begins[SIGN, QUOTED] = 0
    exits[SHORT, QUOTED], exits[PAIR, QUOTED] = CLOSED, HALF
    begins[[SHORT, PAIR], QUOTED] = 0
    for symbol in (LETTER, SHORT, PAIR):
        exits[symbol, HALF], begins[symbol, HALF] = CLOSED, 0
    return exits.ravel(), begins.ravel()


_EXITS, _BEGINS = _machine()


@cache
def kinds() -> np.ndarray:
    """The kind of each code point: SIGN, NUMBER, LETTER or SPACE."""
    out = np.full(0x110000, SIGN, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((NUMBER, r"\p{N}"), (LETTER, r"\p{L}"), (SPACE, r"\s")):
        out[[ord(c) for c in regex.findall(pattern, points)]] = kind
    return out


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbols of a tape of code points; `ends` marks the places that end a text."""
    out = kinds()[points]
    out[ends] = END
    following, after = np.append(out[1:], np.uint8(END)), np.append(points[1:], np.uint32(0))
    word_next = (following != SPACE) & (following != END)
    space = out == SPACE
    out[space & word_next] = LAST
    out[(points == ord(" ")) & space & word_next] = BLANK
    out[(points == ord("'")) & (out == SIGN)] = QUOTE
    letter_next = following == LETTER
    pair = ((points == ord("r")) | (points == ord("v"))) & (after == ord("e")) | (points == ord("l")) & (after == ord("l"))
    letter = out == LETTER
    for c in "stmd":
        out[letter & (points == ord(c))] = SHORT
    out[letter & pair & letter_next] = PAIR
    return out


def chunk_maps(tape: np.ndarray) -> np.ndarray:
    """The map of every chunk (a column of `tape`, which holds STATES times the symbol) from entry to exit states."""
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (tape.shape[1], 1))
    for row in tape:
        maps = _EXITS[row[:, None] + maps]
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Each map composed with all before it, in a logarithmic number of rounds."""
    step = 1
    while step < len(maps):
        maps = np.concatenate((maps[:step], np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)))
        step *= 2
    return maps


def begins(tape: np.ndarray, chunk: int) -> np.ndarray:
    """The places of a tape of symbols where a pre-token begins."""
    size = len(tape)
    padded = np.zeros(-(-size // chunk) * chunk, np.uint8)
    padded[:size] = tape
    columns = np.ascontiguousarray((padded * np.uint8(STATES)).reshape(-1, chunk).T)
    state = np.concatenate((np.zeros(1, np.uint8), prefix_scan(chunk_maps(columns))[:-1, FRESH]))
    found = np.empty(columns.shape, np.uint8)
    for j, row in enumerate(columns):
        at = row + state
        found[j], state = _BEGINS[at], _EXITS[at]
    return np.flatnonzero(found.T.ravel()[:size])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class WordTransducer:
    """A deterministic transducer over bytes whose transitions carry changes of the token count."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        number = {t: k for k, t in enumerate(vocabulary)}
        self.shift = len(number).bit_length()
        #: Rank of a pair of tokens; rank, left and right part of a merged token.
        self.rank = {number[a] << self.shift | number[b]: k for k, (a, b) in enumerate(merges)}
        self.made, self.left, self.right = [-1] * len(number), [0] * len(number), [0] * len(number)
        for k, (a, b) in enumerate(merges):
            if self.made[t := number[a + b]] < 0:
                self.made[t], self.left[t], self.right[t] = k, number[a], number[b]
        #: The trie of the vocabulary: a node's child by node and byte, its token, and whether it has children.
        self.trie: dict[int, int] = {}
        self.token, self.grows = [-1], [True]
        for word, k in number.items():
            node = 0
            for byte in word:
                child = self.trie.get(node << 8 | byte)
                if child is None:
                    child = self.trie[node << 8 | byte] = len(self.token)
                    self.token.append(-1), self.grows.append(False)
                    self.grows[node] = True
                node = child
            self.token[node] = k
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple[tuple[int, int, int], ...], int] = {}
        self.states: list[tuple[tuple[int, int, int], ...]] = []
        self.next: dict[int, tuple[int, int]] = {}
        self.start = self._state(((0, -1, 0),))

    def _state(self, key: tuple[tuple[int, int, int], ...]) -> int:
        if (k := self.number.get(key)) is None:
            k = self.number[key] = len(self.states)
            self.states.append(key)
        return k

    def follows(self, a: int, b: int) -> bool:
        """Whether token b can stand right after token a: every merge across their border comes too late.

        The merges are undone from the latest on, on the sides that touch; a pair across the border
        that ranks before the merge just undone would have been joined first.
        """
        limit = len(self.rank)
        while self.rank.get(a << self.shift | b, limit) >= limit:
            made_a, made_b = self.made[a], self.made[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                limit, a = made_a, self.right[a]
            else:
                limit, b = made_b + 1, self.left[b]
        return False

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the change of the count, compiled when first asked for."""
        kept, token, change = [], -1, 0
        for node, before, count in self.states[state]:
            child = self.trie.get(node << 8 | byte)
            if child is None:
                continue
            if token < 0 and (ends := self.token[child]) >= 0:
                if before >= 0:
                    pair = before << self.shift | ends
                    if (fits := self.fits.get(pair)) is None:
                        fits = self.fits[pair] = self.follows(before, ends)
                else:
                    fits = True
                if fits:
                    token, change = ends, count + 1
            if self.grows[child]:
                kept.append((child, before, count))
        moved = self._state((*[(n, t, c - change) for n, t, c in kept], (0, token, 0))), change
        self.next[state << 8 | byte] = moved
        return moved

    def count(self, word: bytes) -> int:
        if len(self.states) > STATES_HELD:
            self.reset()
        if len(self.fits) > FITS_HELD:
            self.fits.clear()
        state, total, known = self.start, 0, self.next.get
        for byte in word:
            state, change = known(state << 8 | byte) or self.step(state, byte)
            total += change
        return total


class TokenCounter:
    """Counts of whole texts by the two machines, over a worker's table of counted words."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        added = {t["content"] for t in spec["added_tokens"]}
        vocabulary = {raw(t): k for t, k in spec["model"]["vocab"].items() if t not in added}
        self.transducer = WordTransducer(vocabulary, [(raw(a), raw(b)) for a, b in pairs])
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added = sorted(added)
        #: Counts of words: met lately, and before.
        self.words: dict[str, int] = {}
        self.former: dict[str, int] = {}

    def _word(self, word: str) -> int:
        n = self.former.get(word)
        if n is None:
            n = self.transducer.count(word.encode())
        self.words[word] = n
        return n

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        tape = "\x00".join([*texts, ""])
        points = np.frombuffer(tape.encode("utf-32-le"), np.uint32)
        borders = np.cumsum([len(t) + 1 for t in texts]) - 1
        ends = np.zeros(len(points), bool)
        ends[borders] = True
        specials = [m.span() for m in self.special.finditer(tape)] if any(t in tape for t in self.added) else []
        for start, end in specials:
            ends[start:end] = True
        found = begins(symbols(points, ends), CHUNK)
        # A word goes on to the next begin, or to the end of its text or an added token.
        stops = np.flatnonzero(ends)
        until = np.minimum(np.append(found[1:], len(points)), stops[np.searchsorted(stops, found)]) if len(found) else found
        totals = np.zeros(len(found) + 1, np.int64)
        for k in range(0, len(found), CUT_OUT):
            if len(self.words) > WORDS_HELD:
                self.former, self.words = self.words, {}
            cut = [tape[a:b] for a, b in zip(found[k : k + CUT_OUT].tolist(), until[k : k + CUT_OUT].tolist(), strict=True)]
            known, word = self.words.get, self._word
            totals[k + 1 : k + 1 + len(cut)] = [n if (n := known(w)) is not None else word(w) for w in cut]
        totals = np.cumsum(totals)
        upto = np.searchsorted(found, borders)
        per_text = totals[upto] - totals[np.append(0, upto[:-1])]
        if specials:
            per_text = per_text + np.bincount(np.searchsorted(borders, [start for start, _ in specials]), minlength=len(texts))
        return per_text.tolist()

    def count(self, text: str) -> int:
        return self.counts([text])[0]


_COUNTERS: dict[str, TokenCounter] = {}


def worker_counter(file: bytes) -> TokenCounter:
    key = hashlib.sha256(file).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(file)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, path: str, *, limit: int = 512, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep`, then n_bytes, n_tokens and over_limit of every whole text.

    The tokenizer's file is read on the driver and broadcast: a few MB, whatever the documents.
    """
    with open(path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [docs.schema[c] for c in keep]
    names = [f.name for f in kept] + ["n_bytes", "n_tokens", "over_limit"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_bytes bigint", "n_tokens bigint", "over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(file.value)
        for batch in batches:
            column = pc.fill_null(batch.column(batch.num_columns - 1), "")
            texts = column.to_pylist()
            counts = pa.array([n for a, b in blocks(texts, 2_000_000) for n in counter.counts(texts[a:b])], pa.int64())
            sizes = pc.binary_length(column).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), sizes, counts, pc.greater(counts, limit)], names)

    return map_arrow(docs.select(*keep, docs[text].alias("__text")), run, schema)
