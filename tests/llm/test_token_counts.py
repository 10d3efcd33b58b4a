import random

import numpy as np
import public_tokenizers as public
import pytest
import regex
from tokenizers import Tokenizer

from strandlake.llm import queries, token_counts

PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as f:
        return token_counts.TokenCounter(f.read())


def test_query_equals_the_library(spark, docs, rows, library, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    made = sorted(str(tuple(r)) for r in queries.op10_token_counts(spark, "").collect())
    counts = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    assert made == sorted(str((i, len((t or "").encode()), n, n > 512)) for (i, t, _), n in zip(rows, counts, strict=True))


@pytest.mark.parametrize("chunk", [1, 2, 5, 64, 4_096])
def test_chunk_maps_compose_over_texts_of_a_block(counter, library, chunk, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    rng = random.Random(chunk)
    alphabet = ["a", "th", "e", " ", "  ", "\n", "é", "1", "'s", "'re", "'", "'l", "l", "!?", "\xa0", "\x00", "\u0303", "<|endoftext|>", "\U0001f600", "zzz"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(200)]
    assert counter.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_begins_are_those_of_the_pattern():
    pattern, rng = regex.compile(token_counts.BYTE_LEVEL_PATTERN), random.Random(4)
    alphabet = ["a", "s", "t", "re", "v", "e", "l", "'", " ", "\n", "\t", "7", "²", "?", "\x1c", "\u3000", "ß"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(20)))
        points = np.frombuffer((text + "\x00").encode("utf-32-le"), np.uint32)
        found = token_counts.begins(token_counts.symbols(points, np.arange(len(points)) == len(text)), rng.choice([1, 3, 8])).tolist()
        assert [text[a:b] for a, b in zip(found, [*found[1:], len(text)], strict=False)] == pattern.findall(text), repr(text)


def test_words_of_all_shapes_and_a_small_table(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES_HELD", 50)
    monkeypatch.setattr(token_counts, "FITS_HELD", 20)
    monkeypatch.setattr(token_counts, "WORDS_HELD", 5)
    monkeypatch.setattr(token_counts, "CUT_OUT", 3)
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("abcdeilnorst ") for _ in range(rng.randrange(1, 40)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_a_very_long_text_and_a_very_long_word(counter, library):
    rng = random.Random(2)
    texts = ["".join(rng.choice("etaoin shrdlu") for _ in range(300_000)), "a" * 50_000, ""]
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_empty(empty):
    assert token_counts.token_counts(empty, PATH).count() == 0
