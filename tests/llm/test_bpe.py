import hashlib
import random

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from strandlake.llm import bpe, queries
from strandlake.llm.common import map_arrow

PATH = public.path("byte_bpe_50k.tiktoken")
HARD = ["a" * 300, "ab" * 200 + " \u2003\u3000 <|endoftext|>é\U0001f600", "\n\n x  y\t\tz \x85\xa0 q", "I'll don't 123 !!??", " " * 40 + "x", "\x1c\x1d a\x1e"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_query_equals_the_library_and_round_trips(spark, docs, rows, library, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    made = sorted(str(tuple(r)) for r in queries.op8_byte_bpe(spark, "").collect())
    want = []
    for i, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append(str((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())))
    assert made == sorted(want)


def joined(rows):
    return [tuple(b"".join(p[k] for p in row) for k in (0, 1)) for row in rows]


def test_hard_texts_and_small_blocks(library, monkeypatch):
    monkeypatch.setattr(bpe, "DECODE_ROWS", 7)
    monkeypatch.setattr(bpe, "WORDS_HELD", 3)
    monkeypatch.setattr(bpe, "PIECE", 5)
    made = bpe.DuckBpe(bpe.read_ranks(PATH), public.PATTERN)
    for _ in range(3):
        found = joined(made.encode(HARD))
        assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in found] == [library.encode_ordinary(t) for t in HARD]
        assert [text for _, text in found] == [t.encode() for t in HARD]
        assert made.decode([ids for ids, _ in found]) == [t.encode() for t in HARD]


@pytest.mark.parametrize("letters", ["a", "ab", "é", "thein", "etaoinshrdlu", "-=", "\n", "abcdefghijklmnopqrstuvwxyzABC"])
def test_long_pre_tokens_are_those_of_the_library(library, letters):
    made = bpe.DuckBpe(bpe.read_ranks(PATH), public.PATTERN)
    rng = random.Random(len(letters))
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in (190, 193, 700, 3000)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in joined(made.encode(words))] == [library.encode_ordinary(w) for w in words]


def test_a_very_long_pre_token_round_trips():
    made = bpe.DuckBpe(bpe.read_ranks(PATH), public.PATTERN)
    word = "".join(random.Random(5).choice("etaoinshrdlu") for _ in range(200_000))
    (ids, text), = joined(made.encode([word]))
    assert text.decode() == word and len(ids) < 4 * 120_000


def test_ids_and_empty(docs, empty):
    out = {str(r["doc_id"]): r for r in bpe.byte_bpe(docs, PATH, public.PATTERN).collect()}
    assert out["5000"]["ids"] == [] and bytes(out["5005"]["decoded"]).decode() == "é ü \U0001f600 ñ"
    assert bpe.byte_bpe(empty, PATH, public.PATTERN).count() == 0


def test_a_worker_lets_go_of_the_encoder_for_another_operator(spark):
    frame = spark.range(8).select("id", F.lit("some words").alias("text")).repartition(4)
    bpe.byte_bpe(frame, PATH, public.PATTERN, keep=("id",)).collect()

    def encoders(batches):
        from strandlake.llm import bpe

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe._ENCODERS)] * batch.num_rows)], ["n"])

    assert {r["n"] for r in map_arrow(frame, encoders, "n bigint").collect()} == {0}
