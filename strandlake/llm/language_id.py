"""Language identification by string kernels: Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the cosine of their sets of character n-grams of 1 to 4 letters (blended
spectrum, presence only). n-grams are hashed to FEATURES places. Landmarks are drawn from a bounded
sample of labelled rows; the Nystroem map of their kernel matrix turns one-versus-rest kernel ridge
regression into a small linear system, solved on the driver. Texts are scored in batches by matrix
products; since the kernel is linear in the sets, landmarks and coefficients are multiplied once.

The sample holds about SAMPLE rows (an equal share of each language, chosen by a hash of the id), as bits of
their features: FEATURES / 8 bytes a row, so about 10 MB. Where there are more than SAMPLE // LEAST values of
the language, the most frequent ones are learnt. Everything else covers all rows and whole texts.

Defined results: a null text and a text without a letter are "und" with score 0; so is every text if
there is no labelled row to learn from; repeated rows give repeated results; ties go to the first
language in order; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, map_arrow

#: Hashed n-gram places, the longest n-gram, rows of the sample, landmarks, ridge.
FEATURES, LONGEST, SAMPLE, LANDMARKS, RIDGE = 32_768, 4, 2_400, 256, 1e-2
#: Texts scored by one product; rows of the sample that are unpacked together; rows of a language in a sample, at least.
ROWS, FITTED, LEAST = 64, 256, 8
_SHIFT = np.uint32(32 - FEATURES.bit_length() + 1)


@cache
def letters() -> np.ndarray:
    """For each code point: itself lower-cased if it is a letter, else the blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def mark(text: str, row: np.ndarray) -> bool:
    """Set the places of the n-grams of a text; False if it has no letter."""
    points = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (points != 32).any():
        return False
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)]))
    rolled = points * np.uint32(0x9E3779B1)
    for n in range(1, LONGEST + 1):
        if n > 1:
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[n - 1 :] * np.uint32(0xC2B2AE3D)
        row[(rolled ^ np.uint32(n * 0x27D4EB2F)) * np.uint32(0x9E3779B1) >> _SHIFT] = 1
    return True


@dataclass(frozen=True)
class KernelModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # FEATURES x languages

    def score(self, marks: np.ndarray) -> np.ndarray:
        """One-versus-rest values of rows of marks, one column a language."""
        return (marks @ self.weights) / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for start in range(0, len(texts), ROWS):
            part = texts[start : start + ROWS]
            marks = np.zeros((len(part), FEATURES), np.float32)
            known = [bool(t) and mark(t, marks[i]) for i, t in enumerate(part)]
            if not self.languages:
                known = [False] * len(part)
                values = np.zeros((len(part), 1))
            else:
                values = self.score(marks)
            best = values.argmax(1)
            langs += [self.languages[best[i]] if k else "und" for i, k in enumerate(known)]
            scores += [float(min(1.0, max(0.0, values[i, best[i]]))) if k else 0.0 for i, k in enumerate(known)]
        return langs, scores


def _marks(bits: list[bytes]) -> np.ndarray:
    """Rows of normalised marks of some sample rows."""
    marks = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)
    return marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))


def fit(bits: list[bytes], labels: list[str]) -> KernelModel:
    """Kernel ridge regression over Nystroem features of the sample, whose rows are unpacked FITTED at a time."""
    if not bits:
        return KernelModel((), np.zeros((FEATURES, 0), np.float32))
    languages = tuple(sorted(set(labels)))
    turns = np.random.default_rng(7).permutation(len(bits))
    landmarks = _marks([bits[k] for k in np.sort(turns[:LANDMARKS])])
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = np.concatenate([_marks(bits[k : k + FITTED]) @ landmarks.T for k in range(0, len(bits), FITTED)]) @ root
    target = (np.array(labels)[:, None] == np.array(languages)[None, :]).astype(np.float64)
    solved = np.linalg.solve(mapped.T @ mapped + RIDGE * len(bits) / 100 * np.eye(mapped.shape[1]), mapped.T @ target)
    return KernelModel(languages, (landmarks.T @ (root @ solved)).astype(np.float32))


def learn(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> KernelModel:
    """Fit on a bounded sample of rows whose language is known: an equal share of each of the sample // LEAST most frequent languages."""
    rows = labelled.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull())
    counts = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "l").limit(sample // LEAST).collect()
    if not counts:
        return fit([], [])
    chances = rows.sparkSession.createDataFrame([(r["l"], sample / len(counts) / r["n"]) for r in counts], "l string, chance double")
    turn = (F.pmod(F.xxhash64(F.coalesce("k", F.lit("")), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double")
    chosen = rows.join(F.broadcast(chances), "l").where(turn < F.col("chance"))  # a row a language: sample // LEAST at most

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                row = np.zeros(FEATURES, np.uint8)
                out.append(np.packbits(row).tobytes() if mark(t, row) else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["bits", "l"])

    made = map_arrow(chosen.select("t", "l"), bits, "bits binary, l string").where("bits is not null").collect()
    made = sorted((bytes(r["bits"]), r["l"]) for r in made)
    return fit([b for b, _ in made], [l for _, l in made])


def held_out(key: Column) -> Column:
    """The rows that no model learns from: a third of the ids by their CRC-32."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame, model: KernelModel, *, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of docs, and the predicted language and its score; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages floats, whatever the documents
    at = docs.columns.index(text)
    names = [*docs.columns, lang_out, score_out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in blocks([t or "" for t in texts]):
                langs, scores = shared.value.predict(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    if {lang_out, score_out} & set(docs.columns):
        raise ValueError(f"{lang_out} and {score_out} must not be columns of the input")
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    return map_arrow(docs, run, schema)
