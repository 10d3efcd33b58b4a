"""Shared counts of many databases: products of blocks of databases, so that no pair is shuffled.

Databases are numbered in order and dealt to blocks of BLOCK at most. A value's databases are cut at the bounds of blocks once;
the pieces of some values (a chunk) that lie in one block are a row, and all rows of a block are a partition. Each pair of
partitions is a task, which reads both again and adds up a matrix of BLOCK x BLOCK counts for each kind: large pieces by
products of 0/1 matrices, small ones place by place. So what is written follows the values, and only reading the number of
blocks. A pair of databases has all its counts in one task and is returned once; memory is that of these matrices and of a
partition of about HELD numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, checkpointed, ship

#: Databases of a block at most, and blocks of fewer databases; values of one product of matrices; places of a piece pair from which on it goes to the product.
BLOCK, BLOCKS, VALUES, DENSE = 2048, 12, 256, 16_384
#: Places that are made together; numbers in the values of a chunk; rows of a batch of results.
TOGETHER, CHUNK, ROWS = 1 << 20, 1 << 21, 1 << 17
#: Numbers in the values of a partition, about (fewer databases a block otherwise).
HELD = 1 << 23
_PIECES = "kind string, i int, chunk bigint, at binary, n binary, sizes binary, places binary"


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes: the run of each element, and the element's place in its run."""
    runs = np.repeat(np.arange(len(sizes)), sizes)
    return runs, np.arange(len(runs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _slices(costs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose costs sum up to about `most`; a larger row is a range of its own."""
    upto, start = np.cumsum(costs), 0
    while start < len(costs):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of kind, n, d in batches of one kind and about CHUNK numbers; a larger set is a batch of its own."""
    held, size = [], 0

    def cut() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        for kind in rows.column(0).unique().to_pylist():
            own = rows.filter(pc.is_null(rows.column(0)) if kind is None else pc.equal(rows.column(0), kind)).combine_chunks()
            for x, y in _slices(pc.list_value_length(own.column(2)).to_numpy(), CHUNK):
                yield from own.slice(x, y - x).to_batches()

    for batch in batches:
        held.append(batch)
        if (size := size + len(batch.column(2).flatten())) >= CHUNK:
            yield from cut()
            held, size = [], 0
    if size:
        yield from cut()


def _pieces(batch: pa.RecordBatch, chunk: int, block: int) -> Iterator[pa.RecordBatch]:
    """A row for each block that a chunk's sets have databases in: numbers in the chunk and n of those sets, sizes and places of their pieces."""
    n, sets = batch.column(1).to_numpy(), batch.column(2)
    values = sets.flatten().to_numpy()
    owner, _ = _spread(sets.value_lengths().to_numpy(zero_copy_only=False))
    order = np.argsort(values // block, kind="stable")
    values, owner = values[order], owner[order].astype(np.int32)
    at = values // block
    bounds = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        starts = np.flatnonzero(np.concatenate(([True], owner[x + 1 : y] != owner[x : y - 1])))
        own, i = owner[x:y][starts], int(at[x])
        numbers = (own, n[own], np.diff(np.append(starts, y - x)).astype(np.int16), (values[x:y] % block).astype(np.int16))
        columns = [batch.column(0)[:1], pa.array([i], pa.int32()), pa.array([chunk], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in numbers)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PIECES.split(", ")])


def _dense(values: np.ndarray, sizes: np.ndarray, block: int, kind: type) -> np.ndarray:
    out = np.zeros((len(sizes), block), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), values] = 1
    return out


def _add(counts: np.ndarray, n: np.ndarray, a: pa.ListArray, b: pa.ListArray) -> None:
    """Add the products of some pairs of pieces to a block's counts."""
    block = len(counts)
    size = lambda c: c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = size(a) * size(b)
    for places, product in ((np.flatnonzero(rows >= DENSE), True), (np.flatnonzero(rows < DENSE), False)):
        for x, y in _slices(np.full(len(places), TOGETHER // VALUES) if product else rows[places], TOGETHER):
            at = pa.array(places[x:y])
            p, q, w = a.take(at), b.take(at), n[places[x:y]]
            ps, qs, pv, qv = size(p), size(q), p.flatten().to_numpy(), q.flatten().to_numpy()
            if product:
                exact = np.float32 if w.sum() < 1 << 24 else np.float64
                counts += ((_dense(pv, ps, block, exact) * w[:, None].astype(exact)).T @ _dense(qv, qs, block, exact)).astype(np.int64)
            else:
                row, k = _spread(ps * qs)
                low = pv[(np.cumsum(ps) - ps)[row] + k // qs[row]].astype(np.int64)
                np.add.at(counts.reshape(-1), low * block + qv[(np.cumsum(qs) - qs)[row] + k % qs[row]], w[row])


def _lists(sizes: bytes, places: bytes) -> pa.ListArray:
    ends = np.cumsum(np.frombuffer(sizes, np.int16), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(places, np.int16)))


def _meet(counts: np.ndarray, low: tuple[bytes, ...], high: tuple[bytes, ...]) -> None:
    """Add the products of two blocks' pieces of one chunk; each side has at, n, sizes, places."""
    a, b = np.frombuffer(low[0], np.int32), np.frombuffer(high[0], np.int32)  # in order
    spot = np.full(max(a[-1], b[-1]) + 1, -1, np.int32)
    spot[b] = np.arange(len(b))
    found = np.flatnonzero(spot[a] >= 0)
    if len(found):
        _add(counts, np.frombuffer(low[1], np.int64)[found], _lists(*low[2:]).take(pa.array(found)), _lists(*high[2:]).take(pa.array(spot[a[found]])))


def shared_pairs(sets: DataFrame, ids: pa.Array, name: str) -> DataFrame:
    """kind, low, high, `name`: of each pair of databases the sum of n over the sets that hold both.

    `sets` has kind, n and d, a sorted array of numbers of databases; `ids` has the databases' ids in this order.
    """
    spark = sets.sparkSession
    # Written once: chunks that are made again are the same, since the rows and their order are.
    sets = checkpointed(sets.select("kind", "n", "d"))
    numbers = sets.agg(F.sum(F.size("d"))).collect()[0][0] or 0
    block = min(BLOCK, -(-len(ids) // max(BLOCKS, numbers // HELD)))  # places in a block are 16-bit numbers
    ship(spark)
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(ids)  # an id a database

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(_chunks(batches)):
            yield from _pieces(batch, first + k, block)

    def result(kind: str, i: int, j: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if i == j:
            counts = np.triu(counts, 1)
        for top in range(0, block, step := max(1, ROWS // block)):
            low, high = np.nonzero(part := counts[top : top + step])
            if len(low):
                names = [shared.value.take(pa.array(p)) for p in (low + (top + i * block), high + j * block)]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(kind, pa.string()), len(low)), *names, pa.array(part[low, high])], ["kind", "low", "high", name])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}  # a task has one pair of blocks
        for batch in batches:
            for kind, i, j, *sides in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind not in held:
                    held[kind] = np.zeros((block, block), np.int64)
                _meet(held[kind], sides[:4], sides[4:])
        while held:
            kind, counts = held.popitem()
            yield from result(kind, i, j, counts)

    pieces = sets.coalesce(max(1, numbers // CHUNK)).mapInArrow(packed, _PIECES).repartitionById(-(-len(ids) // block), F.col("i"))
    low, high = (pieces.select([F.col(c).alias(f"{c}{s}") for c in ("kind", "i", "chunk", "at", "n", "sizes", "places")]) for s in (1, 2))
    # The hint has each pair of partitions read by a task; a join by chunk would send each row to all blocks.
    pairs = low.join(high.hint("shuffle_replicate_nl"), (F.col("chunk1") == F.col("chunk2")) & (F.col("i1") <= F.col("i2")))
    kind = pa_type(ids)
    return pairs.select("kind1", "i1", "i2", "at1", "n1", "sizes1", "places1", "at2", "n2", "sizes2", "places2").mapInArrow(added, f"kind string, low {kind}, high {kind}, `{name}` bigint")


def pa_type(ids: pa.Array) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(ids.type).simpleString()
