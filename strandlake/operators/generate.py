"""Decoys and entrapment: reversed, shuffled, digestion-aware and foreign sequences.

Random arrangements are seeded by the seed and the sequence they belong to, so they do not depend on
partitions or order and any task can make them again. `parity` modes draw from one generator in file
order, which needs a single task, and are for small databases only.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice
from math import factorial, prod

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from ..functions.sequences import Digestion, composition, digest, reverse_and_switch, segments
from ..session import checkpointed, ship
from .peptides import digested

#: Tries of a peptide (of each copy of it), and arrangements that all are given before the unresolved get all tries.
TRIES, FIRST = 100, 20
#: Rows of a batch of arrangements.
ROWS = 20_000
PRECEDING, FOLLOWING = "AK", "AK"


def reverse_decoys(rows: DataFrame, prefix: str = "REV_") -> DataFrame:
    """raw_header and sequence of reversed decoys."""
    return rows.withColumns({"raw_header": F.concat(F.lit(prefix), "raw_header"), "sequence": F.reverse("sequence")})


def shuffle_decoys(rows: DataFrame, seed: int, prefix: str = "REV_", *, parity_order: list[str] | None = None) -> DataFrame:
    """Whole sequences shuffled. With `parity_order`, one generator runs through all rows in that order, in one task."""
    ship(rows.sparkSession)
    headed = rows.withColumn("raw_header", F.concat(F.lit(prefix), "raw_header"))
    if parity_order is None:

        @arrow_udf("string")
        def shuffled(ids: pa.Array, sequences: pa.Array) -> pa.Array:
            out = []
            for i, s in zip(ids.to_pylist(), sequences.to_pylist(), strict=True):
                residues = list(s or "")
                random.Random(f"{seed}\0{i}\0{s}").shuffle(residues)
                out.append("".join(residues))
            return pa.array(out, pa.string())

        return headed.withColumn("sequence", shuffled(F.col("raw_header"), F.col("sequence")))
    at = headed.columns.index("sequence")

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = random.Random(seed)
        for batch in batches:
            out = []
            for s in batch.column(at).to_pylist():
                residues = list(s)
                draw.shuffle(residues)
                out.append("".join(residues))
            yield batch.set_column(at, "sequence", pa.array(out, pa.string()))

    return headed.repartition(1).sortWithinPartitions(*parity_order).mapInArrow(in_order, headed.schema)


def orders(letters: str) -> int:
    """How many different orders some letters have."""
    return factorial(len(letters)) // prod(factorial(n) for n in Counter(letters).values())


def ordered_by_rank(letters: str, rank: int, total: int | None = None) -> str:
    """The order of some letters that has `rank` different orders before it by the alphabet; `total` is how many orders there are."""
    left, total, made = sorted(letters), total or orders(letters), []
    for size in range(len(left), 0, -1):
        # Of all orders of what is left, total * n / size begin with a letter that is left n times.
        letter = left[rank * size // total]
        at = left.index(letter)
        rank -= total * at // size
        total = total * left.count(letter) // size
        made.append(left.pop(at))
    return "".join(made)


def rank_of(order: str, total: int | None = None) -> int:
    """How many different orders of the same letters come before this one by the alphabet."""
    left, total, rank = sorted(order), total or orders(order), 0
    for size, letter in zip(range(len(left), 0, -1), order):
        at = left.index(letter)
        rank += total * at // size
        total = total * left.count(letter) // size
        left.pop(at)
    return rank


def _core(peptide: str, fix_first: bool, fix_last: bool) -> tuple[int, int]:
    """Where the part of a peptide that may be rearranged begins and ends."""
    return int(fix_first), max(int(fix_first), len(peptide) - int(fix_last))


def drawn_ranks(peptide: str, count: int, seed: int, n: int) -> Iterator[int]:
    """Ranks of orders in the order in which a peptide draws them, one of n orders at most once; its own may be among them."""
    rng = random.Random(f"{seed}\0{peptide}")
    if n <= 4 * count:
        yield from rng.sample(range(n), n)
        return
    met = set()
    for _ in range(2 * count + 8):  # of so many orders two draws seldom meet
        rank = rng.randrange(n)
        if rank not in met:
            met.add(rank)
            yield rank


def drawn_orders(peptide: str, count: int, seed: int, *, fix_first: bool, fix_last: bool) -> list[str]:
    """Up to `count` different other orders of a peptide, drawn without repetition by their ranks."""
    start, stop = _core(peptide, fix_first, fix_last)
    core = peptide[start:stop]
    found = (ordered_by_rank(core, r) for r in drawn_ranks(peptide, count, seed, orders(core)))
    return [peptide[:start] + o + peptide[stop:] for o in islice((o for o in found if o != core), count)]


def arrangements(peptides: DataFrame, count: int, seed: int, *, fix_first: bool = False, fix_last: bool = True) -> DataFrame:
    """Up to `count` distinct other orders of each peptide: peptide, nth, candidate; from a generator of the peptide's own.

    A peptide with no more than `count` other orders gets all of them.
    """
    ship(peptides.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((p, k, o) for p in batch.column(0).to_pylist() for k, o in enumerate(drawn_orders(p, count, seed, fix_first=fix_first, fix_last=fix_last)))
            while held := list(islice(rows, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["peptide", "nth", "candidate"])

    return peptides.select("peptide").mapInArrow(run, "peptide string, nth bigint, candidate string")


def _signature(peptide: Column, digestion: Digestion) -> Column:
    """How a peptide is cleaved alone, after and before others."""
    parts = lambda s: F.size(F.flatten(segments(s, digestion)))
    return F.struct(parts(peptide), parts(F.concat(F.lit(PRECEDING), peptide)), parts(F.concat(peptide, F.lit(FOLLOWING))))


def decoypyrat(rows: DataFrame, digestion: Digestion, seed: int, prefix: str = "REV_", *, candidates: int = TRIES) -> DataFrame:
    """Digestion-aware decoys: reversed with cleavage residues switched; peptides that targets have are rearranged.

    `rows` has id, raw_header, sequence. Each distinct colliding peptide is resolved once, by the first of
    its `candidates` arrangements that is no target and is cleaved alike; one without any is left out, and so
    is a decoy that nothing is left of. Those that FIRST arrangements don't resolve are given the others. Adds initial_collisions and dropped_peptides of each decoy.
    """
    targets = digested(rows.select("sequence"), Digestion(digestion.enzyme, digestion.cut, digestion.shortest, digestion.longest)).select("peptide").distinct()
    first = rows.select("id", "raw_header", F.posexplode(F.flatten(segments(reverse_and_switch(F.col("sequence")), digestion))).alias("pos", "peptide"))
    selected = F.length("peptide").between(digestion.shortest, digestion.longest)
    clashing = checkpointed(first.where(selected).select("peptide").distinct().join(targets, "peptide", "left_semi"))

    def fitting(peptides: DataFrame, count: int) -> DataFrame:
        tried = arrangements(peptides, count, seed, fix_last=True).where(_signature(F.col("candidate"), digestion) == _signature(F.col("peptide"), digestion))
        tried = tried.join(targets.withColumnRenamed("peptide", "candidate"), "candidate", "left_anti")
        return checkpointed(tried.groupBy("peptide").agg(F.min_by("candidate", "nth").alias("replacement")))

    chosen = fitting(clashing, min(FIRST, candidates))
    if candidates > FIRST:
        chosen = chosen.union(fitting(clashing.join(chosen, "peptide", "left_anti"), candidates))
    resolved = clashing.join(chosen, "peptide", "left").withColumn("clash", F.lit(True))
    parts = first.join(resolved, "peptide", "left")
    part = F.when(F.col("clash").isNull(), F.col("peptide")).otherwise(F.coalesce("replacement", F.lit("")))
    built = parts.groupBy("id", "raw_header").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda p: p["part"]), "").alias("sequence"),
        F.count_if(F.col("clash").isNotNull()).alias("initial_collisions"), F.count_if(F.col("clash").isNotNull() & F.col("replacement").isNull()).alias("dropped_peptides"),
    )
    return built.where(F.col("sequence") != "").withColumn("raw_header", F.concat(F.lit(prefix), "raw_header"))


def chosen_ranks(own: dict[str, int], taken: set[int], n: int, fold: int, seed: int, most: int) -> Iterator[tuple[str, int, int]]:
    """peptide, place and rank of up to `fold` of n orders of each peptide of a class, none of them in `taken`.

    `own` has the peptides, sorted by name, with their own ranks. The peptides of a class have the same letters
    and the same fixed ends, so their orders have the same ranks.
    """
    had, lacking, count = dict.fromkeys(own, 0), list(own), min(most, max(FIRST, 2 * fold))
    while lacking:
        owned, used = {p: [] for p in lacking}, set(taken)
        for p in lacking:
            free = (r for r in islice((r for r in drawn_ranks(p, count, seed, n) if r != own[p]), count) if r not in used)
            # Of equal candidates the first peptide by name keeps it; what the last one leaves, nobody asks for.
            owned[p] = list(islice(free, fold - had[p]) if p is lacking[-1] else free)
            used.update(owned[p])
        added = 0
        for p in lacking:
            for r in owned[p][: fold - had[p]]:
                taken.add(r)
                had[p] += 1
                added += 1
                yield p, had[p], r
        lacking = [p for p in lacking if had[p] < fold]
        if count == most and not added:
            break
        count = most


def _chosen(rows: DataFrame, digestion: Digestion, fold: int, seed: int, *, fix_first: bool, fix_last: bool, most: int) -> DataFrame:
    """Columns peptide, place, candidate: what each selected peptide is given.

    Orders of a peptide have its letters and its fixed ends, so only peptides of the same letters and ends can
    meet in a candidate. Such a class (the distinct peptides that are anagrams of each other) is resolved by one
    task; no candidate that isn't kept is made, sent or joined.
    """
    ship(rows.sparkSession)
    whole = F.flatten(segments(F.col("sequence"), digestion))
    peptides = rows.select(F.explode(whole).alias("peptide"), F.lit(True).alias("wanted")).where(F.length("peptide").between(digestion.shortest, digestion.longest))
    if digestion.missed:  # targets that are not fully cleaved
        peptides = peptides.union(digested(rows.select("sequence"), digestion).select("peptide", F.lit(False)))
    ends = F.concat_ws("-", composition(F.col("peptide")), F.left("peptide", F.lit(int(fix_first))), F.right("peptide", F.lit(int(fix_last))))
    held = peptides.groupBy("peptide").agg(F.bool_or("wanted").alias("wanted")).select(ends.alias("class"), "peptide", "wanted")
    held = held.repartition("class").sortWithinPartitions("class", "peptide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))

        def given() -> Iterator[tuple[str, int, str]]:
            for _, group in groupby(seen, lambda row: row[0]):
                group = list(group)
                start, stop = _core(group[0][1], fix_first, fix_last)
                n = orders(group[0][1][start:stop])
                ranks = {p: rank_of(p[start:stop], n) for _, p, _ in group}
                for p, place, rank in chosen_ranks({p: ranks[p] for _, p, w in group if w}, set(ranks.values()), n, fold, seed, most):
                    yield p, place, p[:start] + ordered_by_rank(p[start:stop], rank, n) + p[stop:]

        rows = given()
        while held := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["peptide", "place", "candidate"])

    return checkpointed(held.mapInArrow(run, "peptide string, place bigint, candidate string"))


def shuffled_entrapment(rows: DataFrame, digestion: Digestion, fold: int, seed: int, *, fix_first: bool = False, fix_last: bool = True, candidates: int | None = None, pairs: bool = False) -> DataFrame:
    """Entrapment proteins: each selected peptide replaced by one of its own `fold` arrangements, all of them unique.

    `rows` has id, raw_header, sequence. Candidates that are targets go; of equal candidates of different
    peptides the first peptide by name keeps it. Peptides that lack some after a round draw again, up to
    `candidates` (TRIES for each copy), without what others have taken, until nothing is added. A protein has as many copies as its poorest peptide allows.
    Columns source_id, fold_index, id, raw_header, sequence; with `pairs` peptide, fold_index, candidate of every peptide.
    """
    parts = rows.select("id", "raw_header", F.posexplode(F.flatten(segments(F.col("sequence"), digestion))).alias("pos", "peptide"))
    selected = F.length("peptide").between(digestion.shortest, digestion.longest)
    taken = _chosen(rows, digestion, fold, seed, fix_first=fix_first, fix_last=fix_last, most=candidates or TRIES * fold)
    if pairs:
        return taken.select("peptide", (F.col("place") - 1).cast("bigint").alias("fold_index"), "candidate")
    lists = taken.groupBy("peptide").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "candidate"))), lambda c: c["candidate"]).alias("found"))
    parts = parts.withColumn("selected", selected).join(lists, "peptide", "left")
    choices = F.when(F.col("selected"), F.coalesce("found", F.array().cast("array<string>"))).otherwise(F.array_repeat("peptide", F.lit(fold)))
    built = parts.groupBy("id", "raw_header").agg(F.array_sort(F.collect_list(F.struct("pos", "peptide", choices.alias("choices")))).alias("parts"))
    built = built.withColumn("copies", F.array_min(F.transform("parts", lambda p: F.size(p["choices"])))).where("copies > 0")
    copies = built.select("id", "raw_header", "parts", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("fold_index"))
    sequence = F.array_join(F.transform("parts", lambda p: F.get(p["choices"], F.col("fold_index"))), "")
    named = F.concat("id", F.when(F.lit(fold) > 1, F.concat(F.lit("_"), F.col("fold_index") + 1)).otherwise(F.lit("")), F.lit("_p_target"))
    return copies.select(F.col("id").alias("source_id"), "fold_index", named.alias("id"), F.concat(named, F.lit(" entrapment of "), "raw_header").alias("raw_header"), sequence.alias("sequence"))


def entrapment_pairs(rows: DataFrame, digestion: Digestion, fold: int, seed: int, **settings) -> DataFrame:
    """Which peptide of which protein an entrapment peptide stands for: source_id, target_peptide, generated_peptide, fold_index.

    Of each protein the copies that shuffled_entrapment makes of it: as many as its poorest peptide allows.
    """
    given = shuffled_entrapment(rows, digestion, fold, seed, pairs=True, **settings)
    lists = given.groupBy("peptide").agg(F.collect_list(F.struct("fold_index", "candidate")).alias("found"))
    parts = rows.select(F.col("id").alias("source_id"), F.explode(F.flatten(segments(F.col("sequence"), digestion))).alias("peptide")).where(F.length("peptide").between(digestion.shortest, digestion.longest)).distinct()
    held = parts.join(lists, "peptide", "left").withColumn("copies", F.min(F.greatest(F.size("found"), F.lit(0))).over(Window.partitionBy("source_id")))
    met = held.where("copies > 0").select("source_id", "peptide", "copies", F.inline("found")).where(F.col("fold_index") < F.col("copies"))
    return met.select("source_id", F.col("peptide").alias("target_peptide"), F.col("candidate").alias("generated_peptide"), "fold_index")


def foreign_entrapment(targets: DataFrame, foreign: DataFrame, digestion: Digestion, count: int, seed: int) -> DataFrame:
    """`count` foreign proteins that share no peptide with the targets, chosen by a seeded hash of their id."""
    known = digested(targets.select("sequence"), digestion).select("peptide").distinct()
    sharing = digested(foreign, digestion, "id").join(known, "peptide", "left_semi").select("id").distinct()
    free = foreign.join(sharing, "id", "left_anti")
    return free.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(count)


def collisions(decoys: DataFrame, targets: DataFrame, digestion: Digestion) -> DataFrame:
    """One row: distinct decoy peptides that are target peptides."""
    d = digested(decoys.select("sequence"), digestion).select("peptide").distinct()
    t = digested(targets.select("sequence"), digestion).select("peptide").distinct()
    return d.join(t, "peptide", "left_semi").agg(F.count(F.lit(1)).alias("collisions"))


__all__ = ["arrangements", "collisions", "decoypyrat", "digest", "entrapment_pairs", "foreign_entrapment", "ordered_by_rank", "reverse_decoys", "shuffle_decoys", "shuffled_entrapment"]
