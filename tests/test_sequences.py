import hashlib
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from strandlake.functions import peptide_properties as props
from strandlake.functions.hashing import ordered_fingerprint, sequence_hash
from strandlake.functions.sequences import Digestion, digest, reverse_and_switch
from strandlake.operators import build, generate, peptides, registry


def digested(spark, sequence, **lengths):
    row = spark.createDataFrame([(sequence,)], "s string").select(digest(F.col("s"), Digestion(**lengths)).alias("d")).first()
    return [(p["peptide"], p["missed_cleavages"]) for p in row["d"]]


def cleaved(sequence, shortest, longest, missed):
    """Brute force: every stretch between two places where trypsin may cut, or the ends of a run of letters."""
    found = []
    for run in re.finditer("[A-Z]+", sequence):
        text = run.group()
        cuts = [0, *(k + 1 for k in range(len(text) - 1) if text[k] in "KR" and text[k + 1] != "P"), len(text)]
        for i, start in enumerate(cuts[:-1]):
            for n, end in enumerate(cuts[i + 1 : i + 2 + missed]):
                if shortest <= end - start <= longest:
                    found.append((text[start:end], n))
    return found


@pytest.mark.parametrize("missed", [0, 1, 2])
@pytest.mark.parametrize("span", [(1, 50), (3, 6)])
def test_digestion_equals_brute_force(spark, missed, span):
    rng = random.Random(10 * missed + span[0])
    for sequence in ["", "KKK", "KP", "-R*", *("".join(rng.choice("GGKRPM*-") for _ in range(rng.randrange(30))) for _ in range(6))]:
        assert digested(spark, sequence, shortest=span[0], longest=span[1], missed=missed) == cleaved(sequence, *span, missed)


@pytest.mark.parametrize("bad", [dict(shortest=0), dict(shortest=9, longest=8), dict(missed=-1), dict(missed=3)])
def test_bad_digestions(bad):
    with pytest.raises(ValueError):
        Digestion(**bad)


def test_reverse_and_switch(spark):
    # Of the reversed sequence, a run of cleavage residues passes the residue before it (at the start, the rest of a run its first one).
    rng = random.Random(3)
    made = ["".join(rng.choice("GKRM") for _ in range(rng.randrange(12))) for _ in range(200)]
    rows = spark.createDataFrame([(s,) for s in made], "s string").select("s", reverse_and_switch(F.col("s")).alias("r")).collect()
    assert all(r["r"] == re.sub("(^[KR]|[^KR])([KR]+)", r"\2\1", r["s"][::-1]) for r in rows)


def test_reverse_and_switch_of_a_long_sequence_is_one_pass(spark):
    rng = random.Random(4)
    made = "".join(rng.choice("GGGKRM") for _ in range(400_000))
    column = reverse_and_switch(F.col("s"))
    assert "aggregate" not in str(column)  # no head that grows letter by letter
    [row] = spark.createDataFrame([(made,)], "s string").select(column.alias("r")).collect()
    assert row["r"] == re.sub("(^[KR]|[^KR])([KR]+)", r"\2\1", made[::-1])


def scans(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + frame._jdf.queryExecution().optimizedPlan().toString().count("Relation")


def test_decoy_statistics_read_each_side_once(spark, tmp_path):
    rng = random.Random(9)
    rows = [("".join(rng.choice("ACDK") for _ in range(60)),) for _ in range(30)]
    spark.createDataFrame(rows, "sequence string").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([(s[::-1],) for (s,) in rows], "sequence string").write.parquet(f"{tmp_path}/d")
    targets, decoys, cut = spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/d"), Digestion(shortest=3, longest=9)
    made = peptides.decoy_statistics(decoys, targets, cut)
    assert scans(made) == 2 and scans(peptides.population(targets, cut)) == 2
    of = lambda texts: {p for t in texts for p, _ in cleaved(t, 3, 9, 0)}
    t, d = of(s for (s,) in rows), of(s[::-1] for (s,) in rows)
    kinds = {"".join(sorted(p)) for p in t}
    assert made.first().asDict() == pytest.approx({"unique_ratio": len(d) / len(t), "shared_with_targets": len(d & t), "composition_overlap": sum("".join(sorted(p)) in kinds for p in d) / len(d)})


def test_tables_are_hashed_after_their_sort(spark):
    frame = spark.createDataFrame([("P", 0, "target", "ACDK")], "id string, final_order long, kind string, sequence string")
    mapped = peptides.protein_peptides(frame, Digestion(shortest=3, longest=9))
    for made in (peptides.peptides_table(mapped), peptides.map_table(mapped)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("ArrowEvalPython") < plan.index("Sort [")  # the sort's sampling pass would run a hash below it once more


def test_property_values(spark):
    # Reference results of public packages for two peptides.
    rows = {r["s"]: r["p"] for r in spark.createDataFrame([("SAMPLER",), ("RSGASILQAGCUG",), ("K",)], "s string").select("s", props.properties(F.col("s")).alias("p")).collect()}
    assert rows["RSGASILQAGCUG"] is None
    sampler = rows["SAMPLER"]
    assert sampler["length"] == 7 and sampler["c_terminal_residue"] == "R" and sampler["contains_methionine"]
    assert sampler["molecular_weight"] == pytest.approx(sum(props.MASS[r] for r in "SAMPLER") + props.WATER, abs=1e-6)
    assert rows["K"]["instability_index"] == 0
    with pytest.raises(Exception, match="non-empty upper-case"):
        spark.createDataFrame([("PEPtIDE",)], "s string").select(props.properties(F.col("s"))).collect()


def test_hashes_and_fingerprints(spark):
    [row] = spark.createDataFrame([("ACD",)], "s string").select(sequence_hash(F.col("s")).alias("h")).collect()
    assert bytes(row["h"]) == hashlib.blake2b(b"ACD", digest_size=16).digest()
    rng = random.Random(6)
    ids = ["".join(rng.choice("aZ9_.~é") for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    [made] = ordered_fingerprint(spark.createDataFrame([("d", i) for i in ids], "db string, id string").repartition(3), ["db"], ["id"]).collect()
    want = hashlib.blake2b(b"".join(i.encode() + b"\n" for i in sorted(set(ids), key=str.encode)), digest_size=16).digest()
    assert bytes(made["fingerprint"]) == want


@pytest.mark.parametrize("n", [3, 10, 11, 57])
def test_exclusive_deciles(spark, n):
    import statistics

    values = [random.Random(n).randrange(40) for _ in range(n)]
    row = peptides.exclusive_deciles(spark.createDataFrame([(v, 1) for v in values], "length int, n int")).first()
    cuts = statistics.quantiles(values, n=10) if n >= 10 else None
    want = (cuts[0], cuts[4], cuts[8]) if cuts else (min(values), statistics.median(values), max(values))
    assert tuple(row) == pytest.approx(want)


def test_decoypyrat_and_entrapment_invariants(spark):
    rng = random.Random(5)
    rows = [(f"P{k}", f"P{k} d", "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(120))) for k in range(20)]
    frame = spark.createDataFrame(rows, "id string, raw_header string, sequence string")
    cut = Digestion(shortest=3, longest=50)
    made = generate.decoypyrat(frame, cut, 7).collect()
    assert all(r["raw_header"].startswith("REV_P") for r in made)
    targets = {r["peptide"] for r in peptides.digested(frame, cut).collect()}
    entrapped = generate.shuffled_entrapment(frame, cut, 2, 7)
    parts = [r["peptide"] for r in peptides.digested(entrapped, cut).collect()]
    assert not targets & set(parts)
    sources = {r[0]: r[2] for r in rows}
    assert all(sorted(r["sequence"]) == sorted(sources[r["source_id"]]) for r in entrapped.collect())
    again = generate.shuffle_decoys(frame.repartition(5), 7).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, generate.shuffle_decoys(frame, 7).collect()))


def test_decoypyrat_keeps_what_a_hundred_tries_resolve(spark):
    rng, rows = random.Random(11), []
    while len(rows) < 120:  # decoys with one inner KP or RP that are targets too
        protein = "".join(rng.choice("ACDEFGHILMNPPPPQSTVWYKR") for _ in range(60))
        decoy = re.sub("(^[KR]|[^KR])([KR]+)", r"\2\1", protein[::-1])
        for part in re.split("(?<=[KR])(?!P)", decoy)[1:-1]:
            if 11 <= len(part) <= 13 and len(re.findall("[KR]P", part)) == 1 and len(re.findall("[KR]", part)) == 2:
                rows += [(f"P{len(rows)}", "d", protein), (f"Q{len(rows)}", "d", part)]
                break
    frame = spark.createDataFrame(rows, "id string, raw_header string, sequence string")
    made = generate.decoypyrat(frame, Digestion(shortest=7, longest=50), 7).where("id like 'P%'").collect()
    assert sum(r["initial_collisions"] for r in made) >= 60 and sum(r["dropped_peptides"] for r in made) == 0


def test_entrapment_of_many_copies(spark):
    frame = spark.createDataFrame([("P", "P", "ACDEFGHILMNK"), ("Q", "Q", "CADEFGHILMNK"), ("S", "S", "ACDK"), ("T", "T", "CADK"), ("U", "U", "DACK")], "id string, raw_header string, sequence string")
    made = generate.shuffled_entrapment(frame.where("id in ('P', 'Q')"), Digestion(shortest=3, longest=50), 30, 7).collect()
    assert len(made) == 60 and len({r["sequence"] for r in made}) == 60
    # Three of six orders are targets, so each peptide can have one of the other three, whoever draws first.
    one = generate.shuffled_entrapment(frame.where("id in ('S', 'T', 'U')"), Digestion(shortest=3, longest=50), 1, 7).collect()
    assert len({r["sequence"] for r in one}) == 3


def test_parity_shuffle_uses_one_generator_in_order(spark):
    rows = [(k, f"P{k}", "ACDEFG") for k in range(6)]
    frame = spark.createDataFrame(rows, "n int, raw_header string, sequence string").repartition(3)
    draw, want = random.Random(9), []
    for _, _, s in rows:
        residues = list(s)
        draw.shuffle(residues)
        want.append("".join(residues))
    made = generate.shuffle_decoys(frame, 9, parity_order=["n"]).orderBy("n").collect()
    assert [r["sequence"] for r in made] == want


def test_first_wins_and_conflicts(spark):
    frame = spark.createDataFrame([("a", 2, "S"), ("a", 1, "S"), ("b", 1, "T")], "id string, n int, sequence string")
    assert sorted(map(tuple, build.first_wins(frame, order=["n"]).collect())) == [("a", 1, "S"), ("b", 1, "T")]
    with pytest.raises(Exception, match="conflicting sequence"):
        build.first_wins(frame.union(spark.createDataFrame([("a", 3, "X")], frame.schema)), order=["n"]).collect()


def test_average_linkage(spark):
    pairs = [("a", "b", 0.9), ("a", "c", 0.2), ("b", "c", 0.4)]
    frame = spark.createDataFrame([("target", x, y, s, 5, 5) for x, y, s in pairs], "kind string, low string, high string, id_jaccard double, distinct_ids_low int, distinct_ids_high int")
    merges = [(r["left_id"], r["right_id"], round(r["distance"], 6), r["leaf_count"]) for r in registry.average_linkage(frame).orderBy("step").collect()]
    assert merges == [(0, 1, 0.1, 2), (3, 2, 0.7, 3)] or merges == [(0, 1, 0.1, 2), (2, 3, 0.7, 3)]


def brute_linkage(names, near):
    """Average linkage by definition: the mean distance of all members of two clusters, ties to the first by name."""
    clusters, made = {k: (k,) for k in range(len(names))}, []
    apart = lambda a, b: sum(1 - near[min(i, j), max(i, j)] for i in a for j in b) / (len(a) * len(b))
    while len(clusters) > 1:
        best = min((round(apart(clusters[i], clusters[j]), 12), min(clusters[i]), min(clusters[j]), i, j) for i in clusters for j in clusters if min(clusters[i]) < min(clusters[j]))
        made.append((best[3], best[4], round(best[0], 6), len(clusters[best[3]]) + len(clusters[best[4]])))
        clusters[len(names) + len(made) - 1] = clusters.pop(best[3]) + clusters.pop(best[4])
    return made


def test_average_linkage_equals_its_definition_and_orders_leaves(spark):
    rng, names = random.Random(4), [f"db{k:02d}" for k in range(14)]
    near = {(i, j): rng.randrange(8) / 8 for j in range(14) for i in range(j)}
    rows = [("target", names[i], names[j], v, 5, 5) for (i, j), v in near.items()] + [("target", n, "empty", 0.0, 5, 0) for n in names]
    frame = spark.createDataFrame(rows, "kind string, low string, high string, id_jaccard double, distinct_ids_low int, distinct_ids_high int")
    merges = [(r["left_id"], r["right_id"], round(r["distance"], 6), r["leaf_count"]) for r in registry.average_linkage(frame).orderBy("step").collect()]
    assert merges == brute_linkage(names, near)
    leaves = {r["database_id"]: r["position"] for r in registry.leaf_order(frame).collect()}
    assert leaves.pop("empty") is None and sorted(leaves.values()) == list(range(14))
    with pytest.raises(ValueError, match="missing"):
        registry.average_linkage(frame.where("low <> 'db00' or high <> 'db01'"))


def test_orders_by_rank():
    for letters in ("A", "AAB", "ABCD", "AABBC"):
        n = generate.orders(letters)
        assert [generate.ordered_by_rank(letters, k) for k in range(n)] == sorted({"".join(p) for p in permutations(letters)})


def test_ranks_of_orders():
    for letters in ("", "A", "AAB", "CABBA", "KRPDDAAK"):
        assert all(generate.rank_of(generate.ordered_by_rank(letters, k)) == k for k in range(generate.orders(letters)))


def rounds(own, taken, n, fold, seed, most):
    """Brute force: in each round every peptide that lacks some draws all its candidates, and of equal ones the first by name is kept."""
    had, count = dict.fromkeys(own, 0), min(most, max(generate.FIRST, 2 * fold))
    while lacking := [p for p in own if had[p] < fold]:
        drawn = {p: [r for r in generate.drawn_ranks(p, count, seed, n) if r != own[p]][:count] for p in lacking}
        first = {r: min(p for p in lacking if r in drawn[p]) for p in lacking for r in drawn[p] if r not in taken}
        kept = [(p, r) for p in lacking for r in [r for r in drawn[p] if first.get(r) == p][: fold - had[p]]]
        for p, r in kept:
            taken.add(r)
            had[p] += 1
            yield p, had[p], r
        if count == most and not kept:
            return
        count = most


@pytest.mark.parametrize("fold", [1, 3, 40])
def test_classes_choose_as_rounds_over_all_candidates(fold):
    rng = random.Random(fold)
    for letters, size in (("AAC", 2), ("AACD", 9), ("ACDEF", 60), ("ACDEFG", 80), ("ACDEFGHI", 30), ("ACDEFGHIKLMN", 1)):
        n = generate.orders(letters)
        own = {p: generate.rank_of(p) for p in sorted({generate.ordered_by_rank(letters, rng.randrange(n)) for _ in range(size)})}
        taken = {*own.values(), *(rng.randrange(n) for _ in range(size))}
        made = list(generate.chosen_ranks(own, set(taken), n, fold, 7, 100 * fold))
        assert made == list(rounds(own, set(taken), n, fold, 7, 100 * fold))
        assert len({r for *_, r in made}) == len(made) and not {r for *_, r in made} & taken


def test_entrapment_makes_no_candidates_that_it_does_not_keep(spark):
    rng = random.Random(8)
    frame = spark.createDataFrame([(f"P{k}", "h", "".join(rng.choice("ACDEFGHIK") for _ in range(300))) for k in range(20)], "id string, raw_header string, sequence string")
    made = generate.entrapment_pairs(frame, Digestion(shortest=7, longest=50), 1, 7)
    # No table of candidates is joined with targets, and no round with another.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join") == 1
    peptides_of = {(r["id"], r["peptide"]) for r in peptides.digested(frame, Digestion(shortest=7, longest=50), "id").collect()}
    assert {(r["source_id"], r["target_peptide"]) for r in made.collect()} == peptides_of


def test_export_numbers(spark):
    frame = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (1 / 3,)], "v double").select(registry.export_text(F.col("v"), "double").alias("t"))
    assert [r["t"] for r in frame.collect()] == ["0.0", "1.0", "0.5", "0.333333333333"]
