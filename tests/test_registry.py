import collections
import datetime
import hashlib
import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.cli import main
from strandlake.operators import blocks, build, classify, lifecycle, peptides, registry
from strandlake.sources import files, tables
from strandlake.sources.fasta import discover, proteins, read_records


def indexed(spark, paths):
    return lifecycle.entries_of(proteins(read_records(spark, paths)))


def counts(spark, root):
    held = lifecycle.open_registry(spark, root)
    assert lifecycle.problems(held["entries"], held["kind_stats"], held["pair_stats"]).count() == 0
    return {r["database_id"].rpartition("/")[2]: r["n"] for r in held["entries"].groupBy("database_id").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_updates_prune_and_rebuild(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "registry")
    source.mkdir()
    for name, n in (("a", 1), ("b", 2), ("c", 3)):
        (source / f"{name}.fasta").write_text("".join(f">{name}{k} x\nAAK\n" for k in range(n)))
    found = discover(spark, str(source))
    lifecycle.rebuild(indexed(spark, [r["path"] for r in found.collect()]), root, found)
    assert counts(spark, root) == {"a.fasta": 1, "b.fasta": 2, "c.fasta": 3}
    read = lambda paths: indexed(spark, paths)
    assert lifecycle.update(spark, discover(spark, str(source)), root, read) == {"indexed": 0, "dropped": 0}
    (source / "c.fasta").unlink()
    (source / "b.fasta").write_text(">b0 x\nAAKK\n>b1\nCC\n>b2\nDD\n>b3\nEE\n")
    (source / "d.fasta").write_text(">b0 x\nAAKK\n")
    assert lifecycle.update(spark, discover(spark, str(source)), root, read, prune=False) == {"indexed": 2, "dropped": 0}
    assert counts(spark, root) == {"a.fasta": 1, "b.fasta": 4, "c.fasta": 3, "d.fasta": 1}
    assert lifecycle.update(spark, discover(spark, str(source)), root, read) == {"indexed": 0, "dropped": 1}
    assert counts(spark, root) == {"a.fasta": 1, "b.fasta": 4, "d.fasta": 1}
    main(["registry", root], spark)
    main(["candidate", root, str(source / "d.fasta")], spark)
    main(["pairs", root, str(tmp_path / "pairs.tsv")], spark)
    main(["pairs", root, str(tmp_path / "matrix.tsv"), "--matrix"], spark)
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "matrix.tsv")).count() == 3
    assert lifecycle.read_registry(spark, str(tmp_path / "none")) is None


def test_a_registry_with_faults_is_not_published(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">a x\nAAK\n")
    entries, root = indexed(spark, [str(tmp_path / "a.fasta")]), str(tmp_path / "registry")
    with pytest.raises(ValueError, match="duplicate ordinals"):
        lifecycle.rebuild(entries.union(entries), root)
    assert not files.exists(spark, root) and not [n for n in files.names(spark, str(tmp_path)) if "part" in n]


def test_a_database_is_ordered_without_its_sequences(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">a x\nAAK\n>b y\nCCK\n")
    plan = indexed(spark, [str(tmp_path / "a.fasta")])._jdf.queryExecution().optimizedPlan()
    lines = plan.toString().splitlines()
    first = min(k for k, line in enumerate(lines) if "Window [" in line)
    last = max(k for k, line in enumerate(lines) if "Window [" in line and "record_ordinal" in line)
    held = next(line for line in lines[last + 1 :] if "Project [" in line)
    assert first <= last and "sequence_hash#" in held and " sequence#" not in held


def test_one_file_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(400, numPartitions=4).selectExpr("399 - id as n", "concat('r', 399 - id) as raw_header", "repeat('AC', cast((399 - id) % 70 as int)) as sequence")
    tables.write_fasta_file(rows, f"{tmp_path}/one.fasta", order=["n"])
    text = (tmp_path / "one.fasta").read_text()
    assert [line[1:] for line in text.splitlines() if line.startswith(">")] == [f"r{k}" for k in range(400)]
    made = {r["raw_header"]: (r["record_ordinal"], r["sequence"]) for r in read_records(spark, f"{tmp_path}/one.fasta").collect()}
    assert made == {f"r{k}": (k, "AC" * (k % 70)) for k in range(400)}
    assert not [n for n in files.names(spark, str(tmp_path)) if "part" in n]
    tables.write_fasta_file(rows.limit(0), f"{tmp_path}/none.fasta", order=["n"])
    assert (tmp_path / "none.fasta").read_bytes() == b""


def test_files_snapshots_and_manifests(spark, tmp_path):
    p = lambda name: f"{tmp_path}/{name}"
    files.write_bytes(spark, p("one"), b"text")
    with pytest.raises(FileExistsError):
        files.write_bytes(spark, p("one"), b"other")
    [row] = files.manifest(spark, p("one"), schema_name="notes", rows=1).collect()
    assert (row["md5"], row["bytes"], row["path"], row["rows"]) == (hashlib.md5(b"text").hexdigest(), 4, "one", 1)
    at = [datetime.datetime(2024, 1, d, tzinfo=datetime.UTC) for d in (3, 1, 2)]
    for a in at:
        files.write_bytes(spark, files.stamped(p("snaps"), a), b"s")
    files.write_bytes(spark, files.stamped(p("snaps"), at[0], ".db"), b"s")
    assert [n.rpartition("/")[2][9:17] for n in files.snapshots(spark, p("snaps"))] == ["20240101", "20240102", "20240103"]
    assert [n.rpartition("/")[2][9:17] for n in files.superseded(spark, p("snaps"), 1)] == ["20240101", "20240102"]
    with pytest.raises(ValueError, match="at least one"):
        files.superseded(spark, p("snaps"), 0)


def test_publishing_together_or_not_at_all(spark, tmp_path):
    p = lambda name: f"{tmp_path}/{name}"
    files.write_bytes(spark, p("a.part"), b"a")
    with pytest.raises(ValueError, match="differ"):
        files.publish(spark, {p("a.part"): p("a"), p("b.part"): p("A")})
    with pytest.raises(OSError):
        files.publish(spark, {p("a.part"): p("a"), p("missing"): p("b")})
    assert files.names(spark, str(tmp_path))[0] == "a.part" and not files.exists(spark, p("a"))
    files.publish(spark, {p("a.part"): p("a")})
    assert files.exists(spark, p("a"))


def test_guards(spark):
    frame = spark.createDataFrame([("a", "decoy", "AcD")], "id string, kind string, sequence string")
    with pytest.raises(Exception, match="has decoys already"):
        build.without_decoys(frame).collect()
    with pytest.raises(Exception, match="must be normalised"):
        frame.select(peptides.required_normalized(F.col("sequence"))).collect()
    with pytest.raises(Exception, match="not a valid inventory row"):
        tables.inventory_entries(frame.withColumn("kind", F.lit("odd"))).collect()


def test_packaged_database(spark):
    rows = [(0, "P1 x", "AA", "target", None), (1, "C1", "CC", "contaminant", "keratin"), (2, "C2", "DD", "contaminant", "keratin"), (3, "E1", "EE", "entrapment", None), (4, "D1", "FF", "decoy", None)]
    made = build.packaged(spark.createDataFrame(rows, "final_order long, raw_header string, sequence string, kind string, contaminant_group string"), "db", "20240101", "all")
    assert [r["raw_header"] for r in made.orderBy("section", "block", "place").collect()] == ["aa|db|20240101 all", "P1 x", "aa|Cont_keratin|db", "C1", "C2", "E1"]


def test_row_checksums(spark):
    digest = lambda raw: hashlib.blake2b(raw, digest_size=16)
    [row] = lifecycle.with_row_checksums(spark.createDataFrame([("P1", "ACD")], "id string, sequence string")).collect()
    assert row["sequence_hash"] == digest(b"ACD").hexdigest()
    assert row["id_sequence_fingerprint"] == digest(b"P1\0" + digest(b"ACD").digest() + b"\n").hexdigest()


def test_shared_counts_of_many_databases_are_those_of_few(spark):
    """By pairs of blocks, with values of few, of many and of all databases, and repeated and null ones."""
    rows = spark.range(40_000).select(
        F.concat(F.lit("d"), (F.xxhash64("id", F.lit(1)) % 150 + 150)).alias("database_id"), F.when(F.col("id") % 7 == 0, "contaminant").otherwise("target").alias("kind"),
        F.when(F.col("id") % 50 > 0, F.when(F.col("id") % 3 == 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9))).otherwise(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(5_000)))).alias("v"),
    )
    plain = registry.shared_counts(rows, ["v"], "n", few=10_000)
    found = registry.shared_counts(rows, ["v"], "n", few=0)
    assert found.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    assert registry.shared_counts(rows.where("v is null"), ["v"], "n", few=0).count() == 0


def test_pairs_of_single_values_of_many_databases_are_not_shuffled(spark):
    rows = spark.range(300_000).select((F.col("id") % 600).alias("database_id"), F.lit("target").alias("kind"), F.floor(F.col("id") / 600).alias("v")).where("(database_id + v) % 5 <> 0")
    found = registry.shared_counts(rows, ["v"], "n")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and found.count() == 600 * 599 // 2


def test_more_blocks_of_databases_shuffle_no_more(spark, monkeypatch):
    """A value's databases are written once, however many blocks they are dealt to; chunks and kinds count as one block does."""
    draw = random.Random(3)
    sets = [(draw.choice(["target", "decoy", None]), n, sorted(draw.sample(range(600), 200))) for n in range(1, 151)]
    wanted = collections.Counter()
    for kind, n, d in sets:
        wanted.update({(kind, *pair): n for pair in itertools.combinations(d, 2)})
    frame = spark.createDataFrame(sets, "kind string, n bigint, d array<int>").coalesce(2)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    grown = []
    for block, most in ((600, 1 << 21), (50, 1000)):
        for name, value in (("BLOCK", block), ("BLOCKS", 1), ("CHUNK", most)):
            monkeypatch.setattr(blocks, name, value, raising=False)
        before = written()
        found = blocks.shared_pairs(frame, pa.array(range(600), pa.int64()), "n").collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        grown.append(written() - before)
        assert {(r["kind"], r["low"], r["high"]): r["n"] for r in found} == wanted and len(found) == len(wanted)
    assert grown[1] < 4 * grown[0]


def test_a_large_database_is_ordered_and_written_in_chunks(spark, tmp_path, monkeypatch):
    """Blocks that run through chunks, end with them or have no entries are those of one pass in order."""
    monkeypatch.setattr(classify, "CHUNK", 4)
    monkeypatch.setattr(lifecycle, "CHUNK", 4)
    draw = random.Random(5)
    rows = [(d, k, *draw.choice([("target", None)] * 6 + [("contaminant", None), ("decoy", None), ("sentinel", None), ("sentinel", "g1"), ("sentinel", "g2")])) for d in ("a", "b", None) for k in range(120)]
    expected = []
    for d, k, kind, marker in rows:
        if k == 0:
            group, empty = None, False
        if kind == "sentinel":
            stale = group is not None and empty
            group, empty = marker and ("unlabelled" if stale else marker), True
        joins = kind in ("target", "contaminant")
        empty = empty and not joins
        got = "contaminant" if joins and group else kind
        expected.append((d, k, got, (group or "unlabelled") if got == "contaminant" else None))
    frame = spark.createDataFrame(rows, "database_id string, ordinal bigint, kind string, marker_group string")
    found = classify.contaminant_blocks(frame, ["database_id"], "ordinal").select("database_id", "ordinal", "resolved_kind", "contaminant_group")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    text = [F.lit("x").alias(c) for c in ("sequence_id", "namespace", "contaminant_group")]
    entries = frame.where("database_id = 'a'").select("database_id", "ordinal", "kind", *text, F.lit(1).cast("bigint").alias("sequence_length"), F.lit(b"1").alias("sequence_hash"), F.lit(b"2").alias("description_hash"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lifecycle.write_entries(entries, str(tmp_path / "r"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "r/entries/database_id=a").glob("*.parquet"))) > 1
    assert lifecycle.read_entries(spark, str(tmp_path / "r")).count() == 120


def test_expanded_pairs_read_their_entries_once(spark):
    rows = spark.range(400).select(F.concat(F.lit("d"), F.col("id") % 6).alias("database_id"), F.lit("target").alias("kind"), (F.col("id") % 90).cast("string").alias("sequence_id"), F.lit("s").alias("sequence_hash"), F.lit("w").alias("description_hash"))
    found = registry.expanded_pairs(rows)
    assert "Range (" not in found._jdf.queryExecution().optimizedPlan().toString()
    columns = ["kind", "low", "high", "shared_ids", "shared_descriptions", "matching_shared_ids"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, registry.pair_stats(rows).select(*columns).collect()))
