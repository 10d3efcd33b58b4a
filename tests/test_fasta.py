import bz2
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from strandlake.operators.classify import kind, labels, namespace, peel
from strandlake.operators.formats import diagnostics, enrich
from strandlake.operators.lifecycle import entries_of, open_registry, problems, rebuild
from strandlake.sources import tables
from strandlake.sources.fasta import basic_frame, discover, file_checksums, file_name_parts, parse_text, proteins, read_records
from strandlake.streaming.index import stream_index

AWKWARD = "\n\r\n>P1 first\tone\r\nAC\r\nDE\r\n>\r\nFG\n  >x\nHI\n>>P4\nAA**"


def rows(frame, *columns):
    return [tuple(r) for r in frame.orderBy("record_ordinal").select(*columns).collect()]


def test_awkward_text(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_bytes(AWKWARD.encode())
    for records in (read_records(spark, str(path)), parse_text(spark, AWKWARD)):
        found = rows(proteins(records), "id", "description", "sequence")
        assert found == [("P1", "first one", "ACDE"), ("", None, "FG>XHI"), ("P4", None, "AA*")]


def test_compressed_files_and_checksums(spark, tmp_path):
    text = ">P1 a\nac d*\n>P2\nEF\n"
    (tmp_path / "a.fasta.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "b.fasta.bz2").write_bytes(bz2.compress(text.encode()))
    (tmp_path / "c.txt").write_text("no")
    assert basic_frame(spark, str(tmp_path / "*.fasta.*")).count() == 4
    assert sorted(r["sequence"] for r in basic_frame(spark, str(tmp_path / "a.fasta.gz")).collect()) == ["ACD", "EF"]
    assert discover(spark, str(tmp_path)).count() == 2
    [made] = file_checksums(spark, str(tmp_path / "c.txt")).collect()
    assert made["md5"] == hashlib.md5(b"no").hexdigest()


def test_content_before_the_first_header_raises(spark, tmp_path):
    (tmp_path / "bad.fasta").write_text("\n >P1\nAA\n")
    with pytest.raises(Exception, match="content before the first header"):
        read_records(spark, str(tmp_path / "bad.fasta")).collect()


def test_file_name(spark):
    [row] = spark.range(1).select(file_name_parts(F.lit("R_db_9606_d_20200101_20210203.fasta.gz")).alias("p")).select("p.*").collect()
    assert (row["database"], str(row["date"]), row["is_decoy"], row["is_entrapment"]) == ("db_9606_20200101", "2021-02-03", True, False)


def classified(spark, ids):
    frame = spark.createDataFrame([(i,) for i in ids], "id string").withColumn("p", peel(F.col("id"))).withColumn("l", labels(F.col("p")))
    return {r["id"]: (r["p"]["bare"], r["l"], r["k"], r["n"]) for r in frame.select("id", "p", "l", kind(F.col("l")).alias("k"), namespace(F.col("p.bare")).alias("n")).collect()}


def test_peeling_to_a_fixed_point(spark):
    found = classified(spark, ["REV_CON__sp|P12345|X_HUMAN", "sp|Cont_P1|Y_Z", "REV_REV_CON_q", "sp|a_p_target|b_c", "gi|1|x", "P12345", "odd"])
    assert found["REV_CON__sp|P12345|X_HUMAN"] == ("sp|P12345|X_HUMAN", ["contaminant", "decoy"], "decoy", "uniprot")
    assert found["sp|Cont_P1|Y_Z"] == ("sp|P1|Y_Z", ["contaminant"], "contaminant", "uniprot")
    assert found["REV_REV_CON_q"][:2] == ("q", ["contaminant", "decoy"])
    assert found["sp|a_p_target|b_c"][1:3] == (["entrapment"], "entrapment")
    assert [found[i][3] for i in ("gi|1|x", "P12345", "odd")] == ["gi|", "uniprot_bare", "unmatched"]


def test_mixed_formats(spark):
    frame = spark.createDataFrame([("sp|P1|A_HUMAN", "Name OS=Homo sapiens OX=9606 GN=G PE=1 SV=2", "A"), ("ref|NP_000001.1|", "thing [Mus musculus]", "C"), ("zz", None, "D")], "id string, description string, sequence string")
    out = {r["id"]: r for r in enrich(frame).collect()}
    first = out["sp|P1|A_HUMAN"]
    assert (first["database"], first["accession"], first["organism_name"], first["taxonomy_id"], first["sequence_version"]) == ("uniprotkb", "P1", "Homo sapiens", 9606, 2)
    assert (out["ref|NP_000001.1|"]["protein_name"], out["ref|NP_000001.1|"]["organism_name"]) == ("thing", "Mus musculus")
    assert out["zz"]["database"] is None and out["zz"]["is_decoy"] is False
    assert enrich(frame, strict=True).columns == ["id", "description", "sequence"]
    assert {(r["format"], r["matched_rows"], r["status"]) for r in diagnostics(frame).collect()} == {("uniprotkb", 1, "partial"), ("refseq", 1, "partial")}


def test_writers(spark, tmp_path):
    frame = spark.createDataFrame([(0, "P1 x", "A" * 61), (1, "P2", "")], "n int, raw_header string, sequence string")
    tables.write_fasta(frame, str(tmp_path / "out"), order=["n"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == ">P1 x\n" + "A" * 60 + "\nA\n>P2\n"
    with pytest.raises(ValueError, match="unknown suffix"):
        tables.write_export(frame, str(tmp_path / "x.xls"))
    tables.write_versioned(frame, str(tmp_path / "v"), {"version": 1})
    assert tables.read_versioned(spark, str(tmp_path / "v"), {"version": 1}).count() == 2
    with pytest.raises(ValueError, match="configuration"):
        tables.read_versioned(spark, str(tmp_path / "v"), {"version": 2})
    with pytest.raises(ValueError, match="not a peptides table"):
        tables.read_table(spark, str(tmp_path / "v"), "peptides")


def test_registry_on_disk_and_stream(spark, tmp_path):
    source, root, streamed = tmp_path / "in", str(tmp_path / "reg"), str(tmp_path / "streamed")
    source.mkdir()
    (source / "a.fasta").write_text(">sp|P1|A_B x\nAAAK\n>REV_sp|P1|A_B x\nKAAA\n>aa|Cont_one|d\nMK\n>zz\nCCC\n")
    (source / "b.fasta").write_text(">sp|P1|A_B x\nAAAK\n>sp|P2|A_B\nCCK\n")
    made = entries_of(proteins(read_records(spark, str(source))))
    rebuild(made, root)
    held = open_registry(spark, root)
    assert problems(held["entries"], held["kind_stats"], held["pair_stats"]).count() == 0
    [pair] = held["pair_stats"].where("kind = 'target'").collect()
    assert (pair["shared_ids"], pair["shared_exact_pairs"]) == (1, 1)
    assert held["entries"].where("contaminant_group = 'one'").count() == 1
    stream_index(spark, str(source), streamed, str(tmp_path / "log")).awaitTermination()
    other = open_registry(spark, streamed)
    names = ["kind", "entries", "distinct_ids", "distinct_sequences"]
    assert sorted(map(tuple, other["kind_stats"].select(*names).collect())) == sorted(map(tuple, held["kind_stats"].select(*names).collect()))


