from strandlake.cli import main
from strandlake.sources import tables


def test_from_fasta_to_comparison(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(">sp|P1|A_B Name OS=X OX=1\nACDEFGHK\nLMNPQRSTVWYK\n>sp|P2|C_D\nACDEFGHKAAAAAAAAK\n")
    main(["table", p("in/a.fasta"), p("table.parquet")], spark)
    assert spark.read.parquet(p("table.parquet")).count() == 2
    main(["prepare", p("in/a.fasta"), p("input"), "--source", "s"], spark)
    main(["build", p("input"), p("inventory")], spark)
    main(["decoy", p("inventory"), p("search")], spark)
    held = tables.read_inventory(spark, p("search"))
    assert sorted((r["final_order"], r["kind"]) for r in held.collect()) == [(0, "target"), (1, "target"), (2, "decoy"), (3, "decoy")]
    main(["peptides", p("search"), p("peptides")], spark)
    main(["pepcompare", p("peptides/peptides"), p("peptides/peptides"), p("compared")], spark)
    rows = {r["population"]: r for r in tables.read_table(spark, p("compared"), "peptide_comparison").collect()}
    assert rows["all"]["jaccard"] == 1.0 and rows["contaminant"]["jaccard"] == 0.0
    main(["derive-input", p("search"), p("derived"), "--source", "d"], spark)
    assert tables.read_table(spark, p("derived"), "protein_input").count() == 2
