import __spark_entry__ as entry


def test_names_and_sql_belong_together():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert len(entry.queries()) > 40


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["peptide", "occurrences", "proteins"]
    assert rows.count() > 0
