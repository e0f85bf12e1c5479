import __spark_entry__ as entry


def test_catalog_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"chrom", "start", "stop", "score"}
