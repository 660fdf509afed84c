"""Every exam query equals its DuckDB oracle on the smallest tables."""

import pytest

from paths import SF_SMALL


@pytest.fixture(scope="module")
def report(spark):
    from examlytics.plans import catalog
    from tools.check_oracle import check
    return check(spark, SF_SMALL, sorted(catalog.QUERIES))


def test_all_queries_match_oracle(report):
    bad = {k: v for k, v in report.items() if v.get("ok") is not True}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0].total == 1000
