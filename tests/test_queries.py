"""Every query with SQL against that SQL, on the smallest tables; and properties of the graph loops."""

import pytest

from oracle import compare

SF = "/root/testdata/sf0.001"


def test_sql_queries_equal_their_oracle(spark):
    from lithoframe.plans import registry

    assert compare(spark, SF, sorted(registry.ORACLES)) == {}


def test_heights_refuse_a_cycle(spark):
    from lithoframe.operators.graph import heights

    with pytest.raises(ValueError):
        heights(spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "parent long, child long"))


def test_floor_division_is_exact():
    import duckdb

    from lithoframe.plans.compiler import oracle

    with duckdb.connect() as c:
        for a in (-7, -6, -1, 0, 5, 2**60 + 1):
            assert c.execute(f"SELECT {oracle(f'@floor({a}, 3)')}").fetchone()[0] == a // 3
