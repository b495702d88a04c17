"""Every registered query against its SQL on the smallest tables; those without SQL run and keep their schema."""

import pytest
from conftest import same

from lumenreel.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = plans.QUERIES[name](spark, sf_dir)
    if name in plans.ORACLE_SQL:
        same(df, duck.sql(plans.ORACLE_SQL[name]))
    else:
        assert df.count() > 0
