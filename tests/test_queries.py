"""Every query of the catalog against its SQL, on the smallest tables."""

import numpy as np
import pandas as pd
import pytest

from granary.plans.catalog import QUERIES, SQL

from .conftest import SF


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), tables.execute(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    ours, theirs = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert len(ours) == len(theirs)
    for c in columns:
        if "f" in (ours[c].dtype.kind, theirs[c].dtype.kind):
            np.testing.assert_allclose(pd.to_numeric(ours[c]).to_numpy(float), pd.to_numeric(theirs[c]).to_numpy(float), rtol=0, atol=1e-9)
        else:
            assert ours[c].astype(str).tolist() == theirs[c].astype(str).tolist(), c


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
