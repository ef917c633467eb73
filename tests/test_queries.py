import pytest

from mailspark.plans import registry
from tests.oracle import same

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
#: Without a twin, and covered by their own tests in test_models.py.
SKIP = {"cross_validate", "calibrate_isotonic", "train_logreg"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(spark, name):
    same(spark, registry.queries()[name], SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - SKIP))
def test_query_without_twin_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0
