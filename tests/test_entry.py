"""The driver's contract: every query gives the same columns twice, with SQL for known names; what is missing takes nothing else along."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from inkgrid import registry


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "ok" in df.columns


def test_core_queries_have_columns_of_different_names(spark):
    for name, made in registry.QUERIES.items():
        names = made(spark, __spark_entry__.SMOKE_DIR).columns
        assert names and len(names) == len(set(names)), name
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["form_document", "task_current", "comparison_document"])
def test_queries_give_the_same_twice(spark, name):
    one, two = (registry.QUERIES[name](spark, __spark_entry__.SMOKE_DIR) for _ in range(2))
    assert one.schema == two.schema and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_a_missing_library_takes_no_core_query_along():
    """With a library of the subpackage gone, the core's queries are all there."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); from inkgrid import registry; assert set(registry.QUERIES) <= set(q) and 'op3_quality' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__spark_entry__.__file__).parent)
