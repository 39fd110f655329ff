"""Every registered query against its SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from compare import compare, connect
from conftest import SMALL
from quern.suite.oracles import SQL
from quern.suite.queries import QUERIES


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_keys():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(contract.queries())


WITHOUT = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[:2] == ["quern", "llm"] or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as contract
from quern.suite.queries import QUERIES
assert set(contract.queries()) == set(QUERIES) and contract.oracle_sql()
"""


def test_without_the_training_data_folder():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=Path(__file__).parent.parent, check=True)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["doc_id", "matched_phrases", "excerpt"] and df.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    ok, note = compare(spark, connection, SMALL, name)
    assert ok, note
