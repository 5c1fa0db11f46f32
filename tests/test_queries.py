"""Every registered query of the core against its SQL, and what the registry does without the optional subpackage."""

import glob
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from cadenza.plans import catalogue, catalogue_library, catalogue_saved, oracles, oracles_library, oracles_saved

QUERIES = catalogue.QUERIES | catalogue_library.QUERIES | catalogue_saved.QUERIES
ORACLES = oracles.ORACLES | oracles_library.ORACLES | oracles_saved.ORACLES

SF_DIR = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def rows(frame, columns):
    def shown(x):
        x = x.item() if hasattr(x, "item") else x
        if x is None or str(x) in ("<NA>", "NaT") or isinstance(x, float) and math.isnan(x):
            return ""
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else repr(x)

    return sorted(zip(*([shown(x) for x in frame[c].tolist()] for c in columns), strict=True))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF_DIR).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("gone", [["cadenza/llm", "tests/llm"], ["cadenza/llm", "tests/llm", "corpus_pipeline.py"]])
def test_registry_without_the_optional_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *(Path(x).name for x in gone)))
    assert not any((copy / x).exists() for x in gone)
    code = """
import __spark_entry__ as e
assert not [q for q in e.queries() if q.startswith("op") or q == "pipeline"], sorted(e.queries())
assert set(e.oracle_sql()) == set(e.queries())
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYTEST_")}
    others = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x and Path(x).resolve() != REPO]  # what the run needs besides this repository
    env |= {"PYTHONPATH": os.pathsep.join([str(copy), *others]), "PYTHONDONTWRITEBYTECODE": "1"}
    for command in (["-c", code], ["-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "--rootdir", str(copy), "tests"]):
        done = subprocess.run([sys.executable, *command], cwd=copy, env=env, timeout=300, capture_output=True, text=True)
        assert done.returncode == 0, f"{command}\n{done.stdout[-3000:]}\n{done.stderr[-3000:]}"
