import os
import subprocess
import sys

from tests.conftest import ROOT

SF = "/root/testdata/sf0.001"


def test_queries_run_and_agree_with_sql(spark):
    """A few of the registered queries against their SQL, on the smallest tables."""
    import duckdb
    import pytest

    from helixframe import queries as core

    if not os.path.isdir(SF):
        pytest.skip("the tables are not here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    for name in ("q02_base_composition", "q16_site_pairs_theta", "q26_hamming_transitions", "q31_hmm_forward", "q36_two_paralog_hky_igc", "q41_tree_pruning"):
        df = core.queries()[name](spark, SF)
        got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
        r = con.execute(core.oracle_sql()[name])
        at = [x[0] for x in r.description]
        assert sorted(at) == sorted(df.columns), name
        assert got == sorted(tuple(x[at.index(c)] for c in sorted(at)) for x in r.fetchall()), name


def test_entry_without_the_pipeline_folders(tmp_path):
    """What is left imports and registers its queries when the subpackage and corpus_pipeline.py are gone."""
    import shutil

    shutil.copytree(os.path.join(ROOT, "helixframe"), tmp_path / "helixframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)


def test_every_query_with_sql_is_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_has_rows(spark):
    import pytest

    import __spark_entry__ as e

    if not os.path.isdir(SF):
        pytest.skip("the tables are not here")
    assert e.entry(spark).count() > 0
