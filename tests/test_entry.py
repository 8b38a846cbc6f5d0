def test_contract():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert set(df.columns) == {"aspect", "negative", "neutral", "positive", "total"}
    assert df.count() >= 0


def test_entry_reads_no_file_at_import():
    """The entry imports and builds its SQL in a fresh process that sees no jar folder, from another working folder."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import glob, zipfile\n"
            "glob.glob = lambda *a, **k: []\n"
            "def no(*a, **k): raise FileNotFoundError(a)\n"
            "zipfile.ZipFile = no\n"
            "import __spark_entry__ as e\n"
            "assert len(e.oracle_sql()) >= 60\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/", env=os.environ | {"PYTHONPATH": repo})
