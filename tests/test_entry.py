"""The driver's entry with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
WITHOUT = """
import sys
sys.path.insert(0, {root!r})
sys.modules[{module!r}] = None
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), "flagship" in e.queries(), set(e.oracle_sql()) <= set(e.queries()))
"""


def test_a_missing_library_costs_only_its_queries():
    import strandgrid.entries as tables

    for module in ("ahocorasick", "tokenizers", "corpus_pipeline", "strandgrid.llm"):
        run = subprocess.run([sys.executable, "-c", WITHOUT.format(root=ROOT, module=module)], capture_output=True, text=True, timeout=120)
        n, sql, flagship, subset = run.stdout.split()
        assert int(n) >= len(tables.QUERIES) and int(sql) >= len(tables.ORACLE_SQL) and (flagship, subset) == ("True", "True"), run.stderr


def test_every_table_query_has_sql():
    import strandgrid.entries as tables

    assert set(tables.QUERIES) == set(tables.ORACLE_SQL)
