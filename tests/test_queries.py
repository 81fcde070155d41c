"""Every registered query of the engine against its DuckDB counterpart, and that it runs without the optional subpackage."""

import math
import subprocess
import sys
from pathlib import Path

import pytest

from terrane.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


def plain(rows):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "as_integer_ratio") and not isinstance(x, bool) else str(x)

    return sorted((tuple(value(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLE:
        assert got.count() > 0
        return
    want = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(tuple(r) for r in got.select([f"`{c}`" for c in columns]).collect()) == plain(want.fetchall())


def test_entry_point_with_the_pipeline_but_without_the_subpackage(tmp_path):
    """An empty folder of the subpackage is none; an error inside it is not passed over."""
    (tmp_path / "terrane").mkdir()
    for part in (ROOT / "terrane").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "terrane" / part.name).symlink_to(part)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            (tmp_path / name).write_text((ROOT / name).read_text())
    run = lambda code: subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    code = "import __spark_entry__ as e; assert 'r08_vulnerability' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    assert run(code).returncode == 0
    (tmp_path / "terrane" / "llm" / "__pycache__").mkdir(parents=True)
    assert run(code).returncode == 0
    (tmp_path / "corpus_pipeline.py").write_text("")
    (tmp_path / "terrane" / "llm" / "__init__.py").write_text("")
    (tmp_path / "terrane" / "llm" / "queries.py").write_text("import no_such_module")
    assert "no_such_module" in run(code).stderr


def test_entry_point_without_the_optional_parts(tmp_path):
    for part in ("__spark_entry__.py", "terrane"):
        (tmp_path / part).symlink_to(ROOT / part) if part.endswith(".py") else None
    (tmp_path / "terrane").mkdir()
    for part in (ROOT / "terrane").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "terrane" / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'r08_vulnerability' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
