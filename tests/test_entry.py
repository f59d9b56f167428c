"""The registry: names, SQL counterparts, and its independence from the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_registry(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    rows = entry.entry(spark)
    assert rows.columns == ["position", "block"] and rows.count() > 0


def test_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op1') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=120)


def test_an_unrelated_missing_module_is_an_error(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    bad = tmp_path / "copy/meshwright/llm"
    bad.mkdir(exist_ok=True)
    (bad / "__init__.py").write_text("")
    (bad / "queries.py").write_text("import no_such_module\n")
    (tmp_path / "copy/corpus_pipeline.py").write_text("")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr


def test_package_is_shipped_where_workers_lack_it(spark, monkeypatch, tmp_path):
    from meshwright import deploy

    monkeypatch.setenv("PYTHONPATH", "")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(deploy, "_shipped", set())
    assert not deploy.importable()
    deploy.ship(spark)
    assert spark.range(1).mapInPandas(lambda parts: (p.assign(id=len(__import__("meshwright").__name__)) for p in parts), "id bigint").first().id == 10
