"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, set(s) <= set(q))"


def look(root) -> list[str]:
    done = subprocess.run([sys.executable, "-c", LOOK], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_without_the_optional_parts(tmp_path):
    ignore = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    for keep_pipeline in (True, False):
        to = tmp_path / str(keep_pipeline)
        shutil.copytree(ROOT, to, ignore=ignore)
        if not keep_pipeline:
            (to / "corpus_pipeline.py").unlink(missing_ok=True)
        n, ops, pipeline, covered = look(to)
        assert int(n) > 60 and ops == "0" and pipeline == "False" and covered == "True"


def test_other_import_errors_are_not_hidden(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    (tmp_path / "r" / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "no_such_module" in done.stderr
