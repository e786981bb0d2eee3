"""The driver contract without the optional text subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SHOW = "import __spark_entry__ as e; names = set(e.queries()); print(len(names), any(n.startswith('op') for n in names), 'pipeline' in names, set(e.oracle_sql()) <= names)"


def _run(folder):
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_imports_without_text_subpackage(tmp_path):
    """With the subpackage gone the rest imports, whether the pipeline's file is left behind or not."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    n, any_op, pipeline, subset = _run(tmp_path)
    assert int(n) > 150 and any_op == "False" and pipeline == "False" and subset == "True"
    if os.path.exists(tmp_path / "corpus_pipeline.py"):
        os.unlink(tmp_path / "corpus_pipeline.py")
    assert _run(tmp_path)[0] == n
