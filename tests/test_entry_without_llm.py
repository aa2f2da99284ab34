"""The driver may delete the training-data subpackage and the pipeline: the entry must still import."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(block: str) -> list[str]:
    code = f"import sys; sys.path.insert(0, {ROOT!r}); {block}import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split()


def test_entry_imports_without_the_subpackage():
    without = names("sys.modules['wattle.llm'] = None; sys.modules['corpus_pipeline'] = None; ")
    assert "lg1_engagement_fytd" in without and "pipeline" not in without and not any(n.startswith("op1_") for n in without)


def test_a_broken_subpackage_is_an_error():
    code = f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules['xxhash'] = None; import __spark_entry__"
    installed = os.path.isdir(os.path.join(ROOT, "wattle", "llm"))
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT)
    assert (run.returncode != 0) == installed
