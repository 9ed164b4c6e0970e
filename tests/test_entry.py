"""The driver's entry: core queries work where the llm subpackage, or a library it needs, is missing."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def listed(code, cwd):
    script = f"import sys; sys.path.insert(0, {str(cwd)!r})\n{code}\nimport __spark_entry__ as e\nprint(len([q for q in e.queries() if not q.startswith('op') and q != 'pipeline']), len(e.oracle_sql()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", script], cwd=cwd, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]
    return done.stdout.split()


def copy(tmp_path):
    import shutil

    shutil.copytree(os.path.join(ROOT, "tessera"), tmp_path / "tessera")
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, f)):
            shutil.copy(os.path.join(ROOT, f), tmp_path)
    return tmp_path


def test_entry_without_llm(tmp_path):
    from tessera.plans import catalog

    at = copy(tmp_path)
    core = str(len(catalog.queries()))
    missing = "import sys; sys.modules['ahocorasick'] = None"
    assert listed(missing, at)[0] == core
    import shutil

    (at / "corpus_pipeline.py").unlink(missing_ok=True)
    assert listed("", at)[0] == core and listed("", at)[2] == "False"
    shutil.rmtree(at / "tessera" / "llm", ignore_errors=True)
    assert listed("", at) == [core, str(len(catalog.oracle_sql())), "False"]
