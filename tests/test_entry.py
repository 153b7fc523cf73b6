import ast
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_oracles_belong_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6


def test_imports_without_the_subpackage(tmp_path):
    code = f"import sys; sys.path.insert(0, {ROOT!r})\nimport importlib.abc\nclass Block(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith(('larkspur.llm', 'corpus_pipeline')):\n            raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, Block())\nimport __spark_entry__ as e\nassert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries() if n[2:3].isdigit() or n == 'pipeline')"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "larkspur")):
        if os.sep + "llm" in folder:
            continue
        for n in (n for n in names if n.endswith(".py")):
            for node in ast.walk(ast.parse(open(os.path.join(folder, n), encoding="utf-8").read())):
                if isinstance(node, (ast.Import, ast.ImportFrom)):
                    assert "llm" not in ast.dump(node)
