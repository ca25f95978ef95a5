import ast
import os

from tests.conftest import ROOT


def test_nothing_else_imports_the_optional_folder():
    for folder, _, names in os.walk(os.path.join(ROOT, "ledgerloom")):
        if os.path.relpath(folder, ROOT).split(os.sep)[:2] == ["ledgerloom", "llm"]:
            continue
        for name in names:
            if name.endswith(".py"):
                for node in ast.walk(ast.parse(open(os.path.join(folder, name)).read())):
                    found = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any(f.startswith("ledgerloom.llm") for f in found), (folder, name)


def test_entry_imports():
    import __spark_entry__

    assert "recon_summary" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_bears_absent_packages(monkeypatch):
    import builtins
    import importlib
    import sys

    import __spark_entry__

    plain = builtins.__import__

    def absent(name, *more, **kw):
        if name.split(".")[0] in ("public_tokenizers", "regex"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return plain(name, *more, **kw)

    for name in [m for m in sys.modules if m.startswith("ledgerloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", absent)
    importlib.invalidate_caches()
    assert "recon_summary" in __spark_entry__.queries() and not any(n.startswith("op2") for n in __spark_entry__.queries())
