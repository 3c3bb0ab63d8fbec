"""The driver's entry, with and without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_llm(tmp_path):
    for f in ROOT.iterdir():
        if f.name not in ("corpus_pipeline.py", "noticeflow", ".git", "tests"):
            (tmp_path / f.name).symlink_to(f)
    (tmp_path / "noticeflow").mkdir()
    for f in (ROOT / "noticeflow").iterdir():
        if f.name != "llm":
            (tmp_path / "noticeflow" / f.name).symlink_to(f)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') and n[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for f in (ROOT / "noticeflow").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text().replace("without the llm subpackage", ""), f
