"""The core stands without the llm subpackage."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_core_does_not_import_llm():
    for path in (ROOT / "aerolith").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"aerolith[. ]+(import )?llm", path.read_text()), path


def test_entry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert {f"p{i}_found" for i in (1, 2, 3, 4, 5, 6)} <= set(names)
