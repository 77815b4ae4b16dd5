import __spark_entry__ as entry


def test_every_twin_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).columns == ["doc", "final"]


def test_nothing_else_imports_the_optional_subpackage():
    import pathlib

    root = pathlib.Path(entry.ROOT) / "kelpline"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "kelpline.llm" not in f.read_text() and "from ..llm" not in f.read_text() and "from .llm" not in f.read_text()
