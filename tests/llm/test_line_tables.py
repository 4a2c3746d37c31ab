"""Line dedup writes few tables: counters many to a row, and only classes that tell a line more than the line itself does."""
from winnowry.llm import _store
from winnowry.llm import line_dedup as m


def test_tables_that_line_dedup_writes(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(m, "materialise", lambda df, name: made.setdefault(name, _store.materialise(df, name)))
    long = "a b c d e f g h i j k l m n o p q r s t"
    texts = ["x y\nz", f"{long}\nx y", long.replace("a b", "a v"), None, "w\n\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["line"]): (r["class_id"], r["class_line"], r["n_links"], r["removed"]) for r in m.duplicate_lines(rows).collect()}
    assert got == {
        (0, 0): (0, 0, 0, False), (0, 1): (0, 1, 0, False), (1, 0): (1, 0, 1, False), (1, 1): (0, 0, 0, True), (2, 0): (2, 0, 1, True),
        (3, 0): (None, None, 0, False), (4, 0): (4, 0, 0, False), (4, 1): (None, None, 0, False), (4, 2): (None, None, 0, False),
    }
    assert list(made) == ["lines", "classes", "found", "partners", "told"]
    assert 0 < made["lines"].where("bucket is not null").count() <= 3 * m.COUNTERS // m.ROW_COUNTERS
    assert made["classes"].count() == 5 and made["told"].count() == 3
