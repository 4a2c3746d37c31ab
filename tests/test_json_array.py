"""Arrays read in splits against reading them whole."""
import json

import pytest

from winnowry.sources.readers import read_json_array

ROWS = [
    {"id": 0, "text": "plain", "in": {"a": [1, {"b": 2}]}}, {"id": 1, "text": "brackets } ] [ { in \" a string", "in": None}, {"id": 2, "text": "back \\ slash \\\" } end\\", "in": {"a": []}},
    {"id": 3, "text": "", "in": {"a": [{"b": 5}, {"b": 6}]}}, {"id": 4, "text": "日本語}「」\n\t", "in": {}}, {"id": 5, "text": "\\\\}\\\\\"", "in": None}, *({"id": k, "text": "}" * (k % 7) + "\"" * (k % 3), "in": {"a": [k]}} for k in range(6, 60)),
]
DDL = "id long, text string"


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_splits_equal_whole(spark, tmp_path, indent, split):
    where = tmp_path / "rows.json"
    where.write_text(json.dumps(ROWS, ensure_ascii=False, indent=indent))
    (tmp_path / "items.json").write_text(json.dumps({"version": "1}[", "items": ROWS}, indent=indent))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        for path, depth in ((where, 1), (tmp_path / "items.json", 2)) if split > 64 else ((where, 1),):
            rows = read_json_array(spark, str(path), DDL, depth)
            assert sorted((r["ordinal"], r["id"], r["text"]) for r in rows.collect()) == [(k, r["id"], r["text"]) for k, r in enumerate(ROWS)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_several_files_and_none(spark, tmp_path):
    folder = tmp_path / "folder"
    folder.mkdir()
    (folder / "a.json").write_text("[]")
    (folder / "b.json").write_text(json.dumps(ROWS[:3]))
    (folder / "c.json").write_text(json.dumps(ROWS[3:5]))
    assert [r["id"] for r in read_json_array(spark, str(folder), DDL).orderBy("ordinal").collect()] == [0, 1, 2, 3, 4]
    (tmp_path / "empty.json").write_text(" [ ] ")
    assert read_json_array(spark, str(tmp_path / "empty.json"), DDL).count() == 0


def test_a_malformed_object_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"id": 1}, {"id": x}]')
    with pytest.raises(Exception):
        read_json_array(spark, str(tmp_path / "bad.json"), DDL).collect()
