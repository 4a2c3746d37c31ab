"""Queries against their SQL on small tables on which they once differed."""
import __spark_entry__
import duckdb


def same(spark, folder, name, **tables):
    """Rows of the query and of its SQL, over tables written to the folder."""
    db = duckdb.connect()
    for k, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/{k}.parquet")
        db.execute(f"CREATE VIEW {k} AS SELECT * FROM '{folder}/{k}.parquet/*.parquet'")
    found = __spark_entry__.queries()[name](spark, str(folder))
    wanted = db.execute(__spark_entry__.oracle_sql()[name])
    at = [[x[0] for x in wanted.description].index(c) for c in found.columns]
    got, want = sorted(map(tuple, found.collect()), key=repr), sorted((tuple(r[k] for k in at) for r in wanted.fetchall()), key=repr)
    assert got == want and got
    return got


def test_dev_split_rounds_down(spark, tmp_path):
    # 30 keys: 1.5 of them are dev; rows that repeat a key go where it goes, and rows without one are train
    rows = [(k,) for k in range(30)] + [(3,), (4,), (None,)]
    got = same(spark, tmp_path, "q_dev_split", documents=(rows, "doc_id long"))
    assert len({k for k, part in got if part == "dev"}) == 1 and len(got) == 33


def test_session_memory_of_conversations_far_apart(spark, tmp_path):
    # conversation 0 goes on in the second part, when those numbered 5000 are in the stream; turn 2 of conversation 0 comes twice
    rows = [(c, t, ("user", "assistant")[t % 2], f"m{c}.{t}") for c in (0, 1, 5000, 5001) for t in range(12)] + [(0, 2, "user", "a tie")]
    got = same(spark, tmp_path, "q_session_memory", conversations=(rows, "conv_id long, turn long, role string, text string"))
    assert {"0", "1", "5000", "5001"} == {r[0] for r in got if r[1] > 8}
