"""Line dedup on lines of few different words."""
from winnowry.llm import line_dedup


def test_lines_of_few_words_are_deduplicated(spark):
    texts = ["All rights reserved.\nx\n\nno no no no no no no no no no no no", "all RIGHTS  reserved.\na b c d e\nX\n", "a b c d e\nd c b a\na b c d\nrights reserved. all\na b c d e f\na b c d e f g\n\nno no"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["line"]): ((r["class_id"], r["class_line"]), r["n_links"], r["removed"]) for r in line_dedup.duplicate_lines(rows).collect()}
    none = ((None, None), 0, False)
    assert got == {
        (0, 0): ((0, 0), 0, False), (0, 1): ((0, 1), 0, False), (0, 2): none, (0, 3): ((0, 3), 0, False),
        (1, 0): ((0, 0), 0, True), (1, 1): ((1, 1), 0, False), (1, 2): ((0, 1), 0, True), (1, 3): none,
        (2, 0): ((1, 1), 0, True), (2, 1): ((2, 1), 0, False), (2, 2): ((2, 1), 0, True), (2, 3): ((0, 0), 0, True),
        (2, 4): ((2, 4), 1, False), (2, 5): ((2, 5), 1, True), (2, 6): none, (2, 7): ((0, 3), 0, True),
    }
    assert [r["text"] for r in line_dedup.drop_lines(rows).orderBy("doc_id").collect()] == [texts[0], "a b c d e\n", "d c b a\na b c d e f\n"]
