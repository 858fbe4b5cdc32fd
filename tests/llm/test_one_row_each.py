"""Near duplicates go row by row."""

from collections import Counter

from blockyard.llm import jaccard_join


def test_rows_not_ids(spark):
    a, b, c, d, e = ("a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x", "one two three four five six")
    rows = [(1, a, "x"), (3, a, "x"), (3, b, "x"), (None, a, "x"), (None, c, "x"), (None, d, "y"), (None, d, "x"), (5, e, "z"), (5, e, "x"), (6, None, "x"), (6, None, "x"), (7, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(tuple(r) for r in jaccard_join.one_of_each(df).collect())
    assert got == Counter([(1, a, "x"), (3, b, "x"), (None, c, "x"), (None, d, "x"), (5, e, "x"), (6, None, "x"), (6, None, "x"), (7, " ", "x")])


def test_near_copies_of_one_id(spark):
    long = [f"word{i}" for i in range(80)]
    rows = [(2, " ".join(long)), (2, " ".join(long[:-1] + ["other"])), (None, " ".join(long[:-1] + ["third"])), (2, "quite another text of many words")]
    got = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 2 and {r["doc_id"] for r in got} == {2}
