"""Votes over readings that stand side by side."""

from paperloom.operators import votes


def test_substring_vote_is_without_a_shuffle(spark):
    rows = [(1, "ab" * 40), (2, "1234567890" * 8), (3, "x" + "1234567890" * 7), (4, None), (5, ""), (6, "short"), (7, "0123456789" * 2), (7, "0123456789" * 3 + "0")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = votes.substring_vote(df, ["k"], "t")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    # 3: of equally near windows the first seen in order of j, then i
    assert sorted(map(tuple, got.collect())) == [(1, "abababababab"[:10]), (2, "1234567890"), (3, "0123456789"), (4, ""), (5, ""), (6, ""), (7, ""), (7, "0123456789")]
