import os

from voxledger import session


def test_written_and_cleared(spark):
    session.clear_written(spark)
    df = session.written(spark.range(3).selectExpr("id", "cast(null as string) AS t"))
    assert df.count() == 3 and df.columns == ["id", "t"]
    path = session.WRITTEN[0].removeprefix("file:")
    assert os.path.isdir(path)
    assert session.clear_written(spark) == 1 and not os.path.exists(path)


def test_cut(spark):
    assert session.cut(spark.range(5)).count() == 5
