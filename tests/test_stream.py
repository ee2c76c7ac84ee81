"""The stream reads a table that is one file and one that is a folder of part files."""

from graphloom.streaming.diagnostics import replay

SF = "/root/testdata/sf0.001"


def test_folder_of_parts(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(map(tuple, replay(spark, SF).collect()))
    assert want and sorted(map(tuple, replay(spark, str(tmp_path)).collect())) == want
