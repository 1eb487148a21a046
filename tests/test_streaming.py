from setloom.streaming.probe import growing_join, probe_stream

SCHEMA = "rid long, tokens array<int>"


def test_probe(spark, tmp_path):
    spark.createDataFrame([(10, [1, 2, 3]), (11, [7, 8])], SCHEMA).write.parquet(str(tmp_path / "in"))
    indexed = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 3, 4])], SCHEMA)
    probe_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), indexed, str(tmp_path / "out"), str(tmp_path / "cp"), threshold=0.7).awaitTermination()
    assert {(r.rid1, r.rid2, r.sim) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 10, 1.0), (2, 10, 0.75)}


def test_growing(spark, tmp_path):
    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        growing_join(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp"), threshold=0.5).awaitTermination()

    feed([(1, [1, 2]), (2, [1, 2, 3])])
    feed([(3, [1, 2, 3]), (4, [9])])
    assert {(r.rid1, r.rid2) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 2), (1, 3), (2, 3)}
