from pyspark.sql import functions as F

from waymark import sources


def test_tables_and_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") % 3)
    assert sources.write_table(df, f"{tmp_path}/t.parquet", ("x",)) == 10
    assert sources.write_table(df.limit(0), f"{tmp_path}/e.parquet") == 0
    t = sources.load_tables(spark, str(tmp_path), ["t"])["t"]
    assert t.count() == 10 and spark.sql("SELECT count(*) FROM t").first()[0] == 10
    assert sources.scan(spark, f"{tmp_path}/t.parquet", ["id"]).columns == ["id"]
    assert sources.write_tracks({"strict": df.limit(4), "retro": df.withColumn("y", F.lit(1))}, f"{tmp_path}/b.parquet") == 14
    assert {r.track: r["count"] for r in spark.read.parquet(f"{tmp_path}/b.parquet").groupBy("track").count().collect()} == {"strict": 4, "retro": 10}
    sources.write_csv(df, f"{tmp_path}/c.csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c.csv").count() == 10
    checks = spark.createDataFrame([("a", True, "")], "assertion string, pass boolean, detail string")
    assert sources.write_checks(checks, f"{tmp_path}/k.json") == 1


def test_headers_are_read_once(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.hea").write_text(f"{n} 12 500\nrest\n")
    done = spark.createDataFrame([], "path string, header string")
    first = sources.ingest_headers(spark, f"{tmp_path}/*.hea", done)
    assert sorted(r.header for r in first.collect()) == ["a 12 500", "b 12 500"]
    done = first.where(F.col("header").startswith("a"))
    assert [r.header for r in sources.ingest_headers(spark, f"{tmp_path}/*.hea", done).collect()] == ["b 12 500"]


def test_only_the_heads_of_files_are_read(spark, tmp_path):
    import io

    class Counting(io.BytesIO):
        n = 0

        def read(self, size=-1):
            self.n += (got := len(x := super().read(size)))
            assert size > 0 and got <= size
            return x

    long = Counting(b"first\r\nsecond\nthird\n" + b"x" * 10_000_000)
    assert sources.first_lines(long, 2) == "first\nsecond" and long.n <= 1 << 14
    assert sources.first_lines(Counting(b"a" * 100_000 + b"\nb"), 2) == "a" * 100_000 + "\nb"
    assert [sources.first_lines(Counting(x), 2) for x in (b"", b"\n", b"one", "é\n\xff".encode("latin-1"))] == [None, "", "one", "\ufffd\n\ufffd"]
    (tmp_path / "a b%.hea").write_text("named oddly\n")
    (tmp_path / "empty.hea").write_text("")
    done = spark.createDataFrame([], "path string, header string")
    assert [r.header for r in sources.ingest_headers(spark, f"{tmp_path}/*.hea", done).collect()] == ["named oddly"]


def test_stream_of_late_events(spark, tmp_path):
    from waymark.streaming import late_bins

    rows = [("a", "v", 1.0, "2024-01-01 00:10:00"), ("a", "v", 3.0, "2024-01-01 00:50:00"), ("a", "v", 5.0, "2024-01-01 01:10:00"), ("b", "v", 9.0, "2024-01-02 00:00:00")]
    ev = spark.createDataFrame(rows, "key string, var string, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    ev.write.parquet(f"{tmp_path}/in")
    stream = late_bins(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.n, r.total) for r in spark.table("late").collect()}
    assert got == {("a", 2, 4.0), ("a", 1, 5.0)}
