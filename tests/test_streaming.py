import datetime as dt
import json

from pyspark.sql import functions as F

from nearfd import (MESSAGE_SCHEMA, parse_messages, shared_dir, stream_project, stream_source, stream_topk,
                    tweet_fields, write_stream)


def test_topk_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    src = tmp_path / "in"
    schema = "id long, ts timestamp, value double, text string"
    for part in range(4):
        rows = [(part * 100 + i, start + dt.timedelta(minutes=part * 25, seconds=i * 20), float((i * 37) % 50), "a\nb")
                for i in range(100)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    sdf = stream_source(spark, str(src), schema, "parquet", files_per_batch=1)
    top = stream_topk(sdf, "ts", ["value", "id"], k=3, watermark="30 minutes", text_cols=["text"])
    out, check = shared_dir(spark, "out"), shared_dir(spark, "check")
    write_stream(top, out, check).awaitTermination(120)
    got = {(r["window_start"], r["rank"], r["id"], r["text"]) for r in spark.read.parquet(out).collect()}
    batch = stream_topk(spark.read.schema(schema).parquet(str(src)), "ts", ["value", "id"], k=3, text_cols=["text"])
    last = start + dt.timedelta(minutes=75, seconds=99 * 20) - dt.timedelta(minutes=30)
    want = {(r["window_start"], r["rank"], r["id"], r["text"]) for r in batch.collect() if r["window_end"] <= last}
    assert want and got == want
    assert all("\\n" in r[3] for r in got)


def test_topk_stream_keeps_types(spark, tmp_path):
    """Nullable longs above 2^53, decimals, NaN and nulls come out as in the batch form."""
    schema = "ts timestamp, v double, big long, d decimal(30,5)"
    rows = [(m, v, big, d) for m, v, big, d in [
        (1, 1.0, 9007199254741009, "1.00001"), (2, float("nan"), None, None), (3, None, 9007199254741011, "2.5"),
        (4, 1.0, 9007199254741010, "12345678901234567890.12345"), (30, 2.0, 1, None), (90, 0.0, 1, None)]]
    df = spark.createDataFrame(rows, "m int, v double, big long, d string").selectExpr(
        "timestamp_seconds(m * 60) as ts", "v", "big", "cast(d as decimal(30,5)) as d")
    src = str(tmp_path / "typed")
    df.coalesce(1).write.parquet(src)
    sdf = stream_source(spark, src, schema, "parquet")
    out = shared_dir(spark, "typed")
    write_stream(stream_topk(sdf, "ts", ["v", "big"], k=3, watermark="0 seconds"), out, shared_dir(spark, "check")).awaitTermination(120)
    got = {str(tuple(r)) for r in spark.read.parquet(out).select("window_start", "rank", "v", "big", "d").collect()}
    batch = stream_topk(df, "ts", ["v", "big"], k=3).filter("window_end <= timestamp_seconds(5400)")
    assert got == {str(tuple(r)) for r in batch.select("window_start", "rank", "v", "big", "d").collect()} and len(got) == 4


def test_batch_topk_cuts_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id", "timestamp_seconds(id * 7) as ts", "cast(id % 91 as double) as v")
    top = stream_topk(df, "ts", ["v", "id"], k=2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.groupBy("window_start").count().agg(F.max("count")).first()[0] == 2


def test_projection_keeps_and_rejects(spark):
    tweet = "struct<created_at:string,text:string,retweet_count:int,favourite_count:int,lang:string>"
    score = "struct<score:double,comparative:double,tokens:array<string>,words:array<string>,positive:array<string>,negative:array<string>>"
    rows = [(("t", "hi", 1, 2, "en"), (1.0, 0.25, ["a", "b"], ["a"], ["a"], None)),
            (("t", "no", 1, 2, "en"), (1.0, 0.25, ["a"], [], [], [])),
            (("t", "xx", 1, 2, "it"), (1.0, 0.25, ["a"], ["a"], [], []))]
    df = spark.createDataFrame(rows, f"tweet {tweet}, sentiment {score}")
    kept, rejected = stream_project(df, tweet_fields(), F.col("sentiment_word_count") >= 1, F.col("tweet.lang") == "en")
    row = kept.collect()
    assert len(row) == 1 and row[0]["sentiment_comparative"] == 25.0 and row[0]["sentiment_tokens"] == 2
    assert row[0]["sentiment_negative_count"] == 0
    assert [r["text"] for r in rejected.collect()] == ["no"]


def test_messages(spark):
    raw = spark.createDataFrame([(json.dumps({"text": "a\nb", "_msgid": "1", "sentiment_score": 2.5}),)], ["value"])
    row = parse_messages(raw).first()
    assert row["text"] == "a\\nb" and row["sentiment_score"] == 2.5 and row["retweet_count"] is None
    assert parse_messages(raw).columns == MESSAGE_SCHEMA.names


def test_divert_reads_once_and_survives_a_second_try(spark, tmp_path):
    """Kept and rejected rows from one pass; a batch whose commit was lost is written again and adds nothing."""
    from nearfd import divert_stream, diverted

    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id long, v int, k string"
    frame = lambda lo, hi: spark.createDataFrame([(i, None if i % 10 == 0 else i % 7, "ab"[i % 2]) for i in range(lo, hi)], schema)
    run = lambda: divert_stream(stream_source(spark, src, schema, "parquet", files_per_batch=1), {"id": F.col("id"), "w": F.col("v") * 2},
                                F.col("w") > 6, out, check, F.col("k") == "a")
    frame(0, 100).coalesce(1).write.mode("append").parquet(src)
    frame(100, 130).coalesce(1).write.mode("append").parquet(src)
    query = run()
    query.awaitTermination(120)
    read = sum(p["numInputRows"] for p in query.recentProgress)
    assert read == 130  # every row once, for both parts
    first = sorted(map(str, diverted(spark, out, "id long, w int").collect()))
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    frame(130, 150).coalesce(1).write.mode("append").parquet(src)
    run().awaitTermination(120)
    got = diverted(spark, out, "id long, w int")
    want = {(i, None if i % 10 == 0 else i % 7 * 2, "kept" if i % 10 and i % 7 > 3 else "rejected") for i in range(0, 150, 2)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and set(first) < set(map(str, got.collect()))


def test_topk_goes_on_after_a_restart(spark, tmp_path):
    """Windows that are open at the stop are in the checkpoint; the two runs together equal the batch result."""
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id long, ts timestamp, v double"
    every = spark.range(600).selectExpr("id", "timestamp_seconds(id * 60) AS ts", "cast(id * 37 % 101 AS double) AS v")
    for part in ("id < 305", "id >= 305"):  # the stop is inside a window
        every.filter(part).write.mode("append").parquet(src)
        top = stream_topk(stream_source(spark, src, schema, "parquet"), "ts", ["v", "id"], k=3, watermark="20 minutes")
        write_stream(top, out, check).awaitTermination(120)
    got = {(r.window_start, r["rank"], r.id) for r in spark.read.parquet(out).collect()}
    batch = stream_topk(every, "ts", ["v", "id"], k=3).filter("window_end <= timestamp_seconds(599 * 60 - 1200)")
    assert got == {(r.window_start, r["rank"], r.id) for r in batch.collect()} and len(got) > 100


def test_query_over_a_list_of_similar_values_is_saved(spark):
    from nearfd import QuerySpec

    near = spark.createDataFrame([("dog", "cat"), ("cat", "cat"), ("cow", "hen")], "l string, r string")
    spec = QuerySpec([("kind", "similar by list", (["cat"], near)), ("n", ">", 1)])
    back = QuerySpec.from_json(spec.to_json())
    df = spark.createDataFrame([("dog", 2), ("cat", 1), ("cat", 3), ("cow", 5)], "kind string, n int")
    assert sorted(map(tuple, back.apply(df).collect())) == sorted(map(tuple, spec.apply(df).collect())) == [("cat", 3), ("dog", 2)]
