"""The streaming labels against the batch labels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ripen.operators import delays
from ripen.session import shared_folder
from ripen.streaming import bucket_counts_stream, label_stream, run_available, write_in_turn

DAY = 86_400
EDGES = (0.0, DAY, 2 * DAY, 3 * DAY)
START = dt.datetime(2024, 1, 1)


def file_stream(spark, df, folder):
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def test_labels_come_out_once_and_negatives_only_when_mature(spark, tmp_path):
    impressions = spark.createDataFrame(
        [(i, START + dt.timedelta(hours=6 * i)) for i in range(40)], "impression_id long, timestamp_dt timestamp")
    conversions = spark.createDataFrame(
        [(i, START + dt.timedelta(hours=6 * i + 5 * (i % 12))) for i in range(0, 40, 3)] * 2,
        "impression_id long, conversion_timestamp_dt timestamp")
    stream = label_stream(file_stream(spark, impressions, str(tmp_path / "i")),
                          file_stream(spark, conversions, str(tmp_path / "c")), EDGES)
    run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.impression_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)
    for i in range(0, 40, 3):
        hours = 5 * (i % 12)
        assert got[i].conversion == 1 and got[i].conversion_delay == hours * 3600
        assert got[i].bucket.bucket_id == 1 + hours // 24 and sum(got[i].bucket_vec) == 1
    # The watermark is an hour behind the slower stream's last event.
    watermark = min(START + dt.timedelta(hours=6 * 39),
                    max(r.conversion_timestamp_dt for r in conversions.collect())) - dt.timedelta(hours=1)
    negatives = {i for i in got if got[i].conversion == 0}
    mature = {i for i in range(40) if i % 3 and START + dt.timedelta(hours=6 * i) + dt.timedelta(days=3) < watermark}
    assert negatives == mature
    assert all(got[i].conversion_delay == -1 and got[i].bucket is None for i in negatives)


def test_daily_bucket_counts(spark, tmp_path):
    rows = spark.createDataFrame(
        [(START + dt.timedelta(hours=i), (i % 4) * DAY - 1) for i in range(120)],
        "timestamp_dt timestamp, conversion_delay long")
    bucketed = delays.add_delay_buckets(rows, EDGES).select("timestamp_dt", "bucket")
    run_available(bucket_counts_stream(file_stream(spark, bucketed, str(tmp_path / "b"))),
                  str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.day, r.bucket_id): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = bucketed.groupBy(F.date_trunc("day", "timestamp_dt").alias("day"), "bucket.bucket_id").count().collect()
    last = START + dt.timedelta(days=4)
    assert got == {(r.day, r.bucket_id): r["count"] for r in batch if r.day < last}


def _labelled_in_batches(spark, tmp_path, crash):
    """Twelve days in four files a side; the run ends after two, and goes on from its checkpoint."""
    impressions = spark.createDataFrame(
        [(i, START + dt.timedelta(hours=3 * i)) for i in range(96)], "impression_id long, timestamp_dt timestamp")
    conversions = spark.createDataFrame(
        [(i, START + dt.timedelta(hours=3 * i + 5 * (i % 14))) for i in range(0, 96, 4)],
        "impression_id long, conversion_timestamp_dt timestamp")
    days = [START + dt.timedelta(days=d) for d in (3, 6, 9)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    told = []
    for early in (True, False):
        for df, moment, name in ((impressions, "timestamp_dt", "i"), (conversions, "conversion_timestamp_dt", "c")):
            some = df.filter(F.col(moment) < F.lit(days[1]) if early else F.col(moment) >= F.lit(days[1]))
            write_in_turn(some, str(tmp_path / name), moment, days[:1] if early else days[2:])
        sides = [spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
                 for df, name in ((impressions, "i"), (conversions, "c"))]
        told.append(run_available(label_stream(*sides, EDGES), out, state))
        if early and crash:  # the last batch wrote its files, but was not committed
            commits = sorted((p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
            commits[-1].unlink()
            (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    return impressions, conversions, spark.read.parquet(out).collect(), told


@pytest.mark.parametrize("crash", [False, True])
def test_batches_and_a_restart_give_the_batch_labels(spark, tmp_path, crash):
    impressions, conversions, rows, told = _labelled_in_batches(spark, tmp_path, crash)
    assert [r.batches for r in told][0] == 2 and told[1].batches >= 2 and sum(r.late for r in told) == 0
    times = {r.impression_id: r.timestamp_dt for r in impressions.collect()}
    converted = {r.impression_id: r.conversion_timestamp_dt for r in conversions.collect()
                 if r.conversion_timestamp_dt - times[r.impression_id] <= dt.timedelta(days=3)}
    watermark = min(max(times.values()), max(r.conversion_timestamp_dt for r in conversions.collect())) - dt.timedelta(hours=1)
    want = {i: int(i in converted) for i in times if i in converted or times[i] + dt.timedelta(days=3) < watermark}
    assert {r.impression_id: r.conversion for r in rows} == want and len(rows) == len(want)
    assert all(r.conversion_delay == (converted[r.impression_id] - times[r.impression_id]).total_seconds() for r in rows if r.conversion)


def test_late_rows_are_counted(spark, tmp_path):
    rows = spark.createDataFrame([(START + dt.timedelta(hours=i), -1) for i in range(120)], "timestamp_dt timestamp, conversion_delay long")
    bucketed = delays.add_delay_buckets(rows, EDGES).select("timestamp_dt", "bucket")
    folder, out, state = (str(tmp_path / x) for x in ("b", "out", "state"))
    bucketed.coalesce(1).write.parquet(folder)

    def run():
        return run_available(bucket_counts_stream(spark.readStream.schema(bucketed.schema).parquet(folder)), out, state)

    first = run()
    bucketed.filter(F.col("timestamp_dt") < F.lit(START + dt.timedelta(hours=5))).coalesce(1).write.mode("append").parquet(folder)
    second = run()
    assert (first.rows, first.late) == (120, 0) and second.rows == 5 and second.late >= 1
    # Days that were given out stay as they were.
    assert {r.day: r.n for r in spark.read.parquet(out).collect()} == {START + dt.timedelta(days=d): 24 for d in range(4)}


def test_shared_folders_are_new(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
