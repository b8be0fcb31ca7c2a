"""A feed applied batch by batch ends where the whole feed ends."""

import random

from millrace.streaming.feed import FeedTable
from tests.test_replay_eager import FEED, brute, feed_of


def test_stream(spark, tmp_path):
    feed = feed_of(random.Random(11), 300, 6, 0.3)
    for i in range(3):
        spark.createDataFrame(feed[i::3], FEED).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    table = FeedTable(spark, f"file://{tmp_path}/state", ["k1", "k2"], "seq", "op", "bits", ["a", "b"])
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table.start(stream, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination(120)
    assert sorted(map(tuple, table.current().collect()), key=str) == brute(feed)
    # a batch that runs again changes nothing, and compacted batches are the same table
    table.apply(spark.createDataFrame(feed[0::3], FEED), 0)
    compact = table.compact(f"file://{tmp_path}/compact")
    compact.apply(spark.createDataFrame(feed[:50], FEED), 9)
    assert sorted(map(tuple, compact.current().collect()), key=str) == brute(feed)
