"""The running cap counts every author, however many a day has."""

import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from socialspark.streaming import intake

ROW = "id string, pubkey string, kind int, ingest_ts timestamp"


def test_the_cap_holds_for_all_authors_of_a_day(spark):
    """Some 3,900 authors of one bucket of 64, as a day of 250,000 has; each posts twice, and once more in a later run."""
    base, noon = "file://" + tempfile.mkdtemp(prefix="stream-test-"), datetime(2024, 3, 1, 12)
    mine = F.pmod(F.xxhash64("pubkey"), F.lit(intake.BUCKETS)) == 0
    authors = [r.pubkey for r in spark.range(250_000).select(F.concat(F.lit("a"), "id").alias("pubkey")).where(mine).collect()]
    exemption = intake.RefreshedExemption(lambda: spark.createDataFrame([], "pubkey string"))
    for part, times in enumerate(((0, 1), (2,))):
        rows = [(f"{a}-{n}", a, 1, noon + timedelta(seconds=n)) for a in authors for n in times]
        spark.createDataFrame(rows, ROW).coalesce(1).write.json(f"{base}/in/part={part}")
        events = spark.readStream.schema(ROW).json(f"{base}/in/*")
        assert intake.start_split(events, base, exemption, once=True).awaitTermination(120)
        assert intake.start_counting(spark, base, ROW, 1, once=True).awaitTermination(120)
    assert {r.id for r in intake.read_intake(spark, base, ROW).collect()} == {f"{a}-0" for a in authors} and len(authors) > 3_125
