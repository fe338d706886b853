"""Daily series that are made in as many partitions as their days need."""

from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

from ladle.operators import forecast, recommend
from ladle.plans import analytics
from tests.conftest import SF


def _lines(spark, rows):
    return spark.createDataFrame(rows, "item_id long, location_id string, day string, quantity double").withColumn("ts", F.to_timestamp("day"))


def test_long_series_of_few_lines_are_not_made_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(forecast, "PARTITION_DAYS", 100)
    lines = _lines(spark, [(k, "a", day, 1.0) for k in range(40) for day in ("2020-01-01", "2020-04-09")])
    days = forecast.daily_series(lines)
    sizes = [r["count"] for r in forecast.training_table(days).groupBy(F.spark_partition_id()).count().collect()]
    assert days.count() == 40 * 100 and len(sizes) > 10 and max(sizes) < 1000


def test_series_equal_the_grid_joined_to_sales(spark):
    rows = [(1, "a", "2020-01-01", 2.0), (1, "a", "2020-01-01", 3.0), (1, "a", "2020-01-05", 1.0), (2, "b", "2020-02-28", None), (2, "b", "2020-03-01", 4.0), (None, "a", "2020-01-01", 7.0), (None, "a", "2020-01-03", 7.0), (3, "c", None, 1.0)]
    lines = _lines(spark, rows)
    spans = lines.groupBy("item_id", "location_id").agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))
    grid = spans.select("item_id", "location_id", F.explode(F.sequence("first", "last")).alias("day"))
    got, want = forecast.daily_series(lines), forecast.daily_quantity(grid, lines)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {(r["item_id"], r["day"]): r["qty"] for r in got.collect()}[1, date(2020, 1, 1)] == 5.0


def test_no_lines_have_no_series(spark):
    assert forecast.daily_series(_lines(spark, [])).count() == 0


def test_peaks_read_the_forecast_once(spark):
    day = date(2020, 1, 1)
    said = spark.createDataFrame([(1, day, 60.0, 30.0), (1, date(2020, 1, 2), 80.0, 30.0), (1, date(2020, 1, 3), 80.0, 30.0), (2, day, 30.0, 30.0)], "item_id long, target_day date, forecast double, recent_average double")
    classified = spark.createDataFrame([(1, 10.0, 5.0), (2, 1.0, 1.0)], "item_id long, contribution_margin double, total_quantity_sold double")
    found = recommend.stock_before_peak(said, classified)
    (row,) = found.collect()
    assert row["impact"] == 100.0 and row["evidence"][1] == "3 of 3 days are peaks" and row["action"].endswith("2020-01-02")
    assert found._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 2


def test_recommendations_are_made_part_by_part(spark, monkeypatch):
    """Each part is written before the next one is made, so that no plan has the broadcasts of them all."""
    stored = []
    monkeypatch.setattr(analytics.tables, "written", lambda df, name: stored.append(df) or df)
    monkeypatch.setattr(analytics.recommend, "ranked", lambda *parts: parts)
    parts = analytics._recommendations(spark, SF)
    assert len(parts) == 9 and all(any(p is s for s in stored) for p in parts)


def test_what_a_written_table_was_made_of_leaves_the_disk(spark):
    """Shuffle files go when the write ends, and the lines that were numbered when they are judged."""

    def shuffled():
        return {p for folder in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for p in Path(folder.getPath()).rglob("shuffle_*.data")}

    before = shuffled()
    out = analytics.tables.written(spark.range(1000).repartition(5).groupBy("id").count(), "shuffled")
    assert not shuffled() - before and out.count() == 1000
    path = Path(out.written_to.removeprefix("file://"))
    assert path.exists()
    analytics.tables.discard(out)
    assert not path.exists()
