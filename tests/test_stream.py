import pytest
from pyspark.sql import functions as F

from cardmill import FieldRule, PageRules
from cardmill.operators.clean import clean_records, distinct_records
from cardmill.operators.extract import parse_pages, records
from cardmill.plans import raw_pages  # noqa: F401
from cardmill.plans.registry import QUERIES
from cardmill.session import new_dir
from cardmill.sources.csv_output import read_output, write_records
from cardmill.streaming import records as streams

RULES = PageRules("li", (FieldRule("text", "a", required=True), FieldRule("link", "a", "href", "url")))


def pages(spark, low, high):
    return spark.range(low, high).selectExpr(
        "id as page_id", "concat('https://x.test/', id) as url",
        "concat('<ul><li><a href=/', id % 30, '>t</a><li><a href=/own', id, '>u</a><li>none</ul>') as html",
    )


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    pages(spark, 0, 60).repartition(4).write.parquet(folder)

    def run():
        rows = streams.stream_records(streams.page_stream(spark, folder, files_per_batch=1), RULES)
        query = streams.write_stream(rows, out, state)
        query.awaitTermination()
        return query

    assert len([p for p in run().recentProgress if p.numInputRows]) == 4
    pages(spark, 50, 80).write.mode("append").parquet(folder)
    run()
    batch = spark.read.parquet(folder)
    want = distinct_records(clean_records(records(parse_pages(batch, RULES), RULES), RULES.names), RULES.names)
    got = read_output(spark, out, RULES.names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 30 + 80


def test_append_to_a_filled_folder(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    pages(spark, 0, 40).write.parquet(folder)
    old = records(parse_pages(pages(spark, 0, 25), RULES), RULES).select(*RULES.names)
    write_records(old, out, RULES.names)
    before = read_output(spark, out, RULES.names).count()
    rows = streams.stream_records(streams.page_stream(spark, folder), RULES)
    target = read_output(spark, out, RULES.names)
    rest = streams.unwritten_records(rows, target, RULES.names)
    added = str(tmp_path / "added")
    streams.write_stream(rest, added, state).awaitTermination()
    new = read_output(spark, added, RULES.names)
    assert new.join(target, RULES.names).count() == 0
    want = distinct_records(records(parse_pages(spark.read.parquet(folder), RULES), RULES), RULES.names)
    assert before + new.count() == want.count()


def test_repeats_may_stay(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    pages(spark, 0, 60).write.parquet(folder)
    rows = streams.stream_records(streams.page_stream(spark, folder), RULES, deduplicate=False)
    streams.write_stream(rows, out, state, encoding="utf-8").awaitTermination()
    assert read_output(spark, out, RULES.names).count() == 120


def test_bounded_state_drops_close_repeats(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    timed = pages(spark, 0, 60).withColumn("seen_at", F.timestamp_seconds(F.col("page_id") + 1_700_000_000))
    timed.write.parquet(folder)
    stream = spark.readStream.schema(timed.schema).parquet(folder)
    streams.write_stream(streams.recent_records(stream, RULES, "seen_at", "1 hour"), out, state).awaitTermination()
    assert read_output(spark, out, RULES.names).count() == 30 + 60


def test_observer_sees_every_page(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    pages(spark, 0, 9).repartition(3).write.parquet(folder)
    seen = []

    def on_pages(batch, number):
        seen.extend((number, r.page_id, r.found, r.kept) for r in batch.collect())

    stream = streams.page_stream(spark, folder, files_per_batch=1)
    streams.observe_pages(stream, RULES, on_pages, state).awaitTermination()
    assert sorted(row[1:] for row in seen) == [(i, 3, 2) for i in range(9)]
    assert len({row[0] for row in seen}) == 3


def test_a_table_is_a_file_or_a_folder(spark, tmp_path):
    folder, file = str(tmp_path / "pages.parquet"), str(tmp_path / "one" / "pages.parquet")
    pages(spark, 0, 12).repartition(3).write.parquet(folder)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "pages.parquet").write_bytes(next((tmp_path / "pages.parquet").glob("part-*")).read_bytes())
    for path, count in ((folder, 12), (file, spark.read.parquet(file).count())):
        seen = []
        stream = streams.table_stream(spark, path)
        streams.observe_pages(stream, RULES, lambda batch, number: seen.extend(r.page_id for r in batch.collect()), new_dir(spark, "state")).awaitTermination()
        assert len(seen) == count > 0
    state, out = new_dir(spark, "state"), new_dir(spark, "out")
    streams.write_stream(streams.stream_records(streams.table_stream(spark, folder), RULES), out, state).awaitTermination()
    assert read_output(spark, out, RULES.names).count() == 12 + 12


@pytest.mark.parametrize("name", ["stream_append", "stream_observer", "stream_records"])
def test_queries_over_a_table_in_parts(spark, tmp_path, name):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    want = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(map(tuple, want))
