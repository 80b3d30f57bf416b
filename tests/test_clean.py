import pytest

from cardmill.operators.clean import clean_records, distinct_records, duplicate_counts, new_records
from cardmill.sources.csv_output import BOM, read_output, write_records

FIELDS = ["title", "price", "link"]
SCHEMA = "title string, price string, link string, extra string"
ROWS = [("quoted, \"so\"", "-12", "ftp://a.test/o", "left out"), ("τρία", "0.75", "b;c", None)]
THIRD = ("Ώμος", "3e3", "https://c.test/?x=1;2", None)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def stored(spark, path, **options):
    return sorted(tuple(r) for r in read_output(spark, str(path), FIELDS, **options).collect())


def first_bytes(path):
    return [part.read_bytes() for part in sorted(path.glob("part-*"))]


def test_columns_blanks_and_trim(spark):
    rows = table(spark, *ROWS, ("", " ", None, "x"), ("  a ", " 1\t", None, None), (None, None, "\xa0l", ""))
    got = sorted(tuple(r) for r in clean_records(rows, FIELDS).collect())
    assert got == sorted([ROWS[0][:3], ROWS[1][:3], ("a", "1", ""), ("", "", "l")])
    assert clean_records(rows, ["title", "missing"]).columns == ["title", "missing"]
    assert clean_records(rows, ["missing"]).count() == 0


def test_write_and_read(spark, tmp_path):
    out = tmp_path / "nested" / "out"
    write_records(table(spark, *ROWS, ("", "", "", None)), str(out), FIELDS, encoding="utf-8")
    assert stored(spark, out) == [r[:3] for r in ROWS]
    assert all(data.startswith(b"title,price,link\n") for data in first_bytes(out))


def test_byte_order_mark(spark, tmp_path):
    write_records(table(spark, *ROWS), str(tmp_path / "o"), FIELDS)
    assert all(data.startswith(b"\xef\xbb\xbftitle,price,link\n") for data in first_bytes(tmp_path / "o"))
    assert stored(spark, tmp_path / "o") == [r[:3] for r in ROWS]
    assert not any(BOM in name for name in read_output(spark, str(tmp_path / "o"), FIELDS).columns)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "UTF-16LE"])
def test_awkward_values_survive(spark, tmp_path, encoding):
    rows = [('say "hi", ok', "a\nb", "\\", None), ('"', ",", "'", None), ("", "x", "", None), ("\\\"", '""', "é№", None)]
    write_records(table(spark, *rows), str(tmp_path / "o"), FIELDS, encoding=encoding)
    assert stored(spark, tmp_path / "o", encoding=encoding) == sorted(r[:3] for r in rows)


def test_only_needed_quotes(spark, tmp_path):
    write_records(table(spark, ("a,b", 'c"d', "e", None)).coalesce(1), str(tmp_path / "o"), FIELDS, encoding="utf-8")
    assert b'"a,b","c""d",e\n' in b"".join(first_bytes(tmp_path / "o"))


def test_repeats(spark, tmp_path):
    rows = table(spark, *ROWS, *ROWS)
    write_records(rows, str(tmp_path / "one"), FIELDS)
    assert len(stored(spark, tmp_path / "one")) == 2
    write_records(rows, str(tmp_path / "all"), FIELDS, deduplicate=False)
    assert len(stored(spark, tmp_path / "all")) == 4
    assert duplicate_counts(rows, FIELDS).first().duplicates == 2
    assert duplicate_counts(rows.limit(0), FIELDS).first().duplicates == 0
    earlier = table(spark, ROWS[1], THIRD, THIRD)
    assert duplicate_counts(rows, FIELDS, existing=earlier).first().duplicates == 3


def test_append(spark, tmp_path):
    out = str(tmp_path / "o")
    write_records(table(spark, *ROWS), out, FIELDS, append=True)
    write_records(table(spark, *ROWS, *ROWS), out, FIELDS, append=True)
    assert len(stored(spark, out)) == 2
    write_records(table(spark, *ROWS, THIRD, (" Ώμος", "3e3 ", THIRD[2], None)), out, FIELDS, append=True)
    assert stored(spark, out) == sorted(r[:3] for r in (*ROWS, THIRD))
    write_records(table(spark, THIRD), out, FIELDS, append=True, deduplicate=False)
    assert len(stored(spark, out)) == 4
    write_records(table(spark, ROWS[0]), out, FIELDS)
    assert stored(spark, out) == [ROWS[0][:3]]


def test_reading_what_is_not_there(spark, tmp_path):
    assert stored(spark, tmp_path / "none") == []
    write_records(table(spark), str(tmp_path / "empty"), FIELDS)
    assert stored(spark, tmp_path / "empty") == []
    write_records(table(spark, *ROWS), str(tmp_path / "o"), ["title"])
    assert stored(spark, tmp_path / "o") == sorted([(ROWS[0][0], "", ""), (ROWS[1][0], "", "")])


def test_first_place_of_a_row(spark):
    rows = spark.createDataFrame([(2, 1, "a"), (1, 9, "a"), (1, 3, "b")], "n int, card_no int, title string")
    got = distinct_records(rows, ["title"], first=["n", "card_no"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, "b"), (1, 9, "a")]


def test_a_row_repeated_a_lot_is_merged_before_the_shuffle(spark):
    rows = spark.range(100_000).selectExpr("if(id % 3 = 0, 'hot', concat('r', id % 500)) as title")
    known = spark.range(100_000).selectExpr("if(id % 2 = 0, 'hot', concat('r', id % 300)) as title")
    fresh = new_records(rows, known, ["title"])
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "partial_min" in plan
    want = {r.title for r in rows.distinct().collect()} - {r.title for r in known.distinct().collect()}
    assert {r.title for r in fresh.collect()} == want and fresh.count() == len(want)
