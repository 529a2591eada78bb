import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from gridloom.functions.parsing import parse_json_object, readable, says_nothing, to_bigint, to_boolean, to_date, to_double
from gridloom.operators.wide import SortedRuns, compact_cells, load_catalog, rows_to_delta, sparse_delta, to_wide, typed_cells, unreadable_cells
from gridloom.streaming.upserts import compact_runs, write_deltas

CATALOG = [("t", "amt", "amount", "bigint"), ("t", "Amount", "amount", "bigint"), ("t", "when", "day", "date"), ("t", "pct", "share", "double"), ("t", "ok", "flag", "boolean"), ("t", "note", "remark", "text")]


@pytest.fixture(scope="module")
def catalog(spark):
    return load_catalog(spark.createDataFrame(CATALOG, "owner_table string, attr_name string, column_name string, value_type string"))


@pytest.mark.parametrize(
    ("reader", "value", "expected"),
    [
        (to_bigint, " 2,14,39,000 ", 21439000), (to_bigint, "Rs. 67,35,000/-", 6735000), (to_bigint, "₹49", 49), (to_bigint, "1589.0", 1589), (to_bigint, "12.5", None), (to_bigint, "1,23", None),
        (to_bigint, "80O", None), (to_bigint, "", None), (to_bigint, "-5", -5), (to_bigint, "1e3", 1000), (to_double, "20.4 %", 20.4), (to_double, "87.02 per cent", 87.02), (to_double, "14-15", None), (to_double, "19.1.1", None),
        (to_boolean, "Yes ", True), (to_boolean, "0", False), (to_boolean, "2", None), (to_date, "2009-04-26T00:00:00", date(2009, 4, 26)), (to_date, "24/07/2014", date(2014, 7, 24)), (to_date, "11.10.1991", date(1991, 10, 11)),
        (to_date, "08-Oct-2010", date(2010, 10, 8)), (to_date, "December 7, 2007", date(2007, 12, 7)), (to_date, "20 August 2018", date(2018, 8, 20)), (to_date, "31/02/2010", None), (to_date, "0000-00-00", None), (to_date, "FY 2015-16", None),
    ],
)
def test_values_as_people_write_them(spark, reader, value, expected):
    assert spark.createDataFrame([(value,)], "v string").select(reader(F.col("v"))).first()[0] == expected


@pytest.mark.parametrize(("blob", "expected"), [('{"a": 1, "a": 2}', {"a": "2"}), ('{"a": null}', {"a": None}), ('{"a": 1} x', None), ("{'a': 1}", None), ('{"a": "', None), ("null", None), ("[1]", None), ("", None), (None, None), ("{}", {}), ('{"a": {"b": [1, 2]}}', {"a": '{"b":[1,2]}'})])
def test_json_objects(spark, blob, expected):
    assert spark.createDataFrame([(blob,)], "v string").select(parse_json_object(F.col("v"))).first()[0] == expected


def test_wide_rows(spark, catalog):
    rows = [(1, 1, '{"amt": "1,000", "when": "2001-02-30", "ok": 1, "extra": "x"}', "c"), (1, 2, '{"amt": "x", "Amount": 7, "note": "n"}', "c"), (2, 3, None, "c"), (3, 4, "not json", "c"), (3, 4, "not json", "c")]
    df = spark.createDataFrame(rows, "k int, version int, blob string, raw string")
    delta = sparse_delta(df, "t", "k", "blob", F.col("version"))
    cells = typed_cells(compact_cells(delta), catalog)
    got = {r.row_key: r for r in to_wide(delta, cells, catalog, "t").collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].amount, got[1].day, got[1].flag, got[1].remark, got[1].other) == (7, None, True, "n", {"extra": "x"})
    assert got[2].amount is None and not got[2].other
    assert {(r.row_key, r.attr_name) for r in unreadable_cells(cells).collect()} == {(1, "amt"), (1, "when")}


def test_cells_from_attribute_rows_meet_blobs_by_version(spark, catalog):
    eav = spark.createDataFrame([(1, "amt", "5", 9), (1, "amt", "4", 8), (1, None, "3", 9)], "k int, name string, value string, v int")
    blob = sparse_delta(spark.createDataFrame([(1, 1, '{"amt": 1, "ok": "no"}')], "k int, v int, b string"), "t", "k", "b", F.col("v"))
    cells = compact_cells(rows_to_delta(eav, "t", "k", "name", "value", F.col("v")), blob)
    assert {(r.attr_name, r.raw) for r in cells.collect()} == {("amt", "5"), ("ok", "no")}


def test_empty_tables(spark, catalog):
    df = spark.createDataFrame([], "k int, v int, b string")
    cells = typed_cells(compact_cells(sparse_delta(df, "t", "k", "b", F.col("v"))), catalog)
    assert cells.count() == 0 and to_wide(sparse_delta(df, "t", "k", "b", F.col("v")), cells, catalog, "t").count() == 0
    assert typed_cells(compact_cells(sparse_delta(df, "t", "k", "b", F.col("v"))), []).count() == 0


def test_readable_and_stand_ins(spark):
    df = spark.createDataFrame([("bigint", "x"), ("text", "x"), ("date", "1 May 2020")], "t string, v string")
    assert [r[0] for r in df.select(readable(F.col("v"), F.col("t"))).collect()] == [False, True, True]
    assert [r[0] for r in spark.createDataFrame([(" N/A ",), ("x",), (None,)], "v string").select(says_nothing(F.col("v"))).collect()] == [True, False, True]


def test_streamed_runs_compact_like_a_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "runs")
    rows = [(1, 1, json.dumps({"a": 1, "b": 1})), (1, 2, json.dumps({"a": 2})), (2, 1, None)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "k int, v int, blob string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k int, v int, blob string").option("maxFilesPerTrigger", 1).parquet(src)
    write_deltas(stream, "t", "k", "blob", F.col("v"), out, str(tmp_path / "ck")).awaitTermination()
    assert {(r.attr_name, r.raw) for r in compact_runs(spark.read.parquet(out)).collect()} == {("a", "2"), ("b", "1")}


def test_sorted_runs_merge_without_a_shuffle(spark):
    """Batches that contradict each other, one of them late: the latest version of a cell wins, and no plan exchanges cells again."""
    runs = SortedRuns(spark, 4)
    batches = [[("k1", 5, '{"a": 1, "b": 1}'), ("k2", 5, '{"a": 1}')], [("k1", 7, '{"a": 2, "c": null}'), ("k1", 6, '{"a": 9, "b": 6}')], [("k1", 4, '{"b": 4, "d": 4}'), ("k2", 9, "no json"), ("k3", 1, None)]]
    for rows in batches:
        runs.append(sparse_delta(spark.createDataFrame(rows, "k string, v int, b string"), "t", "k", "b", F.col("v")))
    want = {("k1", "a", "2", 7), ("k1", "b", "6", 6), ("k1", "c", None, 7), ("k1", "d", "4", 4), ("k2", "a", "1", 5)}
    rows_of = lambda r: {(x.row_key, x.attr_name, x.raw, x.version) for x in r.cells().collect()}
    assert rows_of(runs) == want
    plan = runs.cells().groupBy("row_key").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    merged = runs.compact()
    assert rows_of(merged) == want
    merged.append(sparse_delta(spark.createDataFrame([("k2", 8, '{"a": 8}')], "k string, v int, b string"), "t", "k", "b", F.col("v")))
    assert ("k2", "a", "8", 8) in rows_of(merged)
    runs.drop()
    merged.drop()
