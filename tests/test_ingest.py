import json
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.sources import ingest as I


def test_read_stats_from_files(spark):
    d = tempfile.mkdtemp(prefix="folio-stats-")
    files = {"ecto.json": {"downloads": {"recent": 1234}}, "plug.json.json": {"downloads": {}},
             "phoenix.json": {"name": "phoenix"}}
    for name, body in files.items():
        with open(os.path.join(d, name), "w") as f:
            json.dump(body, f)
    got = {r.name: r.recent_downloads for r in I.read_stats(spark, d).collect()}
    assert got == {"ecto": 1234, "plug": 0, "phoenix": 0}


def test_items_both_shapes_and_default_type(spark):
    rows = [("p1", json.dumps({"items": [{"ref": "a", "title": "A", "type": "module", "doc": "x"}]})),
            ("p2", json.dumps([{"ref": "b", "title": "B", "type": None, "doc": "y"},
                               {"ref": "c", "title": "C", "doc": "z"}]))]
    df = spark.createDataFrame(rows, "package string, json string")
    got = sorted(tuple(r) for r in I.items_with_repair(df)[0].collect())
    assert got == [("p1", "a", "A", "module", "x"), ("p2", "b", "B", "extras", "y"), ("p2", "c", "C", "extras", "z")]


def test_repair_and_quarantine(spark):
    rows = [(1, '{"k": 1}'), (2, '{"k": 2, "note": "x\\d"}'), (3, '{"k": 3, "note": "a\tb"}'),
            (4, '{"k": 4, "note": "open'), (5, '{"k": 5, "doc":<<raw>>,"z": 1}')]
    df = spark.createDataFrame(rows, "id bigint, json string")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("note", T.StringType())])
    p = I.parse_with_repair(df, schema)
    got = {r.id: (None if r.parsed is None else (r.parsed.k, r.parsed.note), r.repaired) for r in p.collect()}
    assert got[1] == ((1, None), False)
    assert got[2] == ((2, "xd"), True)
    assert got[3] == ((3, "a\tb"), True)
    assert got[4][0] is None
    assert got[5] == ((5, None), True)
    assert [(r.id, r.context) for r in I.quarantine(p).collect()] == [(4, 'te": "open')]
    fixed = spark.createDataFrame([('{"items":[{"doc":<<65, 32, ...>>,"ref":"a"}]}',)], "j string").select(I.repair_json(F.col("j")))
    assert fixed.first()[0] == '{"items":[{"doc":"<<65, 32, ...>>","ref":"a"}]}'


def test_docs_folder_repair_and_quarantine(spark):
    d = tempfile.mkdtemp(prefix="folio-docs-")
    item = {"ref": "r", "title": "T", "type": "module", "doc": "x"}
    files = {"good.json": json.dumps({"items": [item]}), "list.json": json.dumps([item, {"ref": "q"}]),
             "bare.json": '{"items":[{"doc":<<65, 32>>,"ref":"b","title":"B","type":null}]}',
             "escape.json": '[{"ref":"e","title":"a \\\\d b","type":"task","doc":"\\#{x}"}]'.replace("\\\\", "\\"),
             "cut.json": '{"items":[{"ref":"c","title":"never clo', "other.json": '{"name": "x"}', "empty.json": '{"items": []}'}
    for name, body in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(body)
    items, bad = I.read_docs_items(spark, d)
    got = [tuple(r) for r in items.collect()]
    assert sorted(got, key=str) == sorted([
        ("good", "r", "T", "module", "x"), ("list", "r", "T", "module", "x"), ("list", "q", None, "extras", None),
        ("bare", "b", "B", "extras", "<<65, 32>>"), ("escape", "e", "a d b", "task", "#{x}")], key=str)
    lost = {r.package: (r.file.rsplit("/", 1)[-1], r.context) for r in bad.collect()}
    assert lost == {"cut": ("cut.json", ":\"never clo"[-10:]), "other": ("other.json", '"name": "x"}'[-10:])}


def test_serving_keeps_count(spark):
    rows = [(1, "r", "t", "x", "d"), (2, None, "t", "x", "d"), (3, "r", "t", "x", None)]
    df = spark.createDataFrame(rows, "id bigint, ref string, type string, title string, doc string")
    assert [r.id for r in I.serving_docs(df).collect()] == [1]
    assert sorted((r.id, r.reason) for r in I.serving_quarantine(df).collect()) == [(2, "null ref"), (3, "null doc")]


def test_upsert_and_band(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "name string, recent_downloads bigint")
    new = spark.createDataFrame([("b", 20), ("c", 30)], "name string, recent_downloads bigint")
    assert sorted(tuple(r) for r in I.upsert(old, new, ["name"]).collect()) == [("a", 1), ("b", 20), ("c", 30)]
    twice = spark.createDataFrame([("b", 50, 1), ("b", 5, 2), ("b", 70, 0)], "name string, recent_downloads bigint, n int")
    assert sorted(tuple(r) for r in I.upsert(old, twice, ["name"], seq="n").collect()) == [("a", 1), ("b", 5)]
    pk = spark.createDataFrame([("sqlite_x", 1000), ("sqliteyx", 1000), ("ecto", 1000), ("big", 9000)],
                               "name string, recent_downloads bigint")
    assert {r.name for r in I.package_band(pk).collect()} == {"ecto"}
