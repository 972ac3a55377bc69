import json

from pyspark.sql import functions as F

from tarnbase.sources import readers as S
from tarnbase.sources import writers as W
from tarnbase.streaming import incremental as R


def test_json_texts_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"b": 1, "a": "x"}\n{"b": 1, "a": "x"}\n{"b": 2, "a": "y"}\n')
    t = S.read_json(spark, str(tmp_path / "in"))
    assert t.count() == 3 and t.select("id").distinct().count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t/m.txt").write_text("Title\n\nbody")
    assert tuple(S.read_texts(spark, str(tmp_path / "t")).first()) == ("m.txt", "Title\n\nbody")
    (tmp_path / "g.csv").write_text("﻿q,a\n#skip\n1,2\n", encoding="utf-8")
    assert S.read_table_file(spark, str(tmp_path / "g.csv")).columns == ["q", "a"]


def test_headers():
    assert S.map_headers(["问题", "Answer", "x"]) == {"问题": "q", "Answer": "a"}
    assert S.classify_sheet(["问题", "答案"]) == "qa"
    assert S.classify_sheet(["标题", "内容"], [["a", "b"]]) == "mapped"
    assert S.classify_sheet(["foo"]) == "unstructured"
    assert S.classify_sheet(["问题", "答案"], [[None, ""]]) == "unstructured"


def test_qa_rows(spark):
    t = spark.createDataFrame([("f", "s", 1, {"问题": " 甲 ", "答案": "乙", "标签": "a;b"}), ("f", "s", 2, {"问题": "丙"})], "file string, sheet string, row_no int, cells map<string,string>")
    r = S.qa_rows(t).collect()
    assert len(r) == 1 and (r[0]["q"], r[0]["a"], r[0]["tags"]) == ("甲", "乙", ["a", "b"])


def test_injected_parser(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"xy")
    (tmp_path / "b.bin").write_bytes(b"")

    def parse(name, content):
        yield len(content), bytes(content)[0]

    got = sorted(map(tuple, S.binary_documents(spark, str(tmp_path), parse, "n int, first int").collect()), key=str)
    assert got[0] == (2, 120, None) and all(r[:2] == (None, None) and r[2] for r in got[1:])


def test_dictionary(spark):
    t = spark.createDataFrame([("c", "k", "v"), ("c", "k2", "v2")], "c string, k string, v string")
    assert S.dictionary(t, "c", "k", value="v").first()["map"] == {"k": "v", "k2": "v2"}


def test_backup_export_copy(spark, tmp_path):
    t = spark.createDataFrame([(1, "A", "x\x01y", [0.5]), (2, "b", None, None)], "id int, index_name string, body string, vec_embedding array<float>")
    assert W.backup(t, str(tmp_path / "b"))["left_out"] == ["vec_embedding"]
    back = spark.read.json(str(tmp_path / "b/data"))
    assert back.count() == 2 and "vec_embedding" not in back.columns
    assert W.export_rows(t, str(tmp_path / "e"), ["id", "body"], "csv") == 2
    assert W.copy_indexes(t, str(tmp_path / "c"), ["b"]).collect()[0]["n"] == 1
    assert S.index_scan(t.withColumn("index_name", F.lower("index_name")), " A,zz").count() == 1


def test_sending(spark, tmp_path):
    out = str(tmp_path / "sent")

    def send(rows):
        with open(f"{out}-{rows[0]['id']}", "w") as f:
            json.dump(rows, f)

    W.push(spark.range(5).coalesce(1), send, 2)
    assert sum(len(json.loads(p.read_text())) for p in tmp_path.glob("sent-*")) == 5


def test_marks_move_only_on_success(spark):
    marks = spark.createDataFrame([("a", 5), ("b", 9)], "k string, mark int")
    t = spark.createDataFrame([("a", 4), ("a", 6), ("b", 9), ("c", 1)], "k string, t int")
    new = R.after_marks(t, marks, ["k"], "t")
    assert sorted(map(tuple, new.collect())) == [("a", 6), ("c", 1)]
    moved = R.next_marks(marks, new, ["k"], "t", spark.createDataFrame([("a",)], "k string"))
    assert sorted(map(tuple, moved.collect())) == [("a", 6), ("b", 9)]
    failed = spark.createDataFrame([("c",)], "k string")
    assert sorted(map(tuple, R.all_or_nothing(marks, moved, failed).collect())) == [("a", 5), ("b", 9)]


def test_stream_turns(spark, tmp_path):
    src, ck = tmp_path / "src", str(tmp_path / "ck")
    src.mkdir()
    schema = "g string, id int, who string, ok boolean, at double"
    spark.createDataFrame([("g", 1, "a", True, 0.0), ("g", 2, "a", True, 100.0), ("g", 3, "b", True, 110.0), ("g", 4, "c", False, 120.0)], schema).coalesce(1).write.mode("append").parquet(str(src))
    got = []
    q = R.run_stream(R.stream_turns(spark.readStream.schema(schema).parquet(str(src)), "g", "id", "who", "ok", "at"), lambda df, _: got.extend(map(tuple, df.collect())), ck)
    assert q.exception() is None
    assert sorted(got) == [("g", "a", 0.0, 100.0, 2), ("g", "b", 110.0, 110.0, 1)]


def test_stream_repeats(spark, tmp_path):
    src = tmp_path / "src"
    schema = "k string, ts timestamp"
    spark.createDataFrame([("a", None), ("a", None)], schema).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).coalesce(1).write.parquet(str(src))
    got = []
    R.run_stream(R.stream_distinct(spark.readStream.schema(schema).parquet(str(src)), ["k"], "ts", "2 minutes"), lambda df, _: got.extend(map(tuple, df.select("k").collect())), str(tmp_path / "ck"))
    assert got == [("a",)]
