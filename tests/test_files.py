"""File sources and sinks on fixtures written under a scratch folder."""

import json
import os
import re

from pyspark.sql import functions as F

from vigil.sources import files


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def bid_tree(root):
    d = f"{root}/acme/2024-03-01"
    write(f"{d}/raw_0.csv", "product_id,prediction,extra\np1,5.0,x\np2,3.0,y\n")
    write(f"{d}/raw_1.csv", "prediction,product_id\n4.0,p3\n")            # reordered header
    write(f"{d}/raw_2.csv", "")                                           # empty: skipped
    write(f"{d}/raw_3.csv", "product_id,prediction\np4,1.0\np5,2.0,zz\n")  # too long: skipped
    write(f"{d}/raw_4.csv", "product_id,prediction,extra\np6\n")           # short: padded
    write(f"{d}/raw_5.csv", 'product_id,prediction\n"p,7",6.0\n')          # quoted comma
    write(f"{d}/raw/part-0.csv", "product_id,prediction\np8,0.5\n")       # raw* folder
    write(f"{d}/raw_6.csv", "product_id,prediction\np10,\nproduct_id prediction,7.0\n")   # a data line like a header
    write(f"{d}/raw_7.csv", "product_id,note\np11,only a note\n")      # no prediction: a null one
    os.makedirs(f"{d}/raw_8.csv.d", exist_ok=True)
    with open(f"{d}/raw_9.csv", "wb") as f:
        f.write(b"product_id,prediction\n\xff\xfe,1.0\n")                # not text: skipped
    write(f"{d}/other.csv", "product_id,prediction\np9,9.0\n")            # not raw*
    write(f"{root}/zen/2024-03-02/raw_0.csv", "product_id,prediction\nq1,1.0\n")
    write(f"{root}/acme/2024-03-02/raw_0.csv", "product_id,prediction\nq2,1.0\n")


def test_bid_reader_file_rules(spark, tmp_dir):
    bid_tree(tmp_dir)
    df = files.read_bid_changes(spark, tmp_dir, "acme", "2024-03-01")
    got = sorted((r.product_id, r.prediction) for r in df.collect())
    assert got == [("p,7", 6.0), ("p1", 5.0), ("p10", None), ("p11", None), ("p2", 3.0), ("p3", 4.0), ("p6", None),
                   ("p8", 0.5), ("product_id prediction", 7.0)]
    assert {r.client for r in df.collect()} == {"acme"}
    more = files.read_bid_changes(spark, tmp_dir, "acme", "2024-03-01", extra=("extra", "note")).collect()
    assert {(r.product_id, r.extra, r.note) for r in more if r.extra or r.note} == {
        ("p1", "x", None), ("p2", "y", None), ("p11", None, "only a note")}
    assert files.read_bid_changes(spark, f"{tmp_dir}/nowhere").count() == 0


def test_bid_partitions_listing(spark, tmp_dir):
    bid_tree(tmp_dir)
    got = sorted(tuple(r) for r in files.list_bid_partitions(spark, tmp_dir).collect())
    assert got == [("acme", "2024-03-01"), ("acme", "2024-03-02"), ("zen", "2024-03-02")]
    from vigil.plans import bids
    parts = files.list_bid_partitions(spark, tmp_dir)
    assert [r.client for r in bids.list_clients(parts).collect()] == ["acme"]


def test_site_config_json(spark, tmp_dir):
    p = f"{tmp_dir}/site_config.json"
    write(p, json.dumps([{"short_name": "acme", "site_id": 7, "percent_prediction_threshold": .3},
                         {"short_name": "zen", "site_id": 8, "percent_prediction_threshold": .2}],
                        indent=2))
    got = sorted(tuple(r) for r in files.read_site_config(spark, p).collect())
    assert got == [("acme", 7, .3), ("zen", 8, .2)]


def test_model_eval_by_day(spark, tmp_dir):
    write(f"{tmp_dir}/model_eval_2024-03-01.csv",
          "model,model_id,short_name,type,ud,rmse,vi,training,testing,start,end\n"
          "m,1,x,gbm,web,0.5,\"{'a': 1, 'b': 2}\",100,25,2024-01-01,2024-01-30\n")
    df = files.read_model_eval(spark, tmp_dir, "2024-03-01")
    r = df.collect()[0]
    assert r.rmse == 0.5 and r.vi == "{'a': 1, 'b': 2}"


def test_complaints_csv_multiline(spark, tmp_dir):
    p = f"{tmp_dir}/complaints.csv"
    write(p, 'Date received,Consumer complaint narrative\n'
             '2015-01-01,"I paid XXXX, then\nagain ""twice"""\n2015-01-02,\n')
    df = files.read_complaints(spark, p)
    texts = [r.text for r in df.collect()]
    assert texts == ['I paid XXXX, then\nagain "twice"']


def test_complaints_keep_their_own_id(spark, tmp_dir):
    p = f"{tmp_dir}/complaints.csv"
    write(p, 'Complaint ID,Consumer complaint narrative\n7,"a\nb"\n3,\n5,""\n')
    got = sorted((r.doc_id, r.text) for r in files.read_complaints(spark, p).collect())
    assert got == [(7, "a\nb")]   # an empty narrative is none


def test_documents_glob_whole_files(spark, tmp_dir):
    write(f"{tmp_dir}/docs/a.txt", "first line\nsecond line\n")
    write(f"{tmp_dir}/docs/b.txt", "other")
    with open(f"{tmp_dir}/docs/c.txt", "wb") as f:
        f.write("caf\xe9 x".encode("latin-1"))
    got = sorted((r.doc_id, os.path.basename(r.path), r.text) for r in
                 files.read_documents(spark, f"{tmp_dir}/docs/*.txt").collect())
    assert got == [(0, "a.txt", "first line\nsecond line\n"), (1, "b.txt", "other"), (2, "c.txt", "caf\xe9 x")]
    from vigil.plans import text   # the ids are what the text jobs take
    toks = text.clean_tokens(files.read_documents(spark, f"{tmp_dir}/docs/*.txt"))
    assert {r.word for r in toks.where("doc_id = 2").collect()} == {"caf\xe9", "x"}


def test_timesheet_sink_by_day(spark, tmp_dir):
    df = spark.sql("select 'k' as key, 1L as k, 'p' as Project, "
                   "timestamp_ntz'2024-01-02 10:00:00' as Start, "
                   "timestamp_ntz'2024-01-02 11:00:00' as `End`, 3600.0 as `Time Spent`")
    files.write_timesheet(df, f"{tmp_dir}/sheet")
    assert os.path.isfile(f"{tmp_dir}/sheet/timesheet_2024-01-02.csv")
    back = spark.read.option("header", True).csv(f"{tmp_dir}/sheet")
    assert back.select("Project").collect()[0][0] == "p"


def test_timesheet_reads_back_with_microseconds(spark, tmp_dir):
    df = spark.sql("select 'k' as key, 1L as k, 'p' as Project, timestamp_ntz'2024-01-02 10:00:00.000123' as Start, "
                   "cast(null as timestamp_ntz) as `End`, cast(null as double) as `Time Spent`")
    files.write_timesheet(df, f"{tmp_dir}/sheet")
    assert files.read_timesheet(spark, f"{tmp_dir}/sheet", df.schema).collect() == df.collect()


def test_parquet_sink(spark, tmp_dir):
    files.write_table(spark.range(3).withColumn("v", F.col("id") * 2), f"{tmp_dir}/t")
    assert spark.read.parquet(f"{tmp_dir}/t").count() == 3


def test_named_files_are_written_whole_or_not_at_all(spark, tmp_dir):
    import pytest

    from vigil.sources.named_files import write_files
    pieces = spark.createDataFrame([("a/x.txt", b"1"), ("a/x.txt", b"2"), ("y.txt", b"")], "name string, piece binary").coalesce(1)
    write_files(pieces, f"{tmp_dir}/f")
    assert open(f"{tmp_dir}/f/a/x.txt").read() == "12" and os.path.getsize(f"{tmp_dir}/f/y.txt") == 0
    for bad in ([("z.txt", b"3"), (None, b"")], [("z.txt", b"3"), ("../q", b"")], [("z.txt", b"3"), ("y.txt", b"4")],
                [("z.txt", b"3"), ("w.txt", b""), ("z.txt", b"5")]):
        failing = spark.createDataFrame(bad, "name string, piece binary").coalesce(1)
        before = sorted(os.listdir(f"{tmp_dir}/f"))
        if bad[-1][0] == "y.txt":   # stands there already: found when the job commits
            before = None
        with pytest.raises(Exception):
            write_files(failing, f"{tmp_dir}/f")
        if before:
            assert sorted(os.listdir(f"{tmp_dir}/f")) == before
        assert not [n for n in os.listdir(f"{tmp_dir}/f") if n.startswith("_temporary")]
    assert os.path.getsize(f"{tmp_dir}/f/y.txt") == 0
    write_files(pieces, f"{tmp_dir}/f", "overwrite")
    assert sorted(os.listdir(f"{tmp_dir}/f")) == ["_SUCCESS", "a", "y.txt"]


def test_vector_lookups_shuffle_ids_only(spark, tmp_dir):
    from vigil.plans import text
    vectors = spark.range(200).select("id", F.array(F.col("id") * 1.0).alias("v"))
    store = spark.table(files.write_vectors(vectors, f"{tmp_dir}/v", buckets=4))
    ids = spark.range(300).select((F.col("id") % 150 * 2).alias("id"), F.col("id").alias("at"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = text.lookup_vectors(ids, store)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert sorted((r.at, r.v) for r in rows) == sorted((i, [i % 150 * 2.0]) for i in range(300) if i % 150 * 2 < 200)


def test_documents_are_listed_and_read_in_tasks(spark, tmp_dir):
    """No file index on the driver; folders of folders, hidden names and other suffixes."""
    for i in range(30):
        write(f"{tmp_dir}/d/{i // 10}/{i:03d}.txt", f"text {i}")
    for odd in ("d/0/_x.txt", "d/0/.y.txt", "d/_h/z.txt", "d/0/x.csv", "d/top.txt"):
        write(f"{tmp_dir}/{odd}", "no")
    found = files.read_documents(spark, f"{tmp_dir}/d/*/*.txt")
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.inputFiles() == []
    got = sorted((r.doc_id, r.path, r.text) for r in found.collect())
    assert got == [(i, f"file:{tmp_dir}/d/{i // 10}/{i:03d}.txt", f"text {i}") for i in range(30)]
    assert files.read_documents(spark, f"{tmp_dir}/d/*/*.none").count() == 0


def test_bid_parts_come_as_batches(spark, tmp_dir):
    import pyarrow as pa

    from vigil.sources import named_files
    write(f"{tmp_dir}/b/c/2024-01-01/raw_0.csv", "note,product_id,prediction,note\na,p,1.5,b\n,,nan\n")
    reader = named_files.BidPartsReader({"path": f"{tmp_dir}/b"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(isinstance(b, pa.RecordBatch) for b in batches)
    rows = [r for b in batches for r in b.to_pylist()]
    assert [(r["product_id"], r["prediction"], r["others"]) for r in rows] == [("p", 1.5, [("note", "b")]), (None, None, [("note", None)])]
    names = pa.RecordBatch.from_arrays([pa.array(["x", "x", "y", "x"]), pa.array([b"1", b"2", b"", b"3"])], ["name", "piece"])
    assert [(n, bytes(c)) for n, c in named_files.runs_of_names(names.slice(1))] == [("x", b"2"), ("y", b""), ("x", b"3")]
