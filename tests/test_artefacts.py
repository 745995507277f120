"""Artefacts on disk and files as a relation, with values that are missing or not finite."""

import hashlib

from pyspark.sql import functions as F

from motionlake.sources import artefacts as A
from motionlake.sources import files


def test_grid_is_written_in_order_with_blanks(spark):
    rows = [("a", r, c, v) for r, c, v in [(2, 0, 1.5), (2, 1, float("nan")), (0, 0, float("inf")), (0, 1, -2.0), (1, 1, None), (10, 0, 1e-9)]] + [("b", 0, 1, 7.0)]
    df = spark.createDataFrame(rows, "g string, row int, col int, v double").withColumn("t", A.fixed(F.col("v"), 8))
    path = A.put_csv(A.wide(df, ["g", "row"], "col", {0: "c0", 1: "c1"}, "t"), "heat", "g", ["row"])
    lines = {r.value for r in spark.read.text(f"{path}/g=a").withColumn("n", F.monotonically_increasing_id()).collect()}
    assert lines == {"row,c0,c1", "0,,-2.00000000", "1,,", "2,1.50000000,", "10,0.00000000,"}
    back = {(r.g, r.row): (r.c0, r.c1) for r in A.read_csv(spark, path, "row int, c0 double, c1 double, g string").collect()}
    assert back == {("a", 0): (None, -2.0), ("a", 1): (None, None), ("a", 2): (1.5, None), ("a", 10): (0.0, None), ("b", 0): (None, 7.0)}
    ordered = [r.value for r in spark.read.text(f"{path}/g=a").collect()]
    assert [line.split(",")[0] for line in ordered] == ["row", "0", "1", "2", "10"]


def test_wide_fills_what_is_missing(spark):
    df = spark.createDataFrame([(1, "x", "1"), (2, "y", "2")], "k long, b string, t string")
    out = A.wide(df, ["k"], "b", {"x": "bx", "y": "by", "z": "bz"}, "t", F.lit("0"))
    assert out.columns == ["k", "bx", "by", "bz"] and {tuple(r) for r in out.collect()} == {(1, "1", "0", "0"), (2, "0", "2", "0")}
    assert A.wide(df.where("false"), ["k"], "b", {"x": "bx"}, "t").count() == 0


def test_files_are_hashed_and_compared(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    content = {"empty.bin": b"", "a.bin": b"a", "deep/b.bin": b"x" * 3_000_000, "c.bin": b"same", "d.txt": b"left out"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    now = files.hashed(spark, str(tmp_path), "*.bin")
    got = {r.path.rpartition("/")[2]: (r.size, r.sha256) for r in now.collect()}
    assert got == {n.rpartition("/")[2]: (len(d), hashlib.sha256(d).hexdigest()) for n, d in content.items() if n.endswith(".bin") and d}
    assert {r.path for r in files.listed(spark, str(tmp_path), "*.bin").collect()} == {r.path for r in now.collect()}
    before = spark.createDataFrame(now.collect(), now.schema)
    name = F.element_at(F.split("path", "/"), -1)
    old = before.where(name != "a.bin").withColumn("sha256", F.when(name == "b.bin", F.lit("other")).otherwise(F.col("sha256"))).withColumn("modified", F.when(name == "c.bin", F.lit(None)).otherwise(F.col("modified")))
    gone = before.where(name == "a.bin").withColumn("path", F.lit("z.bin"))
    states = {r.path.rpartition("/")[2]: r.state for r in files.compared(now, old.union(gone)).collect()}
    assert states == {"a.bin": "new", "b.bin": "changed", "c.bin": "touched", "z.bin": "gone"}
    assert {r.state for r in files.compared(now, before).collect()} == {"same"}


def test_files_are_hashed_in_pieces_whatever_they_are_called(spark, tmp_path):
    data = bytes(range(256)) * 40_000
    names = ["a b.bin", "c%20d#e?.bin", "é.bin", "packed.gz"]
    for i, name in enumerate(names):
        (tmp_path / name).write_bytes(data[i:])
    want = {(n, len(data) - i, hashlib.sha256(data[i:]).hexdigest()) for i, n in enumerate(names)}
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.hashes.link./in", f"file://{tmp_path}")
    # no file is taken as a whole: a row of more than so many bytes is refused
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1 << 20)
    try:
        for folder in (str(tmp_path), "viewfs://hashes/in"):
            assert {(r.path.rpartition("/")[2], r.size, r.sha256) for r in files.hashed(spark, folder).collect()} == want
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
