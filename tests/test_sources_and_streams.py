"""Sources, contracts and streams on small files."""

import pytest
from pyspark.sql import functions as F

from cellwise.operators import contracts
from cellwise.sources import tables
from cellwise.streaming import incremental


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfid,x\n1,2\n")
    assert tables.csv_table(spark, str(tmp_path / "a.csv")).columns == ["id", "x"]
    spark.createDataFrame([(1, True), (2, None)], "id int, download boolean").write.parquet(str(tmp_path / "p"))
    assert {r.id: r.available for r in tables.locations(spark, str(tmp_path / "p")).collect()} == {1: True, 2: False}
    files = spark.createDataFrame([(f"d/{p}_{h}.jpg",) for p in ("a", "b_90") for h in (0, 90, 180, 270)] + [("c_0.jpg",), ("c_0.jpg",), ("x.txt",)], "path string")
    assert sorted(r.row for r in tables.complete_rows(files).collect()) == ["a", "b_90"]
    parts = [tables.shard(spark.range(50), "id", i, 3).count() for i in range(3)]
    assert sum(parts) == 50 and min(parts) > 0
    tables.write_partitioned(spark.range(20).withColumn("city", F.col("id") % 3), str(tmp_path / "w"), "city")
    assert spark.read.parquet(str(tmp_path / "w")).where("city = 1").count() == 7


def test_contracts(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "id int, x double")
    assert contracts.require(df, has_id="id IS NOT NULL") is df
    with pytest.raises(contracts.ContractError, match="share"):
        contracts.require(df, share="x BETWEEN 0 AND 1")
    assert contracts.same_rows(df, df.where("id = 1"), ["id"]) == 1 and contracts.same_rows(df, df, ["id"]) == 0
    made = []
    make = lambda: (made.append(1), df)[1]
    for _ in range(2):
        assert contracts.stage(spark, str(tmp_path), "s", contracts.identity(a=1, b=[2]), make).count() == 2
    assert made == [1] and contracts.identity(b=[2], a=1) == contracts.identity(a=1, b=[2])


def test_streams(spark, tmp_path):
    rows = [(f"g{i % 3}", i, float(i * 37 % 101)) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], "g string, id int, v double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("g string, id int, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    incremental.keep_top(stream, str(tmp_path / "top"), ["g"], "v", "id", 4, str(tmp_path / "c1")).awaitTermination()
    got = {(r.g, r.id) for r in spark.read.parquet(str(tmp_path / "top/version=2")).collect()}
    assert got == {(g, i) for g in ("g0", "g1", "g2") for _, i in sorted((-v, i) for h, i, v in rows if h == g)[:4]}
    q = incremental.running_moments(stream, ["g"], "v").writeStream.format("memory").queryName("moments").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("moments").where("g = 'g1'").first()
    values = [v for g, _, v in rows if g == "g1"]
    assert r.n == 20 and r.mean == pytest.approx(sum(values) / 20) and r.peak == max(values)
