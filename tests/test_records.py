"""Edge files as a data source, for tables and streams."""

import numpy as np
import pytest

from weald.schema import EDGE
from weald.sources import files, records

ROWS = [(0, 1, 254), (2**32 - 1, 5, 1), (7, 7, 0)]


@pytest.fixture(autouse=True)
def known(spark):
    records.register(spark)


def read(spark, path, schema=EDGE):
    return spark.read.format(records.FORMAT).schema(schema).load(str(path))


def test_tables_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame(ROWS, EDGE).repartition(3)
    out = str(tmp_path / "out")
    df.write.format(records.FORMAT).mode("append").save(out)
    assert sorted(map(tuple, read(spark, out).collect())) == sorted(ROWS)
    assert sorted(map(tuple, files.read_binary(spark, out).collect())) == sorted(ROWS)
    assert sorted(r[0] for r in read(spark, out, "weight bigint").collect()) == [0, 1, 254]
    df.write.format(records.FORMAT).mode("append").save(out)
    assert read(spark, out).count() == 6
    df.limit(1).write.format(records.FORMAT).mode("overwrite").save(out)
    assert read(spark, out).count() == 1
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]
    spark.createDataFrame([], EDGE).write.format(records.FORMAT).mode("append").save(str(tmp_path / "none"))
    assert read(spark, tmp_path / "none").count() == 0


def test_large_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    np.array([(i, i + 1, i % 256) for i in range(1000)], files.RECORD).tofile(tmp_path / "a.bin")
    monkeypatch.setattr(records, "RANGE", 9 * 300)
    reader = records.RecordReader(str(tmp_path), ["u"])
    parts = reader.partitions()
    assert [(p.begin, p.size) for p in parts] == [(0, 2700), (2700, 2700), (5400, 2700), (8100, 900)]
    assert [x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()] == list(range(1000))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([*ROWS, (0, 1, 256)], EDGE).repartition(2, "weight")
    with pytest.raises(Exception, match="does not fit"):
        df.write.format(records.FORMAT).mode("append").save(str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []


@pytest.mark.parametrize("name,match", [("none.bin", "no such file"), ("short.bin", "within a record")])
def test_wrong_files(spark, tmp_path, name, match):
    (tmp_path / "short.bin").write_bytes(b"1234567890")
    with pytest.raises(Exception, match=match):
        read(spark, tmp_path / name).count()
    with pytest.raises(Exception, match="not .'x'"):
        read(spark, tmp_path, "x bigint").count()


def test_streams_are_written(spark, tmp_path):
    source = tmp_path / "in"
    for row in ROWS:
        spark.createDataFrame([row], EDGE).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(EDGE).option("maxFilesPerTrigger", 2).parquet(str(source))
    query = stream.writeStream.format(records.FORMAT).option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(map(tuple, read(spark, tmp_path / "out").collect())) == sorted(ROWS)
    assert len({p.name[:14] for p in (tmp_path / "out").iterdir()}) == 2
    writer = records.RecordStreamWriter(str(tmp_path / "out"), False)  # a batch that is written again replaces its files
    writer.commit([], 1)
    assert len({p.name[:14] for p in (tmp_path / "out").iterdir()}) == 1
