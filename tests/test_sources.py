import pytest
from pyspark.sql import functions as F

from tidemark import sources

PANEL = "sec long, month date, x double"


def panel(spark, rows):
    return spark.createDataFrame([(s, m, float(x)) for s, m, x in rows], "sec long, month string, x double").withColumn("month", F.to_date("month"))


def held(df):
    return sorted((r.sec, str(r.month), r.x) for r in df.collect())


def test_dates_are_replaced_and_others_stay(spark, tmp_path):
    path = f"{tmp_path}/panel"
    first = [(1, "2024-01-31", 1), (2, "2024-01-31", 2), (1, "2024-02-29", 3)]
    for _ in range(2):
        sources.write_dates(panel(spark, first), path)
    sources.write_dates(panel(spark, [(9, "2024-02-29", 4), (9, "2024-03-31", 5)]), path)
    want = [(1, "2024-01-31", 1.0), (2, "2024-01-31", 2.0), (9, "2024-02-29", 4.0), (9, "2024-03-31", 5.0)]
    assert held(spark.read.parquet(path)) == want
    assert held(sources.as_of(spark, path, "2024-02-29")) == want[2:3]


def test_batches_can_be_written_again(spark, tmp_path):
    path, rows = f"{tmp_path}/log", spark.range(5)
    for batch, df in (("a", rows), ("b", rows), ("b", rows.where("id > 2"))):
        sources.append_batch(df, path, batch)
    assert sorted((r.batch, r.id) for r in spark.read.parquet(path).collect()) == [("a", i) for i in range(5)] + [("b", 3), ("b", 4)]
    plain = f"{tmp_path}/plain"
    for mode in ("replace", "append", "replace", "append"):
        sources.write_table(rows, plain, mode)
    assert spark.read.parquet(plain).count() == 10
    info = {(r.table, r.column): (r.present, r.rows, r.type) for r in sources.table_info(spark, {"plain": plain, "gone": f"{tmp_path}/gone"}).collect()}
    assert info == {("plain", "id"): (True, 10, "bigint"), ("gone", None): (False, 0, None)}


def test_a_release_that_breaks_off_is_not_the_latest(spark, tmp_path):
    root, worked = f"{tmp_path}/out", spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            worked.add(len(b))
            yield b

    rows = spark.range(40).mapInPandas(counted, "id long")
    sources.release(spark, {"a": rows, "b": spark.range(3)}, root, "2024-01-31", ("csv", "json"))
    assert worked.value == 40  # once, whatever the number of formats
    broken = spark.range(4).select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        sources.release(spark, {"a": spark.range(7), "b": broken}, root, "2024-02-29")
    assert sources.read_release(spark, root, "a").count() == 40
    for _ in range(2):
        sources.release(spark, {"a": spark.range(8), "b": spark.range(2)}, root, "2024-02-29")
    assert sources.read_release(spark, root, "a").count() == 8 and sources.read_release(spark, root, "a", "2024-01-31").count() == 40
    assert sorted((r.date, r.table, r.rows) for r in sources.manifests(spark, root).collect()) == [("2024-01-31", "a", 40), ("2024-01-31", "b", 3), ("2024-02-29", "a", 8), ("2024-02-29", "b", 2)]
    assert spark.read.json(f"{root}/2024-01-31/a.json").count() == spark.read.csv(f"{root}/2024-01-31/a.csv", header=True).count() == 40
    with pytest.raises(ValueError):
        sources.read_release(spark, root, "c")


def test_files_and_sections(spark, tmp_path):
    for name, text in (("x.csv", "title\r\n\r\n,a,b\r\n202401, 1.5,-99.99\r\n202402,x,-999\r\n202403, 2\r\n Annual \r\n202412, 9, 9\r\n"), ("y.csv", "202401,1,2"), ("z.csv", "nothing\n2024,1,2\n")):
        (tmp_path / name).write_bytes(text.encode())
    got = sorted((r.file, str(r.month), r.a, r.b) for r in sources.factor_files(spark, str(tmp_path), ["a", "b"]).collect())
    assert got == [("x.csv", "2024-01-31", 0.015, None), ("x.csv", "2024-02-29", None, None), ("x.csv", "2024-03-31", 0.02, None), ("y.csv", "2024-01-31", 0.01, 0.02)]
    folder = tmp_path / "f" / "deep"
    folder.mkdir(parents=True)
    (folder / "10-Q_0001-24-000001.txt").write_text("one")
    (tmp_path / "f" / "10-K_0002-24-000002.txt").write_text("two\nlines")
    got = sorted((r.id, r.form, r.content) for r in sources.filings(spark, str(tmp_path / "f")).collect())
    assert got == [("0001-24-000001", "10-Q", "one"), ("0002-24-000002", "10-K", "two\nlines")]
