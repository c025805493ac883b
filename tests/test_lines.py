import pytest
from pyspark.sql import functions as F

from prunecluster.sources import lines, points


@pytest.fixture
def short_splits(spark):
    """Splits of a few lines, several of them in a task."""
    names = {"spark.sql.files.maxPartitionBytes": "90", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def write_files(folder, files):
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


def test_numbers_follow_files_and_splits(spark, tmp_path, short_splits):
    files = {f"f{k}.txt": "".join(f"{k}:{i}\n" + "\n" * (i % 3) for i in range(40 + k)) for k in range(3)}
    path = write_files(tmp_path, files)
    rows = lines.numbered_lines(spark, path, 2).orderBy("file", "line").collect()
    assert [r.value for r in rows] == [f"{k}:{i}" for k in range(3) for i in range(40 + k)]
    assert [r.line for r in rows] == [i for k in range(3) for i in range(40 + k)]
    kept = [r for r in rows if r.line >= 2]
    assert [r.row for r in kept] == list(range(len(kept)))
    assert spark.read.text(path).select(F.spark_partition_id()).distinct().count() > 3


def test_header_behind_skipped_lines(spark, tmp_path, short_splits):
    body = "".join(f'{i},{i / 4},"name, {i}",{i % 2 == 0},{10**12 + i}\n' for i in range(60))
    path = write_files(tmp_path, {"a.csv": "about this file\n\nsecond, line\nid,part,the name,flag,long\n" + body})
    df = lines.read_csv_lines(spark, path, skip_lines=2)
    assert df.dtypes == [("id", "int"), ("part", "double"), ("the name", "string"), ("flag", "boolean"), ("long", "bigint")]
    rows = df.orderBy("id").collect()
    assert tuple(rows[7]) == (7, 1.75, "name, 7", False, 10**12 + 7) and len(rows) == 60
    first = lines.read_csv_lines(spark, path, skip_lines=2, limit=13, schema="id int, part double, n string, f boolean, l long")
    assert sorted(r.id for r in first.collect()) == list(range(13))


def test_the_cut_runs_over_files(spark, tmp_path, short_splits):
    files = {f"{k}.csv": "skipped\nx\n" + "".join(f"{k * 100 + i}\n" for i in range(20)) for k in range(4)}
    path = write_files(tmp_path, files)
    expected = [k * 100 + i for k in range(4) for i in range(20)]
    for limit in (0, 1, 20, 21, 55, 80, 500):
        got = lines.read_csv_lines(spark, path, skip_lines=1, limit=limit, schema="x int")
        assert sorted(r.x for r in got.collect()) == expected[:limit]


def test_odd_files(spark, tmp_path):
    one = write_files(tmp_path, {"a.csv": "skip\na,,c\n1,2\n4,5,6,7\nx,8,9\n"})
    df = lines.read_csv_lines(spark, one, skip_lines=1, schema="a int, b int, c int")
    assert sorted(map(tuple, df.collect()), key=repr) == [(1, 2, None), (4, 5, 6), (None, 8, 9)]
    strict = lines.read_csv_lines(spark, one, skip_lines=1, schema="a int, b int, c int", skip_malformed=True)
    assert strict.where("a is null").count() == 0
    named = lines.read_csv_lines(spark, one, skip_lines=1)
    assert named.columns == ["a", "_c1", "c"] and dict(named.dtypes)["a"] == "string"
    bare = lines.read_csv_lines(spark, one, skip_lines=2, header=False, limit=1)
    assert [tuple(r) for r in bare.collect()] == [(1, 2)]
    with pytest.raises(ValueError, match="no line"):
        lines.read_csv_lines(spark, one, skip_lines=9)
    with pytest.raises(ValueError, match="negative"):
        lines.read_csv_lines(spark, one, skip_lines=-1)
    assert lines.read_csv_lines(spark, one, skip_lines=9, schema="a int").count() == 0


def test_changed_splits_fail(spark, tmp_path, short_splits):
    path = write_files(tmp_path, {"a.csv": "".join(f"{i}\n" for i in range(200))})
    df = lines.numbered_lines(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37")
    with pytest.raises(Exception, match="changed while it was read"):
        df.collect()


def test_datasets_are_kept_by_name(spark, tmp_path):
    path = write_files(tmp_path, {"a.csv": "a,b\n1,2\n3,4\n"})
    loads = []

    def load(spark, name, **options):
        loads.append((name, options))
        return points.load_dataset(spark, name, **options)

    with points.Datasets(spark, load) as datasets:
        first = datasets.get(path, limit=1)
        assert datasets.get(path, limit=1) is first and first.is_cached
        assert first.count() == 1 and datasets.get(path).count() == 2
        assert datasets.get("gaussian_3", n=90, dims=2) is datasets.get("gaussian_3", dims=2, n=90)
    assert [name for name, _ in loads] == [path, path, "gaussian_3"] and not datasets.kept
    assert not first.is_cached
