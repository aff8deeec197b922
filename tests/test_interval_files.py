"""Files of intervals in many parts: the header once, lines in order, the same numbers for any number of tasks."""

from pathlib import Path

from pyspark.sql import functions as F

from tidemark.sources import tables


def test_parts_are_one_file(spark, tmp_path):
    n = 5000
    det = spark.range(n).select(F.concat(F.lit("v"), F.lpad((F.col("id") % 3).cast("string"), 2, "0")).alias("tv"), (F.pmod(F.xxhash64("id"), F.lit(100000)) / 8).alias("start"), F.lit(1.5).alias("length"), F.lit("c").alias("clip"), F.lit(0.5).alias("score")).repartition(5)
    want = sorted((r["tv"], r["start"]) for r in det.collect())
    for parts in ("1", "7"):
        path = tmp_path / f"found{parts}"
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert tables.write_intervals(det, str(path))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        files = sorted(Path(path).glob("part-*"))
        assert len(files) == int(parts)
        lines = [x for f in files for x in f.read_text().splitlines()]
        assert lines[0].startswith("# tv") and not any(x.startswith("#") for x in lines[1:]) and [tuple(x.split("\t")[:2]) for x in lines[1:]] == [(v, str(round(s, 3))) for v, s in want]
        # numbers are those of the parts put together, however they are read
        for most in ("128m", "2000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            got = sorted((r["line_no"], r["tv"], r["start"]) for r in tables.read_intervals(spark, str(path), True)[0].collect())
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            assert [k for k, _, _ in got] == list(range(2, n + 2)) and [(v, s) for _, v, s in got] == [(v, round(s, 3)) for v, s in want]
    assert not tables.write_intervals(det.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_one_file_and_line_breaks(spark, tmp_path):
    (tmp_path / "one.txt").write_text("# head\r\n\r\na\t1\t2\tb\t0.5\r\nbad\n")
    good, bad = tables.read_intervals(spark, str(tmp_path / "one.txt"))
    assert [(r["line_no"], r["tv"]) for r in good.collect()] == [(3, "a")] and [(r["line_no"], r["reason"]) for r in bad.collect()] == [(4, "wrong number of columns")]
