"""The SQL of queries whose hard cases the small tables lack, on fixtures that have them."""

import random
from collections import Counter

import duckdb

from tidemark.llm import quality, warc


def rows_of(con, sql: str, columns: list[str]) -> Counter:
    found = con.sql(sql)
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == sorted(columns)
    return Counter(tuple(r[k] for k in at) for r in found.fetchall())


def same(spark, folder, name: str, query, sql: str) -> int:
    df = query(spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    got = Counter(map(tuple, df.collect()))
    assert got == rows_of(con, sql, df.columns)
    return sum(got.values())


def test_revisits(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}é</p>") for i in range(60)] + [(100, None, None), (90, "u", ""), (5, "http://h/5", "<p>5é</p>"), (None, "n", "<p>0é</p>"), (None, "n", "only")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert same(spark, str(tmp_path), "pages", warc.op3_warc, warc.OP3_SQL) == len(rows)


def test_votes_and_estimate(spark, tmp_path):
    rng = random.Random(8)
    words = ["river", "Stone", "HOUSE", "über", "ÉTÉ", "a1", "x#", "$$", "the", "of", "naïve.", "end.", "日本語", "\xa0", "it's", "&", "ªº", "ok:", "50%"]
    rows = [(None, "no id " * 20), (1, None), (2, ""), (3, " \t\n\n "), (4, "\n"), (5, "one two three four five " * 3), (5, "one two three four five " * 3), (6, "x" * 5000), (7, "a\r\nb\x0bc\x0cd\n" * 9)]
    for i in range(10, 200):
        lines = [" ".join(rng.choices(words[: rng.choice([3, 8, 19])], k=rng.randrange(1, 14))) + rng.choice(["", ".", " ", "?\r"]) for _ in range(rng.randrange(1, 12))]
        rows.append((i, "\n".join(lines + rng.choices(lines, k=rng.choice([0, 0, 3, 30])))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert same(spark, str(tmp_path), "documents", quality.op6_quality, quality.OP6_SQL) == len(rows)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert same(spark, str(tmp_path), "documents", quality.op6_quality, quality.OP6_SQL) == 0
    assert same(spark, str(tmp_path), "pages", warc.op3_warc, warc.OP3_SQL) == 0
