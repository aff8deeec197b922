"""Quality rules by weak supervision.

Rules vote good or bad or abstain. Expectation-maximisation over the counts of vote patterns of all documents
estimates each rule's accuracy on good and on bad documents and the share of good ones; the posterior probability of
quality given a document's votes then decides, in place of a filter that every rule must pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

SPACE = " \t\n\x0b\x0c\r"
NOT_SYMBOL = re.compile(r"[^#*$%&|<>]+")
WORDS = re.compile(r"[^ \t-\r]+")
#: What str.split() takes for space beyond the six characters that separate words here.
OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Rules in the order of their votes.
RULES = ("length", "symbols", "repeats", "dup_lines", "capitals", "word_length", "plain_words", "line_ends", "variety")

FEATURES = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("votes", pa.string())])
FEATURES_SQL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes string"


def repeated_words(words: list[str], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, each word once."""
    grams = list(zip(*(islice(words, k, None) for k in range(width))))
    if len(grams) == len(seen := set(grams)):
        return 0
    twice = {g for g, n in Counter(grams).items() if n > 1} if len(seen) < len(grams) else set()
    total = done = 0
    for i, g in enumerate(grams):
        if g in twice:
            total += i + width - max(done, i)
            done = i + width
    return total


def measure(text: str | None) -> tuple[int, int, int, int, int, str]:
    """The five base counts and the votes ('+', '-' or '0' a rule) of one whole text."""
    text = text or ""
    words = WORDS.findall(text) if OTHER_SPACE.search(text) else text.split()
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(NOT_SYMBOL.sub("", text))
    lines = [x for x in text.split("\n") if x and x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    if not n:
        return 0, 0, symbols, 0, 0, "-" + "0" * (len(RULES) - 1)

    def share(x: float, good: float, bad: float) -> str:
        return "-" if x > bad else "+" if x <= good else "0"

    upper = sum(map(str.isupper, words))
    plain = sum(map(str.isalpha, words)) + sum(w[-1] in ".,;:" and w[:-1].isalpha() for w in words)
    ends = sum(x.rstrip(SPACE)[-1] in ".!?" for x in lines)
    mean = chars / n
    votes = (
        "-" if n < 10 else "+" if n >= 50 else "0",
        share(symbols / n, 0.02, 0.08),
        share(repeats / n, 0.05, 0.20),
        share(dup / len(lines), 0.10, 0.60),
        share(upper / n, 0.10, 0.40),
        "+" if 3.5 <= mean <= 8 else "-" if mean < 2.5 or mean > 12 else "0",
        share(1 - plain / n, 0.15, 0.25 if n >= 50 else 0.50),
        "0" if len(lines) < 3 else share(1 - ends / len(lines), 0.34, 0.97),
        "0" if n < 50 else share(-len(set(words)) / n**0.75, -1.0, -0.4),
    )
    return n, chars, symbols, dup, repeats, "".join(votes)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x) for x in batch.column(1).to_pylist()]
        columns = zip(*rows) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, FEATURES.types[1:]))], schema=FEATURES)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    common.tuned(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(common.lean(_measured), FEATURES_SQL)


def fit(patterns: dict[str, int], rounds: int = 200, tolerance: float = 1e-9) -> dict[str, float]:
    """Posterior probability of quality for each vote pattern.

    Two classes; a rule that votes is right with an accuracy of its own in each class, and whether it abstains tells
    nothing. The start says that a rule seldom blames a good document and misses most bad ones, as each rule is about
    one fault: 0.95 right on good documents, 0.3 on bad, 0.8 of them good. One pseudo-vote for and against keeps the
    accuracies inside (0, 1). With no documents there are no patterns.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    weight = np.array([patterns[k] for k in keys], dtype=float)
    plus = np.array([[c == "+" for c in k] for k in keys], dtype=float)
    minus = np.array([[c == "-" for c in k] for k in keys], dtype=float)
    prior, right_good, right_bad = 0.8, np.full(plus.shape[1], 0.95), np.full(plus.shape[1], 0.3)
    posterior = np.zeros(len(keys))
    for _ in range(rounds):
        good = np.log(prior) + plus @ np.log(right_good) + minus @ np.log1p(-right_good)
        bad = np.log1p(-prior) + minus @ np.log(right_bad) + plus @ np.log1p(-right_bad)
        new = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        moved, posterior = np.abs(new - posterior).max(), new
        if moved < tolerance:
            break
        g, b = weight * posterior, weight * (1 - posterior)
        prior = (g.sum() + 1) / (weight.sum() + 2)
        right_good = (g @ plus + 2) / (g @ (plus + minus) + 3)
        right_bad = (b @ minus + 2) / (b @ (plus + minus) + 3)
    return dict(zip(keys, posterior.tolist()))


def posteriors(rows: DataFrame) -> DataFrame:
    """(votes, quality) from the counts of all vote patterns in ``rows``; at most 3**9 patterns reach the driver."""
    fitted = fit({r[0]: r[1] for r in rows.groupBy("votes").count().collect()})
    return F.broadcast(rows.sparkSession.createDataFrame(list(fitted.items()), "votes string, quality double"))


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (F.lit(100) * n_repeat_words > F.lit(20) * n_words)


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document row: base counts, ``votes``, ``base_failed``, ``quality`` (posterior) and ``kept``.

    Null and empty texts have no words and fail the base test. Repeated rows count as often as they occur, in the
    estimate too. Empty tables give no rows. Other columns are ignored, whatever their names.

    The features are staged once; what reaches the driver is one count per vote pattern, at most 3**9 whatever the
    input, and each pattern's posterior goes back as a broadcast of the same size.
    """
    rows, _ = common.staged(features(docs, id_col, text_col), "quality")
    return (
        rows.join(posteriors(rows), "votes")
        .withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
        .withColumnRenamed("doc_id", id_col)
    )


def _beside(position: int):
    """Rows as they are, with word count, repeated words and votes behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(x) for x in batch.column(position).cast(pa.string()).to_pylist()]
            extra = [pa.array([m[0] for m in found], pa.int64()), pa.array([m[4] for m in found], pa.int64()), pa.array([m[5] for m in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "n", "repeats", "votes"])

    return common.lean(run)


def passing(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``scored`` keeps, with all their columns, whatever their names.

    Null and empty texts fail the base test and go. Ids play no part: rows with null or repeated ids are each kept or
    not by their own text. An empty table gives no rows.

    Every text is measured once: rows are staged with their votes beside them, the vote patterns counted, and the
    table of posteriors, at most 3**9 rows, joined to the staged rows.
    """
    common.tuned(docs.sparkSession)
    n, repeats, votes, fitted, quality = common.fresh_names(docs, "n", "repeats", "votes", "fitted_votes", "quality")
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    shape = T.StructType([*numbered.schema.fields, T.StructField("n", T.LongType()), T.StructField("repeats", T.LongType()), T.StructField("votes", T.StringType())])
    measured = numbered.mapInArrow(_beside(docs.columns.index(text_col)), shape).toDF(*docs.columns, n, repeats, votes)
    marked, _ = common.staged(measured, "quality-measured")
    table = posteriors(marked.select(F.col(votes).alias("votes"))).toDF(fitted, quality)
    kept = marked.join(table, F.col(votes) == F.col(fitted)).where(~base_failed(F.col(n), F.col(repeats)) & (F.col(quality) >= threshold))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return scored(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"), "votes")


#: Letters of category Ll, Lt and Lu stand for cased ones. Words, lines, windows and votes by SQL functions, the estimate as a recursion over one row of lists.
OP6_SQL = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
pos AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM t),
five AS (SELECT r, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e FROM pos WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM five WHERE e IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c, d, e) > 1),
inside AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) AS s(k) GROUP BY r),
base AS (
  SELECT t.r, doc_id, len(w) AS n, length(array_to_string(w, '')) AS chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS symbols,
    len(l) AS lines, len(l) - len(list_distinct(l)) AS dup, coalesce(inside.n, 0) AS again, len(list_distinct(w)) AS kinds,
    len(list_filter(w, lambda x: regexp_matches(x, '^[^\p{Ll}\p{Lt}ªº]*\p{Lu}[^\p{Ll}\p{Lt}ªº]*$'))) AS upper, len(list_filter(w, lambda x: regexp_matches(x, '^\pL+[.,;:]?$'))) AS plain,
    len(list_filter(l, lambda x: regexp_matches(x, '[.!?][\x20\x09-\x0D]*$'))) AS ends
  FROM t LEFT JOIN inside ON t.r = inside.r),
voted AS (
  SELECT doc_id, n, chars, symbols, dup, again, CASE WHEN n = 0 THEN '-00000000' ELSE
    CASE WHEN n < 10 THEN '-' WHEN n >= 50 THEN '+' ELSE '0' END
    || CASE WHEN symbols / n > 0.08 THEN '-' WHEN symbols / n <= 0.02 THEN '+' ELSE '0' END
    || CASE WHEN again / n > 0.20 THEN '-' WHEN again / n <= 0.05 THEN '+' ELSE '0' END
    || CASE WHEN dup / lines > 0.60 THEN '-' WHEN dup / lines <= 0.10 THEN '+' ELSE '0' END
    || CASE WHEN upper / n > 0.40 THEN '-' WHEN upper / n <= 0.10 THEN '+' ELSE '0' END
    || CASE WHEN chars / n BETWEEN 3.5 AND 8 THEN '+' WHEN chars / n < 2.5 OR chars / n > 12 THEN '-' ELSE '0' END
    || CASE WHEN 1 - plain / n > CASE WHEN n >= 50 THEN 0.25 ELSE 0.50 END THEN '-' WHEN 1 - plain / n <= 0.15 THEN '+' ELSE '0' END
    || CASE WHEN lines < 3 THEN '0' WHEN 1 - ends / lines > 0.97 THEN '-' WHEN 1 - ends / lines <= 0.34 THEN '+' ELSE '0' END
    || CASE WHEN n < 50 THEN '0' WHEN kinds / pow(n, 0.75) < 0.4 THEN '-' WHEN kinds / pow(n, 0.75) >= 1.0 THEN '+' ELSE '0' END END AS votes
  FROM base),
patterns AS (SELECT list(votes ORDER BY votes) AS v, list(c ORDER BY votes) AS c FROM (SELECT votes, CAST(count(*) AS DOUBLE) AS c FROM voted GROUP BY votes)),
em AS (
  SELECT 0 AS step, CAST(0.8 AS DOUBLE) AS prior, list_transform(range(9), lambda j: CAST(0.95 AS DOUBLE)) AS g, list_transform(range(9), lambda j: CAST(0.3 AS DOUBLE)) AS b,
    list_transform(v, lambda x: CAST(0 AS DOUBLE)) AS post, CAST(1 AS DOUBLE) AS moved FROM patterns
  UNION ALL
  SELECT step + 1, (list_sum(list_transform(range(1, len(v) + 1), lambda k: c[k] * new[k])) + 1) / (list_sum(c) + 2),
    list_transform(range(1, 10), lambda j: (list_sum(list_transform(range(1, len(v) + 1), lambda k: CASE WHEN v[k][j] = '+' THEN c[k] * new[k] ELSE 0.0 END)) + 2)
      / (list_sum(list_transform(range(1, len(v) + 1), lambda k: CASE WHEN v[k][j] <> '0' THEN c[k] * new[k] ELSE 0.0 END)) + 3)),
    list_transform(range(1, 10), lambda j: (list_sum(list_transform(range(1, len(v) + 1), lambda k: CASE WHEN v[k][j] = '-' THEN c[k] * (1 - new[k]) ELSE 0.0 END)) + 2)
      / (list_sum(list_transform(range(1, len(v) + 1), lambda k: CASE WHEN v[k][j] <> '0' THEN c[k] * (1 - new[k]) ELSE 0.0 END)) + 3)),
    new, list_max(list_transform(range(1, len(v) + 1), lambda k: abs(new[k] - post[k])))
  FROM (
    SELECT *, list_transform(v, lambda x: 1 / (1 + exp(least(700, greatest(-700, ln(1 - prior) - ln(prior) + list_sum(list_transform(range(1, 10), lambda j:
      CASE x[j] WHEN '+' THEN ln(1 - b[j]) - ln(g[j]) WHEN '-' THEN ln(b[j]) - ln(1 - g[j]) ELSE 0.0 END))))))) AS new
    FROM em, patterns WHERE step < 200 AND moved >= 1e-9)),
fitted AS (SELECT unnest(v) AS votes, unnest(post) AS quality FROM (SELECT post FROM em ORDER BY step DESC LIMIT 1), patterns)
SELECT doc_id, n AS n_words, chars AS word_chars, symbols AS n_symbols, dup AS n_dup_lines, again AS n_repeat_words, n < 10 OR 100 * again > 20 * n AS base_failed,
  NOT (n < 10 OR 100 * again > 20 * n) AND quality >= 0.5 AS kept, round(quality, 6) AS quality, votes
FROM voted JOIN fitted USING (votes)
"""
