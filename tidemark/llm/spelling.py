"""Spelling variants: words one letter apart, found by joining sums of letter powers.

A word's anagram key is the sum of the fifth powers of its letters' numbers. A letter more, fewer or exchanged changes
the key by a power or a difference of two: two words one letter apart have equal keys once that letter has been taken
off the one that has it, or off both. Only the vocabulary is joined, at most one row a distinct letter of a word, and
the order of the letters is verified on the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: Letters by number, a to z and then U+00C0 to U+00FF, and the exponent of their powers. Sums of up to 10^9 letters fit
#: in a long.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
EXPONENT = 5
NUMBER = np.zeros(256, dtype=np.int64)
NUMBER[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)

#: Distinct words that a task counts before it passes the counts on.
HELD = 200_000
#: Members of one key beyond which they also meet by the order of their letters.
CROWD = 64


def _counter(lose_every: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            words, n = list(counts), np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
            counts.clear()
            for at in range(0, len(words), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 8192], pa.string()), pa.array(n[at : at + 8192])], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(RUN.findall(text)).items():
                    word = word.lower() if word.isascii() else word.translate(LOWER)
                    if lose_every:
                        h = zlib.crc32(word.encode(), start)
                        if h % lose_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= min_chars:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) >= HELD:
                    yield from flushed()
        yield from flushed()

    return common.lean(run)


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3, lose_every: int = 0) -> DataFrame:
    """(word, n): maximal runs of Latin letters of all texts, A-Z in lower case, of at least ``min_chars`` code points,
    that occur at least ``min_count`` times overall.

    ``lose_every``: a run whose CRC-32 behind its document's id and a colon is divisible by it loses the letter at that
    number modulo its length first, as a typist would; 0 changes nothing. Null and empty texts have no words; a null
    id is an empty string. Repeated rows count as often. No rows give no words. Words are counted in each task, then
    in the shuffle's map side, so that no frequent word is a large group. Other columns are ignored.
    """
    common.tuned(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    counted = rows.mapInArrow(_counter(lose_every, min_chars), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, letter, rest, size): the anagram key with one letter taken off, for each distinct letter and for none
    (letter 0), and the number of letters left."""
    for batch in batches:
        row, letter, rest, size = [], [], [], []
        for k, word in enumerate(batch.column(0).to_pylist()):
            number = NUMBER[np.frombuffer(word.encode("latin-1"), dtype=np.uint8)]
            key = int((number**EXPONENT).sum())
            for x in (0, *np.unique(number).tolist()):
                row.append(k)
                letter.append(x)
                rest.append(key - x**EXPONENT)
                size.append(len(word) - (x > 0))
        own = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(letter, pa.int32()), pa.array(rest, pa.int64()), pa.array(size, pa.int64())], names=["word", "n", "letter", "rest", "size"])


def near_words(words: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """(word, n, other, other_n), in both directions: words that differ by one letter added, removed or exchanged.

    ``words``: distinct ``word`` of the letters of ``LETTERS``, and ``n``. No words give no rows. Words meet by anagram
    key and size, and never with the same letter taken off, so anagrams do not meet at all. More than ``crowd`` members
    of a key meet by the letters that are left in their order as well, which near words share: work follows the
    pairs found, however many anagrams a vocabulary has. Every pair is verified on the whole words.
    """
    common.tuned(words.sparkSession)
    keys, _ = common.staged(words.select("word", "n").mapInArrow(common.lean(_keyed), "word string, n long, letter int, rest long, size long"), "anagram-keys")
    crowded = keys.groupBy("rest", "size").agg(F.count("*").alias("members")).where(F.col("members") > crowd).select("rest", "size", F.lit(True).alias("crowded"))
    # the order of what is left, by every place of the letter taken off; crowds alone need it
    letter = F.substring(F.lit(LETTERS), F.col("letter"), F.lit(1))
    without = lambda i: F.xxhash64(F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.char_length("word"))))
    places = F.filter(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.substring("word", i, F.lit(1)) == letter)
    orders = F.when(F.col("crowded").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("letter") == 0, F.array(F.xxhash64("word"))).otherwise(F.array_distinct(F.transform(places, without)))
    met = keys.join(crowded.hint("merge"), ["rest", "size"], "left").select("word", "n", "letter", "rest", "size", F.explode(orders).alias("order"))
    met, _ = common.staged(met, "anagram-members")
    a, b = (met.select("rest", "size", "order", *[F.col(c).alias(f"{side}_{c}") for c in ("word", "n", "letter")]) for side in ("a", "b"))
    pairs = a.join(b.hint("merge"), ["rest", "size", "order"]).where("a_letter < b_letter").where(F.levenshtein("a_word", "b_word", 1) == 1)
    pairs = pairs.select("a_word", "a_n", "b_word", "b_n").distinct()
    both = F.explode(F.array(F.struct(F.col("a_word").alias("word"), F.col("a_n").alias("n"), F.col("b_word").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b_word").alias("word"), F.col("b_n").alias("n"), F.col("a_word").alias("other"), F.col("a_n").alias("other_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def forms(words: DataFrame, near: DataFrame, *, times: float = 2) -> DataFrame:
    """(word, n, n_near, form, form_n): of each word the near word of the largest count, the smallest in code-point order
    on a tie, if it counts at least ``times`` the word's own; else null. A word without near words has ``n_near`` 0."""
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    best = best.select(F.col("word").alias("near_word"), "n_near", F.col("best.other").alias("form"), (-F.col("best.minus")).alias("form_n"))
    joined = words.join(best.hint("merge"), F.col("word") == F.col("near_word"), "left")
    able = F.col("form_n") >= times * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(able, F.col("form")).alias("form"), F.when(able, F.col("form_n")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """``forms`` with ``root``: from each word, forms followed to the last; the word itself if it has none.

    Counts grow by ``times`` > 1 a step, so there are no circles and chains are short; every round doubles the steps
    followed, each written before the next reads it, until no word moves.
    """
    spark = found.sparkSession
    steps, at = common.staged(found.where("form is not null").select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        on = steps.select(F.col("word").alias("from_word"), F.col("root").alias("to_word"))
        further = steps.join(on, F.col("root") == F.col("from_word"), "left").select("word", F.coalesce("to_word", "root").alias("root"), F.col("from_word").isNotNull().alias("moved"))
        further, new = common.staged(further, "spelling-steps")
        done = further.where("moved").isEmpty()
        common.remove(spark, at)
        steps, at = further.select("word", "root"), new
        if done:
            break
    last = steps.select(F.col("word").alias("step_word"), "root").hint("merge")
    return found.join(last, F.col("word") == F.col("step_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3, lose_every: int = 0, times: float = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``word_counts``; nulls, repeats and empty tables as there."""
    words, _ = common.staged(word_counts(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_count=min_count, lose_every=lose_every), "words")
    found, _ = common.staged(forms(words, near_words(words), times=times), "spelling-forms")
    return with_roots(found)


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(common.table(spark, sf_dir, "documents"), lose_every=97)


#: CRC-32 of a list of bytes, by a table of 256 numbers.
CRC_SQL = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
CRC_OF = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295)"

OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents)
  GROUP BY doc_id, w
), spelt AS (
  SELECT w, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END)) AS b FROM runs
), hashed AS (
  SELECT w, n, {CRC_OF.format(bytes="b")} AS h FROM spelt, crc_table
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
), found AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM found
  UNION ALL SELECT walk.word, found.form FROM walk JOIN found ON found.word = walk.root WHERE found.form IS NOT NULL
), roots AS (
  SELECT walk.word, walk.root FROM walk JOIN found ON found.word = walk.root WHERE found.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM found JOIN roots USING (word)
"""
