"""Jaccard join on word n-grams with Bayesian candidate pruning.

Texts with equal n-gram sets are one class. Class representatives meet in MinHash bands; candidate pairs compare
their MinHash values a few at a time and are dropped once the posterior probability of reaching the threshold is
below a tolerance (Satuluri and Parthasarathy 2012, uniform prior); what is left is verified on the whole sets.

Where many different texts share a bucket, their pairs are not emitted: the texts of such overlapping buckets form a
group, blocks of the group meet in tasks, and a task returns its link counts and a spanning forest of its links.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.components import PER_FILE, components

BANDS, ROWS = 45, 6
#: MinHash values compared by the pruning, 16 bits each.
COMPARED = 128
#: At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**6)**45 = 1.1e-6.
TOLERANCE = 1e-7
#: Buckets of more representatives than this make groups; smaller ones emit at most 15.5 pairs a row.
SMALL = 32
#: Texts, and bytes of their n-gram sets, in one block of a group; a task holds two blocks.
BLOCK, BLOCK_BYTES = 512, 64 << 20
#: Members of a large bucket that meet in one task.
PART = 256
LOW = -(1 << 63)

_rng = np.random.default_rng(20_240_229)
MULTIPLY = _rng.integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
POWERS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
BAND_SALT = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Words(dict):
    """64-bit hashes of words, kept for one task: about 15 MB of them, and no long words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= 100_000:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: str | None, width: int, known: Words | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words (runs without ASCII blanks). A text of fewer words, but
    not none, has all its words as its only n-gram. ``known``: hashes of words met before."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map((Words() if known is None else known).__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h += (w[i : len(w) - k + 1 + i] ^ (w[i : len(w) - k + 1 + i] >> np.uint64(32))) * POWERS[i]
    return np.unique(mixed(h))


def min_hashes(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 512):
        y = x[None, i : i + 512] * MULTIPLY[0][:, None] + ADD[:, None]
        y ^= y >> np.uint32(15)
        y *= MULTIPLY[1][:, None]
        np.minimum(out, y.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    h = BAND_SALT.copy()
    for k in range(ROWS):
        h = mixed(h ^ m[k::ROWS].astype(np.uint64))
    return h.view(np.int64)


@functools.cache
def least_matches(threshold: float, tolerance: float = TOLERANCE, step: int = 16) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches to go on). With a uniform prior, P(similarity >= t | m of n match) is the
    probability of at most m successes in n + 1 trials of t."""
    out = []
    for n in range(step, COMPARED + 1, step):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the pairs (rows of two signature arrays) that pruning leaves."""
    live, matches, done = np.arange(len(left)), np.zeros(len(left), dtype=np.int64), 0
    for n, least in least_matches(threshold):
        matches = matches + (left[live, done:n] == right[live, done:n]).sum(axis=1)
        ok = matches >= least
        live, matches, done = live[ok], matches[ok], n
    return live


def reaches(both: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """both / (a + b - both) >= threshold in whole numbers of a millionth."""
    t = round(threshold * 1_000_000)
    return (both > 0) & (both * 1_000_000 >= t * (a + b - both))


SIGNED = pa.schema([("row_id", pa.int64()), ("body", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def _signer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, width, known)
                m = min_hashes(s)
                for c, v in zip(columns, (xxhash.xxh128_digest(s.tobytes()), len(s), band_keys(m) if len(s) else np.zeros(0, dtype=np.int64), m[:COMPARED].astype("<u2").tobytes())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, SIGNED.types[2:]))], schema=SIGNED)

    return common.lean(run)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a small bucket but those inside one group, smaller id first."""
    for batch in batches:
        a, b = [], []
        for members in batch.column(0).to_pylist():
            members = sorted((m["key"], m["grp"]) for m in members)
            for i, (x, g) in enumerate(members):
                for y, h in members[i + 1 :]:
                    if g != h or g < 0:
                        a.append(x)
                        b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _pruned(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u2").reshape(-1, COMPARED) for k in ("sig", "sig_b"))
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(survivors(left, right, threshold))) for k in ("a", "b")], names=["a", "b"])

    return common.lean(run)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows that share an id, only those with the set of the class."""
        known = Words()
        for batch in batches:
            keys, sets = [], []
            for key, digest, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                s = shingle_set(text, width, known).tobytes()
                if xxhash.xxh128_digest(s) == digest:
                    keys.append(key)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return common.lean(run)


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("shingles").to_pylist(), batch.column("shingles_b").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep.append(bool(reaches(np.int64(both), np.int64(len(x)), np.int64(len(y)), threshold)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in ("a", "b")], names=["a", "b"])

    return common.lean(run)


def linked(sigs: np.ndarray, sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs rows x cols (all other values False) reach the threshold: pruned, then verified whole."""
    out = np.zeros((len(rows), len(cols)), dtype=bool)
    alive = np.ones((len(rows), len(cols)), dtype=bool)
    matches, done = np.zeros((len(rows), len(cols)), dtype=np.int16), 0
    for n, least in least_matches(threshold):
        for k in range(done, n):
            matches += sigs[rows, k][:, None] == sigs[cols, k][None, :]
        alive &= matches >= least
        done = n
    r, c = (np.flatnonzero(alive.any(axis=axis)) for axis in (1, 0))
    if not len(r):
        return out
    # whole intersections of the surviving rows and columns: incidence matrices over the n-grams that both sides have
    left, right = [sets[i] for i in rows[r]], [sets[i] for i in cols[c]]
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    both = np.zeros((len(r), len(c)), dtype=np.float32)
    for at in range(0, len(shared), 4096):
        part = shared[at : at + 4096]
        sides = []
        for side in (left, right):
            table = np.zeros((len(side), len(part)), dtype=np.float32)
            for k, s in enumerate(side):
                own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                place = np.searchsorted(part, own)
                table[k, place[part[np.minimum(place, len(part) - 1)] == own]] = 1
            sides.append(table)
        both += sides[0] @ sides[1].T
    size = np.array([len(s) for s in sets], dtype=np.int64)
    ok = reaches(both.astype(np.int64), size[rows[r]][:, None], size[cols[c]][None, :], threshold)
    out[np.ix_(r, c)] = ok & alive[np.ix_(r, c)]
    return out


def _blocks(threshold: float):
    def links_of(table: pa.Table) -> pa.Table:
        """Links of one pair of blocks: each text's count, and an edge for each text of a spanning forest."""
        keys, order = np.unique(table.column("key").to_numpy(), return_index=True)
        block = table.column("block").to_numpy()[order]
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype="<u2").reshape(-1, COMPARED)[order]
        raw = table.column("shingles").to_pylist()
        sets = [np.frombuffer(raw[i], dtype=np.uint64) for i in order]
        one = table.column("one")[0].as_py()
        rows, cols = np.flatnonzero(block == one), np.flatnonzero(block == table.column("two")[0].as_py())
        n, count = len(keys), np.zeros(len(keys), dtype=np.int64)
        if len(rows) and len(cols):
            links = linked(sigs, sets, rows, cols, threshold)
            if rows[0] == cols[0]:
                np.fill_diagonal(links, False)
            else:
                np.add.at(count, cols, links.sum(axis=0))
            np.add.at(count, rows, links.sum(axis=1))
        root = np.arange(n)
        if count.any():
            x, y = np.nonzero(links)
            x, y = rows[x], cols[y]
            while True:  # smallest label of any neighbour until nothing changes
                new = root.copy()
                np.minimum.at(new, x, root[y])
                np.minimum.at(new, y, root[x])
                new = new[new]
                if (new == root).all():
                    break
                root = new
        keep = np.flatnonzero(count)
        return pa.table({"key": pa.array(keys[keep]), "links": pa.array(count[keep]), "root": pa.array(keys[root[keep]])})

    def run(table: pa.Table) -> pa.Table:
        try:
            return links_of(table)
        finally:
            if table.nbytes > 8 << 20:
                common.release()

    return run


def _stars(large: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the members of each bucket (``h``, ``key``, ``m`` members).

    A bucket may hold a third of all texts, so no task and no join sees a whole one: members are dealt into parts of
    about ``PART``, each joined to its smallest, those smallest dealt and joined again, and the last ones to the
    bucket's smallest, one row for PART**2 members.
    """
    edges, level = None, large
    for size in (PART, PART * PART, None):
        part = F.lit(0).cast("long") if size is None else F.pmod(F.xxhash64("key"), F.ceil(F.col("m") / size))
        lists = level.groupBy("h", part.alias("part")).agg(F.collect_list("key").alias("keys"), F.min("key").alias("b"), F.any_value("m").alias("m"))
        star = lists.select(F.explode("keys").alias("a"), "b").where("a <> b")
        edges = star if edges is None else edges.unionByName(star)
        level = lists.select("h", F.col("b").alias("key"), "m")
    return edges


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document row: id, ``body`` (hash of its text), ``class_id``, ``copy_id``, ``n_links``.

    copy_id: the smallest id of the texts with the same n-gram set. n_links: how many other such sets are linked to
    it, at a Jaccard similarity of ``threshold`` or more. class_id: the smallest id that links lead to.

    Null and empty texts have no n-grams: they are copies of each other without links. Texts shorter than an n-gram
    are copies only of texts of the same words. A null id is smaller than all others and comes back as null.
    Repeated rows are copies. Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    spark = common.tuned(docs.sparkSession)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("row_id"), F.xxhash64(text).alias("body"), text.alias("text"))
    signed, signed_at = common.staged(texts.mapInArrow(_signer(width), "row_id long, body long, digest binary, n long, bands array<long>, sig binary"), "near-signatures")
    grouped = signed.groupBy("digest").agg(F.min("row_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"), F.any_value("n").alias("n"))
    # a number for each class, as ids may repeat with other texts
    classes, classes_at = common.staged(grouped.withColumn("key", F.monotonically_increasing_id()), "near-classes")
    members, members_at = common.staged(signed.select("row_id", "body", "digest"), "near-members")
    common.remove(spark, signed_at)

    rows = classes.select("key", F.explode("bands").alias("h"))
    # tables joined by a key that may be hot are staged: Spark splits such a key between two tables, not beside an aggregate
    sizes, sizes_at = common.staged(rows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").withColumnRenamed("h", "size_h"), "near-sizes")
    buckets, buckets_at = common.staged(rows.join(sizes.hint("merge"), F.col("h") == F.col("size_h")).select("h", "key", "m"), "near-buckets")

    groups, groups_at = common.staged(components(_stars(buckets.where(F.col("m") > SMALL))).withColumnRenamed("root", "grp"), "near-groups", per_file=PER_FILE)

    small = buckets.where(F.col("m") <= SMALL).join(groups.hint("merge"), F.col("key") == F.col("node"), "left").select("h", "key", F.coalesce("grp", F.lit(-1)).alias("grp"))
    lists = small.groupBy("h").agg(F.collect_list(F.struct("key", "grp")).alias("members")).select("members")
    pairs = lists.mapInArrow(_pairs, "a long, b long").distinct()
    sig_a = classes.select(F.col("key").alias("key_a"), "sig")
    sig_b = classes.select(F.col("key").alias("key_b"), F.col("sig").alias("sig_b"))
    candidates = pairs.join(sig_a.hint("merge"), F.col("a") == F.col("key_a")).join(sig_b.hint("merge"), F.col("b") == F.col("key_b")).select("a", "b", "sig", "sig_b")
    left, left_at = common.staged(candidates.mapInArrow(_pruned(threshold), "a long, b long"), "near-candidates")
    common.remove(spark, buckets_at, sizes_at)

    # whole sets of the texts that stand for a class in a candidate or a group
    wanted = left.select(F.col("a").alias("w")).unionByName(left.select(F.col("b").alias("w"))).unionByName(groups.select(F.col("node").alias("w"))).distinct()
    chosen = classes.join(wanted.hint("merge"), F.col("key") == F.col("w"), "left_semi").select("key", "rep", "digest")
    once = texts.join(chosen.hint("merge"), F.col("row_id") == F.col("rep")).dropDuplicates(["row_id", "body", "key"])
    sets, sets_at = common.staged(once.select("key", "digest", "text").mapInArrow(_sets(width), "key long, shingles binary"), "near-sets")
    sets_a = sets.select(F.col("key").alias("key_a"), "shingles")
    sets_b = sets.select(F.col("key").alias("key_b"), F.col("shingles").alias("shingles_b"))
    whole = left.join(sets_a.hint("merge"), F.col("a") == F.col("key_a")).join(sets_b.hint("merge"), F.col("b") == F.col("key_b")).select("a", "b", "shingles", "shingles_b")
    links, links_at = common.staged(whole.mapInArrow(_verified(threshold), "a long, b long").distinct(), "near-links")

    # groups in blocks: a row goes to as many tasks as its group has blocks
    held = groups.join(classes.select(F.col("key").alias("key_n"), "n").hint("merge"), F.col("node") == F.col("key_n"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES))
    counts, counts_at = common.staged(held.groupBy("grp").agg(blocks.cast("int").alias("blocks")).withColumnRenamed("grp", "count_grp"), "near-counts", per_file=PER_FILE)
    dense = (
        groups.join(counts.hint("merge"), F.col("grp") == F.col("count_grp"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(sets.hint("merge"), F.col("node") == F.col("key"))
        .join(sig_a.hint("merge"), F.col("node") == F.col("key_a"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("grp", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "key", "sig", "shingles")
    )
    inside, inside_at = common.staged(dense.groupBy("grp", "one", "two").applyInArrow(_blocks(threshold), "key long, links long, root long"), "near-inside")
    common.remove(spark, sets_at, left_at, counts_at)

    each = links.select(F.explode(F.array("a", "b")).alias("key"), F.lit(1).cast("long").alias("links")).unionByName(inside.select("key", "links"))
    degree = each.groupBy("key").agg(F.sum("links").alias("links")).withColumnRenamed("key", "degree_key")
    roots, roots_at = common.staged(components(links.unionByName(inside.select(F.col("key").alias("a"), F.col("root").alias("b")))), "near-roots", per_file=PER_FILE)
    known = (
        classes.select(F.col("digest").alias("class_digest"), "rep", "key")
        .join(degree.hint("merge"), F.col("key") == F.col("degree_key"), "left")
        .join(roots.hint("merge"), F.col("key") == F.col("node"), "left")
        .select("class_digest", "rep", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "key").alias("root"))
    )
    named, named_at = common.staged(known, "near-named")
    smallest, smallest_at = common.staged(named.groupBy("root").agg(F.min("rep").alias("least")).withColumnRenamed("root", "least_root"), "near-smallest", per_file=PER_FILE)
    named = named.join(smallest.hint("merge"), F.col("root") == F.col("least_root"))
    shown = lambda c: F.when(F.col(c) != LOW, F.col(c))
    out = members.join(named.hint("merge"), F.col("digest") == F.col("class_digest")).select(shown("row_id").alias(id_col), "body", shown("least").alias("class_id"), shown("rep").alias("copy_id"), "n_links")
    result, _ = common.staged(out, "near-result")
    common.remove(spark, classes_at, members_at, groups_at, links_at, inside_at, roots_at, named_at, smallest_at)
    return result


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is their group's ``class_id``, with all their columns, whatever their names.

    Rows of the same id and text count once: one of them stays. Null ids are one document, smaller than all others,
    so a group with a null id keeps that row. Null and empty texts are one group. An empty table gives no rows.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, width=width, threshold=threshold)
    own, stay_id, stay_body = common.fresh_names(docs, "own_body", "stay_id", "stay_body")
    stay = found.where(F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias(stay_id), F.col("body").alias(stay_body)).hint("merge")
    kept = docs.withColumn(own, F.xxhash64(F.col(text_col).cast("string"))).join(stay, F.col(id_col).cast("long").eqNullSafe(F.col(stay_id)) & (F.col(own) == F.col(stay_body)), "left_semi")
    return kept.dropDuplicates([id_col, own]).drop(own)


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).drop("body")


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM documents
), shingled AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s
  FROM words
), classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM shingled GROUP BY s
), flat AS (SELECT rep, n, unnest(s) AS g FROM classes
), shared AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM flat a JOIN flat b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL
), links AS (SELECT a, b FROM shared WHERE 10 * k >= 8 * (na + nb - k)
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, other) AS (SELECT a, b FROM sides UNION SELECT r.node, b.b FROM reach r JOIN sides b ON r.other = b.a
), roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node
), degrees AS (SELECT a, count(*) AS n_links FROM sides GROUP BY a)
SELECT d.doc_id, least(c.rep, coalesce(r.root, c.rep)) AS class_id, c.rep AS copy_id, coalesce(g.n_links, 0) AS n_links
FROM shingled d JOIN classes c USING (s) LEFT JOIN roots r ON r.node = c.rep LEFT JOIN degrees g ON g.a = c.rep
"""
