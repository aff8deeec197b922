"""Repair of conversation structure: the cheapest edits that make the roles alternate.

A repaired conversation is empty, or an optional system turn and then pairs of a user's and an assistant's turn. Turns
are kept, given another role or deleted, and empty turns may be inserted. Turns lie in order in a staged table, where
blocks of ``BLOCK`` positions cut conversations into runs; runs are hashed over the tasks, and there a recursive DuckDB
query advances one turn of all runs of a batch at once, keeping for every state of the grammar the minimum cost and the
least audit. A run that begins with its block may be the rest of a conversation: it is walked from each state in which
it may begin, so that the runs of a long conversation need not wait for each other, and they are chained afterwards by
their costs, a few numbers a run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.spelling import CRC_OF, CRC_SQL

WHITE = " \t\n\x0b\x0c\r"
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn with an initial leads from each state: system only first, then user and assistant in turns.
STEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
COMPLETE = (EMPTY, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  # costs; the last of keeping a truncated turn's text
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Letters of the edits. Inside, J is an insertion and S a change of role that give an assistant's turn, where I and R
#: give a user's. From one state only one of the two can follow, so the order of audits is the same.
OUTSIDE = ("JS", "IR")
#: The letters of one turn: insertions before it, its own, and insertions that close the conversation.
LETTERS = re.compile("[IJ]*[DKRS](?:[IJ]+$)?")
ARROW_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

#: Positions in one block; turns in one DuckDB batch.
BLOCK, BATCH_TURNS = 256, 16_384
#: Bytes of one conversation that a task holds before it passes them on.
PIECE_BYTES = 1 << 20
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def insertions(state: int) -> Iterator[tuple[int, int, str]]:
    """(cost, state, letters) of none, one or two inserted turns: more would come back to a state at a cost."""
    yield 0, state, ""
    letters, cost, at = "", 0, state
    for _ in range(2):
        role = "a" if at == USER else "u"
        at, cost, letters = STEP[at, role], cost + INSERT, letters + ("J" if role == "a" else "I")
        if at != state:
            yield cost, at, letters


def moves() -> list[tuple[int, str, int, int, int, str]]:
    """(state, initial, fault, next state, cost, letters): the cheapest ways over one turn, insertions before it
    included."""
    out = []
    for state in range(4):
        for initial in "sua-":
            for fault in (FINE, TRUNCATED, BLANK, DUPLICATE):
                best: dict[int, tuple[int, str]] = {}
                for cost, at, letters in insertions(state):
                    ways = [(at, DELETE, "D")]
                    if fault in (FINE, TRUNCATED):
                        extra = CUT_OFF if fault == TRUNCATED else 0
                        ways += [(STEP[at, initial], KEEP + extra, "K")] if (at, initial) in STEP else []
                        ways += [(STEP[at, "u"], REROLE + extra, "R")] if (at, "u") in STEP else []
                        ways += [(STEP[at, "a"], REROLE + extra, "S")] if (at, "a") in STEP else []
                    for to, more, letter in ways:
                        best[to] = min(best.get(to, (1 << 62, "")), (cost + more, letters + letter))
                out += [(state, initial, fault, to, *found) for to, found in best.items()]
    return out


#: The end of a conversation from each state: cost and letters.
CLOSING = [min((c, x) for c, at, x in insertions(s) if at in COMPLETE) for s in range(4)]


def ordered_turns(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A staged table of the turns in order: ``pos`` (ascending by conversation and turn, no two alike), ``conv``,
    ``turn``, ``role``, ``text``, ``initial`` (of the role, - if none of s, u and a) and ``fault`` without duplicates.

    Null turns come first; equal turns go by role, the first 64 characters of the text and its MD5. Null roles and texts
    are one space, null ids one conversation. The place of a row in the input is part of the range key, so that one
    conversation, one turn or one group of copies spreads over partitions.
    """
    spark = common.tuned(rows.sparkSession)
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    first = F.substring("role", 1, 1)
    own = own.withColumns({"initial": F.when(first.isin("s", "u", "a"), first).otherwise("-"), "fault": fault.cast("int"), "head": F.substring("text", 1, 64), "digest": F.unhex(F.md5("text")), "place": F.monotonically_increasing_id()})
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest"), F.col("place")]
    laid = own.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order).drop("head", "place")
    return common.staged(laid.withColumn("pos", F.monotonically_increasing_id()), "turns")[0]


def judged(turns: DataFrame) -> DataFrame:
    """(pos, conv, initial, fault) of ``ordered_turns``, duplicates included: not blank, and role and text seen earlier
    in the conversation. The first of each is found by an aggregate, so no text is a large group."""
    first = turns.where(F.col("fault") != BLANK).groupBy("conv", "role", "digest").agg(F.min("pos").alias("first_pos")).select("first_pos").hint("merge")
    seen = (F.col("fault") != BLANK) & F.col("first_pos").isNull()
    joined = turns.select("pos", "conv", "initial", "fault").join(first, F.col("pos") == F.col("first_pos"), "left")
    return joined.select("pos", "conv", "initial", F.when(seen, DUPLICATE).otherwise(F.col("fault")).cast("int").alias("fault"))


RUN_SQL = f"""
WITH RECURSIVE placed AS (
  SELECT *, lag(initial) OVER run AS last_initial, row_number() OVER run AS i FROM turns WINDOW run AS (PARTITION BY pos // {BLOCK}, conv ORDER BY pos)
), runs AS (
  SELECT min(pos) AS run, count(*) AS n, pos // {BLOCK} AS block, conv, count(*) FILTER (WHERE fault = {BLANK}) AS blank, count(*) FILTER (WHERE fault = {DUPLICATE}) AS duplicate,
    count(*) FILTER (WHERE fault = {TRUNCATED}) AS truncated, count(*) FILTER (WHERE last_initial || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    arg_min(initial, pos) AS first, arg_max(initial, pos) AS last FROM placed GROUP BY ALL
), steps AS (
  SELECT pos - i + 1 AS run, i, initial, fault FROM placed
), walk(run, entry, state, i, cost, audit) AS (
  SELECT run, entry, entry, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' FROM runs, range(4) e(entry) WHERE entry = {EMPTY} OR run % {BLOCK} = 0
  UNION ALL
  SELECT run, entry, next, i, best.cost, best.audit FROM (
    SELECT w.run, w.entry, m.next, s.i, min({{'cost': w.cost + m.cost, 'audit': w.audit || m.letters}}) AS best
    FROM walk w JOIN steps s ON s.run = w.run AND s.i = w.i + 1 JOIN moves m ON m.state = w.state AND m.initial = s.initial AND m.fault = s.fault
    GROUP BY w.run, w.entry, m.next, s.i)
), ends AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.run, entry ORDER BY audit) AS rank FROM walk w JOIN runs r ON r.run = w.run AND r.n = w.i
)
SELECT r.run, r.n, r.conv, blank, duplicate, truncated, illegal, first, last, e.ways
FROM runs r JOIN (SELECT run, list({{'entry': CAST(entry AS INTEGER), 'next': CAST(state AS INTEGER), 'cost': cost, 'rank': CAST(rank AS INTEGER), 'audit': audit}}) AS ways FROM ends GROUP BY run) e ON e.run = r.run
"""

WAY = pa.struct([("entry", pa.int32()), ("next", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())])
COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _solver(conv_type: pa.DataType):
    shape = pa.schema([("run", pa.int64()), ("n", pa.int64()), ("conv", conv_type), *[(c, pa.int64()) for c in COUNTS], ("first", pa.string()), ("last", pa.string()), ("ways", pa.list_(WAY))])
    known = pa.table([pa.array(c) for c in zip(*moves())], names=["state", "initial", "fault", "next", "cost", "letters"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        con.register("moves", known)
        held: list[pa.RecordBatch] = []

        def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            con.register("turns", rows)
            found = con.sql(RUN_SQL).to_arrow_table()
            con.unregister("turns")
            yield from found.cast(shape).to_batches(max_chunksize=2048)

        # batches are cut between blocks
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BATCH_TURNS:
                rows = pa.Table.from_batches(held)
                block = rows.column("pos").to_numpy() // BLOCK
                cut = int(np.searchsorted(block, block[-1]))
                if cut:
                    yield from solved(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held and sum(map(len, held)):
            yield from solved(pa.Table.from_batches(held))
        con.close()

    return common.lean(solve)


def solved_runs(turns: DataFrame) -> DataFrame:
    """One row a run of ``judged`` turns: ``run`` (its first pos), ``n``, ``conv``, counts of faults and of illegal pairs
    of roles inside it, its first and last initial, and ``ways``: from each state to each, cost, audit and the audit's
    rank among those of the same entry."""
    spark = turns.sparkSession
    block = F.shiftright("pos", BLOCK.bit_length() - 1)
    batches = turns.select("pos", "conv", "initial", "fault").repartition(common.partitions(spark), block).sortWithinPartitions("pos")
    kind = turns.schema["conv"].dataType.simpleString()
    sql = f"run long, n long, conv {kind}, {', '.join(c + ' long' for c in COUNTS)}, first string, last string, ways array<struct<entry int, next int, cost long, rank int, audit string>>"
    return batches.mapInArrow(_solver(ARROW_TYPES[kind]), sql)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs in order, the way through each that begins the cheapest whole, the least audit on a tie; the closing
    letters and, with a conversation's last run, its cost. A conversation is held as 32 numbers a run."""

    def paths(runs: list) -> tuple[list, list, list, list, list]:
        to_go = [c for c, _ in CLOSING]
        behind = []
        for _, ways, _, _ in reversed(runs):
            behind.append(to_go)
            to_go = [min((cost + to_go[t] for e, t, cost, _ in ways if e == s), default=1 << 60) for s in range(4)]
        state, entries, nexts = EMPTY, [], []
        for (_, ways, _, _), after in zip(runs, reversed(behind)):
            _, _, to = min((cost + after[t], rank, t) for e, t, cost, rank in ways if e == state)
            entries.append(state)
            nexts.append(to)
            state = to
        last = len(runs) - 1
        edges = [0, *(a[3] + b[2] not in ("su", "ua", "au") for a, b in zip(runs, runs[1:]))]
        return [r[0] for r in runs], entries, nexts, [CLOSING[state][1] if k == last else "" for k in range(len(runs))], [to_go[EMPTY] if k == last else 0 for k in range(len(runs))], [int(x) for x in edges]

    def made(groups: list) -> pa.RecordBatch:
        columns = [sum(c, []) for c in zip(*map(paths, groups))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["at_run", "entry", "next", "closing", "cost", "edge"])

    groups: list = []
    conv = object()
    for batch in batches:
        ways = batch.column("ways")
        flat = [ways.flatten().field(k).to_pylist() for k in range(4)]
        ends = np.cumsum(ways.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        starts = [0, *ends]
        for k, (c, run, first, last) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("conv", "run", "first", "last")))):
            if c != conv:
                if len(groups) >= 1024:
                    yield made(groups)
                    groups = []
                conv = c
                groups.append([])
            groups[-1].append((run, list(zip(*(x[starts[k] : ends[k]] for x in flat))), first, last))
    if groups:
        yield made(groups)


def solution(runs: DataFrame) -> DataFrame:
    """(run, n, conv, cost, edge, piece): the letters of every run in the cheapest whole; ``cost`` of the conversation
    with its last run, ``edge`` 1 where the pair of roles at a run's beginning is illegal."""
    spark = runs.sparkSession
    light = runs.select("conv", "run", "first", "last", F.transform("ways", lambda w: F.struct(w["entry"].alias("entry"), w["next"].alias("next"), w["cost"].alias("cost"), w["rank"].alias("rank"))).alias("ways"))
    # equal conversations are neighbours there, null ids too
    light = light.repartition(common.partitions(spark), "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "run")
    paths = light.mapInArrow(common.lean(_chained), "at_run long, entry int, next int, closing string, cost long, edge long").hint("merge")
    way = F.filter("ways", lambda w: (w["entry"] == F.col("entry")) & (w["next"] == F.col("next")))[0]["audit"]
    return runs.join(paths, F.col("run") == F.col("at_run")).select("run", "n", "conv", "cost", "edge", F.concat(way, "closing").alias("piece"))


def _edited(letters: str, role: str, text: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what stands for one turn: insertions before it, itself unless deleted, the closing."""
    for x in letters:
        if x in "IJ":
            yield "I", "user" if x == "I" else "assistant", ""
        elif x != "D":
            yield x.translate(str.maketrans(*OUTSIDE)), {"K": role, "R": "user", "S": "assistant"}[x], text


def _turns_with_letters(batches: Iterator[pa.RecordBatch], files: dict[int, list[str]]) -> Iterator[tuple[int, list]]:
    """(part, [(pos, conv, letters, role, text), ...]): runs of one staged part, in order, beside the part's rows."""

    def read(names: list[str]) -> Iterator[tuple]:
        for name in names:
            fs, path = pyarrow.fs.FileSystem.from_uri(name)
            with fs.open_input_file(path) as stream:
                for rows in pq.ParquetFile(stream).iter_batches(batch_size=common.ARROW_ROWS, columns=["pos", "conv", "role", "text"]):
                    yield from zip(*(rows.column(c).to_pylist() for c in range(4)))

    part, rows = None, iter(())
    for batch in batches:
        out: list = []
        for p, run, piece in zip(*(batch.column(c).to_pylist() for c in ("part", "run", "piece"))):
            if p != part and out:
                yield part, out
                out = []
            if p != part:
                part, rows = p, read(files[p])
            letters = LETTERS.findall(piece)
            out += [(pos, conv, x, role, text) for x, (pos, conv, role, text) in zip(letters, rows)]
            if out[-len(letters)][0] != run:
                raise ValueError("runs and turns do not match")
            if len(out) >= common.ARROW_ROWS:
                yield part, out
                out = []
        if out:
            yield part, out


def _by_part(solved: DataFrame, turns: DataFrame) -> tuple[DataFrame, dict[int, list[str]]]:
    """The runs, hashed by the part of the staged turns that they lie in and sorted, and the files of each part: as many
    names as there are shuffle partitions."""
    spark = turns.sparkSession
    part = F.shiftright("pos", 33)
    names = turns.groupBy(part.alias("part"), F.col("_metadata.file_path").alias("file")).agg(F.min("pos").alias("at")).orderBy("at").collect()
    files: dict[int, list[str]] = {}
    for r in names:
        files.setdefault(r["part"], []).append(r["file"])
    runs = solved.select(F.shiftright("run", 33).alias("part"), "run", "piece")
    return runs.repartition(common.partitions(spark), "part").sortWithinPartitions("part", "run"), files


def repaired_turns(solved: DataFrame, turns: DataFrame) -> DataFrame:
    """(pos, at, conv, edit, role, text): the turns of the repaired conversations, in order of pos and at; pos is that
    of the turn itself, or of that beside which a turn was inserted."""
    runs, files = _by_part(solved, turns)

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _turns_with_letters(batches, files):
            out = [(pos, k, conv, *item) for pos, conv, letters, role, text in rows for k, item in enumerate(_edited(letters, role, text))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["pos", "at", "conv", "edit", "role", "text"])

    return runs.mapInArrow(common.lean(edited), f"pos long, at long, conv {turns.schema['conv'].dataType.simpleString()}, edit string, role string, text string")


def _hasher(files: dict[int, list[str]], conv_type: pa.DataType):
    names = ["conv", "run", "bytes", "sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation inside a part is hashed here; one that touches an edge of the part, or is long, goes on as
        pieces of its bytes."""
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (conv_type, pa.int64(), pa.binary(), pa.string()))], names=names)

        here, conv, items, size, whole, first = None, None, [], 0, False, 0
        for part, rows in _turns_with_letters(batches, files):
            for pos, c, letters, role, text in rows:
                if part != here or c != conv:
                    if here is not None:
                        inside = whole and part == here
                        body = b"\n".join(items)
                        out.append((conv, first, None if inside else body or None, hashlib.sha256(body).hexdigest() if inside else None))
                    whole, here, conv, items, size, first = part == here, part, c, [], 0, pos
                for _, r, t in _edited(letters, role, text):
                    items.append(f"{r}:{t}".encode())
                    size += len(items[-1])
                if size >= PIECE_BYTES:
                    out.append((conv, first, b"\n".join(items), None))
                    items, size, whole, first = [], 0, False, pos + 1
                    yield made()
            if len(out) >= common.ARROW_ROWS:
                yield made()
        if here is not None:
            out.append((conv, first, b"\n".join(items) or None, None))
        if out:
            yield made()

    return common.lean(run)


def _joined(conv_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hash of a conversation's pieces, one after the other."""
        done: list[tuple] = []
        conv, hasher, empty = object(), None, True
        for batch in batches:
            for c, body in zip(batch.column("conv").to_pylist(), batch.column("bytes")):
                if c != conv:
                    if hasher is not None:
                        done.append((conv, hasher.hexdigest()))
                    conv, hasher, empty = c, hashlib.sha256(), True
                if body.is_valid:
                    hasher.update(body.as_buffer() if empty else b"\n")
                    if not empty:
                        hasher.update(body.as_buffer())
                    empty = False
        if hasher is not None:
            done.append((conv, hasher.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (conv_type, pa.string()))], names=["conv", "repaired_sha256"])

    return common.lean(run)


def digests(solved: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of ``role:text`` of the repaired turns, joined by line breaks. Parts of the staged turns
    are read where they lie, without another shuffle. A hash has to see its bytes in order: those of a conversation
    that lies in several parts are streamed through one task, of which no more than a piece is held."""
    spark = turns.sparkSession
    runs, files = _by_part(solved, turns)
    kind = turns.schema["conv"].dataType.simpleString()
    arrow = ARROW_TYPES[kind]
    hashed, _ = common.staged(runs.mapInArrow(_hasher(files, arrow), f"conv {kind}, run long, bytes binary, sha256 string"), "turn-hashes")
    pieces = hashed.where("sha256 is null").select("conv", "run", "bytes").repartition(common.partitions(spark), "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "run")
    whole = hashed.where("sha256 is not null").select("conv", F.col("sha256").alias("repaired_sha256"))
    return whole.unionByName(pieces.mapInArrow(_joined(arrow), f"conv {kind}, repaired_sha256 string"))


def repair(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", conversations: DataFrame | None = None) -> DataFrame:
    """One row a conversation: ``conv_id``, ``gaps`` (turn numbers missing between the first and the last), counts
    ``blank``, ``duplicate``, ``truncated`` (the first fault of a turn) and ``illegal`` (neighbouring roles out of turn),
    ``cost`` and ``audit`` of the cheapest edits (the least string on a tie), ``repaired_sha256``.

    ``conversations``: a table whose ids all come back, also those without rows: zeros, an empty audit and the hash of
    nothing. Null roles and texts are one space; null ids are one conversation, null turns come first and count for no
    gap; repeated rows are turns of their own, duplicates unless blank. An empty role has no legal initial. Ids are
    whole numbers or strings. Other columns are ignored. No rows give none.
    """
    turns = ordered_turns(rows, conv=conv, turn=turn, role=role, text=text)
    runs, _ = common.staged(solved_runs(judged(turns)), "turn-runs")
    solved, _ = common.staged(solution(runs), "turn-repairs")
    letters = solved.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("edge").alias("illegal"), F.translate(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "piece"))), lambda x: x["piece"]), ""), *OUTSIDE).alias("audit"))
    distinct = turns.select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    everything = [distinct, runs.select("conv", *COUNTS), letters, digests(solved, turns)]
    if conversations is not None:
        everything.append(conversations.select(F.col(conv).alias("conv")).distinct())
    both = everything[0]
    for df in everything[1:]:
        both = both.unionByName(df, allowMissingColumns=True)
    number = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = both.groupBy("conv").agg(*[number(c) for c in ("gaps", *COUNTS, "cost")], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
    return out.withColumnRenamed("conv", conv)


def damaged(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with one fault in five of twenty, by the CRC-32 of ``conv:turn``: dropped, emptied, without full stops,
    repeated, or a user's. Nulls are one space there, and in role and text."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text(conv), F.lit(":"), as_text(turn)).cast("binary")) % 20
    new_text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(as_text(text), "[.!?]", "")).otherwise(as_text(text))
    own = rows.where(kind != 0).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(as_text(role)).alias("role"), new_text.alias("text"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return own.drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations")
    return repair(damaged(rows), conversations=rows).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _walk_sql() -> str:
    """The same fold in one recursion over whole conversations, for the test of the query."""
    values = ", ".join(f"({s}, '{i}', {f}, {t}, {c}, '{x}')" for s, i, f, t, c, x in moves())
    closing = ", ".join(f"({s}, {c}, '{x}')" for s, (c, x) in enumerate(CLOSING))
    return f"moves(state, initial, fault, next, cost, letters) AS (VALUES {values}), closing(state, cost, letters) AS (VALUES {closing})"


OP12_SQL = rf"""
WITH RECURSIVE {CRC_SQL}, {_walk_sql()},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS b FROM conversations
), chosen AS (
  SELECT conv_id, turn, role, text, {CRC_OF.format(bytes="b")} % 20 AS kind FROM keyed, crc_table
), harmed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM chosen WHERE kind <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), unhex(md5(text))) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE '-' END AS initial FROM harmed
), turns AS (
  SELECT *, CASE WHEN bare = '' THEN {BLANK} WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN {DUPLICATE} WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE {FINE} END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = {BLANK}) AS blank, count(*) FILTER (WHERE fault = {DUPLICATE}) AS duplicate,
    count(*) FILTER (WHERE fault = {TRUNCATED}) AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM turns GROUP BY conv_id
), walk(conv_id, state, i, cost, audit) AS (
  SELECT conv_id, 0, CAST(0 AS BIGINT), 0, '' FROM counted
  UNION ALL
  SELECT conv_id, next, i, best.cost, best.audit FROM (
    SELECT w.conv_id, m.next, t.i, min({{'cost': w.cost + m.cost, 'audit': w.audit || m.letters}}) AS best
    FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 JOIN moves m ON m.state = w.state AND m.initial = t.initial AND m.fault = t.fault GROUP BY w.conv_id, m.next, t.i)
), best AS (
  SELECT w.conv_id, min({{'cost': w.cost + c.cost, 'audit': w.audit || c.letters}}) AS best
  FROM walk w JOIN counted n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i JOIN closing c ON c.state = w.state GROUP BY w.conv_id
), letters AS (
  SELECT conv_id, k, substr(best.audit, k, 1) AS x, 1 + length(regexp_replace(substr(best.audit, 1, k - 1), '[IJ]', '', 'g')) AS i FROM best, unnest(range(1, length(best.audit) + 1)) AS r(k)
), repaired AS (
  SELECT l.conv_id, sha256(string_agg(CASE x WHEN 'I' THEN 'user:' WHEN 'J' THEN 'assistant:' WHEN 'R' THEN 'user:' || text WHEN 'S' THEN 'assistant:' || text ELSE role || ':' || text END, chr(10) ORDER BY k)) AS repaired_sha256
  FROM letters l LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i WHERE x <> 'D' GROUP BY l.conv_id
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, translate(coalesce(best.audit, ''), '{OUTSIDE[0]}', '{OUTSIDE[1]}') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""
