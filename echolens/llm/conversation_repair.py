"""Conversation structure repair: cheapest edits to a legal order of roles, by a run-length dynamic programme.

Every row has a symbol: its role (s, u, a by the role's first character, or other) and its fault. The first that holds is
its fault: ``blank`` (no character but white space), ``duplicate`` (role and text seen earlier in the conversation),
``truncated`` (the last character that is not white space is none of ``. ! ?``). Edits and their costs:

| letter | edit | cost |
| --- | --- | --- |
| K | keep the row | 0, of a truncated row 3 |
| R | make the row's role user or assistant | 3, of a truncated row 6 |
| D | delete the row; the only edit of blank and duplicate rows | 4 |
| I | insert a user or assistant row with empty text, anywhere | 3 |

The result's role initials have the form ``(s?(ua)+)?``: four states (nothing yet, after s, after u, after a). A symbol is
a min-plus matrix of 4 x 4 costs, insertions before the row included. Equal consecutive symbols are collapsed to a run;
the cost of a run is its matrix to the power of its length, put together from cached binary powers. The edits are
then unrolled run by run: at each row the least letter (D, I, K, R) that keeps the cost is taken, which gives the
ASCII-least of the cheapest audits. The state fixes the role of R and I, so an audit has one repaired conversation.

At scale: one shuffle of the rows by conversation and range of turns. They are packed in segments of ``SEGMENT`` rows at most, so a
conversation that holds a third of all rows is many segments. A conversation of one segment is repaired in
place. For longer ones, segments become matrices, whose suffix products (one small list per conversation) give the cost
to go after each segment; the state in which a segment is entered is chained in the same way; then every segment
unrolls its edits by itself. Duplicates across segments are found by a join of text digests. Only the two outputs
that are one value per conversation, audit and digest, are put together by one task, which streams the segments.

Cases: null role or text counts as one space, in the key of the damage null conv_id or turn too; rows are ordered by turn (nulls
first), ties by (role, text) in byte order; a role with another initial, or an empty one, can only be re-roled or deleted; rows of
a null conversation id are one conversation; repeated rows are duplicates; a conversation without rows has zero
counts, an empty audit and the digest of an empty string; texts of any length are read whole; an empty table gives no
row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .frames import per_batch, table, written

SEGMENT = 256  # rows of one conversation handled at a time
TURN_SPAN = 4096  # turn numbers of one conversation that are put in order together
KEEP_TRUNCATED = REROLE = INSERT = 3
DELETE = 4
NEVER = 1 << 40  # cost of what is not allowed; sums of two stay far below 2**63

NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
START = NOTHING
NEEDED = {NOTHING: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}  # role that an inserted or re-roled row takes
AFTER = {"u": AFTER_U, "a": AFTER_A}
NAMES = {"u": "user", "a": "assistant"}
# A symbol: 0 must be deleted; else 1 + 2 * (0 other, 1 s, 2 u, 3 a) + truncated.
MUST_DELETE, SYMBOLS = 0, 9
INITIALS = {"s": 1, "u": 2, "a": 3}

SPACES = " \t\n\x0b\x0c\r"


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def _insertions() -> np.ndarray:
    one = np.full((4, 4), NEVER)
    np.fill_diagonal(one, 0)
    for state, role in NEEDED.items():
        one[state, AFTER[role]] = min(one[state, AFTER[role]], INSERT)
    return min_plus(min_plus(one, one), one)


INSERTIONS = _insertions()
ENDS = np.array([0, NEVER, NEVER, 0])  # legal states at the end
ENDING = (INSERTIONS + ENDS).min(axis=1)


def moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row, least letter first."""
    out = [("D", DELETE, state)]
    if symbol == MUST_DELETE:
        return out
    role, truncated = divmod(symbol - 1, 2)
    extra = KEEP_TRUNCATED * truncated
    if role == INITIALS["s"] and state == NOTHING:
        out.append(("K", extra, AFTER_S))
    if role == INITIALS.get(NEEDED[state]):
        out.append(("K", extra, AFTER[NEEDED[state]]))
    return [*out, ("R", REROLE + extra, AFTER[NEEDED[state]])]


MOVES = [[moves(symbol, state) for state in range(4)] for symbol in range(SYMBOLS)]


def _step(symbol: int) -> np.ndarray:
    used = np.full((4, 4), NEVER)
    for state in range(4):
        for _, cost, after in MOVES[symbol][state]:
            used[state, after] = min(used[state, after], cost)
    return min_plus(INSERTIONS, used)


@lru_cache(maxsize=SYMBOLS * 64)
def power(symbol: int, k: int) -> np.ndarray:
    """The symbol's matrix to the power 2**k."""
    if k == 0:
        return _step(symbol)
    half = power(symbol, k - 1)
    return min_plus(half, half)


def runs(symbols: bytes) -> list[tuple[int, int]]:
    return [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]


def before_run(symbol: int, length: int, togo: np.ndarray) -> np.ndarray:
    """Cost to go before a run, from the cost to go behind it."""
    k = 0
    while length:
        if length & 1:
            togo = np.minimum((power(symbol, k) + togo).min(axis=1), NEVER)
        length, k = length >> 1, k + 1
    return togo


def segment_matrix(symbols: bytes) -> np.ndarray:
    """Costs from the state before the rows to the state behind them."""
    out = np.full((4, 4), NEVER)
    np.fill_diagonal(out, 0)
    for symbol, length in runs(symbols):
        k = 0
        while length:
            if length & 1:
                out = min_plus(out, power(symbol, k))
            length, k = length >> 1, k + 1
    return out


def unroll(symbols: bytes, state: int, behind: np.ndarray) -> tuple[str, int]:
    """Least cheapest edits of the rows from ``state`` on, given the cost to go behind them; and the state behind."""
    parts = runs(symbols)
    edges = [behind]
    for symbol, length in reversed(parts):
        edges.append(before_run(symbol, length, edges[-1]))
    edges.pop()
    audit = []
    for symbol, length in parts:
        after = edges.pop()
        inside = [after]
        for _ in range(length):  # cost to go at every row of this run
            inside.append(np.minimum((power(symbol, 0) + inside[-1]).min(axis=1), NEVER))
        inside = [x.tolist() for x in inside]
        for left in range(length, 0, -1):
            done = False
            while not done:
                togo, rest = inside[left][state], inside[left - 1]
                options = MOVES[symbol][state]
                insert = AFTER[NEEDED[state]]
                if options[0][1] + rest[state] == togo:  # D comes before I, I before K and R
                    audit.append("D")
                    done = True
                elif INSERT + inside[left][insert] == togo:
                    audit.append("I")
                    state = insert
                else:
                    letter, _, state = next(m for m in options[1:] if m[1] + rest[m[2]] == togo)
                    audit.append(letter)
                    done = True
    return "".join(audit), state


def closing(state: int) -> str:
    """Insertions that reach a legal end."""
    return "" if ENDS[state] == 0 else "I" if state == AFTER_U else "II"


@lru_cache(maxsize=1 << 14)
def _short_plan(symbols: bytes) -> tuple[int, str]:
    cost = ENDING
    for symbol, length in reversed(runs(symbols)):
        cost = before_run(symbol, length, cost)
    audit, state = unroll(symbols, START, ENDING)
    return int(cost[START]), audit + closing(state)


def plan(symbols: bytes) -> tuple[int, str]:
    """Least cost of a whole conversation and its audit. Short symbol sequences repeat, so their plans are kept."""
    return _short_plan(symbols) if len(symbols) <= 32 else _short_plan.__wrapped__(symbols)


def faults(rows: list[tuple], earlier=frozenset()) -> tuple[bytes, list[int]]:
    """Symbols of a segment's rows (turn, role, text), and how many are blank, duplicate and truncated.

    ``earlier`` holds the positions of rows whose role and text stand in an earlier segment.
    """
    seen: set[tuple[str, str]] = set()
    out, counts = bytearray(), [0, 0, 0]
    for i, (_, role, text) in enumerate(rows):
        bare = text.rstrip(SPACES)
        if not bare:
            counts[0] += 1
            out.append(MUST_DELETE)
        elif (role, text) in seen or i in earlier:
            counts[1] += 1
            out.append(MUST_DELETE)
        else:
            truncated = bare[-1] not in ".!?"
            counts[2] += truncated
            out.append(1 + 2 * INITIALS.get(role[:1], 0) + truncated)
        seen.add((role, text))
    return bytes(out), counts


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def repaired(rows: list[tuple], audit: str, state: int = START) -> list[str]:
    """Rows ``role:text`` of the repaired conversation, or of the part of it that begins in ``state``."""
    out, i = [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[i][1:3]
        i += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            out.append(f"{role}:{text}")
            state = AFTER_S if role[0] == "s" else AFTER[role[0]]
        else:
            out.append(f"{NAMES[NEEDED[state]]}:{text}")
            state = AFTER[NEEDED[state]]
    return out


def gap(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


# ---- the job

SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def damaged(chats: DataFrame) -> DataFrame:
    """The rows with planted faults, decided by a checksum of conversation and turn."""
    space = F.lit(" ")
    text = F.coalesce(F.col("text").cast("string"), space)
    role = F.coalesce(F.col("role").cast("string"), space)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = chats.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fate"))
    rows = rows.filter("fate <> 0").withColumn("again", F.explode(F.expr("sequence(1, IF(fate = 3, 2, 1))")))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"))


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv_id, span, piece, rows): the ordered rows of each conversation in pieces; (span, piece) is their order."""
    span = F.coalesce(F.floor(F.col("turn") / TURN_SPAN), F.lit(-(1 << 62))).cast("bigint")
    order = Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumn("span", span).withColumn("at", F.row_number().over(order) - 1)
    piece = F.floor(F.col("at") / size).cast("bigint").alias("piece")
    of_piece = placed.select("conv_id", "span", piece, F.struct("at", "turn", "role", "text").alias("row"))
    return of_piece.groupBy("conv_id", "span", "piece").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def _rows(batch: pa.RecordBatch, name: str = "rows") -> Iterator[list[tuple]]:
    for found in batch.column(batch.schema.get_field_index(name)):
        yield [(r["turn"], r["role"], r["text"]) for r in found.as_py()]


def _repair_whole(batch: pa.RecordBatch) -> dict:
    out = {f.split(" ")[0]: [] for f in SUMMARY.split(", ")}
    for rows in _rows(batch):
        symbols, (blank, duplicate, truncated) = faults(rows)
        cost, audit = plan(symbols)
        text = "\n".join(repaired(rows, audit))
        values = (gap([r[0] for r in rows]), blank, duplicate, truncated, illegal([r[1][:1] for r in rows]), cost, audit, hashlib.sha256(text.encode()).hexdigest())
        for kept, value in zip(out.values(), values):
            kept.append(value)
    return out


def _long(pieces: DataFrame) -> DataFrame:
    """Repair of conversations of several segments."""
    place = ["conv_id", "span", "piece"]
    # Rows whose role and text stand in an earlier segment.
    texts = pieces.select(*place, F.explode("rows").alias("row")).select(
        *place, (F.col("row.at") % SEGMENT).cast("int").alias("i"), F.sha2(F.concat_ws(":", F.char_length("row.role").cast("string"), "row.role", "row.text"), 256).alias("digest"))
    first = texts.groupBy("conv_id", "digest").agg(F.min(F.struct("span", "piece")).alias("lo"), F.max(F.struct("span", "piece")).alias("hi")).filter("lo < hi")
    again = texts.alias("t").join(first.alias("f"), F.col("t.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("t.digest") == F.col("f.digest")))
    again = again.filter(F.struct("t.span", "t.piece") > F.col("f.lo")).groupBy(*[F.col(f"t.{c}") for c in place]).agg(F.collect_list("t.i").alias("earlier"))

    def same(a: str, b: str, names=place) -> Column:
        return F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in names))

    marked = pieces.alias("p").join(again.alias("q"), same("p", "q"), "left").select("p.*", "q.earlier")

    def describe(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("symbols", "matrix", "faults", "first", "last", "illegal", "low", "high", "turns")}
        for rows, earlier in zip(_rows(batch), batch.column(batch.schema.get_field_index("earlier")).to_pylist()):
            symbols, counts = faults(rows, frozenset(earlier or ()))
            known = [r[0] for r in rows if r[0] is not None]
            values = (symbols, segment_matrix(symbols).ravel(), counts, rows[0][1][:1], rows[-1][1][:1], illegal([r[1][:1] for r in rows]), min(known, default=None), max(known, default=None), len(set(known)))
            for kept, value in zip(out.values(), values):
                kept.append(value)
        return out

    described = written(per_batch(marked, describe, "symbols binary, matrix array<bigint>, faults array<bigint>, first string, last string, illegal bigint, low bigint, high bigint, turns bigint", *place, "rows"), "segments")

    # Cost to go behind each segment: suffix products, a list of small matrices per conversation.
    lists = described.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("span", "piece", "matrix", "first", "last"))).alias("list"))

    def suffixes(batch: pa.RecordBatch) -> dict:
        out = {"behind": [], "cost": [], "borders": []}
        for parts in batch.column(1).to_pylist():
            togo, behind = ENDING, []
            for part in reversed(parts):
                behind.append({"span": part["span"], "piece": part["piece"], "togo": togo.tolist()})
                togo = np.minimum((np.array(part["matrix"]).reshape(4, 4) + togo).min(axis=1), NEVER)
            out["behind"].append(behind[::-1])
            out["cost"].append(int(togo[START]))
            out["borders"].append(sum(illegal([a["last"], b["first"]]) for a, b in zip(parts, parts[1:])))
        return out

    planned = written(per_batch(lists, suffixes, "behind array<struct<span: bigint, piece: bigint, togo: array<bigint>>>, cost bigint, borders bigint", "conv_id"), "suffixes")
    behind = planned.select("conv_id", F.explode("behind").alias("b")).select("conv_id", "b.span", "b.piece", "b.togo")
    ready = described.alias("p").join(behind.alias("q"), same("p", "q")).select("p.*", "q.togo")

    def exits(batch: pa.RecordBatch) -> dict:
        names = batch.schema.names
        both = zip(batch.column(names.index("symbols")).to_pylist(), batch.column(names.index("togo")).to_pylist())
        return {"exit": [[unroll(s, state, np.array(togo))[1] if before_all(s, togo)[state] < NEVER else state for state in range(4)] for s, togo in both]}

    left = written(per_batch(ready.select(*place, "symbols", "togo"), exits, "exit array<int>", *place), "exits")
    chains = left.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("span", "piece", "exit"))).alias("list"))

    def chain(batch: pa.RecordBatch) -> dict:
        out = []
        for parts in batch.column(1).to_pylist():
            state, entries = START, []
            for part in parts:
                entries.append({"span": part["span"], "piece": part["piece"], "state": state})
                state = part["exit"][state]
            entries[-1]["state"] += 4  # marks the last segment, which also closes the conversation
            out.append(entries)
        return {"entries": out}

    entered = per_batch(chains, chain, "entries array<struct<span: bigint, piece: bigint, state: int>>", "conv_id").select("conv_id", F.explode("entries").alias("e")).select("conv_id", "e.*")
    ready = ready.alias("p").join(entered.alias("q"), same("p", "q")).select("p.*", "q.state")

    def edit(batch: pa.RecordBatch) -> dict:
        out, names = {"audit": [], "text": []}, batch.schema.names
        columns = [batch.column(names.index(c)).to_pylist() for c in ("symbols", "togo", "state")]
        for rows, symbols, togo, state in zip(_rows(batch), *columns):
            last, state = divmod(state, 4)
            audit, end = unroll(symbols, state, np.array(togo))
            audit += closing(end) if last else ""
            out["audit"].append(audit)
            out["text"].append("".join(f"{line}\n" for line in repaired(rows, audit, state)))
        return out

    edited = per_batch(ready, edit, "audit string, text string", *place)
    width = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(conv, audit, held, digest):
            digest.update(held[:-1])  # no line feed behind the last row
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

        now = None
        for batch in batches:
            for conv, audit, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if now is None or now[0] != conv:
                    if now is not None:
                        yield row(*now)
                    now = (conv, [], b"", hashlib.sha256())
                now[1].append(audit)
                if text:
                    now[3].update(now[2])
                    now = (now[0], now[1], text.encode(), now[3])
        if now is not None:
            yield row(*now)

    ordered = edited.repartition(width, "conv_id").sortWithinPartitions("conv_id", "span", "piece").select("conv_id", "audit", "text")
    outputs = ordered.mapInArrow(put_together, "conv_id bigint, audit string, repaired_sha256 string")
    spans = described.groupBy("conv_id").agg(
        *[F.sum(F.element_at("faults", i + 1)).alias(c) for i, c in enumerate(("blank", "duplicate", "truncated"))], F.sum("illegal").alias("illegal"),
        F.min("low").alias("low"), F.max("high").alias("high"))
    # A turn may stand in several segments; it counts once.
    distinct = pieces.select("conv_id", F.explode("rows.turn").alias("turn")).groupBy("conv_id").agg(F.count_distinct("turn").alias("turns"))
    joined = spans.alias("s").join(planned.alias("p"), same("s", "p", ["conv_id"])).join(distinct.alias("d"), same("s", "d", ["conv_id"])).join(outputs.alias("o"), same("s", "o", ["conv_id"]))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return joined.select("s.conv_id", gaps, "blank", "duplicate", "truncated", (F.col("illegal") + F.col("borders")).alias("illegal"), "cost", "audit", "repaired_sha256")


def before_all(symbols: bytes, togo) -> np.ndarray:
    togo = np.array(togo)
    for symbol, length in reversed(runs(symbols)):
        togo = before_run(symbol, length, togo)
    return togo


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of the rows (conv_id, turn, role, text), none of them null but conv_id and turn."""
    pieces = written(segments(rows), "pieces")
    several = written(pieces.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id", F.lit(True).alias("long")), "long")
    if several.limit(1).count() == 0:
        return per_batch(pieces.select("conv_id", "rows"), _repair_whole, SUMMARY, "conv_id")
    held = F.broadcast(several) if several.count() <= 1 << 20 else several
    match = F.expr("p.conv_id <=> q.conv_id")
    whole = pieces.alias("p").join(held.alias("q"), match, "left_anti")
    long = written(pieces.alias("p").join(held.alias("q"), match, "left_semi"), "long-pieces")
    short = per_batch(whole.select("conv_id", "rows"), _repair_whole, SUMMARY, "conv_id")
    return short.unionByName(_long(long))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    chats = table(spark, folder, "conversations")
    fixed = repair(damaged(chats))
    every = chats.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    joined = every.alias("e").join(fixed.alias("f"), F.expr("e.conv_id <=> f.conv_id"), "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    names = [f.split(" ")[0] for f in SUMMARY.split(", ")]
    return joined.select("e.conv_id", *[F.coalesce(F.col(f"f.{c}"), none.get(c, F.lit(0))).alias(c) for c in names])


def _oracle() -> str:
    def best(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"

    def then(state: str, cost: str, letter: str, line: str, when: str = "true") -> str:
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"

    def insert(state: str, role: str) -> str:
        return then(state, "3", "I", f"'{role}:' || chr(10)")

    def use(state: str, letter: str, role: str, cost: str, when: str = "true") -> str:
        return then(state, f"{cost} + 3 * CAST(truncated AS INT)", letter, f"{role} || ':' || text || chr(10)", f"NOT gone AND {when}")

    def delete(state: str) -> str:
        return then(state, "4", "D", "''")

    before_user = ("s0", "s1", "n3")
    end = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return rf"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce([i] || range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, tab,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations, tab),
fated AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS fate FROM named),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(0, 2) AS again(k) WHERE fate <> 0 AND (k = 0 OR fate = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
marked AS (
  SELECT *, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
judged AS (
  SELECT *, left(role, 1) AS r, last = '' AS blank, last <> '' AND again AS dup, last NOT IN ('', '.', '!', '?') AND NOT again AS truncated, last = '' OR again AS gone FROM marked),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {end} AS s1, {end} AS s2, {end} AS s3
  FROM (SELECT DISTINCT conv_id FROM judged)
  UNION ALL
  SELECT conv_id, i, {delete('s0')}, {best(delete('s1'), use('s0', 'K', 'role', '0', "r = 's'"))},
    {best(delete('n2'), *[use(s, 'K', 'role', '0', "r = 'u'") for s in before_user], *[use(s, 'R', "'user'", '3') for s in before_user])},
    {best(delete('n3'), use('n2', 'K', 'role', '0', "r = 'a'"), use('n2', 'R', "'assistant'", '3'))}
  FROM (
    SELECT *, {best('s3', insert('n2', 'assistant'))} AS n3 FROM (
      SELECT w.*, j.i AS i, j.role, j.text, j.r, j.truncated, j.gone,
        {best('s2', insert('s0', 'user'), insert('s1', 'user'), insert('s3', 'user'))} AS n2
      FROM (SELECT conv_id, s0, s1, s2, s3, i AS done FROM walk) w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.done + 1)) AS x(conv_id, s0, s1, s2, s3, done, i, role, text, r, truncated, gone, n2, n3)),
ended AS (
  SELECT conv_id, {best('s0', 's3', insert('n2', 'assistant'))} AS e FROM (
    SELECT *, {best('s2', insert('s0', 'user'), insert('s1', 'user'), insert('s3', 'user'))} AS n2
    FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(d.e.c, 0) AS cost, coalesce(d.e.a, '') AS audit, sha256(coalesce(left(d.e.t, length(d.e.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""


OP13_SQL = _oracle()
