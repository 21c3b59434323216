"""Repair of damaged conversations by lightest derivations.

A repaired conversation is an optional system turn followed by pairs of a user
and an assistant turn, or nothing. Repair is a weighted deduction system: an
item ``(i, q)`` says that the first ``i`` rows can be edited to turns that end
in grammar state ``q``, an item ``i`` that row ``i`` is read; each hyperedge
joins such items to a further one by keeping, re-roling, deleting or inserting
a turn. Its weight is a pair (cost, audit) and its function adds the cost of
the edit and appends its initial to the audit. Both only grow, and two audits
of one item and one cost are never prefixes of each other (they hold one letter
per row, and every further insertion costs), so the function is superior and
Knuth's agenda finalises items in order of weight until the goal is popped.

Rows are dealt by range of (conversation, turn, role, hash of text), so a
conversation that holds a third of all rows is spread over many tasks. A task
streams its sorted rows and closes a piece at the end of each conversation,
every ``PIECE`` rows or ``PIECE_BYTES``. A piece that is a whole conversation
is repaired at once. For a piece of a split one the agenda is run from each
state, which gives one span item per pair of states; the spans of a
conversation are joined in order by a second deduction that reads no texts.
Faults that depend on earlier rows come from an aggregation over hashes.

Edge cases: null ids, roles and texts count as one space, except that a null
conversation is returned under its null; rows of one turn are ordered by role
and hash of text, null turns first; of equal rows the first is no duplicate; a
role that does not start with s, u or a cannot be kept; empty texts are blank;
a long text moves with its row; a conversation without rows has an empty
repair; empty tables give no rows; further columns are not carried and may
have any name. Only the audit and the digest of a conversation, single values,
pass one task, the digest as a stream.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

#: Rows and bytes of text of a piece.
PIECE, PIECE_BYTES = 512, 4 << 20
#: Cost of each edit and of a truncated row that stays.
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
#: States: nothing yet, after a system, user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, FINAL = 4, (START, ASSISTANT)
#: The state behind a turn by its initial.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
PAIRS = ("su", "ua", "au")


def derive(initials: list[str], gone: list[bool], cut: list[bool], start: int, goal: bool):
    """Knuth's agenda over the items of some rows from state ``start``:
    ``{state: (cost, audit)}`` of the lightest derivations that read all rows;
    with ``goal`` it ends with the first that is in a final state. ``gone``
    rows must be deleted, ``cut`` ones are truncated."""
    n, done, out = len(initials), set(), {}
    agenda = [(0, "", 0, start)]  # the axiom; rows are axioms of no weight
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n:
            out.setdefault(q, (cost, audit))
            if goal and q in FINAL:
                return {q: (cost, audit)}
        for initial in ROLES:  # insert
            to = NEXT[q].get(initial)
            if to is not None and (i, to) not in done:
                heapq.heappush(agenda, (cost + COST["I"], audit + "I", i, to))
        if i == n:
            continue
        if (i + 1, q) not in done:
            heapq.heappush(agenda, (cost + COST["D"], audit + "D", i + 1, q))
        if gone[i]:
            continue
        stays = cost + TRUNCATED * cut[i]
        for initial, to in NEXT[q].items():
            if (i + 1, to) in done:
                continue
            if initial == initials[i]:
                heapq.heappush(agenda, (stays + COST["K"], audit + "K", i + 1, to))
            if initial in ROLES:
                heapq.heappush(agenda, (stays + COST["R"], audit + "R", i + 1, to))
    return out


def apply_edits(audit: str, roles: list[str], texts: list[str], start: int) -> list[tuple[str, str]]:
    """The turns that the edits make of the rows, from state ``start``."""
    q, i, turns = start, 0, []
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            turns.append((roles[i], texts[i]))
        else:  # a made turn is the one user or assistant turn that may follow
            initial = next(r for r in NEXT[q] if r in ROLES)
            turns.append((ROLES[initial], "" if edit == "I" else texts[i]))
        q = NEXT[q][turns[-1][0][0]]
        i += edit != "I"
    return turns


_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns_seen")


class _Piece:
    """The rows of a conversation that a task has read and not yet closed."""

    def __init__(self, conv, number: int, opened: bool):
        self.conv, self.number, self.opened = conv, number, opened  # opened: begun by another piece
        self.roles, self.texts, self.gone, self.cut = [], [], [], []
        self.count = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = None
        self.bytes = 0

    def add(self, turn, role, text, blank, duplicate, truncated, same):
        """``same``: the row equals the one before it."""
        if turn is not None and turn != self.last:
            self.count["turns_seen"] += 1
            self.last = turn
            self.first = turn if self.first is None else self.first
        duplicate = not blank and (duplicate or same)
        truncated = not blank and not duplicate and truncated
        for name, fault in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
            self.count[name] += fault
        if self.roles:
            self.count["illegal"] += (self.roles[-1][:1] + role[:1]) not in PAIRS
        self.roles.append(role)
        self.texts.append(text)
        self.gone.append(blank or duplicate)
        self.cut.append(truncated)
        self.bytes += len(text)

    def full(self, rows: int) -> bool:
        return len(self.roles) >= rows or self.bytes >= PIECE_BYTES

    def row(self, whole: bool) -> dict:
        initials = [r[:1] for r in self.roles]
        row = {"conv": self.conv, "piece": self.number, "whole": whole, "first": self.first, "last": self.last,
               "head": initials[0] if initials else None, "tail": initials[-1] if initials else None, **self.count}
        if whole:
            (cost, audit), = derive(initials, self.gone, self.cut, START, True).values()
            turns = apply_edits(audit, self.roles, self.texts, START)
            return {**row, "cost": cost, "audit": audit, "repaired": [{"role": r, "text": t} for r, t in turns]}
        spans = [{"start": q, "end": e, "cost": c, "audit": a} for q in range(STATES)
                 for e, (c, a) in sorted(derive(initials, self.gone, self.cut, q, False).items())]
        return {**row, "spans": spans, "roles": self.roles, "texts": self.texts}


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                      T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])


def _piece_schema(conv: T.DataType) -> T.StructType:
    strings = T.ArrayType(T.StringType())
    return T.StructType([
        T.StructField("conv", conv), T.StructField("piece", T.LongType()), T.StructField("whole", T.BooleanType()),
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
        T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in _COUNTS],
        T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()),
        T.StructField("repaired", T.ArrayType(_TURN)), T.StructField("spans", T.ArrayType(_SPAN)),
        T.StructField("roles", strings), T.StructField("texts", strings)])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def pieces(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """Pieces of conversations of at most ``most`` rows, in order within each. ``rows`` are ``(conv,
    turn, role, text, blank, truncated, missing)``, ``missing`` ones only name
    their conversation."""
    digest = F.md5(F.concat_ws("\0", "role", "text"))
    rows = rows.withColumn("digest", F.when(~F.col("missing") & ~F.col("blank"), digest))
    # texts that occur again in their conversation, with their first turn (a null turn comes first)
    again = (rows.filter("digest is not null").groupBy("conv", "digest")
             .agg(F.count("*").alias("n"), F.min("turn").alias("least"), F.count("turn").alias("timed"))
             .filter("n > 1").select(F.col("conv").alias("c"), F.col("digest").alias("g"),
                                     F.when(F.col("timed") == F.col("n"), F.col("least")).alias("since"),
                                     F.lit(True).alias("repeated")))
    rows = rows.join(again, rows.conv.eqNullSafe(again.c) & (rows.digest == again.g), "left")
    later = F.col("turn").isNotNull() & (F.col("since").isNull() | (F.col("turn") > F.col("since")))
    rows = rows.select("conv", F.xxhash64("conv").alias("h"), "turn", "role", "text", "blank", "truncated", "missing",
                       F.coalesce(F.col("repeated") & later, F.lit(False)).alias("duplicate"), "digest",
                       F.xxhash64("text").alias("th"))
    order = ["h", "conv", "turn", "role", "th"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    dealt = dealt.withColumn("part", F.spark_partition_id())
    schema = _piece_schema(rows.schema["conv"].dataType)
    arrow = _arrow(schema)
    names = ["conv", "turn", "role", "text", "blank", "truncated", "missing", "duplicate", "digest", "part"]

    def run(batches):
        open_, number, before, out, size = None, 0, None, [], 0
        first = True  # the first conversation of a task may have begun in another one

        def batch():
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        for read in batches:
            cols = [read.column(i).to_pylist() for i in range(len(names))]
            for conv, turn, role, text, blank, cut, missing, duplicate, digest, part in zip(*cols):
                if open_ is None:
                    number = part << 32
                    open_ = _Piece(conv, number, first)
                elif conv != open_.conv:
                    out.append(open_.row(not open_.opened))
                    number += 1
                    open_, first, before = _Piece(conv, number, False), False, None
                elif open_.full(most):
                    out.append(open_.row(False))
                    number += 1
                    open_ = _Piece(conv, number, True)
                size += len(text)
                if len(out) >= 256 or size >= PIECE_BYTES:
                    if out:
                        yield batch()
                    out, size = [], 0
                if missing:
                    continue
                same = digest is not None and before == (turn, digest)
                open_.add(turn, role, text, blank, duplicate, cut, same)
                before = (turn, digest)
        if open_ is not None:  # it may go on in the next task
            out.append(open_.row(False))
        if out:
            yield batch()

    return written(dealt.select(*names).mapInArrow(run, schema))


_REPORT = ("first", "last", *_COUNTS, "cost", "audit")


def joined(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans of split conversations joined in order: a report row per
    conversation, and ``(conv, piece, start, end)`` of the spans chosen."""
    schema = T.StructType([parts.schema["conv"], T.StructField("piece", T.LongType()),
                           T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                           *[parts.schema[c] for c in _REPORT]])
    arrow = _arrow(schema)
    cols = ["conv", "piece", "first", "last", "head", "tail", *_COUNTS, "spans"]
    sorted_ = parts.filter("not whole").select(*cols).repartition("conv").sortWithinPartitions("conv", "piece")

    def close(conv, total, best, trail):
        (cost, audit), state = min((best[q], q) for q in FINAL if q in best)
        # back through the pieces: the span that each state was reached by
        for number, back in reversed(trail):
            start = back[state]
            yield {"conv": conv, "piece": number, "start": start, "end": state}
            state = start
        yield {"conv": conv, **total, "cost": cost, "audit": audit}

    def run(batches):
        total = best = trail = conv = tail = None
        out = []
        for read in batches:
            for r in read.to_pylist():
                if total is None or r["conv"] != conv:
                    if total is not None:
                        out += close(conv, total, best, trail)
                    conv, tail = r["conv"], None
                    total, best, trail = dict.fromkeys(_REPORT), {START: (0, "")}, []
                    total.update(dict.fromkeys(_COUNTS, 0))
                for c in _COUNTS:
                    total[c] += r[c]
                if r["first"] is not None:
                    total["turns_seen"] -= r["first"] == total["last"]
                    total["first"] = r["first"] if total["first"] is None else total["first"]
                    total["last"] = r["last"]
                if r["head"] is not None:
                    total["illegal"] += tail is not None and tail + r["head"] not in PAIRS
                    tail = r["tail"]
                reached, back = {}, {}
                for s in r["spans"]:
                    if s["start"] not in best:
                        continue
                    cost, audit = best[s["start"]]
                    weight = (cost + s["cost"], audit + s["audit"])
                    if s["end"] not in reached or weight < reached[s["end"]]:
                        reached[s["end"]], back[s["end"]] = weight, s["start"]
                best = reached
                trail.append((r["piece"], back))
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if total is not None:
            out += close(conv, total, best, trail)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    found = written(sorted_.mapInArrow(run, schema))
    return found.filter("piece is null").select("conv", *_REPORT), \
        found.filter("piece is not null").select("conv", "piece", "start", "end")


def repair(rows: DataFrame, most: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """``(report, parts)`` of the rows ``(conv, turn, role, text, missing)``
    (``missing`` rows only name their conversation). ``report`` has a row per
    conversation: its faults, the cost and audit of its repair and the repaired
    ``turns``. Where a conversation was split (into pieces of ``most`` rows), ``turns`` is null and its turns
    are in ``parts``: ``(conv, piece, turns)``, in order of ``piece``."""
    shown = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    rows = rows.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce("missing", F.lit(False)).alias("missing"))
    rows = rows.withColumn("blank", shown == "").withColumn("truncated", ~shown.rlike(r"[.!?]\z"))
    found = pieces(rows, most)
    report, chosen = joined(found)
    split = found.filter("not whole").select(F.col("conv").alias("c"), F.col("piece").alias("p"), "spans", "roles", "texts")
    there = chosen.join(split, chosen.conv.eqNullSafe(split.c) & (chosen.piece == split.p))

    @F.udf(T.ArrayType(_TURN), useArrow=True)
    def turns(spans, roles, texts, start, end):
        audit = next(s["audit"] for s in spans if s["start"] == start and s["end"] == end)
        return apply_edits(audit, roles, texts, start)

    whole = found.filter("whole").select("conv", *_REPORT, F.col("repaired").alias("turns"))
    return whole.unionByName(report.withColumn("turns", F.lit(None).cast(T.ArrayType(_TURN)))), \
        there.select("conv", "piece", turns("spans", "roles", "texts", "start", "end").alias("turns"))


def lines(turns: str) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")


def stream_digests(parts: DataFrame) -> DataFrame:
    """``(conv, sha)``: SHA-256 of the lines of split conversations, each
    hashed as a stream of its pieces."""
    schema = T.StructType([parts.schema["conv"], T.StructField("sha", T.StringType())])
    arrow = _arrow(schema)

    def run(batches):
        conv = state = None
        begun = False

        def row():
            return pa.RecordBatch.from_pylist([{"conv": conv, "sha": state.hexdigest()}], schema=arrow)

        for read in batches:
            for c, text in zip(read.column(0).to_pylist(), read.column(1).to_pylist()):
                if state is None or c != conv:
                    if state is not None:
                        yield row()
                    conv, state, begun = c, hashlib.sha256(), False
                if text is not None:
                    state.update(("\n" + text if begun else text).encode())
                    begun = True
        if state is not None:
            yield row()

    text = F.when(F.size("turns") > 0, lines("turns")).alias("text")
    return parts.select("conv", "piece", text).repartition("conv").sortWithinPartitions("conv", "piece").select(
        "conv", "text").mapInArrow(run, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` damaged by the checksum of ``conv_id:turn``: rows
    dropped (left as ``missing``), emptied, without ends of sentences, repeated
    or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", text("role").alias("role"),
                                text("text").alias("text"), kind.alias("kind"))
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(times)).select(
        "conv", "turn", "role", "text", (F.col("kind") == 0).alias("missing"))


def contract(report: DataFrame, parts: DataFrame) -> DataFrame:
    """The columns of ``op13_repair`` from what :func:`repair` returns."""
    sha = stream_digests(parts).select(F.col("conv").alias("c"), "sha")
    cut = report.filter("turns is null").join(sha, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    all_ = report.filter("turns is not null").withColumn("sha", F.sha2(lines("turns"), 256)).unionByName(cut)
    gaps = F.coalesce(F.col("last") - F.col("first") + 1 - F.col("turns_seen"), F.lit(0)).cast("long")
    return all_.select(F.col("conv").alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal",
                       "cost", "audit", F.col("sha").alias("repaired_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired turns of every
    damaged conversation."""
    return contract(*repair(damage(table(spark, sf_dir, "conversations"))))


QUERIES = {"op13_repair": op13_repair}
ORACLE_SQL = {}
