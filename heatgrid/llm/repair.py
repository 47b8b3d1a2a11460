"""Repair of conversation structure by Knuth's lightest-derivation agenda.

A repaired conversation's roles read `(s?(ua)+)?` (by their initials). Every row is kept (cost 0), re-roled to user or assistant (3) or
deleted (4; the only choice for blank and duplicate rows), empty user or assistant rows may be inserted anywhere (3), and a truncated row that
stays adds 3. The audit of a repair is the row of its edits' initials; the cheapest repair is wanted, of equally cheap ones
the one whose audit comes first.

Items are weighted deductions. `Prefix[i, q]` says that the first i rows of a chunk can be edited so that the roles lead
from the chunk's entry state to q; an edit of the next row or an insertion derives further prefixes. `Span[p -> r]` of a chunk or of two adjacent
spans joined at a state is a derivation with two antecedents, `Span[p -> q], Span[q -> r] => Span[p -> r]`. The agenda pops
items by (cost, rows covered, audit); an item is final when it is popped first, and the goal ends the search.

Why that is right: weights add up and audits are joined, so a consequence is never lighter than an antecedent (an edit
costs something or covers a row more). And a lighter antecedent gives a lighter consequence, also where audits are compared: derivations of one
item cover the same rows, so of two equally cheap ones neither audit begins the other (it could only go on with
insertions, which cost), and whatever is joined before or behind them cannot turn their order.

On a cluster. Only marks travel at first: equal rows of a turn merge to one with a count, a row is a duplicate if its role and
text have an earlier turn (a minimum per group), rows are range-sorted by (conversation, turn), and each task turns
its rows into chunks with all (entry, exit) derivations. Conversations of one chunk are done there; the chunks of others are joined pairwise. So a
conversation may be as long as it likes: its edits are found by many tasks. Its digest (SHA-256 has one chain) is read in one pass
over its sorted rows by one task that holds one batch and the audit.

Defined results: null roles, texts, conversation ids and turns count as one space where they are read as text; null turns come first and
are no turns for the gaps; null ids are one conversation; rows of one turn are ordered by role and by a digest of the
text; roles of another initial fit nowhere, nor does an empty role; conversations without rows have zeros and an empty audit; an
empty table gives no rows. Only the four columns are read, others cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from heatgrid.llm.common import written

CHUNK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that may come next in each state, when it is free to choose.
FREE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}

Weight = tuple[int, int, str]  # cost, rows covered, audit


def lightest(axioms: Iterable[tuple[tuple, Weight]], deduce: Callable, goals: set | None = None) -> dict[tuple, Weight]:
    """Knuth's generalisation of Dijkstra: the lightest derivation of each item, in the order of their weights.

    `deduce(item, weight, final)` yields the consequences of a new final item, with its partners among the final ones. The search ends
    with the agenda or when all goals are final."""
    agenda = [(weight, item) for item, weight in axioms]
    heapq.heapify(agenda)
    final: dict[tuple, Weight] = {}
    open_ = set(goals or ())
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if goals:
            open_.discard(item)
            if not open_:
                break
        for consequence, value in deduce(item, weight, final):
            if consequence not in final:
                heapq.heappush(agenda, (value, consequence))
    return final


def chunk_spans(rows: list[tuple[str, bool, bool]], entries: Iterable[int], goals: set[int] | None = None) -> dict[tuple[int, int], Weight]:
    """(entry, exit) -> lightest derivation over the rows of one chunk, given as (initial, must be deleted, truncated)."""
    n = len(rows)

    def deduce(item, weight, _):
        i, q = item
        cost, _, audit = weight
        free = FREE[q]
        yield (i, free), (cost + INSERT, i, audit + "I")
        if i < n:
            initial, lost, cut = rows[i]
            yield (i + 1, q), (cost + DELETE, i + 1, audit + "D")
            if not lost:
                more = TRUNCATED if cut else 0
                kept = NEXT.get((q, initial))
                if kept is not None:
                    yield (i + 1, kept), (cost + KEEP + more, i + 1, audit + "K")
                yield (i + 1, free), (cost + REROLE + more, i + 1, audit + "R")

    out = {}
    for p in entries:
        if goals is None:
            found = lightest([((0, p), (0, 0, ""))], deduce, None)
            out |= {(p, q): found[n, q] for q in range(4) if (n, q) in found}
        else:  # the goal item: the end of the rows in a state that may end
            stop = n + 1

            def ending(item, weight, final):
                if item[0] == n and item[1] in goals:
                    yield (stop, 0), weight
                if item[0] < stop:
                    yield from deduce(item, weight, final)

            found = lightest([((0, p), (0, 0, ""))], ending, {(stop, 0)})
            out[p, -1] = found[stop, 0]
    return out


def join_spans(chunks: list[dict[tuple[int, int], Weight]]) -> Weight:
    """The lightest derivation over all chunks: spans of two neighbours are joined where the left one's exit is the right one's entry."""
    width = 1
    while width < len(chunks):
        width *= 2
    whole = {(q, q): (0, 0, "") for q in range(4)}
    level = chunks + [whole] * (width - len(chunks))
    # items are (level, place, entry, exit); the goal is any accepting exit of the root
    depth = width.bit_length() - 1
    axioms = [((0, k, p, r), w) for k, spans in enumerate(level) for (p, r), w in spans.items() if k or p == START]

    def deduce(item, weight, final):
        up, k, p, r = item
        if up == depth:
            if p == START and r in (START, ASSISTANT):
                yield (depth + 1, 0, 0, 0), weight
            return
        for q in range(4):
            other = (up, k ^ 1, r, q) if k % 2 == 0 else (up, k ^ 1, q, p)
            found = final.get(other)
            if found is not None:
                left, right = (weight, found) if k % 2 == 0 else (found, weight)
                ends = (p, q) if k % 2 == 0 else (q, r)
                yield (up + 1, k >> 1, *ends), (left[0] + right[0], left[1] + right[1], left[2] + right[2])

    return lightest(axioms, deduce, {(depth + 1, 0, 0, 0)})[depth + 1, 0, 0, 0]


# --- rows ---------------------------------------------------------------------------------------------

def _space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text): the conversations with faults, chosen by crc32 of `conv:turn` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its end marks away, 3 repeats it, 4 makes the user say it."""
    kind = F.pmod(F.crc32(F.concat(_space(F.col(conv)), F.lit(":"), _space(F.col(turn))).cast("binary")), F.lit(20))
    said = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    rows = df.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), _space(F.col(role)).alias("_role"), _space(F.col(text)).alias("_text"), kind.alias("_kind"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("_kind != 0").select(
        F.col("_conv").alias(conv), F.col("_turn").alias(turn), F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias(role), said.alias(text), times.alias("_copy"),
    ).drop("_copy")


def _named(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), _space(F.col(role)).alias("role"), _space(F.col(text)).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


ORDER = ("turn", "role", "digest")  # ascending order puts null turns first


def marked_rows(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, initial, n, blank, cut, again): equal rows of a turn once; `again` if an earlier turn says the same."""
    bare = F.expr(r"trim(TRAILING ' \t\n\u000b\f\r' FROM text)")
    last = F.substring(bare, -1, 1)
    marked = rows.select("conv", "turn", "role", "digest", (bare == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    equal = marked.groupBy("conv", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    equal = equal.withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    first = equal.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    return equal.join(first, same, "left").select("conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "n", "blank", "cut", again.alias("again"))


_STATS = ["rows", "low", "high", "turns", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal", "first", "last"]
_STATS_DDL = ("rows bigint, low bigint, high bigint, turns bigint, first_turn bigint, last_turn bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
              "first string, last string")


def _measure(rows: list[tuple]) -> dict:
    """Counts of (turn, initial, blank, duplicate, cut) rows in order."""
    turns = [t for t, *_ in rows if t is not None]
    return {
        "rows": len(rows), "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)), "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None, "blank": sum(b for _, _, b, _, _ in rows), "duplicate": sum(d and not b for _, _, b, d, _ in rows),
        "truncated": sum(c and not b and not d for _, _, b, d, c in rows), "illegal": sum(x[1] + y[1] not in LEGAL for x, y in zip(rows, rows[1:])),
        "first": rows[0][1], "last": rows[-1][1],
    }


def _merge(a: dict, b: dict) -> dict:
    least = lambda f, x, y: y if x is None else x if y is None else f(x, y)
    known = a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out = {k: a[k] + b[k] for k in ("rows", "turns", "blank", "duplicate", "truncated", "illegal")}
    out["turns"] -= known
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    return out | {
        "low": least(min, a["low"], b["low"]), "high": least(max, a["high"], b["high"]), "first": a["first"], "last": b["last"],
        "first_turn": a["first_turn"] if a["first_turn"] is not None else b["first_turn"], "last_turn": b["last_turn"] if b["last_turn"] is not None else a["last_turn"],
    }


def _chunks(chunk: int, conv_type: pa.DataType):
    """Sorted rows to chunks: `cost` and `audit` where the conversation is one chunk that lies inside the task, else its `spans`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, out, conv, inside, held = 0, [], None, False, []
        started = False

        def close(last: bool, ends_here: bool) -> None:
            """The rows held become a chunk. `last`: the conversation's last one in this task."""
            nonlocal at, held
            if not held:
                return
            row = {"conv": conv, "part": part, "at": at, **_measure(held)}
            edits = [(i, b or d, c) for _, i, b, d, c in held]
            if last and ends_here and inside and not pieces:
                cost, _, audit = chunk_spans(edits, [START], {START, ASSISTANT})[START, -1]
                row |= {"cost": cost, "audit": audit, "spans": None}
            else:
                spans = chunk_spans(edits, range(4))
                row |= {"cost": None, "audit": None, "spans": [{"entry": p, "exit": r, "cost": w[0], "audit": w[2]} for (p, r), w in spans.items()]}
            out.append(row)
            at, held = at + 1, []

        def batch() -> pa.RecordBatch:
            nonlocal out
            rows, out = out, []
            return pa.RecordBatch.from_pylist(rows, schema=_chunk_schema(conv_type))

        pieces = False
        for arrow in batches:
            columns = [c.to_pylist() for c in arrow.columns]
            for c, turn, initial, n, blank, cut, again in zip(*columns):
                if not started or c != conv:
                    if started:
                        close(True, True)
                    inside, conv, pieces, started = started, c, False, True
                for k in range(n):
                    if len(held) == chunk:
                        close(False, False)
                        pieces = True
                    held.append((turn, initial, blank, again or k > 0, cut))
                    if len(out) >= 1000:
                        yield batch()
        if started:
            close(True, False)
        if out:
            yield batch()

    return run


def _chunk_schema(conv_type: pa.DataType) -> pa.Schema:
    text, long = pa.string(), pa.int64()
    span = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", long), ("audit", text)])
    return pa.schema([("conv", conv_type), ("part", pa.int32()), ("at", long), *[(s, text if s in ("first", "last") else long) for s in _STATS], ("cost", long), ("audit", text), ("spans", pa.list_(span))])


def _join(conv_type: pa.DataType):
    """Chunks sorted by conversation and place to one row for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, stats, spans = None, None, []
        schema = pa.schema([f for f in _chunk_schema(conv_type) if f.name not in ("part", "at", "spans")])

        def done() -> pa.RecordBatch:
            cost, _, audit = join_spans(spans)
            return pa.RecordBatch.from_pylist([{"conv": conv, **stats, "cost": cost, "audit": audit}], schema=schema)

        for arrow in batches:
            for row in arrow.to_pylist():
                if stats is not None and row["conv"] != conv:
                    yield done()
                    stats, spans = None, []
                conv = row["conv"]
                stats = {k: row[k] for k in _STATS} if stats is None else _merge(stats, row)
                spans.append({(s["entry"], s["exit"]): (s["cost"], row["rows"], s["audit"]) for s in row["spans"]})
        if stats is not None:
            yield done()

    return run


def find_repairs(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv, rows, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[conv].dataType
    marked = marked_rows(_named(df, conv, turn, role, text))
    placed = marked.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER).select("conv", "turn", "initial", "n", "blank", "cut", "again")
    span = "array<struct<entry:int,exit:int,cost:bigint,audit:string>>"
    own = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL(f"part int, at bigint, {_STATS_DDL}, cost bigint, audit string, spans {span}").fields])
    chunks = written(placed.mapInArrow(_chunks(chunk, to_arrow_type(kind)), own))
    final = T.StructType([f for f in own.fields if f.name not in ("part", "at", "spans")])
    parts = chunks.where(F.col("spans").isNotNull()).repartition("conv").sortWithinPartitions("conv", "part", "at")
    done = chunks.where(F.col("spans").isNull()).select(*final.names).unionByName(parts.mapInArrow(_join(to_arrow_type(kind)), final))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("bigint"))
    return done.select(F.col("conv").alias(conv), "rows", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, str, str | None]]:
    """(conversation, place, role, text) of the repaired rows, from each conversation's audit followed by its rows in order. A last entry
    without a place ends every conversation."""
    conv, audit, at, state, place, started = None, "", 0, START, 0, False

    def inserts() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state = FREE[state]
            at, place = at + 1, place + 1
            yield conv, place - 1, ROLE[state], ""

    for batch in batches:
        for c, edits, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if edits is not None:
                if started:
                    yield from inserts()
                    yield conv, -1, "", None
                conv, audit, at, state, place, started = c, edits, 0, START, 0, True
                continue
            yield from inserts()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "K":
                state = NEXT[state, role[:1]]
            else:
                state = FREE[state]
                role = ROLE[state]
            place += 1
            yield conv, place - 1, role, text
    if started:
        yield from inserts()
        yield conv, -1, "", None


def _with_audits(df: DataFrame, repairs: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = _named(df, conv, turn, role, text).select("conv", F.lit(None).cast("string").alias("audit"), "role", "text", "turn", "digest", F.lit(1).alias("kind"))
    none = lambda t: F.lit(None).cast(t)
    audits = repairs.select(F.col(conv).alias("conv"), "audit", none("string").alias("role"), none("string").alias("text"), none("bigint").alias("turn"), none("binary").alias("digest"), F.lit(0).alias("kind"))
    return rows.unionByName(audits).repartition("conv").sortWithinPartitions("conv", "kind", *ORDER).select("conv", "audit", "role", "text")


def repaired_rows(df: DataFrame, repairs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, role, text): the conversations after their repairs."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[conv].dataType
    arrow = pa.schema([("conv", to_arrow_type(kind)), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for c, place, r, t in _edited(batches):
            if place >= 0:
                rows.append({"conv": c, "place": place, "role": r, "text": t})
                size += len(t) + 50
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    out = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL("place bigint, role string, text string").fields])
    done = _with_audits(df, repairs, conv, turn, role, text).mapInArrow(run, out)
    return done.select(F.col("conv").alias(conv), "place", F.col("role").alias(role), F.col("text").alias(text))


def repaired_digests(df: DataFrame, repairs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, repaired_sha256): lowercase hex SHA-256 of the repaired rows as `role:text`, joined by newlines."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[conv].dataType
    arrow = pa.schema([("conv", to_arrow_type(kind)), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, digest = [], hashlib.sha256()
        for c, place, r, t in _edited(batches):
            if place >= 0:
                digest.update((("\n" if place else "") + r + ":").encode())
                digest.update(t.encode())
                continue
            rows.append({"conv": c, "repaired_sha256": digest.hexdigest()})
            digest = hashlib.sha256()
            if len(rows) == 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    out = T.StructType([T.StructField("conv", kind), T.StructField("repaired_sha256", T.StringType())])
    return _with_audits(df, repairs, conv, turn, role, text).mapInArrow(run, out).select(F.col("conv").alias(conv), "repaired_sha256")


def repair_report(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK, all_conversations: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of `all_conversations` (default: of df): faults, cost, audit and the digest of the repaired rows."""
    rows = written(df.select(conv, turn, role, text))
    repairs = written(find_repairs(rows, conv, turn, role, text, chunk))
    digests = repaired_digests(rows, repairs, conv, turn, role, text)
    every = (df if all_conversations is None else all_conversations).select(F.col(conv).alias("_id")).distinct()
    a, b = repairs.withColumnRenamed(conv, "_a"), digests.withColumnRenamed(conv, "_b")
    both = every.join(a, F.col("_id").eqNullSafe(F.col("_a")), "left").join(b, F.col("_id").eqNullSafe(F.col("_b")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return both.select(F.col("_id").alias(conv), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
