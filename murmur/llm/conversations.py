"""Repair of conversations: the cheapest edits that make the roles alternate, by auctions over a cost lattice.

A node of the lattice is (rows used, state); the state is what the repaired roles are so
far: nothing, a system row, a user row last, an assistant row last. Arcs keep, re-role,
delete or insert a row. Every node gets a price. A path grows from a node along the arc
whose cost and end price are least (extension); where that sum exceeds the node's own
price, the price rises to it and the path steps back (contraction). A path that meets
a settled node settles all its nodes, whose prices then are exact distances to the end. Arcs
whose cost is just the difference of their prices are tight, and the audit follows the
tight arc with the least letter from node to node.

A conversation is cut into segments of bounded length. Prices pass between segments through
their 4 x 4 costs, so no task needs the rows of a long conversation together.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.session import materialize

SEGMENT_BITS = 12  # segments have up to 4,096 rows
MEMO_CHARS = 64

# Costs of the edits, and white space and sentence ends in faults.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = r"\x20\x09-\x0D"
SENTENCE_END = "[.!?]"

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
REACHES = ({0, 1, 2, 3}, {1, 2, 3}, {2, 3}, {2, 3})  # states that can still follow a state
TURN = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an inserted or re-roled row leads to
ROLE = {USER: "user", ASSISTANT: "assistant"}
CLOSING = ("", "II", "I", "")  # inserts that complete a conversation
LAST = tuple(INSERT * len(c) for c in CLOSING)
UNREACHABLE = 1 << 60
LEGAL = {"su", "ua", "au"}


def arcs(code: str, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, rows used, next state) of every edit that a row allows in a state, by letter.

    ``code`` is s, u, a or x (any other initial), in upper case where the row is truncated,
    or - where it must be deleted.
    """
    found = [("D", DELETE, 1, state), ("I", INSERT, 0, TURN[state])]
    if code == "-":
        return found
    extra = TRUNCATED if code.isupper() else 0
    kept = {"s": SYSTEM if state == EMPTY else None, "u": USER if state != USER else None, "a": ASSISTANT if state == USER else None}.get(code.lower())
    if kept is not None:
        found.append(("K", extra, 1, kept))
    return [*found, ("R", REROLE + extra, 1, TURN[state])]


_ARCS = {code: [arcs(code, state) for state in STATES] for code in "suaxSUAX-"}


def settle(out, price: list[int], settled: list[bool], origin: int) -> None:
    """Run one auction from ``origin``; ``out(node)`` lists (cost, node) of its arcs."""
    path = [origin]
    while True:
        node = path[-1]
        best, end = min(((cost + price[to], to) for cost, to in out(node)), default=(UNREACHABLE, -1))
        if best >= UNREACHABLE:
            price[node], settled[node] = UNREACHABLE, True
            path.pop()
            if not path:
                return
        elif price[node] < best:
            price[node] = best
            if len(path) > 1:
                path.pop()
        elif settled[end]:
            for x in path:
                settled[x] = True
            return
        else:
            path.append(end)


def prices(layers: int, exits, out) -> list[int]:
    """Price of every node (4 * layer + state) of a lattice whose last layer has the prices ``exits``."""
    price = [0] * (4 * layers) + list(exits)
    settled = [False] * (4 * layers) + [True] * 4
    for node in range(4 * layers - 1, -1, -1):
        if not settled[node]:
            settle(out, price, settled, node)
    return price


def _live(exits) -> list[bool]:
    """States from which an exit with a price can follow; the others would bid against each other without end."""
    return [any(exits[e] < UNREACHABLE for e in REACHES[s]) for s in STATES]


def row_prices(codes: str, exits) -> list[int]:
    """Prices of a segment's lattice. At its last layer nothing is inserted: that is left to what follows."""
    live = _live(exits)
    tables = {c: [[(cost, 4 * used + to) for _, cost, used, to in options if live[to]] if live[s] else [] for s, options in enumerate(_ARCS[c])] for c in set(codes)}

    def out(node: int):
        layer = node & ~3
        return [(cost, layer + to) for cost, to in tables[codes[node >> 2]][node & 3]]

    return prices(len(codes), exits, out)


def _memo(function):
    kept = lru_cache(1 << 16)(function)
    return lambda codes, *rest: kept(codes, *rest) if len(codes) <= MEMO_CHARS else function(codes, *rest)


@_memo
def crossing_costs(codes: str) -> tuple[int, ...]:
    """Least cost from every entry state to every exit state of a segment, entries first."""
    columns = [row_prices(codes, [0 if e == to else UNREACHABLE for e in STATES])[:4] for to in STATES]
    return tuple(columns[to][s] for s in STATES for to in STATES)


@_memo
def trace(codes: str, exits: tuple[int, ...], entry: int) -> tuple[str, int]:
    """(letters of the edits, exit state): the least letters along tight arcs from an entry state."""
    price = row_prices(codes, exits)
    at, state, letters = 0, entry, []
    while at < len(codes):
        here = price[4 * at + state]
        for letter, cost, used, to in _ARCS[codes[at]][state]:
            if cost + price[4 * (at + used) + to] == here:
                break
        letters.append(letter)
        at, state = at + used, to
    return "".join(letters), state


def boundary_prices(crossings: list[list[int]]) -> list[list[int]]:
    """Prices of the four states before each segment and behind the last."""

    def out(node: int):
        costs = crossings[node >> 2][4 * (node & 3) : 4 * (node & 3) + 4]
        return [(cost, (node & ~3) + 4 + to) for to, cost in enumerate(costs) if cost < UNREACHABLE]

    price = prices(len(crossings), LAST, out)
    return [price[i : i + 4] for i in range(0, len(price), 4)]


class Repair(NamedTuple):
    """turns: conv_id, turn, role, text, at, in order of ``at``. segments: conv_id, start, edits (letters).
    edits: conv_id, at, sub, edit, role of every edit, in order of (at, sub). conversations: conv_id, cost and counts.
    """

    turns: DataFrame
    segments: DataFrame
    edits: DataFrame
    conversations: DataFrame


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults planted by the checksum of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its sentence ends out, 3 repeats it, 4 makes it a
    user's. Null values count as one space.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(known("conv_id"), F.lit(":"), known("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", SENTENCE_END, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Rows by conversation and turn, numbered upwards by ``at`` (with gaps), and what repair needs of each.

    Equal turns are ordered by role, then by the digest of role and text; rows equal in all
    are spread by their place in the input, so a conversation of any length or a row of
    any number of copies is sorted in many tasks.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    same = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    initial = F.substring("role", 1, 1)
    rows = rows.select(
        "*",
        F.unhex(F.sha2(F.encode(same, "UTF-8"), 256)).alias("digest"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"),
        (~F.col("text").rlike(rf"{SENTENCE_END}[{SPACE}]*\z")).alias("cut_off"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv_id", "turn", "role", "digest", "tie"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id())


def _arrow_map(df: DataFrame, schema: T.StructType, work) -> DataFrame:
    """``work`` turns one row, as a dictionary, into rows of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                made = [row for given in batch.slice(at, 1024).to_pylist() for row in work(given)]
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row)) for row in made], schema=arrow)

    return df.mapInArrow(run, schema)


def _schema(df: DataFrame, fields: str) -> T.StructType:
    """The type of ``conv_id`` in ``df`` and further fields."""
    return T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType), *T._parse_datatype_string(fields).fields])


def _measure(row: dict):
    initials, turns = row["initials"], row["turns"]
    illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
    counts = (row["blank"], row["duplicate"], row["truncated"])
    yield (row["conv_id"], turns[0], turns, row["codes"], list(crossing_costs(row["codes"])), illegal, initials[0], initials[-1], *counts)


def _price(row: dict):
    parts = row["parts"]
    price = boundary_prices([p["costs"] for p in parts])
    borders = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
    yield (row["conv_id"], price[0][EMPTY], row["illegal"] + borders, row["blank"], row["duplicate"], row["truncated"], [p["start"] for p in parts], price[1:])


def _ways(row: dict):
    """What a segment does from each entry state."""
    exits = tuple(row["exits"])
    found = [trace(row["codes"], exits, s) if row["entries"][s] < UNREACHABLE else ("", s) for s in STATES]
    yield (row["conv_id"], row["start"], row["turns"], [f[0] for f in found], [f[1] for f in found])


def _chain(row: dict):
    """The entry state of every segment, and the inserts behind the last."""
    state = EMPTY
    for i, part in enumerate(row["parts"]):
        entry, state = state, part["leads"][state]
        yield (row["conv_id"], part["start"], entry, CLOSING[state] if i == len(row["parts"]) - 1 else "")


def _lay_out(row: dict):
    """One row per edit; inserts take the number of the row they precede, those at the end that of the last row."""
    turns, state, used, sub = row["turns"], row["entry"], 0, 0
    for letter in row["edits"]:
        at = turns[min(used, len(turns) - 1)]
        to = TURN[state]
        if letter == "K":
            to = row["kept"][used]
        if letter != "D":
            state = to
        yield (row["conv_id"], at, sub, letter, ROLE[to] if letter in "RI" else None)
        sub += 1
        if letter != "I":
            used += 1
            sub = 0 if used < len(turns) else sub


def repair(conversations: DataFrame) -> Repair:
    """The cheapest repair of every conversation of (conv_id, turn, role, text); null roles and texts count as one space.

    A row is blank (nothing but white space), a duplicate (role and text seen earlier in the
    conversation) or truncated (no sentence end last), in this order. Keeping costs 0, a new role 1,
    deleting 2, an inserted empty row 5; blank rows and duplicates must go, truncated ones cost 5
    more if they stay. The roles' initials must be nothing, or user and assistant in turn behind at
    most one system row. Of equally cheap repairs the one with the least letters is taken.

    Null ids are a conversation of their own; null turns come first; repeated rows are
    duplicates; rows with another role can be deleted or get a new one. Other columns are left
    out. An empty table gives empty tables.
    """
    turns = materialize(ordered_turns(conversations), "turns")
    firsts = turns.groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    judged = turns.select("conv_id", "at", "initial", "blank", "cut_off").join(firsts, "at", "left")
    duplicate = ~F.col("blank") & F.col("first").isNull()
    truncated = ~F.col("blank") & F.col("first").isNotNull() & F.col("cut_off")
    code = F.when(F.col("blank") | duplicate, "-").when(truncated, F.upper("initial")).otherwise(F.col("initial"))
    entry = F.struct("at", code.alias("code"), "initial")
    joined = lambda field: F.array_join(F.transform("entries", lambda e: e[field]), "")
    cut = judged.groupBy("conv_id", F.shiftright("at", SEGMENT_BITS).alias("block")).agg(
        F.sort_array(F.collect_list(entry)).alias("entries"),
        F.count_if("blank").alias("blank"), F.count_if(duplicate).alias("duplicate"), F.count_if(truncated).alias("truncated"),
    )
    cut = cut.select("conv_id", F.col("entries.at").alias("turns"), joined("code").alias("codes"), joined("initial").alias("initials"), "blank", "duplicate", "truncated")
    measured = _schema(cut, "start long, turns array<long>, codes string, costs array<long>, illegal long, first string, last string, blank long, duplicate long, truncated long")
    segments = materialize(_arrow_map(cut, measured, _measure), "conversation-segments")

    per = segments.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "costs", "first", "last"))).alias("parts"),
        *[F.sum(c).alias(c) for c in ("illegal", "blank", "duplicate", "truncated")],
    )
    priced = _schema(per, "cost long, illegal long, blank long, duplicate long, truncated long, starts array<long>, exits array<array<long>>")
    per = materialize(_arrow_map(per, priced, _price), "conversation-prices")

    exits = per.select(F.explode(F.arrays_zip("starts", "exits")).alias("x")).select(F.col("x.starts").alias("start"), F.col("x.exits").alias("exits"))
    entries = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda e: F.col("costs")[4 * s + e] + F.col("exits")[e])))
    ways = _schema(segments, "start long, turns array<long>, edits array<string>, leads array<int>")
    found = _arrow_map(segments.join(exits, "start").select("conv_id", "start", "turns", "codes", "exits", entries.alias("entries")), ways, _ways)
    found = materialize(found, "conversation-ways")

    linked = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "leads"))).alias("parts"))
    entered = _arrow_map(linked, _schema(linked, "start long, entry int, closing string"), _chain).drop("conv_id")
    chosen = found.join(entered, "start").select("conv_id", "start", "turns", "entry", F.concat(F.col("edits")[F.col("entry")], "closing").alias("edits"))
    chosen = materialize(chosen, "conversation-edits")

    codes = segments.select("start", F.split(F.lower("codes"), "").alias("letters"))
    states = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
    kept = F.transform("letters", lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in states.items()]))
    laid = _arrow_map(chosen.join(codes, "start").withColumn("kept", kept).drop("letters", "start"), _schema(chosen, "at long, sub int, edit string, role string"), _lay_out)
    return Repair(turns.select("conv_id", "turn", "role", "text", "at"), chosen.select("conv_id", "start", "edits"), laid, per.drop("starts", "exits"))


def repaired_turns(repair: Repair) -> DataFrame:
    """conv_id, at, sub, role, text of the repaired conversations, in order of (at, sub)."""
    stay = repair.edits.filter("edit != 'D'").withColumnRenamed("role", "new_role")
    rows = stay.join(repair.turns.select("at", "role", "text"), "at", "left")
    text = F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
    return rows.select("conv_id", "at", "sub", F.coalesce("new_role", "role").alias("role"), text.alias("text"))


def _gathered(rows: DataFrame, order: list[str], value: Column, name: str, between: str) -> DataFrame:
    """One text per conversation; as long as the conversation itself."""
    in_order = F.sort_array(F.collect_list(F.struct(*order, value.alias("value"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(in_order, lambda x: x["value"]), between).alias(name))


def audits(original: DataFrame, repair: Repair) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (the turns as ``role:text`` lines).

    One row for every conversation of ``original``, also for those that have no rows left. The last
    two columns are whole conversations in one value, as asked for; the tables of ``repair`` are not.
    """
    spans = repair.turns.select("conv_id", F.col("turn").cast("long").alias("turn")).distinct().groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")
    )
    lines = repaired_turns(repair)
    parts = [
        spans,
        repair.conversations,
        _gathered(repair.segments, ["start"], F.col("edits"), "audit", ""),
        _gathered(lines, ["at", "sub"], F.concat("role", F.lit(":"), "text"), "repaired", "\n"),
    ]
    found = original.select(F.col("conv_id").alias("asked")).distinct()
    for part in parts:
        found = found.join(part, F.col("asked").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        F.col("asked").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], *[F.coalesce(c, F.lit("")).alias(c) for c in ("audit", "repaired")]
    )
