"""Conversations put back into turns, at the least cost, by an auction for shortest paths.

A conversation is a lattice: how many rows are behind, and where the order of roles stands
(``s?(ua)+`` or nothing).  An edit is an arc with a whole-number cost.  The auction keeps a
price for every node, never above an arc's cost and the price behind it, and a path from
the start: where the path's end can go on without loss it is extended, else its price
rises and it is contracted.  When the path arrives, the prices are duals that show every
arc of every cheapest path as tight, and the edits are traced along tight arcs that reach
the end, the smallest letter first.

Conversations of any length: rows are numbered in range partitions and cut into blocks.  A
block's prices towards each of its ends are a small matrix; what is behind a block is a
scan of matrices, where its trace begins is a scan of the traces' ends, and both scans go
over blocks of blocks.  Nothing holds a conversation but the strings that are asked for:
its audit, and its digest, which one task has to read in order (it keeps no rows).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfold.llm.common import tidied, whole_texts
from cellfold.runtime import same_keys, written

#: Rows of a block, elements of one that a scan runs through in one go.
ROWS, FAN = 64, 256
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: Where the order of roles stands: 0 nothing yet, 1 after s, 2 after u, 3 after a.
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
ENDS = (0, 3)
#: No way at all.
NONE = 1 << 40
SPACE = " \t\n\v\f\r"


def arcs_of(rows: str, exits: list[int], last: bool) -> tuple[list[list[tuple[str, int, int]]], list[int]]:
    """Arcs of a block's lattice as (letter, cost, node) and prices to begin with.

    ``rows`` has two letters a row: the role's initial and the fault (``-`` none, ``x`` to
    be deleted, ``t`` truncated).  Node 4i + q is state q before row i; the last node is the
    end, ``exits`` the cost of leaving the block in each state.
    """
    n = len(rows) // 2
    arcs, prices, behind = [[] for _ in range(4 * n + 4)], [0] * (4 * n + 5), 0
    for i in range(n, -1, -1):
        if i < n and rows[2 * i + 1] == "x":
            behind += DELETE
        for q in range(4):
            out = arcs[4 * i + q]
            prices[4 * i + q] = behind
            if i < n:
                initial, fault = rows[2 * i], rows[2 * i + 1]
                more = CUT if fault == "t" else 0
                out.append(("D", DELETE, 4 * i + 4 + q))
                out.append(("I", INSERT, 4 * i + WANTED[q]))
                if fault != "x":
                    if initial in KEEPS[q]:
                        out.append(("K", more, 4 * i + 4 + KEEPS[q][initial]))
                    out.append(("R", REROLE + more, 4 * i + 4 + WANTED[q]))
            else:
                if exits[q] < NONE:
                    out.append(("", exits[q], 4 * n + 4))
                if last:
                    out.append(("I", INSERT, 4 * i + WANTED[q]))
    leads = leading(arcs, lambda node, cost, to: True)
    return arcs, [p if ahead else NONE for p, ahead in zip(prices, leads)]


def leading(arcs: list[list[tuple[str, int, int]]], good: Callable[[int, int, int], bool]) -> list[bool]:
    """Which nodes good arcs lead to the end from.  (A node without a way would raise its
    price round a cycle of inserts for ever.)"""
    end = len(arcs)
    leads = [False] * end + [True]
    for layer in range(end - 4, -1, -4):
        for _ in range(2):  # inserts lead from 0 and 1 to 2, from 2 to 3 and back
            for node in range(layer + 3, layer - 1, -1):
                leads[node] = leads[node] or any(leads[to] and good(node, cost, to) for _, cost, to in arcs[node])
    return leads


def auction(arcs: list[list[tuple[str, int, int]]], prices: list[int], origin: int) -> int:
    """Raise ``prices`` until a path of tight arcs leads from ``origin`` to the end, whose
    price is 0; the origin's price, the distance."""
    end, path = len(arcs), [origin]
    while prices[origin] < NONE and path[-1] != end:
        here = path[-1]
        best, to = NONE, -1
        for _, cost, node in arcs[here]:
            if cost + prices[node] < best:
                best, to = cost + prices[node], node
        if prices[here] < best:
            prices[here] = best
            if here != origin:
                path.pop()
        else:
            path.append(to)
    return min(prices[origin], NONE)


def traces(rows: str, exits: list[int], last: bool, entries: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """For each state the block is entered in: edits, their cost, and the state it is left in."""
    arcs, prices = arcs_of(rows, exits, last)
    for q in entries:
        auction(arcs, prices, q)
    end, found = len(arcs), []
    leads = leading(arcs, lambda node, cost, to: prices[node] == cost + prices[to])
    for q in entries:
        node, letters, spent = q, [], 0
        if prices[q] >= NONE:
            found.append(("", NONE, q))
            continue
        while node != end:
            letter, cost, to = min(a for a in arcs[node] if leads[a[2]] and prices[node] == a[1] + prices[a[2]])
            if to == end:
                break
            letters.append(letter)
            spent += cost
            node = to
        found.append(("".join(letters), spent, node - (end - 4)))
    return found


def matrix(rows: str, last: bool) -> list[int]:
    """Distances through a block, from each state to each."""
    found = np.full((4, 4), NONE, np.int64)
    for to in range(4):
        arcs, prices = arcs_of(rows, [0 if q == to else NONE for q in range(4)], last)
        for q in range(4):
            found[q, to] = auction(arcs, prices, q)
    return found.reshape(-1).tolist()


def through(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First ``a``, then ``b``: the smallest sums."""
    return np.minimum((a.reshape(4, 4)[:, :, None] + b.reshape(4, 4)[None]).min(axis=1), NONE).reshape(-1)


def after(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """First ``f``, then ``g``: states to states."""
    return g[f]


def scanned(blocks: DataFrame, then: Callable[[np.ndarray, np.ndarray], np.ndarray], unit: list[int], backwards: bool, most: int) -> DataFrame:
    """``conv_id, no`` and as ``value`` everything before block ``no`` of a conversation put
    together, or with ``backwards`` everything behind it.

    ``blocks`` has ``conv_id, no, value``; ``no`` runs from 0 to ``most``.  ``FAN`` blocks are
    run through in one go, blocks of blocks likewise, so no task has a whole conversation.
    """
    grouped = blocks.withColumn("up", F.expr(f"no div {FAN}"))
    lists = grouped.groupBy("conv_id", "up").agg(F.sort_array(F.collect_list(F.struct("no", "value"))).alias("run"))
    wide = most >= FAN
    if wide:
        def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                sums = []
                for run in frame["run"]:
                    sum_ = np.array(unit)
                    for item in run:
                        sum_ = then(sum_, np.asarray(item["value"]))
                    sums.append(sum_.tolist())
                yield pd.DataFrame({"conv_id": frame["conv_id"], "no": frame["up"], "value": sums})

        kind = blocks.schema["conv_id"].dataType.simpleString()
        above = scanned(written(lists.mapInPandas(total, f"conv_id {kind}, no long, value array<long>"), "totals"), then, unit, backwards, most // FAN)
        lists = same_keys(lists, above.select("conv_id", F.col("no").alias("up"), F.col("value").alias("carry")), ["conv_id", "up"])
    else:
        lists = lists.withColumn("carry", F.array(*[F.lit(int(x)).cast("long") for x in unit]))

    def run_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names, numbers, values = [], [], []
            for name, run, carry in zip(frame["conv_id"], frame["run"], frame["carry"]):
                state = np.asarray(carry)
                for item in reversed(run) if backwards else run:
                    names.append(name)
                    numbers.append(item["no"])
                    values.append(state.tolist())
                    one = np.asarray(item["value"])
                    state = then(one, state) if backwards else then(state, one)
            yield pd.DataFrame({"conv_id": pd.Series(names, dtype=frame["conv_id"].dtype), "no": numbers, "value": values})

    kind = blocks.schema["conv_id"].dataType.simpleString()
    return written(lists.select("conv_id", "run", "carry").mapInPandas(run_up, f"conv_id {kind}, no long, value array<long>"), "scan")


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their place in the partition's run of their
    conversation and what is to be known of their text."""
    part, before, places = TaskContext.get().partitionId(), None, count()
    for batch in batches:
        idx, initial, fault, key = [], [], [], []
        for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            if before is None or before[0] != conv:
                before, places = (conv,), count()
            idx.append(next(places))
            # Only three initials are told apart.
            initial.append(role[:1] if role[:1] in ("s", "u", "a") else "?")
            end = text.rstrip(SPACE)
            fault.append("x" if not end else "-" if end[-1] in ".!?" else "t")
            key.append(xxhash.xxh3_128_digest(f"{role}\0{text}".encode()) if end else None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(idx, pa.int64()), pa.array(initial), pa.array(fault), pa.array(key, pa.binary())],
            [*batch.schema.names, "part", "idx", "initial", "fault", "key"])


def each_block(columns: Callable[[pd.DataFrame], dict]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"conv_id": frame["conv_id"], "no": frame["no"]} | columns(frame))

    return run


def by_row(letters: str, entry: int) -> tuple[list[str], list[str], str]:
    """For every row the roles inserted before it and what becomes of its role (empty:
    deleted, ``=``: kept), and the roles inserted at the end."""
    inserts, roles, waiting, state = [], [], [], entry
    for letter, ahead in letters:
        if letter == "I":
            waiting.append(ROLE[WANTED[state]])
            state = WANTED[state]
            continue
        inserts.append("\n".join(f"{r}:" for r in waiting))
        waiting = []
        if letter == "D":
            roles.append("")
        elif letter == "R":
            roles.append(ROLE[WANTED[state]])
            state = WANTED[state]
        else:
            roles.append("=")
            state = KEEPS[state][ahead]
    return inserts, roles, "\n".join(f"{r}:" for r in waiting)


def edits_of(frame: pd.DataFrame) -> dict:
    found = {n: [] for n in ("letters", "cost", "inserts", "roles", "tail")}
    for rows, entry, each in zip(frame["rows"], frame["entry"], frame["traces"]):
        letters, cost = each[entry]["letters"], each[entry]["cost"]
        initials, at = [], 0
        for letter in letters:
            initials.append(rows[2 * at] if letter != "I" else "")
            at += letter != "I"
        inserts, roles, tail = by_row(list(zip(letters, initials)), entry)
        for name, value in zip(found, (letters, cost, inserts, roles, tail)):
            found[name].append(value)
    return found


def digest_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, repaired_sha256`` of lines that come sorted; no line is kept."""
    before, hasher, some = None, hashlib.sha256(), False
    for batch in batches:
        names, found = [], []
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if before is not None and before[0] != conv:
                names.append(before[0])
                found.append(hasher.hexdigest())
            if before is None or before[0] != conv:
                before, hasher, some = (conv,), hashlib.sha256(), False
            if line is not None:
                hasher.update((("\n" if some else "") + line).encode())
                some = True
        yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field("conv_id").type), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
    if before is not None:
        yield pa.RecordBatch.from_arrays([pa.array([before[0]], batch.schema.field("conv_id").type), pa.array([hasher.hexdigest()])], ["conv_id", "repaired_sha256"])


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired conversations and how they came about.

    ``rows`` has ``conv_id, turn, role, text``, any other column is left out.  First result:
    ``conv_id, part, idx, line``, sorted by these the conversation's ``role:text`` lines,
    null where a row is deleted; a line holds the inserted lines before it.  Second result, a row for each
    conversation: ``gaps, blank, duplicate, truncated, illegal, cost, audit``.

    Null role and text are one space.  A null conv_id is a conversation, a null turn comes
    first; rows of one turn are ordered by role and text.  Equal rows are told apart by
    place: the first stays, the others are duplicates.  A gap count beyond a long is null.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    order = ["conv_id", "turn", "role", "text"]
    ranged = whole_texts(rows).select("conv_id", "turn", space("role"), space("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    turn = rows.schema["turn"].dataType.simpleString()
    table = written(ranged.mapInArrow(tidied(marked), f"conv_id {kind}, turn {turn}, role string, text string, part int, idx long, initial string, fault string, key binary"), "turns")

    place = F.struct("part", "idx")
    seen = table.where("key IS NOT NULL").groupBy("conv_id", "key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = table.select("conv_id", "turn", "part", "idx", "initial", "fault", "key")
    again = same_keys(known, seen, ["conv_id", "key"], "left").withColumn("again", F.coalesce(F.col("first") != place, F.lit(False)))
    facts = written(again.select("conv_id", "turn", "part", "idx", "initial", "fault", "again"), "facts")
    mark = F.when(F.col("again"), "x").otherwise(F.col("fault"))

    blocks = facts.groupBy("conv_id", "part", F.expr(f"idx div {ROWS}").alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.concat("initial", mark).alias("two")))), lambda x: x["two"]), "").alias("rows"))
    blocks = written(blocks, "blocks")
    # Blocks of a conversation are numbered through: in a partition they are, and partitions are few.
    sizes = blocks.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"), F.sum("n").alias("all"))
    starts = lists.select("conv_id", "all", F.posexplode("parts").alias("k", "p"), "parts").select(
        "conv_id", "all", F.col("p.part").alias("part"), F.aggregate(F.slice("parts", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("start"))
    blocks = written(same_keys(blocks, starts, ["conv_id", "part"]).select(
        "conv_id", "part", "block", (F.col("start") + F.col("block")).alias("no"), "all", "rows"), "numbered")

    many = blocks.where("all > 1")
    most = many.agg(F.max("no")).first()[0] or 0
    last = F.col("no") == F.col("all") - 1
    costs = many.select("conv_id", "no", "rows", last.alias("last")).mapInPandas(
        each_block(lambda f: {"value": [matrix(r, bool(x)) for r, x in zip(f["rows"], f["last"])]}), f"conv_id {kind}, no long, value array<long>")
    same = np.where(np.eye(4, dtype=bool), 0, NONE).reshape(-1).tolist()
    behind = scanned(written(costs, "matrices"), through, same, True, most) if most else None
    # Left in state q, what is behind costs the least way to an end.
    ways = lambda v, q: F.least(*[F.get(v, F.lit(4 * q + e)) for e in ENDS])
    end = F.array(*[F.lit(0 if q in ENDS else NONE).cast("long") for q in range(4)])
    if behind is None:
        exits = blocks.withColumn("exits", end)
    else:
        exits = same_keys(blocks, behind, ["conv_id", "no"], "left").withColumn(
            "exits", F.when(F.col("value").isNull(), end).otherwise(F.array(*[ways(F.col("value"), q) for q in range(4)]))).drop("value")

    def traced(f: pd.DataFrame) -> dict:
        out = []
        for rows_, exits_, last_, alone in zip(f["rows"], f["exits"], f["last"], f["alone"]):
            each = traces(rows_, [int(x) for x in exits_], bool(last_), (0,) if alone else (0, 1, 2, 3))
            out.append([{"letters": a, "cost": b, "exit": c} for a, b, c in each])
        return {"rows": f["rows"], "traces": out}

    found = written(exits.select("conv_id", "no", "rows", "exits", last.alias("last"), (F.col("all") == 1).alias("alone")).mapInPandas(
        each_block(traced), f"conv_id {kind}, no long, rows string, traces array<struct<letters: string, cost: long, exit: long>>"), "traces")
    if behind is None:
        entered = found.withColumn("entry", F.lit(0).cast("long"))
    else:
        steps = found.where(F.size("traces") > 1).select("conv_id", "no", F.transform("traces", lambda t: t["exit"]).alias("value"))
        into = scanned(steps, after, [0, 1, 2, 3], False, most)
        entered = same_keys(found, into, ["conv_id", "no"], "left").withColumn("entry", F.coalesce(F.get("value", F.lit(0)), F.lit(0)))
    edits = entered.select("conv_id", "no", "rows", "entry", "traces").mapInPandas(
        each_block(edits_of), f"conv_id {kind}, no long, letters string, cost long, inserts array<string>, roles array<string>, tail string")
    edits = written(same_keys(edits, blocks.select("conv_id", "no", "part", "block", "rows"), ["conv_id", "no"]), "edits")

    each = edits.select("conv_id", "part", (F.col("block") * ROWS).alias("low"), "tail", "inserts", F.posexplode("roles").alias("k", "new"), F.size("roles").alias("n"))
    each = each.select("conv_id", "part", (F.col("low") + F.col("k")).alias("idx"), "new", F.get("inserts", "k").alias("ahead"),
                       F.when(F.col("k") == F.col("n") - 1, F.col("tail")).otherwise("").alias("tail"))
    own = F.when(F.col("new") != "", F.concat(F.when(F.col("new") == "=", F.col("role")).otherwise(F.col("new")), F.lit(":"), "text"))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    line = F.concat_ws("\n", filled("ahead"), own, filled("tail"))
    some = (F.col("ahead") != "") | (F.col("new") != "") | (F.col("tail") != "")
    lines = same_keys(table.select("conv_id", "part", "idx", "role", "text"), each, ["conv_id", "part", "idx"]).select(
        "conv_id", "part", "idx", F.when(some, line).alias("line"))

    # Neighbours within a block, and each block's end with the next one's beginning.
    pair = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
    first, final = F.substring("rows", 1, 1), F.substring("rows", -2, 1)
    size = (F.length("rows") / 2).cast("int")
    inside = F.size(F.filter(F.sequence(F.lit(1), size), lambda k: (k < size) & ~pair(F.substr(F.col("rows"), 2 * k - 1, F.lit(1)), F.substr(F.col("rows"), 2 * k + 1, F.lit(1)))))
    seams = same_keys(edits.select("conv_id", (F.col("no") + 1).alias("no"), final.alias("one")), edits.select("conv_id", "no", first.alias("two")), ["conv_id", "no"])
    seams = seams.groupBy("conv_id").agg(F.sum((~pair("one", "two")).cast("long")).alias("seams"))
    sums = edits.groupBy("conv_id").agg(
        F.sum("cost").alias("cost"), F.sum(inside.cast("long")).alias("inside"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    wide = lambda c: c.cast("decimal(38,0)")
    number = lambda c: F.sum(c.cast("long"))
    counts = facts.groupBy("conv_id").agg(
        F.coalesce(wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count_distinct("turn")), F.lit(0)).try_cast("long").alias("gaps"),
        number(F.col("fault") == "x").alias("blank"), number(F.col("again")).alias("duplicate"),
        number((F.col("fault") == "t") & ~F.col("again")).alias("truncated"))
    report = same_keys(same_keys(counts, sums, ["conv_id"]), seams, ["conv_id"], "left")
    return lines, report.select("conv_id", "gaps", "blank", "duplicate", "truncated", (F.col("inside") + F.coalesce("seams", F.lit(0))).alias("illegal"), "cost", "audit")


def repair_report(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The second result of ``repaired`` with ``repaired_sha256`` for every ``conv_id`` of
    ``named``; one without rows has zeros, an empty audit and the empty string's digest."""
    lines, report = repaired(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    digests = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "idx").select("conv_id", "line").mapInArrow(
        tidied(digest_lines), f"conv_id {kind}, repaired_sha256 string")
    all_ = same_keys(same_keys(named.select("conv_id").distinct(), report, ["conv_id"], "left"), digests, ["conv_id"], "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    # A gap count may be null on its own account: beyond a long.
    told = F.col("cost").isNotNull()
    return all_.select("conv_id", *[F.when(told, F.col(c)).otherwise(F.lit(empty.get(c, 0))).alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")])


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults drawn from a hash of ``conv_id:turn``."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    drawn = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fault.alias("_fault")).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    return drawn.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
