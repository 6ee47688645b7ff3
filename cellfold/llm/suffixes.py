"""Bytes that stand in a string repeated elsewhere, found by distributed prefix doubling.

A position's rank says which string of a length starts there.  Ranks of a length are made
of pairs of ranks of half of it, at the position and at a growing offset from it; Spark
brings equal pairs together, and positions whose rank is unique go before the next length.
Only equality of ranks is asked, never their order, so a rank is the pair's 64-bit name
and need not be carried back to its neighbours; two names always have to agree.

Sorting every byte at every length would shuffle the corpus dozens of times.  Three things
keep the rounds small and lose nothing:

* **Anchors.**  Of every window of ``length`` bytes the smallest hash of a third of it is
  the anchor.  Equal windows have equal anchors, so the first round ranks anchors alone,
  one in about 70 bytes, and windows whose anchor is unique are done.
* **Classes.**  The windows of one anchor lie together.  Where all their bytes are equal
  they are one class, of which one member goes on; a class met twice is repeated whole.
* **Blocks.**  The next round ranks, in what is left, the bytes that eight windows share:
  unique, they are done; their whole union met twice, they are repeated.  Only what is
  left of that is ranked window by window, at the full length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfold.llm.common import tidied, whole_texts
from cellfold.runtime import written

LENGTH = 200
#: Windows of a text that are hashed at once, windows of a block.
CHUNK, GRID = 1 << 16, 8
#: Bits of a packed hash that hold its place in a chunk.
PLACE = np.uint64((1 << 20) - 1)

U = np.uint64
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(count, base, U)]), dtype=U)


_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _table(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and powers of the base and of its inverse for ``size`` bytes."""
    size = max(1 << 17, 1 << int(size).bit_length())
    if size not in _tables:
        letters = np.random.default_rng(13).integers(0, 2**63, 256, dtype=U) * U(2) + U(1)
        _tables.clear()
        _tables[size] = letters, _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
    return _tables[size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes:
    """Hashes of the substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        letters, powers, self.inverse = _table(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(letters[data] * powers[:len(data)], out=self.sums[1:])

    def of(self, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        return (self.sums[past] - self.sums[first]) * self.inverse[first]

    def all(self, length: int) -> np.ndarray:
        count = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:count]) * self.inverse[:count])

    def ranks(self, length: int, least: int = 64) -> np.ndarray:
        """Ranks of all strings of ``length``: pairs of ranks of half of it."""
        if length <= least:
            return self.all(length)
        half = (length + 1) // 2
        below = self.ranks(half, least)
        count = max(0, len(self.sums) - length)
        return mixed(below[:count] * U(0xD6E8FEB86659FD93) + below[length - half:length - half + count])


def anchors(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``first, count, own, rank, name`` of the groups of windows that share an anchor: the
    first window, how many there are, the anchor's place behind the first, its rank and the
    name of all the group's bytes."""
    size = max(1, length // 3)
    width = length - size + 1
    for start in range(0, len(data) - length + 1, CHUNK):
        part = data[start:start + CHUNK + length - 1]
        hashes = Hashes(part)
        ranks = hashes.all(size)
        low = (ranks & ~PLACE) | np.arange(len(ranks), dtype=U)
        have = 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[:len(low) - step], low[step:])
            have += step
        place = (low & PLACE).astype(np.int64)
        first = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(place[1:] != place[:-1]) + 1])
        count = np.diff(np.append(first, len(place)))
        own = place[first] - first
        rank = ranks[place[first]]
        name = mixed(hashes.of(first, first + count - 1 + length) + mixed(rank + (own << 20).astype(U) + count.astype(U)))
        yield start + first, count, own, rank, name


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and bytes of every text that is not null."""
    for row, text in enumerate(column.cast(pa.large_binary())):
        if text.is_valid:
            yield row, np.frombuffer(text.as_buffer(), np.uint8)


def signed(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array(a.view(np.int64)) for a in arrays]


def first_ranks(length: int):
    """``rank, name, n``: anchors' ranks and groups' names with how often a batch has them."""
    def run(batches):
        for batch in batches:
            found = [(g[3], g[4]) for _, data in texts_of(batch.column("text")) for g in anchors(data, length)]
            if found:
                rank, name = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((name, rank))
                rank, name = rank[order], name[order]
                new = np.flatnonzero(np.append(True, (rank[1:] != rank[:-1]) | (name[1:] != name[:-1])))
                yield pa.RecordBatch.from_arrays([*signed(rank[new], name[new]), pa.array(np.diff(np.append(new, len(rank))))], ["rank", "name", "n"])

    return run


def groups_of(length: int):
    """``name, doc_id, h, first, count, own`` of every group of windows."""
    names = ["name", "doc_id", "h", "first", "count", "own"]

    def run(batches):
        for batch in batches:
            found, rows = [], []
            for row, data in texts_of(batch.column("text")):
                for first, count, own, _, name in anchors(data, length):
                    found.append((name, first, count, own))
                    rows.append(np.full(len(first), row))
            if found:
                name, first, count, own = (np.concatenate(x) for x in zip(*found))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [*signed(name), batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(first), pa.array(count.astype(np.int32)), pa.array(own.astype(np.int32))], names)

    return run


def strings_of(length: int):
    """``name, n, own, count, doc_id, h, first, bytes``: the bytes of the groups asked for."""
    names = ["name", "n", "own", "count", "doc_id", "h", "first", "bytes"]

    def run(batches):
        for batch in batches:
            lists = batch.column("asked")
            flat, ends = lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            first, count = (flat.field(n).to_numpy() for n in ("first", "count"))
            rows = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            for low in range(0, len(rows), 4096):
                part = slice(low, low + 4096)
                data = {r: np.frombuffer(batch.column("text")[r].cast(pa.large_binary()).as_buffer(), np.uint8) for r in np.unique(rows[part]).tolist()}
                cut = [data[r][f:f + c + length - 1].tobytes() for r, f, c in zip(rows[part].tolist(), first[part].tolist(), count[part].tolist())]
                own = flat.slice(low, len(cut))
                at = pa.array(rows[part])
                yield pa.RecordBatch.from_arrays(
                    [own.field("name"), own.field("n"), own.field("own"), own.field("count"), batch.column("doc_id").take(at), batch.column("h").take(at),
                     own.field("first"), pa.array(cut, pa.binary())], names)

    return run


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 ... c-1 for each of ``counts``, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def laid_out(batch: pa.RecordBatch) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's strings in one row of bytes: hashes, where each begins, its anchor, its windows."""
    column = batch.column("bytes")
    lengths = np.array([len(x) for x in column.to_pylist()], np.int64)
    begin = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return Hashes(data), begin, batch.column("own").to_numpy().astype(np.int64), batch.column("count").to_numpy().astype(np.int64)


def block_ranks(length: int):
    """``core, whole, n, name, block``: for each block of windows the rank of what they share
    and the name of their union."""
    def run(batches):
        for batch in batches:
            hashes, begin, own, count = laid_out(batch)
            low, high = -own // GRID, (count - 1 - own) // GRID
            many = high - low + 1
            row = np.repeat(np.arange(len(own)), many)
            block = low[row] + ranges(many)
            start = own[row] + block * GRID  # of the whole block, the string's first window being 0
            b1, b2 = np.maximum(start, 0), np.minimum(start + GRID, count[row]) - 1
            core = hashes.ranks(length - GRID + 1)[begin[row] + start + GRID - 1]
            whole = mixed(hashes.of(begin[row] + b1, begin[row] + b2 + length) + mixed(((b1 - start) * 64 + b2 - b1).astype(U) + U(1)))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*signed(core, whole), batch.column("n").take(at), batch.column("name").take(at), pa.array(block.astype(np.int32))],
                                             ["core", "whole", "n", "name", "block"])

    return run


def window_ranks(length: int):
    """``rank, core, n, name, window`` of the windows of the blocks asked for."""
    def run(batches):
        for batch in batches:
            hashes, begin, own, count = laid_out(batch)
            lists = batch.column("blocks")
            many = lists.value_lengths().to_numpy().astype(np.int64)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(own)), many)
            start = own[row] + flat.field("block").to_numpy().astype(np.int64) * GRID
            b1, b2 = np.maximum(start, 0), np.minimum(start + GRID, count[row]) - 1
            each = np.repeat(np.arange(len(row)), b2 - b1 + 1)
            window = b1[each] + ranges(b2 - b1 + 1)
            rank = hashes.ranks(length)[begin[row[each]] + window]
            at, of = pa.array(row[each]), pa.array(each)
            yield pa.RecordBatch.from_arrays(
                [*signed(rank), flat.field("core").take(of), flat.field("n").take(of), batch.column("name").take(at), pa.array(window.astype(np.int32))],
                ["rank", "core", "n", "name", "window"])

    return run


def cut_out(length: int, kept: list[str]):
    """Texts without the bytes of the windows listed."""
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                spans, left = [], []
                for text, hits in zip(part.column("_text").cast(pa.large_binary()), part.column("_hits")):
                    data = text.as_buffer() if text.is_valid else b""
                    size = len(data)
                    if not hits.is_valid or not len(hits):
                        spans.append([])
                        left.append(bytes(data))
                        continue
                    first, past = (hits.values.field(n).to_numpy().astype(np.int64) for n in ("first", "past"))
                    order = np.argsort(first, kind="stable")
                    first, past = first[order], np.maximum.accumulate(past[order] + length - 1)
                    new = np.flatnonzero(np.append(True, first[1:] > past[:-1]))
                    first, past = first[new], past[np.append(new[1:], len(past)) - 1]
                    spans.append([{"first": int(a), "past": int(b)} for a, b in zip(first, past)])
                    edges = zip(np.append(0, past).tolist(), np.append(first, size).tolist())
                    left.append(b"".join(bytes(data[a:b]) for a, b in edges))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))), pa.array(left, pa.binary())],
                    [*kept, "spans", "kept"])

    return run


def same_document(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by ``doc_id, h``; rows that share both have the same text."""
    other = right.withColumnsRenamed({"doc_id": "_doc", "h": "_h"})
    return left.join(other, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), how).drop("_doc", "_h")


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, h, first, past``: runs of window starts whose string also starts elsewhere.

    ``docs`` has ``doc_id, h, text``; ``h`` is a hash of the text.
    """
    texts = whole_texts(docs.where(F.octet_length("text") >= length).select("doc_id", "h", "text"))
    # Round 1: anchors.  What a batch has often comes once, so a hot rank is few rows.
    met = texts.select("text").mapInArrow(tidied(first_ranks(length)), "rank long, name long, n long").repartition("rank")
    classes = met.groupBy("rank", "name").agg(F.sum("n").alias("n"))
    of_rank = Window.partitionBy("rank")
    told = classes.withColumn("classes", F.count("*").over(of_rank)).withColumn("least", F.min("n").over(of_rank))
    open_ = (F.col("classes") > 1) & (F.col("least") == 1)
    classes = written(told.where((F.col("n") > 1) | open_).select("name", "n", open_.alias("open")), "classes")

    groups = texts.mapInArrow(tidied(groups_of(length)), "name long, doc_id long, h long, first long, count int, own int")
    hits = written(groups.join(classes, "name"), "groups")
    whole = hits.where("n > 1").select("doc_id", "h", "first", (F.col("first") + F.col("count")).alias("past"))

    # Round 2: blocks of one member of each class whose anchor other classes share.
    member = F.min(F.struct("doc_id", "h", "first", "count", "own")).alias("m")
    asked = hits.where("open").groupBy("name").agg(F.first("n").alias("n"), member).select("name", "n", "m.*")
    asked = asked.groupBy("doc_id", "h").agg(F.collect_list(F.struct("name", "n", "own", "count", "first")).alias("asked"))
    strings = written(same_document(texts, asked).mapInArrow(
        tidied(strings_of(length)), "name long, n long, own int, count int, doc_id long, h long, first long, bytes binary"), "strings")
    met = strings.select("name", "n", "own", "count", "bytes").mapInArrow(
        tidied(block_ranks(length)), "core long, whole long, n long, name long, block int").repartition("core")
    of_core, of_whole = Window.partitionBy("core"), Window.partitionBy("core", "whole")
    told = (met.withColumn("met", F.sum("n").over(of_whole))
            .withColumn("once", F.row_number().over(of_whole.orderBy("name", "block")) == 1)
            .withColumn("unions", F.sum(F.col("once").cast("int")).over(of_core)).withColumn("least", F.min("met").over(of_core)))
    blocks = written(told.where("(n = 1 AND met > 1) OR (once AND unions > 1 AND least = 1)"), "blocks")
    found = blocks.where("n = 1 AND met > 1").select("name", F.col("block").alias("at"), F.lit(True).alias("is_block"))

    # Round 3: single windows of the blocks whose core others share and whose union is alone.
    asked = blocks.where("once AND unions > 1 AND least = 1").groupBy("name").agg(
        F.collect_list(F.struct("block", "core", F.col("met").alias("n"))).alias("blocks"))
    met = strings.select("name", "own", "count", "bytes").join(asked, "name").mapInArrow(
        tidied(window_ranks(length)), "rank long, core long, n long, name long, window int").repartition("rank", "core")
    told = met.withColumn("met", F.sum("n").over(Window.partitionBy("rank", "core"))).where("n = 1 AND met > 1")
    found = found.union(told.select("name", F.col("window").alias("at"), F.lit(False)))

    # A class with n = 1 has one member, so what was found of it is found of a document.
    own = strings.where("n = 1").select("name", "doc_id", "h", "first", "count", "own")
    start = F.col("own") + F.col("at") * GRID
    low = F.when(F.col("is_block"), F.greatest(start, F.lit(0))).otherwise(F.col("at"))
    high = F.when(F.col("is_block"), F.least(start + GRID, F.col("count"))).otherwise(F.col("at") + 1)
    parts = own.join(found, "name").select("doc_id", "h", (F.col("first") + low).alias("first"), (F.col("first") + high).alias("past"))
    return whole.union(parts)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (``doc_id, text`` and any others) with ``spans``, the runs of bytes that are
    covered by strings of ``length`` bytes which also start elsewhere, and ``kept``, the
    other bytes.

    Every repeat counts, in the same text too and overlapping itself; nothing stays for the
    first of them.  A null text is an empty one; texts under ``length`` bytes stay whole.
    Repeated rows are repeats of each other, whatever their ids; a null doc_id is an id like
    any other.  Columns called ``spans``, ``kept`` or ``h`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("spans", "kept", "h", "_text", "_hits", "_doc", "_h")]
    marked = docs.select(*kept).withColumn("h", F.xxhash64("text"))
    hits = repeated_windows(marked.select("doc_id", "h", "text"), length)
    listed = hits.groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "past")).alias("_hits"))
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    joined = same_document(marked.withColumn("_text", F.col("text")), listed, "left")
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "spans array<struct<first: long, past: long>>, kept binary"])
    return whole_texts(joined).select(*kept, "_text", "_hits").mapInArrow(tidied(cut_out(length, kept)), schema)


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of ``without_repeats``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda sum_, s: sum_ + s["past"] - s["first"])
    return found.select("doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
