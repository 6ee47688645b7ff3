"""Mix sources to target weights: packed blocks, multinomial shards, permuted slots.

Words of each source are packed into blocks of a fixed length.  Each output shard draws
how many of its slots go to which source; the slots of a source are numbered through all
shards, and a slot's number is mapped through a pseudorandom permutation of the source's
block numbers, one permutation per pass over the source.  Slots and blocks then meet by
source and block number.

The draws are multinomial counts given their totals: the slots of a source over all
shards are fixed by its target, so the counts come from halving the shards again and
again, each half's counts a hypergeometric draw from the whole's.  A shard finds its own
counts and the numbers of its first slots on the way down, from seeds that name the
halves: no shard has to know another, and a task that runs again draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfold.llm.common import tidied, whole_texts, word_count
from cellfold.runtime import bounded, written

#: Words of a block, slots of an output shard.
BLOCK, SLOTS = 64, 2048
WEIGHTS = (3, 1, 2)
#: The table of sources is held by the driver.
MOST_SOURCES = 1_000_000
#: Documents whose words are run up in one window group.
CHUNK = 4096
#: Slots that one tree of draws covers; numpy's draws end at a thousand million.
TREE = 1 << 28


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """What each source gives: ``share`` of all sizes by weight, no source more than
    ``most`` times its size, what is over shared again by weight."""
    found, rest = [0.0] * len(sizes), share * sum(sizes)
    free = [k for k, s in enumerate(sizes) if s > 0]
    while free:
        unit = rest / sum(weights[k] for k in free)
        full = [k for k in free if weights[k] * unit > most * sizes[k]]
        if not full:
            for k in free:
                found[k] = weights[k] * unit
            break
        for k in full:
            found[k] = most * sizes[k]
            rest -= found[k]
        free = [k for k in free if k not in set(full)]
    return found


@dataclass(frozen=True)
class Mixture:
    """One entry per source, by code point with null last."""

    sources: tuple[str | None, ...]
    sizes: tuple[int, ...]
    targets: tuple[float, ...]
    rows: tuple[int, ...]
    block: int
    seed: int

    @property
    def blocks(self) -> np.ndarray:
        return -(-np.array(self.sizes, np.int64) // self.block)

    @property
    def slots(self) -> np.ndarray:
        """Slots of each source: its target in blocks of the mean length."""
        sizes = np.maximum(np.array(self.sizes, float), 1)
        return np.rint(np.array(self.targets) / sizes * self.blocks).astype(np.int64)


def mixture(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
            block: int = BLOCK, seed: int = 11) -> Mixture:
    """Sources of ``sized`` (``source, size``) with their targets; ``weights`` repeat."""
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    aims = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share, most)
    return Mixture(tuple(r["source"] for r in found), tuple(sizes), tuple(aims), tuple(r["n"] for r in found), block, seed)


def permuted(numbers: np.ndarray, size: int, *key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 ... size-1 at ``numbers``: four rounds that mix the
    halves of the bits, walked on while the result is not below ``size``."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = np.random.default_rng(list(key)).integers(0, 2**63, 4, dtype=np.uint64)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for salt in rounds:
            z = (right + salt) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, (left ^ (z >> np.uint64(32))) & mask
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def shard_counts(totals: np.ndarray, shards: int, shard: int, slots: int, key: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in ``shard`` and before it, out of ``totals`` in ``shards`` shards."""
    before, low, high = np.zeros_like(totals), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([*key, low, high])
        left = rng.multivariate_hypergeometric(totals, (middle - low) * slots, method="marginals")
        if shard < middle:
            totals, high = left, middle
        else:
            before, totals, low = before + left, totals - left, middle
    return totals, before


def draw_slots(spark, mix: Mixture, slots: int = SLOTS) -> DataFrame:
    """``shard, slot, source_no, block``: which block each slot of each output shard takes."""
    totals = mix.slots
    trees = max(1, -(-int(totals.sum()) // TREE))
    # A tree has its share of every source, so shards of all trees look alike.
    cuts = [totals * k // trees for k in range(trees + 1)]
    counts = [-(-int((b - a).sum()) // slots) for a, b in zip(cuts, cuts[1:])]
    first = np.cumsum([0, *counts])
    blocks, seed = mix.blocks, mix.seed

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                tree = int(np.searchsorted(first, shard, "right")) - 1
                own, before = shard_counts(cuts[tree + 1] - cuts[tree], counts[tree], shard - int(first[tree]), slots, (seed, tree))
                before = before + cuts[tree]
                numbers, names = [], []
                for s in np.nonzero(own)[0]:
                    slot = np.arange(before[s], before[s] + own[s])
                    for turn in np.unique(slot // blocks[s]):
                        part = slot[slot // blocks[s] == turn] % blocks[s]
                        numbers.append(permuted(part, int(blocks[s]), seed, int(s), int(turn)))
                        names.append(np.full(len(part), s))
                if numbers:
                    order = np.random.default_rng([seed, int(shard), 3]).permutation(sum(map(len, numbers)))
                    yield pd.DataFrame({"shard": int(shard), "slot": np.arange(len(order)),
                                        "source_no": np.concatenate(names)[order], "block": np.concatenate(numbers)[order]})

    shards = int(first[-1])
    parts = max(1, min(shards, 64 + shards // 64))
    return spark.range(0, shards, 1, parts).mapInPandas(run, "shard long, slot long, source_no long, block long")


def source_numbers(spark, mix: Mixture) -> DataFrame:
    rows = [(k, *r) for k, r in enumerate(zip(mix.sources, mix.sizes, mix.targets, mix.rows))]
    return spark.createDataFrame(rows, "source_no long, source string, source_size long, target double, n_rows long")


def numbered(docs: DataFrame, mix: Mixture) -> DataFrame:
    """``docs`` (with ``size``) and its ``source_no``, ``source_size``, ``target``, ``n_rows``."""
    known = bounded(source_numbers(docs.sparkSession, mix), len(mix.sources)).withColumnRenamed("source", "_source")
    return docs.join(known, docs["source"].eqNullSafe(known["_source"]), "left").drop("_source")


def offsets(rows: DataFrame) -> DataFrame:
    """``rows`` (``doc_id, source_no, size, n_rows, h``) with ``start``, the number of words
    of the source before the row.

    A source's rows are dealt by hash into chunks; words are run up inside a chunk, and
    over the chunks' sums.  Equal rows get places in some order, which no result shows.
    """
    chunk = F.pmod(F.xxhash64("doc_id", "h"), F.ceil(F.col("n_rows") / CHUNK)).alias("chunk")
    dealt = rows.select("*", chunk)
    sums = dealt.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sums.select("source_no", "chunk", F.coalesce(F.sum("words").over(up), F.lit(0)).alias("base")), "chunks")
    inside = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return run.join(starts, ["source_no", "chunk"]).withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner", "chunk")


def taken_spans(docs: DataFrame, mix: Mixture) -> DataFrame:
    """Every piece the mix takes: ``shard, slot, source_no, block, doc_id, h, first, past``.

    ``docs`` has ``doc_id, h, source, size``.  ``first`` and ``past`` count the document's
    words from 0.  Pieces of a slot follow each other as they lie in the block.
    """
    rows = numbered(docs.select("doc_id", "h", "source", "size").where("size > 0"), mix)
    at = offsets(rows.drop("source", "source_size", "target"))
    size = mix.block
    over = at.select("doc_id", "h", "source_no", "start", "size", F.explode(F.sequence(
        F.expr(f"start div {size}"), F.expr(f"(start + size - 1) div {size}"))).alias("block"))
    pieces = over.select(
        "source_no", "block", "doc_id", "h", (F.greatest(F.col("start"), F.col("block") * size) - F.col("start")).alias("first"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size) - F.col("start")).alias("past"))
    # What a task of draws makes is not in its size, so the planner must not take it for small.
    return draw_slots(docs.sparkSession, mix).hint("merge").join(pieces, ["source_no", "block"])


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", word_count("text")).withColumn("h", F.xxhash64("text"))


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document what the mix takes of it: ``doc_id, size, source_size, target, taken``.

    ``docs`` has ``doc_id, text, source``.  A null or empty text has size 0 and gives
    nothing; null is a source of its own, the last.  Rows with the same doc_id, text and
    source are told apart only by number: each reports an equal share of what their
    copies give together.
    """
    known = written(sized(docs.select("doc_id", "text", "source")).drop("text"), "sizes")
    mix = mixture(known)
    spans = taken_spans(known, mix).groupBy("source_no", "doc_id", "h").agg(F.sum(F.col("past") - F.col("first")).alias("all"))
    rows = numbered(known, mix)
    copies = rows.groupBy("source_no", "doc_id", "h").agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.count("*").alias("copies"))
    s = spans.select(F.col("source_no").alias("_s"), F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "all")
    same = (F.col("source_no") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("h").eqNullSafe(F.col("_h"))
    each = copies.join(s, same, "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    upto = lambda k: F.expr(f"(coalesce(all, 0) * {k}) div copies")
    return each.select("doc_id", "size", "source_size", "target", (upto("copy") - upto("(copy - 1)")).alias("taken"))


def mixed_texts(docs: DataFrame, mix: Mixture | None = None) -> DataFrame:
    """The mix itself, a row for each piece of a document in each slot: ``shard, slot,
    first, past`` and the columns of ``docs``, ``text`` being the piece's words joined by
    one space.

    ``docs`` has ``doc_id, text, source`` and any others; columns called like the new ones
    are replaced.  Rows with the same doc_id, text and source give their pieces in the
    first one's name.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot", "first", "past", "size", "h")]
    docs = whole_texts(docs).select(*own)
    # Words are counted once; from here on texts are only read to be cut.
    known = written(sized(docs.select("doc_id", "text", "source")).drop("text"), "sizes")
    mix = mix or mixture(known)
    spans = taken_spans(known, mix).groupBy("source_no", "doc_id", "h").agg(F.collect_list(F.struct("shard", "slot", "first", "past")).alias("_spans"))
    s = spans.select(F.col("source_no").alias("_s"), F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "_spans")
    rows = numbered(docs.withColumn("h", F.xxhash64("text")), mix)
    # Only where an id, text and source are repeated is there anything to collapse.
    if not known.where("size > 0").groupBy("doc_id", "h", "source").count().where("count > 1").isEmpty():
        rows = rows.repartition("doc_id", "h").dropDuplicates(["doc_id", "h", "source_no"])
    joined = rows.join(s, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")) & (F.col("source_no") == F.col("_s")))
    kept = [f for f in docs.schema if f.name != "text"]
    numbers = ("shard", "slot", "first", "past")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                lists = part.column("_spans")
                many, flat = lists.value_lengths().to_numpy(), lists.flatten()
                first, past = flat.field("first").to_numpy(), flat.field("past").to_numpy()
                found, at = [], 0
                for text, n in zip(part.column("text"), many.tolist()):
                    words = text.as_buffer().to_pybytes().split()
                    found += [b" ".join(words[a:b]) for a, b in zip(first[at:at + n].tolist(), past[at:at + n].tolist())]
                    at += n
                # The text and its list of spans are not taken: a row for each piece would hold them again.
                rows_of = pa.array(np.repeat(np.arange(part.num_rows), many))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name).take(rows_of) for f in kept), *(flat.field(n) for n in numbers), pa.array(found, pa.binary()).cast(pa.string())],
                    [*(f.name for f in kept), *numbers, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "shard long, slot long, first long, past long, text string"])
    return joined.select(*(f.name for f in kept), "text", "_spans").mapInArrow(tidied(cut), schema).select("shard", "slot", "first", "past", *own)
