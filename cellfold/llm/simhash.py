"""SimHash near-duplicates over whole texts, with tables of distances to pivots.

Two fingerprints that differ in at most ``bits`` bits also have distances to any third
one that differ by at most ``bits``.  So every fingerprint carries its Hamming distances
to many reference fingerprints, pairs whose coordinates differ by more are discarded
without being compared, and only survivors are verified.

What is compared at all: cut into ``bits + 2`` blocks, two such fingerprints agree in at
least two whole blocks, so fingerprints meet under each pair of their blocks.  That
loses nothing and keeps the work far from all pairs.  A key with very many fingerprints
is dealt into chunks and every two chunks meet in a task of their own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cellfold.llm.cells import each_cell
from cellfold.llm.common import components, tidied, tidy, whole_texts
from cellfold.runtime import written

PIVOTS = 32
#: Fingerprints of one key that a task compares at once, per side.
CHUNK = 1024


def references(count: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(64).integers(-(2**63), 2**63 - 1, count, dtype=np.int64)


def simhash(text: str | None, size: int = 3) -> int:
    """The fingerprint, as a signed 64-bit number; zero without a word."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k:k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    found = texts.map(simhash).astype("int64")
    tidy()
    return found


def block_keys(value: Column, bits: int) -> Column:
    """The keys under which a fingerprint is compared: each two of its blocks."""
    edges = [64 * k // (bits + 2) for k in range(bits + 3)]
    blocks = [F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) for low, high in zip(edges, edges[1:])]
    return F.array(*[
        F.lit(k << 32).bitwiseOR(F.shiftleft(blocks[i], 16)).bitwiseOR(blocks[j])
        for k, (i, j) in enumerate(combinations(range(bits + 2), 2))
    ])


def linked(prints: np.ndarray, tables: np.ndarray, bits: int) -> np.ndarray:
    """For each fingerprint the first one of its component in this cell."""
    n = len(prints)
    # Two coordinates at once for all pairs, the others for what is left of them.
    near = np.abs(tables[:, None, 0] - tables[None, :, 0]) <= bits
    near &= np.abs(tables[:, None, 1] - tables[None, :, 1]) <= bits
    left, right = np.nonzero(np.triu(near, 1))
    for k in range(2, tables.shape[1]):
        keep = np.abs(tables[left, k] - tables[right, k]) <= bits
        left, right = left[keep], right[keep]
    keep = np.bitwise_count(prints[left] ^ prints[right]) <= bits
    met = np.zeros((n, n), bool)
    met[left[keep], right[keep]] = met[right[keep], left[keep]] = True
    root = np.full(n, -1)
    for first in range(n):
        front = np.array([first]) if root[first] < 0 else []
        while len(front):
            root[front] = first
            front = np.nonzero(met[front].any(axis=0) & (root < 0))[0]
    return root


def links_of_cell(cell: pd.DataFrame, bits: int) -> pd.DataFrame | None:
    """A spanning star for each component of a cell."""
    if len(cell) < 2:
        return None
    prints = cell["fp"].to_numpy(np.int64)
    tables = np.frombuffer(b"".join(cell["table"]), np.int8).reshape(len(cell), -1).astype(np.int16)
    root = prints[linked(prints.view(np.uint64), tables, bits)]
    away = root != prints
    return pd.DataFrame({"a": prints[away], "b": root[away]})


def near_links(prints: DataFrame, bits: int = 3, pivots: int = PIVOTS) -> DataFrame:
    """``a, b``: links of different values of ``fp`` within ``bits`` bits, enough of them
    that whatever is connected stays so."""
    keyed = prints.select("fp", F.explode(block_keys(F.col("fp"), bits)).alias("key"))
    counts = written(keyed.groupBy("key").count().where("count > 1"), "keys")
    chunks = F.ceil(F.col("count") / CHUNK)
    met = keyed.hint("merge").join(counts, "key").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    table = F.concat(*[F.unhex(F.lpad(F.hex(F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(r))))), 2, "0")) for r in references(pivots)])
    cells = met.withColumn("other", other).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp").withColumn("table", table)
    keys = ["key", "low", "high"]
    cells = cells.repartition(*keys).sortWithinPartitions(*keys)
    found = cells.mapInPandas(tidied(lambda frames: each_cell(frames, keys, lambda cell: links_of_cell(cell, bits))), "a long, b long")
    return found.distinct()


def labelled(docs: DataFrame, bits: int) -> DataFrame:
    """``simhash_groups`` with the component's smallest fingerprint as ``_label``: a name
    that components without a doc_id have too."""
    kept = [c for c in docs.columns if c not in ("text", "fp", "component_id")]
    marked = written(whole_texts(docs).select(*kept, fingerprint("text").alias("fp")), "prints")
    prints = written(marked.groupBy("fp").agg(F.min("doc_id").alias("_first")), "values")
    found = components(near_links(prints, bits)).withColumnRenamed("node", "fp")
    named = written(prints.join(found, "fp", "left").select("fp", "_first", F.coalesce("label", "fp").alias("_label")), "groups")
    first = written(named.groupBy("_label").agg(F.min("_first").alias("component_id")), "firsts")
    of = written(named.join(first, "_label").select("fp", "component_id", "_label"), "members")
    return marked.join(of, "fp").select(*kept, "fp", "component_id", "_label")


def simhash_groups(docs: DataFrame, bits: int = 3) -> DataFrame:
    """``docs`` (``doc_id, text`` and any others) with ``fp, component_id`` for ``text``.

    Component: everything reachable over fingerprints at most ``bits`` bits apart; its id
    is the smallest doc_id.  Null and empty texts have fingerprint zero and link like any
    other.  Repeated rows stay; a null doc_id is linked but never names a component.
    Columns called ``fp`` or ``component_id`` are replaced.
    """
    return labelled(docs, bits).drop("_label")


def one_of_each(docs: DataFrame, bits: int = 3) -> DataFrame:
    """One row of each group of ``docs``: that of the smallest doc_id.

    A group whose documents all have no id keeps its smallest text hash.  Rows that repeat
    the kept id and text are one.
    """
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    groups = labelled(marked, bits)
    able = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = able.groupBy(F.col("doc_id").alias("_doc"), "_label").agg(F.min("_h").alias("_of"))
    kept = written(chosen.select("_doc", "_of"), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_of"))
    left = docs.join(kept, same, "left_semi")
    # Only where an id and text are repeated is there anything to collapse.
    repeated = groups.select("doc_id", "_h").join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_of"))).count() > kept.count()
    return left.withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).drop("_h") if repeated else left


def hex16(value: str) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
