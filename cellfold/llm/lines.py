"""Line deduplication within an edit bound, by a join of deletion neighbourhoods.

A line is its words.  Two lines are the same if they are equal or one word inserted,
deleted or replaced makes one of the other.  Every line of at least ``LONG`` words emits
itself and every form with one word deleted as a hashed key; lines meet where keys are
equal:

* both deleted a word at the same place: one word was replaced;
* one deleted a word, the other is whole: one word was inserted.

The place and a second hash, by another base, are part of the key.  A line that meets an
earlier one is compared with it word by word, and goes if the edit distance is one; the
earliest line of a key is enough for that, so no other pairs are listed.

Lines without a possible partner emit nothing: at distance one, one half of a line
(for the shorter line's length) is equal in both.  Halves are hashed and counted first,
and only lines that share one emit deletions, and only in the other half.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from cellfold.llm.common import discard, tidied, whole_texts
from cellfold.runtime import small_side, written

#: Lines of fewer words are never dropped; lines of fewer than LONG only as exact repeats.
SHORT, LONG = 3, 10
#: Rows a task hands on at once.
ROWS = 20_000

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def halves(words: list[bytes]) -> list[int]:
    """Hashes of the first and the last half, as a line of its own length and as one of a
    word less; two of the four are always the same words.  Even hashes are of first
    halves, odd ones of last halves."""
    n, found = len(words), set()
    for length in (n, n - 1):
        cut = length // 2
        found.add(xxhash.xxh64_intdigest(b" ".join(words[:cut])) & ~1)
        found.add(xxhash.xxh64_intdigest(b" ".join(words[n - length + cut:])) | 1)
    return [signed(h) for h in found]


def line_hash(words: list[bytes]) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(b" ".join(words))
    return signed(digest >> 64), signed(digest & (1 << 64) - 1)


def read_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "h", "no", "a", "b", "keys"]
    for frame in frames:
        rows = []
        for doc, h, text in zip(frame["doc_id"], frame["h"], frame["text"]):
            for no, line in enumerate(text.encode().split(b"\n")):
                words = line.split()
                if len(words) >= SHORT:
                    rows.append((doc, h, no, *line_hash(words), halves(words) if len(words) >= LONG else []))
            if len(rows) >= ROWS:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


@functools.lru_cache(maxsize=64)
def powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(count - 1, base, np.uint64)]))


def neighbourhood(words: list[bytes], first: bool, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of the whole line (place -1) and of it without each word, and the places.

    ``first`` and ``last`` say which half is shared with another line: the word to delete
    is in the other.
    """
    n, mask = len(words), (1 << 64) - 1
    own = np.array([xxhash.xxh64_intdigest(w, 9) for w in words], np.uint64)
    places = np.arange(n)
    places = places[((places >= (n - 1) // 2) & first) | ((places <= n // 2) & last)]
    hashes = []
    for base, salt in zip(BASES, (0, 0xA5A5A5A5)):
        terms = (own ^ np.uint64(salt)) * powers(base, 1 << (n - 1).bit_length())[:n]
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        total = before[-1]
        without = before[places] + (total - before[places + 1]) * np.uint64(pow(base, -1, mask + 1))
        hashes.append(np.concatenate([[total], without]).astype(np.uint64).view(np.int64))
    return hashes[0], hashes[1], np.concatenate([[-1], places]).astype(np.int32)


def read_neighbourhoods(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def joined(parts):
        v, w, place, words, *one = zip(*parts)
        lengths = list(map(len, v))
        doc, h, no, a = (pd.Series(x, dtype="Int64").repeat(lengths).array for x in one)
        line = np.full(sum(lengths), None, object)
        line[np.cumsum(lengths) - lengths] = [b" ".join(x) for x in words]  # once, with the whole line's hash
        return pd.DataFrame({"v": np.concatenate(v), "w": np.concatenate(w), "place": np.concatenate(place), "doc_id": doc, "h": h, "no": no, "a": a, "line": line})

    for frame in frames:
        parts, count = [], 0
        for doc, h, text, firsts, lasts in zip(frame["doc_id"], frame["h"], frame["text"], frame["firsts"], frame["lasts"]):
            firsts, lasts, seen = set(firsts), set(lasts), set()
            for no, line in enumerate(text.encode().split(b"\n")):
                words = line.split()
                if len(words) < LONG:
                    continue
                a = line_hash(words)[0]
                if (a in firsts or a in lasts) and a not in seen:
                    seen.add(a)
                    parts.append((*neighbourhood(words, a in firsts, a in lasts), words, None if pd.isna(doc) else int(doc), h, no, a))
                    count += len(words) + 1
            if count >= ROWS:
                yield joined(parts)
                parts, count = [], 0
        if parts:
            yield joined(parts)


def one_edit_apart(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the word edit distance is one: beside what both begin and end with, one
    has a single word, the other one or none."""
    most, same = min(len(a), len(b)), 0
    while same < most and a[same] == b[same]:
        same += 1
    back = 0
    while back < most - same and a[-1 - back] == b[-1 - back]:
        back += 1
    return max(len(a), len(b)) - same - back == 1


@F.pandas_udf(BooleanType())
def near(ones: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([one_edit_apart(a.split(), b.split()) for a, b in zip(ones, others)], dtype=bool)


@F.pandas_udf(StringType())
def without_lines(texts: pd.Series, gone: pd.Series) -> pd.Series:
    def one(text, numbers):
        if text is None:
            return None
        numbers = set(numbers)
        return "\n".join(line for no, line in enumerate(text.split("\n")) if no not in numbers)

    return pd.Series([one(t, g) for t, g in zip(texts, gone)], dtype=object)


def earliest_met(forms: DataFrame) -> DataFrame:
    """``a`` of the lines that meet an earlier one, from the keys of all neighbourhoods.
    Each is compared with the earliest it meets, word by word."""
    shared = written(forms.groupBy("v").count().where("count > 1").select("v"), "shared")
    met = written(forms.drop("line").join(shared, "v"), "meeting").withColumn("at", F.struct("doc_id", "h", "no", "a"))
    same_place = met.where("place >= 0").groupBy("v", "w", "place").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    replaced = met.join(written(same_place.drop("n"), "replaced"), ["v", "w", "place"]).where("at > first")
    both = met.groupBy("v", "w").agg(F.min(F.when(F.col("place") < 0, F.col("at"))).alias("whole"),
                                     F.min(F.when(F.col("place") >= 0, F.col("at"))).alias("part"))
    both = written(both.where("whole IS NOT NULL AND part IS NOT NULL"), "inserted")
    inserted = met.join(both, ["v", "w"]).withColumn("first", F.when(F.col("place") < 0, F.col("part")).otherwise(F.col("whole"))).where("at > first")
    pairs = replaced.select("a", F.col("first.a").alias("b")).union(inserted.select("a", F.col("first.a").alias("b"))).where("a <> b").distinct()
    said = forms.where("place < 0").select("a", "line")
    told = pairs.join(said, "a").join(said.select(F.col("a").alias("b"), F.col("line").alias("other")), "b")
    return told.where(near("line", "other")).select("a").distinct()


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """A hash of whole rows; maps, which have none, by what they read like."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in df.schema[c].dataType.simpleString() else F.col(c) for c in columns])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text`` and any others) without repeated lines, and with
    ``n_lines`` and ``n_kept``.

    Lines are cut at \\n.  Order is that of ``doc_id`` (null first), of a hash of the text
    where an id is missing or shared, and then of the lines in the text.  A repeated row
    appears once.  A null text stays null with 0 lines; a text that loses every line is
    empty.  Columns called ``n_lines`` or ``n_kept`` are replaced.
    """
    docs = whole_texts(docs).drop("n_lines", "n_kept")
    marked = docs.withColumn("h", F.xxhash64("text"))
    lines = written(marked.where("text IS NOT NULL").select("doc_id", "h", "text").mapInPandas(
        tidied(read_lines), "doc_id long, h long, no int, a long, b long, keys array<long>"), "lines")
    at = F.struct("doc_id", "h", "no")
    firsts = written(lines.groupBy("a", "b").agg(F.min(at).alias("first"), F.count("*").alias("n")), "firsts")

    # Lines that share a half with another: only where one stands first are its words read again.
    halves_ = lines.select("a", F.explode("keys").alias("key"))
    multi = written(halves_.groupBy("key").agg(F.min("a").alias("p"), F.max("a").alias("q")).where("p <> q").select("key"), "halves")
    side = F.col("key").bitwiseAND(F.lit(1))
    sides = halves_.join(multi, "key").groupBy("a").agg(F.max(side == 0).alias("f"), F.max(side == 1).alias("l"))
    asked = written(sides.join(firsts.select("a", "first.doc_id", "first.h"), "a").groupBy("doc_id", "h").agg(
        F.collect_set(F.when(F.col("f"), F.col("a"))).alias("firsts"),
        F.collect_set(F.when(F.col("l"), F.col("a"))).alias("lasts")).withColumnsRenamed({"doc_id": "_of", "h": "_h"}), "asked")
    listed = 8 * (F.size("firsts") + F.size("lasts"))
    same = F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("h") == F.col("_h"))
    forms = marked.where("text IS NOT NULL").select("doc_id", "h", "text").join(small_side(asked, width=listed), same).drop("_of", "_h")
    forms = written(forms.mapInPandas(
        tidied(read_neighbourhoods), "v long, w long, place int, doc_id long, h long, no int, a long, line binary"), "forms")

    gone = earliest_met(forms).withColumn("gone", F.lit(True))
    # A line that stands once and meets no earlier one stays, whatever it is.
    state = written(firsts.join(gone, "a", "left").where("n > 1 OR gone").drop("n"), "state")
    discard(firsts, multi, asked, forms)
    dropped = lines.select("doc_id", "h", "no", "a", "b").join(state, ["a", "b"]).where(F.col("gone") | (at != F.col("first")))
    dropped = dropped.groupBy(F.col("doc_id").alias("_of"), F.col("h").alias("_h")).agg(F.collect_set("no").alias("_gone"))

    # Whole texts are only moved to find equal rows where ids and texts are repeated at all.
    if not marked.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        marked = marked.withColumn("_row", row_hash(docs, docs.columns)).repartition("doc_id", "h").dropDuplicates(["doc_id", "h", "_row"]).drop("_row")
    found = marked.join(dropped, same, "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    cut = without_lines(F.when(F.col("_gone").isNotNull(), F.col("text")), "_gone")
    return found.select(
        *[F.when(F.col("_gone").isNotNull(), cut).otherwise(F.col("text")).alias("text") if c == "text" else c for c in docs.columns],
        n_lines.cast("long").alias("n_lines"),
        (n_lines - F.coalesce(F.size("_gone"), F.lit(0))).cast("long").alias("n_kept"))
