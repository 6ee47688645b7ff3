"""Byte-level BPE over Arrow batches: ids with their places in the text, and back to bytes."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from cellfold.llm.common import tidied, whole_texts

#: Longest piece of a text that is encoded at once, and rows handed on at once.
PIECE, ROWS = 1 << 18, 64

#: A place where every match ends: what follows is one space and then a letter or digit.
SAFE = re.compile(r"(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")


@dataclass(frozen=True)
class Vocabulary:
    """``ranks`` as pairs of token bytes and id; ``pattern`` cuts a text before merging."""

    path: str
    pattern: str

    def ranks(self) -> dict[bytes, int]:
        with open(self.path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def multilingual() -> Vocabulary:
    return Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a vocabulary of text."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes ``token``, merging the lowest rank first."""
    parts, limit = [token[k:k + 1] for k in range(len(token))], ranks[token]
    while len(parts) > 2:
        k = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], limit))
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return parts[0], parts[1]


@functools.lru_cache(maxsize=4)
def tokenizer_text(vocabulary: Vocabulary) -> str:
    """The tokenizer as JSON, made on the driver and sent to the tasks."""
    ranks, shown = vocabulary.ranks(), byte_characters()
    word = lambda token: "".join(shown[b] for b in token)
    merges = [tuple(map(word, halves(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    made = Tokenizer(models.BPE({word(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(vocabulary.pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return made.to_str()


def tokenizer(text: str) -> Tokenizer:
    """Made anew by each task, so that an idle worker doesn't keep it."""
    return Tokenizer.from_str(text)


@functools.lru_cache(maxsize=4)
def byte_table(text: str) -> list[bytes]:
    """The bytes of each id, by the byte-to-character table read backwards."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = json.loads(text)["model"]["vocab"]
    table = [b""] * (max(vocabulary.values()) + 1)
    for word, number in vocabulary.items():
        table[number] = bytes(back[c] for c in word)
    return table


def joined_bytes(ids: np.ndarray, table: list[bytes]) -> bytes:
    # Plain numbers are looked up several times faster than array elements.
    return b"".join(map(table.__getitem__, ids.tolist()))


def pieces(text: str, most: int = PIECE) -> Iterator[tuple[int, str]]:
    """``text`` in pieces of about ``most`` characters, cut only where no match can span."""
    start = 0
    while len(text) - start > most and (cut := SAFE.search(text, start + most)):
        yield start, text[start:cut.start()]
        start = cut.start()
    if start < len(text):
        yield start, text[start:]


class Encoder:
    """Encodes texts match by match: a match is encoded once and then looked up.

    What is kept is bounded: about ``most`` matches, none longer than ``LONGEST``; it starts
    anew when full.
    """

    LONGEST = 48

    def __init__(self, made: Tokenizer, pattern: str, offsets: bool, most: int = 100_000):
        self.made, self.offsets, self.most = made, offsets, most
        self.find = regex.compile(pattern).findall
        self.ids: dict[str, tuple[int, ...]] = {}
        self.places: dict[str, list[tuple[int, int]]] = {}

    def _learn(self, matches: list[str]) -> None:
        encode = self.made.encode_batch if self.offsets else self.made.encode_batch_fast
        for match, found in zip(matches, encode(matches, add_special_tokens=False)):
            self.ids[match] = tuple(found.ids)
            if self.offsets:
                self.places[match] = found.offsets

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and the past-the-last character of each one's text."""
        ids, places = [], []
        for start, piece in pieces(text):
            if len(self.ids) > self.most:
                self.ids, self.places = {}, {}
            matches = self.find(piece)
            unknown = [m for m in set(matches) if m not in self.ids]
            if unknown:
                self._learn(unknown)
            ids.append(np.array(list(chain.from_iterable(map(self.ids.__getitem__, matches))), np.int32))
            if self.offsets:
                begins = start + np.cumsum([0, *map(len, matches)])[:-1]
                own = np.array(list(chain.from_iterable(map(self.places.__getitem__, matches))), np.int64).reshape(-1, 2)
                places.append(own + np.repeat(begins, [len(self.ids[m]) for m in matches])[:, None])
            for match in unknown:
                if len(match) > self.LONGEST:
                    del self.ids[match]
                    self.places.pop(match, None)
        join = lambda parts, empty: np.concatenate(parts) if parts else empty
        places = join(places, np.zeros((0, 2), np.int64))
        return join(ids, np.zeros(0, np.int32)), places[:, 0], places[:, 1]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def encode(docs: DataFrame, vocabulary: Vocabulary, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids ARRAY<INT>`` for ``text``, which is dropped; with ``offsets`` also
    ``starts, ends ARRAY<BIGINT>``, places in characters, and with ``decoded`` also what
    the ids decode to, BINARY.

    Each match of the vocabulary's pattern is encoded by itself, special tokens are
    ordinary text.  A character that is split over several tokens is the place of each of
    them.  Null is encoded as the empty text: no ids.  Columns named like the new ones
    are replaced.
    """
    names = ["ids", "starts", "ends"] if offsets else ["ids"]
    last = ["decoded"] if decoded else []
    kept = [c for c in docs.columns if c not in (*names, *last, "text")]
    sent, pattern = docs.sparkSession.sparkContext.broadcast(tokenizer_text(vocabulary)), vocabulary.pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoded, table = Encoder(tokenizer(sent.value), pattern, offsets), byte_table(sent.value) if decoded else None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                found = [encoded(t or "") for t in rows.column("text").to_pylist()]
                lists = [_lists([f[k] for f in found], (pa.int32(), pa.int64(), pa.int64())[k]) for k in range(len(names))]
                back = [pa.array([joined_bytes(f[0], table) for f in found], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *lists, *back], [*kept, *names, *last])

    kinds = {"ids": "array<int>", "starts": "array<bigint>", "ends": "array<bigint>"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), *(f"{n} {kinds[n]}" for n in names), *(f"{n} binary" for n in last)])
    return whole_texts(docs).select(*kept, "text").mapInArrow(tidied(run), schema)


def decode(ids: str | Column, spark, vocabulary: Vocabulary) -> Column:
    """The bytes the ids stand for, BINARY: a token that holds part of a character adds its
    bytes, which the next one completes.  Null stays null."""
    sent = spark.sparkContext.broadcast(tokenizer_text(vocabulary))

    @F.pandas_udf("binary")
    def joined(lists: pd.Series) -> pd.Series:
        table = byte_table(sent.value)
        return lists.map(lambda x: None if x is None else joined_bytes(x, table))

    return joined(ids)


@F.pandas_udf(StringType())
def ids_sha256(lists: pd.Series) -> pd.Series:
    """SHA-256 of the ids as little-endian unsigned 32-bit numbers."""
    return lists.map(lambda x: hashlib.sha256(np.asarray(x, "<u4").tobytes()).hexdigest())


def digests(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """What identifies an encoding: the number of ids, their digest, that of the decoded bytes."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256("ids").alias("ids_sha256"),
        F.sha2(decode("ids", encoded.sparkSession, vocabulary), 256).alias("decoded_sha256"))
