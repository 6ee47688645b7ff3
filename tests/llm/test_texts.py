"""Mixing, line dedup, encoding, language and SimHash against plain Python on small tables."""

import math
import random
import re

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from cellfold.llm import encoding, langid, lines, mixing, queries, simhash
from cellfold.llm.common import components, word_count

DOCS = "doc_id long, text string, lang string, source string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows."""
    rows = [(1, "a b c", "en", "s1"), (2, None, "en", "s1"), (3, "", None, "s2"), (4, " \n\t ", "en", None), (None, "x y", "de", None),
            (5, "word " * 30_000, "en", "s2"), (6, "same row", "fr", "s3"), (6, "same row", "fr", "s3"), (7, "é ß", "fr", "s3")]
    return frame(spark, rows)


# --- mixing --------------------------------------------------------------------


def test_word_count(spark, odd):
    for row in odd.select("text", word_count("text").alias("n")).collect():
        assert row.n == len(re.findall(r"[^\x20\x09-\x0D]+", row.text or ""))


def test_targets():
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.choice([0, 3, 100, 5000, rng.randint(1, 10**6)]) for _ in range(rng.randint(1, 9))]
        weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
        found = mixing.targets(sizes, weights)
        assert math.isclose(sum(found), 1.5 * sum(sizes), abs_tol=1e-6)
        assert all(t <= 2 * s + 1e-6 for t, s in zip(found, sizes))
        free = [t / w for t, w, s in zip(found, weights, sizes) if t < 2 * s - 1e-6]
        assert not free or max(free) - min(free) < 1e-6 * max(free)  # by weight where not stopped
        assert all(not free or t / w <= max(free) + 1e-6 for t, w in zip(found, weights))


def test_permuted():
    for size in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(size), size, 1, 2, 3)) == list(range(size))
    assert list(mixing.permuted(np.arange(1000), 1000, 1, 2, 3)) != list(mixing.permuted(np.arange(1000), 1000, 1, 2, 4))


def test_shard_counts():
    totals = np.array([1000, 0, 37, 563])
    found = [mixing.shard_counts(totals, 16, k, 100, (5, 0)) for k in range(16)]
    counts = np.array([c for c, _ in found])
    assert (counts.sum(axis=0) == totals).all() and (counts.sum(axis=1) == 100).all()
    assert (np.cumsum(counts, axis=0)[:-1] == np.array([b for _, b in found])[1:]).all()


def test_mix(spark, odd):
    report = mixing.mix_report(odd).collect()
    assert len(report) == 9
    by = {}
    for r in report:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (size, target), taken in by.items():
        assert abs(sum(taken) - target) <= mixing.BLOCK
    assert sorted(map(str, report)) == sorted(map(str, mixing.mix_report(odd.repartition(5)).collect()))
    # The texts of the mix are the words the report counts, and a slot is a block.
    clash = odd.withColumn("shard", F.lit("x")).withColumn("first", F.lit(1))
    pieces = mixing.mixed_texts(clash).collect()
    words = sum(len(p.text.split(" ")) for p in pieces)
    assert words == sum(r["taken"] for r in report)
    sizes = {}
    for p in pieces:
        sizes[p.shard, p.slot] = sizes.get((p.shard, p.slot), 0) + p.past - p.first
    assert max(sizes.values()) <= mixing.BLOCK


def test_mix_of_nothing(spark):
    assert mixing.mix_report(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mixed_texts(frame(spark, [(1, None, "en", "s")])).count() == 0


def test_trees(spark, monkeypatch):
    """Many trees of draws give the same totals as one."""
    mix = mixing.Mixture(("a", "b"), (64 * 500, 64 * 30), (64 * 700.0, 64 * 60.0), (1, 1), 64, 3)
    monkeypatch.setattr(mixing, "TREE", 100)
    rows = mixing.draw_slots(spark, mix, 16).collect()
    taken = {}
    for r in rows:
        taken[r.source_no, r.block] = taken.get((r.source_no, r.block), 0) + 1
    assert sum(v for (s, _), v in taken.items() if s == 0) == 700 and max(taken.values()) == 2
    assert all(taken[1, k] == 2 for k in range(30))


# --- lines ---------------------------------------------------------------------


def one_word_apart(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute_lines(rows):
    listed = [(doc, no, line, line.encode().split()) for doc, text in rows if text is not None for no, line in enumerate(text.split("\n"))]
    out = {}
    for doc, no, line, words in listed:
        gone = False
        if len(words) >= lines.SHORT:
            firsts = {}
            for d, n, _, w in sorted(listed, key=lambda r: r[:2]):
                firsts.setdefault(tuple(w), (d, n))
            gone = firsts[tuple(words)] < (doc, no)
            if len(words) >= lines.LONG:
                mine = firsts[tuple(words)]
                gone |= any(at < mine and len(w) >= lines.LONG and one_word_apart(list(w), words) for w, at in firsts.items())
        if not gone:
            out.setdefault(doc, []).append(line)
    return {doc: (None if text is None else "\n".join(out.get(doc, []))) for doc, text in rows}


def test_lines(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (1, 2, 3, 4, 9, 10, 11, 12, 12, 12, 30)]
    rows = []
    for doc in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(words))
                words = rng.choice([words[:k] + words[k + 1:], [*words[:k], rng.choice("abz"), *words[k:]], [*words[:k], "q", *words[k + 1:]]]) or ["a"]
            own.append(rng.choice([" ", "  "]).join(words))
        rows.append((doc, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n")]
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows)
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_kept == (0 if r.text is None else len(want[k].split("\n")) if want[k] or r.n_kept else 0) for k, r in got.items())


def test_lines_odd(spark, odd):
    got = lines.dedup_lines(odd.withColumn("n_lines", F.lit("clash"))).collect()
    assert len(got) == 8  # the repeated row once
    assert {(r.doc_id, r.source): r.n_lines for r in got}[2, "s1"] == 0
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_halves_meet():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(10, 14))]
        k = rng.randrange(len(a))
        b = rng.choice([a[:k] + a[k + 1:], [*a[:k], b"z", *a[k:]], [*a[:k], b"z", *a[k + 1:]]])
        assert set(lines.halves(a)) & set(lines.halves(b))
        if len(b) >= lines.LONG and a != b:
            shared = set(lines.halves(a)) & set(lines.halves(b))
            side = [any(h % 2 == s for h in shared) for s in (0, 1)]
            keys = [{(v, w, p) for v, w, p in zip(*lines.neighbourhood(x, *side))} for x in (a, b)]
            whole = [{(v, w) for v, w, p in x if p < 0} for x in keys]
            part = [{(v, w) for v, w, p in x if p >= 0} for x in keys]
            assert keys[0] & keys[1] or whole[0] & part[1] or whole[1] & part[0]


# --- encoding ------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    v = encoding.multilingual()
    return tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks(), special_tokens={})


def test_encode_round_trip(spark, reference, odd):
    rng = random.Random(2)
    pool = [" ", "\n", "\t", "ab", "B", "é", "'s", "　", "\u0085", "$", "ß", "日本", "😀", "\x00", "²", "<|endoftext|>", "9"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 20))) for _ in range(500)] + ["x" * 5000, None, "", "a b " * 5000]
    docs = frame(spark, [(k, t, None, "clash") for k, t in enumerate(texts)]).withColumnRenamed("source", "ids")
    v = encoding.multilingual()
    rows = encoding.encode(docs, v, offsets=True).withColumn("back", encoding.decode("ids", spark, v)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert list(r.ids) == reference.encode_ordinary(text) and bytes(r.back) == text.encode()
        assert len(r.starts) == len(r.ids) == len(r.ends)
        assert all(0 <= a < b <= len(text) for a, b in zip(r.starts, r.ends))
        covered = {k for a, b in zip(r.starts, r.ends) for k in range(a, b)}
        assert covered == set(range(len(text)))
    assert encoding.digests(encoding.encode(odd, v), v).count() == 9
    assert encoding.encode(spark.createDataFrame([], DOCS), v).count() == 0


def test_pieces(reference):
    text = "some words, 12 of them.  And  more\n text " * 40
    parts = list(encoding.pieces(text, 50))
    assert len(parts) > 10 and "".join(p for _, p in parts) == text
    assert [i for _, p in parts for i in reference.encode_ordinary(p)] == reference.encode_ordinary(text)
    assert list(encoding.pieces("x" * 99, 10)) == [(0, "x" * 99)]


def test_encoder_forgets(reference):
    v = encoding.multilingual()
    made = encoding.tokenizer(encoding.tokenizer_text(v))
    small = encoding.Encoder(made, v.pattern, True, most=5)
    for text in ("one two three four", "five six " + "y" * 100, "one two seven eight nine ten"):
        assert list(small(text)[0]) == reference.encode_ordinary(text)
    assert len(small.ids) < 20 and all(len(m) <= small.LONGEST for m in small.ids)


# --- language ------------------------------------------------------------------


def test_language(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = langid.predict(docs, langid.fit(docs, texts=60))
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.9
    assert found.where("score < 0 OR score > 1").count() == 0
    assert found.count() == docs.count()


def test_language_odd(spark, odd, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    net = langid.fit(docs, texts=30)
    got = {(r.doc_id, r.text): r for r in langid.predict(odd.withColumn("score", F.lit("clash")), net).collect()}
    assert got[2, None].lang_pred == got[3, ""].lang_pred == got[4, " \n\t "].lang_pred == "und"
    assert got[None, "x y"].held_out is False and got[None, "x y"].lang_pred in net.languages
    none = langid.fit(docs.where("lang IS NULL"))
    assert none is None and {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.predict(spark.createDataFrame([], DOCS), net).count() == 0


def test_tables_are_the_filters():
    """Looking rows up gives what the convolution gives."""
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    net = langid.train(rng.integers(97, 100, (40, langid.WINDOW)).astype(np.uint8), rng.integers(0, 2, 40), ["a", "b"], rounds=5)
    pooled = []
    for w, kernel in net.filters.items():
        seen = net.bytes_[windows]
        response = sum(seen[:, o:langid.WINDOW - w + 1 + o] @ kernel[o] for o in range(w))
        pooled.append(np.maximum(response.max(axis=1) + net.bias[w], 0))
    want = langid.softmax(np.concatenate(pooled, axis=1) @ net.out + net.out_bias)
    assert np.allclose(langid.probabilities(net, net.tables(), windows), want, atol=1e-4)


# --- SimHash -------------------------------------------------------------------


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for text in (None, "", " \n", "One", "one TWO", "A b C d É é", "to be or not to be " * 50, "x" * 9000):
        assert simhash.simhash(text) % (1 << 64) == plain_simhash(text)


def brute_components(values, bits=3):
    left, out = set(values), {}
    while left:
        group, front = set(), [left.pop()]
        while front:
            x = front.pop()
            group.add(x)
            near = [y for y in left if (x ^ y).bit_count() <= bits]
            left -= set(near)
            front += near
        out |= {x: group for x in group}
    return out


@pytest.mark.parametrize("chunk", [4, 1024])
def test_near_links(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(300):
        values.append(rng.choice(values) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    assert all((r.a ^ r.b) % (1 << 64) for r in links.collect())
    label = {r.node: r.label for r in components(links).collect()}
    want = brute_components([v % (1 << 64) for v in signed])
    for v in signed:
        group = want[v % (1 << 64)]
        assert label.get(v, v) == min(x - (1 << 64) if x >> 63 else x for x in group)


def test_groups_and_one_of_each(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    marks = {t: plain_simhash(t) for _, t in rows}
    want = brute_components(marks.values())
    got = simhash.simhash_groups(odd.select("doc_id", "text", F.lit("clash").alias("component_id"), F.col("source"))).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = [i for i, t in rows if marks[t] in want[r.fp % (1 << 64)] and i is not None]
        assert r.component_id == (min(ids) if ids else None)
    kept = simhash.one_of_each(odd).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(x) for x in {r.doc_id for r in got if r.doc_id == r.component_id})
    assert simhash.one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_groups_without_an_id(spark):
    """Each group whose documents all have no id keeps one of them; so does an id with unrelated or near texts."""
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    alone, story, twice, near = [words(40) for _ in range(9)], words(300), words(40), words(400)
    copy = f"{near} more"
    assert 0 < (plain_simhash(near) ^ plain_simhash(copy)).bit_count() <= 3
    rows = [(None, t) for t in [*alone, alone[0], story, story, near, copy]] + [(7, story), (8, twice), (8, near[::-1])]
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(frame(spark, rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([*((None, t) for t in alone), (7, story), (8, twice), (8, near[::-1]),
                                            next((None, t) for t in (near, copy) if (None, t) in kept)], key=str)


def test_components_of_a_chain(spark):
    chain = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 1500).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    found = {r.node: r.label for r in components(chain.union(star)).collect()}
    assert all(found[k] == 0 for k in range(201)) and all(found[k] == 1000 for k in range(1000, 1500))
    assert components(chain.where("a < 0")).count() == 0


# --- the queries ----------------------------------------------------------------


def test_names():
    assert [re.match(r"op(\d+)_", n).group(1) for n in sorted(queries.QUERIES, key=lambda n: int(re.match(r"op(\d+)", n).group(1)))] == [str(k) for k in range(1, 14)]
