"""Whitening, conversation repair and repeated strings against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellfold import runtime
from cellfold.llm import extraction, ivfpq, lines, queries, repair, suffixes, surrogates, whitening

# --- whitening ------------------------------------------------------------------


def brute_whitening(vectors, top):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:top], v[:, ::-1][:, :top]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, y @ v / np.sqrt(e), e / np.trace(y.T @ y / n)


def by_vector(rows, k):
    found = collections.defaultdict(lambda: [None] * k)
    for r in rows:
        found[r.vec_id][r.component - 1] = r
    return found


def check_whitening(rows, ids, vectors, top):
    n, deviation, whitened, explained = brute_whitening(vectors, top)
    k = whitened.shape[1]
    found = by_vector(rows, k)
    assert len(rows) == len(ids) * k and found.keys() == set(ids)
    got = np.array([[r.whitened for r in found[i]] for i in ids])
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - whitened * signs).max() < 1e-6
    for i, d in zip(ids, deviation):
        assert all((r.n, r.deviation) == (n, d) and r.identity_error < 1e-9 for r in found[i])
        assert np.allclose([r.explained for r in found[i]], explained, rtol=1e-9)


def test_whitening_table(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    got = queries.QUERIES["op11_whitening"](spark, data).collect()
    check_whitening(got, [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(40, 5)) @ np.diag([9, 3, 1, 0.1, 0.03])
    rows = [(k, v.tolist(), "clash") for k, v in enumerate(good)]
    bad = [(90, None, ""), (91, [], ""), (92, [1.0, 2.0], ""), (93, [None] * 5, ""), (94, [float("nan")] * 5, ""), (95, [float("inf")] + [0.0] * 4, "")]
    schema = "vec_id long, vector array<double>, component string"
    got = whitening.whiten(spark.createDataFrame(rows + bad, schema).repartition(3)).collect()
    check_whitening(got, range(40), good, 5)
    # A repeated row counts twice and comes back twice.
    twice = whitening.whiten(spark.createDataFrame([*rows, rows[0], (None, rows[1][1], "")], schema)).collect()
    assert len(twice) == 42 * 5 and twice[0].n == 42
    same = [(k, [1.0, 2.0], "") for k in range(3)]
    assert whitening.whiten(spark.createDataFrame(same, schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    # One direction varies: one component. Very large entries don't overflow.
    line = whitening.whiten(spark.createDataFrame([(k, [k * 1.0, 5.0], "") for k in range(4)], schema)).collect()
    assert len(line) == 4 and abs(line[0].explained - 1) < 1e-12
    huge = whitening.whiten(spark.createDataFrame([(k, [k * 1e300, k * 1e15, 1.0], "") for k in range(4)], schema)).collect()
    assert len(huge) >= 4 and all(np.isfinite(r.whitened) for r in huge)


def test_factor():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 12)) * np.logspace(0, -6, 12)
    v = a @ a.T
    factor = whitening.pivoted_cholesky(v)
    assert factor.shape[1] == 12 and np.allclose(factor @ factor.T, v, atol=1e-12)
    turned = whitening.rotated(factor)
    norms = np.sort((turned**2).sum(axis=0))[::-1]
    assert np.allclose(norms, np.linalg.svd(a)[1] ** 2, rtol=1e-9)


# --- conversations ---------------------------------------------------------------


def brute_repair(rows):
    """Every way there is, from the end backwards: (cost, audit, lines) per state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    keeps = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    wanted, names = (2, 2, 3, 2), {2: "user", 3: "assistant"}
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))

    def inserted(best):
        once = [min(best[q], (best[wanted[q]][0] + 5, "I" + best[wanted[q]][1], (f"{names[wanted[q]]}:", *best[wanted[q]][2]))) for q in range(4)]
        return [min(best[q], (once[wanted[q]][0] + 5, "I" + once[wanted[q]][1], (f"{names[wanted[q]]}:", *once[wanted[q]][2]))) for q in range(4)]

    none = (10**9, "", ())
    best = inserted([(0, "", ()), none, none, (0, "", ())])
    for (_, role, text), fault in zip(rows[::-1], faults[::-1]):
        new = []
        for q in range(4):
            ways = [(best[q][0] + 2, "D" + best[q][1], best[q][2])]
            if fault not in ("blank", "duplicate"):
                more, to = 5 * (fault == "truncated"), wanted[q]
                ways.append((best[to][0] + 1 + more, "R" + best[to][1], (f"{names[to]}:{text}", *best[to][2])))
                if role[:1] in keeps[q]:
                    to = keeps[q][role[0]]
                    ways.append((best[to][0] + more, "K" + best[to][1], (f"{role}:{text}", *best[to][2])))
            new.append(min(ways))
        best = inserted(new)
    cost, audit, lines = best[0]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("size, fan", [(64, 256), (3, 2)])
def test_repair(spark, monkeypatch, size, fan):
    """The second time every conversation is cut in blocks of three, and these in pairs."""
    monkeypatch.setattr(repair, "ROWS", size)
    monkeypatch.setattr(repair, "FAN", fan)
    rng = random.Random(7)
    convs = {}
    for conv in range(60):
        n = rng.choice([0, 1, 2, 5, 9, 30])
        convs[conv] = [(rng.choice([None, *range(n + 2)]) if rng.random() < 0.2 else k, rng.choice(["system", "user", "assistant", "tool", "", "user", "assistant"]),
                        rng.choice(["a.", "b!", "cut", " \n", "", "d?", "é. ", "long " * 50 + "."])) for k in range(n)]
    convs[None] = [(1, "user", "q?"), (2, "assistant", "a."), (2, "assistant", "a.")]
    rows = [(c, t, r, x, "clash") for c, each in convs.items() for t, r, x in each]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(3)
    named = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_report(df, named).collect()}
    assert got == {c: brute_repair(each) for c, each in convs.items()}


def test_repair_nulls(spark):
    rows = [(1, None, None, None), (1, 3, "user", None), (2, None, "user", "x."), (3, -(2**63), "user", "x."), (3, 2**63 - 1, "assistant", "y.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repair.repair_report(df, df).collect()}
    assert (got[1].blank, got[1].audit, got[1].gaps) == (2, "DD", 0)
    assert (got[2].audit, got[2].cost, got[2].gaps) == ("D", 2, 0)
    assert (got[3].audit, got[3].gaps) == ("KK", None)
    assert repair.repair_report(df.limit(0), df.limit(0)).count() == 0
    assert [tuple(r[c] for c in COLUMNS) for r in repair.repair_report(df.limit(0), df.where("conv_id = 2")).collect()] == [
        (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_prices():
    """When the auction is over no arc is cheaper than the prices say, and the path's are equal."""
    rng = random.Random(2)
    for _ in range(50):
        rows = "".join(rng.choice("sua?") + rng.choice("-xt-") for _ in range(rng.randint(0, 12)))
        repair.matrix(rows, rng.random() < 0.5)  # ends, though some states can't be reached
        arcs, prices = repair.arcs_of(rows, [0, repair.NONE, repair.NONE, 0], True)
        distance = repair.auction(arcs, prices, 0)
        assert all(prices[k] <= cost + prices[to] for k, out in enumerate(arcs) for _, cost, to in out)
        (letters, cost, _), = repair.traces(rows, [0, repair.NONE, repair.NONE, 0], True, (0,))
        assert cost == distance and sum(x != "I" for x in letters) == len(rows) // 2


# --- repeated strings --------------------------------------------------------------


def brute_repeats(texts, length):
    seen = collections.Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    for text in texts:
        covered = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if seen[text[p:p + length]] > 1:
                covered[p:p + length] = b"\1" * length
        kept = bytes(b for b, gone in zip(text, covered) if not gone)
        yield len(text), sum(covered), len([run for run in bytes(covered).split(b"\0") if run]), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length, chunk", [(200, 1 << 16), (20, 64), (7, 1 << 16)])
def test_repeats(spark, monkeypatch, length, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rng = random.Random(length)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9 * length))) for _ in range(12)]
    texts = []
    for _ in range(60):
        cuts = ((b := rng.choice(base), rng.randint(0, len(b) - 1)) for _ in range(rng.randint(0, 5)))
        texts.append("".join(b[k:k + rng.randint(0, 3 * length)] for b, k in cuts))
    texts += [None, "", "ab" * 3 * length, "x" * 5 * length, "y" * length, texts[0], texts[1], texts[1]]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    rows = [(i, t, "clash", [1]) for i, t in zip(ids, texts)] + [(None, texts[2], "", None), (None, "z" * (length + 1), "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, h array<int>").repartition(3)
    got = [tuple(r) for r in suffixes.digests(suffixes.without_repeats(df, length)).collect()]
    want = [(r[0], *w) for r, w in zip(rows, brute_repeats([(r[1] or "").encode() for r in rows], length))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffixes.without_repeats(df.limit(0), length).count() == 0


# --- surrogates and lines --------------------------------------------------------


def test_wide_rows_are_not_fetched(spark, monkeypatch):
    """Few rows with long lists or maps stay where they are."""
    wide = spark.range(4).select("id", F.sequence(F.lit(1), F.lit(100)).alias("list"))
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 1000)
    width = 8 * F.size("list")
    assert runtime.small_side(wide, width=width) is wide
    assert runtime.small_side(wide.limit(1), width=width).count() == 1
    seen, side = [], runtime.small_side
    monkeypatch.setattr(lines, "small_side", lambda df, **given: seen.append((df, found := side(df, **given))) or found)
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    line = " ".join("abcdefghijkl")
    lines.dedup_lines(spark.createDataFrame([(1, line), (2, f"{line} m")], "doc_id long, text string"))
    assert len(seen) == 1 and seen[0][0] is seen[0][1]


def test_surrogates_have_one_plan(spark):
    docs = spark.createDataFrame([(1, "Mr. John Smith, " + "a@b.cc " * 3), (2, None), (3, "Anna Smith")], "doc_id long, text string")
    plan = surrogates.replace(docs)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_texts_of_any_form_are_read(spark):
    """Long names, host names and runs of names end, as does a text of thousands of titles."""
    texts = ["Mr. " + "Ab" * 4000, "Mr. " + "Ab-" * 4000 + "Ab", "x@" + "a." * 20000 + "com", "Anna " * 5000 + "Miller", "Mr. " * 5000 + "Miller",
             "to x@a.b.co.uk. And", "x@" + "abc." * 100 + "com", "+1" + " (222)" * 5000, "1." * 20000]
    got = {r.doc_id: r for r in surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    assert len(got) == len(texts)
    for k in (0, 1, 3, 4, 5, 6):
        assert got[k].n_entities >= 1 and got[k].text != texts[k], k
    assert "Ab" not in got[0].text and "Ab" not in got[1].text and "Miller" not in got[3].text + got[4].text
    assert "x@a.b.co.uk" not in got[5].text and got[5].text.endswith(". And") and "abc." not in got[6].text


def test_surrogates_grow_until_there_is_room(spark, monkeypatch):
    """A space of two surnames for 40, one-letter addresses that fill theirs, and a whole 192.168 range."""
    monkeypatch.setitem(surrogates.SYLLABLES, "latin", ["bar"] * 8 + ["ben"] * 8)
    people = [("person", f"name{k}") for k in range(40)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    mail = [("email", f"{a}@{b}.org") for a in letters for b in letters]
    inside = [("ip", f"192.168.{a}.{b}") for a in range(256) for b in range(0, 256, 2)]
    entities = people + mail + inside
    got = surrogates.drawn_apart(spark.createDataFrame(entities, "kind string, value string"), "key").collect()
    assert len(got) == len(entities) == len({(r.kind, r.new) for r in got}) and not {r.new for r in got} & {v for _, v in entities}
    assert all(r.new.endswith(".org") for r in got if r.kind == "email") and all(r.new.count(".") == 3 for r in got if r.kind == "ip")


def test_given_names_are_permuted_by_the_key(spark):
    orders = {tuple(surrogates.keyed_order(surrogates.NAMES["latin", "f"], f"key {k}")) for k in range(20)}
    assert len(orders) == 20
    names = [n for each in surrogates.NAMES.values() for n in each]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.new for r in df.select("name", surrogates.given_name(F.col("name"), "key").alias("new")).collect()}
    assert all(a != b for a, b in got.items()) and sorted(got.values()) == sorted(names)
    for each in surrogates.NAMES.values():
        assert {got[n] for n in each} == set(each)


def test_lines_of_rows_without_ids_and_with_maps(spark):
    """Rows that share or lack an id are told apart by their texts; maps and clashing columns stay."""
    head = "one two three four"
    rows = [(None, f"{head}\nfirst text", {"k": 1}), (None, f"{head}\nsecond text", {"k": 2}), (None, f"{head}\nsecond text", {"k": 2}),
            (7, "same id other", {}), (7, "another three words\nsame id other", None), (8, None, {"a": 1}), (9, "", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_kept map<string, int>").withColumn("m", F.col("n_kept"))
    got = lines.dedup_lines(df).collect()
    assert len(got) == 6 and sum(head in (r.text or "") for r in got) == 1
    assert sum("same id other" in (r.text or "") for r in got if r.doc_id == 7) == 1
    assert {str(r.m) for r in got if r.doc_id is None} == {"{'k': 1}", "{'k': 2}"}


def test_word_distance():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 6))] for _ in range(2))
        table = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, table[0] = table[0], i
            for j, y in enumerate(b, 1):
                before, table[j] = table[j], min(table[j] + 1, table[j - 1] + 1, before + (x != y))
        assert lines.one_edit_apart(a, b) == (table[-1] == 1)


# --- pages and vectors --------------------------------------------------------------


def test_names_that_only_hold_a_word_of_furniture(spark):
    kept = ['<div class="content has-sidebar"><p>body</div>', '<div class="post related-social-theory"><p>body</div>', '<section id="notice-of-motion"><p>body</section>']
    left = ['<div class="site-footer">x</div><p>body', "<div id=comment-list>x</div><p>body", '<p>body<div class="wide ad">x</div>', '<p>body<div class="Related-Posts">x</div>']
    df = spark.createDataFrame([(k, "http://h/x", page) for k, page in enumerate(kept + left)], "page_id long, url string, html string")
    assert [r.text for r in extraction.extract(df).orderBy("page_id").collect()] == ["body"] * 7


def test_probes_by_products():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 16))
    index = ivfpq.Index(centres, np.zeros((4, 2, 4)), 0.4, 3.0)
    vectors = rng.normal(size=(50, 16))
    own, asked = index.probes(vectors)
    distance = np.linalg.norm(vectors[:, None] - centres[None], axis=2)
    assert (own == distance.argmin(axis=1)).all()
    between = np.linalg.norm(centres[own][:, None] - centres[None], axis=2)
    bound = 2 * 0.4 * between * (3 / 4) + 1e-9
    apart = distance**2 - (distance**2).min(axis=1)[:, None] - bound
    assert ((apart <= 0) == asked)[np.abs(apart) > 1e-6].all() and asked[np.arange(50), own].all()
