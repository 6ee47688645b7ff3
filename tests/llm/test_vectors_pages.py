"""Vectors, pages, toxicity and surrogates against brute force and planted cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellfold.llm import extraction, ivfpq, mtree, surrogates, toxicity

VECTORS = "vec_id long, vector array<double>, n_links string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    points = [c + rng.normal(size=16) * s for c in centres for s in (0, 0, 0.05, 0.2, 0.3, 0.45)]
    rows = [(k, [float(x) for x in p], "clash") for k, p in enumerate(points)]
    n = len(rows)
    rows += [(n, None, ""), (n + 1, [0.0] * 16, ""), (n + 2, [float("nan")] * 16, ""), (n + 3, [None] + [1.0] * 15, ""),
             (n + 4, [float("inf")] * 16, ""), (n + 5, [1.0, 2.0], ""), (n + 6, [], ""), (None, [1.0] * 16, "")]
    return rows, spark.createDataFrame(rows, VECTORS).repartition(3)


def test_near_vectors(vectors, monkeypatch):
    rows, df = vectors
    monkeypatch.setattr(ivfpq, "PER_LIST", 20)
    monkeypatch.setattr(ivfpq, "SIDE", 16)
    got = {r.vec_id: r for r in ivfpq.near_vectors(df, 0.9).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v)) for i, v, _ in rows if v and len(v) == 16 and i is not None and None not in v and np.isfinite(v).all() and any(v)]
    x = np.stack([v for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[near[k]].min() for k in range(len(x))])
    for k, (i, _) in enumerate(good):
        assert (got[i].n_links, got[i].component_id) == (near[k].sum() - 1, good[label[k]][0])
        assert got[i].kept == (i == got[i].component_id)
    for i in got.keys() - {i for i, _ in good}:
        assert got[i].n_links == 0 and got[i].component_id == i


def test_index_recall(spark, data):
    """Links found over the given vectors, with jittered copies, against brute force."""
    base = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    jitter = base.where("vec_id % 3 = 0").select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform(
        "vector", lambda x, k: x + 0.03 * F.sin(k * 12.9 + F.col("vec_id"))).alias("vector"))
    df = base.union(jitter)
    got = ivfpq.near_vectors(df, 0.9).toPandas().sort_values("vec_id")
    x = np.stack(df.toPandas().sort_values("vec_id")["vector"])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum() - len(x)
    assert want > 100 and want * 0.9 <= got["n_links"].sum() <= want


def test_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert ivfpq.near_vectors(empty).count() == 0 and mtree.top_products(empty).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0], "")], VECTORS)
    assert [tuple(r) for r in ivfpq.near_vectors(one).collect()] == [(20, 0, 20, True)]
    assert mtree.top_products(one).count() == 0


@pytest.mark.parametrize("part, page", [(4096, 128), (16, 4)])
def test_top_products(spark, vectors, part, page, monkeypatch):
    monkeypatch.setattr(mtree, "PART", part)
    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "ASKING", 3)
    rows, df = vectors
    rows = [*rows, (3, [9.0] * 16, "")]
    df = df.union(spark.createDataFrame([rows[-1]], VECTORS))
    by = {}
    for i, v, _ in rows:
        if v is not None and len(v) == 16 and i is not None and None not in v and np.isfinite(v).all():
            by[i] = min(by.get(i, [99e9]), [int(np.floor(64 * x)) for x in v])
    want = set()
    for q in by:
        if q % 20 == 0:
            best = sorted((-int(np.dot(by[q], by[x])), x) for x in by if x != q)[:20]
            want |= {(q, n, x, -s) for n, (s, x) in enumerate(best, 1)}
    assert {tuple(r) for r in mtree.top_products(df).collect()} == want


def test_bounds_save_distances():
    """The stored distances leave pages and entries unread."""
    rng = np.random.default_rng(6)
    points = np.rint(rng.normal(size=(2000, 4)) * 40 + rng.choice([-300, 0, 300], (2000, 4)))
    space = mtree.Space(int((points**2).sum(axis=1).max()), np.zeros((0, 0)))
    lifted, ids = space.lifted(points), np.arange(2000)
    made = mtree.pages_of(lifted, ids, 32)
    route = lifted[:1]
    tree = made | {"parent": np.linalg.norm(np.stack(made["route"]) - route, axis=1), "radius": np.array(made["radius"]),
                   "route2": [r @ r for r in made["route"]]}
    query, counted = np.append(points[7], 0.0), [0]
    best = mtree.search(query, 7, -np.inf, 10, space.square, tree, float(np.linalg.norm(query - route)), counted)
    want = sorted((-int(points[7] @ points[k]), k) for k in range(2000) if k != 7)[:10]
    assert [(-int(s), int(i)) for s, i in zip(best.scores, best.ids)] == want
    assert counted[0] < 1500


# --- pages ----------------------------------------------------------------------

PAGES = [
    ('<header><h1>Site</h1></header><main><h1>A &lt;b&gt;</h1><p>x<b>y</b> \n z<p>w<div class="user-comments">bad</div></main><div>tail</div>', "A <b>\nxy z\nw"),
    ("plain &amp; simple", "plain & simple"), (None, ""), ("", ""),
    ('<nav>m</nav><p>a<p>b<script>if(a<b){"</p>"}</script>c</p><ul class="menu"><li>m</ul>x<!-- <p>no -->y < z', "a\nbc\nxy < z"),
    ("<article><header><h2>T</h2></header><p>one<br>two</p><button>Buy</button><aside>s</aside><footer>f</footer><p>three &eacute;&#233;&#x20AC;</p>"
     "<form>q</form></article><p>after</p>", "T\none two\nthree éé€"),
    ("<div id='cookie-notice'>c</div><table><tr><td>1<td>2</table><div style='display: none'>h</div><div hidden>h</div><p role=navigation>n</p>", "1\n2"),
    ("<p>never closed <b>bold", "never closed bold"), ("<title>T</title><style>p{}</style><p>&am;&quot;</p", '&am;"'),
    ("<p>" + "long " * 50_000 + "</p>", ("long " * 50_000).strip()),
]


def test_pages(spark):
    rows = [(k, "http://Host.example/x", page, "clash") for k, (page, _) in enumerate(PAGES)] + [(None, None, "<p>q</p>", "")]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)).collect()
    texts = {r.page_id: r for r in got}
    for k, (page, want) in enumerate(PAGES):
        assert texts[k].text == want, page and page[:60]
        assert texts[k].n_chars == len(want)
    assert texts[None].text == "q"
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_furniture(spark):
    """What many pages of a host repeat outside articles goes; copied articles stay."""
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    banner, story = words(200), words(200)
    own = [words(60) for _ in range(12)]
    rows = [(k, f"http://a.example/{k}", f"<div>{banner}</div><div>{text}</div>") for k, text in enumerate(own)]
    rows += [(100 + k, f"http://b.example/{k}", f"<article><p>{story}</p><p>{k}</p></article>") for k in range(12)]
    rows += [(200, "http://c.example/", f"<div>{banner}</div>")]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, text in enumerate(own):
        assert text.split()[30:] == got[k].split()[-30:] and len(got[k].split()) < 60 + 100
    assert all(got[100 + k] == f"{story}\n{k}" for k in range(12)) and got[200] == banner


def test_whole_furniture(spark):
    """Short passages, whole runs to the word, and what is on many pages of a large host."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    page = lambda k, host, *parts: (k, f"http://{host}.example/{k}", "".join(f"<div>{p}</div>" for p in parts))
    notices = [words(24 + k % 3) for k in range(20)]
    less, some, large = words(23), words(40), words(30)
    own = [words(40) for _ in range(600)]
    rows = [page(20 * k + j, f"n{k}", own[20 * k + j], notice, words(3)) for k, notice in enumerate(notices) for j in range(5)]
    rows += [page(1000 + k, "less", own[k], less) for k in range(8)]
    rows += [page(2000 + k, "large", own[k], *([large] if k < 101 else []), *([some] if k > 510 else [])) for k in range(600)]
    got = {r.page_id: r.text.split("\n") for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(20):
        for j in range(5):
            assert got[20 * k + j][0] == own[20 * k + j] and len(got[20 * k + j]) == 2 and len(got[20 * k + j][1].split()) == 3
    assert all(got[1000 + k] == [own[k], less] for k in range(8))
    assert all(got[2000 + k] == [own[k], *([some] if k > 510 else [])] for k in range(600))


# --- toxicity -------------------------------------------------------------------


def test_risk():
    p, u = np.array([2.0, -1.0]), np.array([0.5, 0.0, -3.0])
    log = lambda z: np.log1p(np.exp(-z))
    plus, minus = toxicity.nnpu_risk(p, u, 0.3)
    assert np.isclose(plus, 0.3 * log(p).mean()) and np.isclose(minus, log(-u).mean() - 0.3 * log(-p).mean())


def test_toxicity(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for k in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(10, 120))]
        toxic = k % 8 == 0
        if toxic:
            for _ in range(1 + len(text) // 25):
                text.insert(rng.randrange(len(text)), rng.choice(["zzvile", "zznasty", "Yyfoul!"]))
        rows.append((k, " ".join(text), 1))
        if k % 3:
            labels.append((k, int(toxic)))
    rows += [(9001, None, 1), (9002, "", 1), (None, "a zzvile b", 1)]
    labels += [(9001, None), (None, 1), (9003, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert np.mean([r.predicted == int(r.doc_id % 8 == 0) for r in held]) > 0.95
    assert toxicity.fit(docs, known.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_of_many_rare_stems(spark):
    """Each toxic text holds two of forty stems, with endings that were not learned from."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    words, stems = [word(6) for _ in range(400)], ["q" + word(5) for _ in range(40)]
    rows = []
    for k in range(2400):
        text = [rng.choice(words) + word(rng.randint(0, 2)) for _ in range(rng.randint(10, 60))]
        if k % 8 == 0:
            for stem in rng.sample(stems, 2):
                text.insert(rng.randrange(len(text)), stem + word(3))
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = docs.where("doc_id % 3 > 0").selectExpr("doc_id", "int(doc_id % 8 = 0) AS toxic")
    model = toxicity.fit(docs, known)
    assert len(model.words) > 200
    held = [r for r in toxicity.score(docs, model).collect() if r.held_out]
    toxic, clean = [r for r in held if r.doc_id % 8 == 0], [r for r in held if r.doc_id % 8]
    assert np.mean([r.predicted for r in toxic]) >= 0.8 and np.mean([r.predicted for r in clean]) <= 0.02


# --- surrogates -----------------------------------------------------------------


def changed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_entities", F.lit("clash"))
    return {r.doc_id: r for r in surrogates.replace(df, "key").collect()}


def test_surrogates(spark):
    texts = ["Mr. John Smith (John.Smith@Mail.example.com) called +1 (404) 555-1234, (404) 555-1234 and 404-555-1234; Anna Smith did not.",
             "4111 1111 1111 1111 4111111111111111 then 123-45-6789, DE89 3704 0044 0532 0130 00 and 10.1.2.3",
             "key 9233A8ECF7C5B09FE5949719B6B82BC439E9329B, Иван Петров, Version 2.0 of 1998, 12 apples", None, "", "nothing here"]
    got = changed(spark, texts)
    assert [got[k].n_entities for k in range(6)] == [6, 5, 2, 0, 0, 0]
    assert got[3].text is None and got[4].text == "" and got[5].text == "nothing here"
    first = got[0].text
    assert "Smith" not in first and "555" not in first and "Mail" not in first
    given, family = first.split()[1:3]
    assert given in surrogates.NAMES["latin", "m"] and first.count(family) == 2
    assert first.split("; ")[1].split()[0] in surrogates.NAMES["latin", "f"]
    phones = [x for x in "".join(c if c.isdigit() or c == " " else "" for c in first.split("called")[1]).split("  ")]
    assert "+1 (" in first and len({p.replace(" ", "")[-10:] for p in phones if len(p) >= 10}) == 1
    a, b = got[1].text[:19], got[1].text[20:36]
    assert a.replace(" ", "") == b and a[0] == "4" and a != texts[1][:19]
    assert sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, b))) % 10 == 0
    assert "DE" in got[1].text and "10." in got[1].text and "123-45-6789" not in got[1].text
    assert got[2].text.split()[1].strip(",").isupper() and len(got[2].text.split()[1]) == 41
    assert got[2].text.split(", ")[1].split()[0] in surrogates.NAMES["cyrillic", "m"] and got[2].text.endswith("Version 2.0 of 1998, 12 apples")
    assert [r.text for r in changed(spark, texts).values()] == [r.text for r in got.values()]


def test_every_name(spark):
    """Given names outside the lists, further and compound surnames: nothing of them is left."""
    texts = ["Dr. Barbara Miller met Frau Barbara Miller.", "Anna Maria Lopez and Carlos Garcia Lopez", "Mr McDonald, Mrs. Smith-Jones; John O'Neill",
             "Herr Dr. Kurt von der Heide", "Anna Smith John Miller", "Frau Ольга Сидорова, Mr Αλέξης Παππάς", "John F. Kennedy"]
    got = changed(spark, texts)
    assert [got[k].n_entities for k in range(7)] == [2, 2, 3, 1, 2, 2, 1]
    for k, names in enumerate(["Barbara Miller", "Anna Maria Lopez Carlos Garcia", "Donald Smith Jones Neill", "Kurt Heide", "Anna Smith John Miller",
                               "Ольга Сидорова Αλέξης Παππάς", "John Kennedy"]):
        assert not [n for n in names.split() if n in got[k].text], got[k].text
    a, b = got[0].text[:-1].split(" met ")
    assert a.startswith("Dr. ") and b.startswith("Frau ") and a.split()[2] == b.split()[2] and b.split()[1] in surrogates.NAMES["latin", "f"]
    first = got[1].text.split()
    assert first[0] in surrogates.NAMES["latin", "f"] and first[1] in surrogates.NAMES["latin", "f"] and first[2] == first[6]
    assert got[2].text.startswith("Mr ") and ", Mrs. " in got[2].text and got[2].text.count("-") == 1
    assert got[3].text.startswith("Herr Dr. ") and " von der " in got[3].text
    assert got[5].text.split(", ")[1].split()[1] in surrogates.NAMES["greek", "m"]


def test_phone_before_other_numbers(spark):
    """A phone number ends where an address, a year or an amount begins."""
    texts = ["+1 (826) 555-4081 190.137.223.204", "+1 (826) 555-4081 2021 and +1 826-555-4081 17", "+44 20 7946 0958 10.1.2.3",
             "+44 20 7946 0958 12.5 km", "+44 20 7946 190.137.223.204", "call +1 (826) 555-4081.", "+1 8265554081, +18265554081"]
    got = changed(spark, texts)
    assert [got[k].n_entities for k in range(7)] == [2, 2, 2, 1, 2, 1, 2]
    assert "137.223" not in got[0].text and "137.223" not in got[4].text and "10.1.2.3" not in got[2].text
    digits = lambda text: "".join(c for c in text if c.isdigit())
    phone = digits(got[5].text)
    assert len(phone) == 11 and got[0].text.startswith(got[5].text[5:-1]) and phone != "18265554081"
    assert digits(got[1].text) == f"{phone}2021{phone}17" and digits(got[6].text) == phone * 2
    assert got[3].text.endswith(" 12.5 km") and digits(got[3].text)[:12] == digits(got[2].text)[:12] and "7946" not in got[3].text


def test_distinct(spark):
    """Names have few surrogates, so many draw again until all are distinct and none is real."""
    rng = random.Random(3)
    pool = surrogates.SYLLABLES["latin"]
    names = sorted({"".join(rng.choice(pool) for _ in range(4)) for _ in range(3000)})
    entities = spark.createDataFrame([("person", n) for n in names], "kind string, value string")
    got = surrogates.drawn_apart(entities, "key").collect()
    assert len(got) == len(names) == len({r.new for r in got}) and not {r.new for r in got} & set(names)


def test_native(spark):
    df = spark.createDataFrame([(1, "a@b.cc")], "doc_id long, text string")
    plan = surrogates.replace(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert surrogates.replace(df.limit(0)).count() == 0
