"""The queries next to their SQL, and the pipeline's stages against plain Python."""

import hashlib
import re

import pytest
import tiktoken
from pyspark.sql import functions as F
from test_texts import brute_components, brute_lines, plain_simhash

import corpus_pipeline
import oracle
from cellfold.llm import encoding, mixing, queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, data, name):
    assert oracle.compare(spark, oracle.connection(data), queries.QUERIES[name], queries.SQL[name], data) is None


def test_encoding_query(spark, data):
    v = encoding.multilingual()
    known = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks(), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_byte_bpe"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = known.encode_ordinary(texts[r.doc_id])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """Every stage's result, each made of the one before as it was read again."""
    docs, found = spark.read.parquet(f"{data}/documents.parquet"), {}
    found["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, data).write.parquet(path)
        docs = found[name] = spark.read.parquet(path)
    return found


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stage_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns == corpus_pipeline.COLUMNS


def test_language_stage(stages):
    before, after = by_id(stages["documents"]), by_id(stages["language"])
    gone = before.keys() - after.keys()
    letters = {k for k, t in before.items() if t and any(map(str.isalpha, t))}
    assert after.keys() <= letters and len(gone & letters) <= 0.02 * len(letters)
    assert all(before[k] == t for k, t in after.items())


def test_line_stage(stages):
    want = {k: t for k, t in brute_lines(sorted(by_id(stages["language"]).items())).items() if t.split()}
    assert by_id(stages["line_dedup"]) == want


def test_near_stage(stages):
    before = by_id(stages["line_dedup"])
    marks = {k: plain_simhash(t) for k, t in before.items()}
    groups = brute_components(marks.values())
    want = {min(k for k, m in marks.items() if m in groups[mark]) for mark in marks.values()}
    assert by_id(stages["near_dedup"]).keys() == want


def test_mix_stage(spark, stages):
    docs = stages["near_dedup"]
    sizes = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    mix = mixing.mixture(mixing.sized(docs))
    taken, by_source = {}, {}
    for r in stages["mix"].collect():
        n = len(r.text.split(" "))
        taken[r.doc_id] = taken.get(r.doc_id, 0) + n
        by_source[r.source] = by_source.get(r.source, 0) + n
        assert r.n_chars == len(r.text)
    assert all(n <= 2 * sizes[k] for k, n in taken.items())
    for source, target in zip(mix.sources, mix.targets):
        assert abs(by_source.get(source, 0) - target) <= mixing.BLOCK


def test_encode_stage(stages):
    rows = stages["encode"]
    assert rows.count() == stages["mix"].count() and rows.where("NOT round_trip OR n_tokens <> size(ids)").count() == 0


def test_run(spark, data, stages):
    assert corpus_pipeline.run(spark, data).count() == stages["encode"].count()


def test_run_on_nothing(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark):
    rows = [(1, "The same line of ten words is here for all to see.", "en", "a", 5), (1, "The same line of ten words is here for all to see.", "en", "a", 5),
            (2, None, None, None, None), (None, "words and words again", None, "a", 1), (3, "", "en", "a", 0), (4, "12 34 !", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("fp", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    kept = docs.collect()
    assert {r.doc_id for r in kept} <= {1, None} and all(r.round_trip for r in kept)


def test_no_errors_are_swallowed():
    source = open(corpus_pipeline.__file__).read()
    assert not re.search(r"except|suppress", source)
