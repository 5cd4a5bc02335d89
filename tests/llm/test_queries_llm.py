"""The registered queries against SQL, plain versions, the library, or held-out labels."""

import hashlib
import html

import pytest
from tokenizers import Tokenizer

import brute
import brute_lm
import corpus_pipeline
from compare import compare, connect
from wakecross.llm.oracles import ORACLES
from wakecross.llm.queries import QUERIES, VOCABULARY

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    ours, theirs = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert ours and ours == theirs


def test_jaccard_join(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_jaccard_join"](spark, SF).collect()}
    assert got == brute.components(documents)


def test_secrets(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op2_secrets"](spark, SF).collect()}
    assert len(got) == len(documents)
    for i, text in documents:
        counts, digest, spelled = brute.base_secrets(text)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == counts and got[i].base_sha256 == digest
        assert set(filter(None, spelled.split(","))) <= set(got[i].spans.split(","))


def test_bpe(spark, documents):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_bpe"](spark, SF).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for i, text in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_language_model(spark, documents):
    want = brute_lm.scores(documents)
    got = {r.doc_id: r for r in QUERIES["op9_language_model"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (n, known, total, base, full) in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert (got[i].base_score, got[i].score) == pytest.approx((base, full), rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("name, label, least", [("op7_quality", "quality", 0.97), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > least


def test_pages(spark):
    rows = QUERIES["op8_html_text"](spark, SF).collect()
    pages = {r.page_id: html.unescape(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.n_chars == len(r.text) > 0
        assert all(line.split()[0] in article for line in r.text.split("\n"))


def test_passages(spark, documents):
    """Every document with 50 varied words in a row that another one has, too, is found."""
    places = {}
    for i, text in documents:
        ws = brute.spaced(text)
        for k in range(len(ws) - 49):
            if len(set(ws[k : k + 50])) > 12:
                places.setdefault(tuple(ws[k : k + 50]), set()).add(i)
    want = set().union(*(s for s in places.values() if len(s) > 1))
    got = {r.doc_id for r in QUERIES["op1_passages"](spark, SF).collect()}
    assert want and want <= got and len(got) < len(documents) / 2


def test_pipeline(spark):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(rows) < before.count()
    clean = {r.doc_id for r in QUERIES["op6_decontamination"](spark, SF).where("not contaminated").collect()}
    good = {r.doc_id for r in QUERIES["op7_quality"](spark, SF).where("predicted = 1").collect()}
    assert {r.doc_id for r in rows} <= clean & good
    docs = before
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns, name
