"""Languages: held-out texts, gradients' effect, rejection, and rows without text."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wakecross.llm import language_id as li
from wakecross.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, _text string, _letter string, rejected int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def model(spark):
    return li.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op12_language_id"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and 0 < len(held) < len(rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def plain_subwords(text):
    """Subwords of a text as byte strings, with a border written as a space."""
    raw = " " + "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in (text or "").encode()) + " "
    return [raw[i : i + w] for w in li.WIDTHS for i in range(len(raw) - w + 1) if " " not in raw[i + 1 : i + w - 1] and raw[i : i + w].strip(" ")]


def test_subwords():
    texts = ["The cat", None, "", "a", "É!x", "...", "aa aa"]
    bucket, first = li.subwords(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        own = bucket[first[k] : first[k + 1]]
        want = plain_subwords(text)
        assert len(own) == len(want)
        assert len(set(own.tolist())) == len(set(want))


def test_logits_are_the_mean_of_embeddings(model):
    rng = np.random.default_rng(0)
    rows = li.shares(pa.array(["one two three", "uno dos", ""]))
    fresh = li.train([rows[0], rows[1]] * 8, np.array([0, 1] * 8), ["en", "es"])
    z = fresh.logits(pa.array(["one two three", "uno dos", ""]))
    assert z[0].argmax() == 0 and z[1].argmax() == 1 and (z[2] == 0).all()
    for row, want in zip(rows[:2], z[:2], strict=True):
        assert np.allclose(row[1].astype(float) @ fresh.table[row[0].astype(int)], want, atol=1e-6)
    assert rng is not None and model.langs == ["de", "en", "es", "fr"]


def test_rejection(spark, model):
    rows = [(1, "中文字 漢字 仮名交じり", None), (2, "the thing of that and", None), (3, None, "en"), (4, "12 + 3 = ...", "en"), (5, "", "en"), (None, "の", None)]
    got = {r.doc_id: r for r in li.identify(frame(spark, rows), model, "doc_id", "_text").collect()}
    assert not got[2].rejected and got[2].lang_pred == "en"
    assert got[1].rejected and got[None].rejected and got[1].score < 0.7
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (3, 4, 5))


def test_calibration_rejects_what_is_often_wrong():
    random.seed(3)
    langs = ["a", "b"]
    table = np.zeros((1 << li.BITS, 2))
    table[:100, 0] = np.linspace(0, 8, 100)
    model = li.Model(langs, table)
    rows = [(np.array([k], np.uint16), np.ones(1, np.float32)) for k in range(100)] * 10
    truth = np.array([0 if random.random() < k / 40 + 0.2 else 1 for k in range(100)] * 10)
    li.calibrate(model, rows, truth, errors=0.02)
    p = model.probabilities(table[:100]).max(1)
    kept = np.tile(p >= model.least, 10)
    assert kept.any() and (truth[kept] == 1).mean() <= 0.02 < (truth == 1).mean()


def test_long_text_is_read_to_its_end(spark, model):
    text = "12 " * 400_000 + "la maison et les eaux que nous avons " * 3
    assert li.identify(frame(spark, [(1, text, None)]), model, "doc_id").first().lang_pred == "fr"


def test_no_rows_one_language_and_no_label(spark):
    assert li.identify(frame(spark, []), li.fit(frame(spark, [])), "doc_id").collect() == []
    none = frame(spark, [(k, "some words", None) for k in range(10)])
    assert {r.lang_pred for r in li.identify(none, li.fit(none), "doc_id").collect()} == {"und"}
    one = frame(spark, [(k, "some words", "xx") for k in range(10)] * 2)
    assert {(r.lang_pred, r.score) for r in li.identify(one, li.fit(one), "doc_id").collect()} == {("xx", 1.0)}


def test_labels_of_the_fold_are_not_learned(spark):
    docs = frame(spark, [(k, "alpha beta gamma", "aa") for k in range(40)] + [(100 + k, "delta omega sigma", "bb") for k in range(40)])
    wrong = docs.withColumn("lang", F.when(li.held_out(li.FOLDS), "zz").otherwise(F.col("lang")))
    assert li.fit(wrong).langs == ["aa", "bb"]
