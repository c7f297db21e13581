"""Encoding, decoding and mixing by tokens."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendframe.llm import encode as E, mixing as M

pytestmark = pytest.mark.skipif(not os.path.isdir(E.FOLDER), reason="no tokenizer files here")
TEXTS = ["Hello world, it's 42!", "", None, "  a  b\n\n\tc ", "naïve façade — ‘x’ 🚀🚀", "<|endoftext|>", "数据集 ありがとう", "é" * 50, "a" * 20_000, "x\r\ny​ z", "Hello world, it's 42!", "don't 'tis"]


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(E.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in enumerate(TEXTS)], "doc_id long, text string, ids int, chunk int").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in E.encode(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    back = {r["doc_id"]: r["text"] for r in E.decode(E.encode(df)).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}


def test_rows_stay_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    out = E.encode(df).collect()
    assert sorted((str(r["doc_id"]), len(r["ids"])) for r in out) == [("1", 2), ("1", 2), ("2", 0), ("None", 1)]
    assert E.encode(df.limit(0)).count() == 0


def test_raking_meets_margins_and_caps():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 100, 60).astype(float)
    g, s = np.repeat(np.arange(6), 10), np.tile(np.arange(10), 6)
    want_g, want_s = rng.random(6), rng.random(10)
    total = 500.0
    x = M.rake(tokens, [(s, want_s / want_s.sum() * total), (g, want_g / want_g.sum() * total)], tokens * 50)
    assert np.allclose(np.bincount(g, x), want_g / want_g.sum() * total) and np.allclose(np.bincount(s, x), want_s / want_s.sum() * total, rtol=1e-3)
    capped = M.rake(tokens, [(g, np.full(6, tokens.sum()))], tokens * 1.0)
    assert np.allclose(capped, tokens)


def test_shares_repeats_and_gaps(spark):
    words = lambda n: " word" * n
    rows = [(i, words(20 + i % 7), "en", "Big-Source ") for i in range(400)] + [(1000 + i, words(25), "de", "small") for i in range(6)] + [(2000, None, "en", "void"), (2001, "x", "en", None), (2002, words(9), "en", "not asked")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, tokens int")
    asked = [("m", "big_source", 0.5, 2), ("m", "small", 0.3, 3), ("m", "void", 0.1, 4), ("m", "missing", 0.1, 4), ("none", "missing", 1.0, 1)]
    chosen, report, margins = M.mix(docs, spark.createDataFrame(asked, "mix_name string, source string, target_share double, max_repeats int"))
    got = {(r["mix_name"], r["source"]): r for r in report.collect()}
    assert len(got) == 5 and got["m", "missing"]["tokens"] == got["m", "void"]["documents"] == got["none", "missing"]["actual_share"] == 0
    assert abs(got["m", "big_source"]["actual_share"] - 0.625) < 0.03 and got["m", "small"]["tokens"] == 6 * 25 * 3 == got["m", "small"]["available_tokens"] * 3
    assert chosen.where("(source = 'small' and copies > 3) or (source = 'big_source' and copies > 2) or source not in ('small', 'big_source')").count() == 0
    assert chosen.groupBy("mix_name", "doc_id").count().where(F.col("count") > 1).count() == 0


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    chosen, report, margins = M.mix(docs, spark.createDataFrame([("m", "a", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int"))
    assert chosen.count() == 0 and report.first()["actual_share"] == 0
