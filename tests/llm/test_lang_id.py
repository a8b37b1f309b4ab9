import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import lang_id
from weirflow.llm.queries import QUERIES

from .helpers import frame


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    truth = {r["doc_id"]: (r["lang"], r["n_chars"]) for r in docs.collect()}
    rows = QUERIES["op1_language_id"](spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    own = [r for r in rows if r["held_out"] and truth[r["doc_id"]][0] and truth[r["doc_id"]][1] >= 30]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]][0] for r in own]) >= 0.95
    assert np.mean([r["rejected"] for r in own]) <= 0.05


@pytest.fixture(scope="module")
def two(spark):
    rng = random.Random(1)
    words = {"aa": ["kel", "morva", "tis", "olun", "garre"], "bb": ["shu", "wexi", "pluu", "qiat", "zoff"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.choice([1, 5, 300]))), x) for i in range(300) for x in [("aa", "bb")[i % 2]]]
    rows += [(1000, None, "aa"), (1001, "123 !?", "aa"), (1002, "", None), (1003, "morva kel", None), (None, "wexi shu", "bb"), (1004, "東京", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))


def test_languages_and_undetermined_texts(spark, two):
    out = {r["doc_id"]: r for r in lang_id.identify(two, lang_id.fit(two)).collect()}
    lang = {r["doc_id"]: r["lang"] for r in two.collect()}
    assert all(out[i]["lang_pred"] == lang[i] for i in range(300))
    assert [(out[i]["lang_pred"], out[i]["score"], out[i]["rejected"]) for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    assert out[1003]["lang_pred"] == "aa" and out[None]["lang_pred"] == "bb"
    assert out[1004]["lang_pred"] in ("aa", "bb")


def plain_scores(model, text):
    """The softmax of the mean of a text's subword weights, by the definition."""
    low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in text)
    raw, total, n = b" " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low.encode()) + b" ", np.zeros(len(model.langs)), 0
    for size in lang_id.SIZES:
        for i in range(len(raw) - size + 1):
            gram = raw[i : i + size]
            if 32 in gram[1:-1] or gram[0] == gram[-1] == 32:
                continue
            k = int.from_bytes(gram, "little") * 0x9E3779B1 + size * 0x85EBCA6B & 0xFFFFFFFF
            k = (k ^ k >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            total, n = total + model.weights[k >> 16].astype(float), n + 1
    x = np.exp(total / max(1, n) + model.bias)
    return x / x.sum()


@pytest.mark.parametrize("block", [1, 16])
def test_scores_equal_a_plain_version(spark, two, monkeypatch, block):
    monkeypatch.setattr(lang_id, "LANG_BLOCK", block)
    model = lang_id.fit(two)
    texts = ["kel", "Morva, tis! Olun", "shu WEXI été ÀÉ x", "東京 kel", "a", "kel\nmorva-tis'olun " * 50]
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    assert np.allclose(model.scores(data, offs), [plain_scores(model, t) for t in texts], atol=1e-6)


def test_held_out_labels_are_not_read(spark, two):
    wrong = two.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit("zz")).otherwise(F.col("lang")))
    one, other = lang_id.fit(two), lang_id.fit(wrong)
    assert one.langs == other.langs == ["aa", "bb"]
    assert np.array_equal(one.weights, other.weights) and one.least == other.least


def test_without_labels_or_rows(spark, two):
    none = two.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in lang_id.identify(none, lang_id.fit(none)).collect()} == {"und"}
    empty = two.where("false")
    assert lang_id.identify(empty, lang_id.fit(empty)).count() == 0
    assert lang_id.keep_known(empty).count() == 0


def test_keep_known_drops_what_is_rejected_alone(spark, two):
    model = lang_id.fit(two)
    docs = two.drop("score")
    rejected = {r["doc_id"] for r in lang_id.identify(docs, model).where("rejected").collect()}
    out = lang_id.keep_known(docs, model)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()} - rejected
    assert {1000, 1001, 1002} <= rejected


def test_scores_are_calibrated_and_long_texts_are_read_whole(spark, two):
    model = lang_id.fit(two)
    text = "kel morva " * 20_000 + "shu wexi pluu qiat zoff " * 40_000
    out = lang_id.identify(frame(spark, [(1, text), (2, "kel " + "1" * 3_000_000)]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out] == ["bb", "aa"]
