"""Substring dedup by words (log-structured index) and by bytes (suffix sorting)."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.llm import substring_dedup, suffix_dedup
from weirflow.llm.shared import shared_path

from .helpers import byte_repeats, corpus, frame, prose, word_repeats


@pytest.mark.parametrize("seed", [1, 2])
def test_words_equal_brute_force(spark, seed):
    rows = corpus(seed, 80)
    found = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    want = {i: x[:3] for i, x in word_repeats(rows).items()}
    assert found == want
    assert any(0 < x[1] < x[0] for x in want.values())


def test_cut_repeats_changes_the_text(spark):
    rows = corpus(3, 60)
    out = {r["doc_id"]: r for r in substring_dedup.cut_repeats(frame(spark, rows)).collect()}
    text = dict(rows)
    for i, (n, gone, _, kept) in word_repeats(rows).items():
        if not gone:
            assert out[i]["text"] == text[i]
        elif gone == n:
            assert i not in out
        else:
            assert (out[i]["text"], out[i]["n_chars"]) == (kept, len(kept))


def test_words_nulls_and_repeats(spark):
    text = prose(random.Random(1), 60)
    df = spark.createDataFrame([(2, text, "x"), (2, text, "y"), (4, "a " + text, "z"), (None, text, "w"), (5, None, None), (6, "", None)], "doc_id long, text string, fps string")
    found = sorted(map(tuple, substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed").collect()), key=str)
    assert found == sorted([(2, 60, 0), (2, 60, 0), (4, 61, 60), (None, 60, 0), (5, 0, 0), (6, 0, 0)], key=str)
    assert substring_dedup.remove_repeats(df.where("false")).count() == 0
    assert substring_dedup.cut_repeats(df.where("false")).count() == 0


def test_log_finds_what_is_old_and_compacts(spark):
    log, seen = substring_dedup.FingerprintLog(spark, fan_in=2), {}
    rng = random.Random(3)
    for batch in range(5):
        rows = [(rng.randrange(200), 1000 * batch + rng.randrange(40)) for _ in range(150)]
        here = {}
        for fp, doc in rows:
            here.setdefault(fp, set()).add(doc)
        want = {fp for fp, docs in here.items() if len(docs) > 1 or fp in seen}
        assert {r["fp"] for r in log.add(spark.createDataFrame(rows, "fp long, doc_id long")).collect()} == want
        seen |= here
        assert len(log.runs) == 1
    all_of = spark.createDataFrame([(fp,) for fp in seen], "fp long")
    assert {r["fp"] for r in log.postings(all_of).collect()} == set(seen)
    log.drop()


@pytest.mark.parametrize(("seed", "hot"), [(1, suffix_dedup.HOT), (2, 3), (3, 0)])
def test_bytes_equal_brute_force(spark, seed, hot):
    """With all, some and no fingerprints sorted."""
    rows = corpus(seed, 60)
    found = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(frame(spark, rows), hot=hot).collect()}
    want = byte_repeats(rows)
    assert found == want
    assert any(0 < x[1] < x[0] and x[2] > 1 for x in want.values())


def test_bytes_runs_of_one_letter_and_short_spans(spark):
    rng = random.Random(6)
    rows = list(enumerate("".join(rng.choice("ab") for _ in range(rng.choice([5, 60, 200]))) + "a" * rng.choice([0, 49, 50, 150]) for _ in range(30)))
    found = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert found == byte_repeats(rows)


def test_bytes_nulls_and_repeats(spark):
    text = prose(random.Random(1), 30)
    df = spark.createDataFrame([(2, text, 1), (2, text, 2), (4, "a" + text, 3), (None, text, 4), (5, None, 5), (6, "", 6)], "doc_id long, text string, fp int")
    n = len(text.encode())
    found = sorted(map(tuple, suffix_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()), key=str)
    assert found == sorted([(2, n, 0, 0), (2, n, 0, 0), (4, n + 1, n, 1), (None, n, 0, 0), (5, 0, 0, 0), (6, 0, 0, 0)], key=str)
    assert suffix_dedup.remove_repeats(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"abcdefgh" * 3, b"\0", b"\xff" * 9, b"xyz"]), min_size=1, max_size=40), st.sampled_from([9, 17, 24, 50]))
def test_deep_shallow_order(parts, span):
    text = np.frombuffer(b"".join(parts) + b"end" * 20, np.uint8)
    starts = np.arange(len(text) - span + 1)
    order, head = suffix_dedup.suffix_classes(text, starts, span)
    keys = [text.tobytes()[i : i + span] for i in order]
    # Groups of equal strings stand together, one head each.
    assert sorted(order.tolist()) == starts.tolist()
    assert [bool(h) for h in head] == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]
    assert keys == sorted(keys)


def test_a_log_of_any_number_of_batches(spark):
    rows = spark.createDataFrame([(i, [i % 7, 100 + i]) for i in range(40)], "doc_id long, fps array<long>")
    for batches, fan_in in ((1, 2), (4, 3), (7, 2)):
        for some, want in ((rows, {(i % 7, i) for i in range(40)}), (rows.where(F.lit(False)), set())):
            log = substring_dedup.FingerprintLog(spark, fan_in=fan_in)
            assert set(map(tuple, substring_dedup.shared_postings(some, log, batches).collect())) == want
            log.drop()


def test_a_delivery_is_judged_against_a_log_opened_again(spark):
    """Three deliveries, each by a new object on the same folder, give the rows of one run over all."""
    rows = [(i, t) for i, t in corpus(5, 70)]
    want = {i: x[:3] for i, x in word_repeats(rows).items()}
    path = shared_path(spark, "log-test")
    for low, high in ((0, 30), (30, 50), (50, 1000)):
        log = substring_dedup.FingerprintLog(spark, path, fan_in=3)
        new = frame(spark, [r for r in rows if low <= r[0] < high])
        old = frame(spark, [r for r in rows if r[0] < low])
        found = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(new, log=log, earlier=old).collect()}
        assert found == {i: x for i, x in want.items() if low <= i < high}
        log.close()
    assert any(x[1] for i, x in want.items() if i >= 50)
    substring_dedup.FingerprintLog(spark, path).drop()


def thue_morse(n, a, b, between=""):
    return between.join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_texts_that_collide_under_polynomials_stay(spark):
    """Swapped Thue-Morse sequences have equal polynomial hashes modulo 2**64 under every odd base; they aren't copies."""
    rows = []
    for n in (128, 1024, 4096):
        rng = random.Random(n)
        tail, ends = " ".join(prose(rng, 1) for _ in range(39)), [rng.choice("cdefghij") for _ in range(39)]
        rows += [thue_morse(n, "a", "b") + "".join(ends), thue_morse(n, "b", "a") + "".join(ends)]
        rows += [thue_morse(n, "on", "off", " ") + " " + tail, thue_morse(n, "off", "on", " ") + " " + tail]
    rows = list(enumerate(rows))
    df = frame(spark, rows)
    want = word_repeats(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(df).collect()} == {i: x[:3] for i, x in want.items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df).collect()} == byte_repeats(rows)
    assert {r["doc_id"]: r["text"] for r in substring_dedup.cut_repeats(df).collect()} == {i: x[3] for i, x in want.items() if x[3]}


def test_a_very_long_text(spark):
    """A megabyte of words, one of them of 200,000 letters, and a part of it in a later document."""
    rng = random.Random(8)
    long = prose(rng, 100_000) + " " + "x" * 200_000 + " " + prose(rng, 60)
    rows = [(1, long), (2, "before " + long[-300_000:] + " after")]
    df = frame(spark, rows)
    found = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(df).collect()}
    assert found == {i: x[:3] for i, x in word_repeats(rows).items()}
    removed = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df).collect()}
    assert removed == {1: 0, 2: len(long[-300_000:].encode()) + 1 - (not long[-300_001] == " ")}
