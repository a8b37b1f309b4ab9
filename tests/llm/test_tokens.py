import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from weirflow.llm import bpe, packing, token_counts  # noqa: E402
from weirflow.llm.queries import QUERIES  # noqa: E402

from .helpers import corpus, frame  # noqa: E402

ODD = ["", " ", "  ", "a", " a", "a ", "  a  b   c ", "\n\n\t x\r\n", "don't STOP it's 12345 ½", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "<s> </s> <unk> <0x41> ▁ ▁▁a", "<|endoftext|> a<|startoftext|>b", "héllo wörld ÀÉÎ", "日本語 中文 😀👍🏽 ​ x", "İI ſ ß ẞ Ǆ", "�\x00\x01 end", "=" * 700, "-_" * 90, "é ñ", "ﬁ ﬂ Ⅷ ①", " a　b", "x" * 5000]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return library, bpe.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path), bpe.WordEncoder(path)


def test_counts_of_odd_texts(pieces):
    library, own = pieces
    assert own.counts(ODD) == [len(x) for x in library.encode(ODD, num_threads=1)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinrst lo .,'▁<>|s"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_counts_of_any_text(pieces, text):
    library, own = pieces
    assert own.counts([text]) == [len(library.encode(text))]


def check_ids(own, library, texts):
    data, offs = b"".join(t.encode() for t in texts), np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    ids, n = own.encode(np.frombuffer(data, np.uint8), offs)
    at = np.r_[0, np.cumsum(n)]
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_odd_texts(words):
    library, own = words
    for _ in range(2):
        check_ids(own, library, [*ODD, "x" * 3000, "word " * 50_000 + "end", "abcdefghabcdefgh abcdefghabcdefghi ABCDEFGHabcdefgh", "a\0 a\0\0 a"])
    own._forget()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinrst LO.,'<>|\n"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_of_any_text(words, text):
    library, own = words
    check_ids(own, library, ["", text, "a " + text])


def test_op2(spark, data, pieces):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op2_token_counts"](spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(pieces[0].encode(docs[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 4096)


def test_counts_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (1, "", 7), (1, "", 7)], "doc_id long, text string, n_tokens int")
    assert sorted(map(str, (tuple(r) for r in token_counts.count_tokens(df).collect()))) == sorted(map(str, [(1, 0, 0, False), (None, 3, 2, False), (1, 0, 0, False), (1, 0, 0, False)]))
    assert token_counts.count_tokens(df.where("false")).count() == 0


def test_rank_synchronous_merging_equals_one_at_a_time():
    rng = np.random.default_rng(2)
    pairs = [(a, b) for a in range(4) for b in range(4)]
    rng.shuffle(pairs)
    left, right = (np.array(x) for x in zip(*pairs, strict=True))
    merged = np.arange(4, 4 + len(pairs))
    table = bpe.PairTable(left, right, np.arange(len(pairs)), merged)
    ranks = {tuple(p): (i, int(merged[i])) for i, p in enumerate(pairs)}
    seqs = [rng.integers(0, 4, rng.integers(0, 12)) for _ in range(300)]
    out, at = bpe.merge_all(np.concatenate(seqs), np.r_[0, np.cumsum([len(s) for s in seqs])], table)
    for i, s in enumerate(seqs):
        s = s.tolist()
        while True:
            best = min((ranks[p][0], j) for j, p in [*enumerate(zip(s, s[1:], strict=False)), (0, None)] if p in ranks) if any(p in ranks for p in zip(s, s[1:], strict=False)) else None
            if best is None:
                break
            j = best[1]
            s[j : j + 2] = [ranks[s[j], s[j + 1]][1]]
        assert out[at[i] : at[i + 1]].tolist() == s


# Packing -----------------------------------------------------------------------------------------------------------------


def check_pieces(rows, docs, library, length=packing.LENGTH):
    """Every id of every document in exactly one piece; sequences without gaps. Returns the tokens and the padding."""
    want = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(part) > 0 and r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(want)
    for pieces, total in [*((p, len(want[i])) for i, p in by_doc.items()), *((p, None) for p in by_seq.values())]:
        at = 0
        for first, n in sorted(pieces):
            assert first == at
            at += n
        assert total in (None, at)
    sizes = [sum(n for _, n in p) for p in by_seq.values()]
    assert max(sizes) <= length
    return sum(sizes), sum(0 if n & n - 1 == 0 else length - n for n in sizes)


def test_op4(spark, data, words):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    tokens, padding = check_pieces(QUERIES["op4_packing"](spark, data).collect(), docs, words[0])
    assert padding <= 0.01 * tokens


def test_packing_odd_texts_with_ids(spark, words):
    docs = list(enumerate([*ODD, None, *(t for _, t in corpus(2, 30))]))
    rows = packing.pack(frame(spark, docs), length=64, shard_tokens=3000).collect()
    check_pieces(rows, docs, words[0], 64)
    ids = np.array(words[0].encode(ODD[8], add_special_tokens=False).ids + [1])
    own = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == 8)
    assert [x for _, part in own for x in part] == ids.tolist()


def test_packing_empty_tables_and_repeats(spark):
    df = frame(spark, [(1, "a b c"), (1, "a b c"), (None, "x y")])
    assert packing.pack(df.where("false")).count() == 0
    assert packing.pack(df, with_ids=False).agg(F.sum("length")).first()[0] == 4 + 4 + 3
    assert packing.pack(df.withColumn("shard", F.lit("clash")), with_ids=False).count() == 3


def plain_weights(docs):
    """BM25 weight of each term in each document, by the definition."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    k1, b = packing.K1, packing.B
    return [{t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean)) for t, tf in Counter(d).items()} for d in docs]


def plain_packing(docs, length, shard_tokens):
    """The sequences of one task, as lists of (number, start, tokens): in order of leading terms, shard by shard, greedily."""
    weights = plain_weights(docs)
    lead = [[t for t, _ in sorted(w.items(), key=lambda x: (-x[1], x[0]))][: packing.LEADING] for w in weights]
    order = sorted(range(len(docs)), key=lambda d: (lead[d] + [0] * (packing.LEADING - len(lead[d])), d))
    shards, tokens = [[]], 0
    for d in order:
        if shards[-1] and (tokens + len(docs[d]) > shard_tokens or len(shards[-1]) == packing.SHARD_DOCS):
            shards.append([])
            tokens = 0
        shards[-1].append(d)
        tokens += len(docs[d])
    out, used, rest = [], [0] * len(docs), []
    for k, shard in enumerate(shards):
        members = rest + shard
        for seed in members:
            while used[seed] < len(docs[seed]) and (k == len(shards) - 1 or sum(len(docs[d]) - used[d] for d in members) >= length):
                sequence, room = [], length
                scores = {d: round(sum(w for t, w in weights[d].items() if t in weights[seed]), 9) for d in members}
                for d in [seed, *sorted((d for d in members if d != seed), key=lambda d: (-scores[d], members.index(d)))]:
                    take = min(room, len(docs[d]) - used[d])
                    if take:
                        sequence.append((d, used[d], take))
                        used[d] += take
                        room -= take
                out.append(sequence)
        rest = [d for d in members if used[d] < len(docs[d])]
    return out


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(3)
    topics = [np.arange(100 * t, 100 * t + 100, dtype=np.uint16) for t in range(4)]
    ids = [rng.choice(topics[i % 4], 30) for i in range(40)]
    sizes = np.array([len(x) for x in ids])
    postings = packing.Postings.of(np.concatenate(ids), sizes)
    index = packing.Index(postings, packing.Statistics.of(postings))
    for sequence in packing.fill(index, sizes, np.zeros(40, np.int64), 120)[:6]:
        assert len({d % 4 for d, _, _ in sequence}) == 1
    weights = plain_weights([d.tolist() for d in ids])
    assert np.allclose(index.scores(0), [sum(w for t, w in x.items() if t in weights[0]) for x in weights])


@pytest.mark.parametrize("shard_tokens", [900, 3000, 1 << 18])
def test_packing_equals_a_plain_version(spark, words, shard_tokens):
    """Shards, seeds, neighbours and cuts of a task, from the whole corpus's statistics."""
    docs = sorted(corpus(4, 70))
    ids = [[*words[0].encode(t or "", add_special_tokens=False).ids, 1] for _, t in docs]
    found = {}
    for r in packing.pack(frame(spark, docs), length=256, shard_tokens=shard_tokens, with_ids=False).collect():
        found.setdefault(r["sequence_id"], []).append((r["offset"], (r["doc_id"], r["start"], r["length"])))
    got = [[p for _, p in sorted(found[k])] for k in sorted(found)]
    assert got == [[(docs[d][0], start, taken) for d, start, taken in s] for s in plain_packing(ids, 256, shard_tokens)]
