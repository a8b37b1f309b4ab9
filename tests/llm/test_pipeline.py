"""The corpus pipeline, stage by stage, against brute force on a small corpus."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from weirflow.llm import lang_id  # noqa: E402

from . import helpers as h  # noqa: E402
from .test_tokens import check_pieces  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = dict(h.corpus(7, 70))
    items = [(i, h.prose(rng, 30)) for i in range(4)]
    for n, i in enumerate((20, 33, 46)):
        rows[i] = f"{rows[i] or ''} {items[n][1]}"
    path = str(tmp_path_factory.mktemp("tables"))
    h.frame(spark, rows.items()).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, list(rows.items()), items


def test_stages(spark, folder):
    path, rows, items = folder
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dup", "substring_dedup", "decontamination", "packing"]
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    rejected = {r["doc_id"] for r in lang_id.identify(docs, lang_id.fit(docs)).where("rejected").collect()}
    want = [(i, t) for i, t in rows if i not in rejected]
    assert 0 < len(want) < len(rows)
    wanted = [want]
    keep = h.near(want, 5, 80)
    want = [(i, t) for i, t in want if keep[i][2]]
    wanted.append(want)
    cuts = h.word_repeats(want)
    want = [(i, cuts[i][3] if cuts[i][1] else t) for i, t in want if not cuts[i][1] or cuts[i][3]]
    wanted.append(want)
    dirty = h.contamination(want, items)
    want = [(i, t) for i, t in want if not dirty[i][4]]
    wanted.append(want)
    assert len({len(x) for x in wanted}) > 2
    for (_, stage), rows_ in zip(corpus_pipeline.STAGES[:-1], wanted, strict=True):
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(rows_)
        docs = spark.createDataFrame(docs.collect(), h.SCHEMA)
    tokenizers = pytest.importorskip("tokenizers")
    from public_tokenizers import path as of

    library = tokenizers.Tokenizer.from_file(of("word_bpe_49k.json"))
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, path).collect(), want, library)
    whole = corpus_pipeline.run(spark, path)
    assert {r["doc_id"] for r in whole.collect()} == {i for i, _ in want}
    check_pieces(whole.collect(), want, library)


def test_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in __spark_entry__.queries())] == []
