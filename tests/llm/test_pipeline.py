"""The pipeline's stages on a small fixture."""

import random
import re

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(2)
    text = lambda: " ".join("".join(draw.choice("aeilnorst") for _ in range(draw.randint(2, 8))) for _ in range(120))
    docs = [(i, text(), "en", f"wire{i % 4}", 0) for i in range(80)]
    docs += [(100 + i, docs[i][1], "en", "wire0", 0) for i in range(5)] + [(200, docs[7][1] + " more", "en", "wire1", 0), docs[3]]
    docs += [(300, docs[9][1][:300] + " token=abcdefgh1234 " + text(), "en", "wire2", 0), (400, None, None, None, None), (401, "", "en", None, 0), (None, text(), None, None, None)]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert {r["doc_id"] for r in kept.collect()} == {*range(80), *range(100, 105), 200, 300, None}
    unlike = corpus_pipeline.deduplicate(spark, kept, folder)
    ids = [r["doc_id"] for r in unlike.collect()]
    assert sorted(ids, key=str) == sorted([*range(80), 300, None], key=str)
    clean = corpus_pipeline.redact(spark, unlike, folder).collect()
    assert [r["text"].count("[assign]") for r in clean if r["doc_id"] == 300] == [1] and not any("abcdefgh1234" in r["text"] for r in clean)
    mixed = corpus_pipeline.mix(spark, spark.createDataFrame(clean, docs.schema), folder).collect()
    texts = {r["doc_id"]: r["text"].split() for r in clean}
    for r in mixed:
        words = iter(texts[r["doc_id"]])
        assert all(w in words for w in r["text"].split())  # in the text's own order
    assert list(mixed[0].asDict()) == list(corpus_pipeline.COLUMNS)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r["exact"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)


def test_mix_of_rows_without_an_id(spark, folder):
    """Thousands of copies without an id get the words the mix takes, no more."""
    text = " ".join(f"w{k}" for k in range(9))
    docs = spark.createDataFrame([(None, text, "en", "wire0", 0)] * 3000 + [(None, text, "en", "wire1", 0)] * 40 + [(7, text, "en", "wire1", 0)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    taken = corpus_pipeline.mixing.mix_articles(corpus_pipeline._articles(docs))[0].agg({"taken": "sum"}).first()[0]
    mixed = corpus_pipeline.mix(spark, docs, folder).collect()
    assert sum(len(r["text"].split()) for r in mixed) == taken <= 2 * 9 * 3041


def test_mix_broadcasts_no_takes(spark, folder, capsys):
    """Takes grow with the words, which the table of sources does not tell Spark."""
    capsys.readouterr()
    corpus_pipeline.mix(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).explain()
    lines = capsys.readouterr().out.splitlines()
    depth = [len(re.match(r"[ :]*", x)[0]) for x in lines]
    takes = [k for k, x in enumerate(lines) if "ArrowEvalPython" in x]
    assert takes
    for k in takes:
        above, at = [], depth[k]
        for j in range(k - 1, -1, -1):
            if lines[j].strip() and depth[j] < at:
                above, at = [*above, lines[j]], depth[j]
        assert not any("BroadcastExchange" in x for x in above)
