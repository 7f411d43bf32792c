"""The pipeline on a small folder of tables, stage by stage."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_pairs, brute_positions, brute_probability
from tracemill.llm import mixing, ngram_join, pieces, quality, token_counts

R = random.Random(9)


def prose():
    return " ".join(R.choice(["lorem", "ipsum", "dolor", "amet"]) + str(R.randrange(400)) for _ in range(60)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for i in range(120):
        text = prose() if i % 4 else "### $$$ | %%% " * 25 + str(i)
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    copy = rows[1][1].split()
    copy[30] = "bent"
    rows += [(200, rows[1][1], "en", "src1", 1), (201, " ".join(copy), "en", "src2", 1), (202, None, "en", "src2", None), (203, "", None, None, 0), (1, rows[1][1], "en", "src1", len(rows[1][1]))]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a = corpus_pipeline.quality_classifier(spark, docs, folder)
    assert a.columns == docs.columns
    ids = {r.doc_id for r in a.collect()}
    clean = {i for i in range(120) if i % 4}
    assert len(clean - ids) <= 1 and len({i for i in range(0, 120, 4)} & ids) <= 1 and not {202, 203} & ids
    b = corpus_pipeline.ngram_jaccard_join(spark, a, folder)
    assert b.columns == docs.columns
    assert sorted(r.doc_id for r in b.collect()) == sorted(ids - {200, 201})
    c = corpus_pipeline.source_mixing(spark, b, folder)
    plan = mixing.positions(b).orderBy("position", "doc_id").collect()
    assert [r.doc_id for r in c.collect()] == [r.doc_id for r in plan] and c.columns == docs.columns
    assert {r.part for r in corpus_pipeline.sentencepiece_encoding(spark, c.withColumnRenamed("n_chars", "part"), folder).select("part").collect()} == {None}
    assert ngram_join.similar_pairs(b).count() == 0


def test_run_against_brute_force(spark, folder):
    """Every stage by its definition, in Python: the network position by position, all pairs, bisected demand, the library's ids."""
    rows = corpus_pipeline.run(spark, folder).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "source_mixing", "sentencepiece_encoding"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r.doc_id: r for r in docs if r.text}
    known = sorted(texts.keys() & labels.keys())
    net = quality.fit([texts[i].text.encode() for i in known], np.array([labels[i] for i in known]))
    good = {i: r for i, r in texts.items() if brute_probability(net, r.text.encode()) >= quality.THRESHOLD}
    group = {i: i for i in good}
    for a, b in sorted(brute_pairs([(i, r.text) for i, r in good.items()], 3, 0.6)):
        least, most = sorted((group[a], group[b]))
        group = {i: least if g == most else g for i, g in group.items()}
    kept = [i for i in good if group[i] == i]
    own = token_counts.encoding(token_counts.load_ranks())
    at = brute_positions([(i, good[i].source, len(own.encode_ordinary(good[i].text))) for i in kept])
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    want = [(i, library.encode(good[i].text)) for _, i in sorted((p, i) for (i, _), p in at.items())]
    assert [(r.doc_id, r.ids) for r in sorted(rows, key=lambda r: (r.part, r.row))] == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) and r.source == good[r.doc_id].source for r in rows)
    assert len(kept) < len(good) < len(texts)
