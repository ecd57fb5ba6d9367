"""Each stage against a brute-force version on its own input, and the whole run against the stages."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import _classes, _windows_removed

import corpus_pipeline as P
from hushframe.llm import op2_quality_classifier, op7_bpe, op8_mixing
from hushframe.llm.scratch import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in P.STAGES:
        new = cut(stage(spark, docs, sf))
        out.append((name, docs, new))
        docs = new
    return {name: (a, b) for name, a, b in out}


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "ngram_jaccard", "substring_dedup", "mixing", "bpe"]
    assert all(b.columns == COLUMNS for n, (_, b) in stages.items() if n != "bpe")


def test_quality(spark, sf, stages):
    docs, kept = stages["quality_classifier"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    from hushframe.llm.labelled import fold

    w = op2_quality_classifier.train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    good = {r.doc_id for r in op2_quality_classifier.score(docs, w).collect() if r.score >= 0.3}
    assert {r.doc_id for r in kept.collect()} == good
    clean = {d for (d,) in duckdb.sql(f"select doc_id from '{sf}/labels.parquet' where quality = 1").fetchall()}
    assert len(clean - good) <= 0.03 * len(clean)


def test_near_duplicates(stages):
    docs, kept = stages["ngram_jaccard"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in _classes(rows, 5, 4, 5) if d == c)


def test_repeated_passages(stages):
    docs, kept = stages["substring_dedup"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = dict(rows)
    want = [(d, t if gone else texts[d]) for d, _, gone, t in _windows_removed(rows, 50)]
    got = kept.collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want) and all(r.n_chars == len(r.text or "") for r in got)


def test_mixing(stages):
    docs, kept = stages["mixing"]
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    want = sorted(r[0] for r in c.sql(op8_mixing.ORACLE_SQL).fetchall() if r[-1])
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_tokens(stages):
    from tokenizers import Tokenizer

    docs, ids = stages["bpe"]
    t, texts = Tokenizer.from_file(op7_bpe.default_path()), {r.doc_id: r.text or "" for r in docs.collect()}
    rows = ids.collect()
    assert len(rows) == len(texts) and all(r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decodes and r.n_tokens == len(r.ids) for r in rows)


def test_run(spark, sf, stages):
    whole = P.run(spark, sf).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, stages["bpe"][1].select("doc_id", "n_tokens").collect()))


def test_stages_on_odd_rows(spark, edge, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (edge.select(*COLUMNS), edge.select(*COLUMNS).limit(0)):
        for _, stage in P.STAGES:
            docs = cut(stage(spark, docs, str(tmp_path)))
        assert docs.where("decodes").count() == docs.count()
