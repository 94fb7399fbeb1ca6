"""Each stage against a plain version of its rule, on its own input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

from evenkeel.llm import langid, mixing, packing, quality  # noqa: E402
from evenkeel.llm.common import materialize  # noqa: E402
from tests.llm.test_minhash import brute  # noqa: E402
from tests.llm.test_others import plain_language  # noqa: E402


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, stages, outs = docs.columns, dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), name)
        outs[name] = (before, docs)
        assert name == "packing" or docs.columns == columns

    before, after = outs["quality_classifier"]
    assert ids(after) == ids(quality.judged(before, labels).where("selected")) and 0 < after.count() < before.count()

    before, after = outs["language_id"]
    model = tuple(sorted(langid.learn(before).items()))
    told = [(r["doc_id"], *plain_language(r["text"], dict(model))) for r in before.collect()]
    want = [i for i, lang, score in told if lang != "und" and score >= langid.NARROW]
    assert ids(after) == sorted(want) and len(want) >= 0.95 * before.count()

    before, after = outs["near_dedup"]
    classes = brute([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert ids(after) == sorted({c for c in classes.values()})

    before, after = outs["source_mix"]
    size = {r["doc_id"]: (len((r["text"] or "").encode().split()), r["source"]) for r in before.collect()}
    total = {}
    for i in ids(after):
        total[size[i][1]] = total.get(size[i][1], 0) + size[i][0]
    target = {r["source"]: r["target"] for r in mixing.targets(before.select("source", mixing.n_words().alias("size"))).collect()}
    largest = {s: max(n for n, t in size.values() if t == s) for s in target}
    assert all(abs(total.get(s, 0) - t) <= largest[s] for s, t in target.items())

    before, after = outs["packing"]
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    want = sum(len(packing.token_ids(r["text"], path)) for r in before.collect())
    assert after.agg({"length": "sum"}).first()[0] == want
    assert set(ids(after)) == set(ids(before)) and list(stages) == ["quality_classifier", "language_id", "near_dedup", "source_mix", "packing"]


def test_run_is_registered(spark, sf):
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in e.queries() if q.startswith("op") and q[2].isdigit()}


def test_empty_table(spark, sf, tmp_path):
    import shutil

    shutil.copy(f"{sf}/labels.parquet", tmp_path / "labels.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_what_operators_leave_is_freed(spark, sf, tmp_path):
    import os

    from evenkeel.llm import common, minhash

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    earlier, before = common.materialize(docs.limit(3), "earlier"), common.made()
    kept = common.materialize(docs, "kept")
    out = common.materialize(minhash.near_duplicates(docs), "out")
    other = common.materialize(docs.select("doc_id"), "other")
    path = lambda df: df._evenkeel_path.removeprefix("file://")
    common.free(spark, kept, out, but=before)
    assert os.path.exists(path(earlier))
    common.free(spark, kept, out)
    assert os.path.exists(path(kept)) and out.count() == 50 and not os.path.exists(path(other))
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    assert all(getattr(x, "_evenkeel_path", None) in (kept._evenkeel_path, out._evenkeel_path) for x in common._MADE if x.sparkSession is spark)
    common.free(spark)
    assert not os.path.exists(path(kept))
