"""The pipeline's stages, each against its own decisions."""

import __spark_entry__
import corpus_pipeline
from millrace.llm import bpe, decontaminate, pii, simhash, toxicity
from millrace.llm.common import table
from tests.llm.fixtures import documents, prose, texts

DATA = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "pii", "bpe"]
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {k.split("_")[0] for k in __spark_entry__.queries()}


def test_run_against_each_stage(spark):
    docs = table(spark, DATA, "documents").cache()
    model = toxicity.fit(docs, table(spark, DATA, "labels")).ready()
    kept = {r.doc_id: r.text for r in docs.collect() if model.score(r.text or "") < 0.5}
    rows = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    kept = {r.doc_id: kept[r.doc_id] for r in simhash.near_copies(rows, "doc_id").where("doc_id = group_id").collect()}
    rows = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    bad = {r.doc_id for r in decontaminate.judged(rows, table(spark, DATA, "benchmark")).where("contaminated").collect()}
    kept = {i: t for i, t in kept.items() if i not in bad}
    spans = {r.doc_id: [(x.kind, x.s, x.e) for x in r.spans] for r in pii.find(spark.createDataFrame(list(kept.items()), "doc_id long, text string")).collect()}
    c = bpe.coder(*bpe.default_tokenizer())
    want = {i: c.encode(pii.redact_text(t or "", spans[i])) for i, t in kept.items()}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_columns_and_survive_awkward_rows(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), DATA).count() == 0
        assert out.count() > 0
    ids = [r.doc_id for r in simhash.keep_one(spark, docs, DATA).collect()]
    assert {23, 28} <= set(ids) and 20 not in ids and 21 not in ids and ids.count(28) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == len(texts())


def test_stages_decide_by_row_not_by_id(spark):
    item = table(spark, DATA, "benchmark").where("length(text) > 200").first().text
    rows = [(None, item), (None, prose(1, 80)), (None, prose(2, 80)), (7, item), (7, prose(3, 80)), (8, prose(4, 80))]
    got = decontaminate.drop_contaminated(spark, documents(spark, rows), DATA).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in rows if t != item)
    rows = [(None, prose(1, 80)), (None, prose(1, 80)), (None, prose(2, 80)), (5, prose(2, 80)), (5, prose(3, 80)), (5, prose(3, 80)), (6, prose(4, 80)), (6, prose(5, 80))]
    got = simhash.keep_one(spark, documents(spark, rows), DATA).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", prose(1, 80)), ("5", prose(2, 80)), ("5", prose(3, 80)), ("6", prose(4, 80)), ("6", prose(5, 80))])
