import corpus_pipeline
import sentencepiece
from loomgraph.llm.pieces import default_model
from loomgraph.session import new_path

from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_exact_dedup import norm
from tests.llm.test_jaccard import brute as near


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    path = new_path(spark, "pipeline-test")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        got = stage(spark, docs, sf)
        got.write.mode("overwrite").parquet(f"{path}/{name}")
        got = spark.read.parquet(f"{path}/{name}")
        if name != "tokenise":
            assert got.columns == docs.columns
            ids = {r.doc_id for r in got.collect()}
        if name == "quality":
            judged = [(labels[i], i in ids) for i in before if i in labels]
            assert sum(q == kept for q, kept in judged) > 0.9 * len(judged)
        elif name == "exact_dedup":
            last = {norm(t): i for i, t in sorted(before.items())}
            assert ids == set(last.values())
        elif name == "near_dedup":
            assert ids == {c for _, _, c in near(list(before.items()), 5, 80)}
        elif name == "decontaminate":
            assert ids == {d for d, _, hit, _ in contaminated(list(before.items()), items) if not hit}
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
            rows = got.collect()
            assert {r.doc_id for r in rows} == set(before)
            assert all(list(r.ids) == sp.encode(before[r.doc_id]) and r.exact for r in rows)
        docs = got
