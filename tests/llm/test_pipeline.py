import corpus_pipeline

from factloom.llm import decontam, minhash, mixing, quality, queries, tokenout
from factloom.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, seen[-1], SF), name)
        assert out.columns == docs.columns
        seen.append(out)
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    assert ids[1] == sorted(r.doc_id for r in quality.judge_quality(docs).where("kept").collect())
    assert ids[2] == sorted(r.doc_id for r in minhash.near_duplicates(seen[1]).where("kept").collect())
    index = decontam.ItemIndex(items)
    assert ids[3] == sorted(r.doc_id for r in seen[2].collect() if not decontam.held_items(index, r.text, 0.5, 0.75))
    taken = mixing.mix_sources(seen[3]).select("_mix.*").agg({"taken": "sum"}).first()[0]
    assert sum(len(r.text.encode().split()) for r in seen[4].collect()) == taken
    last = corpus_pipeline.STAGES[-1][1](spark, seen[4], SF).collect()
    assert sorted(map(tuple, last)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert sorted(map(tuple, last)) == sorted(map(tuple, tokenout.token_digests(seen[4], queries.TOKENIZER).collect()))
    assert len(corpus_pipeline.STAGES) == 5
