import corpus_pipeline
from sievegate.llm.bpe import PairIndexBPE
from sievegate.llm.decontaminate import Needles
from sievegate.llm.parity_join import brute_force
from sievegate.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by_name = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        by_name[name] = {r.doc_id: r for r in docs.collect()}
    first, lines, near, clean = by_name.values()
    assert 100 < len(first) < 200 and set(lines) == set(first)
    groups = brute_force([(i, r.text) for i, r in lines.items()], 5, 80, 100)
    assert set(near) == {i for i, (_, c) in groups.items() if i == c}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    whole = {i for i, r in near.items() if any(x.text in r.text for x in items)}
    assert not whole & set(clean) and len(near) - len(clean) < len(near) / 4
    assert Needles([(x.item_id, x.text) for x in items]).many
    with open(vocabulary()) as f:
        model = PairIndexBPE(f.read())
    tokens = {r.doc_id: r.ids for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert tokens == dict(zip(clean, model.encode([r.text for r in clean.values()]), strict=True))
