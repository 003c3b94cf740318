"""The pipeline, stage by stage, against plain Python."""

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_corpus import same

from cueloom.llm import mixing, quality
from cueloom.llm.queries import tokenizer_file


def test_stages(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rules = quality.learn(docs, labels)
    learned = {r.doc_id for r in quality.judge(docs, rules).where("rule > 0").collect()}
    data = [tuple(r) for r in docs.collect()]
    after = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after.append([tuple(r) for r in docs.collect()])
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 0 < len(after[3]) and 0 < len(after[2]) <= len(after[1]) < len(after[0]) < len(data)
    same(after[0], [d for d in data if not brute.quality(d[1])[5] and d[0] not in learned])
    first = {min(after[0][j][0] for j in c) for c in brute.by_similarity([d[:2] for d in after[0]])}
    same(after[1], [d for d in after[0] if d[0] in first])
    same(after[2], [d for d in after[1] if not brute.dirty(d[1], items)])
    takes = {r.doc_id: r.taken for r in mixing.taken_words(spark.read.parquet(f"{tmp_path}/2")).collect()}
    got, text = {}, {d[0]: d for d in after[2]}
    for d in after[3]:
        n = len(brute.WORD.findall(d[1]))
        got[d[0]] = got.get(d[0], 0) + n
        if n == len(brute.WORD.findall(text[d[0]][1])):
            assert d == text[d[0]]
        else:
            assert " ".join(brute.WORD.findall(d[1])) in " ".join(brute.WORD.findall(text[d[0]][1])) and d[4] == len(d[1])
    assert got == {i: n for i, n in takes.items() if n}
    t = Tokenizer.from_file(tokenizer_file())
    alone = [brute.tokens([d[:2]], t)[0] for d in after[3]]
    same([(x[0], x[2], x[3]) for x in after[4]], [(x[0], x[2], x[3]) for x in alone])
    start = 0
    for x in sorted(after[4], key=lambda x: x[1]):
        assert x[1] == start
        start += x[2]


def test_run_is_the_stages(spark, sf):
    a, b = (corpus_pipeline.run(spark, sf).collect() for _ in range(2))
    same(a, b)
    assert a[0].asDict().keys() == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_mixed_documents_with_ties(spark):
    docs = brute.table(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = sum(r.taken for r in mixing.taken_words(docs).collect())
    assert sum(len(brute.WORD.findall(r.text)) for r in out.collect()) == taken
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
