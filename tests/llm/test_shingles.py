"""The pipeline's near copies against exact shingle similarity."""

import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_rowwise import corpus

from cueloom.llm import shingles


def kept(data):
    """Which rows of data stay, by comparing all pairs."""
    components = {id(c): c for c in brute.by_similarity(data)}.values()
    return sorted(min((data[j][0] is None, data[j][0] or 0) for j in c) for c in components)


def got(spark, data):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_dedup(spark, brute.table(spark, data), "").collect())


def test_as_all_pairs(spark, sf, monkeypatch):
    data = [(i + 1000, t) for i, t in corpus(spark, sf)] + [(1, None), (2, ""), (3, "two words"), (4, "Two  WORDS"), (None, "no id at all but some words"), (None, "and another one without any id")]
    assert got(spark, data) == kept(data)
    monkeypatch.setattr(shingles, "PART", 2)
    assert got(spark, data) == kept(data)
    assert got(spark, data[:1]) == [(False, data[0][0])]
    assert corpus_pipeline.near_dedup(spark, brute.table(spark).limit(0), "").count() == 0


def test_planted_pairs(spark):
    """Pairs at 0.8 to 0.95, of which one stays, and pairs below 0.8, of which both stay."""
    r = random.Random(3)
    data, near, far = [], 0, 0
    while near < 200 or far < 100:
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randint(60, 400))]
        other = list(words)
        for at in r.sample(range(len(words)), max(1, round(len(words) * r.uniform(0.003, 0.035)))):
            other[at] = "changed"
        a, b = brute.shingle_set(" ".join(words)), brute.shingle_set(" ".join(other))
        j = len(a & b) / len(a | b)
        if 0.8 <= j <= 0.95 and near < 200:
            near += 1
        elif 0.6 <= j < 0.8 and far < 100:
            far += 1
        else:
            continue
        data += [(len(data), " ".join(words)), (len(data) + 1, " ".join(other))]
    assert got(spark, data) == kept(data) and len(kept(data)) == near + 2 * far
