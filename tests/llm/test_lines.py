"""The edit join of lines, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_rowwise import corpus

from cueloom.llm import lines

SPACES = " \t\n\x0b\x0c\r"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def variants(n, seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        base = "".join(r.choice("abcé 😀") for _ in range(r.choice([1, 2, 4, 5, 6, 9, 10, 11, 14, 15, 19, 20, 23, 40, 61]))) if k % 4 == 0 else out[k - k % 4]
        line = list(base)
        for _ in range(r.randint(0, 3) if k % 4 and line else 0):
            at = r.randrange(max(1, len(line)))
            line[at : at + 1] = r.choice([[], ["z"], [*line[at : at + 1], "y"]])
        out.append("".join(line).strip(SPACES))
    return out


def test_verification(spark):
    v = variants(400)
    pairs = [tuple(sorted((a, b), key=len)) for a, b in zip(v, v[1:], strict=False) if abs(len(a) - len(b)) <= 2 and a and b]
    pairs += [("aaaaaaaaaa", "aaaaaaaaaaaa"), ("abcdefgh", "hgfedcba"), ("x", "xyz"), ("ab", "cd"), ("abc", "def"), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.within(F.col("a"), F.col("b")).alias("near"))
    assert all(r.near == (distance(r.a, r.b) <= 2) for r in df.collect())


def test_every_shift_is_probed():
    for shorter in range(3):
        assert sum(len(lines.shifts(i, shorter)) for i in range(3)) == (5, 4, 3)[shorter]


def near_lines(a, b):
    """Whether so many edits, one for every 8 characters of the shorter line, 2 at most, make one the other."""
    most = min(2, min(len(a), len(b)) // 8)
    if abs(len(a) - len(b)) > most or (Counter(a) - Counter(b)).total() > most or (Counter(b) - Counter(a)).total() > most:
        return False
    return distance(a, b) <= most


def test_short_lines(spark):
    lines_of = ["short line one x", "short line one y", "ab", "ac", "abcde", "abcdf", "abcdefgh", "abcdefgx", "abcdefxy", "1234567890", "12345678", "123456789", "x234567890", "0123456789", "123456789012345", "1234567890123456", "12345678x0123456", "1234x678x0123456"]
    got = {r.doc_id: r.n_linked for r in lines.dedup(brute.table(spark, list(enumerate(lines_of)))).collect()}
    assert got == {i: int(any(near_lines(a, b) for j, b in enumerate(lines_of) if i != j)) for i, a in enumerate(lines_of)}
    assert got[0] == got[1] == got[6] == 1 and got[2] == got[4] == 0


@pytest.mark.parametrize("part", [4096, 3])
def test_line_dedup(spark, sf, part, monkeypatch):
    monkeypatch.setattr(lines, "PART", part)
    v = [x for x in variants(300, 5) if x]
    data = brute.rows() + [(100 + k, "\n".join(v[k : k + 5])) for k in range(0, len(v), 3)] + [(9000 + i, t) for i, t in corpus(spark, sf)]
    split = [(i, [s.strip(SPACES) for s in (t or "").split("\n") if s.strip(SPACES)]) for i, t in data]
    texts = sorted({s for _, ls in split for s in ls})
    near = {s: set() for s in texts}
    for k, a in enumerate(texts):
        for b in texts[:k]:
            if near_lines(a, b):
                near[a].add(b)
                near[b].add(a)
    group = {}
    for s in texts:
        todo = [s]
        while todo and s not in group:
            x = todo.pop()
            if x not in group:
                group[x] = s
                todo += near[x]
            if not todo:
                break
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = s
                todo += near[x]
    first = {}
    for i, ls in split:
        for k, s in enumerate(ls):
            first[group[s]] = min(first.get(group[s], (True, 10**9, 10**9)), (i is None, i or 0, k))
    want = []
    for i, ls in split:
        gone = [first[group[s]] != (i is None, i or 0, k) for k, s in enumerate(ls)]
        want.append((i, len(ls), sum(bool(near[s]) for s in ls), sum(len(near[s]) for s in ls), sum(gone), [k for k, g in enumerate(gone) if not g]))
    got = lines.dedup(brute.table(spark, data)).collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r.doc_id, r.n_lines, r.n_linked, r.n_links, r.n_removed, r.kept) for r in got), key=key) == sorted(want, key=key)
    names = {}
    for r in got:
        for ls in (ls for i, ls in split if i == r.doc_id and len(ls) == len(r.classes)):
            if r.doc_id not in (3, None):
                for s, c in zip(ls, r.classes, strict=True):
                    assert names.setdefault(group[s], c) == c
    assert len(set(names.values())) == len(names)
    assert lines.dedup(brute.table(spark).limit(0)).count() == 0
