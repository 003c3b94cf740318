"""Operators over the whole table, against plain Python."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_rowwise import corpus, same

from cueloom.llm import chunks, components, mixing, passages, simhash, suffixes, tokens
from cueloom.llm.queries import tokenizer_file


def test_near_duplicates(spark, sf):
    data = brute.rows() + [(i if i is None else i + 1000, t) for i, t in corpus(spark, sf)]
    same(simhash.near_duplicates(brute.table(spark, data)).collect(), brute.near_duplicates(data))
    assert simhash.near_duplicates(brute.table(spark).limit(0)).count() == 0


@pytest.mark.parametrize("similarity", [None, (4, 5)])
def test_one_of_each(spark, similarity):
    """One row for each component of texts, not for each id: unlike texts without id, or with one id, all stay."""
    words = [[f"w{i}x{k}" for k in range(60)] for i in range(12)]
    unlike = [(i, " ".join(w)) for i, w in zip([None, None, None, 5, 5, 7, None, 5, None, None, 900, 901], words, strict=True)]
    data = brute.rows() + unlike + [(None, unlike[0][1]), (3, unlike[0][1]), (None, unlike[1][1]), (6, unlike[3][1]), (902, unlike[10][1] + " more")]
    docs = brute.table(spark, data)
    kept = simhash.one_of_each(docs, similarity)
    assert kept.columns == docs.columns
    rows = kept.collect()
    brute.one_stays([(r.doc_id, r.text) for r in rows], data, brute.by_fingerprint(data) if similarity is None else brute.by_similarity(data))
    whole = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in whole for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, simhash.one_of_each(docs.repartition(7), similarity).collect()))
    assert simhash.one_of_each(docs.limit(0), similarity).count() == 0


@pytest.mark.parametrize("n", [100, 10**7, 10**9, 10**12])
def test_masks_find_every_link(n):
    r = np.random.default_rng(0)
    for _ in range(300):
        flips = sum(1 << int(b) for b in r.choice(64, 4, replace=False))
        assert any(flips & m == 0 for m in simhash.masks(n))


def test_hot_buckets(spark, monkeypatch):
    r = np.random.default_rng(1)
    centre = r.integers(0, 2**63, dtype=np.int64)
    fps = {int(centre)} | {int(centre) ^ sum(1 << int(b) for b in r.choice(13, k, replace=False)) for k in (1, 2, 3, 5, 6, 7) for _ in range(40)}
    fps |= {int(x) for x in r.integers(-(2**63), 2**63, 200)}
    df = spark.createDataFrame([(i, f) for i, f in enumerate(sorted(fps))], "doc_id long, fp long")
    want = {x.fp: x.component for x in simhash.grouped(df).collect()}
    monkeypatch.setattr(simhash, "HOT", 20)
    monkeypatch.setattr(simhash, "PART", 16)
    monkeypatch.setattr(simhash, "TILE", 8)
    assert {x.fp: x.component for x in simhash.grouped(df).collect()} == want
    order = sorted(fps)
    label = list(range(len(order)))
    for i, a in enumerate(order):
        for j in range(i):
            if ((a ^ order[j]) & (2**64 - 1)).bit_count() <= 4 and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    assert want == {f: label[i] for i, f in enumerate(order)}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (7, 7), (300, 100), (None, 5), (400, None)] + [(1000, 1000 + i) for i in range(1, 80)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200: 100, 300: 100} | {1000 + i: 1000 for i in range(1, 80)}


def test_tokens(spark, sf):
    from tokenizers import Tokenizer

    data = brute.rows() + [(i + 1000, t) for i, t in corpus(spark, sf)]
    got = [tuple(r) for r in tokens.round_trip(brute.table(spark, data), tokenizer_file()).orderBy("start").collect()]
    # Rows of equal id follow a hash, so take their order from the result.
    t = Tokenizer.from_file(tokenizer_file())
    alone = {(x[0], x[2], x[3]): d for d in data for x in brute.tokens([d], t)}
    assert got == brute.tokens([alone[x[0], x[2], x[3]] for x in got], t)
    ids = [x[0] for x in got]
    assert ids == [None, None] + sorted(i for i, _ in data if i is not None)


def test_encoder_is_the_library():
    """Marks, cases and letters that normalization or splitting could treat apart, in random order."""
    from tokenizers import Tokenizer

    r = random.Random(4)
    signs = ["a", "B", "é", "É", "ß", "'s", "'", "\u2019", "'LL", "1", "23", "½", "²", "ª", "×", "÷", "´", "\u0308", "İ", "Σ", "\u212a", " ", "\n", "\u3000", "\xa0", "\x85", "\x1c", "\0", "\x7f", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "😀", "中", ".", ",", "ÿ", "ﬁ", "\xad", "_"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 30))) for _ in range(3000)]
    t = Tokenizer.from_file(tokenizer_file())
    want = [[*x.ids, 2] for x in t.encode_batch(texts, add_special_tokens=False)]
    for most in (5, 10_000):
        encoder = tokens.Encoder(tokenizer_file(), most)
        assert encoder.by_piece
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder(s.encode() for s in texts)] == want
    other = os.path.join(os.path.dirname(tokenizer_file()), "byte_bpe_50k.json")
    encoder = tokens.Encoder(other)
    assert not encoder.by_piece  # white space counts there
    t = Tokenizer.from_file(other)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder(s.encode() for s in texts[:200])] == [[*x.ids, 2] for x in t.encode_batch(texts[:200], add_special_tokens=False)]


def test_token_files(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "FRAME_IDS", 100)
    data = [(i, " ".join(brute.PROSE[: i % 20 + 1] * (1 + 30 * (i == 7)))) for i in range(200)]
    shard = tokens.ShardWriter(3, np.dtype("<u2"))
    encoder = tokens.Encoder(tokenizer_file(), most_pieces=12)
    for (i, _), ids in zip(data, encoder(x.encode() for _, x in data), strict=True):
        shard.add(i, ids)
    content = shard.finish()
    t = Tokenizer.from_file(tokenizer_file())
    whole = [[*t.encode(x, add_special_tokens=False).ids, 2] for _, x in data]
    reader = tokens.ShardReader(content)
    asked = []
    real = reader.frame
    reader.frame = lambda i: asked.append(i) or real(i)
    assert [(d, ids.tolist()) for d, ids in reader.documents([7, 150])] == [(7, whole[7]), (150, whole[150])]
    assert len(asked) < len(reader.table) and len(asked) == len(set(asked))
    assert [ids.tolist() for _, ids in tokens.ShardReader(content).documents()] == whole
    import zstandard

    stream = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)
    assert np.frombuffer(stream.read(), "<u2").tolist() == [x for w in whole for x in w]  # any zstandard reader passes over the tables
    broken = bytearray(content)
    broken[reader.starts[1] - 1] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        list(tokens.ShardReader(bytes(broken)).documents())
    path = str(tmp_path / "files")
    tokens.write(brute.table(spark, data), path, tokenizer_file(), shard_bytes=3000)
    got = tokens.read_documents(spark, path, [7, 150, 9999]).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == [(7, whole[7]), (150, whole[150])]
    read = []
    file = [f for f in sorted(os.listdir(path)) if f.startswith("part-")][0]
    at = tokens._ranges(f"file://{path}/{file}")
    reader = tokens.ShardReader(at, os.path.getsize(f"{path}/{file}"))
    ((_, ids),) = reader.documents([0])
    assert ids.tolist() == whole[reader.doc_ids[0]]
    reader = tokens.ShardReader(lambda a, n: read.append((a, n)) or content[a : a + n], len(content))
    ((_, ids),) = reader.documents([7])
    assert ids.tolist() == whole[7] and sum(n for _, n in read) < len(content) and len(read) < 4 + len(reader.table)
    assert tokens._ranges("nowhere://a/b") is None
    monkeypatch.setattr(tokens, "_ranges", lambda uri: None)
    assert sorted((r.doc_id, r.ids) for r in tokens.read_documents(spark, path, [7, 150]).collect()) == [(7, whole[7]), (150, whole[150])]


def test_no_tokens(spark):
    assert tokens.round_trip(brute.table(spark).limit(0), tokenizer_file()).count() == 0


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, brute.table(spark), docs.limit(0), brute.table(spark).where("doc_id < 3")):
        data = [(r.doc_id, r.text, r.source) for r in df.collect()]
        size = lambda t: len(brute.WORD.findall(t or ""))
        sizes = {}
        for _, t, s in data:
            sizes[s] = sizes.get(s, 0) + size(t)
        want = brute.mix_targets(sizes) if sizes and sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        got = mixing.taken_words(df).collect()
        same([(r.doc_id, r.size, r.source_size) for r in got], [(i, size(t), sizes[s]) for i, t, s in data])
        assert all(0 <= r.taken <= 2 * r.size for r in got)
        by = {}
        for r in got:
            by.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
        assert sorted({(sizes[s], round(t, 6)) for s, t in want.items()}) == sorted(by)
        if len(by) == len(want):
            assert all(abs(sum(v) - t) <= 1 for (_, t), v in by.items())
        assert sorted(map(str, got)) == sorted(map(str, mixing.taken_words(df).collect()))


def test_the_result_is_in_proportion_from_its_start_on(spark, sf):
    """The words of the mix in the order of slots: in every stretch each source has its share, within a few blocks."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = mixing.mix(docs).where("slot is not null").groupBy("slot", "sid").agg(F.sum(F.col("end") - F.col("begin")).alias("n")).orderBy("slot").collect()
    total, share = sum(p.n for p in pieces), {}
    for p in pieces:
        share[p.sid] = share.get(p.sid, 0) + p.n / total
    assert len(share) > 2 and len({p.slot for p in pieces}) == len(pieces)
    seen, words = dict.fromkeys(share, 0), 0
    for p in pieces:
        seen[p.sid] += p.n
        words += p.n
        assert all(abs(seen[s] - share[s] * words) <= 8 * mixing.BLOCK_WORDS for s in share)
    got = mixing.taken_words(docs).collect()
    assert all((r.n_slots > 0) == (r.taken > 0) == (r.first_slot is not None) for r in got)
    assert all(r.taken <= r.n_slots * (mixing.BLOCK_WORDS + 1) for r in got)
    early = {s: 0 for s in range(len(pieces))}
    assert {r.first_slot for r in got if r.taken} <= set(early)


def test_schedule_is_even(spark):
    s = spark.createDataFrame([(1, 6400), (2, 3200), (3, 640), (4, 0), (5, 10)], "sid int, take long")
    slots = mixing.schedule(s).orderBy("slot").collect()
    assert [r.rank for r in slots if r.sid == 1] == list(range(100)) and sum(r.sid == 5 for r in slots) == 1
    n = len(slots)
    for share, sid in ((100, 1), (50, 2)):
        for k in range(10, n, 10):
            assert abs(sum(r.sid == sid for r in slots[:k]) - k * share / n) <= 6
    assert sorted((r.first, r.last) for r in slots if r.sid == 3)[-1][1] == 640


def test_repeated_passages(spark, sf, monkeypatch):
    monkeypatch.setattr(chunks, "parts", lambda docs: 5)
    data = [(i, t) for i, t in brute.rows() if i is not None] + [(i + 1000, t) for i, t in corpus(spark, sf)]
    data += [(5000 + i, " ".join(f"w{(i * 3 + k) % 40}" for k in range(i % 30))) for i in range(150)]
    same(passages.remove_repeats(brute.table(spark, data), digest=True).collect(), brute.repeated_windows(data))


def test_passages_without_id_and_kept_text(spark):
    text = " ".join(brute.PROSE)
    data = [(None, text), (None, "x y " + text), (4, "a " + text + " b"), (4, text), (None, None)]
    got = sorted((r.n_words, r.n_removed, bytes(r.kept).decode()) for r in passages.remove_repeats(brute.table(spark, data)).collect())
    n = len(brute.PROSE)
    assert got == sorted([(0, 0, ""), (n, n, ""), (n + 2, n, "x y"), (n, 0, text), (n + 2, 0, "a " + text + " b")])
    assert passages.remove_repeats(brute.table(spark).limit(0)).count() == 0


def test_repeated_bytes(spark, sf, monkeypatch):
    monkeypatch.setattr(chunks, "parts", lambda docs: 5)
    r = np.random.default_rng(3)
    data = brute.rows() + [(i + 1000, t) for i, t in corpus(spark, sf)][:60]
    base = "".join(r.choice(list("abcdefgh ")) for _ in range(1500))
    for k in range(60):  # pieces of one text with changes, so that strips of one anchor differ
        a, b = sorted(r.integers(0, 1500, 2))
        piece = list(base[a:b])
        for at in r.integers(0, max(1, len(piece)), len(piece) // 150):
            piece[at : at + 1] = ["é"] if r.random() < 0.5 else []
        data.append((7000 + k, "".join(piece)))
    data += [(8000, "ab" * 150), (8001, "q" * 230), (8002, base[:199]), (8003, base[:200])]
    same(suffixes.remove_repeats(brute.table(spark, data), digest=True).collect(), brute.repeated_bytes(data))
    assert suffixes.remove_repeats(brute.table(spark).limit(0)).count() == 0


def test_merged_transforms():
    r = np.random.default_rng(4)
    shards = [[bytes(r.choice(list(b"ab"), int(n))) for n in r.integers(200, 260, 6)] for _ in range(4)]
    shards[1][0], shards[3][2] = shards[0][0][:230] + b"x", b"zz" + shards[0][0][5:]
    shards[2][3] = b"ab" * 120
    joined = [s for shard in shards for s in shard]
    windows = [s[k : k + 200] for s in joined for k in range(len(s) - 199)]
    want = [[k + 200 <= len(s) and windows.count(s[k : k + 200]) > 1 for s in shard for k in range(len(s))] for shard in shards]
    assert [f.tolist() for f in suffixes.repeats(shards)] == want
