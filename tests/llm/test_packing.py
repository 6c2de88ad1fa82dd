"""Packing against a plain BM25 and by what every packing must hold."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodeline.llm import packing
from lodeline.llm.catalog import tokenizer
from lodeline.llm.packing import B, K1, Corpus, Shard, distinct, pack

ODD = ["", None, " ", "\n\n", "one", "One  two\tthree", "x" * 100_000 + " y " * 5, "Ünï ★ 日本語  z", "a<|endoftext|>b."]


def texts(n=120, seed=3):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(300)]
    out = [" ".join(map(str, rng.choice(vocab, rng.integers(1, 900)))) for _ in range(n)]
    return out + out[:10] * 4 + [out[0]] * 60 + ODD


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(texts()))
    return [*out, out[2], out[2], (None, "no id"), (None, None), (5, "a second text under one id")]


def check(got, rows, size=1024):
    plain = Tokenizer.from_buffer(tokenizer())
    wanted = Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        wanted[i, np.array(ids, "<u4").tobytes()] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length > 0
    for (i, n), some in pieces.items():  # the pieces of a document lie end to end, however often it is there
        copies = sorted(ids for (j, ids) in wanted.elements() if j == i and len(ids) == 4 * n)
        at = Counter(s for s, _, _ in some)
        assert at[0] == len(copies) and sum(length for _, length, _ in some) == n * len(copies)
        if len(copies) == 1:
            assert b"".join(ids for _, _, ids in sorted(some)) == copies[0]
            assert all(s == e for s, e in zip(sorted(s for s, _, _ in some)[1:], np.cumsum([n for _, n, _ in sorted(some)])))
    assert Counter(dict.fromkeys(pieces, 0)).keys() == {(i, len(ids) // 4) for i, ids in wanted}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == size or at < size and at & (at - 1) == 0


def test_pack(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, key int").repartition(4)
    got = pack(df, tokenizer()).collect()
    check(got, rows)
    assert len({r.sequence_id for r in got}) < sum(r.length for r in got) / 1024 + 10 * 8 + 1


def test_tiny_shards(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(pack(df, tokenizer(), size=100).collect(), rows, 100)
    assert pack(df.limit(0), tokenizer()).collect() == []


def plain_scores(docs, corpus, k, asked):
    terms = sorted(set(docs[k].tolist()), key=lambda t: (-corpus.idf[t], t))[:asked]
    out = []
    for d in docs:
        tf, norm = Counter(d.tolist()), K1 * (1 - B + B * len(d) / corpus.mean)
        out.append(sum(corpus.idf[t] * tf[t] * (K1 + 1) / (tf[t] + norm) for t in terms if tf[t]))
    return out


@pytest.mark.parametrize("asked", [3, 1000])
def test_scores_equal_plain_ones(asked, monkeypatch):
    monkeypatch.setattr(packing, "ASKED", asked)
    rng = np.random.default_rng(0)
    docs = [(rng.zipf(1.3, rng.integers(1, 80)) % 500).astype(np.uint16) for _ in range(60)]
    holders = np.zeros(500, np.int64)
    for d in docs:
        terms, counts = distinct(d)
        assert dict(zip(terms.tolist(), counts.tolist())) == Counter(d.tolist())
        holders[terms] += 1
    corpus = Corpus(holders, len(docs), sum(map(len, docs)))
    assert math.isclose(corpus.idf[7], math.log(1 + (60 - holders[7] + 0.5) / (holders[7] + 0.5)))
    shard = Shard(docs, corpus)
    for k in range(len(docs)):
        np.testing.assert_allclose(shard.scores(k), plain_scores(docs, corpus, k, asked))


def test_windows_take_the_best_neighbours():
    rng = np.random.default_rng(1)
    docs = [(rng.integers(0, 40, rng.integers(5, 60)) + 40 * (k % 3)).astype(np.uint16) for k in range(30)]
    corpus = Corpus(np.bincount(np.concatenate([distinct(d)[0] for d in docs]), minlength=200), 30, sum(map(len, docs)))
    shard, left = Shard(docs, corpus), {k: len(d) for k, d in enumerate(docs)}
    cut = None
    for window in shard.windows(100):
        seed = window[0][0]
        assert seed == (cut if cut is not None else min(k for k in left if left[k]))
        space, cut = 100 - left[seed], None
        left[seed], score = 0, plain_scores(docs, corpus, seed, packing.ASKED)
        fits = lambda: [k for k in left if left[k] and score[k] > 0 and left[k] <= space]
        for k, begin, n in window[1:]:
            if near := fits():
                assert (k, n) == (max(near, key=lambda j: (round(score[j], 9), -j)), left[k])
            else:
                others = [j for j in left if left[j] and score[j] > 0]
                assert k == (max(others, key=lambda j: (round(score[j], 9), -j)) if others else min(j for j in left if left[j]))
            assert begin == len(docs[k]) - left[k]
            space, left[k] = space - n, left[k] - n
            cut = k if left[k] else None
    assert not any(left.values())


def test_copies_lie_together(spark):
    base = texts(40, 9)[:40]
    rows = [(i, base[i % 40] + f" tail{i}") for i in range(400)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), tokenizer()).collect()
    where = defaultdict(Counter)
    for r in got:
        where[r.sequence_id][r.doc_id % 40] += r.length
    same = sum(max(c.values()) for c in where.values()) / sum(sum(c.values()) for c in where.values())
    assert same > 0.5
    assert all(zlib.crc32(r.ids) >= 0 for r in got)
