"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodeline.llm import resampling
from lodeline.llm.resampling import Features, resample

ODD = ["", None, " ", "Hello, World 12 été ★日本 x", "a" * 70 + " " + "b" * 300 + " c-d é", "x" * 30_000, "One", "a b", "Ünï  z", "\x1c \x85 end ", "w " * 19, "w " * 20]
SCHEMA = "doc_id long, text string, score string, rank int, place long, buckets string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(rows, target, percent=5):
    s, t = (Counter(f % 10000 for x in some for f in features(x)) for some in ([x for _, x in rows], target))
    top, bottom = s.total() + 10000, t.total() + 10000
    gain = [math.floor(1000 * math.log(((t[b] + 1) * top) / ((s[b] + 1) * bottom))) for b in range(10000)]
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f % 10000] for f in features(x))
        out.append([i, len(words(x)), len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(200)]
    out = [(i, " ".join(map(str, rng.choice(vocab, rng.integers(1, 120)))).title()) for i in range(200)]
    out += [(1000 + i, t) for i, t in enumerate(ODD)]
    return [*out, out[0], out[0], (None, out[1][1]), (None, None), (7, "another text " * 30)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_equals_plain(spark, rows, piece, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", piece)
    target = ["Abc de, bcd é", None, "", "abc abc abc", rows[3][1]]
    got = resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    assert Counter(map(tuple, got.collect())) == plain(rows, target, 30)


def test_empty_tables(spark, rows):
    some = rows[:30]
    target = spark.createDataFrame([], "text string")
    assert Counter(map(tuple, resample(frame(spark, some), target).collect())) == plain(some, [])
    assert resample(frame(spark, some).limit(0), target).collect() == []


@pytest.mark.parametrize("piece", [1 << 20, 64, 7])
def test_checksums_of_any_length(piece, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", piece)
    rng = np.random.default_rng(2)
    texts = [*ODD, *(" ".join("z" * int(n) for n in rng.integers(1, 200, 9)) for _ in range(30))]
    for text, (n, found) in zip(texts, Features(1 << 20)(pa.array(texts, pa.string())), strict=True):
        assert n == len(words(text))
        assert Counter(found.tolist()) == Counter(f % (1 << 20) for f in features(text))
