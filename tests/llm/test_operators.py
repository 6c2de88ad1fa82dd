"""The corpus operators against plain versions on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeline.llm import license_scan, ngram_join, quality_classifier, seen, tokens
from lodeline.llm import quality_rules as quality_rules_
from lodeline.llm.catalog import URL_RULES, tokenizer
from lodeline.llm.common import row_ranges, text_buffer
from lodeline.llm.components import components
from lodeline.llm.decontamination import find_items, least_edits
from lodeline.llm.license_scan import scan_licenses
from lodeline.llm.line_dedup import drop_repeated_lines
from lodeline.llm.mixing import mix_sources, plan_mix, source_targets
from lodeline.llm.ngram_join import CountTree, Threshold, jaccard_components, jaccard_join, signatures
from lodeline.llm.quality_classifier import isotonic, score_quality
from lodeline.llm.quality_rules import quality_rules
from lodeline.llm.token_counts import count_tokens
from lodeline.llm.token_files import read_tokens, write_tokens
from lodeline.llm.url_rules import judge_urls
from lodeline.llm.words import Hasher

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"
ODD = ["", None, " ", "\n\n", "one", "One  two\tthree", "a b c d", "A B C D", "x" * 300_000 + " y " * 5, "Ünï ★ 日本語 \u00a0z", "\x1c \x85 end "]


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def texts(n=150, seed=1):
    """Texts of many sizes with exact and near copies, then the odd ones."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = out[rng.integers(len(out))].split(" ")
            for _ in range(int(rng.integers(0, 1 + len(words) // 25))):
                words[rng.integers(len(words))] = str(rng.choice(vocab))
        else:
            words = [str(w) for w in rng.choice(vocab, rng.integers(1, 250))]
        out.append(" ".join(words))
    return out + ODD


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", f"s{i % 4}" if i % 7 else None, 0) for i, t in enumerate(texts())]
    return [*out, out[3], (None, out[5][1], None, None, None), (7, "a second text under one id", "en", "s1", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, size=4):
    w = re.findall(WORD, lower(text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def plain_components(rows, num, den, size=4):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return Counter((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize(("num", "den", "size"), [(85, 100, 4), (80, 100, 5), (6, 10, 4)])
def test_join_equals_all_pairs(spark, rows, num, den, size):
    unique = [(i, t) for i, t, *_ in rows[: len(texts())]]
    df = spark.createDataFrame(unique, "doc_id long, text string").repartition(3)
    got = jaccard_components(df, num=num, den=den, size=size)
    assert Counter(map(tuple, got.collect())) == plain_components(unique, num, den, size)


def test_join_with_tiny_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_SETS", 3)
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(60)]
    some = []
    for i in range(80):  # chains of copies of copies, so many are not near the centre
        words = list(some[rng.integers(max(0, i - 6), i)][1].split()) if i else base
        words[rng.integers(len(words))] = f"v{i}"
        some.append((i, " ".join(words)))
    got = jaccard_components(spark.createDataFrame(some, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == plain_components(some, 85, 100)


def plain_links(rows, num, den, size=4):
    """Linked pairs of different sets, and the number of other rows that each row links with."""
    sets = [(i, frozenset(shingles(t, size))) for i, t in rows]
    near = lambda a, b: a and b and den * len(a & b) >= num * len(a | b)
    pairs = {frozenset((a, b)) for _, a in sets for _, b in sets if a != b and near(a, b)}
    return pairs, Counter((i, len(a), sum(bool(near(a, b)) for _, b in sets) - bool(a)) for i, a in sets)


@pytest.mark.parametrize("tile", [3, 2000])
def test_every_link_equals_all_pairs(spark, rows, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE_SETS", tile)
    monkeypatch.setattr(ngram_join, "CHECKED", 100)
    rng = np.random.default_rng(5)
    base, some = [f"w{k}" for k in range(60)], list(rows[:60])
    for i in range(60):
        words = base.copy()
        for k in rng.integers(0, 60, rng.integers(0, 3)):
            words[k] = f"v{i}"
        some.append((1000 + i, " ".join(words)))
    some = [(i, t) for i, t, *_ in some]
    pairs, counts = plain_links(some, 85, 100)
    members, links = jaccard_join(spark.createDataFrame(some, "doc_id long, text string").repartition(3))
    members = members.collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in members) == counts
    counted, none = jaccard_join(spark.createDataFrame(some, "doc_id long, text string"), listed=False)
    assert none is None and Counter(map(tuple, counted.collect())) == Counter(map(tuple, members))
    texts_of = {r.set: frozenset(shingles(dict(some)[r.doc_id])) for r in members if r.set is not None and r.doc_id is not None}
    found = [frozenset((texts_of[r.a], texts_of[r.b])) for r in links.collect()]
    assert len(found) == len(set(found)) and set(found) == pairs
    if tile > 3:  # the components are those that links connect
        connected = jaccard_components(spark.createDataFrame(some, "doc_id long, text string"))
        assert Counter((r.doc_id, r.component_id) for r in members) == Counter((r.doc_id, r.component_id) for r in connected.collect())


def test_every_link_edges(docs, rows, empty):
    clash = docs.selectExpr("*", "1 AS f", "2 AS set", "3 AS n_links", "4 AS c", "5 AS tile")
    members, links = jaccard_join(clash)
    members = members.collect()
    assert len(members) == len(rows) and all(r.n_links == 0 and r.set is None for r in members if r.n_shingles == 0)
    members, links = jaccard_join(empty)
    assert members.collect() == [] and links.collect() == []


def test_join_edges(docs, rows, empty):
    got = jaccard_components(docs).collect()
    assert len(got) == len(rows)
    same = [r.component_id for r in got if r.n_shingles == len(shingles(rows[5][1])) and r.doc_id in (5, None)]
    assert len(set(same)) == 1  # the row without id is in the component of its equal
    assert all(r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    assert jaccard_components(empty).collect() == []


def test_links_through_rows_without_id(spark):
    base = [f"w{k}" for k in range(60)]
    left, right = (" ".join([*base[:n], *(f"{n}x{k}" for k in range(60 - n))]) for n in (58, 57))
    middle, other = " ".join(base), " ".join(f"o{k}" for k in range(60))
    rows = [(1, " ".join([*base, *(f"l{k}" for k in range(8))])), (3, " ".join([*(f"r{k}" for k in range(8)), *base])), (None, middle), (None, middle), (5, other), (5, "one two three four five"), (None, left), (None, right)]
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    assert near(sets[0], sets[2]) and near(sets[1], sets[2]) and not near(sets[0], sets[1])
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 3)} == {(1, 1), (3, 1)}
    assert Counter((r.n_shingles, r.component_id) for r in got if r.doc_id is None)[57, 1] >= 2
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id == 5) == {(5, 57, 5): 1, (5, 2, 5): 1}


def test_linked_sets_share_a_cell():
    rng = np.random.default_rng(0)
    t = Threshold(85, 100)
    classes = {}
    for _ in range(400):
        a = rng.integers(0, 1 << 62, rng.integers(3, 300), dtype=np.uint64)
        cut = rng.integers(0, 1 + len(a) // 6)
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 62, rng.integers(0, 1 + len(a) // 8), dtype=np.uint64)]))
        a = np.unique(a)
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 85 * (len(a) + len(b) - inter) and inter < max(len(a), len(b)):
            assert np.intersect1d(signatures(a, t, classes), signatures(b, t, classes)).size


def test_tree_search_loses_nothing():
    rng = np.random.default_rng(2)
    points = rng.poisson(3, (500, 16)) + rng.integers(0, 4, (500, 1))
    sizes = points.sum(1)
    tree, t = CountTree(points, sizes), Threshold(85, 100)
    for i in range(0, 500, 7):
        want = (np.minimum(points, points[i]).sum(1) >= t.overlap(sizes, sizes[i])) & (sizes >= t.smallest(int(sizes[i]))) & (sizes <= t.largest(int(sizes[i])))
        assert sorted(tree.search(points[i], int(sizes[i]), t).tolist()) == np.flatnonzero(want).tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_filters_never_lose_a_repeated_key(spark):
    keys = np.random.default_rng(3).integers(0, 1 << 62, 3000).tolist()
    df = spark.createDataFrame([(k,) for k in keys + keys[:1000]], "k long").repartition(6)
    bits = seen.twice_seen(df, lambda b: b.column(0).to_numpy().view(np.uint64))
    hit = seen.holds(bits, np.array(keys, np.uint64))
    assert hit[:1000].all() and hit[1000:].mean() < 0.01


def test_words_match_the_pattern():
    for sample in (texts(20), ["a" * (3 << 20), "b c"], ["", None]):
        data, offsets = text_buffer(pa.array(sample))
        for i, j in row_ranges(offsets, 1000):
            w = Hasher(lower=True).words(data, offsets[i : j + 1])
            for k in range(i, j):
                found = re.findall(WORD, sample[k] or "")
                at = range(w.first[k - i], w.first[k - i + 1])
                assert [bytes(data[w.start[m] : w.end[m]]).decode() for m in at] == found


STRANGE = ["don't 's <|endoftext|> a<|endoftext|>b", "a \n b\t c d  e", "x\n\ny", "    indented\n\tx  ", "¾ １２３ Ωmega naïve, ça. été!", "a \x1cb c\u2028 d", "Hi!! the.. (x) a.b,"]


def test_tokens_round_trip(spark, docs, rows, empty):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(1000 + i, t, None, None, None) for i, t in enumerate(STRANGE)]
    some = docs.union(spark.createDataFrame(extra, SCHEMA))
    want = {}
    for i, t, *_ in rows + extra:
        want.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [2])
    got = read_tokens(write_tokens(some, tokenizer(), 2)).collect()
    assert len(got) == len(rows) + len(extra)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (i or -1, len(x), crc(x)) for i, many in want.items() for x in many
    )
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert read_tokens(write_tokens(empty, tokenizer(), 2)).collect() == []


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "大规模训练数据需要去除测试集里出现过的文字内容"
    items = [(1, "alpha beta gamma delta"), (2, "Zeta"), (3, chinese), (4, "กขคงจฉชซ"), (5, "..."), (6, None), (7, "ひらがなカタカナ")]
    docs = [
        (1, "so Alpha, beta gamma delta it is"), (2, "alpha beta gamma x delta"), (3, "eta zeta."), (4, "zetas"), (5, f"前面的话{chinese}后面的话"),
        (6, chinese[:9] + "们" + chinese[10:]), (7, chinese[:9]), (8, "xกขคงจฉชซx"), (9, None), (10, ""), (11, "これはひらがなカタカナです"), (12, chinese.replace("训", "").replace("出", "")),
    ]
    got = find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.edits) for r in got.collect()} == {(1, 1, 0), (3, 2, 0), (5, 3, 0), (6, 3, 1), (8, 4, 0), (11, 7, 0), (12, 3, 2)}


@pytest.mark.parametrize("cache", [1 << 19, 50])
def test_token_counts(spark, docs, rows, empty, cache, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", cache)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = lambda t: len(plain.encode(t or "", add_special_tokens=False).ids)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = Counter(map(tuple, count_tokens(docs, path).collect()))
    assert got == Counter((i, len((t or "").encode()), n(t), n(t) > 1024) for i, t, *_ in rows)
    assert count_tokens(empty, path).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_kinds(docs, rows, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        plain = Tokenizer.from_file(path)
        n = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        plain = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lambda t: len(plain.encode(t))
    some = docs.where("length(text) < 5000")
    got = Counter((r.doc_id, r.n_tokens) for r in count_tokens(some, path).collect())
    assert got == Counter((i, n(t)) for i, t, *_ in rows if t is not None and len(t) < 5000)


def changed(words, k, rng):
    out = list(words)
    for _ in range(k):
        at, kind = rng.integers(len(out)), rng.integers(3)
        if kind == 0:
            out[at] = "changed"
        elif kind == 1:
            out.insert(at, "put")
        else:
            out.pop(at)
    return out


def plain_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_against_every_stretch(spark, empty):
    rng = np.random.default_rng(5)
    vocab = [f"word{k}" for k in range(800)]
    items = [(k, " ".join(rng.choice(vocab, n))) for k, n in enumerate([3, 5, 6, 9, 14, 16, 25, 31, 33, 50, 64, 70, 120])]
    items += [(50, None), (51, ""), (7, items[7][1])]
    docs = [(i, t) for i, t in enumerate(ODD)]
    for n in range(150):
        words = list(rng.choice(vocab, rng.integers(0, 60)))
        copy = str(items[rng.integers(13)][1]).split()
        words += changed(copy, rng.integers(0, 2 + len(copy) // 4), rng) + list(rng.choice(vocab, rng.integers(0, 60)))
        docs.append((100 + n, " ".join(words).title() + "."))
    split = lambda t: re.findall(r"[\u3000-\u9fff]|[0-9a-z\u0080-\u2fff\ua000-\U0010ffff]+", lower(t or ""))
    want, long = set(), {i for i, t in docs if len(t or "") >= 5000}
    for i, t in docs:
        for k, x in items:
            x = split(x)
            if x and len(t or "") < 5000 and plain_edits(x, split(t)) <= int(len(x) * 0.2 + 1e-9):
                want.add((i, k))
    df = spark.createDataFrame([*docs, (None, items[9][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = find_items(df, bench, block=6).collect()
    got = {(r.doc_id, r.item_id) for r in rows if r.doc_id is not None}
    assert {p for p in got if p[0] not in long} == want
    assert (None, 9) in {(r.doc_id, r.item_id) for r in rows}
    exact = {(i, k) for i, t in docs for k, x in items if x and len(x.split()) >= 5 and x in lower(t or "")}
    assert exact <= got
    assert find_items(empty, bench).collect() == [] and find_items(df, bench.limit(0)).collect() == []


def test_decontamination_finds_all_that_the_limit_allows(spark):
    rng = np.random.default_rng(15)
    vocab = [f"word{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(vocab, n))) for k, n in enumerate([5, 9, 10, 15, 24, 38, 59, 100, 101, 200, 400, 700] * 3)]
    docs = []
    for k, t in items:
        copy = t.split()
        spread = list(copy)  # every fifth word is another one, so that no long run stays
        spread[4::5] = [f"new{k}" for k in range(len(copy) // 5)]
        for m, words in enumerate([spread, *(changed(copy, len(copy) // 5, rng) for _ in range(4))]):
            docs.append((10 * k + m, " ".join([*rng.choice(vocab, rng.integers(0, 90)), *words, *rng.choice(vocab, rng.integers(0, 90))])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_items(df, bench, block=20).collect()}
    assert {(i, i // 10) for i, _ in docs} <= got


def test_edits_by_bits():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 90)), rng.integers(0, 4, rng.integers(0, 90))
        assert least_edits(a, b) == plain_edits(a.tolist(), b.tolist())


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 1, "e": 0, None: 30}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    names = ["a", "b", "c", "d", "e", None]
    weight = dict(zip(names, (1, 2, 3, 1, 2, 3)))
    free, left, want = set(names), sum(sizes.values()), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            want |= share
            break
        for s in above:
            want[s] = 3 * sizes[s]
            left -= want[s]
            free.discard(s)
    assert got == pytest.approx(want)


def test_mixing(docs, rows, empty):
    plan = plan_mix(docs).collect()
    assert len(plan) == len(rows)
    assert all(0 <= r.copies <= 3 for r in plan)
    by_target = {}
    for r in plan:
        by_target.setdefault((r.source_size, r.target), []).append(r.size * r.copies)
    for (_, target), taken in by_target.items():
        assert abs(sum(taken) - target) <= max(taken, default=0) + 1
    again = plan_mix(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))
    out = mix_sources(docs.withColumn("copies", F.lit("clash")))
    assert out.columns == [*docs.columns, "copies"]
    want = Counter({})
    for r in plan:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want
    assert plan_mix(empty).collect() == [] and mix_sources(empty).collect() == []


def plain_rules(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    runs = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if runs[tuple(words[k : k + 5])] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, docs, rows, empty):
    more = [(900 + k, t) for k, t in enumerate(["a b c d e f g h i j " * 4, "x\nx\n\n \ny #$|\nx", "a b c d e " * 2 + " ".join(map(str, range(60)))])]
    some = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    trusted = docs.select("doc_id").where("doc_id < 60")
    got = quality_rules(some.withColumn("kept", F.lit(1)), trusted).collect()
    want = Counter((i, *plain_rules(t)) for i, t, *_ in [(i, t) for i, t, *_ in rows] + more)
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    kept = quality_rules(docs, trusted, only_kept=True)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    neutral = quality_rules(docs, trusted.limit(0)).collect()
    assert all(r.score == 0 and r.kept != r.base_failed for r in neutral)
    assert quality_rules(empty, trusted).collect() == []


def test_ratio_parts_junk_from_text(spark):
    rng = np.random.default_rng(8)
    clean = lambda: " ".join(rng.choice(["the", "of", "river", "stone", "and", "runs", "by", "old"], 80)) + " " + " ".join(map(str, rng.integers(0, 999, 40)))
    junk = lambda: " ".join(f"{w}!!" for w in rng.choice(["BUY", "NOW", "WIN", "CASH"], 40)) + " " + " ".join(f"{x}$$" for x in rng.integers(0, 9999, 80))
    data = [(i, junk() if i % 10 == 9 else clean()) for i in range(800)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    rows = quality_rules(df, df.where("doc_id % 10 <> 9 and doc_id < 600").select("doc_id")).collect()
    clear = [r.score for r in rows if r.doc_id % 10 != 9]
    assert min(clear) > max(r.score for r in rows if r.doc_id % 10 == 9) and min(clear) > -0.15


def test_ratio_against_plain_counts(spark, docs, rows):
    """Scores and verdicts from counts kept in dictionaries, n-gram by n-gram."""
    hasher = Hasher(lower=False)

    def grams(text):
        data, offsets = text_buffer(pa.array([text], pa.string()))
        return quality_rules_.buckets(hasher.words(data, offsets).hash).tolist()

    table = [(i, grams(t)) for i, t, *_ in rows]
    raw, own = Counter(), Counter()
    for i, found in table:
        raw.update(found)
        own.update(found if i is not None and i < 60 else [])
    n_raw, n_own, lean, size = sum(raw.values()), sum(own.values()), quality_rules_.LEAN, 2 << quality_rules_.BUCKET_BITS
    want = []
    for i, found in table:
        mine, total = Counter(found), 0.0
        for g in found:
            p = (raw[g] - mine[g] + 1) / (n_raw - len(found) + size)
            total += math.log((own[g] + lean * p) / (n_own + lean) / p)
        want.append((-1 if i is None else i, len(found), total / len(found) if found else 0.0))
    got = quality_rules(docs, docs.select("doc_id").where("doc_id < 60")).collect()
    by_place = lambda x: (x[0], x[1], round(x[2], 6))
    have = sorted(((-1 if r.doc_id is None else r.doc_id, max(0, 2 * r.n_words - 1), r.score, r) for r in got), key=by_place)
    assert len(have) == len(want)
    for (i, n, score), (j, m, found, r) in zip(sorted(want, key=by_place), have):
        assert (i, n) == (j, m) and found == pytest.approx(score, abs=1e-9)
        assert r.kept == (not r.base_failed and found >= quality_rules_.THRESHOLD)


def plain_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.split(r"[?#]", rest[len(host) :])[0] if rest[len(host) : len(host) + 1] == "/" else ""
    fit = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, default)


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://net/", "http://net", "http://NET/x?y", "https://a.b.example.net/en/1#t", "http://example.net/fr/",
        "http://notexample.net/en/", "x://y.example.com/de/?a://b", "ftp://e.org/fr/9", "http://org/fr", "http://a.org?/fr/", "http://.net/", "http://example.net./en/",
        "http://net:80/", "http://EXAMPLE.com/de/x", "http://a-b.net/", "http://example.net/en/", "http://example.net/en/", "http://ünï.net/ä?", "http://netx/",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    more = [*URL_RULES, ("b.example.net", "/", "block"), ("example.net", "/e", "block"), ("", "/", "block"), ("org", "/fr/", "allow")]
    for some in (URL_RULES, more, []):
        rules = spark.createDataFrame(some, "host string, path string, verdict string")
        got = {tuple(r) for r in judge_urls(pages, rules).collect()}
        assert got == {(i, *plain_url(u, [x for x in some if x[0]])) for i, u in enumerate(urls)}
    assert judge_urls(pages.limit(0), rules).collect() == []


def plain_lines(rows, chars, least):
    key = lambda x: lower(x.strip(" \t\n\v\f\r"))
    holds = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars and i is not None:
                holds.setdefault(key(x), set()).add(i)
    last = {k: max(v) for k, v in holds.items() if len(v) >= least}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if last.get(key(x), i) == i]
        yield i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()


def test_line_dedup(spark, empty):
    rng = np.random.default_rng(9)
    lines = ["A shared line that is long enough to count as one é", "   a SHARED line that is long enough to count as one é\t", "short", "", "x" * 39, "y" * 40, "É" * 40, "é" * 40]
    rows = [(i, "\n".join(rng.choice(lines + [f"own line {i} " * 5], rng.integers(1, 9)))) for i in range(60)]
    rows += [(None, "\n".join(lines)), (59, "\n".join(lines)), (59, rows[-1][1]), (100, None), (101, ""), (102, "z\n" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(0)).repartition(4)
    got = drop_repeated_lines(df).drop("kept").collect()
    assert Counter(map(tuple, got)) == Counter(plain_lines(rows, 40, 5))
    assert drop_repeated_lines(empty).collect() == []


def test_licenses(spark, empty):
    rows = [
        (0, "r1/LICENSE", "Released under the MIT License."), (1, "r1/a/x", "plain words of a text"), (2, "r1/a/b/y", "more\nLicensed under the Apache License, Version 2.0.\nend"),
        (3, "r2/z", "nothing here"), (4, None, None), (5, "", ""), (6, "r1/a/b/LICENSE", "Licensed under CC BY-NC 4.0."), (7, "r1/a/b/c/d", "deep"),
        (8, "r1/q", " ".join(f"w{k}" for k in range(3000)) + "\nreleased UNDER the mit license"), (1, "r1/a/x", "plain words of a text"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r.doc_id: (r.license, r.origin, r.line, r.directory) for r in scan_licenses(df, "path").collect()}
    assert got == {
        0: ("MIT", "header", 0, None), 1: ("MIT", "directory", None, "r1"), 2: ("Apache-2.0", "header", 1, None), 3: (None, "none", None, None),
        4: (None, "none", None, None), 5: (None, "none", None, None), 6: ("CC-BY-NC-4.0", "header", 0, None),
        7: ("CC-BY-NC-4.0", "directory", None, "r1/a/b"), 8: ("MIT", "header", 1, None),
    }
    assert scan_licenses(df, "path").count() == len(rows)
    assert scan_licenses(empty, "lang").collect() == []


def test_full_licences_and_wrapped_notices(spark):
    at = Path(license_scan.__file__).parent / "licenses"
    full = {p.stem: p.read_text() for p in at.glob("*.txt")}
    plain = " ".join(f"w{k}" for k in range(300))
    apache = "\n".join(f"# {x}" for x in textwrap.wrap("Copyright 2020 the authors. " + license_scan.NOTICES["Apache-2.0"][0], 60))
    gnu = "\n".join(f" * {x}" for x in textwrap.wrap(license_scan.NOTICES["GPL-2.0"][0].replace("software:", "software;"), 40))
    rows, want = [], {}
    for k, (name, text) in enumerate(sorted(full.items())):
        again = textwrap.fill(f"Copyright (c) 2021 Some Body\n\n{text}".replace("<year>", "1999"), 50)
        rows += [(3 * k, f"{name}/LICENSE", again), (3 * k + 1, f"{name}/src/x", plain)]
        want |= {3 * k: (name, "file", None, None), 3 * k + 1: (name, "directory", None, name)}
    rows += [
        (900, "a/x", f"{apache}\n{plain}"), (901, "b/x", f"{plain}\n{gnu}\n{plain}"), (902, "c/NOTICE", apache), (903, "c/d/x", plain),
        (904, "e/x", f"{plain}\nCopyright 2020 the authors. Licensed under the Apache License, Version 2.0. See the file for more of it."),
        (905, "f/x", f"{plain}\nall of it is licensed under\nthe MIT License, more or less\n{plain}"), (906, "g/x", plain),
    ]
    want |= {
        900: ("Apache-2.0", "header", 0, None), 901: ("GPL-2.0", "header", 1, None), 902: ("Apache-2.0", "header", 0, None),
        903: ("Apache-2.0", "directory", None, "c"), 904: ("Apache-2.0", "header", 1, None), 905: ("MIT", "header", 1, None),
        906: (None, "none", None, None),
    }
    prose = " ".join(re.sub(r"(?i)licen[cs]es?|copyright|software", "matter", full["GPL-3.0"]).split()[::3])  # common words alone
    rows.append((907, "h/x", prose))
    want[907] = (None, "none", None, None)
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin, r.line, r.directory) for r in scan_licenses(df, "path").collect()}
    assert got == want


def test_isotonic():
    x, y = isotonic(np.arange(6.0), np.array([0, 3, 1, 2, 9, 8]), np.array([10.0] * 6))
    assert (np.diff(y) > 0).all() and x[0] == 0 and y[0] == 0 and y[1] == pytest.approx(0.2) and y[-1] == pytest.approx(0.85)


def test_classifier(spark, docs, rows, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = {r.doc_id: r for r in score_quality(table, labels).collect()}
    known = [(out[r.doc_id], r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    assert len(out) == 1000 and all(0 <= r.score <= 1 for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert np.mean([r.predicted == q for r, q in known]) > 0.95
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in score_quality(table, flipped).collect()}
    assert again == {i: r.score for i, r in out.items()}  # held-out labels change nothing
    odd = score_quality(docs, labels.limit(0)).collect()
    assert len(odd) == len(rows) and {r.score for r in odd} == {0.5}
    assert len(score_quality(docs, labels.union(labels.limit(5))).collect()) == len(rows)
    assert score_quality(empty, labels).collect() == []


def plain_isotonic(score, ones, n):
    """The isotonic fit by its definition, max over starts of min over ends of the mean, and the centre of each level."""
    k = len(score)
    mean = lambda a, b: ones[a : b + 1].sum() / n[a : b + 1].sum()
    fit = [max(min(mean(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)]
    levels = sorted(set(np.round(fit, 12)))
    at = [np.flatnonzero(np.round(fit, 12) == v) for v in levels]
    return [(score[a] * n[a]).sum() / n[a].sum() for a in at], levels


def test_classifier_against_plain_fit(spark):
    """Equal scores from one least-squares problem on all rows at once and the isotonic fit by its definition."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    ids = sorted(texts)
    hasher = Hasher(lower=False)
    x = np.concatenate([part for _, _, part in quality_classifier.statistics(pa.array([texts[i] for i in ids], pa.string()), hasher)])
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i in ids])
    marks = {r.doc_id: float(r.quality) for r in labels.collect()}
    y = np.array([marks.get(i, np.nan) for i in ids])
    fits, bends = (fold == 0) & ~np.isnan(y), (fold == 2) & ~np.isnan(y)
    kernel = quality_classifier.Kernel(x[fits].mean(0), x[fits].std(0))
    z = kernel(x)
    share = quality_classifier.RIDGE * (z[fits] ** 2).sum() / z.shape[1]
    pull = np.diag(np.r_[np.full(z.shape[1] - 1, math.sqrt(share)), 0.0])
    weights = np.linalg.lstsq(np.vstack([z[fits], pull]), np.r_[y[fits], np.zeros(len(pull))], rcond=None)[0]
    raw = np.clip(z @ weights, -0.5, 1.5)
    bins = np.floor((raw[bends] + 0.5) / 2 * quality_classifier.BINS).astype(int)
    found = np.unique(bins)
    ones, n = (np.array([f(y[bends][bins == b]) for b in found], float) for f in (np.sum, len))
    want = np.interp(raw, *plain_isotonic((found + 0.5) / quality_classifier.BINS * 2 - 0.5, ones, n))
    got = {r.doc_id: r.score for r in score_quality(table, labels).collect()}
    np.testing.assert_allclose([got[i] for i in ids], want, atol=1e-6)
