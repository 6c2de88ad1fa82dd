"""The pipeline's stages against plain versions on the smallest tables."""

import os
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodeline.llm.catalog import tokenizer, trusted
from lodeline.llm.mixing import plan_mix
from lodeline.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "token_files":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append((name, docs, out := spark.read.parquet(f"{tmp_path}/{name}")))
        docs = out
    assert list(stages) == [n for n, _, _ in seen]
    rows = {n: ([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]) for n, a, b in seen}

    table = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality_rules(seen[0][1], trusted(table)).where("kept").collect()}
    assert {r[0] for r in rows["quality_rules"][1]} == kept

    before, after = ({r[0]: r for r in x} for x in rows["near_duplicates"])
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in ((i, words(r[1])) for i, r in before.items())}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b) if a and b else False
    for i in before:
        twins = [j for j in before if j != i and near(sets[i], sets[j])]
        assert i in after or any(j < i for j in twins) or len(twins) > 1
        if i in after:
            assert not any(j in after for j in twins)

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r[0] for r in rows["decontamination"][0]} - {r[0] for r in rows["decontamination"][1]}
    assert gone == {r[0] for r in rows["decontamination"][0] if any(x in r[1] for x in items)}

    copies = Counter({r.doc_id: r.copies for r in plan_mix(seen[3][1]).collect()})
    assert Counter(r[0] for r in rows["mixing"][1]) == +copies

    plain, at = Tokenizer.from_buffer(tokenizer()), 0
    tokens = sorted(rows["token_files"][1], key=lambda r: r[1])
    for r, doc in zip(tokens, sorted(rows["mixing"][1]), strict=True):
        n = len(plain.encode(doc[1], add_special_tokens=False).ids) + 1
        assert r[:3] == (doc[0], at, n)
        at += n


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_null_and_repeated_ids(spark):
    plain = lambda seed: " ".join(f"w{seed}x{k}" for k in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    near = plain(1) + " more"
    rows = [
        (1, plain(1)), (2, near), (2, plain(2)), (3, plain(3)), (3, plain(3) + " more"), (None, plain(4)), (None, plain(4)), (None, plain(5)),
        (4, plain(5) + " more"), (None, plain(6)), (None, plain(6) + " more"), (5, ""), (6, ""), (7, None), (None, None), (8, plain(8)), (8, plain(8)),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect())
    assert max(got.values()) == 1
    sure = {(1, plain(1)), (2, plain(2)), (None, plain(4)), (4, plain(5) + " more"), (5, ""), (6, ""), (7, None), (None, None), (8, plain(8))}
    either = [{(3, plain(3)), (3, plain(3) + " more")}, {(None, plain(6)), (None, plain(6) + " more")}]
    assert set(got) - set().union(*either) == sure and all(len(set(got) & two) == 1 for two in either)

    rows = [(1, f"{plain(1)} {item}"), (1, plain(1)), (None, f"{plain(2)} {item} {plain(3)}"), (None, plain(2)), (None, None), (2, ""), (2, plain(2)), (2, plain(2))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], df.schema)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, df, SF).collect())
    assert got == Counter((i, t) for i, t in rows if item not in (t or ""))


def test_clashing_columns(spark):
    """Columns with the names that stages use inside keep their values."""
    names = ["row_key", "mix_copies", "mix_copy", "mix_id", "mix_row", "_mix_copies", "component", "component_id", "place", "key", "copies"]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", 0, *(f"{n}{i}" for n in names)) for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame(rows, schema)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontaminate, corpus_pipeline.mix):
        got = stage(spark, df, SF)
        assert got.columns == df.columns
        assert {tuple(r) for r in got.collect()} == set(rows), stage.__name__
