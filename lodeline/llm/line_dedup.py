"""Operator 10: dropping lines that many documents share.

A line's key is its text without white space at both ends, A-Z in lower case. Two Bloom filters over the keys of all
documents, one for those seen once and one for those seen twice, leave few suspects. Only suspects are shuffled: as
128-bit digests they are counted exactly and get the document that keeps them. Each document then gets the digests that
it loses.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import SPACES, keep, slices
from lodeline.llm.seen import holds, twice_seen

_STRIP = "".join(map(chr, SPACES))


def _digest(key: str) -> bytes:
    return blake2b(key.encode().lower(), digest_size=16).digest()  # of bytes, lower() changes A-Z alone


def _digests(text: str | None, least: int) -> set[bytes]:
    """Digests of a document's keys that are long enough."""
    keys = (line.strip(_STRIP) for line in (text or "").split("\n") if len(line) >= least)
    return {_digest(k) for k in keys if len(k) >= least}


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8")[::2].astype(np.uint64)


def drop_repeated_lines(
    docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, kept, n_lines, n_dropped, kept_sha256)`` for every row; ``kept`` is the text that stays.

    Keys of at least ``least_chars`` code points that at least ``least_docs`` documents (distinct ids) hold lose all their
    lines, except those in the largest id that holds them. A null or empty text is one empty line. Rows that repeat an
    id are one document for the counts and each keep or lose the same keys. Rows without an id count for no key and
    lose every line whose key is dropped elsewhere. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("at", F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")))

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        texts = (t for part in slices(batch) for t in part.column(0).to_pylist())
        return _words([d for t in texts for d in _digests(t, least_chars)])

    seen = spark.sparkContext.broadcast(twice_seen(docs.select("text"), keys))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows, out = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                own = list(_digests(t, least_chars))
                if own:
                    hit = holds(seen.value, _words(own))
                    out += [d for d, h in zip(own, hit) if h]
                    rows += [k] * int(hit.sum())
            ids, at = (batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 2))
            yield pa.RecordBatch.from_arrays([ids, at, pa.array(out, pa.binary())], names=["doc_id", "at", "digest"])

    found, _ = keep(docs.mapInArrow(suspects, "doc_id long, at string, digest binary"), "suspects")
    found = found.distinct()
    shared = found.where("doc_id is not null").groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    shared = shared.where(F.col("n") >= least_docs).select("digest", "last")
    lost = found.join(shared.hint("merge"), "digest").where("doc_id is null or doc_id <> last")
    lost = lost.groupBy("at").agg(F.collect_set("digest").alias("lost"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                kept, lines_, dropped = [], [], []
                for t, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    lines = (t or "").split("\n")
                    gone = set(gone or ())
                    stay = lines
                    if gone:
                        stay = [x for x in lines if len(k := x.strip(_STRIP)) < least_chars or _digest(k) not in gone]
                    kept.append("\n".join(stay))
                    lines_.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                sha = [sha256(k.encode()).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.string()), pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)],
                    names=["doc_id", "kept", "n_lines", "n_dropped", "kept_sha256"],
                )

    joined = docs.join(lost.hint("merge"), "at", "left").select("doc_id", "text", "lost")
    return joined.mapInArrow(clean, "doc_id long, kept string, n_lines long, n_dropped long, kept_sha256 string")
