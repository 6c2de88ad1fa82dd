"""Two Bloom filters over 64-bit keys: one for keys seen once, one for keys seen twice or more.

Each task fills both for about a million keys and sends them in segments, as lists of positions where they are thin.
Merging two parts keeps the rule ``twice = twice | other.twice | (once & other.once)``, so a key of two tasks is always
in the second filter. Only that one goes back to the tasks. Its size is fixed; where it fills up, more keys pass as
suspected, and results stay the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeline.llm.common import mix

BITS = 26  # of an address: 2**26 bits are 8 MB for each filter
SEGMENT = 16  # of an address within a segment: 65,536 bits
FLUSH = 1 << 20
_BYTES = (1 << SEGMENT) // 8


def _addresses(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - BITS)
    return keys >> shift, mix(keys + np.uint64(0x9E3779B97F4A7C15)) >> shift


def _pack(places: np.ndarray) -> bytes:
    if len(places) < _BYTES // 2:
        return places.astype("<u2").tobytes()
    bits = np.zeros(1 << SEGMENT, bool)
    bits[places] = True
    return np.packbits(bits).tobytes()


def _unpack(part: bytes) -> np.ndarray:
    if len(part) == _BYTES:
        return np.frombuffer(part, np.uint8)
    bits = np.zeros(1 << SEGMENT, bool)
    bits[np.frombuffer(part, "<u2")] = True
    return np.packbits(bits)


def _segments(addresses: np.ndarray) -> dict[int, np.ndarray]:
    addresses = np.unique(addresses)
    which = (addresses >> np.uint64(SEGMENT)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(which)) + 1
    places = (addresses & np.uint64((1 << SEGMENT) - 1)).astype(np.int64)
    starts = [0, *cuts.tolist()]
    return {int(which[a]): p for a, p in zip(starts, np.split(places, cuts))} if len(addresses) else {}


def _part(keys: np.ndarray) -> pa.RecordBatch:
    keys, count = np.unique(keys, return_counts=True)
    once = _segments(np.concatenate(_addresses(keys)))
    twice = _segments(np.concatenate(_addresses(keys[count > 1])))
    names = sorted(once)
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_pydict(
        {"segment": pa.array(names, pa.int32()), "once": pa.array([_pack(once[s]) for s in names], pa.binary()),
         "twice": pa.array([_pack(twice.get(s, none)) for s in names], pa.binary())}
    )


def twice_seen(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The filter of keys that two rows or more hold; ``keys`` gives a batch's keys, each as often as it should count."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            found = keys(batch)
            for i in range(0, len(found), FLUSH):
                held.append(found[i : i + FLUSH])
                n += len(held[-1])
                if n >= FLUSH:
                    yield _part(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield _part(np.concatenate(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                a, b = _unpack(a), _unpack(b)
                twice[s] = twice[s] | b | (once[s] & a) if s in once else b
                once[s] = once[s] | a if s in once else a
        for s, bits in twice.items():
            if bits.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "bits": pa.array([bits.tobytes()])})

    split = df.mapInArrow(parts, "segment int, once binary, twice binary").repartition("segment")
    out = np.zeros((1 << (BITS - SEGMENT), _BYTES), np.uint8)
    for row in split.mapInArrow(merge, "segment int, bits binary").toLocalIterator():
        out[row.segment] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def holds(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may have been seen twice. Never false for one that was."""
    a, b = (x.astype(np.int64) for x in _addresses(keys))
    hit = lambda x: (filter_[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1
    return (hit(a) & hit(b)).astype(bool)
