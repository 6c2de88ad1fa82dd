"""Operator 7: licences of documents, from their own lines or from the nearest directory above that has one.

Lines and whole texts are compared with licence templates by the cosine of sparse TF-IDF vectors. Words are hashed;
document frequencies are counted over the whole corpus in a table of fixed size, so rare words of the corpus weigh as
much as rare words of a template. Only units whose template words could reach the threshold by themselves get a full
vector. Notices are also compared with each run of words as long as they are, so one that is wrapped or shares its line counts.
A document whose whole text is close to a notice or to the full text of a licence (``licenses/``) is a licence file and
stands for its directory; documents without a licence of their own take that of the nearest directory above them, found
by joining paths.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import keep, row_ranges, share, shared, text_buffer
from lodeline.llm.words import MARKS, Hasher

#: Short notices by which works are put under a licence.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
}

_LATER = "either version {} of the License, or (at your option) any later version."
_GNU = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the "
    "Free Software Foundation, " + _LATER
)

#: The notices that stand at the head of files. The short templates above are parts of some, so one of these goes before them.
NOTICES = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ],
    "GPL-2.0": [_GNU.format("program", "General Public License", "2"), _GNU.replace(_LATER, "version 2 of the License.").format("program", "General Public License")],
    "GPL-3.0": [_GNU.format("program", "General Public License", "3"), _GNU.replace(_LATER, "version 3 of the License.").format("program", "General Public License")],
    "LGPL-2.1": [_GNU.format("library", "Lesser General Public License", "2.1")],
    "LGPL-3.0": [_GNU.format("program", "Lesser General Public License", "3"), _GNU.format("library", "Lesser General Public License", "3")],
    "AGPL-3.0": [_GNU.format("program", "Affero General Public License", "3")],
}

LINE = 0.8
FILE = 0.5
FULL = 0.9  # of full texts; running prose of any kind shares its common words with them
FREQUENCY_BITS = 16


def full_texts() -> dict[str, list[str]]:
    """The full texts of licences."""
    found = {p.stem: [p.read_text()] for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    # no copy of it is here; its words are nearly those of the GPL, but for the name
    found["AGPL-3.0"] = [found["GPL-3.0"][0].replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL")]
    return found


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold a word of each bucket, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, df, n = Hasher(lower=True, separators=MARKS), np.zeros(1 << FREQUENCY_BITS, np.int64), 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            n += batch.num_rows
            for i, j in row_ranges(offsets):
                w = hasher.words(data, offsets[i : j + 1])
                found = _bucket(w.hash)
                for k in range(j - i):
                    df[np.unique(found[w.first[k] : w.first[k + 1]])] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    df = np.zeros((1 << FREQUENCY_BITS) + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r.bucket] = r.n  # one row per bucket; the last is the number of texts
    return df[:-1], int(df[-1])


class Templates:
    """TF-IDF vectors of the templates, and the cosine of units of words with them."""

    def __init__(self, templates: dict[str, list[str]], df: np.ndarray, n: int):
        self.idf = np.log((1 + n) / (1 + df)) + 1
        self.names = [name for name, texts in templates.items() for _ in texts]
        hasher = Hasher(lower=True, separators=MARKS)
        data, offsets = text_buffer(pa.array([t for texts in templates.values() for t in texts], pa.large_string()))
        w = hasher.words(data, offsets)
        self.words, at = np.unique(w.hash, return_inverse=True)
        which = np.repeat(np.arange(len(self.names)), np.diff(w.first))
        self.vectors = np.zeros((len(self.words), len(self.names)))
        np.add.at(self.vectors, (at, which), 1)
        self.vectors *= self.idf[_bucket(self.words)][:, None]
        norm = np.sqrt((self.vectors**2).sum(0))
        self.vectors /= np.where(norm, norm, 1)
        self.reach = self.vectors**2
        self.lengths = np.diff(w.first)

    def _vector(self, h: np.ndarray) -> np.ndarray:
        """The cosine of one unit of words with each template."""
        own, tf = np.unique(h, return_counts=True)
        v = tf * self.idf[_bucket(own)]
        place = np.searchsorted(self.words, own)
        place[place == len(self.words)] = 0
        same = self.words[place] == own
        return (v[same] @ self.vectors[place[same]]) / np.sqrt((v**2).sum())

    def runs(self, h: np.ndarray, first: np.ndarray, least: float) -> Iterator[tuple[int, str, float]]:
        """``(word, licence, cosine)`` of runs that begin at a word, are as long as a template and reach ``least`` with it; none
        crosses from one row, ``first[i]:first[i + 1]``, into the next."""
        if not len(h) or not len(self.words):
            return
        weight = self.idf[_bucket(h)]
        at = np.searchsorted(self.words, h)
        at[at == len(self.words)] = 0
        known = np.flatnonzero(self.words[at] == h)
        power = np.concatenate([[0], np.cumsum(weight**2)])
        for t, n in enumerate(self.lengths.tolist()):
            if not 0 < n <= len(h):
                continue
            part = np.zeros(len(h) + 1)
            part[known + 1] = weight[known] * self.vectors[at[known], t]
            part = np.cumsum(part)
            # repeated words make a vector longer than this, so the cosine can only be too high
            bound = (part[n:] - part[:-n]) >= (least - 1e-6) * np.sqrt(power[n:] - power[:-n])
            starts = np.flatnonzero(bound)
            starts = starts[starts + n <= first[np.searchsorted(first, starts, "right")]]
            for k in starts.tolist():
                cosine = float(self._vector(h[k : k + n])[t])
                if cosine >= least:
                    yield k, self.names[t], cosine

    def match(self, h: np.ndarray, first: np.ndarray, least: float) -> list[tuple[int, str, float]]:
        """``(unit, licence, cosine)`` of units ``first[i]:first[i + 1]`` that reach ``least``; the nearest template each, the
        first of those equally near."""
        at = np.searchsorted(self.words, h)
        at[at == len(self.words)] = 0
        known = np.flatnonzero(self.words[at] == h) if len(self.words) else np.zeros(0, np.int64)
        if not len(known):
            return []
        unit = np.searchsorted(first, known, "right") - 1
        heads = np.flatnonzero(np.diff(unit, prepend=-1))
        # repeated words count again here, so this can only be too high
        bound = np.add.reduceat(self.reach[at[known]], heads).max(1)
        out = []
        for u in unit[heads][bound >= least**2 - 1e-9].tolist():
            cosine = self._vector(h[first[u] : first[u + 1]])
            best = int(np.argmax(np.round(cosine, 12)))
            if cosine[best] >= least:
                out.append((u, self.names[best], float(cosine[best])))
        return out


def _own_licences(rows: DataFrame, templates: tuple[Templates, Templates, Templates], line: float, file: float, full: float) -> DataFrame:
    """``(doc_id, path, own, own_cosine, own_line, whole, whole_cosine)`` for each row; a full text has no line of its own."""
    sent = share(rows.sparkSession, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (known, notices, licences) = Hasher(lower=True, separators=MARKS), shared(sent)
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for i, j in row_ranges(offsets):
                at = offsets[i : j + 1]
                w = hasher.words(data, at)
                feeds = np.flatnonzero(data[at[0] : at[-1]] == 10) + at[0]
                starts = np.unique(np.concatenate([at[:-1], feeds + 1]))
                starts = starts[starts < at[-1]]
                lines = np.append(np.searchsorted(w.start, starts), len(w.hash))
                found = [(u, name, cosine, 1) for u, name, cosine in known.match(w.hash, lines, line)]
                for some, rank in ((notices, 0), (known, 1)):
                    for k, name, cosine in some.runs(w.hash, w.first, line):
                        found.append((int(np.searchsorted(starts, w.start[k], "right")) - 1, name, cosine, rank))
                header: dict[int, tuple] = {}
                # long notices before short ones, then the nearest, then the first line
                for u, name, cosine, _ in sorted(found, key=lambda x: (x[3], -round(x[2], 12), x[0])):
                    row = int(np.searchsorted(at, starts[u], "right")) - 1
                    header.setdefault(row, (name, cosine, u - int(np.searchsorted(starts, at[row]))))
                whole = {u: (name, c) for u, name, c in known.match(w.hash, w.first, file)}
                whole |= {u: (name, c) for u, name, c in notices.match(w.hash, w.first, full)}
                for u, name, c in licences.match(w.hash, w.first, full):
                    whole[u] = (name, c)
                    header.pop(u, None)  # what it quotes says nothing that it does not say itself
                none = (None, None, None)
                mine, its = [header.get(k, none) for k in range(j - i)], [whole.get(k, none) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([x[0] for x in mine], pa.string()),
                     pa.array([x[1] for x in mine], pa.float64()), pa.array([x[2] for x in mine], pa.int64()),
                     pa.array([x[0] for x in its], pa.string()), pa.array([x[1] for x in its], pa.float64())],
                    names=["doc_id", "path", "own", "own_cosine", "own_line", "whole", "whole_cosine"],
                )

    kind = "doc_id long, path string, own string, own_cosine double, own_line long, whole string, whole_cosine double"
    return rows.select("doc_id", "path", "text").mapInArrow(run, kind)


def _above(path):
    """The directories of a path, nearest first: ``a/b/c`` has ``a/b``, ``a`` and the root, which is empty."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def scan_licenses(
    docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None,
    line: float = LINE, file: float = FILE, notices: dict[str, list[str]] | None = None, licences: dict[str, list[str]] | None = None,
    full: float = FULL,
) -> DataFrame:
    """``(doc_id, path, license, origin, similarity, line, directory)`` for every row of ``docs``.

    ``origin`` is ``header`` for a line of the document within cosine ``line`` of a template, or a run of words within it of a
    template or notice of that length; ``file`` for a whole text within ``file`` of a template, or within ``full`` of one of
    the ``licences``, which goes before any header; ``directory`` for a licence taken from the nearest directory above the document in which a licence
    file lies (the document's own directory first), else ``none``; a whole text within ``full`` of a notice is a licence file
    as well. ``line`` counts from 0 and is where a run begins; ``similarity`` is the cosine of what
    was found. Long notices go before short templates; the best of several lines counts, then the first; of several files of one directory the nearest to
    its template, then the licence first by name. ``path`` names the column of paths, with ``/`` between their parts; a
    null path is at the root. Null and empty texts have no licence of their own. Repeated rows each give a row, an
    empty table none.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(text).alias("text"))
    df, n = document_frequency(rows)
    texts = (TEMPLATES if templates is None else templates, NOTICES if notices is None else notices, full_texts() if licences is None else licences)
    own, _ = keep(_own_licences(rows, tuple(Templates(x, df, n) for x in texts), line, file, full), "licences")
    own = own.withColumn("dir", F.element_at(_above(F.col("path")), 1))
    files = own.where("whole is not null").groupBy("dir", "whole").agg(F.max(F.round("whole_cosine", 9)).alias("c"))
    files = files.groupBy("dir").agg(F.min(F.struct((-F.col("c")).alias("c"), "whole")).alias("best"))
    files = files.select(F.col("dir").alias("above"), F.col("best.whole").alias("license"), (-F.col("best.c")).alias("cosine"))
    further = F.when(F.col("dir") != "", _above(F.col("dir"))).otherwise(F.array())
    up = own.select("dir").distinct().select("dir", F.posexplode(F.concat(F.array("dir"), further)).alias("steps", "above"))
    nearest = up.join(files, "above").groupBy("dir").agg(F.min(F.struct("steps", "above", "license", "cosine")).alias("up"))
    nearest, _ = keep(nearest, "directories")  # written, so that Spark can split a directory that very many documents are in
    out = own.join(nearest, "dir", "left")
    origin = F.when(F.col("own").isNotNull(), "header").when(F.col("whole").isNotNull(), "file").when(F.col("up").isNotNull(), "directory").otherwise("none")
    return out.select(
        "doc_id", "path", F.coalesce("own", "whole", "up.license").alias("license"), origin.alias("origin"),
        F.round(F.coalesce("own_cosine", "whole_cosine", "up.cosine"), 9).alias("similarity"), F.col("own_line").alias("line"),
        F.when(F.col("own").isNull() & F.col("whole").isNull(), F.col("up.above")).alias("directory"),
    )
