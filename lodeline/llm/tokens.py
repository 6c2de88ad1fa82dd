"""Token ids of whole texts through a bounded cache of space-separated chunks.

In byte-level BPE with its usual pattern, a text always breaks before a single space that has no white space beside it,
and on both sides of such a line feed. So the ids of ``a text`` are those of its chunks, each with the space before it,
one after the other. Arrow finds the distinct chunks of a column, and a mark after letters is taken off them, so the
library sees ``word``, ``word.`` and ``word,`` once. Words that are met again cost a dictionary lookup: workers remember
two generations of them; when the younger is full it becomes the older, and what is met again moves back, so common
words are never lost. A text in which white space meets white space, or that begins or ends with it, goes to the library
whole, and so does every text of a tokenizer with other rules.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodeline.llm.common import worker_store

WORDS = 1 << 19  # of a generation
#: Bytes of text that are encoded at a time.
PIECE = 1 << 22
#: Marks that, alone after a word, are a piece of their own.
MARKS = ".,;:!?"
#: Letters that every Unicode version knows, then a mark.
_MARKED = f"^(?P<word>\n?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)(?P<mark>[{MARKS}])$"


def _byte_names() -> dict[int, str]:
    """The characters that byte-level vocabularies use for bytes which are not printable in Latin-1."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


def load(content: bytes):
    """The tokenizer of a file's content, parsed once for each worker."""
    from tokenizers import Tokenizer

    store, key = worker_store(), ("tokenizer", sha256(content).digest())
    if key not in store:
        tokenizer = Tokenizer.from_buffer(content)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        store[key] = tokenizer
    return store[key], key


def splits_at_spaces(content: bytes) -> bool:
    """Whether chunks can be encoded one by one: byte-level, with its own pattern, nothing that rewrites the text."""
    x = json.loads(content)
    pre = x.get("pre_tokenizer") or {}
    plain = not x.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    added = x.get("added_tokens") or []
    plain = plain and (x.get("model") or {}).get("type") == "BPE"
    odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in added)
    lettered = any(all(c.isalpha() or c in MARKS for c in t["content"]) for t in added)
    return bool(plain and not odd and not lettered)


def _letters(word: str) -> bool:
    """Whether all are letters that every Unicode version knows."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class _Words:
    """Values of words, found when they are first asked for, in two generations; ``frequent`` ones are kept always."""

    def __init__(self, find: Callable[[list[str]], list], frequent: dict | None = None):
        self.find, self.frequent, self.younger, self.older = find, frequent or {}, {}, {}

    def __call__(self, words: list[str]) -> list:
        if len(self.younger) >= WORDS:
            self.younger, self.older = {}, self.younger
        values = list(map(self.younger.get, words))
        new = []
        for k in [k for k, v in enumerate(values) if v is None]:
            value = self.frequent.get(words[k])
            if value is None and (value := self.older.get(words[k])) is None:
                new.append(k)
            values[k] = self.younger[words[k]] = value
        for k, value in zip(new, self.find([words[k] for k in new])):
            values[k] = self.younger[words[k]] = value
        return values


class Encoder:
    """Ids of texts, or their numbers where ``width`` is None.

    Arrow splits a column into chunks and finds the distinct ones, so Python sees each of them once for a column; the ids
    of texts are then gathered from theirs. A chunk is what stands between single spaces, with the line feed before it
    if it begins a line. ``frequent`` holds values that the caches never lose.
    """

    def __init__(self, content: bytes, width: int | None, frequent: dict | None = None):
        self.tokenizer, key = load(content)
        self.width = width
        self.pack = as_bytes(width) if width else len
        self.chunked = splits_at_spaces(content)
        if self.chunked:
            self.names, self.model = _byte_names(), self.tokenizer.model
            self.feed, *self.marks = (self.pack(i) for i in self.ids(["\n", *MARKS]))
            self.words = worker_store().setdefault((key, width), _Words(self._find, frequent))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, words: list[str]) -> list:
        """Values with the space or the line feed before each; False where it cannot be encoded apart from its neighbours."""
        model, pack, space, out = self.model.tokenize, self.pack, self.names[0x20], []
        for word in words:
            first = word[:1] == "\n"
            bare = word[1:] if first else word
            if not bare or bare[0].isspace() or bare[-1].isspace():
                out.append(False)
                continue
            if _letters(bare):  # one piece, which the model can take without splitting it first
                plain = bare if bare.isascii() else bare.encode().decode("latin-1").translate(self.names)
                value = pack([t.id for t in model(plain if first else space + plain)])
            else:
                value = pack(self.tokenizer.encode(bare if first else " " + bare, add_special_tokens=False).ids)
            out.append(self.feed + value if first else value)
        return out

    def _found(self, column: pa.Array):
        """Rows' bounds among the chunks, each chunk's word and mark (none: the last), the words' values, rows to encode whole."""
        lines = pc.replace_substring(column, "\n", " \n")
        parts = pc.split_pattern(pc.binary_join_element_wise("\n", lines, ""), " ")
        chunks = parts.flatten().dictionary_encode()
        marked = pc.extract_regex(chunks.dictionary, _MARKED)
        words = pc.coalesce(pc.struct_field(marked, "word"), chunks.dictionary).dictionary_encode()
        marks = pc.fill_null(pc.index_in(pc.struct_field(marked, "mark"), pa.array(list(MARKS))), len(MARKS))
        rows = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        which = chunks.indices.to_numpy()
        word, mark = words.indices.to_numpy()[which], marks.to_numpy()[which]
        values = self.words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        alone = np.fromiter((v is False for v in values), bool, len(values))[word]
        return rows, word, mark, values, np.flatnonzero(np.logical_or.reduceat(alone, rows[:-1]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each row begins and ends in them. Null counts as empty."""
        kind, column = f"<u{self.width}", pc.fill_null(column, "")
        if not len(column) or not self.chunked:
            found = self.ids(column.to_pylist())
            bounds = np.cumsum([0, *map(len, found)])
            return np.concatenate([np.zeros(0, kind), *(np.array(f, kind) for f in found)]), bounds
        rows, word, mark, values, whole = self._found(column)
        alone = [self.pack(f) for f in self.ids([column[int(k)].as_py() for k in whole])]
        table = [*(v or b"" for v in values), *self.marks, b"", *alone]
        flat = np.frombuffer(b"".join(table), kind)
        size = np.fromiter(map(len, table), np.int64, len(table)) // self.width
        start = np.cumsum(size) - size
        entry = np.stack([word, mark + len(values)], 1).reshape(-1).astype(np.int64)  # each chunk's word, then its mark
        at, n, rows = start[entry], size[entry], 2 * rows
        feed = len(self.feed) // self.width  # before a text's first line
        at[rows[:-1]] += feed
        n[rows[:-1]] -= feed
        for k, row in enumerate(whole.tolist(), len(table) - len(alone)):
            n[rows[row] : rows[row + 1]] = 0
            at[rows[row]], n[rows[row]] = start[k], size[k]
        ends = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(at - ends[:-1], n) + np.arange(ends[-1])], ends[rows]

    def count(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each row. Null counts as empty."""
        column = pc.fill_null(column, "")
        if not len(column) or not self.chunked:
            return np.array(list(map(len, self.ids(column.to_pylist()))), np.int64)
        rows, word, mark, values, whole = self._found(column)
        sizes = np.array(values, np.int64)[word] + np.array([*self.marks, 0], np.int64)[mark]
        n = np.add.reduceat(sizes, rows[:-1]) - self.feed
        n[whole] = list(map(len, self.ids([column[int(k)].as_py() for k in whole])))
        return n


def as_bytes(width: int) -> Callable[[list[int]], bytes]:
    """Packs ids as little-endian unsigned integers."""
    letter = {2: "H", 4: "I"}[width]
    return lambda ids: struct.pack(f"<{len(ids)}{letter}", *ids)
