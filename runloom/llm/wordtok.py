"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once per worker.

For a word-level vocabulary (white space dropped, word ends marked) the ids of a text are the ids of its words in order:
no pre-token spans white space, and neither normal forms nor lower-casing reach across it. So each worker keeps the ids of
the words that it has met, and gathers them by numpy. Words are given to the library as they are written: lower-casing them
first would let letters join marks that only their small forms can join.
Other vocabularies are encoded text by text.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from runloom.llm.arrow_text import as_list, words_of

#: Words kept per worker; beyond it the worker starts again with an empty table.
MEMO_WORDS = 500_000
#: Latin letters alone or marks alone: exactly one pre-token, so such words can be encoded many at a time.
_PLAIN = r"^([A-Za-zÀ-ÖØ-öø-ÿ]+|[.,;:!?#*%$&|]+)$"
#: A pre-token always begins where one of these marks follows one of these letters or digits, so a space there changes no ids.
#: Both lists are closed: Latin, Greek and Cyrillic letters that stay one letter when normalised and lower-cased (U+0130 doesn't),
#: and punctuation that joins nothing before it. Anything else stays in its word.
_LETTERS = r"A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{481}\x{48A}-\x{4FF}"
_MARKS = rf"([{_LETTERS}])([!-/:-@\[-`{{-~\x{{A1}}\x{{A7}}\x{{AB}}\x{{BB}}\x{{BF}}\x{{2010}}-\x{{2027}}\x{{2030}}-\x{{203E}}])"
_END = "</w>"


class WordTokenizer:
    """Encodes Arrow arrays of texts with the tokenizer file at ``path``."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.by_word = spec["model"].get("end_of_word_suffix") == _END and '"\\\\s+"' in json.dumps(spec["normalizer"])
        self.special = "|".join("".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in t["content"]) for t in spec["added_tokens"]) or r"\z."
        self.vocab_size = self.tok.get_vocab_size()
        self.ends = np.zeros(self.vocab_size, bool)
        for piece, i in self.tok.get_vocab().items():
            self.ends[i] = piece.endswith(_END)
        self.memo_words = memo_words
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def _each(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, words: list[str], group: int = 400) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and sizes of words that are one pre-token each, encoded in joined groups; None if their ends don't show."""
        joined = ["\n".join(words[i : i + group]) for i in range(0, len(words), group)]
        ids = np.concatenate([np.array(x, np.uint32) for x in self._each(joined)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(stops, prepend=0)) if len(stops) == len(words) else None

    def _learn(self, words: pa.Array) -> None:
        plain = pc.match_substring_regex(words, _PLAIN)
        odd, even = as_list(words.filter(pc.invert(plain))), as_list(words.filter(plain))
        if even and (got := self._plain(even)):
            self._add(even, *got)
        else:
            odd += even
        if odd:
            lists = self._each(odd)
            self._add(odd, np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists]))

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.slot), len(self.slot) + len(words)
        if m > len(self.start):
            room = max(m, 2 * len(self.start))
            self.start, self.size = np.resize(self.start, room), np.resize(self.size, room)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, max(self.used + len(ids), 2 * len(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[n:m] = self.used + np.cumsum(sizes) - sizes
        self.size[n:m] = sizes
        self.used += len(ids)
        self.slot.update(zip(words, range(n, m), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (no nulls) as uint32, and each text's bounds in them."""
        whole = pc.match_substring_regex(texts, self.special) if self.by_word else pa.array(np.ones(len(texts), bool))
        if not pc.any(whole).as_py():
            return self._by_word(texts)
        rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        lists = self._each([texts[i].as_py() for i in rows.tolist()])
        ids, bounds = self._by_word(pc.if_else(whole, "", texts)) if self.by_word else (np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64))
        sizes = np.zeros(len(texts), np.int64)
        sizes[rows] = [len(x) for x in lists]
        ids = np.insert(ids, np.repeat(bounds[rows], sizes[rows]), np.array([i for x in lists for i in x], np.uint32))
        return ids, bounds + np.concatenate([[0], np.cumsum(sizes)])

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, bounds, words = words_of(pc.replace_substring_regex(texts, _MARKS, r"\1 \2"))
        names = as_list(words)
        slots = np.fromiter((self.slot.get(w, -1) for w in names), np.int64, len(names))
        if (missing := slots < 0).any():
            if len(self.slot) + missing.sum() > self.memo_words:
                self._clear()
                missing[:] = True
            self._learn(words.filter(pa.array(missing)))
            slots = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))
        # The ids of this step's words come together first, so that the gather below stays in the cache.
        size = self.size[slots].astype(np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        near = self.pool[np.repeat(self.start[slots] - start[:-1], size) + np.arange(start[-1])]
        size = size[codes]
        stop = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(start[codes] - stop[:-1], size) + np.arange(stop[-1])
        return near[where], stop[bounds]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer of ``path``: kept from task to task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokenizer(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text's, and the new bounds."""
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
