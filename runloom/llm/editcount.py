"""Edit-aware token counts: a segment tree of pre-tokens per document, updated where edits touch it.

A document is cut into pre-tokens once; leaves of about ``LEAF`` pre-tokens hold their characters and tokens, inner nodes
the sums. An edit (at, cut, add: code points) finds its leaves by descending the character sums, and only they are cut and
encoded again, with the leaf before as left context, since a pre-token may look one character ahead, and further leaves to
the right until a new pre-token boundary meets an old leaf boundary: from there on nothing can differ, as a cut depends on
what follows it alone. Then the sums above the changed leaves are updated. A leaf that outgrows 2 * ``LEAF`` pre-tokens is split.

Trees are rows: ``plant`` makes them, ``apply_edits`` gives them back edited, and both can be stored in between, so a later batch
of edits (join it to the trees by id) encodes only what it touches.

Edits of a document apply in their order, each to the text that the ones before it left; places beyond the text are taken
as its end. Null text is the empty text, null edits are no edits. Rows that repeat a document are counted each by itself;
a null id is kept as it is, other columns are ignored, an empty table gives no rows. ``edit`` keeps leaves in their places, so a leaf
that an edit empties stays, with zeros, until its tree is stored or split.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.arrow_text import as_array, as_list, steps

LEAF = 32
_WORD = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Distinct pre-tokens that a worker remembers the size of.
MEMO = 1_500_000
#: Columns of a stored tree's leaves (characters, tokens and pre-tokens of each), and of the counts.
LEAVES = ("leaf_chars", "leaf_tokens", "leaf_pretokens")
TREE = "text string, " + ", ".join(f"{c} array<int>" for c in LEAVES)
COUNTS = ("n_tokens", "n_tokens_edited", "n_pretokens_edited", "n_chars_edited", "n_chars_encoded")


class PreTokens:
    """Cuts texts into pre-tokens and counts the tokens of each; sizes of pre-tokens met are kept."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.cut = regex.compile(pattern).findall
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.size: dict[str, int] = {}
        vocab = self.tok.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for piece, i in vocab.items() if piece.startswith("Ġ")]] = True

    def learn(self, pretokens: set[str]) -> None:
        """Remembers the sizes of these pre-tokens."""
        new = [t for t in pretokens if t not in self.size]
        if len(self.size) + len(new) > MEMO:
            self.size.clear()
            new = list(pretokens)
        words = [t for t in new if _WORD(t)]
        rest = [t for t in new if not _WORD(t)]
        if words:
            # a space and letters: pre-tokens that stay apart when written one after the other, each begun by a mark of the space
            joined = ["".join(words[i : i + 400]) for i in range(0, len(words), 400)]
            ids = np.concatenate([np.array(e.ids) for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)])
            first = np.flatnonzero(self.begins[ids])
            if len(first) == len(words):
                self.size.update(zip(words, np.diff(first, append=len(ids)).tolist(), strict=True))
            else:
                rest += words
        if rest:
            self.size.update(zip(rest, (len(e.ids) for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)), strict=True))

    def counts(self, pretokens: list[str]) -> list[int]:
        try:
            return [self.size[t] for t in pretokens]
        except KeyError:
            self.learn(set(pretokens))
            return [self.size[t] for t in pretokens]


class CountTree:
    """The segment tree of one document, from its text and the characters, tokens and pre-tokens of its leaves."""

    def __init__(self, text: str, by: PreTokens, leaves: np.ndarray, leaf: int = LEAF):
        self.by, self.text, self.leaf, self.encoded = by, text, leaf, 0
        self._grow(leaves)

    @classmethod
    def of(cls, text: str, by: PreTokens, leaf: int = LEAF, pretokens: list[str] | None = None) -> CountTree:
        """The tree of a text that is cut and counted here."""
        return cls(text, by, leaves_of(by.cut(text) if pretokens is None else pretokens, by, leaf), leaf)

    def _grow(self, leaves: np.ndarray) -> None:
        """Builds the inner sums above these leaves (3 rows: characters, tokens, pre-tokens); nothing is encoded."""
        self.leaves = max(1, leaves.shape[1])
        self.base = 1 << (self.leaves - 1).bit_length()
        self.sums = np.zeros((3, 2 * self.base), np.int64)
        self.sums[:, self.base : self.base + leaves.shape[1]] = leaves
        level = self.base
        while level > 1:
            level //= 2
            self.sums[:, level : 2 * level] = self.sums[:, 2 * level : 4 * level].reshape(3, -1, 2).sum(2)
        self.chars = self.sums[0]

    def kept(self) -> np.ndarray:
        """The filled leaves, to be stored."""
        leaves = self.sums[:, self.base : self.base + self.leaves]
        return leaves[:, leaves[0] > 0]

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds code point ``place`` (or the last one), and where it begins."""
        node, before = 1, 0
        while node < self.base:
            node *= 2
            if place >= before + self.chars[node] and node + 1 < 2 * self.base and self.chars[node + 1]:
                before += int(self.chars[node])
                node += 1
        return node - self.base, before

    def _set(self, leaf: int, sums: tuple[int, int, int]) -> None:
        node = leaf + self.base
        self.sums[:, node] = sums
        while node > 1:
            node //= 2
            self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]

    def edit(self, at: int, cut: int, add: str) -> None:
        """Replaces ``cut`` code points from ``at`` by ``add`` and updates the counts."""
        old = self.text
        at = min(max(at, 0), len(old))
        stop = min(at + max(cut, 0), len(old))
        self.text = old[:at] + add + old[stop:]
        shift = len(add) - (stop - at)
        first, begin = self._leaf_at(max(0, at - 1))
        # what precedes may look ahead over the edit: take the nearest filled leaf before as well
        before = first - 1
        while before >= 0 and not self.chars[before + self.base]:
            before -= 1
        if before >= 0:
            begin -= int(self.chars[before + self.base])
            first = before
        last, edge = first, begin + int(self.chars[first + self.base])
        while edge < stop and last + 1 < self.leaves:
            last += 1
            edge += int(self.chars[last + self.base])
        while True:
            # one leaf more than needed is cut, so that the cut at the edge has seen what follows it
            ahead, beyond = edge, last
            while beyond + 1 < self.leaves and ahead == edge:
                beyond += 1
                ahead += int(self.chars[beyond + self.base])
            pretokens = self.by.cut(self.text[begin : ahead + shift])
            self.encoded += ahead + shift - begin
            if ahead == edge:
                break
            ends = np.cumsum(np.fromiter(map(len, pretokens), np.int64, len(pretokens)))
            hit = int(np.searchsorted(ends, edge + shift - begin))
            if edge + shift == begin or (hit < len(ends) and ends[hit] == edge + shift - begin):
                pretokens = pretokens[: hit + 1] if edge + shift > begin else []
                break
            edge, last = ahead, beyond
        if len(pretokens) <= 2 * self.leaf:
            self._set(first, (edge + shift - begin, sum(self.by.counts(pretokens)), len(pretokens)))
            for leaf in range(first + 1, last + 1):
                if self.chars[leaf + self.base]:
                    self._set(leaf, (0, 0, 0))
        else:  # the region outgrew its leaf: it is split, and the sums are built anew above the leaves that are there
            old = self.sums[:, self.base : self.base + self.leaves]
            parts = np.hstack([old[:, :first], leaves_of(pretokens, self.by, self.leaf), old[:, last + 1 :]])
            self._grow(parts[:, parts[0] > 0])


def leaves_of(pretokens: list[str], by: PreTokens, leaf: int = LEAF) -> np.ndarray:
    """Characters, tokens and number of every ``leaf`` pre-tokens, as three rows."""
    if not pretokens:
        return np.zeros((3, 0), np.int64)
    n = len(pretokens)
    head = np.arange(0, n, leaf)
    chars = np.fromiter(map(len, pretokens), np.int64, n)
    return np.stack([np.add.reduceat(chars, head), np.add.reduceat(np.array(by.counts(pretokens), np.int64), head), np.diff(head, append=n)])


@lru_cache(maxsize=2)
def pre_tokens(path: str, pattern: str) -> PreTokens:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PreTokens(path, pattern)


def plant(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segment trees of all documents, one row each: id, text, and an array per sum of the leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = pre_tokens(path, pattern)
        for batch in batches:
            for part in steps(batch, "text"):
                texts = as_array(part.column(1))
                cut = [by.cut(t) for t in as_list(texts)]
                by.learn(set().union(*cut))
                yield pa.RecordBatch.from_arrays([part.column(0), texts, *_lists([leaves_of(c, by) for c in cut])], ["id", "text", *LEAVES])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {TREE}")


def apply_edits(trees: DataFrame, path: str, pattern: str, edits_col: str = "edits", keep_trees: bool = True) -> DataFrame:
    """Trees (rows of ``plant`` or of this function) after the edits of their column ``edits_col``, with the counts.

    ``edits_col``: array of structs (at int, cut int, add string) in the order they apply. Per row: id, n_tokens before the
    edits, n_tokens, n_pretokens and n_chars after them, n_chars_encoded for them; with ``keep_trees`` the edited text and leaves
    too, to be stored for the next batch of edits. Nothing but what the edits touch is cut or encoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = pre_tokens(path, pattern)
        for batch in batches:
            for part in steps(batch, "text"):
                rows, done = [], []
                bounds = np.concatenate([[0], np.cumsum(part.column(2).value_lengths().to_numpy(zero_copy_only=False))])
                leaves = np.stack([part.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3, 4)]).astype(np.int64)
                for k, (text, edits) in enumerate(zip(as_list(as_array(part.column(1))), part.column(5).to_pylist(), strict=True)):
                    tree = CountTree(text, by, leaves[:, bounds[k] : bounds[k + 1]])
                    before = tree.total
                    for e in edits or ():
                        tree.edit(e["at"] or 0, e["cut"] or 0, e["add"] or "")
                    rows.append((before, tree.total, int(tree.sums[2, 1]), len(tree.text), tree.encoded))
                    if keep_trees:
                        done.append((tree.text, tree.kept()))
                table = np.array(rows, np.int64).reshape(-1, len(COUNTS))
                own = [pa.array([t for t, _ in done], pa.string()), *_lists([x for _, x in done])] if keep_trees else []
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(table[:, k]) for k in range(len(COUNTS))), *own], ["id", *COUNTS, *(["text", *LEAVES] if keep_trees else [])])

    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    columns = trees.select("id", "text", *LEAVES, F.col(edits_col).alias("edits"))
    return columns.mapInArrow(run, f"id {dict(trees.dtypes)['id']}, {counts}" + (f", {TREE}" if keep_trees else ""))


def _lists(leaves: list[np.ndarray]) -> list[pa.Array]:
    """One list column per sum, from the leaves of every row."""
    offsets = pa.array(np.cumsum([0, *(x.shape[1] for x in leaves)]).astype(np.int32))
    every = np.hstack([np.zeros((3, 0), np.int64), *leaves]).astype(np.int32)
    return [pa.ListArray.from_arrays(offsets, pa.array(row)) for row in every]
