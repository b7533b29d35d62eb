"""Sampled SentencePiece segmentations by forward filtering and backward sampling over the piece lattice.

The lattice of a text has an edge for every vocabulary piece that its bytes spell, weighted by the piece's place in the
vocabulary's own order (``(1 + rank) ** -exponent``). A character that no piece spells alone is a chain of byte pieces.
Spaces are the pieces' word mark, written without a leading one, and a word mark in the text itself goes by byte pieces, so
decoding gives back every byte of the text. No piece crosses into a space or over a line feed, so the lattice of a text
is a chain of independent ones, one per chunk; equal chunks share their forward weights and are sampled separately.

Draws are a hash of the row's key, the seed and the place in the text: a row's segmentation doesn't depend on partitions,
order or other rows, and rows that repeat a key and a text get the same one. Null and empty texts have no pieces. Texts
without spaces are one long chunk, handled as such. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.arrow_text import as_array, mix64, steps
from runloom.llm.tokens_io import id_crcs

EXPONENT = 1.3
_MARK, _SPACE, _FEED = "▁", 32, 10
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class PieceLattice:
    """The vocabulary as a byte trie with weights."""

    def __init__(self, path: str, exponent: float = EXPONENT):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        self.bytes_of: list[bytes] = [b""] * n
        plain = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append(i)
                self.bytes_of[i] = piece.replace(_MARK, " ").encode()
        for i in plain:
            if b"\n" in self.bytes_of[i] or b" " in self.bytes_of[i].lstrip(b" "):
                raise ValueError("a piece crosses words")
        plain.sort(key=lambda i: (-sp.get_score(i), i))
        self.log_weight = np.full(n, -exponent * np.log(1.0 + n))
        self.log_weight[plain] = -exponent * np.log(1.0 + np.arange(len(plain)))
        child: list[dict[int, int]] = [{}]
        self_piece = [-1]
        for i in plain:
            at = 0
            for b in self.bytes_of[i]:
                nxt = child[at].get(b)
                if nxt is None:
                    nxt = child[at][b] = len(child)
                    child.append({})
                    self_piece.append(-1)
                at = nxt
            self_piece[at] = i
        self.child = np.zeros((len(child), 256), np.int32)
        for s, row in enumerate(child):
            for b, t in row.items():
                self.child[s, b] = t
        self.piece = np.array(self_piece, np.int32)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def edges(self, raw: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All edges of the lattices over ``raw``: first byte, byte after the last, piece. ``stop``: each byte's chunk end."""
        at = np.arange(len(raw))
        state = np.zeros(len(raw), np.int32)
        width = np.where(raw < 0x80, 1, np.where(raw >= 0xF0, 4, np.where(raw >= 0xE0, 3, 2)))
        first = (raw & 0xC0) != 0x80
        spelled = np.zeros(len(raw), bool)
        at = at[first]
        state = state[first]
        depth, out = 0, []
        while len(at):
            inside = at + depth < stop[at]
            at, state = at[inside], state[inside]
            state = self.child[state, raw[at + depth]]
            alive = state > 0
            at, state = at[alive], state[alive]
            depth += 1
            piece = self.piece[state]
            hit = piece >= 0
            out.append((at[hit], np.full(int(hit.sum()), depth), piece[hit]))
            spelled[at[hit & (width[at] == depth)]] = True
        lone = np.flatnonzero(~spelled[np.maximum.accumulate(np.where(first, np.arange(len(raw)), 0))]) if len(raw) else np.zeros(0, np.int64)
        out.append((lone, np.ones(len(lone), np.int64), self.byte_id[raw[lone]]))
        begin = np.concatenate([x[0] for x in out])
        return begin, begin + np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])

    def filter_forward(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Incoming edges of every node, node by node: first edge of a node, cumulative probabilities, begin nodes, pieces.

        Chunk c has the nodes bounds[c] + c to bounds[c + 1] + c; the first is its beginning.
        """
        n = np.diff(bounds)
        chunk = np.repeat(np.arange(len(n)), n)
        begin, end, piece = self.edges(raw, bounds[1:][chunk])
        c = chunk[begin]
        local = end - bounds[:-1][c]
        order = np.lexsort((begin, c, local))
        begin, end, piece, c, local = begin[order], end[order], piece[order], c[order], local[order]
        source, target = begin + c, end + c
        weight = self.log_weight[piece]
        alpha = np.full(len(raw) + len(n), -np.inf)
        alpha[bounds[:-1] + np.arange(len(n))] = 0.0
        total = np.empty(len(begin))
        cuts = np.searchsorted(local, np.arange(1, int(local.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            score = alpha[source[a:b]] + weight[a:b]
            head = np.flatnonzero(np.diff(target[a:b], prepend=-1))
            peak = np.maximum.reduceat(score, head)
            peak[np.isneginf(peak)] = 0.0
            spread = np.diff(head, append=b - a)
            alpha[target[a:b][head]] = peak + np.log(np.maximum(np.add.reduceat(np.exp(score - np.repeat(peak, spread)), head), 1e-300))
            total[a:b] = score
        by_node = np.argsort(target, kind="stable")
        target, source, piece = target[by_node], source[by_node], piece[by_node]
        p = np.exp(total[by_node] - alpha[target])
        run = np.cumsum(p)
        head = np.flatnonzero(np.diff(target, prepend=-1))
        before = np.repeat(run[head] - p[head], np.diff(head, append=len(target)))
        cdf = run - before
        first = np.zeros(len(alpha) + 1, np.int64)
        np.add.at(first, target + 1, 1)
        first = np.cumsum(first)
        cdf[first[1:][target] - 1 == np.arange(len(target))] = 2.0  # the last edge takes what rounding leaves
        return first, cdf, source, piece

    def sample(self, texts: pa.Array, keys: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Sampled piece ids of all texts, and each text's bounds in them."""
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        before = np.concatenate([[0], raw[:-1]])
        cut = ((raw == _SPACE) & (before != _SPACE)) | (raw == _FEED) | (before == _FEED)
        cut[bounds[:-1][bounds[:-1] < len(raw)]] = True
        starts = np.flatnonzero(cut)
        chunks = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(raw)])
        coded = chunks.dictionary_encode()
        code = coded.indices.to_numpy()
        _, own_offsets, own = coded.dictionary.buffers()
        own_bounds = np.frombuffer(own_offsets, np.int32)[: len(coded.dictionary) + 1].astype(np.int64)
        first, cdf, source, piece = self.filter_forward(np.frombuffer(own, np.uint8)[: own_bounds[-1]], own_bounds)
        begin = own_bounds[:-1] + np.arange(len(own_bounds) - 1)
        row = np.searchsorted(bounds, starts, "right") - 1
        salt = mix64(keys.astype(np.uint64) + np.array([seed], np.uint64) * _GOLD)[row] + (starts - bounds[row]).astype(np.uint64) * _GOLD
        node = begin[code] + np.diff(own_bounds)[code]
        active, drawn, step = np.arange(len(starts)), [], 0
        while len(active):
            u = (mix64(salt[active] ^ mix64(np.full(1, step + 1, np.uint64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = first[node[active]]
            late = np.flatnonzero(cdf[e] <= u)
            while len(late):
                e[late] += 1
                late = late[cdf[e[late]] <= u[late]]
            drawn.append((active, piece[e]))
            node[active] = source[e]
            active = active[node[active] != begin[code[active]]]
            step += 1
        size = np.zeros(len(starts), np.int64)
        for who, _ in drawn:
            size[who] += 1
        stop = np.cumsum(size)
        ids = np.empty(int(stop[-1]), np.int32)
        for k, (who, got) in enumerate(drawn):
            ids[stop[who] - 1 - k] = got  # drawn from the end
        return ids, np.concatenate([[0], stop])[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, and each text's bounds in them."""
        size = self.lengths[ids]
        stop = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.starts[ids] - stop[:-1], size) + np.arange(stop[-1])
        return self.blob[where], stop[bounds]


@lru_cache(maxsize=1)
def lattice(path: str, exponent: float = EXPONENT) -> PieceLattice:
    return PieceLattice(path, exponent)


def encode(docs: DataFrame, path: str, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", exponent: float = EXPONENT) -> DataFrame:
    """id and pieces (array of int) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path, exponent)
        for batch in batches:
            for part in steps(batch, "text"):
                ids, bounds = own.sample(as_array(part.column(1)), part.column(2).to_numpy(zero_copy_only=False).view(np.uint64), seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], ["id", "pieces"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("key"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, pieces array<int>")


def decode(coded: DataFrame, path: str, id_col: str = "id", pieces_col: str = "pieces") -> DataFrame:
    """id and text of every row of pieces (null pieces: empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            bounds = lists.offsets.to_numpy().astype(np.int64)
            raw, at = own.decode(lists.flatten().to_numpy(), bounds - bounds[0])
            text = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["id", "text"])

    return coded.select(F.col(id_col).alias("id"), F.col(pieces_col).alias("pieces")).mapInArrow(run, f"id {dict(coded.dtypes)[id_col]}, text string")


def digest(docs: DataFrame, path: str, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), lossless (decoded bytes equal the text's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for batch in batches:
            for part in steps(batch, "text"):
                texts = as_array(part.column(1))
                ids, bounds = own.sample(texts, part.column(2).to_numpy(zero_copy_only=False).view(np.uint64), seed)
                raw, at = own.decode(ids, bounds)
                back = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(id_crcs(ids, bounds), pa.int64()), pc.equal(back, texts.cast(pa.binary()))], ["id", "n_pieces", "ids_crc32", "lossless"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("key"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_pieces bigint, ids_crc32 bigint, lossless boolean")
