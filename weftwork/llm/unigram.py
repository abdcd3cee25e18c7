"""SentencePiece encoding by the unigram lattice: the best-scored sequence of pieces (Viterbi).

Pieces are looked up in a double-array trie over UTF-8 bytes. Spaces become the marker U+2581, with
one put before the text; a character that no piece covers is written as byte pieces, and so is a
marker that stands in the text itself, which makes decoding exact for every text. Among sequences
of equal score, the one with the longer last piece wins, at every position.

Lattices are solved per chunk: no piece of a vocabulary may run from another character into a
marker (checked when it is loaded), so the best path always passes between the two.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from weftwork.llm.chunks import ChunkTable, grouped, open_shared, per_worker, share

MARK = "▁"
#: Stands for a marker of the text itself while a chunk is encoded; no UTF-8 text has this byte.
_LITERAL = 0xFF


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]  # id of each byte's piece
    ordinary: list[int]  # ids that the lattice may use
    path: str = ""


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece model file. A BPE model stores merge ranks r instead of log scores; its
    pieces get those of Zipf's law, log(1 / (r + 1)) less the log of the sum of all."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    stored = [sp.get_score(i) for i in range(n)]
    ordinary = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    by_name = {pieces[i]: i for i in range(n) if sp.is_byte(i)}
    if len(by_name) != 256:
        raise ValueError("the vocabulary has no byte pieces")
    ranks = [-stored[i] for i in ordinary]
    if all(r == int(r) >= 0 for r in ranks):
        total = math.log(sum(1 / (r + 1) for r in ranks))
        for i in ordinary:
            stored[i] = -math.log(1 - stored[i]) - total
    if any(MARK in pieces[i].lstrip(MARK) for i in ordinary):
        raise ValueError("a piece runs into a marker")
    return Vocabulary(pieces, stored, [by_name[f"<0x{b:02X}>"] for b in range(256)], ordinary, path)


class DoubleArray:
    """A trie in two arrays: the child of node s by byte c is t = base[s] + c + 1 if check[t] == s.
    ``value`` holds the piece that ends in a node, or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, v in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][c]
            values[node] = v
        place, used, free, end, todo = {0: 0}, {0: 0}, 260, 260, [0]  # used: slot -> its parent's slot
        base_of: dict[int, int] = {}
        for node in todo:
            codes = sorted(c + 1 for c in children[node])
            if not codes:
                continue
            while free in used:
                free += 1
            at = free - codes[0]  # from 260 on, so never negative
            if len(codes) > 1:  # one child takes the hole as it is; more: a place nearby, or else behind all others
                for _ in range(32):
                    if not any(at + c in used for c in codes):
                        break
                    at += 1
                else:
                    at = max(end, free) - codes[0]
            base_of[place[node]] = at
            for c in codes:
                child = children[node][c - 1]
                place[child] = at + c
                used[at + c] = place[node]
                todo.append(child)
            end = max(end, at + codes[-1] + 1)
        size = end + 258
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        for slot, parent in used.items():
            self.check[slot] = parent
        for slot, at in base_of.items():
            self.base[slot] = at
        for node, slot in place.items():
            self.value[slot] = values[node]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.pieces, self.byte_ids = v.pieces, v.byte_ids
        self.trie = DoubleArray({v.pieces[i].encode(): i for i in v.ordinary})
        self.scores = v.scores
        self.unknown = min(v.scores[i] for i in v.ordinary) - 10  # what an uncovered character costs
        self.table = ChunkTable(self._encode_many)

    def viterbi(self, data: bytes) -> list[int]:
        """The ids of one chunk of UTF-8 bytes; its markers are spaces, 0xFF is a marker of the text."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(data)
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == -math.inf:
                continue
            c = data[i]
            width = 1 if c < 0x80 or c == _LITERAL else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            node, j, covered = 0, i, False
            while j < n:
                t = base[node] + data[j] + 1
                if check[t] != node:
                    break
                node = t
                j += 1
                p = value[node]
                if p >= 0:
                    covered = covered or j == i + width
                    s = here + scores[p]
                    if s > best[j]:
                        best[j], back[j], piece[j] = s, i, p
            if not covered and here + self.unknown > best[i + width]:
                best[i + width], back[i + width], piece[i + width] = here + self.unknown, i, -1
        out, j = [], n
        while j:
            i = back[j]
            if piece[j] >= 0:
                out.append(piece[j])
            else:
                char = MARK.encode() if data[i] == _LITERAL else data[i:j]
                out.extend(self.byte_ids[b] for b in reversed(char))
            j = i
        return out[::-1]

    def _encode_many(self, chunks: list[str]):
        literal, marks = MARK.encode(), bytes([_LITERAL])
        found = [self.viterbi((" " + c).encode().replace(literal, marks).replace(b" ", literal)) for c in chunks]
        sizes = np.array([len(f) for f in found], np.int64)
        return chunks, np.array([i for f in found for i in f], np.int32), sizes

    @staticmethod
    def chunks(text: str) -> list[str]:
        """A text as chunks, each a run of spaces, less the first of them, and what follows it. Before
        the first chunk, that space is the one put there."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in re.findall(r" *[^ ]+| +", " " + text)]
        return text.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each."""
        return self.table.encode([self.chunks(t) for t in texts])


class Decoder:
    """Turns ids back into text: pieces are joined, markers become spaces, the first one goes."""

    def __init__(self, vocabulary: Vocabulary):
        byte_of = {i: b for b, i in enumerate(vocabulary.byte_ids)}
        raw = [bytes([byte_of[i]]) if i in byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(vocabulary.pieces)]
        self.size = np.array([len(r) for r in raw])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at].tobytes()[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), verify: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` (array of int), and the ``carry`` columns.
    Null and empty texts have no ids. Whole texts, whatever their length. Rows that repeat an id or a text
    are encoded one by one; of paths with the same score the one with the longer last piece wins, so that
    equal texts have equal ids. Columns of ``docs`` that are not carried may have any name. ``verify``
    decodes the ids again and adds ``round_trip``, whether they give the text back."""
    shared = share(docs.sparkSession, vocabulary)

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa

        words = open_shared(shared)
        encoder = per_worker(f"unigram {words.path}", lambda: Encoder(words))
        decoder = per_worker(f"unigram decoder {words.path}", lambda: Decoder(words)) if verify else None
        for batch in it:
            rows = 0
            for group in grouped([b.decode("utf-8", "replace") if b else "" for b in batch.column(0).to_pylist()]):
                ids, sizes = encoder.encode(group)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                others = [c.slice(rows, len(group)) for c in batch.columns[1:]]
                names = [*batch.schema.names[1:], "ids"]
                if verify:
                    ends = np.cumsum(sizes).tolist()
                    others.append(pa.array([decoder.decode(ids[b - n : b]) == t for b, n, t in zip(ends, sizes.tolist(), group)], pa.bool_()))
                    names.insert(-1, "round_trip")
                yield pa.RecordBatch.from_arrays([*others, lists], names=names)
                rows += len(group)

    keep = [F.col(f"`{c}`") for c in dict.fromkeys([id_col, *carry])]
    rows = docs.select(F.col(f"`{text_col}`").cast("binary").alias("__text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(batches, f"{schema}{', round_trip boolean' if verify else ''}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary, carry: list[str], ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: the ``carry`` columns and ``decoded``; no ids: empty text."""
    shared = share(encoded.sparkSession, vocabulary)

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa

        words = open_shared(shared)
        decoder = per_worker(f"unigram decoder {words.path}", lambda: Decoder(words))
        for batch in it:
            lists = batch.column(0)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [decoder.decode(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "decoded"])

    ids = F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))
    rows = encoded.select(ids.alias("__ids"), *[F.col(f"`{c}`") for c in carry])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(batches, f"{schema}, decoded string")
