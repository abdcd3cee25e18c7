"""Token ids of a corpus in files, entropy-coded with a static range asymmetric numeral system.

A set of files is two Parquet tables below one path. ``frequencies`` holds the shared table: the
count of every token id in the whole corpus, scaled to 2**PRECISION. ``blocks`` holds independent
blocks in binary, each of at most ``BLOCK`` tokens of consecutive documents (a longer document has
blocks of its own):

    magic, lanes, tokens, documents, checkpoints, words (little-endian unsigned 32 bits each)
    documents x (id, number within the shard, tokens of it in this block, tokens of it before)
    checkpoints x word offset, checkpoints x lanes x coder state (64 bits), words (32 bits), CRC-32

Token i of a block belongs to lane i mod lanes; lanes have coder states of their own and share one
stream of words. A checkpoint holds all states at every ``SEGMENT``-th step, so a block is decoded
from all its checkpoints at once. The checksum covers everything before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftwork.llm.chunks import ChunkTable, per_worker
from weftwork.session import shared_dir

MAGIC = 0x52414E53
PRECISION = 20
LANES, SEGMENT, STEPS = 1024, 128, 256
BLOCK = LANES * STEPS
#: Bytes of texts that are encoded at a time.
GROUP = 1 << 22
_LOW = np.uint64(1 << 31)
_DOC = np.dtype([("id", "<i8"), ("seq", "<u4"), ("n", "<u4"), ("before", "<u8")])


def scaled(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies of sum 2**precision, at least 1 for every id that occurs."""
    total, size = int(counts.sum()), 1 << precision
    if total == 0:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts * size // total), 0).astype(np.int64)
    over = int(freq.sum()) - size
    order = np.argsort(-freq, kind="stable")
    for i in order:  # the largest take up what rounding left
        if over == 0:
            break
        change = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= change
        over -= change
    if over:
        raise ValueError("more distinct ids than the table has places")
    return freq


class Coder:
    def __init__(self, freq: np.ndarray, precision: int = PRECISION):
        self.k, self.freq = np.uint64(precision), freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.mask = np.uint64((1 << precision) - 1)
        self.top = np.uint64(63 - precision)

    def encode(self, ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(lanes, word offset of each checkpoint, states of each checkpoint, words)."""
        lanes = min(LANES, len(ids))
        steps = -(-len(ids) // lanes)
        state, stream = np.full(lanes, _LOW), [None] * steps
        marks = -(-steps // SEGMENT)
        states = np.empty((marks, lanes), np.uint64)
        freq, cum = self.freq[ids], self.cum[ids]
        for t in range(steps - 1, -1, -1):
            f, c = freq[t * lanes : (t + 1) * lanes], cum[t * lanes : (t + 1) * lanes]
            x = state[: len(f)]
            full = x >= f << self.top
            stream[t] = x[full].astype(np.uint32)
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: len(f)] = (q << self.k) + (x - q * f) + c
            if t % SEGMENT == 0:
                states[t // SEGMENT] = state
        sizes = np.array([len(w) for w in stream])
        offsets = (np.cumsum(sizes) - sizes)[::SEGMENT]
        return lanes, offsets, states, np.concatenate(stream)

    def decode(self, n: int, lanes: int, offsets: np.ndarray, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """All segments side by side, each from its checkpoint."""
        marks = len(offsets)
        out = np.zeros((marks, SEGMENT * lanes), np.uint32)
        at, state, steps = offsets.astype(np.int64)[:, None].copy(), states.copy(), -(-n // lanes)
        words = np.append(words, np.uint32(0)).astype(np.uint64)
        for t in range(min(SEGMENT, steps)):
            slot = state & self.mask
            sym = self.symbol[slot]
            out[:, t * lanes : (t + 1) * lanes] = sym
            state = self.freq[sym] * (state >> self.k) + slot - self.cum[sym]
            low = state < _LOW
            reach = np.cumsum(low, axis=1)
            state = np.where(low, (state << np.uint64(32)) | words[np.minimum(at + reach - 1, len(words) - 1)], state)
            at += reach[:, -1:]
        return out.ravel()[:n]


def pack_block(coder: Coder, ids: np.ndarray, docs: np.ndarray) -> bytes:
    lanes, offsets, states, words = coder.encode(ids)
    head = np.array([MAGIC, lanes, len(ids), len(docs), len(offsets), len(words)], "<u4")
    body = b"".join([head.tobytes(), docs.tobytes(), offsets.astype("<u8").tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes()])
    return body + zlib.crc32(body).to_bytes(4, "little")


def unpack_block(coder: Coder, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, documents); raises ValueError if the block is damaged."""
    magic, lanes, n, docs, marks, words = np.frombuffer(data, "<u4", 6).tolist() if len(data) > 28 else [0] * 6
    if magic != MAGIC or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("damaged token block")
    at = 24
    table = np.frombuffer(data, _DOC, docs, at)
    at += table.nbytes
    offsets = np.frombuffer(data, "<u8", marks, at)
    at += offsets.nbytes
    states = np.frombuffer(data, "<u8", marks * lanes, at).reshape(marks, lanes)
    return coder.decode(n, lanes, offsets, states, np.frombuffer(data, "<u4", words, at + states.nbytes)), table


def _bytes_of(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


_WORD, _VISIBLE = _bytes_of("".join(c for c in map(chr, range(128)) if c.isalnum())), _bytes_of("".join(map(chr, range(33, 127))))
#: ASCII punctuation and the line's end; apostrophes may belong to letters on both sides.
_MARK = _VISIBLE & ~_WORD & ~_bytes_of("'") | _bytes_of("\n")
#: First bytes of characters that are not white space, and those of which some are.
_MAYBE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_SOLID = ~_MAYBE & ~_bytes_of("".join(c for c in map(chr, range(128)) if c.isspace()))
#: White space of two or three bytes, as numbers of three bytes.
_SPACES = [int.from_bytes(chr(c).encode().ljust(3, b"\0")) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _is_wide(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether two bytes are a letter from U+00C0 to U+023F; two signs of arithmetic stand among them."""
    return (first >= 0xC3) & (first <= 0xC8) & ~((first == 0xC3) & ((second & 0xDF) == 0x97))


def chunk_starts(data: np.ndarray, offsets: np.ndarray, usual: bool, whole: list) -> np.ndarray:
    """Where the chunks of texts begin, and the end of the last; text i is the UTF-8 of ``data`` from
    ``offsets[i]`` to ``offsets[i + 1]``. A text is cut before each space that something other than white
    space follows: the pre-tokenizer always begins a token there, so chunks are encoded one by one.
    ``usual``: as the usual pattern of a byte-level pre-tokenizer begins tokens there, whatever stands around,
    it is also cut between a letter or digit and ASCII punctuation or a line's end, and between a single
    line's end and a letter or digit. So these make no new chunks of words. ``whole``: where texts begin and end
    that are not cut."""
    begins = np.zeros(len(data) + 1, bool)
    space = np.flatnonzero(data == 32)
    lead = data.take(space + 1, mode="clip")
    solid = _SOLID[lead]
    maybe = np.flatnonzero(_MAYBE[lead])
    if len(maybe):
        at, a = space[maybe] + 2, lead[maybe].astype(np.int32)
        b, c = data.take(at, mode="clip").astype(np.int32), data.take(at + 1, mode="clip")
        solid[maybe] = ~np.isin(a << 16 | b << 8 | np.where(a == 0xC2, 0, c), _SPACES)
    begins[space[solid]] = True
    begins[offsets[1:] - 1] = False  # nothing follows the last character of a text
    if usual:
        mark = np.flatnonzero(_MARK[data])
        before = data.take(mark - 1, mode="clip")
        after_word = _WORD[before] | _is_wide(data.take(mark - 2, mode="clip"), before)
        begins[mark[after_word]] = True
        line = data[mark] == 10
        end = mark[line] + 1
        after = data.take(end, mode="clip")
        word = _WORD[after] | _is_wide(after, data.take(end + 1, mode="clip"))
        begins[end[word & (after_word | _VISIBLE[before])[line]]] = True
    for a, b in whole:
        begins[a:b] = False
    begins[offsets] = True
    return np.flatnonzero(begins)


def utf8(texts):
    """(bytes, offsets) of an Arrow array of binary texts; null is empty, what is no UTF-8 is replaced."""
    import pyarrow as pa

    texts = texts.fill_null(b"")
    try:
        texts = texts.cast(pa.large_string())
    except pa.ArrowInvalid:
        texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64)[texts.offset :][: len(texts) + 1]


class Tokens:
    """Ids of texts, by a byte-level BPE of the tokenizers library."""

    def __init__(self, definition: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        # names of added tokens are matched before a text is cut, so a text with one stays whole
        self.names = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a byte-level token has one character for each byte
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.table = ChunkTable(self._encode_many)
        rules = json.loads(definition)
        before = rules.get("pre_tokenizer") or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.usual = usual and not rules.get("normalizer")
        # words of ASCII letters are one token each to the pre-tokenizer, and only their space is written
        # otherwise: the library encodes them faster if it cuts at that alone
        self.space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0] if self.usual else ""
        cut = {"type": "Split", "pattern": {"String": self.space}, "behavior": "MergedWithNext", "invert": False}
        self.words = Tokenizer.from_str(json.dumps(rules | {"pre_tokenizer": cut, "added_tokens": []})) if self.usual else self.tokenizer

    def _each(self, chunks: list[bytes]):
        found = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def _encode_many(self, chunks: list[bytes]):
        """Chunks that begin with a space are encoded in one string, which costs the library less,
        and told apart by the bytes of their tokens."""
        first, words, rest = [], [], []
        names = self._names_in(b"".join(chunks))
        for c in chunks:
            (first if c[0] != 32 or (names and any(n in c for n in names)) else words if self.usual and c[1:].isalpha() else rest).append(c)
        found = [self._each(first), self._joined(self.words, self.space, words), self._joined(self.tokenizer, " ", rest)]
        return first + words + rest, np.concatenate([ids for ids, _ in found]), np.concatenate([sizes for _, sizes in found])

    def _joined(self, tokenizer, space: str, chunks: list[bytes]):
        if not chunks:
            return self._each([])
        text = b"".join(chunks).decode()
        text = text if space == " " else text.replace(" ", space)
        together = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        reached = np.cumsum(self.bytes[together])
        at = np.searchsorted(reached, ends)
        if len(reached) and reached[-1] == ends[-1] and (reached[at] == ends).all():
            return together, np.diff(at + 1, prepend=0)
        return self._each(chunks)  # a token runs over a cut, which another tokenizer may do

    def _names_in(self, text: bytes) -> list[bytes]:
        return [n for n in self.names if n in text]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of ids of each."""
        import pyarrow as pa

        return self.encode_utf8(*utf8(pa.array([t.encode() for t in texts], pa.large_binary())))

    def encode_utf8(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts that lie in ``data`` between ``offsets``. A distinct chunk is looked up once."""
        import pyarrow as pa

        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        cuts = zip(offsets[:-1].tolist(), offsets[1:].tolist()) if self._names_in(data.tobytes()) else ()
        starts = chunk_starts(data, offsets, self.usual, [(a, b) for a, b in cuts if self._names_in(data[a:b].tobytes())])
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist()
        lists = self.table.lists(self.table.find(distinct)).take(chunks.indices)
        ends = lists.offsets.to_numpy()[np.searchsorted(starts, offsets)]
        return lists.flatten().to_numpy(), np.diff(ends)


def token_ids(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, counts: bool = False) -> DataFrame:
    """(id, n, ids): the token ids of each whole text and the end id; ids as compressed unsigned
    integers of 16 bits, or 32 where the vocabulary needs them. Null counts as empty. ``counts``: a task
    adds a row with an n of -1 that has, as ids of 64 bits, how often each token id is in its texts."""
    from pathlib import Path

    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_json).read_text(encoding="utf-8"))

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        tokens = per_worker(f"tokens {tokenizer_json}", lambda: Tokens(shared.value))
        kind = "<u2" if tokens.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        press, total = zstandard.ZstdCompressor(level=3), np.zeros(end_id + 1, np.int64)
        for batch in it:
            data, offsets = utf8(batch.column(1))
            row = 0
            while row < batch.num_rows:
                after = max(int(np.searchsorted(offsets, offsets[row] + GROUP, "right")) - 1, row + 1)
                ids, sizes = tokens.encode_utf8(data, offsets[row : after + 1])
                if counts:
                    mine = np.bincount(ids, minlength=len(total))
                    total = mine + np.append(total, np.zeros(len(mine) - len(total), np.int64))
                    total[end_id] += after - row
                ids, ends = ids.astype(kind), np.cumsum(sizes)
                end = np.array([end_id], kind).tobytes()
                packed = [press.compress(ids[b - n : b].tobytes() + end) for b, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, after - row), pa.array(sizes + 1), pa.array(packed, pa.binary()), pa.array([int(kind[2])] * (after - row), pa.int32())],
                    names=["id", "n", "ids", "width"],
                )
                row = after
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([press.compress(total.astype("<i8").tobytes())], pa.binary()), pa.array([8], pa.int32())], names=["id", "n", "ids", "width"]
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(batches, "id bigint, n bigint, ids binary, width int")


def _unpack(batch) -> Iterator[np.ndarray]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for ids, width in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist()):
        yield np.frombuffer(press.decompress(ids), f"<u{width}")


def _counts(totals: DataFrame) -> DataFrame:
    """(token, count) over all documents, from the tasks' counts."""

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            for total in _unpack(batch):
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].astype(np.int64))], names=["token", "count"])

    return totals.select("ids", "width").mapInArrow(batches, "token bigint, count bigint").groupBy("token").agg(F.sum("count").alias("count"))


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Write the token ids of all documents below ``path``, in ascending order of their ids (whole
    numbers; rows without one come first). A range of ids is a shard; a task writes one shard. Null and
    empty texts are the end id alone. Rows that repeat an id are written one after the other, ordered by
    their ids' number and bytes, so that repeated rows are alike in any order. A text of more than a block
    is laid over blocks of its own. Other columns are not looked at."""
    spark = docs.sparkSession
    token_ids(docs, tokenizer_json, id_col, text_col, end_id, counts=True).write.option("compression", "none").parquet(f"{path}/unsorted")
    written = spark.read.parquet(f"{path}/unsorted")
    tokens = written.filter("n >= 0")
    counts = _counts(written.filter("n < 0")).orderBy("token").toPandas()  # a row for each id of the vocabulary at most
    raw = np.zeros(int(counts["token"].max()) + 1 if len(counts) else 1, np.int64)
    raw[counts["token"].to_numpy(np.int64)] = counts["count"].to_numpy(np.int64)
    freq = scaled(raw)
    used = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in used], "token int, frequency int").coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(freq)

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        coder, shard = Coder(shared.value), TaskContext.get().partitionId()
        room = np.empty(BLOCK, np.uint32)
        filled, table, number, seq, start = 0, [], 0, 0, 0

        def block(whole: bool):
            nonlocal filled, table, number, start
            data = pack_block(coder, room[:filled], np.array(table, _DOC))
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()), "start": pa.array([start]), "tokens": pa.array([filled], pa.int64()), "whole": pa.array([whole]), "data": pa.array([data], pa.binary())})
            number, start, filled, table = number + 1, start + filled, 0, []
            return row

        for batch in it:
            for doc, null, ids in zip(batch.column("id").fill_null(0).to_pylist(), batch.column("id").is_null().to_pylist(), _unpack(batch)):
                done, key = 0, (1 << 31) + seq if null else seq
                if filled and filled + len(ids) > BLOCK:
                    yield block(True)
                while done < len(ids):
                    n = min(BLOCK, len(ids) - done)
                    room[filled : filled + n] = ids[done : done + n]
                    table.append((doc, key, n, done))
                    filled, done = filled + n, done + n
                    if len(ids) > BLOCK:  # a document in blocks of its own
                        yield block(False)
                seq += 1
        if filled:
            yield block(True)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = tokens.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "n", "ids")
    ordered.mapInArrow(batches, "shard int, block int, start bigint, tokens bigint, whole boolean, data binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the files: ``start`` counts the ids of all
    documents before it, ``ids`` are little-endian unsigned integers of 32 bits. Blocks are decoded
    independently of each other; only documents of more than a block are put together."""
    table = spark.read.parquet(f"{path}/frequencies").toPandas()
    freq = np.zeros(int(table["token"].max()) + 1 if len(table) else 1, np.int64)
    freq[table["token"].to_numpy(np.int64)] = table["frequency"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals, base, so_far = blocks.groupBy("shard").agg(F.sum("tokens").alias("t")).orderBy("shard").collect(), [], 0  # a row a shard
    for r in totals:
        base.append((r["shard"], so_far))
        so_far += r["t"]

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa

        coder = Coder(shared.value)
        for batch in it:
            for shard, start, data in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), batch.column("data").to_pylist()):
                ids, docs = unpack_block(coder, data)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(docs["n"].astype(np.int64))
                begins = ends - docs["n"]
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard] * len(docs), pa.int32()),
                        "seq": pa.array(docs["seq"].astype(np.int64)),
                        "id": pa.array(docs["id"].astype(np.int64), mask=docs["seq"] >= 1 << 31),
                        "at": pa.array(start + begins),
                        "before": pa.array(docs["before"].astype(np.int64)),
                        "n": pa.array(docs["n"].astype(np.int64)),
                        "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())], pa.binary()),
                    }
                )

    kinds = "shard int, seq bigint, id bigint, at bigint, before bigint, n bigint, ids binary"
    decoded = lambda some: some.select("shard", "start", "data").mapInArrow(batches, kinds)
    inside = decoded(blocks.filter("whole")).select("shard", "id", "at", "n", "ids")
    joined = (
        decoded(blocks.filter("not whole"))
        .groupBy("shard", "seq")
        .agg(F.first("id").alias("id"), F.min("at").alias("at"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("before", "ids"))).alias("p"))
        .select("shard", "id", "at", "n", F.expr("unhex(array_join(transform(p, x -> hex(x.ids)), ''))").alias("ids"))
    )
    bases = F.broadcast(spark.createDataFrame(base, "shard int, base bigint"))
    both = inside.union(joined).join(bases, "shard")
    return both.select(F.col("id").alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), "ids")


def token_folder(spark: SparkSession) -> str:
    """A new folder among the shared ones."""
    import uuid

    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
