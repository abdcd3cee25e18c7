"""The table of chunks already encoded."""

import numpy as np

from weftwork.llm import chunks


def test_chunks_met_again_outlive_a_full_table(monkeypatch):
    """Ids do not depend on what the table forgets, and a frequent chunk is encoded once."""
    monkeypatch.setattr(chunks, "CHUNKS", 20)
    asked = []

    def encode_many(new):
        asked.extend(new)
        return new, np.array([ord(ch) for c in new for ch in c], np.int32), np.array([len(c) for c in new], np.int64)

    table = chunks.ChunkTable(encode_many)
    for i in range(60):
        texts = [["often", f"x{i}"], [], ["too", f"y{i}", "often"]]
        ids, sizes = table.encode(texts)
        assert "".join(map(chr, ids)) == "".join("".join(t) for t in texts) and sizes.tolist() == [len("".join(t)) for t in texts]
        assert len(table.index) <= 20 + 4
    assert asked.count("often") == asked.count("too") == 1 and asked.count("x7") == 1


def test_a_table_of_frequent_chunks_starts_anew(monkeypatch):
    monkeypatch.setattr(chunks, "CHUNKS", 20)
    table = chunks.ChunkTable(lambda new: (new, np.array([int(c) for c in new], np.int32), np.ones(len(new), np.int64)))
    many = [str(i) for i in range(30)]
    for _ in range(5):
        ids, sizes = table.encode([many, many])
        assert ids.tolist() == [*range(30)] * 2 and sizes.tolist() == [30, 30] and len(table.index) == 30


def tokens():
    import public_tokenizers

    from weftwork.llm.token_files import Tokens

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return Tokens(f.read())


def test_punctuation_and_line_ends_make_no_new_chunks():
    """Each word, mark and line beginning is encoded by the library once, in whatever chunk it stands."""
    made, asked = tokens(), []
    encode_many = made.table.encode_many
    made.table.encode_many = lambda new: (asked.extend(new), encode_many(new))[1]
    words, marks = [a + b + "q" for a in "abcdefgh" for b in "klmnop"], [".", ",", "!", "?!", ";", "***", ".\n"]
    texts = [" ".join(w + marks[(i + j) % 7] for j, w in enumerate(words)) + f" {words[i]}.\n{words[-i]} end" for i in range(40)]
    ids, sizes = made.encode(texts)
    assert np.split(ids, np.cumsum(sizes)[:-1])[7].tolist() == made.tokenizer.encode(texts[7]).ids
    assert len(asked) == len(set(asked)) <= 3 * len(words) + len(marks) + 1


def test_texts_cut_into_parts_are_encoded_as_a_whole():
    import random

    made, rng = tokens(), random.Random(7)
    parts = [" ", "  ", "\n", "\n\n", ".", "'s", "'", "re", "a", "Word", "é", "×", "1", "²", "\t", "\r", "\x1c", "\x85", "\u180e", "_", "-", ",", "%", "<|endoftext|>", "e\u0301", "文。", "\u2003", "~", "[", '"', "s", "\0", "Ⅷ", "ɐ"]
    texts = ["", " ", "\n", " a", "a "] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [t.replace("  ", " ").replace("<|endoftext|>", "") for t in texts]
    ids, sizes = made.encode(texts)
    for got, whole in zip(np.split(ids, np.cumsum(sizes)[:-1]), made.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == whole.ids
    ids, sizes = made.encode([])
    assert len(ids) == len(sizes) == 0
    assert made.encode(["", ""])[1].tolist() == [0, 0]


def test_a_chunk_is_looked_up_once_in_many_texts():
    """Looking up each occurrence took most of the time of op2_token_files beside the library's."""

    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    made = tokens()
    made.table.index = Counted()
    texts = ["the same words, again and again"] * 500
    for _ in range(2):
        ids, sizes = made.encode(texts)
        assert ids.tolist() == made.tokenizer.encode(texts[0]).ids * 500 and len(set(sizes.tolist())) == 1
    assert Counted.asked <= 2 * 7


def test_cuts_do_not_reach_over_the_end_of_a_text():
    """Texts lie one after the other: what follows in the next is not seen, nor a part of a character."""
    import random

    made, rng = tokens(), random.Random(11)
    parts = [" ", "\n", "a", "b", "7", ".", "'", "é", "÷", "«", "’", "あ", "ሴ", "😀", "ȿ", "ɏ", "\x85", "\xa0", " ", "᠎", " ", " ", " ", "　", " <|endoftext|>"]
    texts = ["a ", "b", " ", " ", "a\n", "b", "", "a ", "", "a", "é", "."] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(6000)]
    for some in (texts, [t for t in texts if "|" not in t], [" "], ["\n"], [""]):
        ids, sizes = made.encode(some)
        assert [i.tolist() for i in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in made.tokenizer.encode_batch(some, add_special_tokens=False)]


def test_bytes_that_are_no_text_are_replaced():
    import pyarrow as pa

    from weftwork.llm.token_files import utf8

    texts = [b"before", "né ".encode(), None, b"", b"\xe2\x82", b"\xac", b"a\xff b", b"\xed\xa0\x80"]
    for kind in (pa.binary(), pa.large_binary()):
        for some in (texts, texts[:4], [None], []):
            data, offsets = utf8(pa.array([b"cut off", *some], kind).slice(1))
            raw = data.tobytes()
            assert [raw[a:b].decode() for a, b in zip(offsets, offsets[1:])] == [(t or b"").decode("utf-8", "replace") for t in some]


def test_tasks_cut_batches_into_groups(spark, monkeypatch):
    """Texts longer than a group, nulls and empty texts, whatever the groups are."""
    from tokenizers import Tokenizer

    from weftwork.llm import token_files
    from weftwork.llm.registered import tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", "one two ", " three.\nfour", None, "long " * 50, "", "end"] * 9
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    for size in (1, 20, 1 << 22):
        monkeypatch.setattr(token_files, "GROUP", size)
        found = token_files.token_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), path, counts=True).toArrow()
        got = {i: ids.tolist() for i, n, ids in zip(found["id"].to_pylist(), found["n"].to_pylist(), token_files._unpack(found)) if n >= 0}
        assert [got[i] for i in range(len(texts))] == want
        total = [ids for n, ids in zip(found["n"].to_pylist(), token_files._unpack(found)) if n < 0]
        assert sum(map(int, total[0])) == sum(map(len, want)) and len(total) == 1
