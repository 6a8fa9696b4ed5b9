import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH, P.PATTERN)


def unpack(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_random_texts(encoder, reference):
    rng = random.Random(5)
    for alphabet in ("ab", "a ", "\n \t!x", "éèaß’'", "你好世界a", "0123", "=-_#*", "²½Ⅷ\x1c\x1d a1", "aāँक्ष्1 "):
        for n in (0, 1, 2, 7, 60, 700):
            for _ in range(25):
                text = "".join(rng.choice(alphabet) for _ in range(n))
                assert unpack(encoder(text)) == reference.encode_ordinary(text), repr(text)


def test_long_pieces_and_bounded_memory(encoder, reference):
    for text in (" " * 20_000, "ab" * 15_000, "<|endoftext|>", "supercalifragilistic" * 900):
        assert unpack(encoder(text)) == reference.encode_ordinary(text)
    small = bpe.Transducer(bpe.load_ranks(PATH), max_states=50)
    for word in ("Gesellschaftsspiele", "incomprehensibility", "désenchantement") * 3:
        assert small.encode(word.encode()) == bpe.merge_all(word.encode(), small.ranks) or word.encode() in small.ranks


def test_lookahead_is_bounded():
    t = bpe.Transducer(bpe.load_ranks(PATH))
    piece = b"abcdefghij" * 3000
    parts, read = [], []

    def bytes_read():
        for i, byte in enumerate(piece):
            read.append(i)
            yield byte

    held = 0
    for part in t.stream(bytes_read()):
        parts += part
        held = max(held, len(read) - sum(len(t.tokens[x]) for x in parts))
    assert parts == t.encode(piece) and held < 64
    assert max(map(len, t.pending)) < 16


def test_neighbours_that_stay_apart():
    """By going back in time as by merging the whole, for pairs of tokens and for ranks in no order."""
    ranks = bpe.load_ranks(PATH)
    rng = random.Random(7)
    t = bpe.Transducer(ranks)
    short = [x for x in ranks.values() if len(t.tokens[x]) <= 6]
    pairs = [(rng.choice(short), rng.choice(short)) for _ in range(4000)]
    for word in ("aaaaaaaa", "banana", "erererer", "        ", "tionstionen"):
        parts = [ranks[word[i:j].encode()] for i in range(len(word)) for j in range(i + 1, len(word) + 1) if word[i:j].encode() in ranks]
        pairs += [(a, b) for a in parts for b in parts]
    for a, b in pairs:
        if bpe.merge_all(t.tokens[a], ranks) == [a] and t._may_follow(-1, b):
            assert t._may_follow(a, b) == (bpe.merge_all(t.tokens[a] + t.tokens[b], ranks) == [a, b])
    odd = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 290, b"bc": 310, b"ca": 280, b"abca": 285}
    t = bpe.Transducer(odd)
    for _ in range(300):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9)))
        assert t.encode(piece) == bpe.merge_all(piece, odd) or piece in odd


def test_utf8_stream():
    data = "aé€𝄞z".encode()
    for cut in range(len(data)):
        s = bpe.Utf8Stream()
        assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.finish() == "aé€𝄞z" and s.valid
    s = bpe.Utf8Stream()
    assert s.feed(b"\xff") == "�" and not s.valid
    s = bpe.Utf8Stream()
    s.feed("€".encode()[:2])
    assert s.finish() == "�" and not s.valid


@given(st.binary(max_size=60), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_utf8_machine_is_that_of_the_interpreter(data, cut):
    s = bpe.Utf8Stream()
    assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.finish() == data.decode(errors="replace")
    try:
        data.decode()
        assert s.valid
    except UnicodeDecodeError:
        assert not s.valid


def test_decoder_takes_tokens_of_parts_of_characters():
    d = bpe.Decoder(PATH)
    ranks = bpe.load_ranks(PATH)
    text = "€𝄞日本" * 700
    single = struct.pack(f"<{len(text.encode())}I", *[ranks[bytes([b])] for b in text.encode()])
    assert d.text(single) == (text, True) and d.text(single[:-4])[1] is False and d.text(None) == ("", True)


def test_tables(spark, edge, reference):
    out = bpe.tokenize(edge, PATH, P.PATTERN)
    rows = out.collect()
    assert len(rows) == edge.count() and set(out.columns) == {*edge.columns, "decoded"}
    for r in rows:
        assert unpack(r["ids"]) == reference.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "")
    assert bpe.tokenize(edge.limit(0), PATH, P.PATTERN).count() == 0
    pair = edge.select("text", bpe.encode(F.col("text"), PATH, P.PATTERN).alias("e")).withColumn("d", bpe.decode(F.col("e"), PATH, P.PATTERN))
    assert all(r["d"] == (r["text"] or "") for r in pair.collect())


def test_states_are_few_and_built_anew(reference):
    """Words of random syllables: no state for the last byte of a piece, and the same ids when states are dropped amid a piece."""
    rng = random.Random(11)
    ranks = bpe.load_ranks(PATH)
    words = ["".join(rng.choice(("th", "er", "on", "tion", "ß", "nd", "wh", "ea", "st", "世")) for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    words = [w for w in dict.fromkeys(words) if w.encode() not in ranks]
    large, small = bpe.Transducer(ranks), bpe.Transducer(ranks, max_states=40)
    assert large.encode(b"") == [] and large.encode(words[0].encode()) and len(large.states) <= len(words[0].encode())
    prefixes = {w.encode()[:n] for w in words for n in range(len(w.encode()))}
    for w in words:
        assert large.encode(w.encode()) == small.encode(w.encode()) == reference.encode_ordinary(w), w
    assert len(large.states) <= len(prefixes) and len(small.states) <= 41
    long = "".join(words).encode()
    assert len(long) > 4 * large.BLOCK and large.encode(long) == [x for part in small.stream(long) for x in part] == reference.encode_ordinary(long.decode())


def test_new_pieces_are_walked_over_together(reference, monkeypatch):
    """Of many texts: the same ids, also when states are dropped between walks, and no step of the single walk for short pieces."""
    rng = random.Random(13)
    parts = ("th", "er", "on", "tion", "ß", "nd", " ", "  ", "\n", "世", "1", "!!", "ea", "é", "\u0301", "'s")
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(120))) for _ in range(800)]
    texts = [" ".join(x[i : i + 60] for i in range(0, len(x), 60)) if x else rng.choice([None, ""]) for x in texts]
    want = [reference.encode_ordinary(x or "") for x in texts]
    e = bpe.Encoder(PATH, P.PATTERN)
    monkeypatch.setattr(e.pieces.transducer, "_step", None)
    assert [unpack(x) for x in e.all(texts)] == want
    monkeypatch.undo()
    e = bpe.Encoder(PATH, P.PATTERN)
    e.CHARS, e.pieces.most, e.pieces.lockstep.BYTES, e.pieces.transducer.max_states = 500, 60, 40, 30
    e.pieces.longest = 9  # others go alone
    assert [unpack(x) for x in e.all(texts * 2)] == want * 2
    assert len(e.pieces) <= 60 + 500 and len(e.pieces.lockstep.number) <= 30 + 40
    assert list(e.all([])) == []


def test_walked_together_by_ranks_in_no_order():
    rng = random.Random(17)
    odd = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 290, b"bc": 310, b"ca": 280, b"abca": 285}
    pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    got = bpe.Lockstep(bpe.Transducer(odd)).encode(pieces)
    assert [unpack(x) for x in got] == [[odd[x]] if x in odd else bpe.merge_all(x, odd) for x in pieces]


def test_table_of_arrays():
    rng = random.Random(19)
    table, want = bpe.Table(2), {}
    for _ in range(60):
        new = sorted({rng.randrange(1 << 45) if rng.random() < 0.5 else rng.randrange(3000) for _ in range(rng.randrange(90))} - want.keys())
        want |= {key: rng.randrange(1 << 30) for key in new}
        table.add(np.array(new, np.int64), np.array([want[key] for key in new], np.int64))
        asked = [*want, *range(0, 3000, 7), 1 << 46]
        assert table.get(np.array(asked, np.int64)).tolist() == [want.get(key, -1) for key in asked]
