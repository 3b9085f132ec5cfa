import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seriesframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)
MINE = bpe.WordBpe(open(PATH, "rb").read())
TEXTS = [
    "", " ", "Hello WORLD don't we'll I'M", "naïve Ünïcode Straße ΣΊΣΥΦΟΣ İstanbul", "éé x\u0085y z\u001cw", "a" * 5000, "1234 56.7 !!!??? :-)",
    "<|startoftext|>Hi<|endoftext|><|endoftext|> there <|startoftext|", "日本語 テキスト 😀👩‍👩‍👧 ​﻿", "\n\t\r\x0b\x0c", "'S 'T o'clock 's", "\x00\x01\x7f", "lower</w> </w>",
    "the " * 3000, "ababababab" * 300]


def same(text):
    want = REAL.encode(text, add_special_tokens=False).ids
    got = list(struct.unpack(f"<{len(MINE.encode(text)) // 4}I", MINE.encode(text)))
    assert got == want
    assert MINE.decode(got) == REAL.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_like_the_library(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abethinorsd'é ÀÉ<|>sw12.\n", max_size=200)))
def test_like_the_library_on_any_text(text):
    if not any("\ud800" <= c <= "\udfff" for c in text):
        same(text)


def test_over_spark(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, None, 1), (3, TEXTS[3], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.encode(docs, PATH, tuple(bpe._TYPES), rows=4).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.doc_id] if r.doc_id is not None else ""
        want = REAL.encode(text, add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (want, len(want))
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        assert r.decoded == REAL.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_a_file_beyond_the_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_FILE", 10)
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH)


def test_every_space():
    for c in [*range(0x00, 0x21), 0x7F, 0x85, 0xA0, 0xAD, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]:
        same(f"ab{chr(c)}cd !{chr(c)}! {chr(c)}")


def test_every_character():
    """All code points: alone, after a letter and before marks of other classes."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for make in ("{0}", "a{0}b", "a{0}\u0316", "a{0}\u05b0", "a\u05b0{0}", "á{0}"):
        texts = [" ".join(make.format(c) for c in every[at:at + 512]) for at in range(0, len(every), 512)]
        for text, want in zip(texts, REAL.encode_batch(texts, add_special_tokens=False)):
            if MINE.encode(text) != struct.pack(f"<{len(want.ids)}I", *want.ids):
                for part in text.split(" "):
                    same(part)
    for pair in ("\U00011935\U00011930", "ΑΣ", "ΑΣ b\u08d1\u08fc", "Σ\u0898Σ"):
        same(pair)


def test_long_pieces_are_not_kept():
    one = bpe.WordBpe(open(PATH, "rb").read())
    one.encode("ab " + "c" * 5000)
    assert list(one) == ["ab"]


def test_the_quick_test_leaves_nothing_out():
    assert all(bpe.BEYOND.search(c) for c in map(chr, range(0x110000)) if MINE.rare(c) or MINE.odd(c))
