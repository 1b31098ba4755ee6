"""Exact round trips of the id files, and damage that is found."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from sitegraph.llm import idcodec as C
from sitegraph.llm import token_files
from sitegraph.llm.token_files import WordTokenizer, read_ids, write_ids

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def _round(ids, lengths):
    frame = C.encode_frame(np.arange(len(lengths)), np.ones(len(lengths), bool), np.array(lengths), ids)
    docs, known, n, back = C.decode_frame(frame)
    assert list(docs) == list(range(len(lengths))) and known.all() and list(n) == list(lengths)
    assert np.array_equal(back, ids)
    return frame


@pytest.mark.parametrize("n", [0, 1, 2, 17, C.BLOCK - 1, C.BLOCK, C.BLOCK + 1, 3 * C.BLOCK + 5])
@pytest.mark.parametrize("kind", ["same", "uniform", "text", "ends"])
def test_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"same": np.full(n, 7), "uniform": rng.integers(0, 1 << 16, n), "text": (rng.zipf(1.3, n) % 3000),
           "ends": rng.choice([0, 65535], n)}[kind].astype(np.uint16)
    frame = _round(ids, [n])
    if kind == "same" and n > 4000:
        assert len(frame) < n / 4


def test_blocks_are_apart_and_checked():
    ids = (np.arange(3 * C.BLOCK) % 50).astype(np.uint16)
    frame = bytearray(_round(ids, [len(ids)]))
    frame[-60] ^= 255
    with pytest.raises(ValueError, match="block 2"):
        C.decode_frame(bytes(frame))
    frame = bytearray(_round(ids, [len(ids)]))
    frame[30] ^= 1
    with pytest.raises(ValueError, match="head"):
        C.decode_frame(bytes(frame))


def test_words_give_the_ids_of_whole_texts():
    rng = np.random.default_rng(1)
    signs = list("abcdeABC'sStT.,!?*%#&  \n\t\r\x0b\x0c  éÉßİΣς̧́中한🙂0123<|>\x00\x1c\x85")
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(400)]
    texts += ["", "<|endoftext|> a <|ENDOFTEXT|>x<|endoftext|>", "It's we'LL", "a" * 3000, "é" * 500]
    t = WordTokenizer(PATH)
    for ids, text in zip(t.ids(pa.array([*texts, None])), [*texts, ""], strict=True):
        assert list(ids) == t.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_files(spark, tmp_path, monkeypatch):
    rows = [(5, "the cat"), (None, "null id"), (3, None), (3, ""), (1, "x " * 20_000), (7, "the cat"), (7, "the cat"), (2, "ünï")]
    df = spark.createDataFrame([(i, t, 1, b"q") for i, t in rows], "doc_id BIGINT, text STRING, part INT, frame BINARY")
    write_ids(df, str(tmp_path / "ids"), PATH)
    got = sorted(map(tuple, read_ids(spark, str(tmp_path / "ids"), ids=True).collect()), key=lambda r: r[1])
    t = WordTokenizer(PATH).tokenizer
    assert [r[0] for r in got] == [None, 1, 2, 3, 3, 5, 7, 7]
    start = 0
    for doc, at, n, crc, ids in got:
        want = [t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in rows if i == doc]
        assert ids in want and at == start and n == len(ids) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += n
    write_ids(df.limit(0), str(tmp_path / "none"), PATH)
    assert read_ids(spark, str(tmp_path / "none")).count() == 0


def test_words_of_letters_go_through_the_tokenizer_together():
    words = [f"x{a}{b}" for a in "abcdefghij" for b in "abcdefghij"] + ["é", "İx", "ßá", "ñandú", "中文"]
    t = WordTokenizer(PATH)
    want = t._each(words)
    texts = []

    class Counting:
        def encode_batch_fast(self, batch, **how):
            texts.extend(batch)
            return real.encode_batch_fast(batch, **how)

    real, t.tokenizer = t.tokenizer, Counting()
    assert t._words(words[:100]) == want[:100] and len(texts) == 1
    # a letter that becomes two words sends its text the other way
    assert t._words(words) == want


def test_letters_with_marks_and_words_beside_signs():
    # a small t and U+0308 are one letter, a large T and U+0308 are not
    texts = ["T̈ ẗ", "H̱J̌W̊Y̊", "schä.Öl,É̸:ñ's×÷.", "a.b@c-1.5'S.x", "é́. ́.a"]
    t = WordTokenizer(PATH)
    for ids, text in zip(t.ids(pa.array(texts)), texts, strict=True):
        assert list(ids) == t.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_worker_remembers_words_and_forgets_the_rest(monkeypatch):
    assert token_files._tokenizer(PATH) is token_files._tokenizer(PATH)
    monkeypatch.setattr(token_files, "REMEMBERED", 150)
    t = WordTokenizer(PATH)
    pieces = [" ".join(f"{a}{b}ö{k}" if k % 2 else f"{a}{b}" for a in "abcdefgh" for b in "klmnop") for k in range(6)]
    for text in [*pieces, *pieces[::-1]]:
        assert list(next(t.ids(pa.array([text])))) == t.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(t.known) == len(t.size) == len(t.begin) <= 150 and len(t.flat) == t.size.sum()
    monkeypatch.setattr(t, "_fresh", None)
    list(t.ids(pa.array([pieces[0].upper()])))
