"""Token-ID output: documents to compressed frames of ids, and back."""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegraph.llm.common import table
from sitegraph.llm.idcodec import decode_frame, frames
from sitegraph.llm.words import BLANK
from sitegraph.session import run_folder

#: words whose ids a Python worker remembers, from task to task
REMEMBERED = 400_000
#: bytes of text whose words are looked up at once
_SLICE = 1 << 23
#: words of letters that are joined to one text
_JOINED = 128

#: kinds of bytes; two side by side are cut where these differ in 3 or more: at white space, and
#: between letters or digits and marks (letters of Latin-1 become of kind 1 too). Apostrophes and the signs of special tokens (<|>) cut nothing
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b".,;:!?*%$#&-@/()+=_\"")] = 2
_KIND[BLANK] = 8
#: letters of ASCII and Latin-1; the latter are the byte 0xC3 and another one, all but these
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_LATIN = f"^[{_LETTERS}]+$"
_NO_LETTER = 0x97, 0xB7
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _stretches(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``begin`` and are ``n`` long, one after another."""
    end = np.cumsum(n)
    return flat[np.repeat(begin - (end - n), n) + np.arange(end[-1] if len(end) else 0)]


class WordTokenizer:
    """A tokenizer whose words never reach over white space, by distinct words.

    Texts are cut at ASCII white space, and between letters or digits and marks, which are
    words of their own to the tokenizer; each distinct word goes through the
    tokenizer once and is remembered. The ids are those of the whole text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # where a model marks ends of words, many words can go through it as one text
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(1 << 16, bool)
        if suffix:
            self.ends[[i for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if word.endswith(suffix)]] = True
        # the same model behind its own splitter, for words of letters that are one piece each to
        # the tokenizer, whatever stands beside them
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.pieces = {ord(c): self._piece(c) for c in _LETTERS}
        # remembered words, and where the ids of each begin and how many they are
        self.known = pa.array([], pa.string())
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def _each(self, words: list[str]) -> list[bytes]:
        """The ids of words, one by one."""
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _piece(self, letter: str) -> str:
        """What the model gets for a letter."""
        if self.tokenizer.normalizer:
            letter = self.tokenizer.normalizer.normalize_str(letter)
        return "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(letter)) if self.tokenizer.pre_tokenizer else letter

    def _groups(self, words: list[str], tokenizer) -> Iterator[tuple[list[str], np.ndarray, np.ndarray | None]]:
        """Words of letters, many at once, with their ids, and where each word's end if that is known.

        Such a word is at least one word to the tokenizer, so if a text has as many ends as
        words, each is one and its ids reach to its end.
        """
        groups = [words[k:k + _JOINED] for k in range(0, len(words), _JOINED)]
        texts = [" ".join(g) for g in groups]
        if tokenizer is self.plain:
            texts = [x.translate(self.pieces) for x in texts]
        for group, coded in zip(groups, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.frombuffer(array("H", coded.ids), np.uint16)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            yield group, ids, cuts if len(cuts) == len(group) and cuts[-1] == len(ids) else None

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters."""
        out: list[bytes] = []
        for group, ids, cuts in self._groups(words, self.tokenizer):
            out += self._each(group) if cuts is None else [x.tobytes() for x in np.split(ids, cuts[:-1])]
        return out

    def _fresh(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words not met before, in another order: how many ids each has, and all these."""
        sizes, flats, order = [], [], []

        def add(got: list[bytes]) -> None:
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)) // 2)
            flats.append(np.frombuffer(b"".join(got), np.uint16))

        if self.ends.any():
            latin = pc.match_substring_regex(words, _LATIN)
            order.append(words.filter(latin))
            words = words.filter(pc.invert(latin))
            for group, ids, cuts in self._groups(order[-1].to_pylist(), self.plain):
                if cuts is None:
                    add(self._each(group))
                else:
                    sizes.append(np.diff(cuts, prepend=0))
                    flats.append(ids)
            letters = pc.utf8_is_alpha(words)
            order.append(words.filter(letters))
            words = words.filter(pc.invert(letters))
            add(self._words(order[-1].to_pylist()))
        add(self._each(words.to_pylist()))
        return pa.concat_arrays([*order, words]), np.concatenate(sizes), np.concatenate(flats)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where distinct words are among the remembered ones, after those that are not were coded."""
        found = pc.index_in(words, value_set=self.known)
        missing = np.asarray(found.is_null())
        place = found.fill_null(0).to_numpy().astype(np.int64)
        if not missing.any():
            return place
        if len(self.known) + int(missing.sum()) > REMEMBERED:
            # the words of this slice stay, others go
            kept = place[~missing]
            size = self.size[kept]
            self.known, self.flat = self.known.take(pa.array(kept)), _stretches(self.flat, self.begin[kept], size)
            self.size, self.begin = size, np.cumsum(size) - size
            place[~missing] = np.arange(len(kept))
        new, size, flat = self._fresh(words.filter(pa.array(missing)))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        place[missing] = len(self.known) + pc.index_in(words.filter(pa.array(missing)), value_set=new).to_numpy()
        self.known = pa.concat_arrays([self.known, new])
        return place

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        words, first = _words_of(texts)
        coded = words.dictionary_encode()
        place = self._places(coded.dictionary)
        begin, size = self.begin[place], self.size[place]
        own = coded.indices.to_numpy()
        for k in range(0, len(texts), 256):
            upto = first[k:k + 257]
            some = own[upto[0]:upto[-1]]
            n = size[some]
            ids = _stretches(self.flat, begin[some], n)
            cut = np.concatenate([[0], np.cumsum(n)])[upto - upto[0]]
            for a, b in zip(cut, cut[1:]):
                yield ids[a:b]


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    """The tokenizer that the tasks of a Python worker share: read once, with the words it remembers."""
    return WordTokenizer(path)


def _words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's begin, and the end; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    kind = _KIND[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3)
    latin = latin[~np.isin(raw[latin + 1], _NO_LETTER)]
    kind[latin] = kind[latin + 1] = 1
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = (kind[1:] ^ kind[:-1]) > 2
    cut[at] = True
    edge = np.flatnonzero(cut)
    filled = kind[edge[:-1]] != 8
    start, length = edge[:-1][filled], np.diff(edge)[filled]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    # lower case is what the tokenizer makes of ASCII, but for names of special tokens, and letters
    # with a combining mark behind (bytes 0xCC and 0xCD): a small t makes one letter with some, a large one none
    if not ((raw[:-1] == ord("<")) & (raw[1:] == ord("|"))).any():
        marked = np.flatnonzero((raw[1:] == 0xCC) | (raw[1:] == 0xCD))
        lower = _LOWER[raw]
        lower[marked] = raw[marked]
        raw = lower
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[kind != 8]))
    return words, np.searchsorted(start, at)


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        done = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, done + _SLICE, side="right")))
        yield texts.slice(first, last - first)
        first = last


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 2) -> None:
    """Write the ids of ``docs(doc_id, text)``, each with ``end_id`` behind, to ``folder``.

    Files, their frames, and the documents in a frame are in ascending order of
    doc_id (null first; rows of equal id by a hash of the text, so that one id with very
    many rows fills several files). A file row is ``part, no, n_ids, frame``.

    Null and empty texts give the end id alone. Repeated rows are written as
    often. An empty table writes no frame. Other columns are not looked at. Ids
    must be below 65,536.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def each() -> Iterator[tuple[int | None, np.ndarray]]:
            own, end = _tokenizer(path), np.array([end_id], dtype=np.uint16)
            for batch in batches:
                ids = iter(batch.column(0).to_pylist())
                for piece in _pieces(batch.column(1)):
                    for got in own.ids(piece):
                        yield next(ids), np.concatenate([got, end])

        for no, (n_ids, frame) in enumerate(frames(each())):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([n_ids], pa.int64()), pa.array([frame], pa.binary())],
                ["part", "no", "n_ids", "frame"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows.select("doc_id", "text").mapInArrow(run, "part INT, no INT, n_ids BIGINT, frame BINARY").write.parquet(folder)


def read_ids(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents in a folder, and their ``ids`` if wanted.

    ``start`` counts the ids of all documents before it. Every block is checked
    by its own checksum. A task reads a few frames at a time; where a frame
    begins follows from the counts beside the frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs, known, n, x = decode_frame(batch.column(2)[k].as_py())
                raw = x.astype("<u4")
                end = np.cumsum(n)
                sums = [zlib.crc32(raw[e - m:e].tobytes()) for e, m in zip(end, n, strict=True)]
                out = [pa.array(np.full(len(n), batch.column(0)[k].as_py(), np.int32)), pa.array(np.full(len(n), batch.column(1)[k].as_py(), np.int32)),
                       pa.array(docs.astype(np.int64), mask=~known), pa.array(end - n), pa.array(n), pa.array(sums, pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(x.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["part", "no", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    held = spark.read.schema("part INT, no INT, n_ids BIGINT, frame BINARY").parquet(folder)
    sizes = held.select("part", "no", "n_ids")
    # a row per file, then a row per frame of a file
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("s"))
    parts = parts.withColumn("part_start", F.sum("s").over(W.orderBy("part")) - F.col("s")).select("part", "part_start")
    starts = sizes.withColumn("frame_start", F.sum("n_ids").over(W.partitionBy("part").orderBy("no")) - F.col("n_ids"))
    starts = starts.join(parts, "part").select("part", "no", (F.col("part_start") + F.col("frame_start")).alias("frame_start"))
    schema = "part INT, no INT, doc_id BIGINT, at BIGINT, n_tokens BIGINT, ids_crc32 BIGINT" + (", ids ARRAY<INT>" if ids else "")
    rows = held.select("part", "no", "frame").mapInArrow(run, schema).join(starts, ["part", "no"])
    return rows.select("doc_id", (F.col("frame_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def token_table(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Documents written as id files below the shared folder, and read from them."""
    folder = run_folder(docs.sparkSession, "ids")
    write_ids(docs, folder, path, end_id)
    return read_ids(docs.sparkSession, folder)


def op7_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    """All documents by the 49k word vocabulary."""
    import public_tokenizers

    return token_table(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
