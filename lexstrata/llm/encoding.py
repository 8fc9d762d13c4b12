"""Encoding of a corpus with a public byte-level BPE tokenizer.

Method: content-defined chunk reuse. A rolling hash over the last characters cuts every text into chunks, so that shared
stretches of texts become equal chunks; each distinct chunk is encoded once a task, and texts with the same content are
brought to the same task first. A chunk's ids are kept for its inner part only: from its first to its last place where a
space or line feed follows a character that is none. At such places the tokenizer's pattern always starts a new word,
whatever surrounds it, so the inner ids hold in every text. Each join of two chunks, from the last such place of one to
the first of the next, is encoded anew; a chunk without such a place belongs to the join as a whole, so the join grows
until both sides agree exactly.

Defined results: null and '' give an empty list. Strings that look like special tokens are ordinary text. Rows are kept
one by one, repeated ids and texts too.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

TOKENIZERS = "/opt/tokenizers"
#: Vocabularies whose words PATTERN tells; the places at which ids are joined hold for that pattern alone.
NAMES = ("byte_bpe_50k",)
#: Fixed value: the word pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW, MASK = 8, 511  # a chunk has 512 characters on average
#: Ids kept by a task for reuse; beyond that it starts anew, which changes speed only.
CACHED_IDS = 8_000_000
CACHED_WORDS = 500_000
#: A space or line feed after any other character but white space always starts a new word of PATTERN.
_WORDS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
BATCH_CHARS = 2_000_000


class Encoder(dict):
    """The tokenizer of one Python worker; as a mapping, ids of words already met. Ids travel as bytes, four each, so that
    they are joined without touching single numbers."""

    def __init__(self, folder: str, name: str):
        import tiktoken

        self._path = f"{folder}/{name}"
        with open(f"{self._path}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._bpe = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._slow = None

    def whole(self, text: str) -> bytes:
        try:
            return np.array(self._bpe.encode_ordinary(text), np.int32).tobytes()
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # the pattern engine gives up on huge runs of white space; the other library has no such bound
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(f"{self._path}.json")
                self._slow.encode_special_tokens = True
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.whole(word)
        if len(word) <= 40:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """Where no other white space than spaces and line feeds occurs, words can be told apart without the pattern."""
        if _OTHER_SPACE.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _WORDS.findall(text)))


@cache
def encoder(folder: str, name: str) -> Encoder:
    return Encoder(folder, name)


def chunk_ends(texts: list[str]) -> list[np.ndarray]:
    """Where each text's chunks end, its length included."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    first = np.cumsum(lens) - lens
    h = np.zeros(len(cp), np.uint32)
    for k in range(WINDOW):
        h[k:] += cp[: len(cp) - k] * np.uint32(pow(0x9E3779B1, k + 1, 1 << 32))
    cuts = np.flatnonzero((h ^ (h >> np.uint32(15))) & np.uint32(MASK) == 0) + 1
    of = np.searchsorted(first, cuts - 1, "right") - 1
    inner = (cuts - first[of] >= WINDOW) & (cuts < first[of] + lens[of])  # the window lies inside the text
    cuts, of = cuts[inner], of[inner]
    at = np.searchsorted(of, np.arange(len(texts) + 1))
    return [np.append(cuts[at[i] : at[i + 1]] - first[i], lens[i]) for i in range(len(texts))]


def _firm(text: str, last: bool) -> int:
    """The first or last place where a space or line feed follows another kind of character; -1 if there is none."""
    if last:
        i = len(text)
        while (i := max(text.rfind(" ", 1, i), text.rfind("\n", 1, i))) > 0:
            if not text[i - 1].isspace():
                return i
        return -1
    i = 0
    while True:
        a, b = text.find(" ", i + 1), text.find("\n", i + 1)
        i = min(a, b) if a > 0 and b > 0 else max(a, b)
        if i < 1:
            return -1
        if not text[i - 1].isspace():
            return i


class ChunkEncoder:
    """Encodes texts by chunks and remembers what it has encoded."""

    def __init__(self, encode: Encoder):
        self.encode, self.chunks, self.held = encode, {}, 0

    def _chunk(self, chunk: str) -> tuple[str, bytes, str] | None:
        """What comes before the inner part, its ids, what comes after; None without an inner part."""
        got = self.chunks.get(chunk, False)
        if got is False:
            a = _firm(chunk, False)
            z = _firm(chunk, True) if a > 0 else -1
            got = None if a < 0 else (chunk[:a], self.encode(chunk[a:z]), chunk[z:])
            if self.held > CACHED_IDS:
                self.chunks, self.held = {}, 0
            self.chunks[chunk] = got
            self.held += len(chunk) // 2
        return got

    def ids(self, text: str, ends: np.ndarray) -> bytes:
        out, open_join, a = [], [], 0
        for z in ends.tolist():
            got = self._chunk(text[a:z])
            if got is None:
                open_join.append(text[a:z])
            else:
                open_join.append(got[0])
                out += [self.encode("".join(open_join)), got[1]]
                open_join = [got[2]]
            a = z
        out.append(self.encode("".join(open_join)))
        return b"".join(out)


def _runs(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def encode(df: DataFrame, doc_id: str, text: str, out: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, ids) or, with out='count', (doc_id, *keep, n_tokens) for every row. One shuffle of the texts by
    their hash, as a rebalance: adaptive execution splits the share of a text that holds many rows."""
    if name not in NAMES:
        raise ValueError(f"{name}: only vocabularies with the fixed word pattern can be encoded by chunks: {', '.join(NAMES)}")
    ship(df.sparkSession)
    keep = keep or []
    counts = out == "count"
    column = pa.field("n_tokens", pa.int64()) if counts else pa.field("ids", pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunked = ChunkEncoder(encoder(folder, name))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, z in _runs(texts, BATCH_CHARS):
                some = texts[a:z]
                sizes, parts, seen = np.zeros(len(some), np.int64), [], {}
                for i, (t, ends) in enumerate(zip(some, chunk_ends(some))):
                    own = seen.get(t)  # copies in the batch share their parts
                    if own is None:
                        own = seen[t] = chunked.ids(t, ends)
                    sizes[i] = len(own) // 4
                    if not counts:
                        parts.append(own)
                if counts:
                    made = pa.array(sizes)
                else:
                    offsets = np.zeros(len(some) + 1, np.int32)
                    np.cumsum(sizes, out=offsets[1:])
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))
                rest = [batch.column(i).slice(a, z - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, made], names=[*batch.schema.names[:-1], column.name])

    source = df.select(F.col(doc_id).alias(doc_id), *keep, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + (", n_tokens bigint" if counts else ", ids array<int>")
    blank = F.coalesce(F.col("__text"), F.lit("")) == ""
    keyed = source.filter(~blank).withColumn("__key", F.xxhash64("__text")).hint("rebalance", "__key")
    full = keyed.select(*source.columns).mapInArrow(run, kinds)
    none = F.lit(0).cast("bigint").alias("n_tokens") if counts else F.array().cast("array<int>").alias("ids")
    return full.unionByName(source.filter(blank).select(*[c for c in source.columns if c != "__text"], none))
