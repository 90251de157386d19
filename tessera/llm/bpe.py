"""BPE by a priority queue of merge ranks over a doubly linked symbol list; decoding by vocabulary strings.

A null text counts as empty: no ids. Repeated rows give repeated results; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import as_bytes, map_arrow, tokenizer_path

#: Distinct chunks, and words, that a worker remembers before it forgets those it has not met meanwhile, and the longest worth remembering in bytes.
CACHE_ENTRIES, CACHE_BYTES = 200_000, 64


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that print stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """Apply the merges in order of rank, leftmost first; `made` has the symbol that each rank makes. Entries of the queue are numbers,
    the rank above the place. The queue keeps entries whose symbols have changed; they are skipped when they surface."""
    n, rank_of = len(symbols), ranks.get
    due = [*map(rank_of, zip(symbols, symbols[1:])), None]  # the rank of each place's pair, as it is now
    bits = n.bit_length()
    mask = (1 << bits) - 1
    queue = [rank << bits | at for at, rank in enumerate(due) if rank is not None]
    if not queue:
        return symbols
    symbol, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    heapify(queue)
    while queue:
        entry = heappop(queue)
        at = entry & mask
        if due[at] != (rank := entry >> bits):
            continue
        whole, follower = made[rank], after[at]
        symbol[at], symbol[follower] = whole, -1
        due[at] = due[follower] = None
        after[at] = beyond = after[follower]
        if beyond >= 0:
            before[beyond] = at
            if (found := rank_of((whole, symbol[beyond]))) is not None:
                due[at] = found
                heappush(queue, found << bits | at)
        if (ahead := before[at]) >= 0:
            due[ahead] = found = rank_of((symbol[ahead], whole))
            if found is not None:
                heappush(queue, found << bits | ahead)
    return [s for s in symbol if s >= 0]


class Memory(dict):
    """Holds at most two generations of `size` entries: what is not asked for again while a generation fills is forgotten with the next."""

    def __init__(self, size: int) -> None:
        self.size, self.older = size, {}

    def keep(self, key, value):
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def recall(self, key):
        """An entry of the older generation, which is kept anew."""
        found = self.older.get(key)
        return found and self.keep(key, found)


class BpeCodec:
    """Encoder and decoder of a byte-level BPE file with word ends, lower-casing and dropped white space."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocabulary.items()} | {i: s for s, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.vocabulary[a], self.vocabulary[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.vocabulary[a + b] for a, b in pairs]
        alphabet = byte_alphabet()
        self.units, self.ends = ([self.vocabulary.get(c + end) for c in alphabet] for end in ("", self.end))
        self.shown = {i: b"%d " % i for i in self.strings}
        self.spelled = {i: f"{s} ".encode() for i, s in self.strings.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.marks = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special))
        self.cache = Memory(CACHE_ENTRIES)  # (decimal ids, strings) by chunk or word

    def word_ids(self, word: bytes) -> list[int]:
        units = self.units
        symbols = [units[b] for b in word]
        symbols[-1] = self.ends[word[-1]]
        return merge_word([s for s in symbols if s is not None] if None in symbols else symbols, self.ranks, self.made)

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens; a capital sigma lower-cases by itself, not by its place in the word."""
        return self.words.findall((text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower())

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the strings of special tokens in it become those tokens."""
        ids: list[int] = []
        for part in self.marks.split(text) if "<|" in text else (text,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for word in self.split(part):
                    ids += self.word_ids(word.encode())
        return ids

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in order; this vocabulary's own convention joins them by one space."""
        return " ".join(self.strings[i] for i in ids)

    def _shown(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b"".join([self.shown[i] for i in ids]), b"".join([self.spelled[i] for i in ids])

    def _word(self, word: bytes) -> tuple[bytes, bytes]:
        found = self.cache.get(word) or self.cache.recall(word)
        if not found:
            found = self._shown(self.word_ids(word))
            if len(word) <= CACHE_BYTES:
                self.cache.keep(word, found)
        return found

    def _chunk(self, chunk: bytes) -> tuple[bytes, bytes]:
        """A chunk that the younger generation does not hold. A lower-case word is remembered once, as a chunk is that word where it has no other."""
        found = self.cache.recall(chunk)
        if found:
            return found
        if chunk.isalpha():  # ASCII letters
            word = chunk.lower()
            found = self._word(word)
            if word == chunk:
                return found
        elif b"<|" in chunk:
            found = self._shown(self.encode(chunk.decode()))
        else:
            words = [self._word(w.encode()) for w in self.split(chunk.decode())]
            found = words[0] if len(words) == 1 else (b"".join([w[0] for w in words]), b"".join([w[1] for w in words]))
        if len(chunk) <= CACHE_BYTES:
            self.cache.keep(chunk, found)
        return found

    def encode_joined(self, text: bytes) -> tuple[int, bytes, bytes]:
        """Count, decimal ids joined by spaces, and decoded text. No word spans ASCII white space, so chunks between it are worked out once and remembered."""
        get, chunk = self.cache.get, self._chunk
        found = [get(c) or chunk(c) for c in text.split()]
        ids = b"".join([f[0] for f in found])
        return ids.count(b" "), ids[:-1], b"".join([f[1] for f in found])[:-1]


@lru_cache(1)
def codec_of(path: str) -> BpeCodec:
    """The codec of a Python worker, with what it remembers from earlier tasks."""
    return BpeCodec(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The table's own columns with `ids` (array<int>) and `decoded` (string) added or replaced."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    at = path or tokenizer_path("word_bpe_49k.json")
    kind = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    held: list[BpeCodec] = []

    @F.arrow_udf(kind)
    def both(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(BpeCodec(at))
        ids = [held[0].encode(t or "") for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array([held[0].decode(i) for i in ids])], ["ids", "decoded"])

    made = both(F.col(text))
    return df.withColumn("__bpe", made).withColumns({"ids": F.col("__bpe.ids"), "decoded": F.col("__bpe.decoded")}).drop("__bpe")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: token count and digests of the ids and of the decoded text."""
    at = path or tokenizer_path("word_bpe_49k.json")

    def make():
        codec = codec_of(at)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [codec.encode_joined(t) for t in as_bytes(batch.column(1))]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return pa.record_batch([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([sha(r[1]) for r in rows], pa.string()), pa.array([sha(r[2]) for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return map_arrow(docs.select("doc_id", "text"), make, SCHEMA)
