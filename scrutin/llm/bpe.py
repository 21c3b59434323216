"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens of a slice of rows are laid out as one symbol list.
An index maps the rank of each mergeable pair to all positions where the pair
stands; ranks are taken in ascending order and every merge files the pairs it
creates under their own ranks. A merge makes a token that only later rules
use, so a rank is complete when its turn comes and each is visited once.

Edge cases: null text encodes to no ids and decodes to the empty text; empty
text likewise; a special token's string inside a text becomes its id, as the
tokenizer file says; columns named like an added one are replaced; rows are
independent, so repeated rows give repeated results and an empty table an
empty one. Null ids decode to null-free empty text.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, table

#: Fixed value: the pattern that splits text before merging (public byte-level BPE).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Code points that the regex module takes for letters or numbers
#: and the Unicode tables (version 16) of the tokenizers do not.
LATER_LETTERS = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf "
    "10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f "
    "12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 "
    "18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff "
    "1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e "
    "2cea2-2cead 323b0-33479 3d000-3fc3f "
)

#: Distinct pre-tokens a Python worker remembers before it starts afresh.
CACHE_WORDS = 100_000
#: Bytes of rows whose new pre-tokens are merged together (their index is the largest thing in memory).
SLICE_BYTES = 2 << 20
#: Pre-tokens of a text of more characters are taken one by one, not as a list.
LONG_TEXT = 4_000_000
_SHIFT = 20  # ids are below 2**20

_LOADED: dict[int, Codec] = {}


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Number of each pre-token met; ``fresh`` lists those not merged yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


def _later_letters() -> str:
    ends = [[int(x, 16) for x in r.split("-")] for r in LATER_LETTERS.split()]
    return "".join(chr(c) for e in ends for c in range(e[0], e[-1] + 1))


class Codec:
    """Encoder and decoder of one tokenizer file (given as its JSON text)."""

    def __init__(self, text: str):
        import regex
        spec = json.loads(text)
        model, chars = spec["model"], _byte_chars()
        vocab = model["vocab"]
        self.find = regex.compile(PATTERN)
        late = _later_letters()
        self.late = frozenset(late)
        self.beyond = re.compile(f"[{min(late, default=chr(0x10ffff))}-\U0010ffff]")
        self.plain = {ord(c): "\ue000" for c in late}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        if size > 1 << _SHIFT:
            raise ValueError("vocabulary of more than 2**20 ids")
        raw = [b""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            raw[i] = bytes(chars[c] for c in s) if all(c in chars for c in s) else s.encode()
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.byte_len = np.array([len(b) for b in raw], dtype=np.int64)
        self.byte_at = np.concatenate([[0], np.cumsum(self.byte_len)[:-1]])
        self.first = np.zeros(256, dtype=np.int64)
        for c, b in chars.items():
            self.first[b] = vocab[c]
        self.left, self.right, self.made, self.rank = [], [], [], {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.made.append(vocab[a + b])
            self.rank[vocab[a] << _SHIFT | vocab[b]] = r
        keys = np.array(list(self.rank), dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array(list(self.rank.values()), dtype=np.int64)[order]
        self.forget()

    def forget(self) -> None:
        self.known = _Words()
        self.ids = np.zeros(0, dtype=np.uint32)
        self.at = np.zeros(0, dtype=np.int64)
        self.len = np.zeros(0, dtype=np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` in one array, and the number of each word's."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        start = np.cumsum(sizes) - sizes
        symbols = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(symbols)
        follow = np.arange(1, n + 1)
        follow[start + sizes - 1] = -1
        before = np.arange(-1, n - 1)
        before[start] = -1
        # the index: rank -> positions of the left half, in ascending order
        at = np.flatnonzero(follow >= 0)
        key = symbols[at] << _SHIFT | symbols[at + 1]
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else key
        hit = self.keys[slot] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
        at, rank = at[hit], self.key_rank[slot[hit]] if len(self.keys) else at[:0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        heap, first = np.unique(rank, return_index=True)
        heap = heap.tolist()
        where = dict(zip(heap, (p.tolist() for p in np.split(at, first[1:]))))
        sym, nxt, prv, look = symbols.tolist(), follow.tolist(), before.tolist(), self.rank.get
        while heap:
            r = heapq.heappop(heap)
            a, b, c = self.left[r], self.right[r], self.made[r]
            places = where.pop(r)
            if a == b:
                places.sort()  # overlapping pairs merge from the left
            for i in places:
                if sym[i] != a:
                    continue
                j = nxt[i]
                if j < 0 or sym[j] != b:
                    continue
                k, p = nxt[j], prv[i]
                sym[i], sym[j], nxt[i] = c, -1, k
                if k >= 0:
                    prv[k] = i
                    q = look(c << _SHIFT | sym[k])
                    if q is not None:
                        if q in where:
                            where[q].append(i)
                        else:
                            where[q] = [i]
                            heapq.heappush(heap, q)
                if p >= 0:
                    q = look(sym[p] << _SHIFT | c)
                    if q is not None:
                        if q in where:
                            where[q].append(p)
                        else:
                            where[q] = [p]
                            heapq.heappush(heap, q)
        out = np.array(sym, dtype=np.int64)
        alive = out >= 0
        return out[alive].astype(np.uint32), np.add.reduceat(alive, start) if n else sizes

    def learn(self, texts: list[str]) -> list[list[tuple[np.ndarray | int, ...]]]:
        """Pre-tokens of the texts as word numbers, new words merged together."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        number, fresh, rows = self.known.__getitem__, self.known.fresh, []
        for text in texts:
            parts = []
            for piece in (self.split.split(text) if self.split else [text]):
                if self.split and piece in self.special:
                    parts.append(self.special[piece])
                elif piece:
                    parts.append(np.fromiter(map(number, self.words(piece)), dtype=np.int64))
            rows.append(parts)
        if fresh:
            ids, count = self.merge([w.encode() for w in fresh])
            base = len(self.ids)
            self.at = np.concatenate([self.at, base + np.cumsum(count) - count])
            self.len = np.concatenate([self.len, count])
            self.ids = np.concatenate([self.ids, ids])
            fresh.clear()
        return rows

    def gather(self, words: np.ndarray) -> np.ndarray:
        count = self.len[words]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.at[words] - (ends - count), count)]

    def words(self, text: str):
        if self.beyond.search(text) and not self.late.isdisjoint(text):  # match as if those were symbols
            return (text[m.start():m.end()] for m in self.find.finditer(text.translate(self.plain)))
        return self.find.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in self.find.finditer(text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for parts in self.learn(texts):
            arrays = [self.gather(p) if isinstance(p, np.ndarray) else np.array([p], dtype=np.uint32) for p in parts]
            out.append(arrays[0] if len(arrays) == 1 else np.concatenate(arrays) if arrays else self.ids[:0])
        return out

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[ids < len(self.byte_len)]
        count = self.byte_len[ids]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.bytes[np.arange(total) + np.repeat(self.byte_at[ids] - (ends - count), count)]
        return flat.tobytes().decode("utf-8", "replace")


def _codec(shipped) -> Codec:
    text = shipped.value
    key = hash(text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Codec(text)
    return _LOADED[key]


def _shipped(spark: SparkSession, tokenizer: str):
    """The tokenizer file's text as a broadcast value (a file of fixed size,
    read once by the driver, so executors need no copy of their own)."""
    with open(tokenizer, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", count: str = "n_tokens",
           decoded: str | None = None) -> DataFrame:
    """``df`` with ``ids``, the token ids of the whole ``text`` as packed
    little-endian unsigned 32-bit integers (the shard format of training
    readers), and ``count``, their number; if ``decoded`` names a column, it
    gets the ids decoded again in the same task. ``tokenizer`` is the path of a
    byte-level BPE file on the driver."""
    shipped = _shipped(df.sparkSession, tokenizer)

    def kernel(cols):
        codec = _codec(shipped)
        found = codec.encode([t or "" for t in cols[0].to_pylist()])
        out = [pa.array([f.astype("<u4").tobytes() for f in found], pa.binary()),
               pa.array([len(f) for f in found], pa.int64())]
        return out + [pa.array([codec.decode(f) for f in found], pa.string())] if decoded else out

    fields = [T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    return append_arrow(df, fields, [text], kernel,
                        max_bytes=SLICE_BYTES)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``text``, the text of the packed ``ids`` (special tokens
    included, ids outside the vocabulary skipped)."""
    shipped = _shipped(df.sparkSession, tokenizer)

    def kernel(cols):
        codec = _codec(shipped)
        return [pa.array([codec.decode(np.frombuffer(b or b"", dtype="<u4")) for b in cols[0].to_pylist()], pa.string())]

    return append_arrow(df, [T.StructField(text, T.StringType())], [ids], kernel, max_bytes=SLICE_BYTES)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every document encoded and decoded; digests of the ids and the text."""
    path = tokenizer or default_tokenizer()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, path, decoded="decoded")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op4_bpe": op4_bpe}
ORACLE_SQL: dict[str, str] = {}
