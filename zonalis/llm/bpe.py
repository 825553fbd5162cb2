"""BPE encoding and decoding with a byte-level vocabulary.

A text is split at added tokens and then into pieces by the byte-level pattern.
Each piece becomes a doubly linked list of symbols; a priority queue holds
the merge ranks of neighbours, smallest rank first and leftmost on ties, and
entries whose symbols changed since are skipped as stale.  Pieces repeat, so
every worker keeps a bounded table of encoded pieces.  Decoding joins the byte
strings of the vocabulary and reads them as UTF-8, malformed parts replaced.

Defined results: a null text is encoded as an empty one.  Very long
pieces cost n log n.  The vocabulary file is a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split of byte-level BPE (fixed value of the public format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of each of a worker's two tables of encoded pieces; longer pieces are not kept.
TABLE_ENTRIES, TABLE_PIECE = 300_000, 64

DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte.

    Printable bytes stand for themselves; the others follow from code point 256 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


def _check(spec: dict) -> None:
    """Raise for what a file may ask for and this codec does not do."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    bad = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    bad += ["type"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * (spec.get("normalizer") is not None)
    bad += ["pre_tokenizer"] * (pre.get("type") != "ByteLevel" or bool(pre.get("add_prefix_space")) or not pre.get("use_regex", True))
    bad += ["decoder"] * ((spec.get("decoder") or {}).get("type") != "ByteLevel")
    bad += [f"added token {t['content']!r}" for t in spec["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") and spec.get("normalizer")]
    if bad:
        raise ValueError(f"not supported in a tokenizers file: {', '.join(bad)}")


class Codec:
    """Encoder and decoder of one tokenizers file with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        #: A pair of ids is written as one number, first * base + second.
        self.base = max(vocab.values()) + 1
        self.ranks: dict[int, int] = {}
        self.makes: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocab[a] * self.base + vocab[b]] = rank
            self.makes.append(vocab[a + b])
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.split = regex.compile(PATTERN)
        self.split_added = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        #: Encoded pieces; those not met again while the table fills up once are forgotten.
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: merges by a queue of ranks over a linked list."""
        ids = [self.byte_id[b] for b in piece]
        n, base, rank_of = len(ids), self.base, self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        # A queue entry is rank * n + place: the least rank first, the leftmost of equals.
        queue = [rank * n + i for i, (a, b) in enumerate(pairwise(ids)) if (rank := rank_of(a * base + b)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = divmod(heapq.heappop(queue), n)
            j = after[i]
            if j == n or ids[i] < 0 or rank_of(ids[i] * base + ids[j]) != rank:
                continue  # stale: one of the two has been merged since
            made = self.makes[rank]
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := rank_of(made * base + ids[k])) is not None:
                    heapq.heappush(queue, new * n + i)
            if (h := before[i]) >= 0 and (new := rank_of(ids[h] * base + made)) is not None:
                heapq.heappush(queue, new * n + h)
        return [x for x in ids if x >= 0]

    def _packed(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = struct.pack(f"<{len(ids)}I", *ids) if (ids := self.encode_piece(piece.encode())) else b""
        if len(piece) <= TABLE_PIECE:
            if len(self.table) >= TABLE_ENTRIES:
                self.older = self.table.copy()
                self.table.clear()
            self.table[piece] = out
        return out

    def encode_packed(self, text: str, special: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; added tokens count as such if ``special``."""
        parts = self.split_added.split(text) if special and self.split_added else [text]
        out, get = [], self.table.get
        for part in parts:
            if special and part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            else:
                out += [get(p) or self._packed(p) for p in self.split.findall(part)]
        return b"".join(out)

    def encode(self, text: str, special: bool = True) -> list[int]:
        return np.frombuffer(self.encode_packed(text, special), dtype="<u4").tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digest(docs: DataFrame, *, text: str = "text", path: str | None = None, into: str = "bpe") -> DataFrame:
    """``docs`` with a struct ``into``: token count, digest of the ids, digest of the decoded text."""
    path = path or default_path()

    @F.arrow_udf(DIGEST)
    def run(texts: pa.Array) -> pa.Array:
        own, rows = codec(path), []
        for t in texts:
            packed = own.encode_packed(t.as_py() or "")
            back = own.decode(np.frombuffer(packed, dtype="<u4").tolist())
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=DIGEST.names)

    return docs.withColumn(into, run(F.col(text)))


def encode(docs: DataFrame, *, text: str = "text", path: str | None = None, into: str = "ids", special: bool = True) -> DataFrame:
    """``docs`` with the token ids of the text as an array column."""
    path = path or default_path()

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        own = codec(path)
        packed = [own.encode_packed(t.as_py() or "", special) for t in texts]
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))

    return docs.withColumn(into, run(F.col(text)))


def decode(df: DataFrame, *, ids: str = "ids", path: str | None = None, into: str = "decoded") -> DataFrame:
    """``df`` with the text of an array of token ids; null ids give null."""
    path = path or default_path()

    @F.arrow_udf(T.StringType())
    def run(arrays: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array([None if (x := a.as_py()) is None else own.decode(x) for a in arrays], pa.string())

    return df.withColumn(into, run(F.col(ids)))
