"""Byte-level BPE encoding and decoding with a pair occurrence index.

Each batch's distinct pre-tokens lie one after another in one sequence of symbols. The index maps
every mergeable pair (by its rank) to all its positions in that sequence. Ranks present are taken
in ascending order; a merge changes its neighbours' pairs, which enter the index under their own
ranks. Texts are then the concatenation of their pre-tokens' ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, rows, strings

#: The byte-level pre-token pattern (a fixed value of the tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens that a task remembers between batches, at most.
MEMORY = 500_000


def check_supported(data: dict) -> None:
    """Refuse tokenizer files that ask for more than byte-level BPE with the pattern above."""
    before, model = data.get("pre_tokenizer") or {}, data.get("model") or {}
    level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    added = not any(t.get(k) for t in data.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
    if not (level and plain and added and model.get("type") == "BPE" and not data.get("normalizer")):
        raise ValueError("not a byte-level BPE file of the supported kind")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class ByteBPE:
    """Encoder and decoder of one tokenizer file (read once in each Python worker)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        check_supported(data)
        vocab, letters = data["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.first = [vocab.get(letters[b], -1) for b in range(256)]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [vocab[a + b] for a, b in pairs]
        self.pair = [(vocab[a], vocab[b]) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = b"".join(bytes([back[c]]) if c in back else c.encode() for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; strings of special tokens stand alone."""
        if self.cut is None or not self.cut.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words.findall(text[at:])

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by the pair occurrence index over all of them."""
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        n = int(ends[-1]) if len(words) else 0
        symbols = np.array(self.first, dtype=np.int64)[np.frombuffer(b"".join(words), dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends.tolist():
            after[e - 1] = -1
            if e < n:
                before[e] = -1
        get, index = self.rank.get, {}
        for i, j in enumerate(after):
            if j >= 0 and (r := get((symbols[i], symbols[j]))) is not None:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        active = list(index)
        heapify(active)
        while active:
            r = heappop(active)
            a, b = self.pair[r]
            new = self.made[r]
            for i in sorted(index.pop(r)):
                if symbols[i] != a or (j := after[i]) < 0 or symbols[j] != b:
                    continue
                symbols[i], symbols[j] = new, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    if (q := get((new, symbols[k]))) is not None:
                        if q in index:
                            index[q].append(i)
                        else:
                            index[q] = [i]
                            heappush(active, q)
                if (h := before[i]) >= 0 and (q := get((symbols[h], new))) is not None:
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        heappush(active, q)
        left = np.array(symbols, dtype=np.int64)
        kept = left >= 0
        upto = np.concatenate([[0], np.cumsum(kept)])
        ids = left[kept].astype("<u4")
        starts = np.concatenate([[0], ends[:-1]]) if len(words) else ends
        return [ids[a:b] for a, b in zip(upto[starts].tolist(), upto[ends].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        for token, i in self.special.items():
            self.known[token] = np.array([i], dtype="<u4").tobytes()
        fresh = list({p for c in cut for p in c if p not in self.known})
        for piece, ids in zip(fresh, self.merge([p.encode() for p in fresh])):
            self.known[piece] = ids.tobytes()
        known = self.known.__getitem__
        return [b"".join(map(known, c)) for c in cut]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


ENCODED = pa.schema([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _mapped(docs: DataFrame, path: str, text_col: str, keep: list[str], added: pa.Schema, make, held: int) -> DataFrame:
    """keep's columns and those of added, by make(ids as bytes, decoded text) for each row; held: bytes of text taken at a time."""
    from pyspark.sql.pandas.types import from_arrow_schema

    picked = docs.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text_col}`").alias("__text"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            for part in by_size(batch, n, held):
                out = []
                for packed in coder.encode(strings(part.column(n))):
                    ids = np.frombuffer(packed, dtype="<u4")
                    out.append(make(ids, packed, coder.decode(ids.tolist())))
                new = rows(added, **{f.name: [x[k] for x in out] for k, f in enumerate(added)})
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n)), *new.columns], names=[*keep, *added.names])

    names = picked.select(*(f"`{k}`" for k in keep)).schema
    for field in from_arrow_schema(added):
        names = names.add(field)
    return picked.mapInArrow(run, names)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs -> keep's columns, n_tokens, ids and decoded: every whole text encoded, and its ids decoded.

    A null or empty text has no ids and decodes to ''. Strings of special tokens inside a text
    become those tokens. Every row is treated by itself, so repeated rows and ids give repeated
    results; an empty table gives an empty one.
    """
    return _mapped(docs, path, text_col, list(keep), ENCODED, lambda ids, packed, text: (len(ids), ids.astype(np.int32), text), 1 << 20)


def digests(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As encode(), with SHA-256 of the ids (little-endian, 32 bits) and of the decoded text in place of both."""
    sha = hashlib.sha256
    return _mapped(docs, path, text_col, list(keep), DIGESTS, lambda ids, packed, text: (len(ids), sha(packed).hexdigest(), sha(text.encode()).hexdigest()), 4 << 20)
