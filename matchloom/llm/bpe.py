"""Byte-pair encoding and decoding in batches with numpy.

Texts are cut into pieces by the vocabulary's pattern; the distinct pieces of a batch that no table
knows yet are merged together: one flat array holds the symbols of all of them, each round looks up
every adjacent pair by binary search among sorted pair keys and merges the lowest rank of each piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from matchloom.llm.common import small_batches, utf8

#: Fixed pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_PIECES = 200_000
#: Bytes from which a piece is merged by itself, with the same result.
LONG_PIECE = 1000
NO_RANK = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Arrays of one byte-level BPE vocabulary: sorted pair keys with rank and product, token bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = _byte_letters(), spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.by_byte = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.by_byte[b] = ids[letter]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: bytes(letters[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(tokens) + 1
        parts = [tokens.get(i, b"") for i in range(size)]
        self.length = np.array([len(t) for t in parts], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)


def merge_long(vocab: Vocabulary, piece: bytes) -> np.ndarray:
    """Token ids of one long piece, whose rounds would each pass over all of it: the lowest pair comes from a heap."""
    symbols = vocab.by_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known: dict[tuple[int, int], tuple[int, int] | None] = {}

    def rank(i):
        pair = symbols[i], symbols[after[i]]
        if pair not in known:
            key = pair[0] << 32 | pair[1]
            at = int(np.searchsorted(vocab.keys, key))
            known[pair] = (int(vocab.ranks[at]), int(vocab.made[at])) if at < len(vocab.keys) and vocab.keys[at] == key else None
        return known[pair]

    heap = [(r[0], i, symbols[i], symbols[i + 1], r[1]) for i in range(n - 1) if (r := rank(i))]
    heapify(heap)
    while heap:
        _, i, left, right, made = heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j] = made, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for at in (before[i], i):
            if at >= 0 and after[at] < n and (r := rank(at)):
                heappush(heap, (r[0], at, symbols[at], symbols[after[at]], r[1]))
    return np.array([s for s in symbols if s >= 0], dtype=np.uint32)


def merge(vocab: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, one after another, and the number of ids of each."""
    if any(len(p) > LONG_PIECE for p in pieces):
        found = [merge_long(vocab, p) if len(p) > LONG_PIECE else None for p in pieces]
        ids, sizes = merge(vocab, [p if f is None else b"" for p, f in zip(pieces, found)])
        at = np.cumsum(sizes) - sizes
        parts, last = [], 0
        for k, f in enumerate(found):
            if f is not None:
                parts += [ids[last : at[k]], f]
                last, sizes[k] = at[k], len(f)
        return np.concatenate([*parts, ids[last:]]), sizes
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    symbols = vocab.by_byte[data]
    piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        key = symbols[:-1] << 32 | symbols[1:]
        at = np.searchsorted(vocab.keys, key)
        at[at == len(vocab.keys)] = 0
        rank = np.where((vocab.keys[at] == key) & (piece[:-1] == piece[1:]), vocab.ranks[at], NO_RANK)
        rank = np.r_[rank, NO_RANK]
        first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        lowest = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.r_[first, len(symbols)])
        still = np.repeat(lowest != NO_RANK, sizes)
        if not still.all():
            done.append((piece[~still], symbols[~still]))
        hit = still & (rank == np.repeat(lowest, sizes))
        # Of overlapping pairs in a run of equal symbols only every second one, from the left, merges.
        chain = hit & np.r_[False, hit[:-1]]
        if chain.any():
            spot = np.arange(len(hit))
            origin = np.maximum.accumulate(np.where(chain, 0, spot))
            hit &= (spot - origin) % 2 == 0
        i = np.flatnonzero(hit)
        symbols = symbols.copy()
        symbols[i] = vocab.made[at[i]]
        still[i + 1] = False
        symbols, piece = symbols[still], piece[still]
    owner = np.concatenate([d[0] for d in done]) if done else np.empty(0, np.int64)
    token = np.concatenate([d[1] for d in done]) if done else np.empty(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return token[order].astype(np.uint32), np.bincount(owner, minlength=len(pieces))


#: The same pattern spelt for texts of Latin letters only, where the plain engine is faster.
_LETTERS, _DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(PATTERN.replace(r"\p{L}", "#L").replace(r"\p{N}", "#N").replace("[^\\s#L#N]", rf"[^\s{_LETTERS}{_DIGITS}]").replace("#L", f"[{_LETTERS}]").replace("#N", f"[{_DIGITS}]"))
_OTHER = re.compile("[^\x00-\x1b\x20-\u024f]").search


class _Pieces(dict):
    """Numbers pieces as they are first seen."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.any, self.latin = regex.compile(PATTERN).findall, _LATIN.findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")").split if vocab.special else None
        self._forget()

    def _forget(self) -> None:
        self.known, self.tokens, self.sizes = _Pieces(), np.empty(0, np.uint32), np.empty(0, np.int64)

    def find(self, text: str) -> list[str]:
        return self.any(text) if _OTHER(text) else self.latin(text)

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(t in text for t in self.vocab.special):
            return self.find(text)
        return [p for part in self.cut(text) for p in ([part] if part in self.vocab.special else self.find(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids (unsigned 32-bit) of all texts in one array, and the offsets of the texts."""
        if len(self.known) > KNOWN_PIECES:
            self._forget()
        cut = [self.pieces(t) for t in texts]
        number = np.fromiter((n for ps in cut for n in map(self.known.__getitem__, ps)), dtype=np.int64)
        if len(self.known) > len(self.sizes):
            new = list(islice(self.known, len(self.sizes), None))
            special = [i for i, p in enumerate(new) if p in self.vocab.special]
            ids, sizes = merge(self.vocab, [b"" if p in self.vocab.special else p.encode() for p in new])
            where = (np.cumsum(sizes) - sizes)[special]
            sizes[special] = 1
            ids = np.insert(ids, where, [self.vocab.special[new[i]] for i in special])
            self.tokens = np.concatenate([self.tokens, ids.astype(np.uint32)])
            self.sizes = np.concatenate([self.sizes, sizes])
        starts = np.cumsum(self.sizes) - self.sizes
        size = self.sizes[number]
        flat = self.tokens[_spread(starts[number], size)]
        ends = np.cumsum([0, *(len(ps) for ps in cut)])
        return flat, np.r_[0, np.cumsum(size)][ends]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each decoded text; bytes that are no UTF-8 become the replacement character."""
        ids = ids.astype(np.int64)
        size = self.vocab.length[ids]
        data = self.vocab.bytes[_spread(self.vocab.start[ids], size)].tobytes()
        ends = np.r_[0, np.cumsum(size)][offsets]
        return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends[:-1], ends[1:])]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One encoder a worker process; the file is read where the task runs, the path is a parameter."""
    return Encoder(Vocabulary(path))


def _rows(path, keep_ids, batches):
    encoder = _encoder(path)
    for batch in small_batches(batches, 4 << 20):
        offsets, data = utf8(batch.column(1))
        ids, at = encoder.encode([str(data[a:b], "utf-8") for a, b in zip(offsets[:-1], offsets[1:])])
        raw = memoryview(ids.astype("<u4").tobytes())
        out = [
            batch.column(0), pa.array(np.diff(at), pa.int64()),
            pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in encoder.decode(ids, at)], pa.string()),
        ]
        if keep_ids:
            out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
        yield pa.record_batch(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])


def encode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids of every row.

    The same ids as the vocabulary's own library gives: special tokens inside a text are recognised,
    none is added. Null and empty texts have no ids. Texts are encoded whole; extra columns are
    ignored; repeated rows give repeated rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(partial(_rows, path, keep_ids), schema)
