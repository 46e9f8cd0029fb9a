"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word is a row of part ids with the ranks of adjacent pairs beside it; the lowest rank is merged, its boundary is
deleted and the two neighbouring ranks are refreshed, again and again until no pair has a rank. Words of equal
length are rows of one matrix, so each step of the scan is one numpy call for all of them; words too long for a
matrix use a heap over linked parts, with the same order of merges.

Each worker keeps bounded caches of pieces that it has met. The vocabulary's path is a parameter; every
executor must be able to read it (a file of an installed package, for example).

Defined cases: null counts as empty, an empty text has no ids; a special token's string within a text is that token; repeated
rows and null ids are encoded like any other; an empty table gives an empty result; other columns are ignored or pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from rillflow.llm.common import batch_of, factorised, gathered, lean, no_cycles, slices_of

#: White space as the vocabulary's split pattern knows it.
WHITE = "\t-\r \x85\xa0  -     　"
#: A text falls into these pieces without cutting any word of the split pattern below.
PIECE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: The public split pattern of byte-level BPE vocabularies.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: A space beside other white space, or at an end: texts with none of these fall into pieces at their spaces.
ODD = f"^ | $| [{WHITE}]|[{WHITE}] "
NO_RANK = np.int64(1 << 40)
MATRIX = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class ByteBPE:
    def __init__(self, path: str, cache: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [b""] * (max(*vocab.values(), *self.special.values()) + 1)
        for t, i in vocab.items():
            self.token[i] = bytes(back[c] for c in t)
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.size = np.array([len(t) for t in self.token])
        self.first = np.cumsum(self.size) - self.size
        self.of_byte = np.array([vocab[s] for s in symbols], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.cache = cache

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], NO_RANK)

    def _matrix(self, words: list[bytes]) -> list[bytes]:
        """Words of one length: delete the boundary of lowest rank in every row, until a row has none."""
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(len(words)), [b""] * len(words)
        while True:
            n, width = ids.shape
            least = ranks.min(1) if width > 1 else np.full(n, NO_RANK)
            done = least >= NO_RANK
            if done.any():
                ended = ids[done].astype("<u4")
                for r, x in zip(row[done].tolist(), ended):
                    out[r] = x.tobytes()
                ids, ranks, row, least = ids[~done], ranks[~done], row[~done], least[~done]
                n = len(row)
            if not n:
                return out
            each, at = np.arange(n), ranks.argmin(1)
            ids[each, at] = self.merged[least]
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[each, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            r = each[at > 0]
            c = at[r]
            ranks[r, c - 1] = self.ranks(ids[r, c - 1], ids[r, c])
            r = each[at < width - 2]
            c = at[r]
            ranks[r, c] = self.ranks(ids[r, c], ids[r, c + 1])

    def _long(self, word: bytes) -> bytes:
        """The same merges for a long word: a heap of (rank, place) over linked parts."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)]
        first = self.ranks(ids[:-1], ids[1:])
        ids, after, before = ids.tolist(), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap = [(r, p) for p, r in enumerate(first.tolist()) if r < NO_RANK]
        heapq.heapify(heap)
        pair = {p: r for r, p in heap}

        def refresh(p: int) -> None:
            pair.pop(p, None)
            if p >= 0 and after[p] < len(word):
                r = int(self.ranks(np.array([ids[p]]), np.array([ids[after[p]]]))[0])
                if r < NO_RANK:
                    pair[p] = r
                    heapq.heappush(heap, (r, p))

        while heap:
            r, p = heapq.heappop(heap)
            if pair.get(p) != r:
                continue
            q = after[p]
            ids[p], ids[q] = int(self.merged[r]), -1
            pair.pop(q, None)
            after[p] = after[q]
            if after[p] < len(word):
                before[after[p]] = p
            refresh(p)
            refresh(before[p])
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (unsigned 32-bit, little-endian) of each word, which is encoded for itself."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        out = [b""] * len(words)
        for length, at in by_length.items():
            if length > MATRIX:
                got = [self._long(words[i]) for i in at]
            elif length:
                got = [x for k in range(0, len(at), 50_000) for x in self._matrix([words[i] for i in at[k : k + 50_000]])]
            else:
                continue
            for i, x in zip(at, got):
                out[i] = x
        return out

    def _learn(self, missing: list[str]) -> None:
        for s, i in self.special.items():
            self.pieces[" \n" + s] = int(i).to_bytes(4, "little")
        missing = [p for p in missing if p not in self.pieces]
        split = [WORD.findall(p) for p in missing]
        need = {w for s in split for w in s}
        new = [w for w in need if w not in self.words]
        if len(self.words) + len(new) > self.cache:
            self.words = {w: self.words[w] for w in need if w in self.words}
        self.words.update(zip(new, self.encode_words([w.encode() for w in new])))
        get = self.words.__getitem__
        self.pieces.update((p, get(s[0]) if len(s) == 1 else b"".join(map(get, s))) for p, s in zip(missing, split))

    def _cut(self, text: str) -> list[str]:
        if self.split and any(s in text for s in self.special):
            # A special token is a piece with a mark before it, which no piece of the pattern can be.
            return [p for k, x in enumerate(self.split.split(text)) for p in ([" \n" + x] if k % 2 else PIECE.findall(x))]
        return PIECE.findall(text)

    def _ids(self, met: list[str]) -> list[bytes]:
        with no_cycles():
            return self._held(met)

    def _held(self, met: list[str]) -> list[bytes]:
        missing = [p for p in met if p not in self.pieces]
        if len(self.pieces) + len(missing) > self.cache:  # what this run of texts uses stays
            self.pieces = {p: self.pieces[p] for p in met if p in self.pieces}
        if missing:
            self._learn(missing)
        return list(map(self.pieces.__getitem__, met))

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Texts in which every space stands alone: a space starts the piece that follows it."""
        met, which, per_text = factorised(pc.split_pattern(texts, " "))
        starts = np.cumsum(per_text) - per_text
        after = np.ones(len(which), bool)
        after[starts] = False
        spaced = np.zeros(len(met), bool)
        spaced[which[after]] = True
        spaced = np.flatnonzero(spaced)
        first = np.unique(which[starts])
        place, keys = np.full(len(met), -1), [" " + met[i] for i in spaced.tolist()]
        place[spaced] = np.arange(len(spaced))
        index = place[which]
        place[first] = len(spaced) + np.arange(len(first))
        index[starts] = place[which[starts]]
        held = self._ids(keys + [met[i] for i in first.tolist()])
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        pool, at = np.frombuffer(b"".join(held), "<u4"), np.cumsum(size) - size
        each = size[index]
        ids = gathered(pool, at[index], each)
        ends = np.r_[0, np.cumsum(each)][np.r_[starts, len(which)]]
        return [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list = [None] * len(column)
        for at, rows in slices_of(column):
            odd = pc.match_substring_regex(rows, ODD).to_numpy(zero_copy_only=False)
            for s in self.special:
                odd |= pc.match_substring(rows, s).to_numpy(zero_copy_only=False)
            plain = np.flatnonzero(~odd)
            if len(plain):
                for i, x in zip(plain.tolist(), self._plain(rows.take(pa.array(plain)))):
                    out[at + i] = x
            for i in np.flatnonzero(odd).tolist():
                cut = self._cut(rows[i].as_py())
                met = list(set(cut))
                held = dict(zip(met, self._ids(met)))
                out[at + i] = np.frombuffer(b"".join(map(held.__getitem__, cut)), "<u4")
        return out

    def forget(self) -> None:
        """At the end of a task: the caches hold what a few batches need, and a worker that waits shall not keep them."""
        self.pieces, self.words = {}, {}

    def decode(self, ids: np.ndarray) -> str:
        return gathered(self.bytes, self.first[ids], self.size[ids]).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    """One per worker."""
    return ByteBPE(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): unsigned 32-bit little-endian ids of each whole text. No shuffle."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    @lean
    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            yield batch_of(out, b.column(0).cast(pa.int64()), [x.tobytes() for x in bpe.encode(b.column(1))])
        bpe.forget()

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give an empty text."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    @lean
    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            yield batch_of(out, b.column(0).cast(pa.int64()), [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(1).to_pylist()])

    return encoded.select(id_col, ids_col).mapInArrow(run, "doc_id long, text string")


def bpe_encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, text): each text's ids, and the text that they decode to, in one pass."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    @lean
    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = bpe.encode(part.column(1))
                yield batch_of(out, part.column(0).cast(pa.int64()), [x.tobytes() for x in ids], [bpe.decode(x) for x in ids])
        bpe.forget()

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, ids binary, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode of each text in one pass, as digests."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @lean
    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            ids = bpe.encode(b.column(1))
            yield batch_of(out, b.column(0).cast(pa.int64()), [len(x) for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids])
        bpe.forget()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
