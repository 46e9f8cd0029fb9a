"""Suffix-array dedup of long repeated byte strings, as logarithmic index families over content buckets.

A string of `span` bytes that starts in two documents makes later copies removable. Documents come in batches (contiguous
id ranges). For each bucket of content, every batch gets a suffix array of its pieces, truncated at `span` bytes; the array is
merge-scanned against the levels of the family that the batches before it have left, and then becomes a level itself;
levels of equal size class merge, so that a family of n strings has at most log2(n) levels.

What a bucket is: every window of `span` bytes has a minimizer, the least hash of its k-byte strings. Equal windows have equal
minimizers, so the minimizer's hash range is the bucket, and runs of windows with one minimizer travel as one
piece of text. Two exchanges keep the volume small: the first sends only hashes (40 bits beside the bucket) and returns to each batch
those that another batch or document has too; the second sends the text of these windows only, each distinct piece
once for each batch with its smallest id, and returns which windows an earlier document has. Minimizers that one batch meets very often in different
surroundings are dealt by their windows' own hashes instead, so that no bucket is hot.

Defined cases: null counts as empty; texts shorter than `span` keep everything; rows with null ids keep everything and remove
nothing; rows with equal ids do not remove from each other; an empty table gives an empty result; other columns are ignored. Strings are
judged on the input, and every covered byte goes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import MOST_PARTITIONS, batch_of, dealt, no_cycles, part_edges, part_of, parted, stored, text_bytes

SPAN, GRAM, PIECE_WINDOWS, HEAVY, MANY_BATCHES, BATCH_WINDOWS = 50, 24, 32, 64, 512, 1 << 18
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every place on."""
    eight = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw).data, strides=(1,))
    n = len(raw) - GRAM + 1
    h = eight[:n] * MIX[0]
    h ^= h >> np.uint64(29)
    h += eight[8 : n + 8]
    h *= MIX[1]
    h ^= h >> np.uint64(31)
    h += eight[16 : n + 16]
    h *= MIX[2]
    h ^= h >> np.uint64(32)
    return h


def _minima(h: np.ndarray, window: int) -> np.ndarray:
    done, out = 1, h
    while 2 * done <= window:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < window:
        rest = window - done
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def window_runs(raw: np.ndarray, ends: np.ndarray, chunk: int = 1 << 18):
    """(first window, windows, minimizer) of runs of at most PIECE_WINDOWS windows with one minimizer, inside documents.

    raw: the documents' bytes one after another; ends: their ends. Windows do not depend on the chunks.
    """
    firsts, counts, hashes = [], [], []
    total = len(raw) - SPAN + 1
    blocked = np.zeros(len(raw) + 1, np.int32)  # windows that cross a document's end
    lo, hi = np.maximum(ends - SPAN + 1, np.r_[0, ends[:-1]]), ends
    np.add.at(blocked, lo, 1)
    np.add.at(blocked, hi, -1)
    blocked = np.cumsum(blocked[:-1]) > 0
    for at in range(0, max(0, total), chunk):
        to = min(total, at + chunk)
        least = _minima(_grams(raw[at : to + SPAN - 1]), SPAN - GRAM + 1)
        ok = ~blocked[at:to]
        edge = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])])
        size = np.diff(np.r_[edge, to - at])
        keep = ok[edge]
        edge, size = edge[keep], size[keep]
        pieces = -(-size // PIECE_WINDOWS)
        first = np.repeat(edge, pieces)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first + nth * PIECE_WINDOWS
        firsts.append(start + at)
        counts.append(np.minimum(np.repeat(size, pieces) - nth * PIECE_WINDOWS, PIECE_WINDOWS))
        hashes.append(least[start])
    if not firsts:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(hashes)


def _batch(t: pa.Table):
    """ids, bytes of all texts in id order, and their ends. Rows with null ids are the last of order."""
    t = t.sort_by("id")
    texts = pc.fill_null(t.column("text"), "").combine_chunks().cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset] if len(texts) else 0
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offset : offset + (ends[-1] if len(ends) else 0)] if len(texts) and texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return t.column("id"), raw, ends


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


SHORT = np.uint64((1 << 40) - 1)


def _announce(buckets: int, batches: int):
    """Per batch: its distinct hashes for each bucket, with two marks: several documents have it, very many places have it."""
    out = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("hashes", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        if part >= batches:  # null ids
            return out.empty_table()
        ids, raw, ends = _batch(t)
        first, _, h = window_runs(raw, ends)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], np.searchsorted(ends, first[order], "right")
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        last = np.r_[at[1:], len(h)] - 1
        # Documents of equal id count as several here; the second exchange decides.
        marks = (doc[last] != doc[at]).astype(np.uint64) | ((last - at + 1 >= HEAVY).astype(np.uint64) << np.uint64(1))
        key, where = h[at], _bucket(h[at], buckets)
        value = ((key & SHORT) << np.uint64(2)) | marks
        order = np.lexsort((value, where))
        value, where = value[order].astype("<u8"), where[order]
        cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else np.empty(0, np.int64)
        packed = value.view(np.uint8).reshape(-1, 8)[:, :6]
        return pa.Table.from_batches([batch_of(out, where[cut], np.full(len(cut), part), [packed[i:j].tobytes() for i, j in zip(cut, np.r_[cut[1:], len(where)])])], out)

    return run


def _unpack(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view("<u8")[:, 0]


def _answer(t: pa.Table) -> pa.Table:
    """Per bucket: which of each batch's hashes are shared, with the mark of hot ones."""
    out = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary())])
    parts, blobs = t.column("part").to_pylist(), [_unpack(b) for b in t.column("hashes").to_pylist()]
    every = np.concatenate(blobs)
    key = every >> np.uint64(2)
    order = np.argsort(key, kind="stable")
    s = key[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    n = np.diff(np.r_[at, len(s)])
    marks = np.bitwise_or.reduceat(every[order] & np.uint64(3), at)
    shared = (n > 1) | ((marks & np.uint64(1)) > 0)
    # hot: one batch has met it in very many places, or very many batches have it
    keys, hot = s[at][shared], ((marks[shared] >> np.uint64(1)) | (n[shared] >= MANY_BATCHES)).astype(np.uint64)
    rows = []
    for part, blob in zip(parts, blobs):
        mine = np.searchsorted(keys, blob >> np.uint64(2))
        mine[mine == len(keys)] = 0
        hit = mine[keys[mine] == blob >> np.uint64(2)] if len(keys) else mine[:0]
        if len(hit):
            value = ((keys[hit] << np.uint64(2)) | hot[hit]).astype("<u8")
            rows.append((part, value.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
    bucket = t.column("bucket")[0].as_py()
    return pa.Table.from_batches([batch_of(out, [r[0] for r in rows], [bucket] * len(rows), [r[1] for r in rows])], out)


def _shared_runs(docs: pa.Table, answers: pa.Table, buckets: int):
    """Runs of one batch whose hashes are shared: (ids, raw, ends, first, windows, bucket); hot ones window by window."""
    ids, raw, ends = _batch(docs)
    first, count, h = window_runs(raw, ends)
    known = [(b, _unpack(x)) for b, x in zip(answers.column("bucket").to_pylist(), answers.column("hashes").to_pylist())]
    if not known or not len(h):
        none = np.empty(0, np.int64)
        return ids, raw, ends, none, none, none
    # (bucket, short hash) as one number: buckets are fewer than 2^22 by _plan
    full = np.sort(np.concatenate([(np.uint64(b) << np.uint64(42)) | v for b, v in known]))
    bucket = _bucket(h, buckets)
    mine = (bucket.astype(np.uint64) << np.uint64(42)) | ((h & SHORT) << np.uint64(2))
    at = np.searchsorted(full, mine)
    at[at == len(full)] = len(full) - 1
    hit = (full[at] | np.uint64(1)) == (mine | np.uint64(1))
    hot = hit & ((full[at] & np.uint64(1)) == 1)
    cold = hit & ~hot
    f, c, b = first[cold], count[cold], bucket[cold]
    if hot.any():
        each = np.repeat(first[hot], count[hot])
        each = each + np.arange(len(each)) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
        own = np.zeros(len(each), np.uint64)
        for k in range(0, SPAN - 7, 7):
            own = (own ^ np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw).data, strides=(1,))[each + k]) * MIX[0]
            own ^= own >> np.uint64(31)
        f, c, b = np.r_[f, each], np.r_[c, np.ones(len(each), np.int64)], np.r_[b, _bucket(own, buckets)]
    order = np.argsort(f, kind="stable")
    return ids, raw, ends, f[order], c[order], b[order]


def _distinct(ids: pa.ChunkedArray, raw: np.ndarray, ends: np.ndarray, first: np.ndarray, count: np.ndarray):
    """The batch's distinct pieces in order of first place; each run's number among them, and each piece's first run and document."""
    whole, number, seen = memoryview(raw).tobytes(), np.empty(len(first), np.int64), {}
    find = seen.setdefault
    with no_cycles():
        for i, (f, to) in enumerate(zip(first.tolist(), (first + count + SPAN - 1).tolist())):
            number[i] = find(whole[f:to], len(seen))
    named = ids.to_numpy()
    doc = np.searchsorted(ends, first, "right")
    run = np.zeros(len(seen), np.int64)
    run[number[::-1]] = np.arange(len(number))[::-1]
    return list(seen), number, run, named[doc[run]] if len(run) else run, named, doc


def _send(buckets: int, batches: int):
    out = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("text", pa.binary()), ("windows", pa.binary()), ("number", pa.binary()), ("owner", pa.binary())])

    def run(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or docs.column("part")[0].as_py() >= batches:
            return out.empty_table()
        part = docs.column("part")[0].as_py()
        ids, raw, ends, first, count, bucket = _shared_runs(docs, answers, buckets)
        pieces, _, run_of, owner, _, _ = _distinct(ids, raw, ends, first, count)
        to, windows = bucket[run_of], count[run_of].astype(np.uint8)
        order = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]]) if len(order) else order
        rows = []
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
            mine = order[i:j]
            rows.append((int(to[mine[0]]), part, b"".join([pieces[k] for k in mine.tolist()]), windows[mine].tobytes(), mine.astype("<u4").tobytes(), owner[mine].astype("<i8").tobytes()))
        return pa.Table.from_batches([batch_of(out, *([list(c) for c in zip(*rows)] or [[]] * 6))], out)

    return run


def suffix_array(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same) of the suffixes at `starts`, compared over SPAN bytes, eight at a time.

    same[i] tells that the i-th suffix in order equals the one before it. All of start .. start + SPAN must lie in text.
    """
    eight = np.ndarray((len(text) - 7,), ">u8", np.ascontiguousarray(text).data, strides=(1,))
    columns = [eight[starts + k].astype(np.uint64) for k in (*range(0, SPAN - 8, 8), SPAN - 8)]
    order = np.lexsort(columns[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for c in columns:
        c = c[order]
        same &= c[1:] == c[:-1]
    return order, np.r_[False, same][: len(order)]


Level = tuple[np.ndarray, np.ndarray]  # sorted strings, and for each the smallest id that has it


def merged(a: Level, b: Level) -> Level:
    """Two levels as one (a merge: both halves are sorted runs). b is the later one: of equal strings a's id is the smaller."""
    both, owner = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(both, kind="stable")
    both = both[order]
    head = np.r_[True, both[1:] != both[:-1]]
    return both[head], owner[order][head]


class Family:
    """Levels of sorted strings, geometrically sized: adding a batch merges levels of its size class."""

    def __init__(self):
        self.levels: list[Level] = []

    def scan(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """For each of the sorted keys the smallest id that has it, by all levels and its own."""
        least = owner.copy()
        for level, held in self.levels:
            at = np.searchsorted(level, keys)
            at[at == len(level)] = 0
            hit = level[at] == keys
            least[hit] = np.minimum(least[hit], held[at[hit]])
        return least

    def add(self, keys: np.ndarray, owner: np.ndarray) -> None:
        level = keys, owner
        while self.levels and self.levels[-1][0].size.bit_length() <= level[0].size.bit_length():
            level = merged(self.levels.pop(), level)
        if level[0].size:
            self.levels.append(level)


def _scan(family: Family, pending: list[tuple], found: dict[int, list[tuple[int, int]]]) -> None:
    """One batch of new pieces: its suffix array, the merge-scan against the family's levels, and the new level."""
    text = np.frombuffer(b"".join([p[2] for p in pending]), np.uint8)
    windows = np.array([len(p[2]) - SPAN + 1 for p in pending], np.int64)
    owner = np.array([p[3] for p in pending], np.int64)
    begin = np.cumsum(windows + SPAN - 1) - (windows + SPAN - 1)
    piece = np.repeat(np.arange(len(windows)), windows)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = begin[piece] + inner
    order, same = suffix_array(text, starts)
    head = np.flatnonzero(~same)
    least = np.minimum.reduceat(owner[piece[order]], head)
    size = np.diff(np.r_[head, len(order)])
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, SPAN)[starts[order[head]]]).view(f"S{SPAN}")[:, 0]
    # An "S" string ends at its last byte that is not 0, so equal here means equal bytes: all have SPAN of them.
    held = owner[piece[order]] > np.repeat(family.scan(keys, least), size)
    family.add(keys, least)
    hit = order[held]
    mask = np.zeros(len(windows), np.uint64)
    np.bitwise_or.at(mask, piece[hit], np.left_shift(np.uint64(1), inner[hit].astype(np.uint64)))
    for i in np.flatnonzero(mask).tolist():
        found.setdefault(pending[i][0], []).append((pending[i][1], int(mask[i])))


def _scan_bucket(t: pa.Table) -> pa.Table:
    """Per bucket: batches in id order; which windows of each piece an earlier document has, as a mask for its first document.

    A piece that a document of smaller id sent in the same bytes is found as a whole. Small batches that follow each other share one
    suffix array. Batches of one id, if it fills several, are told apart by the ids that go with all strings.
    """
    out = pa.schema([("part", pa.int32()), ("number", pa.binary()), ("mask", pa.binary())])
    t = t.sort_by("part")
    family, seen, pending, waiting = Family(), {}, [], 0
    found: dict[int, list[tuple[int, int]]] = {}
    with no_cycles():
        for r in range(t.num_rows):
            part, text = t.column("part")[r].as_py(), t.column("text")[r].as_py()
            windows = np.frombuffer(t.column("windows")[r].as_py(), np.uint8).astype(np.int64)
            number = np.frombuffer(t.column("number")[r].as_py(), "<u4").tolist()
            owner = np.frombuffer(t.column("owner")[r].as_py(), "<i8").tolist()
            ends = np.cumsum(windows + SPAN - 1)
            for n, o, i, j in zip(number, owner, (ends - windows - SPAN + 1).tolist(), ends.tolist()):
                piece = text[i:j]
                if seen.setdefault(piece, o) < o:
                    found.setdefault(part, []).append((n, (1 << (j - i - SPAN + 1)) - 1))
                else:
                    pending.append((part, n, piece, o))
                    waiting += j - i - SPAN + 1
            if waiting >= BATCH_WINDOWS:
                _scan(family, pending, found)
                pending, waiting = [], 0
        if pending:
            _scan(family, pending, found)
    rows = [(part, np.array([n for n, _ in x], "<u4").tobytes(), np.array([m for _, m in x], "<u4").tobytes()) for part, x in found.items()]
    return pa.Table.from_batches([batch_of(out, *([list(c) for c in zip(*rows)] or [[]] * 3))], out)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(buckets: int, batches: int, with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    out = pa.schema([*fields, *([("kept", pa.binary())] if with_text else [])])

    def run(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        """Two kinds of replies: answers (hashes) and masks; runs are found again, as they were sent."""
        if not docs.num_rows:
            return out.empty_table()
        answers = replies.filter(pc.is_valid(replies.column("hashes")))
        masks = replies.filter(pc.is_valid(replies.column("mask")))
        ids, raw, ends = _batch(docs)
        cover = np.zeros(len(raw) + 1, np.int32)
        if docs.column("part")[0].as_py() < batches and answers.num_rows:
            ids, raw, ends, first, count, bucket = _shared_runs(docs, answers, buckets)
            pieces, number, _, owner, named, doc = _distinct(ids, raw, ends, first, count)
            mask = np.zeros(len(pieces), np.uint32)
            del pieces
            for n, m in zip(masks.column("number").to_pylist(), masks.column("mask").to_pylist()):
                mask[np.frombuffer(n, "<u4")] = np.frombuffer(m, "<u4")
            later = named[doc] > owner[number] if len(number) else np.empty(0, bool)
            all_of = np.where(count >= 32, np.uint32(0xFFFFFFFF), (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
            bits = np.where(later, all_of, mask[number]) if len(number) else np.empty(0, np.uint32)
            hit = np.flatnonzero(bits)
            for k in range(0, len(hit), 1 << 15):
                some = hit[k : k + (1 << 15)]
                set_ = ((bits[some, None] >> np.arange(PIECE_WINDOWS, dtype=np.uint32)) & 1).astype(bool)
                start = (first[some, None] + np.arange(PIECE_WINDOWS))[set_]  # no window is in two runs
                cover[start] += 1
                cover[start + SPAN] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        begins = gone & ~np.r_[False, gone[:-1]]
        begins[np.r_[0, ends[:-1]][np.r_[0, ends[:-1]] < len(gone)]] |= gone[np.r_[0, ends[:-1]][np.r_[0, ends[:-1]] < len(gone)]]
        sums, spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(begins)]
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        kept = [raw[i:j][~gone[i:j]].tobytes() for i, j in zip(starts.tolist(), ends.tolist())]
        columns = [ids.combine_chunks(), ends - starts, sums[ends] - sums[starts], spans[ends] - spans[starts], [hashlib.sha256(k).hexdigest() for k in kept]]
        return pa.Table.from_batches([batch_of(out, *columns, *([kept] if with_text else []))], out)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 8 << 20, bucket_hashes: int = 500_000, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    n_bytes = text_bytes(docs, text_col)
    edges = part_edges(docs, id_col, n_bytes, part_bytes)
    batches = len(edges) + 1
    nulls = math.ceil(text_bytes(docs.filter(F.col(id_col).isNull()), text_col) / part_bytes)
    parts = batches + max(1, nulls)  # the last ones hold rows with null ids
    # A minimizer is new about every (window + 1) / 2 bytes; the hash's upper 24 bits tell that many buckets apart, enough for 137 TB.
    buckets = min(1 << 24, max(1, math.ceil(n_bytes * 2 / (SPAN - GRAM + 2) / bucket_hashes)))
    base = parted(docs, id_col, text_col, part_of(id_col, text_col, edges, nulls), parts)
    told = base.groupBy("part").applyInArrow(_announce(buckets, batches), "bucket int, part int, hashes binary")
    answers = stored(told.repartition(min(buckets, MOST_PARTITIONS), "bucket").groupBy("bucket").applyInArrow(_answer, "part int, bucket int, hashes binary"), "none")
    sent = base.groupBy("part").cogroup(dealt(answers, parts, "part").groupBy("part")).applyInArrow(_send(buckets, batches), "bucket int, part int, text binary, windows binary, number binary, owner binary")
    masks = sent.repartition(min(buckets, MOST_PARTITIONS), "bucket").groupBy("bucket").applyInArrow(_scan_bucket, "part int, number binary, mask binary")
    none = F.lit(None).cast("binary")
    replies = answers.select("part", "bucket", "hashes", none.alias("number"), none.alias("mask")).unionByName(masks.select("part", F.lit(None).cast("int").alias("bucket"), none.alias("hashes"), "number", "mask"))
    return base.groupBy("part").cogroup(dealt(replies, parts, "part").groupBy("part")).applyInArrow(_remove(buckets, batches, with_text), RESULT + (", kept binary" if with_text else ""))
