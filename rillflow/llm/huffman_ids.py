"""Token ids as canonical length-limited Huffman code, in blocks that decode independently.

Code lengths come from counts over the whole corpus (package-merge, so no code is longer than the limit); the code is
canonical, so the lengths are the whole code book. A block holds the ids of a run of documents in ascending id order:

    magic "RHF1" | u32 documents | u64 tokens | u32 spacing | u32 checkpoints | u8 max length
    | i64 doc ids | u8 null flags | u32 tokens of each document | u64 bit offset at each checkpoint | bits

A checkpoint gives the bit offset of every `spacing`-th id. Decoding looks up `max length` bits at a time in one table and
follows all checkpoints of a block in step. Blocks are rows of a Parquet table in the shared folder (any file
system that Spark writes), in id order over its files and numbered by it; the code book is a table beside them.

Defined cases: null counts as empty, and an empty document still has its end id; null doc ids come first; rows with
equal ids keep all their tokens, in any order among themselves; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import LOWER, batch_of, factorised, gathered, no_cycles, shared_dir, slices_of

MAGIC, HEAD = b"RHF1", struct.Struct("<4sIQIIB")


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge). Ids that never occur have length 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("the limit is too small for so many ids")
    order = np.argsort(counts[used], kind="stable")
    weight = counts[used][order].astype(np.float64)
    packed, kinds = np.empty(0), []
    for _ in range(limit):
        both = np.concatenate([weight, packed])
        by = np.argsort(both, kind="stable")
        both = both[by]
        kinds.append(by < len(weight))
        pairs = len(both) // 2
        packed = both[: 2 * pairs : 2] + both[1 : 2 * pairs : 2]
    take, depth = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(kinds):
        mine = int(leaf[:take].sum())
        depth[:mine] += 1
        take = 2 * (take - mine)
    lengths[used[order]] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length for each value of the next max-length bits."""
    most = max(1, int(lengths.max(initial=1)))
    ids, sizes = np.zeros(1 << most, np.uint32), np.ones(1 << most, np.uint8)
    codes = canonical_codes(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.left_shift(1, most - lengths[order].astype(np.int64))
    filled = np.repeat(order, span)
    ids[: len(filled)], sizes[: len(filled)] = filled, lengths[filled]
    assert not len(order) or int(codes[order[0]]) == 0
    return ids, sizes, most


def encode_block(doc_ids: list, tokens: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray, spacing: int) -> bytes:
    ids = np.concatenate(tokens) if tokens else np.empty(0, np.uint32)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    most = max(1, int(lengths.max(initial=1)))
    # Runs of `group` codes make one left-aligned 64-bit word; the bits that count are picked from all words at once.
    group = max(1, 64 // most)
    padded = np.zeros(-(-len(ids) // group) * group, np.int64)
    padded[: len(ids)] = ids
    length = lengths[padded].astype(np.uint64)
    length[len(ids) :] = 0
    code = codes[padded].astype(np.uint64)
    code[len(ids) :] = 0
    code, length = code.reshape(-1, group), length.reshape(-1, group)
    word, total = code[:, 0].copy(), length[:, 0].copy()
    for k in range(1, group):
        word = (word << length[:, k]) | code[:, k]
        total += length[:, k]
    word = np.where(total > 0, word << (np.uint64(64) - np.maximum(total, 1)), 0).astype(">u8")
    place, total = np.arange(64, dtype=np.uint8), total.astype(np.uint8)
    bits = []
    for at in range(0, len(word), 1 << 15):
        row = np.unpackbits(word[at : at + (1 << 15)].view(np.uint8)).reshape(-1, 64)
        bits.append(row[place[None, :] < total[at : at + (1 << 15), None]])
    stream = np.packbits(np.concatenate(bits)).tobytes() if bits else b""
    checks = (ends - size)[::spacing].astype("<u8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    named = np.array([0 if d is None else d for d in doc_ids], "<i8")
    counts = np.array([len(t) for t in tokens], "<u4")
    return HEAD.pack(MAGIC, len(doc_ids), len(ids), spacing, len(checks), most) + named.tobytes() + nulls.tobytes() + counts.tobytes() + checks.tobytes() + stream


def decode_block(block: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, tokens of each document, all ids)."""
    magic, docs, n, spacing, checks, _ = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at = HEAD.size
    named = np.frombuffer(block, "<i8", docs, at)
    nulls = np.frombuffer(block, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(block, "<u4", docs, at + 9 * docs)
    offset = np.frombuffer(block, "<u8", checks, at + 13 * docs).astype(np.int64)
    stream = np.frombuffer(block, np.uint8, offset=at + 13 * docs + 8 * checks)
    ids, sizes, most = table
    out = np.zeros((checks, spacing), np.uint32)
    padded = np.concatenate([stream, np.zeros(16, np.uint8)])
    # 32 bits from every byte on, so that a look-up is one gather, one shift and one mask.
    window = (padded[:-3].astype(np.uint32) << 24) | (padded[1:-2].astype(np.uint32) << 16) | (padded[2:-1].astype(np.uint32) << 8) | padded[3:]
    last = len(stream) * 8
    for k in range(spacing):
        live = checks if k < (n - 1) % spacing + 1 else checks - 1  # only the last run can be short
        bit = np.minimum(offset[:live], last)
        peek = (window[bit >> 3] >> (32 - most - (bit & 7)).astype(np.uint32)) & np.uint32((1 << most) - 1)
        out[:live, k] = ids[peek]
        offset[:live] += sizes[peek]
    return [None if z else int(d) for d, z in zip(named, nulls)], counts, out.reshape(-1)[:n]


#: Punctuation that the vocabulary's split pattern and lower-casing treat apart from letters (no marks, apostrophes or special tokens).
PUNCTUATION = "!-&(-/:;?@\\[-`{}~"
#: Letters that stay one letter in lower case: A-Z, a-z and U+00C0 to U+024F without the two signs among them and without U+0130, which
#: becomes i and a mark.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: Pieces that the split pattern keeps whole, so that they end at the one id that ends a word.
WHOLE = re.compile(f"[{LETTERS}]+|[{PUNCTUATION}]+|[0-9]")
_SOLE = re.compile(f"[{PUNCTUATION}]")
IS_MARK = np.array([b < 128 and bool(_SOLE.match(chr(b))) for b in range(256)])
IS_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
IS_SPACE = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])
#: What a vocabulary file must do for pieces between white space to be encoded apart.
NORMALISERS = ["NFC", ("Replace", "\\s+", " "), "Lowercase"]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"
#: The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 and up in order; spaces stay.
SPELT = np.arange(256, dtype="<u2")
_OTHERS = np.array([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)])
SPELT[_OTHERS] = 256 + np.arange(len(_OTHERS))
SPELT[32] = 32


def splits_at_spaces(spec: dict) -> bool:
    """Whether a vocabulary file drops white space, lower-cases and marks the ends of words, so that `LibraryTokenizer` may divide texts."""
    steps = [(n["type"], n["pattern"].get("Regex"), n["content"]) if n["type"] == "Replace" else n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = next((p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"), {})
    model = spec["model"]
    plain = all(t["special"] and "<|" in t["content"] and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    return steps == NORMALISERS and split.get("pattern", {}).get("Regex") == SPLIT and split.get("invert") is True and split.get("behavior") == "Removed" and model.get("end_of_word_suffix") == WORD_END and not model.get("dropout") and plain


def detached(rows: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and a space between a word's last letter and the punctuation that ends it.

    The vocabulary reads both alike; it leaves fewer distinct pieces to look up. rows: no nulls, no special tokens.
    """
    rows = pa.concat_arrays([rows])
    ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    raw = LOWER[np.frombuffer(rows.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends -= ends[0]
    if not len(raw):
        return rows
    mark, space, edge = IS_MARK[raw], np.r_[IS_SPACE[raw], True], np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    before = np.r_[False, mark[:-1]] & ~edge[:-1]
    after = np.r_[mark[1:], False] & ~edge[1:]
    starts, stops = np.flatnonzero(mark & ~before), np.flatnonzero(mark & ~after) + 1
    # The last letter is ASCII, or one of LETTERS of two bytes.
    last, lead = raw[np.maximum(starts - 1, 0)], raw[np.maximum(starts - 2, 0)]
    signs = ((lead == 0xC3) & ((last == 0x97) | (last == 0xB7))) | ((lead == 0xC4) & (last == 0xB0)) | ((lead == 0xC9) & (last > 0x8F))
    two = (starts > 1) & (last >= 128) & (lead >= 0xC3) & (lead <= 0xC9) & ~signs
    starts = starts[~edge[starts] & (IS_LETTER[last] | two) & (space[stops] | edge[stops])]
    offsets = (ends + np.searchsorted(starts, ends)).astype(np.int32)
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(np.insert(raw, starts, 32)))


class LibraryTokenizer:
    """The tokenizers library, asked once for each piece between white space that a bounded cache does not hold.

    The cache is one run of ids and, for each piece, its place there. Pieces that are one word go to the vocabulary's model side by side,
    in long lines that are lower-cased and spelt in its byte alphabet already, and are told apart by the ids that end words; others are
    encoded one by one. A vocabulary of other habits encodes whole texts.
    """

    def __init__(self, path: str, cache: int = 500_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            self.divides = splits_at_spaces(json.load(f))
        self.cache = cache
        if self.divides:
            self.ends_word = np.zeros(self.size, bool)
            self.ends_word[[i for w, i in self.lib.get_vocab(with_added_tokens=False).items() if w.endswith(WORD_END)]] = True
            self.words = Tokenizer(self.lib.model)
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.place: dict[str, int] = {}
            self.pool, self.first, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ids(self, texts: list[str], lib=None) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in (lib or self.lib).encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, pieces: list[str]) -> None:
        """Forgets all but these pieces, which are held."""
        at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        self.pool, self.sizes = gathered(self.pool, self.first[at], self.sizes[at]), self.sizes[at]
        self.place = dict(zip(pieces, range(len(pieces))))

    def _learn(self, missing: list[str]) -> None:
        whole = WHOLE.fullmatch
        lines = [w for w in missing if whole(w)]
        single = [w for w in missing if not whole(w)] if len(lines) < len(missing) else []
        held, sizes = [self.pool], [self.sizes]
        for k in range(0, len(lines), 4096):
            line = SPELT[np.frombuffer(" ".join(lines[k : k + 4096]).lower().encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = self._ids([line], self.words)[0]
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(lines[k : k + 4096]) or ends[-1] != len(ids):
                raise ValueError("the vocabulary does not end each word at one id")
            held.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        for k in range(0, len(single), 4096):
            some = self._ids(single[k : k + 4096])
            held += some
            sizes.append(np.array([len(x) for x in some], np.int64))
        self.place.update(zip(lines + single, range(len(self.place), len(self.place) + len(missing))))
        self.pool, self.sizes = np.concatenate(held), np.concatenate(sizes)
        self.first = np.cumsum(self.sizes) - self.sizes

    def _places(self, met: list[str]) -> np.ndarray:
        """Number of each piece in the cache."""
        missing = [p for p in met if p not in self.place]
        if missing:
            if len(self.place) + len(missing) > self.cache:
                self._keep([p for p in met if p in self.place])
            self._learn(missing)
        return np.fromiter(map(self.place.__getitem__, met), np.int64, len(met))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        out = []
        for _, rows in slices_of(texts):
            if not self.divides:
                out += self._ids(rows.to_pylist())
                continue
            if not pc.any(pc.match_substring(rows, "<|")).as_py():
                rows = detached(rows)
            met, which, per_text = factorised(pc.ascii_split_whitespace(rows))
            empty = met.index("") if "" in met else -1  # from white space at an end
            with no_cycles():
                at = self._places([w or "a" for w in met])
            first, size = self.first[at], self.sizes[at]
            if empty >= 0:
                size[empty] = 0
            each = size[which]
            ids = gathered(self.pool, first[which], each)
            ends = np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(per_text)]]
            out.extend(ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()))
        return out


@lru_cache(maxsize=2)
def library(path: str) -> LibraryTokenizer:
    return LibraryTokenizer(path)


def write_ids(docs: DataFrame, path: str, end_id: int, to: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 16, spacing: int = 256, part_bytes: int = 16 << 20, block_tokens: int = 1 << 20) -> str:
    """Encodes every text, ends it with end_id, and writes blocks in ascending id order; returns the folder.

    The texts are tokenised and counted where they are read; only ids are shuffled, once, to ranges of the id, and equal ids are
    divided by their place in the files. A task packs its range in order, block by block. The counts, one for each id of the vocabulary,
    are all that is collected.
    """
    spark = docs.sparkSession
    to = to or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    kind = np.dtype("<u2" if max(library(path).size, end_id + 1) <= 1 << 16 else "<u4")
    pieces = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("tally", pa.binary())])

    def tokenise(batches):
        """The ids of each text; and a row with the counts of each batch, as pairs (id, count)."""
        lib, end = library(path), np.array([end_id], kind).tobytes()
        for b in batches:
            found = lib.encode(b.column(1))
            n = np.bincount(np.concatenate(found), minlength=end_id + 1) if found else np.zeros(end_id + 1, np.int64)
            n[end_id] += len(found)
            used = np.flatnonzero(n)
            yield batch_of(pieces, b.column(0).cast(pa.int64()), [x.astype(kind).tobytes() + end for x in found], [None] * len(found))
            yield batch_of(pieces, [None], [None], [np.stack([used, n[used]], 1).astype("<i8").tobytes()])

    plain = f"{to}/plain"
    whole = docs.select(id_col, text_col).mapInArrow(tokenise, "id long, ids binary, tally binary")
    whole.write.option("compression", "zstd").parquet(plain)
    plain = spark.read.schema(whole.schema).parquet(plain)
    tally = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            pairs = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8").reshape(-1, 2)
            here = np.bincount(pairs[:, 0], pairs[:, 1]).astype(np.int64)
            here[: len(total)] += total[: len(here)]
            total = np.r_[here, total[len(here) :]]
        used = np.flatnonzero(total)
        yield batch_of(tally, used, total[used])

    counted = plain.filter("tally is not null").select("tally").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["id"] for r in counted], default=end_id) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, limit)
    codes = canonical_codes(lengths)
    spark.createDataFrame([(lengths.tobytes(), int(end_id))], "lengths binary, end_id int").write.parquet(f"{to}/book")
    packed = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("tokens", pa.int64()), ("payload", pa.binary())])
    most = block_tokens * kind.itemsize

    def pack(batches):
        from pyspark import TaskContext

        part, block, named, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def packed_block():
            tokens = [np.frombuffer(x, kind) for x in held]
            return batch_of(packed, [part], [block], [size // kind.itemsize], [encode_block(named, tokens, lengths, codes, spacing)])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and size + len(x) > most:
                    yield packed_block()
                    block, named, held, size = block + 1, [], [], 0
                named.append(d)
                held.append(x)
                size += len(x)
        if held:
            yield packed_block()

    parts = max(1, -(-int(counts.sum()) * kind.itemsize // part_bytes))
    ids = plain.filter("ids is not null").select("id", "ids", F.col("_metadata.row_index").alias("row"))
    ids = ids.repartitionByRange(parts, "id", "row").sortWithinPartitions("id", "row").select("id", "ids")
    ids.mapInArrow(pack, "part int, block int, tokens long, payload binary").write.option("compression", "none").parquet(f"{to}/blocks")
    return to


def read_ids(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary u32) of each document, decoded from the files.

    `start` counts the ids of all documents before, summed in three levels: over runs of a thousand parts, parts and blocks.
    """
    from pyspark.sql import Window as W

    lengths = np.frombuffer(spark.read.parquet(f"{where}/book").first()["lengths"], np.uint8)
    blocks = spark.read.parquet(f"{where}/blocks")
    light = blocks.select("part", "block", "tokens").withColumn("run", F.floor(F.col("part") / 1000))
    zero, earlier = F.lit(0).cast("long"), lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    total = light.groupBy("run", "part").agg(F.sum("tokens").alias("tokens"))
    runs = total.groupBy("run").agg(F.sum("tokens").alias("tokens")).select("run", F.coalesce(F.sum("tokens").over(earlier(W.orderBy("run"))), zero).alias("a"))
    parts = total.select("run", "part", F.coalesce(F.sum("tokens").over(earlier(W.partitionBy("run").orderBy("part"))), zero).alias("b")).join(runs, "run")
    firsts = light.select("part", "block", F.coalesce(F.sum("tokens").over(earlier(W.partitionBy("part").orderBy("block"))), zero).alias("c"))
    firsts = firsts.join(parts, "part").select("part", "block", (F.col("a") + F.col("b") + F.col("c")).alias("first"))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def unpack(batches):
        table = decode_table(lengths)
        for b in batches:
            for first, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                named, counts, ids = decode_block(payload, table)
                ends = np.cumsum(counts.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                for k in range(0, len(named), 512):
                    to = ends[k : k + 512]
                    at = to - counts[k : k + 512]
                    yield batch_of(out, named[k : k + 512], at + first, counts[k : k + 512].astype(np.int64), [raw[4 * i : 4 * j] for i, j in zip(at.tolist(), to.tolist())])

    return blocks.join(firsts, ["part", "block"]).select("first", "payload").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def ids_digest(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_ids returns."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
