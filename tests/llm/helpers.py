"""Fixtures and brute-force versions of the corpus operators."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from rillflow.llm.license_scan import PHRASES

SPACE = re.compile(r"[\x20\x09-\x0d]+")
LONG = " ".join(f"word{k} of the long text {k * k}" for k in range(4000))
#: null, empty, white space, very long, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, LONG), (5, LONG), (6, "A b  c\nd e f g h"), (7, "a B c d e f g h"), (None, "a B c d e f g h"), (8, "é 日本 <|endoftext|> \x00 x")]


def frame(spark, rows=ODD, extra=True):
    """doc_id and text, with columns beside them whose names operators use themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    wide = [(*r, "en", "s", 1, 2, "x", True) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, fp long, part string, kept boolean")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[SPACE.sub(" ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left == 1
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def simhash(docs, bits=4):
    import xxhash

    fps = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64(x, 42).intdigest() for x in s]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0))
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, f"{f:016x}", min(least[find(k)], default=None)) for k, (i, f) in enumerate(fps)), key=str)


def suffixes(docs, span=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - span + 1 if i is not None else 0):
            k = b[p : p + span]
            first[k] = min(i, first.get(k, i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1 if i is not None else 0):
            if first[b[p : p + span]] < i:
                gone[p : p + span] = b"\1" * span
        spans = sum(1 for x in range(len(gone)) if gone[x] and (not x or not gone[x - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def phrases(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def context_trees(docs, depth):
    count, words = Counter(), Counter()
    tokens = lambda t: (t or "").encode().lower().split()
    seq = lambda t: b"\xff" * depth + b" ".join(tokens(t)) + b"\xff"
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    for i, t in docs:
        if not held(i):
            words.update([*tokens(t), "end"])
            s = seq(t)
            for p in range(depth, len(s)):
                for d in range(depth + 1):
                    for k in range(8):
                        count[d, s[p - d : p], (1 << k) | (s[p] >> (8 - k)), s[p] >> (7 - k) & 1] += 1
    nodes = defaultdict(lambda: [0, 0])
    for (d, c, v, bit), n in count.items():
        nodes[d, c, v][bit] += n
    longer, weight = defaultdict(float), {}
    for key in sorted(nodes, key=lambda x: -x[0]):
        (d, c, v), (a, b) = key, nodes[key]
        pe = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        pw = pe
        if d < depth:
            hi, lo = max(pe, longer[key]), min(pe, longer[key])
            pw = hi + math.log1p(math.exp(lo - hi)) - math.log(2)
            weight[key] = math.exp(pe - math.log(2) - pw)
        if d:
            longer[d - 1, c[1:], v] += pw
    total, kinds, out = sum(words.values()), len(words), []
    for i, t in docs:
        toks, s, score = [*tokens(t), "end"], seq(t), 0.0
        for p in range(depth, len(s)):
            for k in range(8):
                q, met = 0.5, False
                for d in range(depth, -1, -1):
                    key = d, s[p - d : p], (1 << k) | (s[p] >> (8 - k))
                    if key in nodes:
                        a, b = nodes[key]
                        w = weight[key] if met and d < depth else 1
                        q, met = w * (b + 0.5) / (a + b + 1) + (1 - w) * q, True
                score += math.log10(q if s[p] >> (7 - k) & 1 else 1 - q)
        out.append((i, held(i), len(toks), sum(words[x] > 0 for x in toks), total, sum(math.log10((words[x] + 1) / (total + kinds + 1)) for x in toks), score))
    return sorted(out, key=str)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def near_classes(docs):
    """Brute force: the smallest id of each class of rows with Jaccard similarity 0.8 or more."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if root[a] != root[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                root = [root[b] if r == root[a] else r for r in root]
    least = {}
    for (i, _), r in zip(docs, root):
        least[r] = min(i, least.get(r, i))
    return sorted(least.values())
