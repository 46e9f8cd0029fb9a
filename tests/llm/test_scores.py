import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, context_trees, frame, phrases, rows
from pyspark.sql import functions as F

from rillflow.llm import ctw_lm as L
from rillflow.llm import license_scan as S
from rillflow.llm import toxicity as T
from rillflow.llm.html_extract import extract, main_text

RNG = np.random.default_rng(5)
VOCAB = ["".join(RNG.choice(list("abcdefgh"), 5)) for _ in range(300)]


def talk(bad: bool) -> str:
    w = list(RNG.choice(VOCAB, 60))
    if bad:
        for k in RNG.choice(60, 4, False):
            w[k] = str(RNG.choice(["zounderel", "quxblight"]))
    return " ".join(w)


LABELLED = [(k, talk(k % 3 == 0), int(k % 3 == 0)) for k in range(240)]


@pytest.fixture(scope="module")
def model(spark):
    labels = spark.createDataFrame([(i, y) for i, _, y in LABELLED] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    return T.fit(frame(spark, [(i, t) for i, t, _ in LABELLED]), labels)


def test_toxicity_learns_and_generalises_to_misspellings(model):
    fresh = [(talk(k % 2 == 0), k % 2 == 0) for k in range(60)]
    scores = model.scores(pa.array([t for t, _ in fresh]))
    assert np.mean((scores >= 0.3) == [y for _, y in fresh]) >= 0.9
    clean, spelt = talk(False), " ".join(VOCAB[:60]) + " zounderell quxblights zoounderel zounderels"
    assert model.scores(pa.array([spelt]))[0] > model.scores(pa.array([clean]))[0]


def test_toxicity_on_odd_rows(spark, model):
    got = rows(T.score(frame(spark), model))
    assert len(got) == len(ODD) and all(0 <= s <= 1 for _, s in got)
    same = {s for i, s in got if i in (1, 2, 3)}
    assert len(same) == 1
    assert T.score(frame(spark, []), model).count() == 0
    kept = T.keep_clean(frame(spark), model, 2.0)
    assert kept.columns == frame(spark).columns and kept.count() == len(ODD)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(s, 6) for _, s in rows(T.score(frame(spark), T.fit(frame(spark), none)))} == {0.0}
    ones = spark.createDataFrame([(4, 1)], "doc_id long, toxic int")
    assert min(s for _, s in rows(T.score(frame(spark), T.fit(frame(spark), ones)))) > 0.99


def test_toxicity_sample_is_bounded(spark):
    rows_ = [(7, LABELLED[0][1])] * 500 + [(i, t) for i, t, _ in LABELLED] + [(3, t) for _, t, _ in LABELLED[:50]] + [(9, "z " * 30_000)]
    labels = spark.createDataFrame([(i, y) for i, _, y in LABELLED], "doc_id long, toxic int")
    seen = []

    def spy(bags, y, w, **rest):
        seen.append((len(bags), sum(map(len, bags)), np.bincount(y).tolist()))
        return real(bags, y, w, **rest)

    real, T.train = T.train, spy
    try:
        T.fit(frame(spark, rows_), labels, max_docs=60)
        T.fit(frame(spark, rows_), labels, max_bytes=40_000)
        T.fit(frame(spark, rows_), labels)
    finally:
        T.train = real
    assert seen[0][0] == 60 and seen[0][2] == [30, 30]  # repeated rows and ids count once each
    assert seen[1][0] <= 40_000 // 300 and min(seen[1][2]) > 20
    assert seen[2][0] == len({(i, t) for i, t in rows_})


def as_pattern(template: str) -> str:
    """A template as a regular expression over words that are each followed by a space."""
    out = []
    for part in re.findall(r"\[\[|\]\]|\{\{.*?\}\}|[^\[\]{}]+|.", template):
        span = re.fullmatch(r"\{\{(\d+)\.\.(\d+)\}\}", part)
        if part in ("[[", "]]"):
            out.append("(?:" if part == "[[" else ")?")
        elif span:
            out.append(rf"(?:\S+ ){{{span[1]},{span[2]}}}")
        elif part.startswith("{{"):
            out.append(f"(?:{part[2:-2]}) ")
        else:
            out += [f"{re.escape(w)} " for w in S.words_of(part)]
    return "(?:^|(?<= ))" + "".join(out)


def variants(rng) -> str:
    """Words of a template with its regions filled in or left out at random, now and then with a word wrong."""
    label = rng.choice(list(S.TEMPLATES))
    text = rng.choice(S.TEMPLATES[label])
    while "[[" in text:
        text = re.sub(r"\[\[([^\[\]]*)\]\]", lambda m: rng.choice([m[1], ""]), text)
    text = re.sub(r"\{\{(\d+)\.\.(\d+)\}\}", lambda m: " ".join(rng.choice(["the", "name", "of"]) for _ in range(rng.randint(int(m[1]), int(m[2])))), text)
    text = re.sub(r"\{\{([^{}.]*)\}\}", lambda m: rng.choice(m[1].split("|")), text)
    words = S.words_of(text)
    if rng.random() < 0.3:
        words[rng.randrange(len(words))] = "wrong"
    return " ".join(words)


def test_labels_against_regular_expressions():
    rng = random.Random(8)
    texts = [" and so on. ".join(variants(rng) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    patterns = {k: [re.compile(as_pattern(t)) for t in v] for k, v in S.TEMPLATES.items()}
    met = set()
    for text, found in zip(texts, S.scan_column(pa.array(texts))):
        words = "".join(f"{w} " for w in S.words_of(text))
        want = {k for k, ps in patterns.items() if any(p.search(words) for p in ps)} | {label for phrase, label in S.PHRASES.items() if f" {phrase} " in f" {words}"}
        assert found[5] == ",".join(sorted(want)), text
        met |= want
    assert met >= set(S.TEMPLATES)


def test_scores_rise_with_the_wording():
    texts = ["nothing", "cc by", "general public license", "CC0 1.0 Universal", "Licensed under the ISC license", S.TEMPLATES["mit-text"][0].replace("{{1..8}}", "the authors")]
    scores = [r[6] for r in S.scan_column(pa.array(texts))]
    assert scores == sorted(scores) and scores[:3] == [0.0, 1 / 3, 0.5] and 0.5 < scores[3] < scores[4] == scores[5] == 1.0


def test_fold(spark):
    import zlib

    df = spark.range(50).select("id", T.fold("id", 4).alias("f"))
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in df.collect())


@pytest.mark.parametrize("depth, sizes", [(3, {}), (3, {"part_bytes": 400, "bucket_bytes": 300}), (L.DEPTH, {"part_bytes": 900, "bucket_bytes": 700})])
def test_context_tree_weighting(spark, depth, sizes):
    docs = [(i, t if t is None or len(t) < 500 else t[:300]) for i, t in ODD] + [(100 + k, " ".join(VOCAB[k : k + 9])) for k in range(12)]
    got, want = rows(L.lm_scores(frame(spark, docs), depth=depth, **sizes)), context_trees(docs, depth)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want]) and np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-4)
    assert L.lm_scores(frame(spark, [])).count() == 0


def test_context_tree_is_a_distribution():
    keys, n = np.unique(L.grams([b"abracadabra abracadabra", b"banana"], 3)[0], return_counts=True)
    tree = L.Tree(keys, n.astype(np.int64), 3, 2)
    context = np.uint64(0x6162 << 16 | 0x72 << 8)
    top = L.Top(np.zeros((256, 256, 2), np.int64), np.zeros((256, 256)))
    p = 10 ** L.log10_probability(context | np.arange(256, dtype=np.uint64), tree, top)
    assert abs(p.sum() - 1) < 1e-9


TEXTS = ["", None, "cc by cc by", "All Rights\nreserved all rights reserved", "Copyright (c) 2024 Foo Bar. All rights reserved.", "general public license cc-by", "Licensed under the Apache License, Version 2.0.", "licensed under the apache license", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "x " * 5000 + "all rights reserved"]


def test_license_phrases_and_templates():
    found = S.scan_column(pa.array(TEXTS))
    assert [f[:5] for f in found] == [phrases(t) for t in TEXTS]
    labels = [f[5] for f in found]
    assert labels[:2] == ["", ""] and labels[4] == "copyright-notice,reserved" and labels[6:11] == ["apache-2.0", "", "mit", "gpl,gpl-3.0", "cc-by,cc-by-nc-4.0"]
    assert [found[k][6] for k in (0, 3, 8)] == [0.0, 0.5, 1.0]


def test_license_automata():
    m = S.Automaton("start [[very [[much]] ]] {{a|b}} {{1..3}} end")
    for text, ok in [("start a x end", True), ("start very b x y z end", True), ("start very much a x end", True), ("start much a x end", False), ("start a end", False), ("start a x y z w end", False), ("start c x end", False)]:
        assert (m.match(text.split(), 0) > 0) is ok, text
    with pytest.raises(ValueError):
        S.Automaton("[[a]]")


def test_license_rows(spark):
    got = S.scan(frame(spark))
    assert got.count() == len(ODD) and S.scan(frame(spark, [])).count() == 0


ARTICLE = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><div class="ad">Buy now, it is cheap and long enough to look like text.</div><article><h1>Title &amp; all</h1><p>First <b>bo</b>ld.<p>Second&nbsp;\n one<br>after.<script>var x="</p>";</script></article><section id="comments"><p>Nice one, I liked it a lot, thank you.</p></section><footer>(c)</footer></body></html>'


@pytest.mark.parametrize(
    "page, want",
    [
        (ARTICLE, "Title & all\n\nFirst bold.\n\nSecond one after."),
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a < b &lt;i&gt;</p>", "a < b <i>"),
        ("<nav><li>menu<article><p>Text here</p></article>", "Text here"),
        ("<article><p>cut off in a <b", "cut off in a"),
        ('<div class="layout sidebar-left"><article><p>kept</p></article></div>', "kept"),
        ('<div><p>One.</p><div class="ad-slot">Ad</div><p>Two.</p><form>f</form></div><aside>x</aside>', "One.\n\nTwo."),
        ("<article><p>Zwölf Boxkämpfer</p></article>" + "<article class='related'><p>More to read</p></article>", "Zwölf Boxkämpfer"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", ARTICLE, "x"), (2, "u", None, "x"), (2, "u", None, "x"), (None, None, "<p>" + "word " * 50_000, "x")], "page_id long, url string, html string, text string")
    got = rows(extract(df).select("page_id", "n_chars"))
    assert got == sorted([(1, len(main_text(ARTICLE))), (2, 0), (2, 0), (None, 249_999)], key=str)
    assert extract(df.filter(F.lit(False))).count() == 0


def test_toxicity_ranks_held_out_rows(spark):
    """Labelled rows that were not learnt from: toxic ones score higher more often than not (measured: 0.80 of the pairs)."""
    from rillflow.llm.queries import op5_toxicity

    sf = "/root/testdata/sf0.01"
    found = op5_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").select("score", "toxic").collect()
    toxic, clean = ([r["score"] for r in found if r["toxic"] == y] for y in (1, 0))
    assert len(toxic) > 10 and len(clean) > 50
    assert sum(t > c for t in toxic for c in clean) >= 0.7 * len(toxic) * len(clean)


def test_scores_hold_the_ngrams_of_few_words_at_once(monkeypatch):
    import tracemalloc

    texts = pa.array([" ".join(f"word{k:x}number{k * 7919 % 9973}" for k in range(at, at + 2000)) for at in range(0, 100_000, 2000)])
    model = T.Model(np.random.default_rng(4).normal(size=1 << T.TABLE_BITS), 0.1)
    tracemalloc.start()
    got = model.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    monkeypatch.setattr(T, "WORDS_AT_ONCE", 1 << 30)
    assert (model.scores(texts) == got).all()
