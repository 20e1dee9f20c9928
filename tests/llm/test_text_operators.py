from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from statelens.llm import language_id, license_scan, packing, quality
from statelens.llm._common import fold, table

SAMPLES = {"en": ["the quick brown fox jumps over the lazy dog and runs away into the woods"], "de": ["der schnelle braune fuchs springt über den faulen hund und läuft in den wald"]}


def greedy(text, sample):
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at += k
        n += 1
    return n


@given(st.text(alphabet="theuickbrown fxßüdrsca", min_size=1, max_size=200))
@settings(max_examples=60, deadline=None)
def test_cross_parsing_equals_longest_matches(text):
    m = language_id.Model(SAMPLES)
    code = m.code()
    counts, n, _ = m.phrases([text], code)
    flat = lambda t: "".join(map(chr, (language_id.normalise([t], code)[0] + 48).tolist()))
    assert n[0] == len(flat(text))
    assert counts[0].tolist() == [greedy(flat(text), flat("\n".join(SAMPLES[k]))) for k in m.langs]


CHINESE, JAPANESE = "我们今天去学校学习中文然后回家吃饭，晚上看书写字。明天天气很好我们去公园散步", "私たちは今日学校へ行って日本語を勉強します。それから家に帰ってご飯を食べます"
RUSSIAN, GREEK = "сегодня мы идём в школу учить русский язык а потом домой обедать и читать книги", "σήμερα πηγαίνουμε στο σχολείο για να μάθουμε ελληνικά και μετά γυρίζουμε στο σπίτι"


@pytest.mark.parametrize("dense", [True, False])
def test_cross_parsing_of_long_texts_equals_longest_matches(dense, monkeypatch):
    import random

    if not dense:
        monkeypatch.setattr(language_id, "DENSE", 0)
    samples = SAMPLES | {"zh": [CHINESE], "ja": [JAPANESE], "ru": [RUSSIAN], "el": [GREEK]}
    m, rnd = language_id.Model(samples), random.Random(5)
    assert (m.automata[0].go is not None) == dense
    code = m.code()
    parts = [s[0][a : a + k] for s in samples.values() for a, k in ((3, 9), (11, 5), (0, 30), (20, 2))]
    texts = ["".join(rnd.choices(parts, k=k)) for k in (1, 300, 700, 250)] + ["the dog " * 700, "a" * 3000, samples["en"][0] * 40, "", None, "x" * 511 + " the", "Ω" * 513, " ".join(rnd.choices(["the", "lazy", "zzz"], k=900))]
    counts, n, _ = m.phrases(texts, code)
    flat = lambda t: "".join(map(chr, (language_id.normalise([t], code)[0] + 200).tolist()))
    assert sum(n > 2000) >= 6
    for i, t in enumerate(texts):
        assert counts[i].tolist() == [greedy(flat(t), flat("\n".join(samples[k]))) for k in m.langs], i
    said = m.predict([CHINESE, JAPANESE, RUSSIAN[5:40], GREEK[8:50], SAMPLES["de"][0][10:60]], code)[0]
    assert said == ["zh", "ja", "ru", "el", "de"]


def test_parses_that_never_meet_are_settled_letter_by_letter(monkeypatch):
    """Phrases of three of one letter: blocks of 512 begin at other places in a phrase, and no parse meets another."""
    calls = []
    whole = language_id.Automaton.whole
    monkeypatch.setattr(language_id.Automaton, "whole", lambda self, codes: calls.append(len(codes)) or whole(self, codes))
    m = language_id.Model({"x": ["aaa b"]})
    assert m.phrases(["a" * 20_000, "b a " * 3000], m.code())[0][:, 0].tolist() == [6667, greedy("b a " * 3000, "aaa b")]
    assert calls == [20_000]


@given(st.text(alphabet="theuickbrown fxßüdrscaжλ", min_size=1, max_size=200))
@settings(max_examples=30, deadline=None)
def test_sparse_tables_equal_dense_ones(text):
    x, y = language_id.Model(SAMPLES), language_id.Model(SAMPLES)
    code = x.code()
    y.automata = [language_id.Automaton(language_id.normalise(["\n".join(SAMPLES[k])], code)[0], len(x.alphabet) + 2, dense=False) for k in y.langs]
    assert x.phrases([text], code)[0].tolist() == y.phrases([text], code)[0].tolist()


def test_languages_of_many_letters_are_told_apart():
    rnd = np.random.default_rng(2)
    latin = " ".join("".join(chr(97 + c) for c in rnd.integers(0, 26, 5)) for _ in range(3000))
    far = {name: "".join(chr(start + c) for c in rnd.integers(0, 300, 2000)) for name, start in (("xa", 0x4E00), ("xb", 0x5E00))}
    m = language_id.Model({"en": [latin], **{k: [v] for k, v in far.items()}})
    assert m.predict([far["xa"][500:560], far["xb"][500:560], latin[600:660]], m.code())[0] == ["xa", "xb", "en"]
    assert len(m.alphabet) > 600


def test_language_edges(spark):
    rows = [(1, "the brown fox runs over the dog", "x"), (2, "der hund läuft über den wald", None), (3, None, "x"), (4, "12 ... 9!", None), (5, "", None), (None, "the dog", None), (1, "the brown fox runs over the dog", "x"), (6, "the dog " * 20000, None)]
    m = language_id.Model(SAMPLES)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1.0 as score", "'k' as lang_pred")
    got = Counter((r["doc_id"], r["lang_pred"]) for r in language_id.identify(df, m).collect())
    assert got == Counter({(1, "en"): 2, (2, "de"): 1, (3, "und"): 1, (4, "und"): 1, (5, "und"): 1, (None, "en"): 1, (6, "en"): 1})
    kept = language_id.with_language(df, m)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0, r["lang"]) for r in kept.collect()) == [(0, "en"), (1, "x"), (1, "x"), (2, "de"), (6, "en")]
    assert {r["lang_pred"] for r in language_id.identify(df, language_id.Model({})).collect()} == {"und"}


def test_language_held_out(spark, sf):
    docs = table(spark, sf, "documents")
    got = language_id.query(spark, sf).where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred <> 'und'")
    assert got.selectExpr("avg(cast(lang = lang_pred as double))").first()[0] > 0.95


def test_quality_held_out_and_edges(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    m = quality.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    x = quality.score(docs, m).join(labels, "doc_id").where(fold(F.col("doc_id"), 5) == 0)
    assert x.selectExpr("avg(cast(predicted = quality as double))").first()[0] > 0.9
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (None, "a b"), (4, "x " * 50000)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score"), m).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r["predicted"] for r in quality.score(docs, none).collect()} == {1}


def test_bradley_terry_orders_pairs():
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((600, len(quality.FEATURES)))
    x[:, 0] = np.log(1 + rnd.integers(50, 500, 600))
    y = (x[:, 3] - x[:, 7] + 0.2 * rnd.standard_normal(600) > -0.8).astype(int)
    m = quality.learn(x, y)
    assert ((m.score(x) >= quality.ACCEPT) == y).mean() > 0.93
    assert m.weights[3] > 0 > m.weights[7]


def test_tokens_equal_the_tokenizers_library():
    import public_tokenizers as files
    from tokenizers import Tokenizer

    whole, ids = Tokenizer.from_file(files.path("byte_bpe_50k.json")), packing.tokenizer("byte_bpe_50k")
    texts = ["", " ", "a  b\n\n c\t", "it's WE'LL é\u00a0x\u2003y 12３ ½", "<|endoftext|> a <|x", "日本語テキスト\u3000。", "\u200b\u0085\x1c\x1f", "e\u0301ñ 🙂👍🏽", "x" * 5000, "!?" * 999 + " " * 300 + "z"]
    for t in texts:
        assert ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids, t


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_tokens_of_any_text(text):
    import public_tokenizers as files
    from tokenizers import Tokenizer

    whole = test_tokens_of_any_text.__dict__.setdefault("w", Tokenizer.from_file(files.path("byte_bpe_50k.json")))
    assert packing.tokenizer("byte_bpe_50k")(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark):
    rows = [(k, "word " * (37 * k % 3000)) for k in range(60)] + [(100, None), (101, ""), (None, "a"), (5, "word " * 185), (5, "word " * 185)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as row", "2 as rank")
    got = packing.pack(df, with_ids=True).collect()
    encode = packing.tokenizer("byte_bpe_50k")
    want = Counter(tuple([*encode(t or "").tolist(), 0]) for _, t in rows)
    assert sum(r["length"] for r in got) == sum(len(k) * n for k, n in want.items())
    by_seq = {}
    for r in got:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for part in by_seq.values():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert len(by_seq) <= 1.05 * sum(r["length"] for r in got) / 1024 + 1
    once = {d for d, n in Counter(d for d, _ in rows).items() if n == 1}
    for d in once:
        ids = [i for r in sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"]) for i in r["ids"]]
        assert ids == [*encode(dict(rows)[d] or "").tolist(), 0]
    assert packing.pack(df.limit(0)).collect() == []


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
@settings(max_examples=80, deadline=None)
def test_patterns_place_every_piece_once(hist):
    used = Counter()
    for lengths, n in packing.patterns(hist, 64):
        assert n > 0 and sum(lengths) <= 64
        for x in lengths:
            used[x] += n
    assert dict(used) == hist


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=80, deadline=None)
def test_patterns_equal_packing_piece_by_piece(hist):
    """One piece after the other, longest first, each in the open pack with the most room before its length's turn."""
    packs = []
    for length in sorted(hist, reverse=True):
        roomy = [p for p in sorted(packs, key=sum) if sum(p) + length <= 64]
        for k in range(hist[length]):
            if k < len(roomy):
                roomy[k].append(length)
            elif k > len(roomy) and sum(packs[-1]) + length <= 64:
                packs[-1].append(length)
            else:
                packs.append([length])
    assert Counter(sum(p) for p in packs) == sum((Counter({sum(p): n}) for p, n in packing.patterns(hist, 64)), Counter())


def test_quality_fit_minimises_the_pairwise_loss():
    """The Newton steps end where plain gradient descent on the same pairs does, and the cut is the others' share of the raw scores."""
    rnd = np.random.default_rng(6)
    x = rnd.standard_normal((300, len(quality.FEATURES)))
    x[:, 0] = np.log(1 + rnd.integers(20, 200, 300))
    y = (x[:, 2] + rnd.standard_normal(300) > 0.3).astype(int)
    m = quality.learn(x, y, pairs=2000)
    z = (x - x.mean(axis=0)) / x.std(axis=0) * (np.expm1(x[:, 0]) / (np.expm1(x[:, 0]) + quality.SHRINK))[:, None]
    pick = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diff = z[pick.choice(good, 2000)] - z[pick.choice(bad, 2000)]
    loss = lambda w: np.log1p(np.exp(-(diff @ w))).mean() + 5e-4 * w @ w
    w = np.zeros(z.shape[1])
    for _ in range(4000):
        w -= 0.5 * (-(diff * (1 / (1 + np.exp(diff @ w)))[:, None]).mean(axis=0) + 1e-3 * w)
    assert abs(loss(w) - loss(m.weights)) < 1e-5 and np.abs(w - m.weights).max() < 0.02
    assert m.cut == pytest.approx(np.quantile(z @ m.weights, (y == 0).mean()))
    # a pair's order by the scores is the order that the loss asks for, more often than not in either kind
    s = m.score(x)
    auc = np.mean([(s[a] > s[b]) + 0.5 * (s[a] == s[b]) for a in good for b in bad])
    assert auc > 0.7


@pytest.mark.parametrize("sep", [" ", ", ", "\n"])
def test_licenses(spark, sep):
    few = sep.join("permission is hereby granted free of charge to any person obtaining a copy of this software".split())
    grant = few + sep + sep.join(["and", "associated"])  # 17 of the template's 19 words; few has 15, and 16 are needed
    rows = [(1, f"All{sep}Rights{sep}reserved cc-BY x cc by"), (2, f"{'pad ' * 500}{grant} {'end ' * 90}"), (3, None), (4, ""), (5, "general public licenses"), (None, "CC BY"), (None, "CC BY"), (6, "reserved rights all"), (7, "é" * 50000), (8, few)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).selectExpr("*", "1 as row", "2 as own")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert [(p["label"], p["start"]) for p in sorted(got[1]["places"], key=lambda p: p["start"])] == [("reserved", 0), ("cc-by", 3), ("cc-by", 6)]
    assert "mit" in {f["label"] for f in got[2]["found"]} and got[2]["places"] == []
    assert got[8]["found"] == []
    assert got[3]["n_words"] == got[4]["n_words"] == 0 and got[5]["places"] == got[6]["places"] == [] and len(got[None]["places"]) == 1
    assert got[7]["n_words"] == 1
    assert license_scan.scan(df, templates=()).count() == len(rows) and license_scan.scan(df.limit(0)).count() == 0


def test_license_join_equals_brute_force_and_lowers_ascii_only(spark):
    import random

    rnd = random.Random(3)
    temps = [("a", "one two three four five six seven eight nine ten"), ("b", "two four six eight"), ("c", "red blue. green"), ("d", "work one")]
    v = "one two three four five six seven eight nine ten red blue green pad fill wor\u212a work".split()
    texts = [" ".join(rnd.choices(v, k=rnd.choice([0, 3, 12, 70, 200]))) for _ in range(60)] + ["wor\u212a one", "WORK One", "Two FOUR six éight"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).selectExpr("*", "'x' as row", "'y' as found")
    got = {r["doc_id"]: sorted((f["label"], f["block"], round(f["containment"], 9)) for f in r["found"]) for r in license_scan.scan(df, templates=temps, phrases={}).collect()}
    want = {}
    for d, t in enumerate(texts):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()
        want[d] = sorted((k, s, round(n / len(q), 9)) for k, q in ((k, set(q.replace(".", "").split())) for k, q in temps) for s in range(0, len(w), 32) if (n := len(q & set(w[s : s + 64]))) >= 0.8 * len(q) - 1e-9)
    assert got == want and got[60] == [] and got[61] != [] and sum(map(len, want.values())) > 20


def test_license_filters_prune_and_lose_nothing(spark):
    """Template of ranks 0 to 9, need 8: prefix 0, 1, 2."""
    index = license_scan.prefix_index(spark, [("t", list(range(10)))], 0.8)
    assert sorted(r["token"] for r in index.collect()) == [0, 1, 2]
    blocks = {0: list(range(10)), 1: [0, 1, 2, 3, 4, 5, 6], 2: [3, 4, 5, 6, 7, 8, 9, 20, 21], 3: [2, 3, 4, 5, 6, 7, 8, 9], 4: [1, 2, 3, 4, 5, 6, 7, 8], 5: [1, 11, 12, 13, 14, 15, 16, 17], 6: [0, 1, 2, 3, 4, 5, 6, 7]}
    df = spark.createDataFrame([(k, 0, v) for k, v in blocks.items()], "row long, block int, ranks array<int>")
    pairs = {r["row"] for r in license_scan.candidates(df, index, 8).collect()}
    assert pairs == {0, 3, 4, 5, 6}  # 1 falls to the length filter, 2 to the prefix filter
    late = spark.createDataFrame([(9, 0, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9][2:] + [30]), (10, 0, [-3, -2, 2, 3, 4, 5, 6, 7, 8])], "row long, block int, ranks array<int>")
    assert {r["row"] for r in license_scan.candidates(late, index, 8).collect()} == {9}  # 10 falls to the position filter: at its word 2 seven are left
    assert {r["row"]: r["containment"] for r in license_scan.similar_blocks(df, index, 8).collect()} == {0: 1.0, 3: 0.8, 4: 0.8, 6: 0.8}
