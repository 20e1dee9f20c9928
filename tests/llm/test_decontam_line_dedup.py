from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from statelens.llm import decontam, line_dedup, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, bench, n):
    out = []
    for d, text in docs:
        w, hit, items = WORD.findall(low(text)), set(), set()
        for item, t in bench:
            q = WORD.findall(low(t))
            for s in range(max(1, len(q) - n + 1) if q else 0):
                win = q[s : s + n]
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit |= set(range(k, k + len(win)))
                        items.add(str(item))
        out.append((d, len(w), len(hit), tuple(sorted(items)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def tables():
    rnd = random.Random(2)
    v = ["a", "B", "é", "dé", "x1", "the", "Zü"]
    text = lambda n: " ".join(rnd.choices(v, k=n))
    bench = [(1, text(9)), (2, text(5)), (3, ""), (4, None), (10, text(2)), (11, "the"), (12, text(9))]
    docs = [(k, text(rnd.randrange(0, 60))) for k in range(60)] + [(100 + i, f"{text(30)}, {t.upper() if t else ''}! {text(3)}") for i, t in bench]
    docs += [(200, None), (201, ""), (None, bench[0][1]), (0, docs[0][1]), (300, text(5000)), (301, "!?\n.")]
    return docs, bench


@pytest.mark.parametrize("most_bytes", [1 << 20, 12])
def test_contamination_equals_brute_force(spark, most_bytes):
    docs, bench = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontam.contamination(d, b, 4, most_bytes=most_bytes).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got], key=repr) == brute(docs, bench, 4)


def test_proximity_finds_words_out_of_order(spark):
    d = spark.createDataFrame([(1, "so fox the quick brown then"), (2, "the quick a b c d e f brown fox"), (3, "the quick brown fox")], "doc_id long, text string")
    b = spark.createDataFrame([("q", "the quick brown fox")], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(d, b, 4, slop=2).collect()}
    assert got[1]["near_items"] == ["q"] and got[1]["n_hit"] == 0
    assert got[2]["near_items"] == [] and got[3]["items"] == ["q"]


def test_proximity_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    v = [f"w{i}" for i in range(400)]
    bench = [(k, " ".join(rnd.choices(v, k=rnd.choice([6, 13, 16])))) for k in range(12)]
    docs = [(100, None), (101, ""), (None, bench[0][1])]
    for k in range(80):
        w = rnd.choice(bench)[1].split()
        for _ in range(rnd.randrange(7)):
            w.insert(rnd.randrange(len(w)), rnd.choice(v))
        if k % 4 == 0:
            rnd.shuffle(w)
        docs.append((k, " ".join([*rnd.choices(v, k=5), *w, *rnd.choices(v, k=rnd.randrange(9))])))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    exact = {r[0]: set(r[3]) for r in brute(docs, bench, 13)}
    want = []
    for d, text in docs:
        w, near = WORD.findall(low(text)), set()
        for item, t in bench:
            q = t.split()
            for win in (Counter(q[s : s + 13]) for s in range(max(1, len(q) - 12))):
                span = sum(win.values()) + decontam.SLOP
                if any(not win - Counter(w[s : s + span]) for s in range(len(w))):
                    near.add(str(item))
        near = sorted(near - exact[d])
        want.append((d, len(w), len(near), hashlib.sha256(",".join(near).encode()).hexdigest()))
    got = queries.queries()["op2_decontamination_near"](spark, str(tmp_path)).select("doc_id", "n_words", "n_near", "near_sha256")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(x[2] for x in want) > 20


def test_decontaminate_cuts_and_drops(spark):
    long = " ".join(f"w{i}" for i in range(200))
    docs = [(1, f"{long} The quick, brown fox. {long}", "a", "x"), (2, "the quick brown fox", "b", "x"), (3, long, "c", "x"), (None, None, "d", "x"), (4, "", "e", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, spans string, items string")
    got = {r["spans"]: r["text"] for r in decontam.decontaminate(d, spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")).collect()}
    assert got == {"a": f"{long} . {long}", "c": long, "d": None, "e": ""}


def test_cutting_goes_on_until_nothing_is_hit(spark):
    """Cutting one passage joins the words of another, and of a third."""
    long = " ".join(f"w{i}" for i in range(400))
    docs = [(1, f"{long} e a b p q r s c d f {long}"), (2, f"{long} a b c d")]
    bench = spark.createDataFrame([(1, "p q r s"), (2, "a b c d"), (3, "e f w0 w1")], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = dict(map(tuple, decontam.decontaminate(d, bench).collect()))
    assert " ".join(got[1].split()) == f"{long} {long.removeprefix('w0 w1 ')}" and got[2].strip() == long


def test_common_passage_of_many_items(spark):
    """One segment of documents that share a passage, which 40 items hold: memory follows documents and items, not their hits."""
    import tracemalloc

    import pyarrow as pa

    passage = [b"p%d" % i for i in range(120)]
    texts = [b" ".join([b"d%d" % k, *passage, b"e%d" % k]) for k in range(512)]
    items = [(str(k), b" ".join([*passage, b"i%d" % k])) for k in range(40)]
    ph = decontam.Phrases(items, 13)
    ids = pa.array(range(512), pa.int64())
    seg = decontam.Segment(decontam._segment(ids, ids, pa.array(texts, pa.binary())), 0, pa.array(list(ph.vocab), pa.binary()))
    tracemalloc.start()
    found = decontam._Items(40)
    ph.order({t: 1 for t in ph.vocab.values()} | {ph.vocab[b"i%d" % k]: 1 for k in range(40)})
    for t in seg.lists:
        for k, offs in ph.by_rarest.get(t, ()):
            s = seg.exact(ph.windows[k], offs)
            found.add(s // 123, ph.items[k])
    assert len(found.fold()) == 512 * 40 and tracemalloc.get_traced_memory()[1] < 64e6
    assert found.lists(512, pa.array(ph.names))[511].as_py() == sorted(map(str, range(40)))


def test_words_of_many_texts_equal_the_pattern():
    import pyarrow as pa

    rnd = random.Random(7)
    texts = ["".join(rnd.choices("aB9é _-\x00\x7fZ\n中", k=rnd.randrange(12))).encode() for _ in range(500)]
    batch = pa.array([b"cut off", *texts, b"too"], pa.binary()).slice(1, 500)
    terms, word, n = decontam._encode(batch)
    flat = [t.as_py() for t in terms.take(pa.array(word))]
    assert flat == [w for t in texts for w in decontam.words(t)] and n.tolist() == [len(decontam.words(t)) for t in texts]
    x = rnd.sample(range(1 << 20), 3000) * 2
    import numpy as np

    assert decontam._order(np.array(x)).tolist() == np.argsort(x, kind="stable").tolist()


def test_index_is_searched_for_several_test_tables(spark):
    docs, bench = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = decontam.build_index(decontam._numbered(d, decontam.F.monotonically_increasing_id()))
    for part in (bench[:3], bench[3:]):
        got = decontam.lookup(index, spark.createDataFrame(part, "item_id long, text string"), 4).collect()
        assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got], key=repr) == brute(docs, part, 4)


def test_empty_tables(spark):
    docs, bench = (spark.createDataFrame([], f"{i} long, text string") for i in ("doc_id", "item_id"))
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.contamination(docs, bench).collect() == []
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(one, bench).collect()] == [(2, 0, [])]


def slow_lines(docs, least=10):
    def key(line):
        return low(line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for d, text in docs:
        if d is not None:
            for line in (text or "").split("\n"):
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, text in docs:
        ls = (text or "").split("\n")
        kept = [x for x in ls if d is None or len(key(x)) < least or d == min(holders[key(x)])]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup_equals_brute_force(spark, batches, fanout):
    rnd = random.Random(4)
    lines = [f"line number {i} é" for i in range(30)] + ["short", "", "  Line Number 3 É ", "\tLINE NUMBER 4 é\r", "ten chars!", "nine char", "x" * 3000]
    docs = [(k * 3, "\n".join(rnd.choices(lines, k=rnd.randrange(1, 12)))) for k in range(80)]
    docs += [(1, None), (2, ""), (4, "\n\n"), (None, "line number 1 é"), docs[5], (7, "line number 1 é\nline number 1 é")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    d = d.selectExpr("*", "'z' as drops", "'z' as h1", "5 as n_lines", "'z' as batch")
    got = line_dedup.dedup_lines(d, batches=batches, fanout=fanout)
    assert {"drops", "h1", "batch"} <= set(got.columns) and got.where("drops <> 'z'").count() == 0
    found = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got.collect()]
    assert sorted(found, key=repr) == slow_lines(docs)


@pytest.mark.parametrize("batches,fanout,runs", [(4, 2, 3), (9, 2, 8)])
def test_line_dedup_writes_few_files(spark, monkeypatch, batches, fanout, runs):
    """One table of lines, a run for each batch but the last, one of what goes: each with a file for each partition at most."""
    from pathlib import Path

    made = []
    for name in ("delete", "forget"):
        monkeypatch.setattr(line_dedup, name, lambda *a: None)
    for name in ("new_path", "save"):
        f = getattr(line_dedup, name)
        monkeypatch.setattr(line_dedup, name, lambda *a, f=f, **b: made.append(f(*a, **b)) or made[-1])
    rnd = random.Random(9)
    docs = [(k, "\n".join(f"line number {rnd.randrange(400)}" for _ in range(9))) for k in range(200)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), batches=batches, fanout=fanout)
    found = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got.collect()]
    assert sorted(found, key=repr) == slow_lines(docs)
    files = [len(list(Path(x if isinstance(x, str) else x.saved_at).rglob("*.parquet"))) for x in made]
    assert len(files) == runs + 2 and max(files) <= 4
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
