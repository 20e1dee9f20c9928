from __future__ import annotations

import pytest

import corpus_pipeline
from statelens.llm import decontam, line_dedup, queries, simhash
from statelens.llm._common import table


def test_stages_hand_over_the_columns_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    names, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).persist()
        if name != "packing":
            assert docs.columns == names
        seen.append(docs)
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[4] == ids[5]
    # nothing left to do for any stage on the next one's input
    assert line_dedup.dedup_lines(seen[2]).agg({"n_dropped": "sum"}).first()[0] == 0
    assert simhash.near_duplicates(seen[3]).where("doc_id <> component_id").count() == 0
    assert decontam.contamination(seen[4], table(spark, sf, "benchmark")).where("n_hit > 0").count() == 0
    assert seen[4].where("n_chars <> char_length(text)").count() == 0


def test_line_stage_writes_lines_once(spark, sf, monkeypatch):
    """One file of lines for each partition of documents, where each file costs processes on a local disk."""
    made = {}

    def save(df, label, *a, f=line_dedup.save, **b):
        made[label] = len((out := f(df, label, *a, **b)).inputFiles())
        return out

    monkeypatch.setattr(line_dedup, "save", save)
    docs = table(spark, sf, "documents").repartition(4)
    corpus_pipeline.lines(spark, docs, sf)
    assert 0 < made["lines"] <= 4


def by_hand(docs, bench):
    """All stages but the last, row by row: {doc_id: text} after each."""
    from test_components_simhash import brute, slow_fingerprint
    from test_decontam_line_dedup import WORD, low, slow_lines

    out = [{d: t for d, t in docs.items() if any(c.isalpha() for c in t or "")}]
    now = out[-1]
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    holder = {}
    for d in sorted(now):
        for line in now[d].split("\n"):
            holder.setdefault(key(line), d)
    out.append({d: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or holder[key(x)] == d) for d, t in now.items()})
    assert sum(r[2] for r in slow_lines(list(now.items()))) == sum(t.count("\n") + 1 for t in now.values()) - sum(len([x for x in now[d].split("\n") if len(key(x)) < 10 or holder[key(x)] == d]) for d in now)
    now = out[-1]
    fp = {d: slow_fingerprint(t) for d, t in now.items()}
    group = brute([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    out.append({d: t for d, t in now.items() if group.get(d, d) == d})
    windows = {tuple(q[s : s + 13]) for t in bench for q in [WORD.findall(low(t))] for s in range(max(1, len(q) - 12)) if q}
    kept = {}
    for d, t in out[-1].items():
        while True:
            spans, w = [m.span() for m in WORD.finditer(low(t))], WORD.findall(low(t))
            hit = sorted({k for win in windows for s in range(len(w) - len(win) + 1) if tuple(w[s : s + len(win)]) == win for k in range(s, s + len(win))})
            if not hit or 20 * len(hit) >= len(w):
                break
            for k in reversed(hit):  # each run of hit words goes with what is between its words
                t = t[: spans[k][0]] + t[spans[k + 1][0] if k + 1 in hit else spans[k][1] :]
        if not hit:
            kept[d] = t
    out.append(kept)
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    import random

    rnd = random.Random(13)
    v = [f"wort{i}" for i in range(500)]
    bench = [" ".join(rnd.choices(v, k=k)) for k in (20, 13, 5)]
    line = lambda n: " ".join(rnd.choices(v, k=n))
    shared = [line(12) for _ in range(4)]
    docs = {}
    for d in range(0, 300, 5):
        parts = [line(rnd.randrange(30, 90)), rnd.choice([*shared, "short", ""]), line(40)]
        if d % 15 == 0:
            parts[0] += f" {rnd.choice(bench)} " + line(400)
        docs[d] = "\n".join(parts)
    for d in range(1, 100, 10):
        w = docs[d - 1].split(" ")
        w[7] = "anders"
        docs[d] = " ".join(w)  # a near copy, most of whose lines go as copies
    text = " ".join(rnd.choices(v, k=200))
    docs |= {901: text, 902: text.replace(" ", "  "), 903: text + " z", 904: None, 905: "", 906: "12 !", 907: bench[0], 908: bench[2] + " " + line(20)}
    docs[909] = f"{line(300)} {' '.join(bench[1].split()[:6])} {bench[2]} {' '.join(bench[1].split()[6:])} {line(300)}"
    rows = [(d, t, rnd.choice(["de", None]), "s", len(t or "")) for d, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, want = table(spark, str(tmp_path), "documents"), by_hand(docs, bench)
    for (name, stage), texts in zip(corpus_pipeline.STAGES, want, strict=False):
        now = corpus_pipeline.save(stage(spark, now, str(tmp_path)), "test")
        assert {r["doc_id"]: r["text"] for r in now.collect()} == texts, name
    assert len({len(x) for x in want}) >= 3 and 909 in want[-1] and 907 not in want[-1]
    got = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    from statelens.llm import packing

    encode = packing.tokenizer("byte_bpe_50k")
    lengths = {d: len(encode(t)) + 1 for d, t in want[-1].items()}
    sums = {}
    for r in got:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["length"]
    assert sums == lengths and len({r["sequence_id"] for r in got}) <= 1.06 * sum(lengths.values()) / 1024 + 1


def test_empty_documents_pass_all_stages(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cols = ", ".join(sorted(df.columns))
    assert sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect()))) == sorted(map(repr, con.execute(f"select {cols} from ({queries.oracle_sql()[name]})").fetchall()))
