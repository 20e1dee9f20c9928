from __future__ import annotations

import random

import numpy as np
from statelens.llm import embedding_dedup, url_filter, warc


def brute(rows, t=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, low = {i: 0 for i, _ in rows if i is not None}, {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a in range(len(ok)):
        for b in range(len(ok)):
            (i, x), (j, y) = ok[a], ok[b]
            if a != b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= t:
                n[i] += 1
                p, q = find(i), find(j)
                low[max(p, q)] = min(p, q)
    return {i: (n[i], find(i)) for i in n}


def test_nn_descent_equals_brute_force(spark):
    rnd = np.random.default_rng(1)
    base = rnd.standard_normal((120, 16))
    rows = [(10 + 2 * k, v.tolist()) for k, v in enumerate(base)]
    for k in range(30):
        rows += [(1000 + 10 * k + j, (base[k] + 0.05 * rnd.standard_normal(16)).tolist()) for j in range(4)]
    rows += [(5000 + k, (base[3] * (k + 1)).tolist()) for k in range(20)] + [(6000 + k, base[50].tolist()) for k in range(15)]
    chain = [np.cos(a) * base[90] / np.linalg.norm(base[90]) + np.sin(a) * (u := base[91] - base[90] * (base[91] @ base[90]) / (base[90] @ base[90])) / np.linalg.norm(u) for a in np.arange(0, 3, 0.2)]
    rows += [(7000 + k, v.tolist()) for k, v in enumerate(chain)]
    rows += [(1, None), (2, []), (3, [0.0] * 16), (4, [float("nan")] + [1.0] * 15), (5, [None] + [1.0] * 15), (6, [float("inf")] + [1.0] * 15), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (None, base[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).selectExpr("*", "1 as node", "'x' as e")
    report = {}
    got = embedding_dedup.near_vectors(df, report=report).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None} == want
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == want[r["vec_id"]][1]) for r in got)
    assert report["found_links"] >= 0.98 * report["audited_links"] > 0


def test_links_are_counted_in_blocks(spark):
    """Far nodes of one component against all of it, in pairs of blocks of four."""
    rnd = np.random.default_rng(3)
    v = rnd.standard_normal(8)
    rows = [(k, (v / np.linalg.norm(v) + 0.12 * rnd.standard_normal(8)).tolist()) for k in range(40)]
    df = spark.createDataFrame([(0, i, 1, e) for i, e in rows], "component long, node long, n long, e array<double>")
    got = {r["node"]: r["mass"] - 1 for r in embedding_dedup._count_links(df, 0.95, 4).collect()}
    assert got == {i: n for i, (n, _) in brute(rows).items()}


def test_links_of_a_drawn_out_component_are_counted_by_bands(spark):
    """A chain over 3 radians, denser at one end, beside a ball: nodes of all bands, near and far ones."""
    rnd = np.random.default_rng(4)
    q = np.linalg.qr(rnd.standard_normal((8, 2)))[0].T
    angles = np.sort(np.concatenate([np.arange(0, 3, 0.04), rnd.uniform(2, 3, 40)]))
    rows = [(k, 0, (np.cos(a) * q[0] + np.sin(a) * q[1] + 0.02 * rnd.standard_normal(8)).tolist()) for k, a in enumerate(angles)]
    v = rnd.standard_normal(8)
    rows += [(500 + k, 500, (v / np.linalg.norm(v) + 0.1 * rnd.standard_normal(8)).tolist()) for k in range(30)]
    df = spark.createDataFrame([(c, i, 1, e) for i, c, e in rows], "component long, node long, n long, e array<double>")
    got = {r["node"]: r["mass"] - 1 for r in embedding_dedup._count_links(df, 0.95, 8).collect()}
    want = {}
    for c in (0, 500):
        want |= {i: n for i, (n, _) in brute([(i, e) for i, k, e in rows if k == c]).items()}
    assert got == want


def test_audit_sees_lost_small_groups_beside_a_large_one(spark):
    """A third of the rows is one found group; of 100 pairs none was found, which hardly shows in a sum of links."""
    rnd = np.random.default_rng(5)
    hot, rows = rnd.standard_normal(16), []
    rows += [(k, 1, 16, (hot + 0.01 * rnd.standard_normal(16)).tolist(), 0) for k in range(150)]
    for k in range(100):
        v = rnd.standard_normal(16)
        rows += [(1000 + 2 * k + j, 1, 16, (v + 0.01 * rnd.standard_normal(16)).tolist(), 1000 + 2 * k + j) for j in (0, 1)]
    df = spark.createDataFrame(rows, "node long, n long, d long, e array<double>, component long")
    for most in (20, 10**6):
        got, met = embedding_dedup._audit(df, 0.95, 0, most)
        assert got["found_links"] > 0.98 * got["audited_links"] and got["recall"] < 0.98
    links = {frozenset((r["node"], r["nbr"])) for r in met.collect()}
    assert links == {frozenset((1000 + 2 * k, 1001 + 2 * k)) for k in range(100)}


def test_all_pairs_of_a_large_block_are_compared(spark, monkeypatch):
    """One block of 300 in parts of 20: every true pair must be in its nodes' lists."""
    monkeypatch.setattr(embedding_dedup, "PART", 20)
    rnd = np.random.default_rng(8)
    rows = []
    for k in range(150):
        v = rnd.standard_normal(16)
        rows += [(2 * k + j, 1, 16, (v + 0.01 * rnd.standard_normal(16)).tolist()) for j in (0, 1)]
    df = spark.createDataFrame(rows, "node long, n long, d long, e array<double>")
    got = embedding_dedup._start(df, [0], 0, 3).collect()
    assert {frozenset((r["node"], r["nbr"])) for r in got if r["sim"] >= 0.95} == {frozenset((2 * k, 2 * k + 1)) for k in range(150)}
    x = np.array([r[3] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argsort(-(x @ x.T) + 9 * np.eye(300), axis=1)[:, :3]
    assert {(i, int(j)) for i in range(300) for j in best[i]} <= {(r["node"], r["nbr"]) for r in got if not r["link"]}


def test_reverse_neighbours_follow_the_doubled_list(spark):
    """Node 0 lists 20 nodes and 20 others list node 0: it is the middle of all 40."""
    rnd = np.random.default_rng(9)
    v = rnd.standard_normal(16)
    nodes = spark.createDataFrame([(k, 1, 16, (v + rnd.standard_normal(16)).tolist()) for k in range(41)], "node long, n long, d long, e array<double>")
    lists = [(0, [(1.0, k, True) for k in range(1, 21)])] + [(k, [(1.0, 0, True)]) for k in range(21, 41)]
    got = embedding_dedup._round(nodes, spark.createDataFrame(lists, "node long, nbrs array<struct<sim:double,nbr:long,fresh:boolean>>"), 0.95, 6)
    assert {r["node"] for r in got.where("not link").collect()} >= set(range(1, 41))


def test_passes_that_fall_short_end_in_an_exact_comparison(spark, monkeypatch):
    """Blocks that show nothing: the audit of a few nodes falls short, and still no link is lost."""
    monkeypatch.setattr(embedding_dedup, "AUDIT", 5)
    monkeypatch.setattr(embedding_dedup, "DRAW", 32)
    monkeypatch.setattr(embedding_dedup, "_start", lambda nodes, *a: spark.createDataFrame([], embedding_dedup.FOUND))
    rnd, rows = np.random.default_rng(11), []
    for k in range(40):
        v = rnd.standard_normal(16)
        rows += [(3 * k + j, (v + 0.01 * rnd.standard_normal(16)).tolist()) for j in range(3)]
    report = {}
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), report=report).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute(rows)
    assert report["exact"] and report["recall"] == 0 and report["drawn_nodes"] < len(rows)


def test_rounds_find_what_the_start_misses(spark, monkeypatch):
    """One table of small blocks: the start's lists fall well short, the joins of neighbours' neighbours reach the recall."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 12)
    monkeypatch.setattr(embedding_dedup, "AUDIT", 10**6)
    rnd, rows = np.random.default_rng(21), []
    for k in range(120):
        v = rnd.standard_normal(12)
        v /= np.linalg.norm(v)
        rows += [(10 * k + j, (v + 0.05 * rnd.standard_normal(12)).tolist()) for j in range(8)]
    report = {}
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tables=1, report=report).collect()
    assert report["by_round"][0] < 0.9 and report["by_round"][-1] >= 0.98 and not report["exact"]
    want = brute(rows)
    assert sum(r["n_links"] for r in got) >= 0.98 * sum(n for n, _ in want.values())
    assert sum(r["component_id"] == want[r["vec_id"]][1] for r in got) >= 0.97 * len(rows)


def test_a_hub_that_all_lists_name_keeps_its_best(spark):
    rows = [(0, k, k / 1000, True) for k in range(1, 900)] + [(5, 6, 0.5, True), (5, 6, 0.5, False)]
    got = {r["node"]: [(x["nbr"], x["fresh"]) for x in r["nbrs"]] for r in embedding_dedup._merge(spark.createDataFrame(rows, "node long, nbr long, sim double, fresh boolean"), 0.8, 6, 48).collect()}
    assert [n for n, _ in got[0]] == list(range(899, 851, -1)) and got[5] == [(6, False)]


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_url_parts_and_rules():
    assert url_filter.split_url("HTTP://A.Example.ORG?x=/y") == ("a.example.org", "")
    assert url_filter.split_url("http://Éx.org/P/q#f?") == ("Éx.org".replace("É", "É"), "/P/q")
    assert url_filter.split_url("x://h/a://b?c") == ("h", "/a://b")
    assert url_filter.split_url(None) == url_filter.split_url("no url") == ("", "")


def slow_rule(host, path, rules):
    best = None
    for rule, verdict in rules:
        own, slash, prefix = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + prefix):
            key = (-len(rule), rule, verdict != "block")
            if best is None or key < best[0]:
                best = key, rule, verdict
    return best and best[1:]


def test_rules_equal_brute_force(spark):
    rnd = random.Random(12)
    rules = [*url_filter.RULES, ("example.org/en/1", "allow"), ("b.example.org/", "block"), ("org/e", "block"), ("com/", "allow"), ("net", "block")]
    hosts = ["example.org", "a.example.org", "b.example.org", "xexample.org", "org", "com", "a.com", "COM", "x.Com", "net", "a.net", "", "example.org.net", "orgs"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x", "/en/2#/es/", "/fr/a", "/de/", "/e?", "//", "/ES/"]
    urls = [f"{rnd.choice(['http', 'HTTPS', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=/es/', '#f?'])}" for _ in range(600)]
    urls += ["http://a/b://c", "no url", "", None, "x://h/a://b?c", "HTTP://A.Example.ORG?x=/y", "http://\u00c9x\U0001f600.org/P\U0001f600/q#f?", "http://u:p@a.com:80/fr/"]
    m = url_filter.Model(np.zeros(8), -1.0, 8)
    got = url_filter.judge(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").repartition(3), m, rules).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = url_filter.split_url(urls[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path), urls[r["page_id"]]
        assert (r["rule"], r["verdict"]) == (slow_rule(host, path, rules) or (None, "allow")), urls[r["page_id"]]
    default = {u: slow_rule(*url_filter.split_url(u), url_filter.RULES) for u in ("http://m.example.org/es/1", "http://example.org", "http://a.com/de/", "http://xexample.org/es/")}
    assert list(default.values()) == [("example.org/es/", "block"), None, ("com/de/", "block"), ("org/", "allow")]


def test_unseen_hosts():
    """Hosts of seen words in new company, and hosts of words that training never saw."""
    m = url_filter.default_model()
    share = lambda rows, label: np.mean([(m.probability(*url_filter.split_url(u)) >= m.block_from) == bool(y) for u, y in rows if y == label])
    new = url_filter.labelled(rows=600, seed=99)
    assert share(new, 0) > 0.97 and share(new, 1) > 0.97
    other = url_filter.labelled(unseen=True)[1::2]
    assert share(other, 0) > 0.95
    seen, held = (set(url_filter._families(url_filter.BLOCKED, x)) for x in (False, True))
    assert held and not any(a in b or b in a for a in seen for b in held)


def test_judge(spark):
    rows = [(1, "https://free-casino-bets.site/win"), (2, "https://www.gardening-notes.site/recipes.html"), (3, None), (None, "http://x.com/fr/1"), (3, "")]
    m = url_filter.default_model()
    got = sorted((r["page_id"] or 0, r["rule"] or "", r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host"), m).collect())
    assert got[0] == (0, "com/fr/", "allow") and got[1][2] == "block" and got[2][2] == "allow" and [g[2] for g in got[3:]] == ["allow", "allow"]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), m).collect() == []
    none = url_filter.fit([])
    assert none.probability("casino.com", "/") < none.block_from


SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id long, url string, date long, type string, status int, headers map<string,string>, digest string, profile string, truncated string"


def records():
    """Ids and dates clash often: 60 ids and 12 dates for 500 records."""
    rnd = random.Random(6)
    out = []
    for k in range(500):
        url = rnd.choice(["http://WWW.a.com/x/", "https://a.com:443/x?utm_source=q#f", "http://a.com/x?b=2&a=1", f"http://b.org/{k % 9}", None, "no url"]) if k % 3 else "http://a.com/x"
        full = rnd.random() < 0.5
        tag = rnd.choice(['"1"', 'W/"1"', '"2"', None])
        headers = None if rnd.random() < 0.1 else {"ETag": tag, "Expires": f"e{k}", "Content-Type": f"c{k}"}
        out.append((rnd.randrange(60), url, None if k % 50 == 3 else rnd.randrange(12), rnd.choice(["response", "response", "request"]) if full else "revisit", rnd.choice([200, 200, 404, 304, 206, None]) if full else 304, headers, rnd.choice([None, "d1", "d2"]), rnd.choice([None, SAME]), "length" if full and rnd.random() < 0.2 else None))
    return out + out[:5]


def test_revisits_equal_brute_force(spark):
    rows = records()
    canon = lambda u: None if u is None or "://" not in u else {"http://WWW.a.com/x/": "a.com/x", "https://a.com:443/x?utm_source=q#f": "a.com/x", "http://a.com/x?b=2&a=1": "a.com/x?a=1&b=2"}.get(u, u[7:])
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    text = lambda h: "\n".join(f"{k}={v or ''}" for k, v in sorted(low(h).items()))
    rank = lambda r: (r[2], r[0], r[6] is not None, r[6] or "", r[4], text(r[5]))
    full = [r for r in rows if r[3] == "response" and r[4] not in (304, 206, None) and r[8] is None]
    want = []
    for i, u, t, kind, status, h, digest, profile, _ in rows:
        if kind != "revisit":
            want.append((i, "full", None, status, digest, low(h)))
            continue
        before = [r for r in full if t is not None and canon(u) is not None and r[2] is not None and canon(r[1]) == canon(u) and (r[2], r[0]) <= (t, i)]
        if not before:
            want.append((i, "orphan", None, status, digest, low(h)))
            continue
        r, same = max(before, key=rank), profile == SAME
        a, b = (None if same else low(x).get("etag") for x in (h, r[5]))
        bad = (a and b and a.removeprefix("W/") != b.removeprefix("W/")) or (digest and r[6] and digest != r[6])
        some = (a and b) or (digest and r[6])
        if bad:
            want.append((i, "mismatch", r[0], status, digest, low(h)))
        else:
            merged = low(h) if same else low(r[5]) | {k: v for k, v in low(h).items() if k in warc.PERMITTED}
            want.append((i, "resolved" if some else "unchecked", r[0], status if same else r[4], r[6] or digest, merged))
    for n in (5, 2):  # in either order of the rows
        df = spark.createDataFrame(rows[::n - 3 if n == 2 else 1], RECORDS).repartition(n)
        got = [(r["record_id"], r["outcome"], r["ref_id"], r["status"], r["digest"], r["headers"]) for r in warc.resolve_revisits(df).collect()]
        assert sorted(map(repr, [(*g[:5], sorted(g[5].items())) for g in got])) == sorted(map(repr, [(*g[:5], sorted(g[5].items())) for g in want]))
    assert len({w[1] for w in want}) == 5


def test_a_304_or_a_truncated_response_is_not_full(spark):
    rows = [(1, "http://a.com/", 1, "response", 200, {"ETag": '"1"'}, "d", None, None), (2, "http://a.com/", 2, "response", 304, {"ETag": '"1"'}, None, None, None), (3, "http://a.com/", 3, "response", 200, {}, "x", None, "time"), (4, "http://a.com/", 4, "revisit", 304, {"ETag": '"1"'}, None, None, None)]
    for some in (rows, rows[::-1]):
        got = warc.resolve_revisits(spark.createDataFrame(some, RECORDS)).where("record_id = 4").first()
        assert (got["outcome"], got["ref_id"], got["status"], got["digest"]) == ("resolved", 1, 200, "d")


def test_headers_merge_and_payload(spark):
    rows = [(1, "http://a.com/", 1, "response", 200, {"ETag": '"1"', "Content-Type": "text/html", "Expires": "old"}, "d"), (2, "http://a.com", 2, "revisit", 304, {"etag": 'W/"1"', "expires": "new", "content-type": "x", "Expires": "twice"}, None)]
    x = warc.resolve_revisits(spark.createDataFrame(rows, "record_id long, url string, date long, type string, status int, headers map<string,string>, digest string"))
    got = {r["record_id"]: r for r in warc.with_payload(x, spark.createDataFrame([(1, b"body")], "record_id long, payload binary")).collect()}
    assert got[2]["headers"] == {"etag": 'W/"1"', "expires": "new", "content-type": "text/html"} and got[2]["payload"] == b"body" and got[2]["status"] == 200
    assert got[1]["payload"] == b"body"


def test_warc_round_trip(spark, tmp_path):
    import gzip

    def record(kind, ident, http):
        return b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:%s>\r\nWARC-Target-URI: http://a.com/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, ident, len(http), http)

    parts = [record(b"response", b"1", b"HTTP/1.1 200 OK\r\nETag: \"x\"\r\n\r\nhello"), record(b"revisit", b"2", b"HTTP/1.1 304 Not Modified\r\nETag: \"x\"\r\n\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "b.warc").write_bytes(b"".join(parts)[:-30])
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(b"")
    got = warc.read_warc(spark, f"{tmp_path}/*.warc*").collect()
    assert sorted((r["type"], r["status"], bytes(r["payload"])) for r in got) == [("response", 200, b"hello"), ("response", 200, b"hello"), ("revisit", 304, b"")]
    assert got[0]["headers"]["etag"] == '"x"'


def test_warc_goes_on_after_a_broken_record(spark, tmp_path):
    import gzip

    def record(ident, body, size=None):
        return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: %s\r\nWARC-Truncated: length\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (ident, len(body) if size is None else size, body)

    good = [record(b"<%d>" % k, b"body %d " % k * (40 if k < 9 else 300_000)) for k in range(10)]
    (tmp_path / "a.warc").write_bytes(b"".join([*good[:3], record(b"<x>", b"short", 10**6), good[3], b"junk\r\n", good[4], record(b"<y>", b"long one", 2), *good[5:]]))
    packed = [gzip.compress(g) for g in good]
    (tmp_path / "b.warc.gz").write_bytes(b"".join([*packed[:4], packed[4][:40] + b"\0" * 30, *packed[5:]]))
    got = warc.read_warc(spark, f"{tmp_path}/*").collect()
    whole = {(b"<%d>" % k).decode(): b"body %d " % k * (40 if k < 9 else 300_000) for k in range(10)}
    ids = sorted(r["record_id"] for r in got)
    assert ids == sorted([*whole, *(k for k in whole if k != "<4>")])
    assert all(bytes(r["payload"]) == whole[r["record_id"]] and r["truncated"] == "length" for r in got)
