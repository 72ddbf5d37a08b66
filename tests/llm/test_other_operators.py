"""Operators on vectors and pages against brute force."""

import hashlib
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.llm import neardup_graph, topk, urls, warc
from assayloom.llm.queries import op1_embeddings, op3_topk, op9_urls, op10_warc

from ..conftest import SF


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows, centre = [], rng.standard_normal((30, 16))
    for i in range(600):
        v = centre[i % 30] + 0.12 * rng.standard_normal(16) if i < 300 else rng.standard_normal(16)
        rows.append((i, v.tolist(), "z"))
    rows += [(1000 + i, rows[3][1], "z") for i in range(50)]  # copies
    rows += [(2000, None, None), (2001, [0.0] * 16, "z"), (2002, [float("nan")] + [1.0] * 15, "z"), (2003, [None] + [1.0] * 15, "z"), (2004, [float("inf")] * 16, "z"), (2005, [], "z"), (None, rows[3][1], "z"), (20, rows[20][1], "z")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")


def links(rows, least=0.95):
    good = [r for r in rows if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    x = np.array([r.embedding for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near, ids = x @ x.T >= least, np.array([r.vec_id for r in good])
    label = ids.copy()
    while True:
        low = np.array([label[n].min() for n in near])
        if (low == label).all():
            break
        label = low
    return {i: (int(n) - 1, int(c)) for i, n, c in zip(ids.tolist(), near.sum(axis=1), label, strict=True)}


def test_near_duplicate_vectors(spark, vectors):
    rows = vectors.collect()
    want = links(rows)
    got = neardup_graph.near_duplicates(vectors)
    assert got.count() == len([r for r in rows if r.vec_id is not None])
    found = {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}
    assert all(found[i] == (0, i) for i in range(2000, 2006))
    assert all(found[i][0] <= n for i, (n, _) in want.items())
    total = sum(n for n, _ in want.values())
    assert sum(found[i][0] for i in want) >= 0.98 * total
    assert np.mean([found[i][1] == c for i, (_, c) in want.items()]) >= 0.99
    assert neardup_graph.audit(vectors, got) >= 0.9 and got.first().recall == neardup_graph.audit(vectors, got)
    assert neardup_graph.near_duplicates(vectors.filter("false")).count() == 0


def test_all_pairs_of_near_cells_where_recall_is_low(spark, vectors, monkeypatch):
    want = links(vectors.collect())
    monkeypatch.setattr(neardup_graph, "CELL", 64)
    monkeypatch.setattr(neardup_graph, "MOST", 100)
    monkeypatch.setattr(neardup_graph, "audit", lambda *_: 0.0)
    found = {r.vec_id: (r.n_links, r.component_id) for r in neardup_graph.near_duplicates(vectors).collect()}
    assert {i: found[i] for i in want} == want


@pytest.mark.parametrize("overlap", [2, 0])
def test_different_vectors_under_one_id(spark, overlap):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a), (5, b), (6, [1.0, 0.1, 0.0]), (7, [0.1, 1.0, 0.0]), (4, [0.12, 1.0, 0.0]), (5, [0.0, 0.0, 1.0]), (5, [0.0, 0.0, 1.0])]
    got = neardup_graph.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), overlap=overlap).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(4, 2, 4), (5, 1, 5), (5, 1, 5), (5, 1, 5), (5, 2, 4), (6, 1, 5), (7, 2, 4)]


def test_a_dense_group_larger_than_a_cell(spark, monkeypatch):
    for name, n in (("CELL", 32), ("MOST", 64), ("SPLIT", 128)):
        monkeypatch.setattr(neardup_graph, name, n)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.02 * rng.standard_normal(16)).tolist()) for i in range(400)] + [(1000 + i, rng.standard_normal(16).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = links(df.collect())
    found = {r.vec_id: (r.n_links, r.component_id) for r in neardup_graph.near_links(df).collect()}
    assert all(found[i][0] <= n for i, (n, _) in want.items())
    assert sum(n for n, _ in found.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert {found[i][1] for i in range(400)} == {0}


@pytest.mark.parametrize("overlap", [2, 4, 8])
def test_pairs_that_meet_in_several_cells_count_once(spark, monkeypatch, overlap):
    for name, n in (("CELL", 64), ("MOST", 128), ("SPLIT", 256), ("CENTRES", 4)):  # split twice, and dealt into slices
        monkeypatch.setattr(neardup_graph, name, n)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((40, 16))
    rows = [(i, (centre[i % 40] + 0.15 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = links(df.collect())
    found = {r.vec_id: r.n_links for r in neardup_graph.near_links(df, overlap=overlap).collect()}
    assert all(found[i] <= n for i, (n, _) in want.items())
    assert sum(found.values()) >= 0.95 * sum(n for n, _ in want.values())


def test_a_hit_counts_where_any_cell_finds_it(monkeypatch):
    import pyarrow as pa

    table = pa.table({"rep": [1, 2], "copies": [1, 5], "e": [[1.0, 0.1], [1.0, 0.0]], "cells": pa.array([[7, 9], [7, 9]], pa.list_(pa.int64())), "order": [0, 1], "indexed": [True, True], "asked": [True, True]})
    whole = neardup_graph._Cell.search
    full = neardup_graph._links(table, 2, 0.95, 2)
    monkeypatch.setattr(neardup_graph._Cell, "search", lambda *a: tuple(v[:0] for v in whole(*a)))
    missed = neardup_graph._links(table, 2, 0.95, 2)
    sent = {1: [], 2: []}
    for r in (*full.to_pylist(), *full.to_pylist(), *missed.to_pylist()):
        if r["several"] is not None:
            sent[r["rep"]].append(r["several"])
    batch = pa.record_batch([pa.array([1, 2]), pa.array([sent[1], sent[2]], pa.list_(pa.binary()))], ["rep", "several"])
    assert [b.to_pydict() for b in neardup_graph._settle([batch])] == [{"rep": [1, 2], "n": [5, 1], "near": [1, 1]}]


def test_the_audit_sees_lost_links_beside_many_copies(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((100, 16))
    rows = [(i, (centre[i % 100] + 0.03 * rng.standard_normal(16)).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 16) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neardup_graph.near_links(df)
    assert neardup_graph.audit(df, got) >= 0.9
    lost = got.withColumns({"n_links": F.when(F.col("vec_id") < 1000, 0).otherwise(F.col("n_links")), "n_near": F.lit(0).cast("long")})
    assert neardup_graph.audit(df, lost) < 0.1
    assert neardup_graph.audit(df, got.withColumn("n_near", F.col("n_near") * 2)) < 0.6


def test_query_1(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in op1_embeddings(spark, SF).collect()}
    assert got == links(rows)


def best(rows, every, k=20):
    """The ranked rows of every query by comparing all rows with all; vectors may have any length and whole numbers of any size."""
    kept = [(r.vec_id, [int(np.floor(64 * x)) for x in r.embedding]) for r in rows if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    for i, (q, v) in enumerate(kept):
        if q % every == 0:
            scores = ((-sum(a * b for a, b in zip(v, w, strict=False)), d) for j, (d, w) in enumerate(kept) if i != j)
            yield from ((q, rank + 1, d, -score) for rank, (score, d) in enumerate(sorted(scores)[:k]))


@pytest.fixture(scope="module")
def odd_vectors(spark, vectors):
    """Also several empty vectors, short ones, repeated ids with vectors of their own, a query of zeros, and large components."""
    rows = [(40, [], "z"), (3000, [], "z"), (60, [0.5, -0.25], "z"), (60, [-3.0] * 16, "z"), (80, [0.0] * 16, "z"), (100, [300.0] * 16, "z"), (3001, [-20_000.0] + [1.0] * 15, "z"), (3001, [2.0] * 16, "z")]
    return vectors.unionAll(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string"))


@pytest.mark.parametrize("small", [False, True])
def test_top_k(odd_vectors, vectors, small, monkeypatch):
    if small:  # many shards, batches and summaries; some shards of one pivot are dealt out
        for name, n in (("SHARD", 64), ("BATCH", 8), ("SUMMARIES", 4), ("PIVOTS", 6)):
            monkeypatch.setattr(topk, name, n)
    for df in (odd_vectors, vectors.filter("vec_id < 4 or vec_id > 1999"), vectors.filter("vec_id = 2005"), vectors.filter("vec_id % 20 <> 0")):
        assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(best(df.collect(), 20))
    assert topk.top_k(vectors.filter("false")).count() == 0


def test_top_k_of_large_numbers(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (10.0**6 * rng.integers(-9, 9, 6) + rng.integers(0, 64, 6) / 64).tolist()) for i in range(90)]  # beyond what doubles add exactly
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, k=5).collect())) == sorted(best(df.collect(), 20, 5))
    with pytest.raises(ValueError, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e300])], df.schema)).count()


def test_top_k_sends_a_query_only_where_it_may_score(spark, monkeypatch):
    for name, n in (("SHARD", 50), ("PIVOTS", 20)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(2)
    centre = 4 * np.eye(8)
    rows = [(i, (centre[i % 8] + 0.05 * rng.standard_normal(8)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent = []
    whole = topk.cut
    monkeypatch.setattr(topk, "cut", lambda frame: sent.append(whole(frame)) or sent[-1])
    assert sorted(map(tuple, topk.top_k(df, every=10).collect())) == sorted(best(df.collect(), 10))
    assert sent[-1].columns[:2] == ["shard", "part"] and sent[-1].count() < 0.5 * 80 * 16  # of the queries times the shards


def test_query_3(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert sorted(map(tuple, op3_topk(spark, SF).collect())) == sorted(best(rows, 20))


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q#f", "http://example.com", "x://example.net/de/8", "http://sub.example.net/de/7", "http://example.org/es/1", "http://com/en/", "http://notexample.com/en/7", "http://a.net?x=/de/", "http://É.com/en/1", "a://b://c/d", "http://h/p\nq"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def judged(host, path):
    fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, None, "z") for i, u in enumerate(ODD_URLS)] + [(0, ODD_URLS[0], None, "z"), (None, "http://example.com/x", None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, mass string")


def test_rules(pages):
    got = urls.judge(pages).collect()
    assert len(got) == pages.count()
    url = {r.page_id: r.url for r in pages.collect()}
    for r in got:
        host, path = parts(url[r.page_id])
        rule = judged(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    assert urls.judge(pages.filter("false")).count() == 0


ROUNDS = 6


def walk(seeds, edges, rounds, damping):
    out = {}
    for a, _, w in edges:
        out[a] = out.get(a, 0) + w
    held = dict(seeds)
    for _ in range(rounds):
        stuck = sum(m for h, m in held.items() if h not in out)
        new = {h: s // 100 * (100 - damping) + stuck * damping // 100 * s // sum(seeds.values()) for h, s in seeds.items()}
        for a, b, w in edges:
            if a in held:
                new[b] = new.get(b, 0) + held[a] * damping // 100 // out[a] * w
        held = new
    return held


def test_the_walk_agrees_with_its_sql(spark):
    import duckdb

    from assayloom.llm.queries import _op9_sql

    rng = np.random.default_rng(0)
    hosts = [f"h{i}.io" for i in range(30)] + ["x.com", "a.net", "b.org", "example.com"]
    rows = []
    for i in range(400):  # a third of the pages are of one host
        host = hosts[0] if i % 3 == 0 else hosts[int(rng.integers(len(hosts)))]
        rows.append((i, f"http://{host}{('/en/7', '/de/1', '/es/2', '/')[int(rng.integers(4))]}", "".join(f"<a href='//{hosts[int(k)]}/x'>" for k in rng.integers(0, len(hosts), 3))))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.judge(df, rounds=ROUNDS).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert [tuple(r) for r in got] == con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({_op9_sql(ROUNDS)}) ORDER BY page_id").fetchall()
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_trust_and_distrust_walk_the_links(spark):
    link = lambda *hosts: "".join(f"<a HREF='//{h.upper()}/x'>" for h in hosts)
    html = {"good.net": link("near.io", "far.io"), "near.io": link("far.io", "good.net"), "far.io": link("spam.org"), "feeder.io": link("spam.org", "worse.io"), "worse.io": link("spam.org"), "spam.org": link("worse.io")}
    path = {"good.net": "/de/1", "spam.org": "/es/1"}
    rows = [(i, f"http://{h}{path.get(h, '/')}", html[h]) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in urls.judge(pages, rounds=ROUNDS).collect()}
    edges = [(h, t.lower(), 1) for h, x in html.items() for t in re.findall(r"//([^/]+)/", x)]
    back = [(b, a, w) for a, b, w in edges]
    trust, distrust = walk({"good.net": urls.UNIT}, edges, ROUNDS, 85), walk({"spam.org": urls.UNIT}, back, ROUNDS, 85)
    for h, r in got.items():
        for found, want in ((r.trust, trust.get(h, 0)), (r.distrust, distrust.get(h, 0))):
            assert abs(int(found) - want) < 1000  # of 10**24: each share is cut to a whole number
    assert abs(int(sum(r.trust for r in got.values())) - urls.UNIT) < 1000  # no mass is lost
    assert got["feeder.io"].verdict == "block" and got["near.io"].verdict == "allow"


def test_the_rounds_reach_the_fixed_point(spark):
    """A ring with a way out: masses by solving the linear system. A damping of 40 percent takes eight rounds."""
    assert 0.85 ** urls.rounds_for() <= urls.TOLERANCE < 0.85 ** (urls.rounds_for() - 1)
    hosts = ["good.net", *(f"r{i}.io" for i in range(6))]
    to = {h: [hosts[(i + 1) % 7]] for i, h in enumerate(hosts)}
    to["r2.io"] = ["r3.io", "out.io"]
    rows = [(i, f"http://{h}{'/de/1' if h == 'good.net' else '/'}", "".join(f"<a href='//{t}/'>" for t in to[h])) for i, h in enumerate(hosts)] + [(9, "http://out.io/", "")]
    got = {r.host: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), damping=40).collect()}
    names = [*hosts, "out.io"]
    step = np.zeros((8, 8))
    for i, h in enumerate(names):
        for t in to.get(h, ["good.net"]):
            step[names.index(t), i] += 1 / len(to.get(h, ["good.net"]))
    start = np.eye(8)[0]
    want = np.linalg.solve(np.eye(8) - 0.4 * step, 0.6 * start)
    assert sum(abs(int(got[h].trust) / urls.UNIT - x) for h, x in zip(names, want, strict=True)) <= 2 * urls.TOLERANCE


def test_a_hub_host_passes_its_mass_on(spark):
    link = lambda *hosts: "".join(f"<a href='//{h}/x'>" for h in hosts)
    many = [f"m{i}.io" for i in range(400)]
    html = [("spam.org", "/es/1", "")] + [("hub.io", "/", link("spam.org", *many))] * 2 + [("hub.io", "/", link("spam.org"))] * 8
    html += [(h, "/", link("hub.io")) for h in many] + [("deep.io", "/", link("m0.io")), *((f"d{i}.io", "/", link("m0.io")) for i in range(400))] + [("tail.io", "/", link("deep.io"))]
    html += [("good.net", "/de/1", link("hub.io", *many))]
    rows = [(i, f"http://{h}{p}", x) for i, (h, p, x) in enumerate(html)]
    got = {r.host: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rounds=ROUNDS).collect()}
    w = {}
    for h, _, x in html:
        for t in re.findall(r"//([^/]+)/", x):
            w[h, t] = w.get((h, t), 0) + 1

    def exact(seed, edges):
        out, held = {}, {seed: Fraction(1)}
        for (a, _), n in edges.items():
            out[a] = out.get(a, 0) + n
        for _ in range(ROUNDS):
            new = {seed: Fraction(15, 100) + Fraction(85, 100) * sum(m for h, m in held.items() if h not in out)}
            for (a, b), n in edges.items():
                if a in held:
                    new[b] = new.get(b, 0) + held[a] * 85 * n / (100 * out[a])
            held = new
        return held

    trust, distrust = exact("good.net", w), exact("spam.org", {(b, a): n for (a, b), n in w.items()})
    for h, r in got.items():
        for found, want in ((r.trust, trust.get(h, 0)), (r.distrust, distrust.get(h, 0))):
            assert abs(int(found) / urls.UNIT - float(want)) <= 1e-9 * float(want)
    assert got["tail.io"].trust == 0 and got["tail.io"].verdict == "block"


def test_query_9_has_no_python(spark):
    plan = op9_urls(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_records(spark, tmp_path):
    big, small = "x" * 1000, "y" * 999
    rows = [(1, "http://a", big), (5, "http://b", big), (9, None, big), (2, "u", small), (3, "u", small), (4, "u", None), (6, "u", ""), (9, None, big), (None, "u", big), (7, "a\r\nb", "ü" * 500)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    warc.write_archive(df, path)
    got = warc.read_archive(spark, path)
    back = got.filter("record_type <> 'warcinfo'").collect()
    page = lambda x: int(x[12:-1]) if x and x[12:-1] else None
    assert len(back) == len(rows)
    for r in back:
        own = [((h or "").encode()) for i, _, h in rows if i == page(r.record_id)]
        if r.record_type == "response":
            assert r.payload in own and r.refers_to is None and r.payload_digest == "sha1:" + hashlib.sha1(r.payload).hexdigest()
        else:
            assert page(r.refers_to) == 9 and r.payload == b"" and r.payload_bytes == 1000
    kinds = sorted((str(page(r.record_id)), r.record_type) for r in back)
    assert kinds == sorted([("1", "revisit"), ("5", "revisit"), ("9", "response"), ("9", "response"), ("None", "revisit"), *((k, "response") for k in ("2", "3", "4", "6", "7"))])
    heads = warc.read_archive(spark, path, payload=False)
    assert heads.filter("payload is not null").count() == 0
    one = heads.filter("record_type = 'revisit' and record_id = '<urn:x-page:5>'")
    assert one.count() == 1
    assert heads.filter(F.col("record_id").isin("<urn:x-page:2>", "<urn:x-page:3>")).count() == 2
    warc.write_archive(df.filter("false"), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_records_are_skipped_unread_and_splits_meet_once(tmp_path, monkeypatch):
    data = b"".join(warc.record({"WARC-Type": "response" if i % 2 else "revisit", "WARC-Record-ID": f"<urn:x-page:{i}>"}, bytes([i % 251]) * (3000 + i)) for i in range(60))
    (tmp_path / "a.warc.gz").write_bytes(data)
    reader = warc.WarcReader({"path": str(tmp_path)})
    monkeypatch.setattr(warc, "SPLIT", 700)
    parts_ = reader.partitions()
    assert len(parts_) > 5
    rows = [x for p in parts_ for b in reader.read(p) for x in b.to_pylist()]
    assert [r["record_id"] for r in rows] == [f"<urn:x-page:{i}>" for i in range(60)] and all(r["payload"] == bytes([i % 251]) * (3000 + i) for i, r in enumerate(rows))
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1
    asked = []
    monkeypatch.setattr(warc._Members, "_read", lambda self, at, n, f=warc._Members._read: asked.append(n) or f(self, at, n))
    assert sum(b.num_rows for p in parts_ for b in reader.read(p)) == 30


def test_plain_gzip_members_are_read_too(tmp_path):
    import gzip

    raw = [f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nContent-Length: 5\r\n\r\nabcd{i}\r\n\r\n".encode() for i in range(5)]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in raw))
    reader = warc.WarcReader({"path": f"file://{tmp_path}/b.warc.gz"})
    assert [x["payload"] for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()] == [f"abcd{i}".encode() for i in range(5)]


def test_query_10(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in op10_warc(spark, SF).collect()}
    assert got == {r.page_id: (len(r.html.encode()), hashlib.sha1(r.html.encode()).hexdigest()) for r in rows}
