"""Merkle manifests, benchmark passages and collocations against brute force, on whole small tables and on odd rows."""

import collections
import random
import re
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.llm import collocations, contamination, merkle, queries

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __own string, leaf string, spans string, phrase string, part long, n long"
ITEM = "The quick brown fox-jumps over a lazy dog, and then it RUNS away from 12 bears"
EXTRA = ("z", "z", "z", "z", 7, 7)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like those inside the operators."""
    long_text = " ".join(f"v{i % 977}x{i}" for i in range(30_000)) + " " + ITEM.lower() + "\nend of it"
    rows = [
        (1, ITEM + " tail", "en", "a", 3), (2, "head\n" + ITEM.upper(), "en", "a", 3), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \t\n ", "fr", None, 3), (None, "no id " + ITEM, "en", "a", 1),
        (7, long_text, "de", "b", 9), (8, "Same Words\nhere", "en", "c", 1), (8, "Same Words\nhere", "en", "c", 1), (8, "other words under an id", "en", "c", 1), (10, "été où\nça 日本語 " + "x" * 400, "fr", "c", 1), (11, "123 ,.;", "und", "a", 2), (-5, "tiny thing", "en", "é", 2),
    ]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.filter("false")


@pytest.mark.parametrize("name", ["op11_merkle", "op12_decontamination", "op13_collocations"])
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(map(tuple, got[sorted(got.columns)].values.tolist()), key=str) == sorted(map(tuple, want[sorted(want.columns)].values.tolist()), key=str)


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(nodes, fanout):
    """The root of the nodes, and of each the others of its runs in order."""
    paths, own = [""] * len(nodes), list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(own):
            run = at // fanout * fanout
            paths[k] += "".join(nodes[j] for j in range(run, min(run + fanout, len(nodes))) if j != at)
            own[k] = at // fanout
        nodes = [digest(*nodes[a : a + fanout]) for a in range(0, len(nodes), fanout)]
    return nodes[0], paths


def expected(rows, fanout):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[0][2] for x in sorted(by[s], key=lambda x: x[0])], fanout) for s in order}
    root, above = tree([subs[s][0] for s in order], fanout)
    out = []
    for s, up in zip(order, above, strict=True):
        out += [(r.doc_id, key[2], subs[s][0], root, own + up) for (key, r), own in zip(sorted(by[s], key=lambda x: x[0]), subs[s][1], strict=True)]
    return out


@pytest.mark.parametrize("name,fanout,block", [("odd", 3, 1024), ("odd", 2, 2), ("docs", 3, 9), ("docs", 3, 27), ("docs", 5, 1024)])
def test_manifest(name, fanout, block, request, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", block)
    df = request.getfixturevalue(name)
    found = merkle.manifest(df, fanout=fanout).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, bytes(r.siblings).decode()) for r in found]
    assert collections.Counter(got) == collections.Counter(expected(df.collect(), fanout))
    assert all(r.claim == r.leaf and r.folded == r.root for r in found)
    assert all(merkle.fold(r.leaf.encode(), bytes(r.siblings), bytes(r.turns)).decode() == r.root for r in found)


def test_tampering_is_found(odd):
    """Rows whose texts lose their line ends no longer lead to the root; the others do."""
    found = merkle.manifest(odd, {"text": F.translate("text", "\n", "")}).collect()
    changed = {leaf(r, r.text): leaf(r, (r.text or "").replace("\n", "") if r.text is not None else None) for r in odd.collect()}
    assert sum(k != v for k, v in changed.items()) == 5  # of two rows that are equal one key
    for r in found:
        assert r.claim == changed[r.leaf] and (r.folded == r.root) == (r.claim == r.leaf)


def test_a_manifest_depends_on_rows_alone(odd):
    want = collections.Counter((r.doc_id, r.leaf, bytes(r.siblings), r.root) for r in merkle.manifest(odd).collect())
    assert want == collections.Counter((r.doc_id, r.leaf, bytes(r.siblings), r.root) for r in merkle.manifest(odd.repartition(5, "text")).collect())


def test_one_source_over_many_blocks(spark):
    """A source over several partitions and blocks, with one whose leaves are equal rows."""
    rows = spark.range(0, 2000, 1, 7).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("t").alias("text"))
    rows = rows.unionAll(spark.range(0, 500, 1, 3).select(F.lit(1).cast("long"), F.lit("again"), F.lit("en"), F.lit(1).cast("long"), F.lit("t")))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, bytes(r.siblings).decode()) for r in merkle.manifest(rows).collect()]
    assert collections.Counter(got) == collections.Counter(expected(rows.collect(), 3))


def test_nothing(spark, nothing, odd):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert merkle.manifest(nothing).collect() == []
    assert contamination.find(nothing, empty).collect() == []
    assert collocations.mine(nothing).collect() == []
    assert all(r.spans == [] and r.items == [] and r.longest == 0 for r in contamination.find(odd, empty).collect())
    assert contamination.decontaminate(odd, empty).count() == odd.count()


def plain(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(rows, items, window):
    """(doc_id, words, covered places, item ids, longest match) of each row, window by window."""
    out = []
    for r in rows:
        w, covered, ids, longest = plain(r.text), set(), set(), 0
        for i in items:
            v = plain(i.text)
            need = min(window, len(v))
            for b in range(max(1, len(v) - window + 1) if v else 0):
                for a in range(len(w) - need + 1):
                    if w[a : a + need] == v[b : b + need]:
                        covered.update(range(a, a + need))
                        ids |= {str(i.item_id)} - {"None"}
                        k = need
                        while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                            k += 1
                        longest = max(longest, k)
        out.append((r.doc_id, len(w), tuple(sorted(covered)), tuple(sorted(ids)), longest))
    return collections.Counter(out)


def told(found):
    return collections.Counter((r.doc_id, r.n_words, tuple(p for s in r.spans for p in range(s.start, s.stop)), tuple(r.items), r.longest) for r in found.collect())


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, ITEM), (2, "unrelated " + ITEM), (30, "Same words HERE"), (4, None), (5, " ,. "), (None, "tiny"), (7, ITEM), (7, "12 bears"), (8, "日本語 xx"), (4, None)]
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "item_id long, text string, spans string, n_words long")


@pytest.mark.parametrize("window", [1, 3, 10])
@pytest.mark.parametrize("block", [1 << 24, 60])
def test_passages(odd, items, window, block, monkeypatch):
    """One pass, and several with blocks of an item or two."""
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block)
    assert told(contamination.find(odd, items, window)) == hits(odd.collect(), items.collect(), window)


def test_passages_are_removed(odd, items):
    want = collections.Counter(str(r) for r in odd.collect() if not next(iter(hits([r], items.collect(), 10)))[2])
    kept = contamination.decontaminate(odd, items)
    assert kept.columns == odd.columns and collections.Counter(map(str, kept.collect())) == want
    assert 3 < sum(want.values()) < odd.count()


def test_long_documents_go_on_in_the_next_shard(spark, monkeypatch):
    """Passages across the ends of shards and of items' pieces."""
    monkeypatch.setattr(contamination, "STEP", 64)
    monkeypatch.setattr(contamination, "PIECE_WORDS", 15)
    rng = random.Random(1)
    text = " ".join(rng.choice("abcd") for _ in range(600))
    docs = spark.createDataFrame([(1, text), (2, text[100:400]), (3, "q " * 50 + text[:90])], "doc_id long, text string")
    items = spark.createDataFrame([(k, text[2 * a : 2 * a + 100]) for k, a in enumerate((0, 113, 300, 555))], "item_id long, text string")
    want = {(r.doc_id, r.n_words): r for r in contamination.find(docs, items, 7).collect()}
    got = hits(docs.collect(), items.collect(), 7)
    assert {(k[0], k[1], k[2], k[3]) for k in got} == {(r.doc_id, r.n_words, tuple(p for s in r.spans for p in range(s.start, s.stop)), tuple(r.items)) for r in want.values()}
    small = contamination.Items([" ".join(plain(i.text)).encode() for i in items.collect()], ["x"] * 4, 7)
    monkeypatch.setattr(contamination, "SHARD_WORDS", 80)
    import pyarrow as pa

    row = {"doc_id": 1, "text": text} | {f.name: None for f in contamination.FOUND}
    kinds = [pa.int64(), contamination._SPANS, pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
    batch = pa.record_batch([pa.array([1]), pa.array([text]), *(pa.array([None], t) for t in kinds)], names=list(row))
    (out,) = contamination._searched(iter([batch]), small)
    assert [p for s in out.column("spans")[0].as_py() for p in range(s["start"], s["stop"])] == [p for s in want[1, 600].spans for p in range(s.start, s.stop)]
    assert out.column("longest")[0].as_py() == next(k[4] for k in got if k[0] == 1)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, (2, 3, 5, 40000)[seed], 400)
    words[100:200] = words[:100]
    depth = (64, 20, 9, 33)[seed]
    key = lambda i: tuple(int(v) for v in words[i : i + depth])
    cut = lambda t: t[: t.index(0)] if 0 in t else t
    order = contamination.suffix_array(words, int(words.max()), depth)
    assert sorted(order) == [i for i in range(400) if words[i]]
    seen = [cut(key(i)) for i in order]
    assert seen == sorted(seen)


def phrases(rows, max_n, least, share, top):
    n, f = collections.Counter(), collections.Counter()
    for r in rows:
        lang = r.lang if r.lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if any(m == lang and len(q) > len(p) and 100 * b >= share * a and inside(p, q) for (m, q), b in often.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)}


def mined(found):
    return {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect()}


@pytest.mark.parametrize("max_n,least,share,top", [(5, 100, 100, 2000), (4, 20, 100, 7), (3, 15, 80, 50), (2, 10, 100, 100)])
def test_collocations(docs, max_n, least, share, top):
    want = phrases(docs.collect(), max_n, least, share, top)
    assert want and mined(collocations.mine(docs, max_n, least, share, top)) == want


@pytest.mark.parametrize("bits", [1 << 26, 1 << 18])
def test_collocations_of_odd_rows(spark, odd, bits, monkeypatch):
    """Ties, tabs, repeats within a piece, letters beyond ASCII; with filters that are nearly full and texts in parts as well."""
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    monkeypatch.setattr(collocations, "MOST_PAIRS", bits >> 16)
    monkeypatch.setattr(collocations, "TOGETHER", 1 << (23 if bits > 1 << 20 else 8))
    more = spark.createDataFrame([(20, "é È x\ty  z.É é; a a a a a a a! A a", None), (21, "one two three one two three; three one\x0btwo", "und"), (22, "one two\rtwo one", "und")], "doc_id long, text string, lang string")
    rows = odd.select("doc_id", "text", "lang", "phrase").unionAll(more.withColumn("phrase", F.lit("z")))
    assert mined(collocations.mine(rows, 5, 2, 100, 2000)) == phrases(rows.collect(), 5, 2, 100, 2000)


def test_steps_between_hashes():
    keys = np.array([0, 1, 5, 65535, 65536, 131071, 400_000, 400_001, 3, 65534, 9_000_000])
    steps, ends = collocations._gaps(keys, np.array([0, 8]))
    assert collocations._from_gaps(steps[: ends[7]].tobytes()).tolist() == keys[:8].tolist()
    assert collocations._from_gaps(steps[ends[7] :].tobytes()).tolist() == keys[8:].tolist()


def test_scores_beyond_64_bits(spark):
    """1000 a n is over 2^63 for counts of a very large corpus; the division stays exact."""
    a, n, left, right = 9_007_199_254_740_993, 9_100_000_000_000_000_003, 9_007_199_254_740_997, 9_007_199_254_740_999
    d = lambda v: F.lit(v).cast("decimal(19,0)")
    row = spark.range(1).select((F.lit(1000).cast("decimal(4,0)") * d(a) * d(n)).alias("up"), (d(left) * d(right)).alias("down")).select(F.expr("up div down").alias("s")).first()
    assert row.s == 1000 * a * n // (left * right)
