"""Operators on documents against brute force, on whole small tables and on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from assayloom.llm import common, language, mixing, packing, simhash, substrings, toxicity
from assayloom.llm.bpe import Bpe
from assayloom.llm.components import connected_components
from assayloom.llm.cutting import solve, whole_patterns

from ..conftest import SF

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, places string, h string, size string, __id string, __key string, __hot boolean, __own string, __text string, whole string"
PASSAGE = " ".join(f"w{i}" for i in range(40))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like those inside the operators."""
    long_text = " ".join(f"v{i % 977}x{i}" for i in range(30_000)) + " " + PASSAGE
    rows = [
        (1, PASSAGE + " tail one", "en", "a", 3), (2, "head " + PASSAGE, "en", "a", 3), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \t\n ", "fr", None, 3), (None, "no id " + PASSAGE, "en", "a", 1),
        (7, long_text, "de", "b", 9), (8, "Same Words here", "en", "c", 1), (8, "Same Words here", "en", "c", 1), (9, "same  words\there", "en", "c", 1), (10, "été où ça 日本語 " + "x" * 400, "fr", "c", 1), (11, "123 ,.;", "de", "a", 2), (-5, PASSAGE, "en", "é", 2),
    ]
    return spark.createDataFrame([(*r, None, "z", "z", "z", "i", "k", True, "o", "t", "w") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.filter("false")


def words(text):
    return WORDS.findall((text or "").encode())


def fingerprint(text):
    w = [x.lower() for x in words(text)]
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    """Each row's fingerprint and the place of the first row of its component, by comparing all pairs."""
    prints = [fingerprint(r.text) for r in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return prints, label


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_simhash(name, request):
    df = request.getfixturevalue(name)
    rows = df.select("doc_id", "text").collect()
    prints, label = groups(rows)
    least = {}
    for v, r in zip(label, rows, strict=True):
        least[v] = min((i for i in (least.get(v), r.doc_id) if i is not None), default=None)
    want = sorted(((r.doc_id, p, least[v]) for r, p, v in zip(rows, prints, label, strict=True)), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == want


def test_simhash_links_at_two_bits_and_not_at_three(spark):
    base = 0x0123456789ABCDEF
    nodes = spark.createDataFrame([(1, base), (2, base ^ 0b11), (3, base ^ 0b1110000), (4, base ^ (1 << 62))], "node long, fp long")
    found = {tuple(sorted((r.src, r.dst))) for r in simhash.link_near(nodes).collect()}
    links = connected_components(spark.createDataFrame(list(found), "src long, dst long"))
    assert {r.node: r.component for r in links.collect()} == {1: 1, 2: 1, 4: 1}
    with pytest.raises(ValueError):
        simhash.link_near(nodes, 3)


def test_one_of_each_group_stays(spark, odd, docs):
    # Rows that share an id or have none, with texts of their own, and columns with dots in their names.
    more = spark.createDataFrame([(20, "alone one two three four"), (20, "another text here it is"), (None, "nobody knows this one"), (None, "nobody knows this one"), (None, "nor that one at all"), (1, "an id again")], "doc_id long, text string")
    for df in (odd, docs, more.withColumn("a.b", F.lit(1)), more.select("text", "doc_id")):
        rows = df.collect()
        label, order = groups(rows)[1], lambda r: (r.doc_id is None, r.doc_id or 0)
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        best = {}
        for v, r in zip(label, rows, strict=True):
            best.setdefault(v, []).append(r)
        got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
        for own in best.values():
            first = min(map(order, own))
            found = [(r.doc_id, r.text) for r in own if got[r.doc_id, r.text]]
            assert len(set(found)) == 1 and order(next(r for r in own if (r.doc_id, r.text) == found[0])) == first
        assert sum(got.values()) == len(best)
        assert sorted(map(str, simhash.keep_one(df.repartition(3)).collect())) == sorted(map(str, kept.collect()))


def test_kept_rows_keep_every_column(odd):
    """Whatever a column is called, it comes back as it was."""
    rows = {str(r) for r in odd.collect()}
    for stage in (simhash.keep_one, language.keep_identified, mixing.resample):
        kept = stage(odd)
        assert kept.columns == odd.columns and kept.count()
        if stage is not language.keep_identified:  # which fills in a lang
            assert {str(r) for r in kept.collect()} <= rows
    assert all((r["__id"], r["__key"], r["__hot"], r["__own"], r["__text"], r.whole) == ("i", "k", True, "o", "t", "w") for f in (substrings.rewrite, language.keep_identified) for r in f(odd).collect())


@pytest.mark.parametrize("copies", [3, 1000])
def test_rows_repeated_whole_have_places_once(spark, copies):
    """What is sent for n copies of a row grows with n, whether its key is hot or not, and what it shares with others is found."""
    text = " ".join(f"r{i}" for i in range(1000))
    rows = [(1, text)] * copies + [(2, "a b c " + " ".join(f"r{i}" for i in range(300, 360)) + " d"), (3, "alone"), (4, "short twin"), (4, "short twin")]
    rows += [(10 + i, f"other {i} words") for i in range(5000 if copies == 3 else 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    places = substrings.repeated_windows(docs).select(F.aggregate(F.coalesce("places", F.array().cast("array<binary>")), F.lit(0), lambda n, p: n + F.length(p)).alias("b")).agg(F.max("b"), F.sum("b")).first()
    assert places[0] <= 2 * 4 * 1000 and places[1] <= 2 * 4 * 1000 * (copies if copies == 3 else 1) + 2000
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs).collect() if r.doc_id < 10)
    assert got == collections.Counter({(1, 1000, 1000, ""): copies, (2, 64, 60, "a b c d"): 1, (3, 1, 0, "alone"): 1, (4, 2, 0, "short twin"): 2})


def test_components_of_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    more = spark.createDataFrame([(100, 101), (101, 100), (7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges.unionAll(more)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def repeats(texts, n=35):
    seen, all_words = collections.Counter(), [words(t) for t in texts]
    for w in all_words:
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        yield len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_substrings(name, request):
    df = request.getfixturevalue(name)
    rows = df.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, repeats([r.text for r in rows]), strict=True)), key=str)
    got = substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert sum(x[2] for x in want) > 0


def test_substrings_within_one_document_and_at_every_shift(spark):
    for shift in range(0, 22, 3):
        filler = " ".join(f"f{i}" for i in range(shift))
        text = f"{filler} {PASSAGE} x {PASSAGE}"
        df = spark.createDataFrame([(1, text), (2, " ".join(f"u{i}" for i in range(100)))], "doc_id long, text string")
        got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(df).collect()}
        assert got == {1: 80, 2: 0}
    below = spark.createDataFrame([(1, "a " + " ".join(PASSAGE.split()[:34])), (2, "b " + " ".join(PASSAGE.split()[:34]))], "doc_id long, text string")
    assert substrings.remove_repeats(below).agg(F.sum("n_removed")).first()[0] == 0


def thue_morse(n):
    """Two words of ``n`` letters that polynomial hashes modulo a power of two confuse."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_windows_are_equal_only_if_their_words_are(spark):
    first, second = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{first} {rest}"), (2, f"{second} {rest}")], "doc_id long, text string")
    assert substrings.remove_repeats(df).agg(F.sum("n_removed")).first()[0] == 0
    # The same with two words in that order, in windows of 1024.
    one, other = (" ".join(w) for w in thue_morse(1024))
    long = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert substrings.remove_repeats(long, 1024).agg(F.sum("n_removed")).first()[0] == 0
    assert substrings.remove_repeats(long.unionAll(long), 1024).agg(F.sum("n_removed")).first()[0] == 4096


def test_large_inputs_are_dealt_into_more_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(common, "PART_BYTES", 1 << 14)
    want = [tuple(r) for r in substrings.remove_repeats(docs).orderBy("doc_id").collect()]
    assert spark.range(10).select(F.col("id").alias("k")).transform(lambda df: common.dealt(df, ["k"], 1 << 20)).rdd.getNumPartitions() == 64
    monkeypatch.undo()
    assert [tuple(r) for r in substrings.remove_repeats(docs).orderBy("doc_id").collect()] == want


def test_a_hot_key_is_met_where_its_rows_are(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.range(300).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id") % 5).cast("long").alias("k"), "id").unionAll(spark.createDataFrame([(None, 300), (99, 301)], "k long, id long"))
    table = rows.filter("k < 99").groupBy("k").agg(F.count("*").alias("copies")).withColumn("v", F.col("k") * 10)
    got = common.spread_join(rows, table, "k")
    assert sorted((r.id, r.v) for r in got.collect()) == [(i, 70 if i < 200 else i % 5 * 10) for i in range(300)] and got.columns == ["k", "id", "v"]
    kept = common.spread_join(rows, table, ["k"], how="left").filter("v is null").collect()
    assert sorted(r.id for r in kept) == [300, 301]


def test_columns_with_dots_and_inner_names_stay(spark):
    df = spark.createDataFrame([(i, f"{PASSAGE} tail {i} of its own", "s", i, "x") for i in range(4)], "doc_id long, text string, source string, `a.b` int, __own string")
    for f in (substrings.rewrite, mixing.resample, simhash.keep_one):
        got = f(df)
        assert got.columns == df.columns and all(r["a.b"] == r.doc_id and r["__own"] == "x" for r in got.collect()) and got.count() > 0


def test_every_cover_meets_every_difference():
    for v, d in substrings.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_rewriting_keeps_rows_and_columns(odd):
    new = substrings.rewrite(odd)
    assert new.columns == odd.columns and new.count() == odd.count()
    by = {r.doc_id: r for r in new.collect()}
    assert by[1].text == "tail one" and by[1].n_chars == 8 and by[4].text == "" and by[3].text is None and by[5].text == " \t\n "


def test_language(spark, odd, docs, nothing):
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)
    model = language.fit(docs)
    pred = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert all(pred[i].lang_pred == "und" and pred[i].score == 0 for i in (3, 4, 5, 11)) and pred[7].lang_pred != "und"
    kept = language.keep_identified(odd, model)
    sure = {r.doc_id for r in language.predict(odd, model).filter(F.col("score") >= language.LEAST_SCORE).collect()}
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id in sure)
    assert {1, 8, 9} <= sure and not sure & {3, 4, 5, 11}
    # By hand: cosines with prototypes from sums over the training rows, all in whole numbers.
    space, sums = language._Space.of(1024, 3), collections.defaultdict(lambda: np.zeros(1024))
    bundle = lambda t: space.bundles([(t or "").encode()])[1][0].astype(float)
    rows = docs.collect()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            sums[r.lang] += bundle(r.text)
    names = sorted(sums)
    unit = np.array([sums[x] / np.linalg.norm(sums[x]) for x in names])
    by = {r.doc_id: r for r in got}
    for r in rows[:60]:
        v = bundle(r.text)
        cosine = unit @ v / np.linalg.norm(v)
        assert by[r.doc_id].lang_pred == names[cosine.argmax()] and by[r.doc_id].score == pytest.approx(max(0, cosine.max()), abs=1e-5)
    unnamed = language.keep_identified(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), model).collect()
    named = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert all(r.lang == named[r.doc_id] for r in unnamed if r.doc_id % 2)
    noise = spark.createDataFrame([(1, "zzqx qqzj xjqz"), (2, docs.first().text)], "doc_id long, text string")
    assert [r.doc_id for r in language.keep_identified(noise, model).collect()] == [2]
    unlearned = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in language.keep_identified(unlearned).collect()} == {1, 2, None, 7, 8, 9, 10, -5}
    assert language.identify(nothing).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_vectors_are_bound_and_bundled():
    space = language._Space.of(64, 3)
    _, doc, packed = space.grams(["Ab c".encode()])
    a, b, c = map(ord, "abc")
    shapes = [(0, a, b), (a, b, 0), (b, 0, c), (0, c, 0)]
    low = [p[0] for p in space.placed]
    want = sum(low[0][x].astype(int) * low[1][y] * low[2][z] for x, y, z in shapes)
    assert (space.bundles([b"Ab c"])[1][0] == want).all() and len(packed) == 4 and set(doc) == {0}
    assert (low[0] == np.roll(low[2], 2, axis=1)).all()
    one = space.vectors(space.grams(["日".encode()])[2])
    assert (one[0] == low[0][0] * low[2][0] * low[1][ord("日") % 4096] * space.placed[1][1][ord("日") >> 12]).all()
    far = space.vectors(space.grams([chr(ord("日") + 4095).encode()])[2])  # of another letter, whatever the distance
    assert abs((one * far).sum()) < 64


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_mixing(name, request):
    df = request.getfixturevalue(name)
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    sizes = sorted((str(r.doc_id), len(words(r.text))) for r in df.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sizes
    assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in got)
    by = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        x = by[r.pattern[0]]
        x[0], x[1], x[2], x[3] = x[0] + r["size"], r.source_size, r.target, x[3] + r.taken
    assert all(x[0] == x[1] for x in by.values())
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    want = mixing.shared_targets({s: by[s][0] for s in order}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert all(abs(by[s][2] - want[s]) < 1e-6 for s in order)
    assert sum(want.values()) == pytest.approx(sum(x[0] for x in by.values()))
    if name == "docs":
        assert all(abs(x[3] - x[2]) <= max(r["size"] for r in got if r.pattern[0] == s) / 2 + 1 for s, x in by.items())
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_targets_reshare_what_is_above():
    got = mixing.shared_targets({"a": 10, "b": 100, "c": 100}, {"a": 5, "b": 2, "c": 1})
    assert got == {"a": 30.0, "b": 120.0, "c": 60.0}


def cheapest(patterns, targets):
    """The most words that can be sent and the least cost of sending as many, by trying every flow of whole words."""
    edges = [(p, s) for p in patterns for s in p]
    best = (0, 0)
    for amounts in itertools.product(*(range(3 * patterns[p] + 1) for p, _ in edges)):
        use, got = collections.Counter(), collections.Counter()
        for (p, s), n in zip(edges, amounts, strict=True):
            use[p] += n
            got[s] += n
        if all(use[p] <= 3 * n for p, n in patterns.items()) and all(got[s] <= round(t) for s, t in targets.items()):
            cost = sum(sum(c * min(n, max(0, use[p] - i * n)) for i, c in enumerate(mixing.COSTS)) for p, n in patterns.items())
            best = max(best, (sum(amounts), -cost))
    return best


@pytest.mark.parametrize("case", range(12))
def test_flow_is_the_cheapest_of_the_largest(case):
    rng = np.random.default_rng(case)
    sources = ["a", "b", None][: 2 + case % 2]
    kinds = [p for k in (1, 2, 3) for p in itertools.combinations(sources, k)]
    patterns = {kinds[i]: int(rng.integers(1, 3)) for i in rng.choice(len(kinds), 3, replace=False)}
    targets = {s: float(rng.integers(0, 6)) for s in sources if any(s in p for p in patterns)}
    sent = mixing.route(patterns, targets)
    use = {p: sum(sent[p].values()) for p in patterns}
    cost = sum(sum(c * min(n, max(0, use[p] - i * n)) for i, c in enumerate(mixing.COSTS)) for p, n in patterns.items())
    assert all(use[p] <= 3 * n for p, n in patterns.items()) and all(sum(v.get(s, 0) for v in sent.values()) <= t for s, t in targets.items())
    assert (sum(use.values()), -cost) == cheapest(patterns, targets)


def test_flow_over_many_patterns_ends_soon():
    rng = np.random.default_rng(0)
    patterns = {tuple(sorted(rng.choice(400, 3, replace=False).tolist())): int(rng.integers(1, 1000)) for _ in range(20_000)}
    share = 3 * sum(patterns.values()) / 400 / 2
    start = time.perf_counter()
    sent = mixing.route({tuple(f"s{i:03}" for i in p): n for p, n in patterns.items()}, {f"s{i:03}": share * (1 + i % 3 / 4) for i in range(400)})
    assert time.perf_counter() - start < 60 and sum(sum(v.values()) for v in sent.values()) > 0.95 * share * 400


def test_targets_are_those_of_the_contract_when_reckoned_exactly():
    rng = random.Random(3)
    for _ in range(50):
        sizes = {s: rng.randrange(1, 1000) for s in "abcde"[: rng.randrange(1, 6)]}
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
        capped, target = set(), {}
        while True:  # exact fractions, and everything is reckoned anew each time
            left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
            weight = sum(w for s, w in weights.items() if s not in capped)
            target = {s: Fraction(3 * sizes[s]) if s in capped else Fraction(left * weights[s], weight) for s in sizes}
            over = {s for s in sizes if target[s] > 3 * sizes[s]}
            if not over:
                break
            capped |= over
        got = mixing.shared_targets(sizes, weights)
        assert all(abs(got[s] - target[s]) < 1e-6 for s in sizes)


def test_flow_serves_overlapping_sources_with_few_repeats():
    sent = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 10})
    assert sum(v.get("a", 0) for v in sent.values()) == 20 and sum(v.get("b", 0) for v in sent.values()) == 10
    assert all(sum(v.values()) == 10 for v in sent.values())  # everything once, nothing twice


def test_mixing_of_documents_with_several_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a"] if i < 30 else ["a", "b"] if i < 60 else None) for i in range(90)], "doc_id long, text string, source array<string>")
    got = mixing.mix(df).collect()
    assert sum(r.taken for r in got) == pytest.approx(900, abs=30) and {tuple(r.pattern) for r in got} == {("a",), ("a", "b"), (None,)}


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_packing(name, request):
    df = request.getfixturevalue(name)
    pieces = packing.pack(df).collect()
    bpe = Bpe.of()
    want = collections.Counter((r.doc_id, tuple([*bpe.slow.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in df.select("doc_id", "text").collect())
    by_seq, parts = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        by_seq[p.sequence_id].append((p.offset, p.length))
        parts[p.doc_id, p.doc_tokens].append((p.start, p.length, ids))
    for seq in by_seq.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 1024
    for (doc, n), got in parts.items():
        same = [k for k in want.elements() if k[0] == doc and len(k[1]) == n]
        assert sum(x[1] for x in got) == n * len(same)
        assert all(any(list(k[1][start : start + length]) == ids for k in same) for start, length, ids in got)
    total = sum(p.length for p in pieces)
    assert total == sum(len(k[1]) for k in want.elements())
    if name == "docs":
        assert len(by_seq) * 1024 / total < 1.02


def test_ids_equal_the_tokenizer_on_awkward_text():
    bpe, rng = Bpe.of(), np.random.default_rng(0)
    texts = ["", " ", "'s", "don't  we'll\n\n x", "''s 'll'", "a\u0085b \u00a0 c", "日本 語's", "<|endoftext|>", "x" * 3000, "\x1c a\x1f"]
    texts += ["".join(rng.choice(list(" \n\t'aslmtdrev1!é "), 50)) for _ in range(500)]
    texts += [*thue_morse(2048), " ".join(thue_morse(2048))]
    assert [x.tolist() for x in bpe.encode(texts)] == [bpe.slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_are_those_of_the_file_as_given():
    from tokenizers import Tokenizer

    from assayloom.llm.bpe import default_path

    fresh = Tokenizer.from_file(default_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>é", "<|endoftext", "日<|endoftext|>", "plain text"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in Bpe.of().encode(texts)] == want and want[0] == [64, 220, 50256, 275]


def test_cutting_stock_covers_the_demand_closely():
    rng = np.random.default_rng(1)
    demand = {int(s): int(n) for s, n in zip(range(1, 31), rng.integers(1, 400, 30), strict=True)}
    plan = solve(demand, 64)
    for s, n in demand.items():
        assert sum(p.get(s, 0) * t for p, t in plan) == pytest.approx(n, rel=1e-6)
    assert all(sum(s * k for s, k in p.items()) <= 64 for p, _ in plan)
    assert sum(t for _, t in plan) <= 1.01 * sum(s * n for s, n in demand.items()) / 64
    whole, left = whole_patterns(demand, 64)
    assert {s: sum(p.get(s, 0) * t for p, t in whole) + left.get(s, 0) for s in demand} == demand
    assert solve({}, 64) == []


def test_severity_is_fitted_to_the_likelihood():
    """The fit's slopes against differences of the loss written out, and its predictions against the formula."""
    rng = np.random.default_rng(0)
    n, m, grades = 60, 5, 3
    x = rng.integers(0, 2, (n, m))
    grade = np.clip(x @ [1, 1, 0, -1, 0] + rng.integers(0, 2, n), 0, grades - 1)
    weight = rng.uniform(0.5, 2, n)
    model = toxicity._descend(x.sum(axis=1), np.nonzero(x)[1], grade, weight, grades, 3000, 0.02, 0.0)

    def loss(w, theta):
        reach = np.concatenate((np.ones((n, 1)), 1 / (1 + np.exp(-((x @ w)[:, None] - theta))), np.zeros((n, 1))), axis=1)
        p = reach[np.arange(n), grade] - reach[np.arange(n), grade + 1]
        return -(weight * np.log(p)).sum() / weight.sum()

    w, theta = model.weights[:m].copy(), model.thresholds.copy()
    assert (np.diff(theta) > 0).all() and not model.weights[m:].any()
    for vector in (w, theta):
        for i in range(len(vector)):
            for step in (1e-2, -1e-2):
                vector[i] += step
                assert loss(w, theta) >= loss(model.weights[:m], model.thresholds) - 1e-7
                vector[i] -= step
    strong = toxicity._descend(x.sum(axis=1), np.nonzero(x)[1], grade, weight, grades, 500, 0.05, 2.0)
    assert (strong.weights != 0).sum() < (model.weights != 0).sum()


def test_a_long_sample_is_cut_in_bytes(spark):
    rows = [(i, "calm words here " * 50 + ("grim vile" if i % 2 else "")) for i in range(400)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, grade int")
    for most in (1 << 30, 60_000):
        got = toxicity.predict(df, toxicity.fit(df, lab, most_bytes=most)).collect()
        assert np.mean([r.toxic == bool(r.doc_id % 2) for r in got]) > 0.95
    repeated = df.unionAll(df).withColumn("grade", F.lit("z"))  # rows that repeat, and a column named like one inside
    assert toxicity.rate(repeated, lab.withColumnRenamed("grade", "toxic").unionAll(spark.createDataFrame([(None, 1), (7, None), (8, -1)], "doc_id long, grade int"))).count() == 800


def test_toxicity(spark, odd, nothing):
    bad = ["grim", "vile", "foul"]
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(400):
        text = [f"n{k}" for k in rng.integers(0, 300, 40)]
        if toxic := i % 4 == 0:
            text += [bad[k] for k in rng.integers(0, 3, 1 + i % 3)]
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.rate(df, lab).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].toxic == (i % 4 == 0) for i in held) / len(held) > 0.95
    model = toxicity.fit(df, toxicity.grades_of(lab))
    assert (np.diff(model.thresholds) > 0).all()
    mean = lambda m: np.mean([got[i].severity for i in range(0, 400, 4) if i % 3 == m])
    assert mean(2) > mean(0) and all(0 <= r.severity <= len(model.thresholds) for r in got.values())
    assert toxicity.predict(odd, model).count() == odd.count() and toxicity.predict(nothing, model).count() == 0
    assert not any(r.toxic for r in toxicity.rate(odd, lab.filter("false")).collect())


def test_empty_tables(nothing):
    for f in (simhash.near_duplicates, substrings.remove_repeats, substrings.rewrite, mixing.mix, mixing.resample, packing.pack, simhash.keep_one):
        assert f(nothing).count() == 0, f.__name__


def test_pipeline(spark, docs, tmp_path):
    frame, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, SF).write.parquet(str(tmp_path / name))
        frame = steps[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "pack" or frame.columns == docs.columns
    assert steps["language_id"].count() >= 0.99 * docs.count()
    assert steps["near_dedup"].count() == simhash.near_duplicates(steps["language_id"]).filter("doc_id = component_id").count()
    assert steps["substring_dedup"].count() == steps["near_dedup"].count()
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(steps["substring_dedup"]).collect() if r.taken}
    assert dict(collections.Counter(r.doc_id for r in steps["mix"].collect())) == taken
    assert {r.doc_id for r in frame.collect()} == set(taken)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in frame.collect())
    assert [tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("doc_id", "start", "sequence_id").collect()] == [tuple(r) for r in frame.orderBy("doc_id", "start", "sequence_id").collect()]


def test_pipeline_on_odd_rows_and_on_none(spark, odd, nothing):
    for df in (odd.withColumn("a.b", F.lit(1)), nothing, odd.withColumn("lang", F.lit(None).cast("string"))):
        frame, counts = df, []
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF)
            assert name == "pack" or frame.columns == df.columns
            counts.append(frame.count())
        assert counts == [0] * 5 if df is nothing else all(counts)
    packed = collections.Counter()
    for r in frame.collect():
        packed[r.doc_id] += r.length
    assert not set(packed) & {3, 4, 5, 11} and 9 not in packed  # nothing in them, and a copy of 8


def test_a_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Far:
        """A session on a cluster that names no folder."""

        conf = type("", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("", (), {"master": "spark://host:7077", "getConf": lambda self: Far.conf, "_jsc": type("", (), {"sc": lambda self: type("", (), {"getCheckpointDir": lambda self: type("", (), {"isEmpty": lambda self: True})()})()})()})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.work_dir(Far)
