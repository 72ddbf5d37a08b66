"""The queries of this subpackage: thin digests of the operators' results, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm import collocations, contamination, language, merkle, mixing, neardup_graph, packing, simhash, substrings, topk, toxicity, urls, warc
from assayloom.llm.common import work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup_graph.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:x-page:(-?[0-9]+)>$', 1) as bigint)")
    full = warc.read_archive(spark, path).filter("record_type = 'response'")
    full = full.select(page("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = warc.read_archive(spark, path, payload=False).filter("record_type = 'revisit'")
    return full.unionAll(again.select(page("record_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", ""), "record_type", page("refers_to")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(_table(spark, sf_dir, "documents"), {"text": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embeddings, op2_mixing, op3_topk, op4_simhash, op5_toxicity, op6_substrings, op7_language, op8_packing, op9_urls, op10_warc, op11_merkle, op12_decontamination, op13_collocations)}


def _op9_sql(rounds: int = urls.rounds_for()) -> str:
    """The rules as one CASE, and the rounds of both walks as two tables each: what hosts without links held, and all masses."""
    ordered = sorted(urls.RULES, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{what(r)}'" for r in ordered) + " END"
    low = lambda x: f"translate({x}, '{urls.UPPER}', '{urls.LOW}')"
    link = urls.LINK.replace("'", "''")
    share = lambda mass, times, parts: f"greatest({mass} // ({parts}) * ({times}) + {mass} % ({parts}) * ({times}) // ({parts}), 1)"
    steps = [f"""g{k} AS MATERIALIZED (SELECT side, sum(mass)::HUGEINT AS stuck FROM h{k - 1} h WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.side = h.side AND e.src = h.host) GROUP BY side),
h{k} AS MATERIALIZED (SELECT side, host, sum(mass)::HUGEINT AS mass FROM (SELECT side, host, {share("seed", f"{100 - urls.DAMPING}::HUGEINT", "100::HUGEINT")} AS mass FROM seeds UNION ALL SELECT side, host, {share("stuck", f"n * {urls.DAMPING}", "total * 100")} FROM seeds JOIN g{k} USING (side)
UNION ALL SELECT e.side, e.dst, {share("mass", f"w * {urls.DAMPING}", "total * 100")} FROM edges e JOIN h{k - 1} h ON h.side = e.side AND h.host = e.src) GROUP BY ALL)""" for k in range(1, rounds + 1)]
    return f"""WITH u AS (SELECT page_id, html, {low("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT page_id, host, path, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS ruled FROM u),
seeds AS MATERIALIZED (SELECT side, host, n, sum(n) OVER (PARTITION BY side)::HUGEINT AS total, n * {urls.UNIT}::HUGEINT AS seed FROM (SELECT ruled AS side, host, count(*)::HUGEINT AS n FROM r WHERE ruled IS NOT NULL AND host <> '' GROUP BY ALL)),
l AS (SELECT DISTINCT page_id, host AS src, unnest(regexp_extract_all({low("html")}, '{link}', 1)) AS dst FROM u), p AS (SELECT src, dst, count(*)::HUGEINT AS w FROM l WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
b AS (SELECT 'allow' AS side, src, dst, w FROM p UNION ALL SELECT 'block', dst, src, w FROM p), edges AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY side, src)::HUGEINT AS total FROM b),
h0 AS MATERIALIZED (SELECT side, host, seed AS mass FROM seeds), {", ".join(steps)},
s AS (SELECT host, coalesce(sum(mass) FILTER (side = 'allow'), 0) AS t, coalesce(sum(mass) FILTER (side = 'block'), 0) AS d FROM h{rounds} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN t + d > 0 AND 2 * (t - d) < -(t + d) THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN s USING (host)"""


OP1_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id WHERE c.root < l.b),
m AS (SELECT id, min(root) AS root FROM c GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id"""

OP3_SQL = """WITH q AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)), 0) = 0),
s AS (SELECT a.uid, a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_inner_product(a.v, b.v), 0) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.uid <> b.uid)
SELECT query_id, CAST(k AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 20"""

OP6_SQL = r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents), s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM d),
g AS (SELECT s.doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s JOIN d USING (doc_id)), r AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r), p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
k AS (SELECT p.doc_id, count(*) FILTER (x.j IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY p.j) FILTER (x.j IS NULL) AS kept FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.j = p.j GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP10_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to FROM q"""


LOWERED = f"translate({{}}, '{urls.UPPER}', '{urls.LOW}')"

_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"


def _op11_sql(levels: int = 14, sources: int = 6) -> str:
    """One table a level: leaves under sources, then sources under the root; paths and folds follow them up."""
    value = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(value(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    even = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, tab[xor(c, b) & 255 + 1])), 4294967295) % 2 = 0".replace("& 255 + 1", "& 255) + 1").replace("tab[xor(c, b)", "tab[(xor(c, b)")
    up = lambda t, k: f"{t}{k} AS (SELECT sid, p // 3 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h, max((n + 2) // 3) AS n FROM {t}{k - 1} WHERE n > 1 GROUP BY sid, p // 3)"
    beside = lambda t, k: f"{t}x{k} AS (SELECT a.sid, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r FROM {t}{k} a JOIN {t}{k} b ON a.sid = b.sid AND a.p // 3 = b.p // 3 WHERE a.n > 1 GROUP BY a.sid, a.p)"
    step = lambda c, t, k: f"{c}{k + 1} AS (SELECT c.uid, c.sid, c.p // 3 AS p, c.proof || coalesce(l || r, '') AS proof, CASE WHEN x.p IS NULL THEN c.f ELSE sha256(l || c.f || r) END AS f FROM {c}{k} c LEFT JOIN {t}x{k} x ON x.sid = c.sid AND x.p = c.p)"
    tables = [
        f"tab AS (SELECT {_CRC_TABLE} AS tab)",
        f"d AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN {even} THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS claim FROM documents, tab)",
        "l AS (SELECT row_number() OVER () AS uid, doc_id, leaf, claim, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM d)",
        "t0 AS (SELECT sid, p, leaf AS h, n FROM l)", *(up("t", k) for k in range(1, levels + 1)),
        "roots AS (" + " UNION ALL ".join(f"SELECT sid, h FROM t{k} WHERE n = 1" for k in range(levels + 1)) + ")",
        "s0 AS (SELECT 0 AS sid, sid AS p, h, count(*) OVER () AS n FROM roots)", *(up("s", k) for k in range(1, sources + 1)),
        "top AS (" + " UNION ALL ".join(f"SELECT h FROM s{k} WHERE n = 1" for k in range(sources + 1)) + ")",
        *(beside("t", k) for k in range(levels)), *(beside("s", k) for k in range(sources)),
        "c0 AS (SELECT uid, sid, p, '' AS proof, claim AS f FROM l)", *(step("c", "t", k) for k in range(levels)),
        f"e0 AS (SELECT uid, 0 AS sid, sid AS p, proof, f FROM c{levels})", *(step("e", "s", k) for k in range(sources)),
    ]
    return f"WITH {', '.join(tables)} SELECT l.doc_id, l.leaf, roots.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = top.h AS verified FROM l JOIN roots USING (sid) JOIN e{sources} e ON e.uid = l.uid, top"


OP12_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(regexp_extract_all({LOWERED.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({LOWERED.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT *, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT uid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM g)), o AS (SELECT uid, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM p),
h AS (SELECT uid, i, o.m, item_id FROM o JOIN g ON g.m = o.m AND g.g = o.g), c AS (SELECT uid, count(DISTINCT j) AS n FROM (SELECT uid, unnest(range(i, i + m)) AS j FROM h) GROUP BY 1),
k AS (SELECT uid, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT uid, item_id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(k.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, c.n IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (uid) LEFT JOIN k USING (uid)"""

OP13_SQL = rf"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1), x AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) r(k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM x GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS v, unnest(range(1, k)) AS j FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, c.a, l.a AS l, r.a AS r, n, 1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a) AS score, j FROM c JOIN n ON n.lang = c.lang JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(v[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(v[j + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
y AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.k > b.k AND 100 * f.a >= 100 * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """Fingerprints (XXH64), seeded choices, learned models and token ids have no SQL."""
    return {"op1_embeddings": OP1_SQL, "op3_topk": OP3_SQL, "op6_substrings": OP6_SQL, "op9_urls": _op9_sql(), "op10_warc": OP10_SQL, "op11_merkle": _op11_sql(), "op12_decontamination": OP12_SQL, "op13_collocations": OP13_SQL}
