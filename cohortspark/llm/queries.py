"""The contract queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lexical, licenses, lmscore, mixing, neardup, quality, runs, secrets, suffix, urlfilter, warc
from .common import fold_of, table


#: Target weights of the sources of ``documents``.
MIX_WEIGHTS = {"src0": 3, **{f"src{i}": 2 for i in range(1, 5)}, **{f"src{i}": 1 for i in range(5, 20)}}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), MIX_WEIGHTS)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, items).drop("part").distinct()


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.document_statistics(table(spark, sf_dir, "documents"))
    return quality.judge(stats, quality.fit(stats, table(spark, sf_dir, "labels")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold_of(F.col("doc_id")) == 0)
    profiles = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, profiles, ("doc_id", "held_out"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.registry(spark))


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    place = warc.write(pages)
    return warc.lookup(spark, place, pages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A dated list for the hosts of ``pages``: (rule, verdict, op, days after the first of 2024).
URL_LIST = (
    ("d:spam-farm.example.org", "block", "add", -200), ("d:spam-farm.example.org", "block", "remove", 90), ("d:spam-farm.example.org", "block", "add", 180),
    ("d:adult-x.example.net", "block", "add", -30), ("d:adult-x.example.net", "block", "remove", 250), ("d:example.com", "block", "add", 100), ("d:example.com", "block", "remove", 130),
    ("d:tionsh.example.com", "allow", "add", 110), ("p:blog.tionsh.example.com/en/", "block", "add", 60), ("p:blog.tionsh.example.com/en/", "block", "remove", 200), ("p:blog.tionsh.example.com/fr/", "block", "add", 120),
    ("d:tionble.example.org", "block", "add", 10), ("d:tionble.example.org", "block", "add", 40), ("d:tionble.example.org", "block", "remove", 300), ("d:m.ththth.example.net", "allow", "add", 0),
    ("d:ththth.example.net", "block", "add", 30), ("d:example.net", "block", "add", 340), ("p:www.ththon.example.org/de/", "block", "add", 200), ("d:ththon.example.org", "allow", "add", 0), ("d:ththon.example.org", "allow", "remove", 220),
    ("d:blog.tionsh.example.net", "block", "add", -20), ("d:blog.tionsh.example.net", "allow", "add", 120), ("d:blog.tionsh.example.net", "block", "remove", 150), ("d:blog.tionsh.example.net", "block", "add", 240),
)
FIRST_DAY = 1_704_067_200


def url_list(pages: DataFrame) -> DataFrame:
    """``URL_LIST``, and for every host of the pages a history of 20 to 49 entries whose dates, verdicts and kinds follow from its first page."""
    listed = pages.sparkSession.createDataFrame([(i, rule, verdict, op, FIRST_DAY + 86_400 * day) for i, (rule, verdict, op, day) in enumerate(URL_LIST)], "entry_id long, rule string, verdict string, op string, ts long")
    hosts = pages.select(urlfilter.host(F.col("url")).alias("h"), "page_id").where("h <> ''").groupBy("h").agg(F.min("page_id").alias("k"))
    made = hosts.withColumn("j", F.explode(F.expr("sequence(0L, 19 + k % 30)"))).selectExpr(
        "1000 * (k + 1) + j AS entry_id", "CASE WHEN j % 4 = 3 THEN concat('p:', h, '/en/') ELSE concat('d:', h) END AS rule", "CASE WHEN (k + j * j) % 5 < 3 THEN 'block' ELSE 'allow' END AS verdict",
        "CASE WHEN (k + j) % 3 = 2 THEN 'remove' ELSE 'add' END AS op", f"{FIRST_DAY} + (k * 7919 + j * 432000) % 31536000 AS ts")
    return listed.unionByName(made)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` has no fetch time: page n counts as fetched 7919 * n seconds (modulo a year) into 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") * 7919 % 31_536_000 + FIRST_DAY).alias("fetched"))
    return urlfilter.evaluate(pages, url_list(pages))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document, by its id's crc32, is given a repeating tail first."""
    return runs.periodic_runs(table(spark, sf_dir, "documents"), change=runs.planted)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op1_sql() -> str:
    weights = ", ".join(f"({_q(s)}, {w})" for s, w in MIX_WEIGHTS.items())
    return f"""
WITH RECURSIVE weights(s, w) AS (VALUES {weights}, ('*', 1)),
d AS (SELECT doc_id, source, coalesce(k.s, '*') AS s, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
      FROM documents LEFT JOIN weights k ON k.s = source AND source <> '*'),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o, doc_id) - 1 AS rk FROM d),
n AS (SELECT s, any_value(w) AS w, CAST(ceil(count(*) / {mixing.BLOCK_ROWS}) AS BIGINT) AS nb, row_number() OVER (ORDER BY s) AS k FROM d JOIN weights USING (s) GROUP BY s),
blocks AS (SELECT s, k, w, unnest(range(nb)) AS i FROM n),
jobs AS (SELECT b.s, b.k, b.i, CAST(floor(sum(least(n.nb * b.w, n.w * b.i)) / b.w) AS BIGINT) AS rel,
                CAST(ceil(sum(least(n.nb * b.w, n.w * (b.i + 1))) / b.w) AS BIGINT) AS due
         FROM blocks b, n GROUP BY b.s, b.k, b.i, b.w),
sched(t, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), (SELECT list(CAST(0 AS BIGINT)) FROM n), CAST(0 AS BIGINT)
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, j: x + CAST(j = p AS BIGINT)), p
  FROM (SELECT t, done, arg_min(j.k, due * 1000000 + j.k) AS p FROM sched JOIN jobs j ON j.i = done[j.k] AND j.rel <= t + 1 GROUP BY t, done)),
slots AS (SELECT pick AS k, done[pick] - 1 AS i, t AS slot FROM sched WHERE t >= 0)
SELECT doc_id, source, CAST(rk // {mixing.BLOCK_ROWS} AS BIGINT) AS mix_block, slot AS mix_slot, CAST(rk % {mixing.BLOCK_ROWS} AS INTEGER) AS mix_rank,
       CAST(slot * {mixing.BLOCK_ROWS} + rk % {mixing.BLOCK_ROWS} AS BIGINT) AS mix_position
FROM r JOIN n USING (s) JOIN slots ON slots.k = n.k AND slots.i = rk // {mixing.BLOCK_ROWS}"""


def _canonical_sql(text: str) -> str:
    t = f"trim(regexp_replace(regexp_replace(lower({text}), {_q(licenses.COPYRIGHT_LINE)}, chr(10), 'g'), {_q(licenses.NOT_WORDS)}, ' ', 'g'))"
    padded = f"(' ' || {t} || ' ')"
    for old, new in licenses.EQUIVALENT:
        padded = f"replace(replace({padded}, ' {old} ', ' {new} '), ' {old} ', ' {new} ')"
    return f"trim({padded})"


def _op6_sql() -> str:
    known = ", ".join(f"({_q(k)}, {_q(v)})" for k, v in sorted(licenses.REGISTRY.items()))
    return f"""
WITH known(license_id, body) AS (VALUES {known}),
k AS (SELECT sha256({_canonical_sql("body")}) AS digest, min(license_id) AS license_id FROM known GROUP BY 1),
d AS (SELECT doc_id, {_canonical_sql("text")} AS form FROM documents)
SELECT doc_id, CAST(length(form) AS BIGINT) AS n_canonical, sha256(form) AS digest, license_id FROM d LEFT JOIN k ON k.digest = sha256(form)"""


def _op7_sql() -> str:
    nibbles = "['" + "', '".join(f"{i:04b}" for i in range(16)) + "']"
    bits = f"array_to_string(list_transform(range(1, 41), lambda i: {nibbles}[1 + instr('0123456789abcdef', x[i]) - 1]), '')"
    value = " + ".join(f"{2 ** (4 - k)} * CAST(b[5 * i + {k + 1}] AS INTEGER)" for k in range(5))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS x FROM pages),
q AS (SELECT *, {bits} AS b FROM p),
d AS (SELECT page_id, body, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + {value}]), '') AS payload_digest FROM q),
m AS (SELECT payload_digest, max(page_id) AS top FROM d GROUP BY payload_digest)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d JOIN m USING (payload_digest)"""


def _op9_sql() -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= {neardup.PERCENT} * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, x.b FROM r JOIN both_ways x ON x.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)"""


def _op8_sql() -> str:
    entries = ", ".join(f"({i}, {_q(rule)}, {_q(verdict)}, {_q(op)}, {FIRST_DAY + 86_400 * day})" for i, (rule, verdict, op, day) in enumerate(URL_LIST))
    return rf"""
WITH hosts AS (SELECT regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '') AS h, min(page_id) AS k FROM pages GROUP BY 1),
made AS (SELECT h, k, unnest(range(20 + k % 30)) AS j FROM hosts WHERE h <> ''),
log(entry_id, rule, verdict, op, ts) AS (SELECT * FROM (VALUES {entries}) UNION ALL
  SELECT 1000 * (k + 1) + j, CASE WHEN j % 4 = 3 THEN 'p:' || h || '/en/' ELSE 'd:' || h END, CASE WHEN (k + j * j) % 5 < 3 THEN 'block' ELSE 'allow' END, CASE WHEN (k + j) % 3 = 2 THEN 'remove' ELSE 'add' END, {FIRST_DAY} + (k * 7919 + j * 432000) % 31536000 FROM made),
dated AS (SELECT a.*, (SELECT min(b.ts) FROM log b WHERE b.rule = a.rule AND (b.ts, b.entry_id) > (a.ts, a.entry_id) AND (b.op = 'add' OR b.verdict = a.verdict)) AS until FROM log a),
live AS (SELECT * FROM dated WHERE op = 'add' AND (until IS NULL OR until > ts)),
p AS (SELECT page_id, url, page_id * 7919 % 31536000 + {FIRST_DAY} AS fetched,
             regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '') AS h,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
met AS (SELECT page_id, l.rule, l.entry_id, l.verdict FROM p JOIN live l ON fetched >= ts AND (until IS NULL OR fetched < until) AND h <> '' AND (
          (starts_with(rule, 'd:') AND (h = rule[3:] OR ends_with(h, '.' || rule[3:])))
          OR (starts_with(rule, 'p:') AND starts_with(h || path, rule[3:]) AND (ends_with(rule, '/') OR h || path = rule[3:])))),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule DESC, verdict DESC, entry_id DESC) AS k FROM met)
SELECT p.page_id, url, fetched, rule, CAST(entry_id AS BIGINT) AS entry_id, coalesce(verdict = 'block', false) AS blocked FROM p LEFT JOIN best ON best.page_id = p.page_id AND k = 1"""


def _op10_sql() -> str:
    def found(pattern: str, kind: int, keep: str, value: str = "m") -> str:
        return f"""
  SELECT doc_id, source, {kind} AS k, g + before AS s, g + before + length(m) AS e, {value} AS v FROM (
    SELECT doc_id, source, hits[i] AS m, coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS before, list_sum(list_transform(gaps[1:i], lambda x: length(x))) AS g
    FROM (SELECT doc_id, source, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
          FROM (SELECT doc_id, source, regexp_extract_all(text, {_q(pattern)}) AS hits, string_split_regex(text, {_q(pattern)}) AS gaps FROM documents))) WHERE {keep}"""

    shaped = f"regexp_matches(m, '[0-9]') AND (regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') OR regexp_matches(m, {_q(secrets.ISSUED)})) AND 2 * length(regexp_replace(m, {_q(secrets.WORD_LIKE)}, '', 'g')) >= length(m)"
    names = "list_value(" + ", ".join(map(_q, secrets.KINDS)) + ")"
    text = f"{names}[k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""
WITH base AS ({found(secrets.ASSIGN, 0, f"length(v) >= {secrets.ASSIGN_LEAST}", f"regexp_extract(m, {_q(secrets.ASSIGN)}, 2)")}
  UNION ALL {found(secrets.ACCESS, 1, "true")} UNION ALL {found(secrets.HEX, 2, "true")}),
broad AS ({found(secrets.BROAD, 3, shaped)}),
extra AS (SELECT * FROM broad x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.e AND x.s < b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
wide AS (SELECT v FROM every GROUP BY v HAVING count(DISTINCT source) > {secrets.EXAMPLE_OWNERS}),
kept AS (SELECT * FROM every WHERE k < 3 OR v NOT IN (SELECT v FROM wide)),
b AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg({text}, ',' ORDER BY s, k) AS base FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg({text}, ',' ORDER BY s, k) AS spans, count(*) FILTER (v IN (SELECT v FROM wide)) AS n_example FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id"""


def _op11_sql() -> str:
    w = suffix.LEAST
    return f"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
e AS (SELECT doc_id, unnest(range(CAST(length(x) // 2 - {w - 1} AS BIGINT))) AS i, x FROM d WHERE length(x) >= {2 * w}),
k AS (SELECT doc_id, i, md5_number(substring(x, 2 * i + 1, {2 * w})) AS h FROM e),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM k) WHERE c > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + {w} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS part
      FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1 - {w}) AS before FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + {w} AS b FROM g GROUP BY doc_id, part),
o AS (SELECT doc_id, b AS lo, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS hi FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(substring(x, 2 * lo + 1, 2 * (coalesce(hi, length(x) // 2) - lo)), '' ORDER BY lo) AS x FROM o JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest.x, d.x))) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN rest ON rest.doc_id = d.doc_id"""


def _op12_sql() -> str:
    terms = lambda text: rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT doc_id, {terms("text")} AS w FROM documents),
docs AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM docs),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, nd),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms("text")}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l)))) AS BIGINT) AS score
           FROM q JOIN df USING (term) JOIN tf USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""


def _op13_sql() -> str:
    least, periods = runs.LEAST_LENGTH, runs.LEAST_PERIODS
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w, coalesce(CAST(doc_id AS VARCHAR), '') AS t FROM documents),
h AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(8 * length(t)), lambda i: CAST((ascii(t[i // 8 + 1]) >> (i % 8)) & 1 AS BIGINT))),
        lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END), CAST(4294967295 AS BIGINT)) AS h FROM d),
a AS (SELECT doc_id, w, n, h, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM h),
p AS (SELECT doc_id, w, n, a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
v AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) AS w FROM p),
t AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM v),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND {periods} * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs) GROUP BY doc_id, q, g),
r AS (SELECT doc_id, s, len, min(q) AS q FROM islands WHERE len >= greatest({least}, {periods} * q) GROUP BY doc_id, s, len),
every AS (SELECT doc_id, count(*) AS n_runs, arg_min((s, len, q), (-len, s, q)) AS top, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY doc_id),
stay AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS c FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND r.s + r.q <= t.i AND t.i < r.s + r.len) GROUP BY doc_id)
SELECT v.doc_id, n AS n_words, coalesce(n_runs, 0) AS n_runs, CAST(top[1] AS BIGINT) AS start, CAST(top[2] AS BIGINT) AS length, CAST(top[3] AS BIGINT) AS period, CAST(1000 * top[2] // top[3] AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM v LEFT JOIN every ON every.doc_id = v.doc_id LEFT JOIN stay ON stay.doc_id = v.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mixing": _op1_sql(), "op6_license_scan": _op6_sql(), "op7_warc_index": _op7_sql(), "op8_url_filter": _op8_sql(), "op9_minhash_near_dedup": _op9_sql(), "op10_secret_scan": _op10_sql(),
        "op11_suffix_dedup": _op11_sql(), "op12_lexical_search": _op12_sql(), "op13_periodic_runs": _op13_sql(),
    }
