"""The registered queries of the corpus operators, with production parameters, and their SQL.

Queries that return short digests of long rows hand them out in few partitions (``common.compact``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import exact, html, minhash, mixing, packing, phrases, quality, resampling, secrets, simhash, suffix, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return c.compact(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return c.compact(packing.pack(_table(spark, sf_dir, "documents")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in every document: place, redacted text and the forest's probability."""
    found = secrets.scan(_table(spark, sf_dir, "documents")).where("is_secret")
    return found.select("doc_id", "start", "length", "redacted", F.sha2(F.col("token").cast("binary"), 256).alias("token_sha256"), F.round("probability", 6).alias("probability"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document loses to passages of 200 bytes that repeat."""
    found = suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    return c.compact(found.select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_pages(_table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the training position of each of its copies (null if not used), in training order."""
    x = mixing.mix(_table(spark, sf_dir, "documents"))
    places = [F.get("positions", k).alias(f"position_{k + 1}") for k in range(mixing.MAX_REPEATS)]
    x = x.select("_row.doc_id", "size", "source_size", "target", "taken", *places, "order")
    x = x.orderBy(F.col("position_1").asc_nulls_last(), "order", "doc_id")
    return c.compact(x.drop("order").withColumns({f"position_{k + 1}": F.round(f"position_{k + 1}", 9) for k in range(mixing.MAX_REPEATS)}), short=False)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    rules = [(True, *r) for r in urls.RULES] + [(False, "block", s, "") for s in urls.SITES]
    listed = urls.listing(spark.createDataFrame(rules, "first boolean, verdict string, host string, path string"))
    return c.compact(urls.judge(_table(spark, sf_dir, "pages"), listed).select("page_id", "host", "path", "rule", "verdict"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    found = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return c.compact(found.select("_row.doc_id", toxicity.held_out(F.col("_row.doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")))


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document, and which one stays."""
    return c.compact(exact.groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface counts and verdict of every document."""
    found = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return c.compact(found.select("_row.doc_id", *quality.COUNTS, "base_failed", "kept"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations of two or three words."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark's texts, and the rank of the tenth that is drawn."""
    return c.compact(resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document by the similarity of its sets of three words."""
    return c.compact(minhash.near_groups(_table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_packing, op3_secrets, op4_suffix, op5_html, op6_mixing, op7_urls, op8_toxicity, op9_exact, op10_quality, op11_phrases, op12_resampling, op13_minhash)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _position(start: str) -> str:
    """The training position of the copy that begins at `start`, by the closed forms of the three schedules: steady, rising (0.5 to 1.5), falling (1.5 to 0.5)."""
    u, used = f"({start} / target)", f"(least(size, floor(target) - {start}) > 0 OR size = 0 AND {start} < target)"
    up = f"CASE WHEN {u} <= 0.375 THEN (sqrt(0.25 + {u} * 2) - 0.5) ELSE 0.5 + (sqrt(1.0 + ({u} - 0.375) * 2) - 1.0) END"
    down = f"CASE WHEN {u} <= 0.625 THEN (1.5 - sqrt(2.25 - {u} * 2)) ELSE 0.5 + (1.0 - sqrt(1.0 - ({u} - 0.625) * 2)) END"
    return f"CASE WHEN {used} THEN round(CASE place % 3 WHEN 0 THEN {u} WHEN 1 THEN {up} ELSE {down} END, 9) END"


_OP6 = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, {c.ORDER_KEY_SQL.format("doc_id")} AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS n,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT *, coalesce(least(cap, weight * arg_min(level, n) FILTER (WHERE level < cap / weight) OVER ()), cap) AS target FROM l
), b AS (
  SELECT d.*, place, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)))::BIGINT AS taken,
  {_position("start")} AS position_1, {_position("(start + source_size)")} AS position_2
FROM b
"""

_OP7 = f"""
WITH p AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(verdict, host, path) AS (VALUES {", ".join(str(r) for r in urls.RULES)}),
s(host) AS (VALUES {", ".join(f"('{x}')" for x in urls.SITES)})
SELECT page_id, p.host, p.path,
  arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
  coalesce(arg_max(r.verdict, length(r.host || r.path)), CASE WHEN bool_or(s.host IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM p
LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
LEFT JOIN s ON p.host = s.host OR ends_with(p.host, '.' || s.host)
GROUP BY n, page_id, p.host, p.path
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW best AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""

_OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT n, {_WORDS} AS words FROM d)),
g AS (SELECT n, i, word, count(word) OVER five AS many, string_agg(word, ' ') OVER five AS gram FROM w WINDOW five AS (PARTITION BY n ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
t AS (SELECT n, i, many = 5 AND count(*) OVER (PARTITION BY n, gram, many) > 1 AS twice FROM g),
r AS (SELECT n, i, max(twice::INT) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rep FROM t),
words AS (SELECT w.n, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, sum(rep)::BIGINT AS n_repeat_words FROM w JOIN r USING (n, i) GROUP BY w.n),
lines AS (SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n),
p AS (SELECT n, unicode(unnest(chars)) AS p, generate_subscripts(chars, 1) AS i FROM (SELECT n, regexp_extract_all(text, '(?s).') AS chars FROM d)),
gram AS (SELECT n, (p * {quality.GRAM[0]} + lead(p, 1) OVER o * {quality.GRAM[1]} + lead(p, 2) OVER o * {quality.GRAM[2]} + lead(p, 3) OVER o) % {quality.BUCKETS} AS bucket FROM p WINDOW o AS (PARTITION BY n ORDER BY i)),
good AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) ORDER BY {c.ORDER_KEY_SQL.format("doc_id")}, doc_id LIMIT {quality.MAX_TARGET_DOCS}),
counts AS (SELECT bucket, count(*) AS raw, count(good.doc_id) AS target FROM gram JOIN d USING (n) LEFT JOIN good USING (doc_id) WHERE bucket IS NOT NULL GROUP BY bucket),
ratio AS (SELECT bucket, round({quality.UNIT} * (ln((target + 1.0::DOUBLE) / (sum(target) OVER () + {quality.BUCKETS}::DOUBLE)) - ln((raw + 1.0::DOUBLE) / (sum(raw) OVER () + {quality.BUCKETS}::DOUBLE))))::BIGINT AS u FROM counts),
score AS (SELECT n, sum(u) AS u, count(*) AS grams FROM gram JOIN ratio USING (bucket) GROUP BY n),
x AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(u, 0) AS u, coalesce(grams, 0) AS grams
  FROM d LEFT JOIN words USING (n) LEFT JOIN lines USING (n) LEFT JOIN score USING (n))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND u >= {round(quality.THRESHOLD * quality.UNIT)} * grams AS kept
FROM x
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, {_LOWERED} AS text FROM documents),
p AS (SELECT doc, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p FROM (SELECT doc, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS pieces FROM d)),
w AS (SELECT doc, lang, p, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM (SELECT doc, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p)),
g AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc, p ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {phrases.MIN_COUNT}),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {phrases.MIN_COUNT}),
over AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT x.lang, x.w1 || ' ' || x.w2 AS phrase, x.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 x JOIN f1 l ON (x.lang, x.w1) = (l.lang, l.w1) JOIN f1 r ON (x.lang, x.w2) = (r.lang, r.w1)
  LEFT JOIN over o ON (x.lang, x.w1, x.w2) = (o.lang, o.w1, o.w2) WHERE o.most IS NULL OR 100 * o.most < {phrases.ABSORB} * x.f
  UNION ALL
  SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 1, l.f, r.f
  FROM f3 x JOIN f1 l ON (x.lang, x.w1) = (l.lang, l.w1) JOIN f2 r ON (x.lang, x.w2, x.w3) = (r.lang, r.w1, r.w2)
  UNION ALL
  SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 2, l.f, r.f
  FROM f3 x JOIN f2 l ON (x.lang, x.w1, x.w2) = (l.lang, l.w1, l.w2) JOIN f1 r ON (x.lang, x.w3) = (r.lang, r.w1)
),
s AS (SELECT *, (({phrases.UNIT}::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= {phrases.TOP}
"""

_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
target AS (SELECT unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
w AS (SELECT row, unnest(words) AS word FROM d),
bytes AS (SELECT range AS b FROM range(256)),
crc AS (SELECT list(x ORDER BY b) AS t FROM (
  SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM bytes)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(hex(encode(word))) // 2), lambda j: ('0x' || substr(hex(encode(word)), 2 * j + 1, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {resampling.BUCKETS} AS bucket
  FROM (SELECT DISTINCT word FROM (SELECT word FROM w UNION ALL SELECT word FROM target)), crc),
raw AS (SELECT bucket, count(*)::DOUBLE AS s FROM w JOIN hashed USING (word) GROUP BY bucket),
goal AS (SELECT bucket, count(*)::DOUBLE AS t FROM target JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(s) FROM raw), 0) AS big_s, coalesce((SELECT sum(t) FROM goal), 0) AS big_t),
gain AS (SELECT bucket, floor({resampling.UNIT} * ln((coalesce(t, 0) + 1) * (big_s + {resampling.BUCKETS}) / ((s + 1) * (big_t + {resampling.BUCKETS}))))::BIGINT AS gain FROM raw LEFT JOIN goal USING (bucket), sums),
many AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS total FROM w JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY row),
x AS (
  SELECT row, doc_id, coalesce(n, 0) AS n_features, coalesce(((total - ((total % n) + n) % n) // n), 0) AS weight,
    floor(-{resampling.UNIT} * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS noise
  FROM d LEFT JOIN many USING (row)),
k AS (SELECT *, weight + noise AS score, n_features >= {resampling.MIN_WORDS} AS may FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features DESC) AS rank, ({resampling.PERCENT} * count(*) OVER (PARTITION BY may)) // 100 AS drawn FROM k)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND rank <= drawn THEN rank END AS rank FROM r
"""

_OP13 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT row, unnest(CASE WHEN len(w) < {minhash.SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle
  FROM d WHERE len(w) > 0),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
overlap AS (SELECT x.row AS a, y.row AS b, count(*) AS k FROM s x JOIN s y USING (shingle) WHERE x.row <> y.row GROUP BY ALL),
links AS (SELECT a, b FROM overlap JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * k >= {minhash.PERCENT} * (x.n + y.n - k)),
reach(a, b) AS (SELECT row, row FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT a AS row, min(doc_id) AS component_id FROM reach JOIN d ON d.row = b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id,
  coalesce(CASE WHEN n > 0 THEN component_id ELSE doc_id END = doc_id, CASE WHEN n > 0 THEN component_id ELSE doc_id END IS NULL) AS kept
FROM d LEFT JOIN n USING (row) LEFT JOIN comp USING (row)
"""

#: SimHash (XXH64) and tokenising are beyond SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op6_mixing": _OP6, "op7_urls": _OP7, "op9_exact": _OP9, "op10_quality": _OP10, "op11_phrases": _OP11, "op12_resampling": _OP12, "op13_minhash": _OP13}
