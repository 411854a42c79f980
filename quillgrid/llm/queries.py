"""The registered queries of the corpus operators, each over its whole table, and DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import digest, format_examples
from .decontaminate import contamination
from .exact_dedup import exact_duplicates
from .fim import fim_digests
from .langid import identify_languages
from .line_dedup import drop_repeated_lines
from .mixing import mix_sources
from .near_dup import near_duplicates
from .pii import replace_pii
from .sharding import balanced_shards
from .substring_dedup import drop_repeated_spans
from .url_filter import filter_urls
from .whitening import whitened_embeddings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    found = identify_languages(docs, docs.where(fold != 0))
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages take the label of the document with their id; low quality or toxic is a bad outcome."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.coalesce("quality", "toxic").isNotNull(), F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    found = filter_urls(table(spark, sf_dir, "pages"), labels)
    return found.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_low")})


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("kept", ~F.col("contaminated"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -1, that is full of control strings."""
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return digest(format_examples(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's ``spark.quillgrid.pii.key``; a deployment sets a secret one, and the fallback only serves runs over test data."""
    return replace_pii(table(spark, sf_dir, "documents"), key=spark.conf.get("spark.quillgrid.pii.key", "not a secret"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_embeddings(table(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of even numbers of rows; documents with equal texts are linked."""
    return balanced_shards(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_chat_format": op9_chat_format,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_sharding": op12_sharding,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_NEAR_DUP = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d
), n AS (SELECT doc_id, len(g) AS n FROM s), x AS (SELECT doc_id, unnest(g) AS g FROM s), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)
), e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

_URL_FILTER = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), hp AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), rules(verdict, of, start) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hit AS (
  SELECT page_id, host, path, arg_max(of || start, length(of || start)) AS rule, arg_max(verdict, length(of || start)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM hp) JOIN rules ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start) GROUP BY ALL
), lab AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
h AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS x FROM hp LEFT JOIN lab USING (page_id) GROUP BY 1),
hb AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM h),
h2 AS (SELECT *, string_split(bare, '.') AS l FROM hb),
h3 AS (SELECT host, n, x, l, array_to_string(l[-2:], '.') AS two, regexp_matches(array_to_string(l[-2:], '.'), '^(?:ac|co|com|edu|go|gob|gov|mil|ne|net|nom|or|org|sch)\.[a-z]{2}$') AS long,
        regexp_matches(bare, '^(?:\d{1,3}(?:\.\d{1,3}){3}|\[[0-9a-f:.]*\])$') AS address, bare FROM h2),
hosts AS (SELECT host, n, x, CASE WHEN address THEN bare WHEN long THEN array_to_string(l[-3:], '.') ELSE two END AS domain, CASE WHEN address THEN '(address)' WHEN long THEN two ELSE l[-1] END AS suffix FROM h3),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY 1),
lev AS (SELECT 1 AS k, n, x FROM suffixes WHERE n > 0 UNION ALL SELECT 2, n, x FROM domains WHERE n > 0 UNION ALL SELECT 3, n, x FROM hosts WHERE n > 0),
sums AS (SELECT k, CAST(count(*) AS DOUBLE) AS g, sum(n) AS n, sum(x) AS x, sum(n * n) AS n2, sum(x * x / n) AS ss FROM lev GROUP BY 1),
rho AS (SELECT k, x / n AS p, ((ss - x * (x / n)) - (x / n) * (1 - x / n) * (g - 1)) / ((x / n) * (1 - x / n) * (n - n2 / n - (g - 1))) AS r,
        (x / n) * (1 - x / n) > 0 AND n - n2 / n - (g - 1) > 0 AS fine FROM sums),
str AS (SELECT k, p, (1 - least(greatest(CASE WHEN fine THEN r ELSE 0 END, 0.001), 0.99)) / least(greatest(CASE WHEN fine THEN r ELSE 0 END, 0.001), 0.99) AS s FROM rho),
top AS (SELECT suffix, (x + s * p) / (n + s) AS above FROM suffixes, str WHERE k = 1),
mid AS (SELECT domain, (x + s * above) / (n + s) AS prior FROM domains JOIN top USING (suffix), str WHERE k = 2),
ab AS (SELECT host, x + s * prior AS a, n - x + s * (1 - prior) AS b FROM hosts JOIN mid USING (domain), str WHERE k = 3),
rep AS (SELECT host, a / (a + b) AS rate, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ab)
SELECT hp.page_id, host, path, rule, coalesce(verdict, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(CAST(rate AS DOUBLE), 6) AS bad_rate, round(CAST(low AS DOUBLE), 6) AS bad_low
FROM hp LEFT JOIN (SELECT page_id, rule, verdict FROM hit) h USING (page_id) LEFT JOIN rep USING (host)
"""

_EXACT_DEDUP = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(translate(coalesce(text, ''), {_BLANKS}, '')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""

_LINE_DEDUP = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.*, s.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

_MIXING = r"""
WITH s AS (SELECT source, sum(CAST(length(text) AS DOUBLE)) AS size FROM documents GROUP BY 1),
r AS (SELECT source, pow(size, 0.5) * sum(size) OVER () / sum(pow(size, 0.5)) OVER () / size AS rate FROM s),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS step FROM r, (SELECT unnest(range(60)) AS k)),
u AS (SELECT *, CAST(('0x' || substr(md5('17:' || doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.doc_id, count(*) AS n FROM u JOIN c ON c.source = u.source AND c.step <= u.u GROUP BY 1)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS BIGINT) AS copy_no, substr(md5('17:' || doc_id || ':' || copy_no), 1, 16) AS shuffle_key
FROM (SELECT u.* EXCLUDE (u), unnest(range(1, n + 1)) AS copy_no FROM u JOIN n USING (doc_id))
"""

_CHAT_FORMAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), l AS (
  SELECT *, 10 + length(replace(replace(replace(replace(role, chr(92), chr(92) || '-'), '<', chr(92) || 'l'), '[', chr(92) || 'b'), chr(10), chr(92) || 'n'))
          + length(replace(replace(replace(text, chr(92), chr(92) || '-'), '<', chr(92) || 'l'), '[', chr(92) || 'b')) AS chars FROM t
), p AS (
  SELECT *, sum(chars) OVER w AS upto, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

_FIM = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
), h AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(list_slice(u, 1, a), '') AS prefix, array_to_string(list_slice(u, a + 1, b), '') AS middle, array_to_string(list_slice(u, b + 1, n), '') AS suffix FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

ORACLES = {
    "op2_minhash_near_dedup": _NEAR_DUP,
    "op3_url_filter": _URL_FILTER,
    "op4_exact_dedup": _EXACT_DEDUP,
    "op5_source_mixing": _MIXING,
    "op7_line_dedup": _LINE_DEDUP,
    "op9_chat_format": _CHAT_FORMAT,
    "op13_fill_in_middle": _FIM,
}
