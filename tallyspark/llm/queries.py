"""The thin ``opN_<name>`` queries over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .decontaminate import contamination
from .linededup import line_dedup
from .lmscore import score_documents
from .merkle import fold, merkle_manifest, siblings
from .packing import pack_documents
from .quality import quality_scores
from .runtime import durable, read_table, shared_dir
from .simhash import near_duplicates
from .substrings import remove_repeats
from .tokencounts import count_tokens
from .toxicity import fit_toxicity, score_toxicity
from .urlrules import judge_urls
from .warc import read_warc, remove_folder, write_warc

#: (verdict, host, path start) of the URL query.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _crc(spark_column: str):
    return F.crc32(F.encode(F.coalesce(F.col(spark_column).cast("string"), F.lit("")), "UTF-8"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents by a network that learns from the rows that are not held out."""
    return score_documents(read_table(spark, sf_dir, "documents"), _crc("doc_id") % 7 == 2).withColumnRenamed("id", "doc_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to archives in the shared folder, read back, and the folder removed, also after a failure."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    # a gap in archives that were written just now is a page lost
    whole = F.when(F.col("kind") == "record", F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("gap in"), "archive", F.lit("at"), "offset", "reason")).cast("boolean"))
    try:
        write_warc(read_table(spark, sf_dir, "pages"), folder).write.format("noop").mode("overwrite").save()
        records = durable(read_warc(spark, folder, payloads=False).drop("payload").where(whole))
    finally:
        remove_folder(spark, folder)
    number = lambda c: F.when(F.col(c) != "null", F.col(c).cast("long"))
    return records.select(number("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def tokenizer_path() -> str:
    """The vocabulary file of the queries that need tokens; it belongs to the box, not to this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences of all documents."""
    pieces = pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return pieces.withColumnRenamed("id", "doc_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base verdict and verdict of the fitted votes of every document."""
    scored = quality_scores(read_table(spark, sf_dir, "documents"))
    return scored.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of the benchmark in every document."""
    found = contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"), "contaminated",
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page, aliases included."""
    judged = judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 35 words that are found elsewhere."""
    done = remove_repeats(read_table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that many documents share."""
    done = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labelled rows that are not held out."""
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    held_out = _crc("doc_id") % 5 == 0
    scored = score_toxicity(docs, fit_toxicity(docs, labels.where(~held_out))).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and roots of every document, and what a check of tampered texts says."""
    tampered = F.when(_crc("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle_manifest(read_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], altered={"text": tampered})
    told = made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("altered_leaf"), F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counted = count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of every language."""
    return collocations(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_warc": op2_warc,
        "op3_packing": op3_packing,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_url_filters": op7_url_filters,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_line_dedup": op9_line_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_token_counts": op12_token_counts,
        "op13_phrase_collocations": op13_phrase_collocations,
    }


#: White space of ``[\x20\x09-\x0D]`` as DuckDB text.
_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "regexp_extract_all(" + _LOWER.format("coalesce({}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _url_sql() -> str:
    """The URL query for DuckDB: the same edges, reached recursively."""
    rest = "CASE WHEN instr(coalesce({0}, ''), '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
    host = _LOWER.format(f"regexp_extract({rest}, '^[^/?#]*', 0)")
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    tail = f"regexp_extract({rest}, '^[^/?#]*([^#]*)', 1)"
    node = "CASE WHEN " + host + " <> '' THEN " + _LOWER.format("split_part({0}, '://', 1)") + " || '://' || " + host + " || CASE WHEN starts_with(" + tail + ", '/') THEN " + tail + " ELSE '/' || " + tail + " END END"
    attribute = lambda name: rf"""regexp_replace(regexp_extract(tag, '(?is)\s{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), '^["'']|["'']$', '', 'g')"""
    ranked = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[0]))
    fits = [(f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{start}')", at + start, verdict) for verdict, at, start in ranked]
    rule = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for test, name, _ in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {test} THEN '{verdict}'" for test, _, verdict in fits) + " END"
    return rf"""
WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\s[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
named AS (SELECT url, lower({attribute('rel')}) AS rel, {attribute('href')} AS href, lower({attribute('http-equiv')}) AS equiv, {attribute('content')} AS content FROM tags),
links AS (
  SELECT url, replace(trim(CASE WHEN regexp_matches(rel, '(^|\s)canonical(\s|$)') THEN href
    WHEN equiv = 'refresh' THEN regexp_extract(content, '(?i)^\s*0*(?:\.0*)?\s*[;,]\s*url\s*=\s*[''"]?([^''"]+)', 1) END), '&amp;', '&') AS link FROM named
),
based AS (SELECT url, link, split_part(url, '://', 1) AS scheme, split_part(url, '://', 1) || '://' || regexp_extract({rest.format('url')}, '^[^/?#]*', 0) AS site,
  regexp_extract({rest.format('url')}, '^[^/?#]*(/[^?#]*)', 1) AS path FROM links WHERE link <> ''),
targets AS (
  SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN site || link
    WHEN regexp_matches(link, '^(#|$|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL WHEN starts_with(link, '?') THEN site || CASE path WHEN '' THEN '/' ELSE path END || link
    ELSE site || CASE regexp_extract(path, '^.*/', 0) WHEN '' THEN '/' ELSE regexp_extract(path, '^.*/', 0) END || link END AS target FROM based
),
edges AS (SELECT src, dst FROM (SELECT {node.format('url')} AS src, {node.format('target')} AS dst FROM targets) WHERE src <> dst),
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT src AS node, src AS seen FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON r.seen = b.src),
told AS (SELECT node, {host.format('seen')} AS host, {path.format('seen')} AS path FROM reach),
alias AS (SELECT node, bool_or(said = 'allow') AS allowed FROM (SELECT node, {said} AS said FROM told) WHERE said IS NOT NULL GROUP BY node),
judged AS (SELECT page_id, node, host, path, {rule} AS rule, {said} AS said FROM (SELECT page_id, {node.format('url')} AS node, {host.format('url')} AS host, {path.format('url')} AS path FROM pages))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN NOT allowed THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN alias USING (node)
"""


def _merkle_sql() -> str:
    """The manifest query for DuckDB: levels and folds reached recursively; the upper tree has no source name."""
    field = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # bit by bit; only the lowest bit of the inverted remainder counts
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"list_reduce(list_prepend(4294967295, {steps}), lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END))"
    tree = lambda name, start: f"""{name} AS (
  {start}
  UNION ALL
  SELECT tree, level + 1, idx // 3, (size + 2) // 3, sha256(string_agg(node, '' ORDER BY idx)) FROM {name} WHERE size > 1 GROUP BY tree, level, idx // 3, size
)"""  # noqa: E731
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf, CASE WHEN {crc} & 1 = 1 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS altered FROM documents
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS size FROM leaves),
{tree("lower_tree", "SELECT tree, 0 AS level, idx, size, leaf AS node FROM numbered")},
tops AS (SELECT tree, node AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM lower_tree WHERE size = 1),
{tree("upper_tree", "SELECT '' AS tree, 0 AS level, place AS idx, size, subroot AS node FROM tops")},
summit AS (SELECT node AS root, level AS steps FROM upper_tree WHERE size = 1),
docs AS (SELECT n.doc_id, n.leaf, n.altered, n.idx, n.tree, t.subroot, t.height, t.place, s.root, s.steps, row_number() OVER () AS row FROM numbered n JOIN tops t ON n.tree = t.tree CROSS JOIN summit s),
climbs AS (
  SELECT row, tree, step, step AS level, idx // CAST(pow(3, step) AS BIGINT) AS at, false AS upper FROM docs, LATERAL (SELECT unnest(range(0, height)) AS step)
  UNION ALL
  SELECT row, tree, height + step, step, place // CAST(pow(3, step) AS BIGINT), true FROM docs, LATERAL (SELECT unnest(range(0, steps)) AS step)
),
nodes AS (SELECT false AS upper, * FROM lower_tree UNION ALL SELECT true, * FROM upper_tree),
beside AS (
  SELECT c.row, c.step, coalesce(string_agg(n.node, '' ORDER BY n.idx) FILTER (WHERE n.idx < c.at), '') AS before, coalesce(string_agg(n.node, '' ORDER BY n.idx) FILTER (WHERE n.idx > c.at), '') AS after
  FROM climbs c JOIN nodes n ON n.upper = c.upper AND n.tree = CASE WHEN c.upper THEN '' ELSE c.tree END AND n.level = c.level AND n.idx // 3 = c.at // 3 GROUP BY c.row, c.step
),
folds AS (
  SELECT row, CAST(0 AS BIGINT) AS step, altered AS node FROM docs
  UNION ALL
  SELECT f.row, f.step + 1, sha256(b.before || f.node || b.after) FROM folds f JOIN beside b ON f.row = b.row AND f.step = b.step
),
proofs AS (SELECT row, string_agg(before || after, '' ORDER BY step) AS proof FROM beside GROUP BY row)
SELECT d.doc_id, d.leaf, d.subroot, d.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.node AS folded_root, f.node = d.root AS verified
FROM docs d JOIN folds f ON f.row = d.row AND f.step = d.height + d.steps LEFT JOIN proofs p ON p.row = d.row
"""


def _collocations_sql() -> str:
    """The collocation query for DuckDB: every phrase spelled out and counted."""
    low = _LOWER.format("coalesce(text, '')")
    part = lambda a, b: f"array_to_string(list_slice(w, {a}, {b}), ' ')"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex({low}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size),
phrases AS (SELECT lang, list_slice(w, i, i + size - 1) AS w, CAST(size AS INT) AS size, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
named AS (SELECT *, array_to_string(w, ' ') AS phrase FROM phrases),
wider AS (
  SELECT lang, {part('a', 'b')} AS phrase, max(f) AS most
  FROM (SELECT lang, w, f, a, unnest(range(a + 1, size + 1)) AS b, size FROM (SELECT *, unnest(range(1, size)) AS a FROM phrases WHERE size > 2)) WHERE b - a + 1 < size GROUP BY 1, 2
),
kept AS (SELECT n.* FROM named n LEFT JOIN wider x ON n.lang = x.lang AND n.phrase = x.phrase WHERE n.size > 1 AND (x.most IS NULL OR 100 * x.most < 100 * n.f)),
cuts AS (SELECT lang, phrase, f AS a, k, {part('1', 'k')} AS first, {part('k + 1', 'size')} AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, t.n, c.k, x.f AS l, y.f AS r, CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN named x ON x.lang = c.lang AND x.phrase = c.first JOIN named y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_merkle_manifest": _merkle_sql(),
        "op13_phrase_collocations": _collocations_sql(),
        "op2_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
h AS (SELECT *, array_to_string(list_transform(string_split(sha1(body), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', c) - 1) + 1, 4)), '') AS bits FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {" + ".join(f"{1 << (4 - k)} * CAST(substr(bits, CAST(5 * i + {k + 1} AS BIGINT), 1) AS INT)" for k in range(5))}, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h
""",
        "op6_benchmark_decontamination": f"""
WITH docs AS (SELECT doc_id, {_ALNUM.format("text")} AS w FROM documents),
bench AS (SELECT item_id, {_ALNUM.format("text")} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM bench, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT size FROM wins),
places AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM docs, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)
),
found AS (SELECT DISTINCT p.doc_id, p.i, p.size, b.item_id FROM places p JOIN wins b ON p.size = b.size AND p.win = b.win),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
        "op7_url_filters": _url_sql(),
        "op8_substring_dedup": f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS win
  FROM docs, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i)
),
twice AS (SELECT win FROM wins GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS place FROM wins SEMI JOIN twice USING (win)),
words AS (SELECT doc_id, place, w[place] AS word FROM docs, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS place)),
left_over AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS kept FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (doc_id)
""",
        "op9_line_dedup": f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, u.i AS i, parts[u.i] AS line, {_LOWER.format(f"trim(parts[u.i], {_WS})")} AS key
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM docs) d, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u
),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
judged AS (
  SELECT l.*, f.key IS NOT NULL AND l.doc_id <> f.keeper AS dropped
  FROM lines l LEFT JOIN frequent f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    }
