"""The operators over their whole tables, as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.llm import arrow, byte_bpe, chat_format, decontaminate, filter_audit, license_scan, line_dedup, merkle, ngram_join, quality_rules, secret_scan, substring_dedup, token_counts, toxicity

PIECES = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Shorter lines repeat by chance or as boilerplate: half of all documents have one, and clean documents are to be left alone.
PASSAGES = {"line": 15, "sentence": 25}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_DIGESTS = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def _chat_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in arrow.parts(batches, 500):
        rows = []
        for out, spans in zip(*arrow.values(part, "formatted", "spans"), strict=True):
            turns = chat_format.read_turns(out)
            loss = "".join(chat_format.unescape(out[s["text_start"] : s["text_end"]]) for s in spans if s["loss"])
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(out)))
        yield arrow.with_columns(part, ["formatted", "spans"], {n: ([r[i] for r in rows], t) for i, (n, t) in enumerate(_DIGESTS.items())})


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the output."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id bigint, turn bigint, role string, text string")
    out = chat_format.format_conversations(rows.unionByName(more))
    return out.select("conv_id", "formatted", "spans").mapInArrow(_chat_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 4-word shingles at a Jaccard similarity of 0.85."""
    return ngram_join.jaccard_join(_read(spark, sf_dir, "documents"), size=4, percent=85)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, the base rules and the verdict of the fences of its language and source."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    counted = quality_rules.features(docs).drop("text")
    out = quality_rules.judge(counted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which at least 80 % of the 5-word shingles are in a document."""
    return decontaminate.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), size=5, percent=80)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the lines that are on ten or more sites; texts of nothing else are flagged."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.remove_boilerplate(docs, site="source", min_sites=10)
    return out.select("doc_id", "n_lines_removed", "all_boilerplate", F.length("text").cast("bigint").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text, and of the bytes that they decode to."""
    return byte_bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every whole text."""
    return token_counts.count_pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every whole text, with coverage and span."""
    out = license_scan.scan_licenses(_read(spark, sf_dir, "documents"))
    return out.withColumn("coverage", F.round("coverage", 6))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 15 words and passages of 25 that repeat an earlier document, and what is left of every text."""
    out = substring_dedup.drop_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), least=PASSAGES)
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("doc_id", F.size("removed").cast("bigint").alias("n_removed"), spans.alias("removed"), F.length("text").cast("bigint").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text. The table comes in two deliveries, earlier and later ids, and the second scans only blobs that aren't in the ledger of the first."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    middle = docs.agg(F.expr("cast(min(doc_id) / 2 + max(doc_id) / 2 as bigint)")).first()[0] or 0
    early = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    found, _ = secret_scan.scan_deliveries([docs.filter(early), docs.filter(~early)], secret_scan.empty_ledger(spark))
    spans = F.col("findings")
    base = F.filter(spans, lambda x: x["kind"].isin([r.kind for r in secret_scan.BASE]))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    kinds = F.transform(spans, lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("bigint").alias(f"n_{r.kind}") for r in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all 120 orders, by language."""
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every whole text; a fifth of the ids is never learned from."""
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = toxicity.fit(docs, labels.filter(~held_out))
    return toxicity.score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every row, and whether a leaf that may have lost its line feeds still leads to the root."""
    docs = _read(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    again = merkle.leaf([tampered if c == "text" else F.col(c) for c in columns])
    out = merkle.manifest(docs, columns, group="source", key="doc_id", keep={"again": F.unhex(again)})
    folded = merkle.fold(F.lower(F.hex("again")), F.col("proof"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_SQL: dict[str, str] = {}

_SQL["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS shingles FROM w
), x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, p.v FROM r JOIN p ON p.u = r.reached
), c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node
), l AS (SELECT u, count(*) AS n_links FROM p GROUP BY u)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, c.component_id, coalesce(l.n_links, 0)::BIGINT AS n_links
FROM s JOIN c ON c.node = s.doc_id LEFT JOIN l ON l.u = s.doc_id
"""

_SQL["op1_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, role, text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, NULL, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (SELECT conv_id, alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c
), f AS (
  SELECT *, length('### ') + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(': ')
    + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + length(' </turn>') + 1 AS chars FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM f GROUP BY conv_id, alone
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

# The quantiles are exact while a sketch holds all its values, as it does over tables of up to a thousand rows.
_SQL["op3_quality_rules"] = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t
), win AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, unnest([array_to_string(words[k:k + 7], ' ') FOR k IN range(1, len(words) - 6)]) AS run FROM w WHERE len(words) >= 8
), again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1
), covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 8) r(k) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id
), m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length FROM f
), g AS (SELECT lang, source, count(*) AS n FROM m WHERE NOT base_failed GROUP BY ALL
), l AS (SELECT lang, count(*) AS n_lang FROM m WHERE NOT base_failed GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, list_sort(list(m.symbol_share)) AS a, list_sort(list(m.dup_line_share)) AS b, list_sort(list(m.repeat_share)) AS c, list_sort(list(m.word_length)) AS d, count(*) AS k
  FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang JOIN m ON NOT m.base_failed AND (g.n < 200 OR m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source) AND (g.n >= 200 OR n_lang < 200 OR m.lang IS NOT DISTINCT FROM g.lang)
  GROUP BY g.lang, g.source
), i AS (SELECT *, greatest(1, ceil(0.05 * k))::INT AS q5, greatest(1, ceil(0.5 * k))::INT AS q50, greatest(1, ceil(0.8 * k))::INT AS q80, greatest(1, ceil(0.99 * k))::INT AS q99 FROM p
), e AS (
  SELECT lang, source, a[q80] + 2::DOUBLE * (a[q80] - a[q50]) + 0.05::DOUBLE AS a_top, b[q99] + 1::DOUBLE * (b[q99] - b[q50]) + 0.05::DOUBLE AS b_top, c[q99] + 1::DOUBLE * (c[q99] - c[q50]) + 0.03::DOUBLE AS c_top,
    d[q80] + 8::DOUBLE * (d[q80] - d[q50]) + 0.1::DOUBLE AS d_top, d[q5] + 4::DOUBLE * (d[q5] - d[q50]) - 0.1::DOUBLE AS d_low FROM i
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbol_share <= a_top AND dup_line_share <= b_top AND repeat_share <= c_top AND word_length <= d_top AND word_length >= d_low, true) AS kept
FROM m LEFT JOIN e ON m.lang IS NOT DISTINCT FROM e.lang AND m.source IS NOT DISTINCT FROM e.source
"""

_SQL["op4_benchmark_decontamination"] = r"""
WITH x AS (SELECT doc_id AS id, 0 AS kind, lower(text) AS text FROM documents UNION ALL SELECT item_id, 1, lower(text) FROM benchmark
), w AS (SELECT id, kind, regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+') AS words FROM x WHERE text IS NOT NULL
), n AS (SELECT id, least(5, len(words)) AS size, words FROM w WHERE kind = 1 AND len(words) > 0
), i AS (SELECT id AS item_id, size, list_distinct([array_to_string(words[k:k + size - 1], ' ') FOR k IN range(1, len(words) - size + 2)]) AS shingles FROM n
), e AS (SELECT item_id, len(shingles) AS n_shingles, unnest(shingles) AS shingle FROM i
), d AS (
  SELECT DISTINCT id AS doc_id, unnest([array_to_string(words[k:k + size - 1], ' ') FOR k IN range(1, len(words) - size + 2)]) AS shingle
  FROM w, (SELECT DISTINCT size FROM i) WHERE kind = 0 AND len(words) >= size
)
SELECT doc_id, item_id, n_shingles::BIGINT AS n_shingles, count(*) AS n_shared
FROM d JOIN e USING (shingle) GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""

_SQL["op5_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents
), h AS (
  SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS normal FROM l
), b AS (SELECT normal FROM h WHERE normal <> '' GROUP BY normal HAVING count(DISTINCT source) >= 10
), f AS (SELECT h.*, b.normal IS NOT NULL AS bad FROM h LEFT JOIN b ON h.normal = b.normal
), g AS (
  SELECT doc_id, any_value(text) AS text, count(*) FILTER (bad) AS n, count(*) FILTER (NOT bad AND normal <> '') > 0 AS alive, string_agg(line, chr(10) ORDER BY place) FILTER (NOT bad) AS kept FROM f GROUP BY doc_id
), r AS (SELECT doc_id, CASE WHEN alive THEN n ELSE 0 END AS n_lines_removed, n > 0 AND NOT alive AS all_boilerplate, CASE WHEN n > 0 AND alive THEN kept ELSE text END AS text FROM g)
SELECT doc_id, n_lines_removed, all_boilerplate, length(text)::BIGINT AS n_chars_left, sha256(text) AS text_sha256 FROM r
"""

_SQL["op9_substring_dedup"] = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text IS NOT NULL
), o AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(regexp_extract(line, '^[.!?]*')) AS off FROM l
), c AS (
  SELECT doc_id, ln, off, unnest(regexp_extract_all(line, '[^.!?]+[.!?]*')) AS t, generate_subscripts(regexp_extract_all(line, '[^.!?]+[.!?]*'), 1) AS k FROM o
), p AS (
  SELECT doc_id, ln, k, length(t) AS n, off + coalesce(sum(length(t)) OVER (PARTITION BY doc_id, ln ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
    [x FOR x IN string_split(lower(rtrim(t, '.!?')), ' ') IF x <> ''] AS words FROM c
), r AS (
  SELECT doc_id, ln, k, a AS start, a + n AS stop, words AS said FROM p WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.ln, p.k, CASE WHEN len(r.said) >= 4 THEN p.a ELSE r.start END, p.a + p.n, CASE WHEN len(r.said) >= 4 THEN p.words ELSE r.said || p.words END
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.ln = r.ln AND p.k = r.k + 1
), v AS (
  SELECT doc_id, 'sentence' AS kind, 25 AS least, start, stop, said FROM r WHERE len(said) >= 4
  UNION ALL
  SELECT doc_id, 'line', 15, off - length(regexp_extract(line, '^[.!?]*')), off - length(regexp_extract(line, '^[.!?]*')) + length(line), [x FOR x IN string_split(lower(line), ' ') IF x <> ''] FROM o WHERE trim(line) <> ''
), u AS (
  SELECT doc_id, kind, least, start, stop, len(said) AS n, array_to_string(said, ' ') AS unit, row_number() OVER (PARTITION BY doc_id, kind ORDER BY start) AS i FROM v
), f AS (SELECT kind, unit, min(doc_id) AS first FROM u GROUP BY kind, unit
), g AS (SELECT u.*, first <> doc_id OR row_number() OVER (PARTITION BY doc_id, u.kind, u.unit ORDER BY i) > 1 AS again FROM u JOIN f ON u.kind = f.kind AND u.unit = f.unit
), h AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS run FROM g WHERE again
), p1 AS (SELECT doc_id, min(start) AS a, max(stop) AS b FROM h GROUP BY doc_id, kind, run, least HAVING sum(n) >= least
), p2 AS (SELECT *, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < a AS fresh FROM (SELECT DISTINCT doc_id, a, b FROM p1)
), p3 AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS part FROM p2
), x AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM p3 GROUP BY doc_id, part
), y AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM x
  UNION ALL SELECT d.doc_id, length(text), NULL, coalesce(max(b), 0) FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id WHERE text IS NOT NULL GROUP BY d.doc_id, text
), z AS (
  SELECT y.doc_id, count(b) AS n_removed, coalesce(string_agg((a::BIGINT) || ':' || (b::BIGINT), ',' ORDER BY a) FILTER (b IS NOT NULL), '') AS removed,
    coalesce(string_agg(substr(text, since::BIGINT + 1, (a - since)::BIGINT), '' ORDER BY since), '') AS left_over FROM y JOIN documents d ON d.doc_id = y.doc_id GROUP BY y.doc_id
)
SELECT doc_id, n_removed, removed, length(left_over)::BIGINT AS n_chars_left, sha256(left_over) AS text_sha256 FROM z
"""

# A match is found again as the first place of its text: an earlier place of the same text would have matched.
_SQL["op10_secret_scans"] = r"""
WITH RECURSIVE k(ord, kind, pat, least) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6), (1, 'access', 'AKIA[A-Z0-9]+()', 20), (2, 'hex', '[0-9a-f]{24,}()', 24),
  (3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----()', 0), (4, 'github', '\bgh[pousr]_[A-Za-z0-9]{36,}()', 0), (5, 'slack', '\bxox[abprs]-[A-Za-z0-9-]{10,}()', 0)
), s AS (
  SELECT doc_id, ord, kind, pat, least, coalesce(text, '') AS rest, 0::BIGINT AS base, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS counted FROM documents, k
  UNION ALL
  SELECT doc_id, ord, kind, pat, least, substr(rest, strpos(rest, m) + length(m)), base + strpos(rest, m) - 1 + length(m), base + strpos(rest, m) - 1, base + strpos(rest, m) - 1 + length(m),
    CASE WHEN ord = 0 THEN length(regexp_extract(m, pat, 2)) ELSE length(m) END
  FROM (SELECT *, regexp_extract(rest, pat) AS m FROM s) WHERE m <> ''
), f AS (SELECT doc_id, ord, kind, kind || ':' || a || ':' || b AS span, a FROM s WHERE b > 0 AND counted >= least
), g AS (
  SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
    string_agg(span, ',' ORDER BY a, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY a, ord) AS spans FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""

_SQL["op11_filter_interaction_audit"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (SELECT *, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM t
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), first AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text), regexp_matches(w.text, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails
  FROM w JOIN first ON w.text = first.text LEFT JOIN l ON l.doc_id = w.doc_id
), g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), o AS (SELECT '' AS said UNION ALL SELECT said || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(x) WHERE NOT contains(said, x)
), s AS (SELECT said AS filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(said) = 5
), x AS (
  SELECT part, filter_order, step, n, good, toxic, fails[strpos('ABCDE', filter_order[step])] AS here, len([k FOR k IN range(1, step) IF fails[strpos('ABCDE', filter_order[k])]]) > 0 AS gone, len([k FOR k IN fails IF k]) AS n_fails FROM g, s
), r AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (here AND n_fails = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (here AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0)::BIGINT AS toxic_lost FROM x GROUP BY part, filter_order, step
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""

# crc32 takes eight steps for each byte: -1 stands for a step, other values for a byte that comes in before them.
_SQL["op13_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_prepend(4294967295, flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])),
    lambda crc, x: CASE WHEN x = -1 THEN xor(crc >> 1, 3988292384 * (crc & 1)) ELSE xor(crc, x::BIGINT) END) AS crc FROM documents
), e AS (
  SELECT doc_id, source, text, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM d
), l AS (SELECT doc_id, coalesce('-' || source, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS again FROM e
), p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), n AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL
  SELECT DISTINCT tree, level + 1, pos // 3, sha256(string_agg(digest, '') OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 2) // 3 FROM n WHERE n > 1
), s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM n WHERE n = 1
), m AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM s
  UNION ALL
  SELECT DISTINCT level + 1, pos // 3, sha256(string_agg(digest, '') OVER (PARTITION BY pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 2) // 3 FROM m WHERE n > 1
), a AS (
  SELECT tree, level, pos // 3 AS run, pos, digest FROM n WHERE n > 1
  UNION ALL SELECT tree, level, pos // 3, pos, digest FROM (SELECT s.tree, m.level + 1000 AS level, m.pos, m.digest FROM m, s WHERE m.n > 1)
), b AS (
  SELECT x.tree, x.level, x.pos, coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS before, coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS after
  FROM a x JOIN a y ON x.tree = y.tree AND x.level = y.level AND x.run = y.run GROUP BY x.tree, x.level, x.pos
), q AS (
  SELECT p.doc_id, p.tree, p.pos, k.level, b.before, b.after
  FROM p JOIN s ON s.tree = p.tree JOIN (SELECT DISTINCT tree, level FROM a) k ON k.tree = p.tree
  JOIN b ON b.tree = p.tree AND b.level = k.level AND b.pos = CASE WHEN k.level < 1000 THEN p.pos // (3 ** k.level)::BIGINT ELSE s.pos // (3 ** (k.level - 1000))::BIGINT END
), z AS (SELECT tree, pos, list(before ORDER BY level) AS b, list(after ORDER BY level) AS a, string_agg(before || after, '' ORDER BY level) AS said FROM q GROUP BY tree, pos
), u AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM m WHERE n = 1) AS root, sha256(coalesce(z.said, '')) AS proof_sha256,
    CASE WHEN z.b IS NULL THEN again ELSE list_reduce(list_prepend(again, [x[1] || ',' || x[2] FOR x IN list_zip(z.b, z.a)]), lambda acc, x: sha256(split_part(x, ',', 1) || acc || split_part(x, ',', 2))) END AS folded_root
  FROM p JOIN s ON s.tree = p.tree LEFT JOIN z ON z.tree = p.tree AND z.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM u
"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
