"""The operators of this subpackage applied to their whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, htmltext, langid, linededup, mixing, neardup, substrings, surrogates, topk
from .state import table

#: White space and ASCII upper case in DuckDB's regular expressions.
_WS = r"[\x20\x09-\x0D]"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 85)


OP1_SQL = f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS set FROM w),
e AS (SELECT doc_id, len(set) AS n, unnest(set) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, max(a.n) + max(b.n) AS t FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (t - c)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(set)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP2_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM usable),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INT AS rank, vec_id, score FROM ranked WHERE r <= 10
"""


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)


OP3_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
g AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(n - 199)) AS i FROM t WHERE n >= 200)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY k) > 1),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r),
v AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s) GROUP BY doc_id, run),
p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low, a AS high FROM v
      UNION ALL SELECT doc_id, coalesce(b, 0), n FROM t LEFT JOIN (SELECT doc_id, max(b) AS b FROM v GROUP BY 1) USING (doc_id)),
k AS (SELECT doc_id, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY low) AS kept FROM p JOIN t USING (doc_id) GROUP BY 1),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM v GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), b"a key of this run")
    return out.select("doc_id", "text", F.col(out.columns[-1]).alias("n_mentions"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP6_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g'), '{_UP}', '{_LOW}') AS k FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT doc_id, line, pos, coalesce(doc_id <> keeper, false) AS dropped FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


#: Target weights of the query and of the pipeline; all others are 1.
WEIGHTS = {("web",): 3.0, ("books",): 2.0, ("web", "en"): 4.0, ("books", "en"): 2.0, ("books", "en", "src1"): 8.0}


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.two_domains(), WEIGHTS)


def _split_budget(rows: str, parent: str, child: str) -> str:
    """SQL for the budgets of siblings: those that fill up first, in the order of capacity by weight, then the rest by weight."""
    return f"""SELECT {parent}, {child}, CASE WHEN c <= (b - before_c) * w / (all_w - before_w) THEN c
       ELSE (b - coalesce(max(CASE WHEN c <= (b - before_c) * w / (all_w - before_w) THEN before_c + c END) OVER p, 0)) * w
            / (all_w - coalesce(max(CASE WHEN c <= (b - before_c) * w / (all_w - before_w) THEN before_w + w END) OVER p, 0)) END AS b
FROM (SELECT *, coalesce(sum(c) OVER o, 0)::DOUBLE AS before_c, coalesce(sum(w) OVER o, 0)::DOUBLE AS before_w, sum(w) OVER (PARTITION BY {parent})::DOUBLE AS all_w FROM ({rows})
      WINDOW o AS (PARTITION BY {parent} ORDER BY c / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WINDOW p AS (PARTITION BY {parent})"""


def _weight(path: tuple[str, ...]) -> str:
    """SQL for the weight of a node whose path's columns are `path`."""
    cases = [f"WHEN {' AND '.join(f"{c} = '{v}'" for c, v in zip(path, key, strict=True))} THEN {w}" for key, w in WEIGHTS.items() if len(key) == len(path)]
    return f"CASE {' '.join(cases)} ELSE 1 END::DOUBLE"


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, 'none') AS l, coalesce(source, 'none') AS s,
         CASE WHEN regexp_matches(source, '[02468]$') THEN 'web' WHEN regexp_matches(source, '[13579]$') THEN 'books' ELSE 'other' END AS d,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT d, l, s, sum(n_tokens) AS t FROM d WHERE n_tokens > 0 GROUP BY ALL),
one AS (SELECT 0 AS root, round_even(0.5 * sum(t)::DOUBLE, 0)::DOUBLE AS b FROM leaf),
first AS ({_split_budget(f"SELECT root, d, {_weight(('d',))} AS w, 2 * t::DOUBLE AS c, b FROM (SELECT d, sum(t) AS t FROM leaf GROUP BY 1), one", "root", "d")}),
second AS ({_split_budget(f"SELECT d, l, {_weight(('d', 'l'))} AS w, 2 * t::DOUBLE AS c, b FROM (SELECT d, l, sum(t) AS t FROM leaf GROUP BY 1, 2) JOIN (SELECT d, b FROM first) USING (d)", "d", "l")}),
third AS ({_split_budget(f"SELECT d || '/' || l AS dl, d, l, s, {_weight(('d', 'l', 's'))} AS w, 2 * t::DOUBLE AS c, b FROM leaf JOIN (SELECT d, l, b FROM second) USING (d, l)", "dl", "s")}),
taken AS (SELECT doc_id, lang, source, epoch, n_tokens, d || '/' || l AS dl, s, md5('17:' || epoch || ':' || doc_id) AS place FROM d, (SELECT unnest([0, 1])::INT AS epoch) WHERE n_tokens > 0),
placed AS (SELECT *, epoch * sum(n_tokens) OVER (PARTITION BY dl, s, epoch) + coalesce(sum(n_tokens) OVER (PARTITION BY dl, s, epoch ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM taken)
SELECT doc_id, lang, source, epoch, n_tokens FROM placed JOIN third USING (dl, s) WHERE before < floor(b + 0.5)
"""


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
n AS (SELECT *, regexp_replace(speaker, '[^A-Za-z0-9_.\\-]', '_', 'g') AS clean FROM t),
h AS (
  SELECT *, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker ELSE 'user' END AS chat_role,
         CASE WHEN clean = speaker THEN speaker ELSE clean || '_' || substr(md5(speaker), 1, 8) END AS name
  FROM n JOIN p USING (conv_id)),
g AS (
  SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' AND speaker <> 'system' THEN ' name=' || name ELSE '' END || chr(10) AS header,
         body || '<|im_end|>' AS trained_text FROM h)
SELECT conv_id, perspective, turn, speaker, chat_role, header || trained_text || chr(10) AS segment, speaker = perspective AS trained,
       CASE WHEN speaker = perspective THEN length(header) ELSE 0 END::BIGINT AS mask_start,
       CASE WHEN speaker = perspective THEN length(header) + length(trained_text) ELSE 0 END::BIGINT AS mask_end
FROM g
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


#: For pages with one article of plain paragraphs, headings and lists, as the tables have them.
OP10_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, string_split_regex(regexp_replace(body, '<br[^>]*>', ' ', 'g'), '</?(?:p|h[1-6]|ul|ol|li|div)(?:\s[^>]*)?>') AS parts FROM a),
t AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS parts FROM b),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM t)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_exact_topk": op2_exact_topk,
    "op3_repeated_substrings": op3_repeated_substrings,
    "op4_decontamination": op4_decontamination,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_line_dedup": op6_line_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_chat_rotation": op8_chat_rotation,
    "op9_language_id": op9_language_id,
    "op10_html_text": op10_html_text,
}
SQL: dict[str, str] = {"op1_near_duplicates": OP1_SQL, "op2_exact_topk": OP2_SQL, "op3_repeated_substrings": OP3_SQL, "op6_line_dedup": OP6_SQL, "op7_source_mixing": OP7_SQL, "op8_chat_rotation": OP8_SQL, "op10_html_text": OP10_SQL}
