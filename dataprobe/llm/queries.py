"""Queries that apply each operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers

from dataprobe.llm import collocations, convrepair, decontam, htmltext, katz, licenses, linealign, linerules, nearcopies, packing, quality, sentencespans, toxicity
from dataprobe.llm.registry import query, table

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[p : p + n - 1], ' ') AS g FROM
  (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, p, n, array_to_string(ws[p : p + n - 1], ' ') AS g FROM
  (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item_id, p, n FROM dw JOIN iw USING (g, n)),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""


@query("op3_decontaminate", OP3_SQL)
def op3_decontaminate(spark, sf_dir):
    """Hit words and items of every document against every benchmark item."""
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_sentence_spans")
def op9_sentence_spans(spark, sf_dir):
    """Every document without the sentences of repeated runs."""
    return sentencespans.remove_repeats(table(spark, sf_dir, "documents"), whole=True)


@query("op8_pack")
def op8_pack(spark, sf_dir):
    """Every piece of every document with its place in a sequence of 4096 tokens."""
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op2_near_copies")
def op2_near_copies(spark, sf_dir):
    """The near-duplicate class of every document."""
    return nearcopies.near_copies(table(spark, sf_dir, "documents")).drop("_key")


@query("op1_line_alignment")
def op1_line_alignment(spark, sf_dir):
    """Every document without the line blocks that earlier documents hold."""
    return linealign.remove_overlaps(table(spark, sf_dir, "documents"), whole=True).drop("_key")


@query("op4_quality")
def op4_quality(spark, sf_dir):
    """Document, prior and posterior probability of every document being good."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op5_sql() -> str:
    texts = ", ".join(f"('{label}', '{t}')" for label, t in licenses.TEMPLATES)
    phrases = ", ".join(f"('{label}', {p.split()!r})" for p, label in licenses.PHRASES)
    return f"""
WITH d AS (SELECT doc_id, text, {_WORDS} AS ws FROM documents),
p AS (SELECT * FROM (VALUES {phrases}) v(label, pw)),
place AS (SELECT doc_id, label, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) JOIN p ON ws[i] = pw[1] AND ws[i : i + len(pw) - 1] = pw),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS z FROM place GROUP BY doc_id),
t AS (SELECT label, list_distinct({_WORDS}) AS tw FROM (VALUES {texts}) v(label, text)),
l AS (SELECT doc_id, list_distinct({_WORDS}) AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)),
met AS (SELECT doc_id, label, len(list_intersect(lw, tw)) / len(tw) AS share FROM l, t WHERE len(list_intersect(lw, tw)) >= ceil({licenses.THRESHOLD} * len(tw) - 1e-9)),
best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT doc_id, label FROM place) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
  coalesce(bl.s, '') AS base_labels, coalesce(al.s, '') AS labels, coalesce(share, 0.0) AS score
FROM d LEFT JOIN base ON d.doc_id = base.doc_id LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN bl ON d.doc_id = bl.doc_id LEFT JOIN al ON d.doc_id = al.doc_id
"""


@query("op5_licenses", _op5_sql())
def op5_licenses(spark, sf_dir):
    """License phrases and notices of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), wrapped=True).drop("blocks")


@query("op7_line_rules")
def op7_line_rules(spark, sf_dir):
    """Counts and verdict of every document."""
    return linerules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("line_labels")


@query("op10_page_text")
def op10_page_text(spark, sf_dir):
    """The main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query("op6_katz_scores")
def op6_katz_scores(spark, sf_dir):
    """Base and model score of every document."""
    return katz.score(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    """Cheapest repair of every damaged conversation."""
    return convrepair.digest(convrepair.damage(table(spark, sf_dir, "conversations")))


@query("op11_toxicity")
def op11_toxicity(spark, sf_dir):
    """Toxicity of every document."""
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
s AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
f1 AS (SELECT lang, x, count(*) AS f FROM s GROUP BY lang, x),
f2 AS (SELECT lang, x, y, count(*) AS f FROM s WHERE y IS NOT NULL GROUP BY lang, x, y),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM s WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
longer AS (SELECT lang, x, y, max(f) AS most FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY lang, x, y),
two AS (SELECT p.lang, p.x || ' ' || p.y AS phrase, p.f AS a, u.f AS l, v.f AS r, (1000000 * p.f::HUGEINT * p.f) // (u.f::HUGEINT * v.f) AS score
  FROM f2 p JOIN f1 u ON u.lang = p.lang AND u.x = p.x JOIN f1 v ON v.lang = p.lang AND v.x = p.y LEFT JOIN longer g ON g.lang = p.lang AND g.x = p.x AND g.y = p.y
  WHERE p.f >= 10 AND (most IS NULL OR 100 * most < 50 * p.f)),
cut AS (SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, u.f AS l1, b.f AS r1, c.f AS l2, v.f AS r2,
  (1000000 * t.f::HUGEINT * t.f) // (u.f::HUGEINT * b.f) AS s1, (1000000 * t.f::HUGEINT * t.f) // (c.f::HUGEINT * v.f) AS s2
  FROM f3 t JOIN f1 u ON u.lang = t.lang AND u.x = t.x JOIN f1 v ON v.lang = t.lang AND v.x = t.z
  JOIN f2 b ON b.lang = t.lang AND b.x = t.y AND b.y = t.z JOIN f2 c ON c.lang = t.lang AND c.x = t.x AND c.y = t.y),
every AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cut),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13_collocations(spark, sf_dir):
    """The first phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
