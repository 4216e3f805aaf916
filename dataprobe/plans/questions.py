"""Question logs, retrieval, SQL audit and ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.operators import ask, intent, retrieval, sqlsurface
from dataprobe.operators.profile import profile
from dataprobe.plans.inputs import QUESTIONS, SALES, STATEMENTS, question_log, sales, statement_log
from dataprobe.plans.profiling import facts_sql
from dataprobe.plans.registry import query
from dataprobe.scratch import materialise
from dataprobe.sources.readers import register_view

CATALOGUE = intent.Catalogue(["region", "nation", "segment", "priority"], ["order_date"], ["quantity", "discount", "revenue"], "revenue")

# ------------------------------------------------- the same rules as SQL text

_NB, _NA = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _has(words):
    return "regexp_matches(q, '" + "|".join(words) + "')"


def _pick(columns, synonyms, tail):
    whens = [f"WHEN contains(q, '{c}') OR contains(q, '{c.replace('_', ' ')}') OR list_has_any(w, {c.split('_')!r}) THEN '{c}'" for c in columns]
    for syns in synonyms.values():
        hit = [c for c in columns if any(s in c for s in syns)]
        if hit:
            whens.append(f"WHEN {_has(syns)} THEN '{hit[0]}'")
    return "CASE " + " ".join(whens + tail) + " END"


_ASKED = f"regexp_extract(q, '{_NB}(?:which|what)\\s+([a-zA-Z0-9_]+)', 1)"
_DIM = _pick(
    CATALOGUE.categorical + CATALOGUE.dates, intent.DIMENSION_SYNONYMS,
    [f"WHEN {_ASKED} <> '' AND (contains('{c}', {_ASKED}) OR contains({_ASKED}, '{c}')) THEN '{c}'" for c in CATALOGUE.categorical] + ["ELSE 'region'"],
)
_METRIC = _pick(CATALOGUE.numeric, intent.METRIC_SYNONYMS, ["ELSE 'revenue'"])
_LIM1 = f"regexp_extract(q, '{_NB}(?:top|first|highest|best|lowest|bottom|worst|limit)\\s*(\\d+){_NA}', 1)"
_LIM2 = f"regexp_extract(q, '{_NB}(\\d+)\\s*(?:{'|'.join(intent.COUNTED_NOUNS)}){_NA}', 1)"


def _num(e):
    return f"greatest(1, least(50, coalesce(try_cast({e} AS INTEGER), 50)))"


_AGG = "CASE " + " ".join(f"WHEN {_has(ws)} THEN '{a}'" for a, ws in intent.AGGREGATION_WORDS.items()) + " ELSE 'sum' END"
_CHART_ASKED = (
    f"regexp_matches(q, '{_NB}(?:{'|'.join(intent.CHART_WORDS)}){_NA}') OR regexp_matches(q, '{_NB}(?:bar|bars|line|lines|pie)\\s+(?:chart|graph|plot|of){_NA}')"
)
_CHART = (
    f"CASE WHEN {_CHART_ASKED} THEN CASE "
    + " ".join(f"WHEN {_has(ws)} THEN '{k}'" for k, ws in intent.CHART_TYPES.items())
    + " WHEN regexp_matches(dimension, 'date|time|day|month|year') THEN 'line' ELSE 'bar' END END"
)
_PARTS = sorted({p for c in CATALOGUE.columns for p in c.split("_") if len(p) > 2})
_OFF = (
    f"len(w) = 0 OR NOT (q IN ({', '.join(repr(g) for g in intent.GREETINGS)}) OR {_has(CATALOGUE.columns)}"
    f" OR list_has_any(w, {_PARTS!r}) OR list_has_any(w, {list(intent.VOCABULARY)!r}))"
)
# trim() of Spark and of this SQL both remove blanks only
INTENTS = f"""{QUESTIONS}, n AS (SELECT conv_id, turn, question, lower(trim(question)) AS q FROM questions),
  w AS (SELECT *, regexp_extract_all(q, '[a-zA-Z0-9_]+') AS w FROM n),
  c AS (SELECT *, {_METRIC} AS metric, {_DIM} AS dimension FROM w),
  intents AS (SELECT conv_id, turn, metric, dimension,
    CAST(CASE WHEN {_LIM1} <> '' THEN {_num(_LIM1)} WHEN {_LIM2} <> '' THEN {_num(_LIM2)} WHEN contains(q, '20 best') THEN 20
         WHEN contains(q, '10 best') THEN 10 WHEN contains(q, '5 best') THEN 5 ELSE 10 END AS INTEGER) AS "limit",
    CASE WHEN {_has(intent.ASCENDING)} THEN 'ASC' ELSE 'DESC' END AS direction, {_AGG} AS aggregation, {_CHART} AS chart, {_OFF} AS off_topic FROM c)"""


def _intents(spark, sf_dir):
    return intent.intents(question_log(spark, sf_dir), CATALOGUE)


@query("intent_limit_dir_agg", f'WITH {INTENTS} SELECT conv_id, turn, "limit", direction, aggregation FROM intents')
def intent_limit_dir_agg(spark, sf_dir):
    return _intents(spark, sf_dir).select("conv_id", "turn", "limit", "direction", "aggregation")


@query("intent_chart", f"WITH {INTENTS} SELECT conv_id, turn, chart FROM intents")
def intent_chart(spark, sf_dir):
    return _intents(spark, sf_dir).select("conv_id", "turn", "chart")


@query("intent_offtopic", f"WITH {INTENTS} SELECT conv_id, turn, off_topic FROM intents")
def intent_offtopic(spark, sf_dir):
    return _intents(spark, sf_dir).select("conv_id", "turn", "off_topic")


@query("intent_columns", f"WITH {INTENTS} SELECT conv_id, turn, metric, dimension FROM intents")
def intent_columns(spark, sf_dir):
    return _intents(spark, sf_dir).select("conv_id", "turn", "metric", "dimension")


_DIMS = CATALOGUE.categorical + CATALOGUE.dates
_LONG = " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS label, quantity, discount, revenue FROM sales" for d in _DIMS)
_CELLS = " UNION ALL ".join(
    f"SELECT dimension, label, count, '{m}' AS metric, '{a}' AS aggregation, {'CAST(count AS DOUBLE)' if a == 'count' else f'{a}_{m}'} AS value FROM g"
    for m in CATALOGUE.numeric
    for a in ("sum", "avg", "max", "min", "count")
)
_AGGS = ", ".join(f"round_even(CAST({a}({m}) AS DOUBLE), 2) AS {a}_{m}" for m in CATALOGUE.numeric for a in ("sum", "avg", "max", "min"))
ANSWERS = f"""{SALES}, {INTENTS}, l AS ({_LONG}), g AS (SELECT dimension, label, count(*) AS count, {_AGGS} FROM l GROUP BY ALL), cells AS ({_CELLS}),
  r AS (SELECT *, 'DESC' AS direction, row_number() OVER (PARTITION BY dimension, metric, aggregation ORDER BY value DESC NULLS LAST, label) AS rank FROM cells
        UNION ALL SELECT *, 'ASC', row_number() OVER (PARTITION BY dimension, metric, aggregation ORDER BY value ASC NULLS LAST, label) FROM cells),
  d AS (SELECT dimension, metric, aggregation, direction, "limit", count(*) AS asked FROM intents WHERE NOT off_topic GROUP BY ALL),
  answers AS (SELECT d.dimension, d.metric, d.aggregation, d.direction, "limit", CAST(rank AS INTEGER) AS rank, label, value, count, asked
              FROM d JOIN r ON d.dimension = r.dimension AND d.metric = r.metric AND d.aggregation = r.aggregation AND d.direction = r.direction
              WHERE rank <= "limit")"""


def _answers(spark, sf_dir):
    return ask.answer_log(sales(spark, sf_dir), _intents(spark, sf_dir), CATALOGUE)


@query("ranked_breakdown", f"WITH {ANSWERS} SELECT * FROM answers")
def ranked_breakdown(spark, sf_dir):
    return _answers(spark, sf_dir)


_VALUE = "CASE aggregation " + " ".join(f"WHEN '{a}' THEN CASE metric " + " ".join(f"WHEN '{m}' THEN {a}_{m}" for m in CATALOGUE.numeric) + " END" for a in ("sum", "avg", "max", "min")) + " ELSE count END"


def _undirected(spark, sf_dir, *columns):
    log = _intents(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in columns})
    return ask.answer_log(sales(spark, sf_dir), log, CATALOGUE)


@query(
    "answer_global",
    f"""WITH {SALES}, {INTENTS}, g AS (SELECT count(*) AS count, {_AGGS} FROM sales),
        d AS (SELECT metric, aggregation, direction, "limit", count(*) AS asked FROM intents WHERE NOT off_topic GROUP BY ALL)
        SELECT CAST(NULL AS VARCHAR) AS dimension, metric, aggregation, direction, "limit", CAST(1 AS INTEGER) AS rank, 'All records' AS label,
               CAST({_VALUE} AS DOUBLE) AS value, count, asked FROM d, g""",
)
def answer_global(spark, sf_dir):
    """Every question of the log as if it named no dimension."""
    return _undirected(spark, sf_dir, "dimension")


@query(
    "answer_count",
    f"""WITH {SALES}, {INTENTS}, g AS (SELECT count(*) AS count FROM sales),
        d AS (SELECT direction, "limit", count(*) AS asked FROM intents WHERE NOT off_topic GROUP BY ALL)
        SELECT CAST(NULL AS VARCHAR) AS dimension, CAST(NULL AS VARCHAR) AS metric, 'count' AS aggregation, direction, "limit", CAST(1 AS INTEGER) AS rank,
               'All records' AS label, CAST(count AS DOUBLE) AS value, count, asked FROM d, g""",
)
def answer_count(spark, sf_dir):
    """Every question of the log as if it named neither dimension nor metric."""
    return _undirected(spark, sf_dir, "dimension", "metric")


def _short(e):
    return f"CASE WHEN {e} < 0 THEN '-' || format('{{:,.2f}}', abs({e})) WHEN {e} = floor({e}) THEN format('{{:,.0f}}', {e}) ELSE format('{{:,.2f}}', {e}) END"


@query(
    "answer_facts",
    f"""WITH {ANSWERS}, f AS (SELECT dimension, metric, aggregation, direction, "limit", arg_min(label, rank) AS leader, arg_min(value, rank) AS a,
          arg_max(label, rank) AS last, arg_max(value, rank) AS b, count(*) AS groups FROM answers GROUP BY ALL)
        SELECT dimension, metric, aggregation, direction, "limit", leader, {_short('a')} AS leader_value, last, {_short('b')} AS last_value, groups FROM f""",
)
def answer_facts(spark, sf_dir):
    return ask.answer_facts(_answers(spark, sf_dir))


# ------------------------------------------------------------------ retrieval

_TYPES = {
    "order_date": "datetime", "region": "string", "segment": "string", "quantity": "float", "discount": "float", "revenue": "float",
}
_COLS = list(_TYPES)


def _known(spark, sf_dir):
    return sales(spark, sf_dir).select(*_COLS)


def _dec(e):
    return f"regexp_replace(CAST(CAST(round({e}, 2) AS DECIMAL(38,2)) AS VARCHAR), '0$', '')"


def _lst(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_NUMS = ["quantity", "discount", "revenue"]
_NUM_CHUNKS = " UNION ALL ".join(
    f"""SELECT {_COLS.index(c) + 1} AS place, 'col_num_{c}' AS chunk_id, {_lst([c] + retrieval.NUMERIC_WORDS + [c.replace('_', ' ')])} AS keywords,
     'Column ''{c}'' (numeric): min=' || {_dec(f'round_even(min({c}::DOUBLE), 2)')} || ', max=' || {_dec(f'round_even(max({c}::DOUBLE), 2)')} || ', average=' || {_dec(f'round_even(avg({c}::DOUBLE), 2)')}
     || ', median=' || {_dec(f'round_even(quantile_cont({c}::DOUBLE, 0.5), 2)')} || ', std_dev=' || {_dec(f'round_even(stddev_samp({c}::DOUBLE), 2)')}
     || ', null_percent=0.0%, unique_values=' || count(DISTINCT {c}) || '.' AS text FROM k"""
    for c in _NUMS
)
_CAT_CHUNKS = " UNION ALL ".join(
    f"""SELECT {_COLS.index(c) + 1}, 'col_cat_{c}', {_lst([c] + retrieval.CATEGORY_WORDS + [c])} || list(lower(v) ORDER BY rn) FILTER (rn <= 5),
     'Column ''{c}'' (categorical): ' || any_value(d) || ' unique values. Top values: ' || string_agg('''' || v || ''' (' || format('{{:,}}', n) || ')', ', ' ORDER BY rn) FILTER (rn <= 10)
     || '. Null percent=0.0%.' FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rn, count(*) OVER () AS d FROM k GROUP BY {c})"""
    for c in ("region", "segment")
)
CHUNKS = f"""{SALES}, k AS (SELECT {', '.join(_COLS)} FROM sales), pr AS (SELECT round_even(corr(quantity, revenue::DOUBLE), 2) AS qr,
    round_even(corr(quantity, discount), 2) AS qd, round_even(corr(discount, revenue::DOUBLE), 2) AS dr FROM k),
  chunks AS (
   SELECT 0 AS place, 'overview' AS chunk_id, {_lst(retrieval.OVERVIEW_WORDS + ['ecommerce'] + retrieval.GREETING_WORDS)} AS keywords,
     'Dataset overview: ' || format('{{:,}}', count(*)) || ' total records and 6 columns. Domain classification: ecommerce. Available attributes: {', '.join(_COLS)}.' AS text FROM k
   UNION ALL {_NUM_CHUNKS}
   UNION ALL SELECT 1, 'col_date_order_date', {_lst(['order_date'] + retrieval.DATE_WORDS)},
     'Column ''order_date'' (date/time): date range from ' || strftime(min(order_date), '%Y-%m-%d') || ' to ' || strftime(max(order_date), '%Y-%m-%d') || '. Null percent=0.0%.' FROM k
   UNION ALL {_CAT_CHUNKS}
   UNION ALL SELECT 7, 'correlations', {_lst(retrieval.CORRELATION_WORDS + _NUMS)}, 'Significant correlations found: ' || t || '.' FROM (
     SELECT string_agg('''' || x || ''' & ''' || y || ''' (r=' || {_dec('r')} || ')', '; ' ORDER BY o) AS t FROM (
       SELECT 1 AS o, 'quantity' AS x, 'discount' AS y, qd AS r FROM pr UNION ALL SELECT 2, 'quantity', 'revenue', qr FROM pr UNION ALL SELECT 3, 'discount', 'revenue', dr FROM pr) WHERE abs(r) >= 0.4) WHERE t IS NOT NULL
   UNION ALL SELECT 8, 'domain_context', {_lst(retrieval.DOMAIN_WORDS + ['ecommerce'] + retrieval.DOMAIN_VALUE_WORDS + ['revenue', 'quantity'])},
     'Domain context (ecommerce): Primary KPI columns detected: revenue, quantity. Risk/efficiency columns: discount.' FROM (SELECT count(*) AS n FROM k) WHERE n > 0)"""


@query("knowledge_chunks", f"WITH {CHUNKS} SELECT CAST(place AS INTEGER) AS place, chunk_id, array_to_string(keywords, '|') AS keywords, text FROM chunks")
def knowledge_chunks(spark, sf_dir):
    c = retrieval.knowledge_chunks(_known(spark, sf_dir), "ecommerce")
    return c.withColumn("keywords", F.array_join("keywords", "|"))


@query(
    "retrieve_topk",
    f"""WITH {CHUNKS}, {QUESTIONS}, ct AS (SELECT place, token, sum(w) AS weight FROM (
          SELECT place, unnest(list_distinct(keywords)) AS token, 3 AS w FROM chunks
          UNION ALL SELECT place, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> ''))), 1 FROM chunks) GROUP BY ALL),
        qt AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(question), '[?,.]', '', 'g')), '\\s+'), lambda t: t <> ''))) AS token FROM questions),
        s AS (SELECT conv_id, turn, place, CAST(sum(weight) AS BIGINT) AS score FROM qt JOIN ct ON qt.token = ct.token GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, place) AS rank FROM s),
        b AS (SELECT conv_id, turn, place, score, rank FROM r WHERE rank <= 4
              UNION ALL SELECT q.conv_id, q.turn, f.place, 0, f.rank FROM questions q, (SELECT place, row_number() OVER (ORDER BY place) AS rank FROM chunks ORDER BY place LIMIT 3) f
              WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = q.conv_id AND r.turn = q.turn))
        SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM b JOIN chunks ON b.place = chunks.place""",
)
def retrieve_topk(spark, sf_dir):
    chunks = materialise(retrieval.knowledge_chunks(_known(spark, sf_dir), "ecommerce"), "chunks")
    return retrieval.retrieve(question_log(spark, sf_dir), chunks, ["conv_id", "turn"])


@query(
    "suggested_prompts",
    f"""WITH {SALES}, {facts_sql("sales", _TYPES)}, f AS (SELECT count(*) AS n FROM typed WHERE rows > 0),
        p AS (SELECT unnest(['Why did revenue decrease?', 'Which region has the highest revenue?', 'Show top 10 by revenue.', 'Show monthly revenue trend.',
                             'What drives discount the most?', 'How does quantity correlate with discount?', 'Find unusual patterns in the data.']) AS prompt,
                     unnest(range(1, 8)) AS place)
        SELECT CAST(place AS INTEGER) AS place, prompt FROM p, f WHERE n = 6""",
)
def suggested_prompts(spark, sf_dir):
    return retrieval.suggested_questions(profile(_known(spark, sf_dir)), "ecommerce")


# ------------------------------------------------------------------------ SQL

_QUIET_SQL = "''[^'']*(?:''''[^'']*)*''|\"[^\"]*(?:\"\"[^\"]*)*\"|`[^`]*`|--[^\\n]*|/\\*[^*]*\\*+(?:[^/*][^*]*\\*+)*/"


@query(
    "sql_audit",
    f"""WITH {STATEMENTS}, a AS (SELECT conv_id, turn, trim(regexp_replace(statement, '[;\\s]+$', '')) AS cleaned FROM statements),
        b AS (SELECT *, regexp_replace(cleaned, '{_QUIET_SQL}', ' '''' ', 'g') AS code FROM a),
        f AS (SELECT conv_id, turn, upper(regexp_extract(code, '^(?:\\s|\\(|'''')*([A-Za-z_]+)', 1)) AS first_word, regexp_matches(code, ';\\s*\\S') AS is_multiple,
                upper(regexp_extract(code, '(?i)\\b({'|'.join(sqlsurface.FORBIDDEN)})\\b', 1)) AS forbidden_word,
                regexp_matches(lower(cleaned), '{'|'.join(sqlsurface.SUSPICIOUS)}') AS is_suspicious, cleaned = '' AS is_empty FROM b)
        SELECT *, CASE WHEN is_empty THEN 'empty' WHEN is_multiple THEN 'multiple statements' WHEN first_word NOT IN ('SELECT', 'WITH') THEN 'not a read statement'
          WHEN forbidden_word <> '' THEN 'forbidden word' WHEN is_suspicious THEN 'suspicious pattern' ELSE 'safe' END AS verdict FROM f""",
)
def sql_audit(spark, sf_dir):
    return sqlsurface.audit(statement_log(spark, sf_dir)).drop("statement")


def _guarded(name, tables, text, limit=1000, sql=None):
    oracle = sql or text
    for t in tables:
        oracle = oracle.replace(f"probe_{t}", t)

    @query(name, f"{oracle} LIMIT {limit}" if sql is None else oracle)
    def run(spark, sf_dir):
        for t in tables:
            register_view(spark, f"probe_{t}", f"{sf_dir}/{t}.parquet")
        return sqlsurface.guarded_sql(spark, text, limit)


_guarded("sql_safety_limit", ["orders"], "SELECT o_orderkey, o_totalprice AS credit_limit FROM probe_orders ORDER BY o_orderkey")
_guarded(
    "sql_cte", ["orders"],
    """WITH per_customer AS (SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS largest FROM probe_orders GROUP BY o_custkey)
       SELECT orders, count(*) AS customers, max(largest) AS largest FROM per_customer GROUP BY orders ORDER BY orders""",
)
_guarded(
    "sql_window", ["customer"],
    """SELECT c_custkey, c_mktsegment, c_acctbal, place FROM (
         SELECT c_custkey, c_mktsegment, c_acctbal, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM probe_customer) t
       WHERE place <= 10 ORDER BY c_mktsegment, place""",
)
_guarded(
    "sql_subquery", ["part", "lineitem"],
    """SELECT p_brand, count(*) AS parts FROM probe_part
       WHERE p_retailprice > (SELECT avg(p_retailprice) FROM probe_part)
         AND p_partkey IN (SELECT l_partkey FROM probe_lineitem WHERE l_quantity > 45)
       GROUP BY p_brand ORDER BY p_brand""",
)
