"""Completions with real content, derived from ``orders``, through unwrapping, fences and parsing.

Every order gives one raw completion of one of ten shapes: bare JSON, JSON in a marked or plain fence with prose around
it, the chat, text and generated-text envelopes, items that break the contract, no list, no JSON, and nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyho import spec
from tallyho.operators.prompts import explode_recommendations, parse_completions
from tallyho.plans.catalog import _sql_text, _strip_sql, register
from tallyho.sources.tables import read_table

#: Pieces of a completion, written alike in both engines: text, or the columns key, customer, status and priority in braces.
_ITEM = '{"priority": PR, "category": "{status}-{priority}", "action": "call {customer}", "reason": "order {key}", "timeline": "TL"}'
_BODY = '{"recommendations": [' + _ITEM.replace("PR", "1").replace("TL", "1 week") + ", " + \
    _ITEM.replace("PR", "4").replace("TL", "a month") + '], "summary": "see order {key}"}'
_ODD = '{"recommendations": [' + _ITEM.replace("PR", "9").replace("TL", "soon") + \
    ', {"priority": 2, "category": "{status}"}, ' + _ITEM.replace("PR", "3").replace("TL", "later") + "]}"
SHAPES = [
    _BODY,
    "Here it is:\n```json\n" + _BODY + "\n```\nGood luck, {customer}.",
    "```\n" + _BODY + "\n```",
    '{"choices": [{"message": {"content": "ESCAPED"}}]}',
    '{"choices": [{"text": "ESCAPED"}]}',
    '{"generated_text": "ESCAPED"}',
    "  \n" + _ODD + "\n ",
    '{"summary": "nothing for {customer}"}',
    "I would call {customer} about order {key}.",
    "",
]
_NAMES = {"{key}": "o_orderkey", "{customer}": "o_custkey", "{status}": "o_orderstatus", "{priority}": "o_orderpriority"}


def _shape(i: int) -> str:
    escaped = SHAPES[1].replace('"', '\\"').replace("\n", "\\n")
    return SHAPES[i].replace("ESCAPED", escaped)


def _pieces(text: str) -> list[tuple[bool, str]]:
    """(is a column, text or column name) in order."""
    out, at = [], 0
    while at < len(text):
        found = [(text.find(n, at), n) for n in _NAMES if text.find(n, at) >= 0]
        to, name = min(found) if found else (len(text), "")
        if to > at:
            out.append((False, text[at:to]))
        if name:
            out.append((True, _NAMES[name]))
        at = to + len(name)
    return out


def completion() -> Column:
    """The raw completion of an order row."""
    out = F.lit(None).cast("string")
    for i in range(len(SHAPES)):
        parts = [F.col(v).cast("string") if is_column else F.lit(v) for is_column, v in _pieces(_shape(i))]
        out = F.when(F.col("o_orderkey") % len(SHAPES) == i, F.concat(*parts) if parts else F.lit("")).otherwise(out)
    return out


def _completion_sql() -> str:
    whens = []
    for i in range(len(SHAPES)):
        parts = [f"CAST({v} AS VARCHAR)" if is_column else _sql_text(v) for is_column, v in _pieces(_shape(i))]
        whens.append(f"WHEN {i} THEN {' || '.join(parts) or _sql_text('')}")
    return f"CASE o_orderkey % {len(SHAPES)} {' '.join(whens)} END"


def _parsed_ctes() -> str:
    paths = ("$.choices[0].message.content", "$.choices[0].text", "$.generated_text", "$.text")
    unwrapped = "CASE WHEN json_valid(raw) THEN coalesce(" + ", ".join(f"json_extract_string(raw, '{p}')" for p in paths) + ", raw) ELSE raw END"
    inside = f"""CASE WHEN content LIKE '%```json%' THEN {_strip_sql("split_part(split_part(content, '```json', 2), '```', 1)")}
              WHEN content LIKE '%```%' THEN {_strip_sql("split_part(content, '```', 2)")} ELSE content END"""
    return f"""WITH o AS (SELECT o_orderkey, {_completion_sql()} AS raw FROM orders),
u AS (SELECT o_orderkey, {unwrapped} AS content FROM o),
t AS (SELECT o_orderkey, {_strip_sql('content')} AS content FROM u),
i AS (SELECT *, {inside} AS inner_text FROM t),
s AS (SELECT *, CASE WHEN length(content) = 0 THEN 'fallback_error' WHEN NOT json_valid(inner_text) THEN 'fallback_invalid_json'
                     WHEN json_type(inner_text, '$.recommendations') IS DISTINCT FROM 'ARRAY' THEN 'fallback_error' ELSE 'ok' END AS status
      FROM i)"""


def _recommendations_sql() -> str:
    has_keys = " AND ".join(f"json_exists(x, '$.{k}')" for k in spec.RECOMMENDATION_KEYS)
    picked = ", ".join(f"json_extract_string(r, '$.{k}') AS {k}" for k in spec.RECOMMENDATION_KEYS if k != "priority")
    fallback = "\n".join(
        f"UNION ALL SELECT o_orderkey, status, 1, CAST({v['priority']} AS BIGINT), " + ", ".join(
            _sql_text(v[k]) for k in spec.RECOMMENDATION_KEYS if k != "priority") + f" FROM s WHERE status = '{status}'"
        for status, v in (("fallback_invalid_json", spec.FALLBACK_INVALID_JSON), ("fallback_error", spec.FALLBACK_OTHER)))
    return f"""{_parsed_ctes()},
k AS (SELECT o_orderkey, status, list_filter(CAST(json_extract(inner_text, '$.recommendations') AS JSON[]), lambda x: {has_keys}) AS recs
      FROM s WHERE status = 'ok'),
x AS (SELECT o_orderkey, status, CAST(generate_subscripts(recs, 1) AS INTEGER) AS position, unnest(recs) AS r FROM k),
rows AS (SELECT o_orderkey, status, position, TRY_CAST(json_extract(r, '$.priority') AS BIGINT) AS priority, {picked} FROM x
{fallback})
SELECT *, CAST((CASE WHEN priority IS NULL OR priority < 1 OR priority > 5 THEN 1 ELSE 0 END)
  + (category IS NULL)::INT + (action IS NULL)::INT + (reason IS NULL)::INT + (timeline IS NULL)::INT AS INTEGER) AS n_violations
FROM rows"""


def _parsed(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    return parse_completions(orders.select("o_orderkey", completion().alias("completion")), envelope=True)


@register("completion_contents", f"""{_parsed_ctes()}
SELECT o_orderkey, status, CASE status WHEN 'fallback_invalid_json' THEN {_sql_text(spec.FALLBACK_INVALID_JSON['summary'])}
    WHEN 'fallback_error' THEN {_sql_text(spec.FALLBACK_OTHER['summary'])}
    ELSE coalesce(json_extract_string(inner_text, '$.summary'), {_sql_text(spec.DEFAULT_SUMMARY)}) END AS summary FROM s""")
def q_contents(spark, sf_dir):
    """Status and summary of completions in envelopes, fences and prose."""
    return _parsed(spark, sf_dir).select("o_orderkey", "status", "summary")


@register("completion_recommendations", _recommendations_sql())
def q_recommendations(spark, sf_dir):
    """The recommendations inside them, with their contract violations."""
    x = explode_recommendations(_parsed(spark, sf_dir), ["o_orderkey"])
    return x.select("o_orderkey", "status", F.col("position").cast("int").alias("position"), *spec.RECOMMENDATION_KEYS,
                    F.size("violations").cast("int").alias("n_violations"))
