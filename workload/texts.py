"""Text-column queries: payloads, repair, override notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.notes import parse_overrides
from tabloom.functions.payload import extract_json_payload, parse_payload, repair_json
from workload.registry import query, table

# Replies around the JSON of an event: bare, fenced, with talk, without JSON.
REPLY = """CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '```json\n' || props || '\n```'
  WHEN 2 THEN 'Here it is: ' || props || ' - done.' WHEN 3 THEN '```\nnothing\n```' ELSE '  ' || event_type || ' ' END"""


def replies(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "props", f"{REPLY} AS reply")


PAYLOAD_SQL = """SELECT event_id, CASE WHEN event_id % 5 < 3 THEN props WHEN event_id % 5 = 3 THEN 'nothing' ELSE event_type END AS payload
  FROM events"""


@query("extract_payload", PAYLOAD_SQL)
def extract_payload(spark, sf):
    return replies(spark, sf).select("event_id", extract_json_payload(F.col("reply")).alias("payload"))


@query(
    "parse_payload",
    f"""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN (json_extract_string(payload_json, '$.k'))::BIGINT END AS k,
      event_id % 5 < 3 AS ok, CASE WHEN event_id % 5 >= 3 THEN left(payload, 200) END AS preview
    FROM (SELECT *, CASE WHEN event_id % 5 < 3 THEN payload END AS payload_json FROM ({PAYLOAD_SQL}) p) q""",
)
def parse(spark, sf):
    rows = replies(spark, sf).select("event_id", extract_json_payload(F.col("reply")).alias("payload"))
    return parse_payload(rows, "payload", "k bigint").select("event_id", F.col("parsed.k").alias("k"), "ok", "preview")


# Broken records: last brace lost, array never closed, trailing comma, 1 to 8 arrays open at once before a further key
# or at the end, a long key after them, beyond repair.
LONG_KEY = "repeat('key ', 40)"
OPEN = "repeat('[', event_id % 8 + 1)"
CLOSE = "repeat(']', event_id % 8 + 1)"
BROKEN = f"""CASE event_id % 8 WHEN 0 THEN props
  WHEN 1 THEN left(props, length(props) - 1)
  WHEN 2 THEN '{{"tags": ["' || event_type || '", ' || substr(props, 2)
  WHEN 3 THEN left(props, length(props) - 1) || ', "v": [1, 2,'
  WHEN 4 THEN '{{"deep": ' || {OPEN.replace('event_id', '(event_id div 8)')} || '1, 2, "' || {LONG_KEY} || '": ' || props || '}}'
  WHEN 5 THEN '{{"deep": ' || {OPEN.replace('event_id', '(event_id div 8)')} || '"a", 2'
  WHEN 6 THEN '{{"a": [{{"b": [[1, 2], [3, "c": ' || user_id || '}}], "d": [4'
  ELSE props || ' ' || event_type END"""
MENDED = f"""CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN props
  WHEN 2 THEN '{{"tags": ["' || event_type || '"], ' || substr(props, 2)
  WHEN 3 THEN left(props, length(props) - 1) || ', "v": [1, 2]}}'
  WHEN 4 THEN '{{"deep": ' || {OPEN.replace('event_id', '(event_id // 8)')} || '1, 2' || {CLOSE.replace('event_id', '(event_id // 8)')} || ', "' || {LONG_KEY} || '": ' || props || '}}'
  WHEN 5 THEN '{{"deep": ' || {OPEN.replace('event_id', '(event_id // 8)')} || '"a", 2' || {CLOSE.replace('event_id', '(event_id // 8)')} || '}}'
  WHEN 6 THEN '{{"a": [{{"b": [[1, 2], [3]], "c": ' || user_id || '}}], "d": [4]}}'
  ELSE props || ' ' || event_type END"""


@query(
    "repair_json",
    f"SELECT event_id, {MENDED} AS repaired, event_id % 8 = 0 AS was_valid, event_id % 8 <> 7 AS is_valid FROM events",
)
def repair(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", f"{BROKEN} AS body")
    return repair_json(rows, "body").select("event_id", "repaired", "was_valid", "is_valid")


NOTE = r"""'user: ' || user_id || ', kind: ' || event_type || '\n flag: ' || CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'false' END
  || ', user: ' || (user_id + 1) || ', rate: 1.5e-' || (event_id % 4 + 1) || ', empty: , plain text'"""


@query(
    "parse_overrides",
    """SELECT event_id, 'user' AS key, 'int' AS kind, (user_id + 1)::VARCHAR AS value, NULL::BOOLEAN AS bool_value,
        (user_id + 1)::BIGINT AS int_value, NULL::DOUBLE AS float_value FROM events
    UNION ALL SELECT event_id, 'kind', 'string', event_type, NULL, NULL, NULL FROM events
    UNION ALL SELECT event_id, 'flag', 'bool', CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'false' END, event_id % 2 = 0, NULL, NULL FROM events
    UNION ALL SELECT event_id, 'rate', 'float', '1.5e-' || (event_id % 4 + 1), NULL, NULL, ('1.5e-' || (event_id % 4 + 1))::DOUBLE FROM events""",
)
def overrides(spark, sf):
    """A repeated key keeps its last value; empty values and plain text are skipped."""
    rows = table(spark, sf, "events").selectExpr("event_id", f"{NOTE} AS note")
    found = parse_overrides(rows, "note").drop("note")
    return found.withColumn("int_value", F.col("int_value").cast("bigint"))
