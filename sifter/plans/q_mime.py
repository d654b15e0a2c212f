"""Registered raw-payload queries (S2-S5): headers, malformed rows, MIME tree, base64url."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions import constants as K
from sifter.plans import oracle as O
from sifter.plans.catalog import register
from sifter.sources import mime as M
from sifter.sources.fixtures import Fixtures, raw_payloads


def _b64(x: str) -> str:
    return f"replace(replace(to_base64(encode({x})), '+', '-'), '/', '_')"


def _leaf(mime: str, text: str) -> str:
    return f"json_object('mimeType', '{mime}', 'body', json_object('data', {_b64(text)}))"


SQL_RAW = ("raw", f"""
SELECT id, ord, json_object('snippet', snippet, 'payload', json_object('mimeType', 'multipart/mixed', 'headers', headers,
  'parts', CASE WHEN ord % 40 = 9
                THEN concat(repeat('[{{"mimeType":"multipart/mixed","parts":', 12), parts, repeat('}}]', 12))::JSON
                ELSE parts::JSON END))::VARCHAR AS payload_json
FROM (
SELECT id, ord, snippet,
  CASE WHEN ord % 50 <> 7 THEN list_concat(
      [json_object('name', 'Subject', 'value', subject), json_object('name', 'From', 'value', sender),
       json_object('name', 'Date', 'value', strftime(to_timestamp(received_epoch), '%a, %d %b %Y %H:%M:%S +0000'))],
      CASE WHEN ord % 5 = 0 THEN [json_object('name', 'SUBJECT', 'value', concat('Re: ', subject))] ELSE [] END) END AS headers,
  to_json(list_concat(
      [json_object('mimeType', 'multipart/alternative', 'parts',
          CASE WHEN body_html <> '' THEN [{_leaf('text/plain', 'body_text')}, {_leaf('text/html', 'body_html')}]
               ELSE [{_leaf('text/plain', 'body_text')}] END)],
      CASE WHEN ord % 4 = 0 THEN [json_object('mimeType', 'application/pdf', 'body', json_object('data', 'JVBERi0xLjQK'))]
           ELSE [] END,
      CASE WHEN ord % 3 = 0 THEN [{_leaf('text/plain', "concat('-- sent to reader ', id)")}] ELSE [] END))::VARCHAR AS parts
FROM messages)""")

SQL_HDR = [
    ("hp", """SELECT id, json_extract(payload_json, '$.payload.headers') AS h,
                     json_extract_string(payload_json, '$.snippet') AS snippet FROM raw"""),
    ("okh", """SELECT * FROM hp WHERE coalesce(json_type(h) = 'ARRAY' AND list_bool_and(list_transform(
                 json_extract(h, '$[*]'), lambda e: json_type(e) = 'OBJECT' AND json_extract(e, '$.name') IS NOT NULL
                 AND json_extract(e, '$.value') IS NOT NULL)), false)"""),
    ("hv", """SELECT id, lower(json_extract_string(e, '$.name')) AS name, json_extract_string(e, '$.value') AS value, i
              FROM (SELECT id, unnest(json_extract(h, '$[*]')) AS e, generate_subscripts(json_extract(h, '$[*]'), 1) AS i
                    FROM okh)"""),
    ("hm", """SELECT id, name, arg_max(value, i) AS value FROM hv GROUP BY id, name"""),
]


def sql_decode(d: str) -> str:
    return f"decode(from_base64(regexp_replace(replace(replace({d}, '-', '+'), '_', '/'), '[^A-Za-z0-9+/=]', '', 'g')))"


SQL_WALK = [
    ("walk", """
SELECT id, []::INTEGER[] AS path, json_extract(payload_json, '$.payload') AS node FROM raw
UNION ALL
SELECT id, list_append(path, CAST(i AS INTEGER)), json_extract(node, concat('$.parts[', i, ']'))
FROM (SELECT id, path, node, unnest(range(CAST(coalesce(json_array_length(node, '$.parts'), 0) AS BIGINT))) AS i FROM walk)"""),
    ("nodes", """SELECT id, path, coalesce(json_extract_string(node, '$.mimeType'), '') AS mime,
                        coalesce(json_extract_string(node, '$.body.data'), '') AS data FROM walk"""),
    ("leaves", f"""SELECT id, path, mime, {sql_decode('data')} AS text FROM nodes
                   WHERE mime IN ('text/html', 'text/plain') AND data <> ''"""),
]


def raw(fx: Fixtures) -> DataFrame:
    return raw_payloads(fx.messages())


@register("parse_headers", O.compose([SQL_RAW, *SQL_HDR], f"""
SELECT okh.id,
       coalesce((SELECT value FROM hm WHERE hm.id = okh.id AND name = 'subject'), {O.q(K.DEFAULT_SUBJECT)}) AS subject,
       coalesce((SELECT value FROM hm WHERE hm.id = okh.id AND name = 'from'), {O.q(K.DEFAULT_SENDER)}) AS sender,
       coalesce((SELECT value FROM hm WHERE hm.id = okh.id AND name = 'date'), '') AS date,
       coalesce(okh.snippet, '') AS snippet
FROM okh"""))
def q_parse_headers(fx: Fixtures) -> DataFrame:
    """Subject / from / date / snippet from raw payloads (last duplicate header wins)."""
    return M.parse_headers(raw(fx))


@register("drop_malformed", O.compose([SQL_RAW, *SQL_HDR],
    "SELECT raw.id, okh.id IS NULL AS malformed FROM raw LEFT JOIN okh ON okh.id = raw.id"))
def q_drop_malformed(fx: Fixtures) -> DataFrame:
    """S3: which payloads are dropped (headers missing or not a list of objects)."""
    v = M.with_variant(raw(fx))
    return v.select("id", (~M.well_formed(F.col("_msg"))).alias("malformed"))


@register("flatten_mime", O.compose([SQL_RAW, *SQL_WALK], """
SELECT r.id,
       coalesce((SELECT string_agg(text, chr(10) ORDER BY path) FROM leaves l WHERE l.id = r.id AND mime = 'text/html'), '')
         AS body_html,
       coalesce((SELECT string_agg(text, chr(10) ORDER BY path) FROM leaves l WHERE l.id = r.id AND mime = 'text/plain'), '')
         AS body_text,
       (SELECT count(*) FROM nodes n WHERE n.id = r.id) AS n_parts
FROM raw r""", recursive=True))
def q_flatten_mime(fx: Fixtures) -> DataFrame:
    """Decoded HTML and text bodies of every payload (pre-order, newline-joined)."""
    return M.flatten_mime(raw(fx)).select("id", "body_html", "body_text", F.col("n_parts").cast("long").alias("n_parts"))


@register("decode_base64url", O.compose([SQL_RAW, *SQL_WALK],
    "SELECT id, array_to_string(path, '.') AS path, mime, text FROM leaves", recursive=True))
def q_decode_base64url(fx: Fixtures) -> DataFrame:
    """Every text part decoded from URL-safe base64."""
    return M.decoded_parts(raw(fx))
