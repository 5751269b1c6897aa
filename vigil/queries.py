"""Named queries over the driver's tables, each a rule or set of rules, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.engine import Engine
from vigil.operators.output import detections
from vigil.plans.pipeline import Pipeline, bundled
from vigil.plans.validate import Validator
from vigil.sources.catalog import Catalog
from vigil.sources.rules import Collection
from vigil.streaming.detect import run_once, stream_correlation, stream_matches

Query = Callable[[SparkSession, str], DataFrame]

IP = "concat('10.', (user_id * 7) % 256, '.', (event_id * 31) % 256, '.', event_id % 256)"
IP6 = "concat('2001:db8:', substring(md5(CAST(user_id AS STRING)), 1, 4), '::', substring(md5(CAST(event_id AS STRING)), 1, 4))"
HASH = "concat('MD5=', md5(CAST(user_id AS STRING)), ',EXTRA=1')"
DASHED = "concat(event_type, CASE user_id % 3 WHEN 0 THEN ' -' WHEN 1 THEN ' /' ELSE ' +' END, 'mode ', user_id % 5)"
CODED = "base64(CAST(concat(substring('abc', 1, CAST(user_id % 3 AS INT)), event_type, '!') AS BINARY))"
LE16 = "regexp_replace(event_type, '(.)', concat('$1', char(0)))"
BE16 = "regexp_replace(event_type, '(.)', concat(char(0), '$1'))"
SQL_IP = "('10.' || (user_id * 7) % 256 || '.' || (event_id * 31) % 256 || '.' || event_id % 256)"
SQL_DASHED = "(event_type || CASE user_id % 3 WHEN 0 THEN ' -' WHEN 1 THEN ' /' ELSE ' +' END || 'mode ' || user_id % 5)"
SQL_CODED = "to_base64((substring('abc', 1, CAST(user_id % 3 AS INT)) || event_type || '!')::BLOB)"


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    def table(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    out = Catalog()
    out.add(
        table("events"), product="app", service="events", name="events", time="ts", json_columns=("props",), keyword_columns=("event_type", "props"),
        derived={"ip": (IP, "string"), "dashed": (DASHED, "string"), "coded": (CODED, "string"), "ip6": (IP6, "string"), "hash": ("md5(CAST(user_id AS STRING))", "string"), "flagged": ("user_id % 2 = 0", "boolean"), "words": ("array(event_type, CAST(user_id AS STRING))", "array<string>"), "le16": (f"concat(char(255), char(254), {LE16})", "string"), "be16": (BE16, "string")},
    )
    out.add(table("orders"), category="sales", service="orders", name="orders", time="o_orderdate")
    out.add(table("lineitem"), category="sales", service="lineitem", name="lineitem", time="l_shipdate")
    out.add(table("part"), category="catalog", name="part")
    out.add(table("customer"), category="crm", name="customer", keyword_columns=("c_name", "c_mktsegment"))
    out.add(table("documents"), category="text", name="documents", keyword_columns=("text",))
    out.add(table("pages"), category="web", name="pages", keyword_columns=("url", "html"))
    out.add(table("conversations"), category="chat", name="conversations", keyword_columns=("text",))
    return out


SOURCES = {
    "events": "{product: app, service: events}",
    "orders": "{category: sales, service: orders}",
    "lineitem": "{category: sales, service: lineitem}",
    "part": "{category: catalog}",
    "customer": "{category: crm}",
    "documents": "{category: text}",
    "pages": "{category: web}",
    "conversations": "{category: chat}",
}
KEYS = {
    "events": ["event_id", "user_id", "event_type"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "part": ["p_partkey"],
    "customer": ["c_custkey"],
    "documents": ["doc_id"],
    "pages": ["page_id"],
    "conversations": ["conv_id", "turn"],
}


@dataclass
class Spec:
    """A rule on one table; ``where`` is what it means in SQL."""

    table: str
    detection: str
    where: str
    pipeline: str = ""
    extra: str = ""  # further documents, such as filters

    def rules(self, name: str) -> str:
        body = "\n".join("  " + line for line in self.detection.strip().splitlines())
        return f"title: {name}\nname: {name}\nlogsource: {SOURCES[self.table]}\nfields: [{', '.join(KEYS[self.table])}]\ndetection:\n{body}\n" + self.extra

    def query(self, name: str) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            engine = Engine(spark, catalog(spark, sf_dir), Pipeline.from_yaml(self.pipeline) if self.pipeline else Pipeline())
            collection = Collection.from_yaml(self.rules(name))
            return engine.matches(collection[0])[0]

        return run

    def sql(self) -> str:
        return f"SELECT {', '.join(KEYS[self.table])} FROM {self.table} WHERE {self.where}"


def one(item: str) -> str:
    return f"sel: {{{item}}}\ncondition: sel"


EXTRA = "{type: add_condition, conditions: {user_id|lt: 75}"

SPECS: dict[str, Spec] = {
    # leaf predicates
    "eq_string": Spec("events", one("event_type: ERROR"), "lower(event_type) = 'error'"),
    "eq_cased": Spec("events", one("event_type|cased: error"), "event_type = 'error'"),
    "cased_prefix": Spec("part", one("p_type|cased|startswith: S"), "starts_with(p_type, 'S')"),
    "startswith": Spec("part", one("p_name|startswith: P"), "starts_with(lower(p_name), 'p')"),
    "endswith": Spec("part", one("p_name|endswith: '7'"), "ends_with(lower(p_name), '7')"),
    "contains": Spec("part", one("p_type|contains: R"), "contains(lower(p_type), 'r')"),
    "contains_all": Spec("part", one("p_name|contains|all: [p, '1']"), "contains(lower(p_name), 'p') AND contains(lower(p_name), '1')"),
    "wildcard_match": Spec("customer", one("c_name: 'customer*1?'"), "lower(c_name) LIKE 'customer%1_'"),
    "wildcard_any": Spec("customer", one("c_mktsegment: '*'"), "c_mktsegment IS NOT NULL"),
    "eq_number": Spec("part", one("p_size: 15"), "p_size = 15"),
    "in_numbers": Spec("part", one("p_size: [1, 7, 49]"), "p_size IN (1, 7, 49)"),
    "in_strings": Spec("events", one("event_type: [Error, CLICK]"), "lower(event_type) IN ('error', 'click')"),
    "number_on_string": Spec("events", one("props.k: 12"), "try_cast(json_extract_string(props, '$.k') AS DOUBLE) = 12"),
    "string_on_number": Spec("part", one("p_size: '15'"), "p_size = 15"),
    "bool_field": Spec("events", one("flagged: true"), "user_id % 2 = 0"),
    "regex": Spec("pages", one("url|re: '^https?://[^/]+/.*[0-9]$'"), "regexp_matches(url, '^https?://[^/]+/.*[0-9]$')"),
    "regex_ignorecase": Spec("part", one("p_name|re|i: 'PART.*[13579]$'"), "regexp_matches(p_name, 'PART.*[13579]$', 'i')"),
    "regex_dotall": Spec("documents", one(r"text|re|m|s: '^the.*\.$'"), r"regexp_matches(text, '(?ms)^the.*\.$')"),
    "regex_contains": Spec("events", one("event_type|re: 'r.o'"), "regexp_matches(event_type, 'r.o')"),
    "cidr_v4": Spec("events", one("ip|cidr: 10.0.0.0/9"), f"CAST(split_part({SQL_IP}, '.', 2) AS INT) < 128"),
    "cidr_v4_list": Spec("events", one("ip|cidr: [10.7.0.0/16, 10.14.128.0/17]"), f"{SQL_IP} LIKE '10.7.%' OR ({SQL_IP} LIKE '10.14.%' AND CAST(split_part({SQL_IP}, '.', 3) AS INT) >= 128)"),
    "cidr_v6": Spec("events", one("ip6|cidr: '2001:db8:8000::/33'"), "ascii(substring(md5(CAST(user_id AS VARCHAR)), 1, 1)) >= ascii('8')"),
    "compare_gte": Spec("lineitem", one("l_quantity|gte: 45"), "l_quantity >= 45"),
    "compare_gt": Spec("lineitem", one("l_extendedprice|gt: 60000.5"), "l_extendedprice > 60000.5"),
    "compare_lt": Spec("lineitem", one("l_discount|lt: 0.02"), "l_discount < 0.02"),
    "compare_lte": Spec("lineitem", one("l_tax|lte: 0.01"), "l_tax <= 0.01"),
    "compare_json": Spec("events", one("props.k|gte: 50"), "try_cast(json_extract_string(props, '$.k') AS DOUBLE) >= 50"),
    "field_equals_field": Spec("orders", one("o_orderkey|fieldref: o_custkey"), "o_orderkey = o_custkey"),
    "field_startswith_field": Spec("orders", one("o_orderkey|fieldref|startswith: o_custkey"), "starts_with(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR))"),
    "field_endswith_field": Spec("orders", one("o_orderkey|fieldref|endswith: o_custkey"), "ends_with(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR))"),
    "field_contains_field": Spec("orders", one("o_orderkey|fieldref|contains: o_custkey"), "contains(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR))"),
    "null_value": Spec("events", one("props.missing: null"), "json_extract_string(props, '$.missing') IS NULL"),
    "exists": Spec("events", one("props.k|exists: true"), "json_extract_string(props, '$.k') IS NOT NULL"),
    "not_exists": Spec("events", one("nowhere|exists: false"), "true"),
    "array_any": Spec("events", one("words|startswith: '4'"), "starts_with(event_type, '4') OR starts_with(CAST(user_id AS VARCHAR), '4')"),
    "keywords": Spec("documents", "kw: [license, '*stupid*']\ncondition: kw", "contains(lower(text), 'license') OR contains(lower(text), 'stupid')"),
    "keyword_number": Spec("events", "kw: [69]\ncondition: kw", "contains(event_type, '69') OR contains(props, '69')"),
    "keyword_regex": Spec("pages", "kw:\n  '|re': '<h[12][^>]*>'\ncondition: kw", "regexp_matches(url, '<h[12][^>]*>') OR regexp_matches(html, '<h[12][^>]*>')"),
    # timestamp parts
    "ts_minute": Spec("events", one("ts|minute: 30"), "minute(ts) = 30"),
    "ts_hour": Spec("events", one("ts|hour|gte: 20"), "hour(ts) >= 20"),
    "ts_day": Spec("events", one("ts|day: 13"), "day(ts) = 13"),
    "ts_week": Spec("events", one("ts|week|lte: 2"), "weekofyear(ts) <= 2"),
    "ts_month": Spec("orders", one("o_orderdate|month: [1, 12]"), "month(o_orderdate) IN (1, 12)"),
    "ts_year": Spec("orders", one("o_orderdate|year|gt: 1995"), "year(o_orderdate) > 1995"),
    # modifiers of text
    "base64": Spec("events", one("coded|base64|startswith: err"), f"starts_with(lower({SQL_CODED}), lower(to_base64('err'::BLOB)))"),
    "base64offset": Spec("events", one("coded|base64offset|contains: rchase"), f"contains(lower({SQL_CODED}), 'cmnoyxnl') OR contains(lower({SQL_CODED}), 'jjagfzz') OR contains(lower({SQL_CODED}), 'yy2hhc2')"),
    "windash": Spec("events", one("dashed|windash|contains: ' -mode 2'"), f"contains({SQL_DASHED}, ' -mode 2') OR contains({SQL_DASHED}, ' /mode 2')"),
    "wide": Spec("events", one("event_type|wide|contains: er"), "contains(event_type, 'e' || chr(0) || 'r' || chr(0))"),
    "neq": Spec("events", one("event_type|neq: error"), "NOT coalesce(lower(event_type) = 'error', false)"),
    "neq_list": Spec("events", one("event_type|neq: [error, view]"), "NOT coalesce(lower(event_type) IN ('error', 'view'), false)"),
    # conditions
    "and_or_not": Spec("events", "a: {event_type: error}\nb: {value|gte: 50}\nc: {user_id|lt: 20}\ncondition: a and not b or b and c", "(event_type = 'error' AND NOT coalesce(value >= 50, false)) OR (value >= 50 AND user_id < 20)"),
    "one_of_them": Spec("events", "a: {event_type: error}\nb: {value|lt: 3}\n_c: {user_id: 1}\ncondition: 1 of them", "event_type = 'error' OR value < 3"),
    "all_of_pattern": Spec("events", "sel_a: {event_type: purchase}\nsel_b: {value|gte: 20}\nother: {user_id: 1}\ncondition: all of sel_*", "event_type = 'purchase' AND value >= 20"),
    "list_of_maps": Spec("events", "sel:\n  - {event_type: error, value|gte: 50}\n  - {event_type: click, value|lt: 5}\ncondition: sel", "(event_type = 'error' AND value >= 50) OR (event_type = 'click' AND value < 5)"),
    "not_selection": Spec("customer", "sel: {c_mktsegment: building}\nlow: {c_acctbal|lt: 0}\ncondition: not 1 of sel* and not low", "NOT coalesce(lower(c_mktsegment) = 'building', false) AND NOT coalesce(c_acctbal < 0, false)"),
    # filters and pipelines
    "rule_filter": Spec("events", one("event_type: error"), "event_type = 'error' AND NOT (user_id < 50)", extra="---\ntitle: f\nlogsource: {product: app}\nfilter:\n  rules: [rule_filter]\n  low: {user_id|lt: 50}\n  condition: not low\n"),
    "field_mapping": Spec("events", one("Type: error"), "event_type = 'error'", "transformations: [{type: field_name_mapping, mapping: {Type: event_type}}]"),
    "field_mapping_multi": Spec("customer", one("name|contains: '99'"), "contains(lower(c_name), '99') OR contains(lower(c_mktsegment), '99')", "transformations: [{type: field_name_mapping, mapping: {name: [c_name, c_mktsegment]}}]"),
    "field_prefix_mapping": Spec("events", one("log.type: click"), "event_type = 'click'", "transformations: [{type: field_name_prefix_mapping, mapping: {log.: event_}}]"),
    "field_prefix_suffix": Spec("events", one("typ: view"), "event_type = 'view'", "transformations: [{type: field_name_prefix, prefix: event_}, {type: field_name_suffix, suffix: e, field_name_conditions: [{type: include_fields, fields: [event_typ]}]}, {type: set_field, fields: [event_id, user_id, event_type]}]"),
    "add_condition": Spec("events", one("event_type: error"), "event_type = 'error' AND NOT coalesce(user_id IN (1, 2, 3), false)", "transformations: [{type: add_condition, negated: true, conditions: {user_id: [1, 2, 3]}, rule_conditions: [{type: logsource, product: app}]}]"),
    "drop_item": Spec("events", one("event_type: error, user_id: 4"), "event_type = 'error'", "transformations: [{type: drop_detection_item, field_name_conditions: [{type: include_fields, fields: [user_id]}]}]"),
    "value_placeholders": Spec("events", one("event_type|expand: '%kinds%'"), "event_type IN ('signup', 'purchase')", "vars: {kinds: [signup, purchase]}\ntransformations: [{type: value_placeholders}]"),
    "wildcard_placeholders": Spec("customer", one("c_name|expand: 'customer%any%7'"), "lower(c_name) LIKE 'customer%7'", "transformations: [{type: wildcard_placeholders}]"),
    "query_placeholders": Spec("events", one("user_id|expand: '%vip%'"), "user_id % 10 = 3", "transformations: [{type: query_expression_placeholders, expression: '{field} % 10 = {id}', mapping: {vip: '3'}}]"),
    "map_string": Spec("events", one("event_type: [fail, open]"), "event_type IN ('error', 'view', 'click')", "transformations: [{type: map_string, mapping: {fail: error, open: [view, click]}}]"),
    "replace_string": Spec("events", one("event_type: evt-error"), "event_type = 'error'", "transformations: [{type: replace_string, regex: '^evt-', replacement: ''}]"),
    "to_regex": Spec("customer", one("c_mktsegment: 'b*g'"), "lower(c_mktsegment) LIKE 'b%g'", "transformations: [{type: regex, method: ignore_case_brackets}]"),
    "set_and_convert_value": Spec("part", one("p_size: 'x'"), "p_size = 15", "transformations: [{type: set_value, value: '15'}, {type: convert_type, target_type: num}]"),
    "case_value": Spec("events", one("event_type|cased: ERROR"), "event_type = 'error'", "transformations: [{type: case, method: lower}]"),
    "hashes_fields": Spec("events", one("Hashes: 'MD5=c4ca4238a0b923820dcc509a6f75849b,IMPHASH=1'"), "md5(CAST(user_id AS VARCHAR)) = 'c4ca4238a0b923820dcc509a6f75849b'", "transformations: [{type: hashes_fields, valid_hash_algos: [MD5, IMPHASH], field_prefix: h}, {type: field_name_mapping, mapping: {hMD5: hash}}, {type: drop_detection_item, field_name_conditions: [{type: include_fields, fields: [hIMPHASH]}]}]"),
    "extract_fields": Spec("events", one("both: ['error:7', 'click:8']"), "(event_type = 'error' AND user_id = 7) OR (event_type = 'click' AND user_id = 8)", "transformations: [{type: extract_fields, regex: '(?P<event_type>[a-z]+):(?P<user_id>[0-9]+)'}]"),
    "change_logsource": Spec("customer", one("event_type: error"), "event_type = 'error'", "transformations: [{type: change_logsource, product: app, service: events}, {type: set_field, fields: [event_id, user_id, event_type]}]"),
    "state_table": Spec("customer", one("event_type: error"), "event_type = 'error'", "transformations: [{type: set_state, key: table, val: events}, {type: set_field, fields: [event_id, user_id, event_type]}]"),
    "nested_pipeline": Spec("events", one("Type: ERR"), "event_type = 'error'", "transformations: [{type: nest, items: [{type: field_name_mapping, mapping: {Type: event_type}}, {type: map_string, mapping: {ERR: error}}]}]"),
    "condition_expression": Spec("events", one("event_type: error"), "event_type = 'error' AND user_id >= 100", "transformations: [{type: add_condition, conditions: {user_id|gte: 100}, rule_conditions: {a: {type: logsource, product: app}, b: {type: contains_field, field: nothing}}, rule_cond_expr: a and not b}]"),
    "utf16": Spec("events", one("le16|utf16|startswith: er"), "starts_with(event_type, 'er')"),
    "utf16be": Spec("events", one("be16|utf16be|contains: rro"), "contains(event_type, 'rro')"),
    "cidr_v4_host": Spec("events", one("ip|cidr: [10.7.31.1/32, 10.64.0.0/10]"), f"{SQL_IP} = '10.7.31.1' OR CAST(split_part({SQL_IP}, '.', 2) AS INT) BETWEEN 64 AND 127"),
    "cidr_v4_octets": Spec("events", one("ip|cidr: 10.14.0.0/16"), f"{SQL_IP} LIKE '10.14.%'"),
    "empty_selector": Spec("events", "sel: {event_type: error}\n_a: {user_id: 1}\ncondition: sel and not 1 of x*", "event_type = 'error'"),
    "filter_hidden_names": Spec("events", one("event_type: error"), "event_type = 'error'", extra="---\ntitle: f\nlogsource: {product: app}\nfilter:\n  rules: [filter_hidden_names]\n  _low: {user_id|lt: 50}\n  condition: not 1 of them\n"),
    "filter_and_hidden_selectors": Spec("events", "_a: {event_type: error}\n_b: {value|gte: 20}\ncondition: all of _*", "event_type = 'error' AND value >= 20 AND user_id >= 50", extra="---\ntitle: f\nlogsource: {product: app}\nfilter:\n  rules: any\n  low: {user_id|lt: 50}\n  condition: not low\n"),
    "hashes_of_unknown_kinds": Spec("events", one("Hashes: ['MD5=c4ca4238a0b923820dcc509a6f75849b', 'BLAKE9=1']"), "md5(CAST(user_id AS VARCHAR)) = 'c4ca4238a0b923820dcc509a6f75849b'", "transformations: [{type: hashes_fields, valid_hash_algos: [MD5], field_prefix: h}, {type: field_name_mapping, mapping: {hMD5: hash}}]"),
    # conditions of pipelines
    "when_field": Spec("events", one("event_type: error"), "event_type = 'error' AND user_id < 75", f"transformations: [{EXTRA}, rule_conditions: [{{type: contains_field, field: event_type}}]}}]"),
    "when_no_field": Spec("events", one("event_type: error"), "event_type = 'error'", f"transformations: [{EXTRA}, rule_conditions: [{{type: contains_field, field: value}}]}}]"),
    "when_item": Spec("events", one("event_type: error"), "event_type = 'error' AND user_id < 75", f"transformations: [{EXTRA}, rule_conditions: [{{type: contains_detection_item, field: event_type, value: error}}]}}]"),
    "when_applied": Spec("events", one("Type: error"), "event_type = 'error' AND user_id < 75", f"transformations: [{{id: named, type: field_name_mapping, mapping: {{Type: event_type}}}}, {EXTRA}, rule_conditions: [{{type: processing_item_applied, processing_item_id: named}}]}}]"),
    "when_state": Spec("events", one("event_type: error"), "event_type = 'error' AND user_id < 75", f"transformations: [{{type: set_state, key: depth, val: 3}}, {EXTRA}, rule_conditions: [{{type: processing_state, key: depth, val: 2, op: gt}}]}}]"),
    "when_tag": Spec("events", one("event_type: error"), "event_type = 'error' AND user_id < 75", f"transformations: [{EXTRA}, rule_conditions: [{{type: tag, tag: attack.t1059}}]}}]", extra="tags: [attack.t1059]\n"),
    "when_attribute": Spec("events", one("event_type: error"), "event_type = 'error' AND user_id < 75", f"transformations: [{EXTRA}, rule_conditions: [{{type: rule_attribute, attribute: level, value: medium, op: gte}}]}}]", extra="level: high\n"),
    "when_detection_rule": Spec("events", one("event_type: error"), "event_type = 'error' AND user_id < 75", f"transformations: [{EXTRA}, rule_conditions: [{{type: is_detection_rule}}]}}]"),
    "when_correlation_rule": Spec("events", one("event_type: error"), "event_type = 'error'", f"transformations: [{EXTRA}, rule_conditions: [{{type: is_correlation_rule}}]}}]"),
    "item_matches": Spec("events", one("event_type: error, user_id: 4"), "user_id = 4", "transformations: [{type: drop_detection_item, detection_item_conditions: [{type: match_string, cond: any, pattern: '^err'}]}]"),
    "item_has_value": Spec("events", one("event_type: error, user_id: 4"), "event_type = 'error'", "transformations: [{type: drop_detection_item, detection_item_conditions: [{type: match_value, cond: any, value: 4}]}]"),
    "item_has_wildcard": Spec("events", one("event_type: 'e*', user_id: [4, 5]"), "user_id IN (4, 5)", "transformations: [{type: drop_detection_item, detection_item_conditions: [{type: contains_wildcard, cond: any}]}]"),
    "item_is_null": Spec("events", one("nothing: null, user_id: 4"), "user_id = 4", "transformations: [{type: drop_detection_item, detection_item_conditions: [{type: is_null, cond: all}]}]"),
    "item_was_applied": Spec("events", one("Type: error, user_id: 4"), "user_id = 4", "transformations: [{id: named, type: field_name_mapping, mapping: {Type: event_type}}, {type: drop_detection_item, detection_item_conditions: [{type: processing_item_applied, processing_item_id: named}]}]"),
    "item_by_state": Spec("events", one("event_type: error, user_id: 4"), "event_type = 'error' AND user_id = 4", "transformations: [{type: drop_detection_item, detection_item_conditions: [{type: processing_state, key: depth, val: 3}]}]"),
    "field_not_excluded": Spec("events", one("type: error, user_id: 4"), "event_type = 'error' AND user_id = 4", "transformations: [{type: field_name_prefix, prefix: event_, field_name_conditions: [{type: exclude_fields, fields: [user_id, event_id, event_type]}]}]"),
    "field_was_applied": Spec("events", one("t: error"), "event_type = 'error'", "transformations: [{id: named, type: field_name_mapping, mapping: {t: type}}, {type: field_name_prefix, prefix: event_, field_name_conditions: [{type: processing_item_applied, processing_item_id: named}]}, {type: set_field, fields: [event_id, user_id, event_type]}]"),
    "field_by_state": Spec("events", one("type: error"), "event_type = 'error'", "transformations: [{type: set_state, key: log, val: raw}, {type: field_name_prefix, prefix: event_, field_name_conditions: [{type: processing_state, key: log, val: raw}, {type: include_fields, fields: [type]}], field_name_cond_op: and}]"),
    "added_and_removed_fields": Spec("events", one("event_type: error"), "event_type = 'error'", "transformations: [{type: remove_field, field: event_type}, {type: add_field, field: [event_type]}]"),
}
for _name in ("change_logsource", "state_table"):
    SPECS[_name].sql = lambda: "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error'"  # type: ignore[method-assign]

BASE = """
title: error
name: error
logsource: {product: app, service: events}
detection: {sel: {event_type: error}, condition: sel}
---
title: click
name: click
logsource: {product: app, service: events}
detection: {sel: {event_type: click}, condition: sel}
---
title: purchase
name: purchase
logsource: {product: app, service: events}
detection: {sel: {event_type: purchase}, condition: sel}
---
"""
E3 = "SELECT *, ts AS t FROM events WHERE event_type IN ('error', 'click', 'purchase')"


def correlated(kind: str, rules: str, timespan: str, condition: str = "", group: str = "[user_id]", more: str = "", method: str = "sliding") -> Query:
    text = f"{BASE}title: c\nname: c\ncorrelation:\n  type: {kind}\n  rules: {rules}\n  timespan: {timespan}\n" + (f"  group-by: {group}\n" if group else "") + (f"  condition: {condition}\n" if condition else "") + more

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        collection = Collection.from_yaml(text)
        out = Engine(spark, catalog(spark, sf_dir), method=method).matches(collection["c"], collection)[0]
        return _comparable(out)

    return run


def _comparable(df: DataFrame) -> DataFrame:
    """Times as microseconds and values rounded, so that any system can compare them.

    Ties are rounded as the SQL does, by the product and not by the decimals of the double.
    """
    kinds = dict(df.dtypes)
    times = {c: F.unix_micros(c) for c, t in kinds.items() if t == "timestamp"}
    rounded = {c: F.round(F.col(c) * 10000) / 10000 for c, t in kinds.items() if t == "double"}
    arrays = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c, t in kinds.items() if t.startswith("array")}
    return df.withColumns(times | rounded | arrays)


def _rolling(value: str, where: str, keep: str, seconds: int, keys: str = "user_id") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    names = f"{keys}, " if keys else ""
    return (
        f"SELECT {names}epoch_us(ts) AS ts, value FROM (SELECT {names}ts, {value} OVER ({part}ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECOND PRECEDING AND CURRENT ROW) AS value "
        f"FROM (SELECT event_id, ts, user_id, event_type, value AS v FROM events WHERE {where})) WHERE {keep}"
    )


def _buckets(value: str, where: str, keep: str, seconds: int, keys: str = "user_id") -> str:
    return (
        f"SELECT {keys}, epoch_us(b) AS window_start, epoch_us(b) + {seconds * 1000000} AS ts, value FROM (SELECT {keys}, time_bucket(INTERVAL {seconds} SECOND, ts, TIMESTAMP '1970-01-01') AS b, {value} AS value "
        f"FROM (SELECT event_id, ts, user_id, event_type, value AS v FROM events WHERE {where}) GROUP BY ALL) WHERE {keep}"
    )


ANY = "event_type IN ('error', 'click', 'purchase')"
_ORDERED = """WITH e AS (SELECT * FROM events WHERE event_type = 'error'), c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT p.user_id, epoch_us(p.ts) AS ts, 3::BIGINT AS value FROM p WHERE EXISTS (SELECT 1 FROM e, c WHERE e.user_id = p.user_id AND c.user_id = p.user_id AND e.ts < c.ts AND c.ts < p.ts AND p.ts - e.ts <= INTERVAL {h} HOUR)"""
_COUNT2 = "(SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = '{}')"

CORRELATIONS: dict[str, tuple[Query, str]] = {
    "event_count_sliding": (correlated("event_count", "error", "1d", "{gte: 2}"), _rolling("count(*)", "event_type = 'error'", "value >= 2", 86400)),
    "event_count_tumbling": (correlated("event_count", "error", "1d", "{gte: 2}", method="tumbling"), _buckets("count(*)", "event_type = 'error'", "value >= 2", 86400)),
    "event_count_ungrouped": (correlated("event_count", "error", "1h", "{gt: 4}", group=""), _rolling("count(*)", "event_type = 'error'", "value > 4", 3600, keys="")),
    "event_count_lt": (correlated("event_count", "error", "12h", "{lt: 2}", method="tumbling"), _buckets("count(*)", "event_type = 'error'", "value < 2", 43200)),
    "value_count_sliding": (correlated("value_count", "[error, click, purchase]", "1d", "{gte: 3, field: event_type}"), _rolling("count(DISTINCT event_type)", ANY, "value >= 3", 86400)),
    "value_count_tumbling": (correlated("value_count", "[error, click, purchase]", "1d", "{gte: 3, field: event_type}", method="tumbling"), _buckets("count(DISTINCT event_type)", ANY, "value >= 3", 86400)),
    "value_sum_sliding": (correlated("value_sum", "purchase", "1d", "{gt: 100.5, field: value}"), _rolling("sum(v)", "event_type = 'purchase'", "value > 100.5", 86400).replace("AS ts, value FROM", "AS ts, round(value, 4) AS value FROM", 1)),
    "value_sum_tumbling": (correlated("value_sum", "purchase", "1d", "{gt: 100.5, field: value}", method="tumbling"), _buckets("sum(v)", "event_type = 'purchase'", "value > 100.5", 86400).replace("AS ts, value FROM", "AS ts, round(value, 4) AS value FROM", 1)),
    "value_avg_sliding": (correlated("value_avg", "purchase", "2d", "{lte: 20, field: value}"), _rolling("avg(v)", "event_type = 'purchase'", "value <= 20", 172800).replace("AS ts, value FROM", "AS ts, round(value, 4) AS value FROM", 1)),
    "value_avg_tumbling": (correlated("value_avg", "purchase", "1d", "{lte: 20, field: value}", method="tumbling"), _buckets("avg(v)", "event_type = 'purchase'", "value <= 20", 86400).replace("AS ts, value FROM", "AS ts, round(value, 4) AS value FROM", 1)),
    "value_median_sliding": (correlated("value_median", "[error, click]", "1d", "{gte: 40, field: value}"), _rolling("quantile_cont(v, 0.5)", "event_type IN ('error', 'click')", "value >= 40", 86400).replace("AS ts, value FROM", "AS ts, round(value, 4) AS value FROM", 1)),
    "value_median_tumbling": (correlated("value_median", "[error, click]", "1d", "{gte: 40, field: value}", method="tumbling"), _buckets("quantile_cont(v, 0.5)", "event_type IN ('error', 'click')", "value >= 40", 86400).replace("AS ts, value FROM", "AS ts, round(value, 4) AS value FROM", 1)),
    "value_percentile_sliding": (correlated("value_percentile", "click", "3d", "{gte: 60, field: value, percentile: 90}"), _rolling("quantile_cont(v, 0.9)", "event_type = 'click'", "value >= 60", 259200).replace("AS ts, value FROM", "AS ts, round(value, 4) AS value FROM", 1)),
    "value_percentile_tumbling": (correlated("value_percentile", "click", "1d", "{gte: 60, field: value, percentile: 90}", method="tumbling"), _buckets("quantile_cont(v, 0.9)", "event_type = 'click'", "value >= 60", 86400).replace("AS ts, value FROM", "AS ts, round(value, 4) AS value FROM", 1)),
    "temporal_sliding": (correlated("temporal", "[error, purchase]", "1d"), _rolling("count(DISTINCT event_type)", "event_type IN ('error', 'purchase')", "value >= 2", 86400)),
    "temporal_tumbling": (correlated("temporal", "[error, purchase]", "1d", method="tumbling"), _buckets("count(DISTINCT event_type)", "event_type IN ('error', 'purchase')", "value >= 2", 86400)),
    "temporal_ordered": (correlated("temporal_ordered", "[error, click, purchase]", "3d"), _ORDERED.format(h=72)),
    "temporal_extended": (
        correlated("temporal", "[error, purchase]", "1d", "error and not purchase"),
        "SELECT e.user_id, epoch_us(e.ts) AS ts, 1::BIGINT AS value FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts BETWEEN e.ts - INTERVAL 1 DAY AND e.ts)",
    ),
    "temporal_ordered_extended": (
        correlated("temporal_ordered", "[error, click, purchase]", "1d", "error and click and not purchase"),
        "SELECT c.user_id, epoch_us(c.ts) AS ts, 1::BIGINT AS value FROM events c WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = c.user_id AND e.ts < c.ts AND e.ts >= c.ts - INTERVAL 1 DAY) AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts BETWEEN c.ts - INTERVAL 1 DAY AND c.ts)",
    ),
    "correlation_aliases": (
        correlated("event_count", "[error, click]", "1d", "{gte: 4}", "[who]", "  aliases: {who: {error: user_id, click: user_id}}\n"),
        _rolling("count(*)", "event_type IN ('error', 'click')", "value >= 4", 86400).replace("user_id, epoch_us", "user_id::BIGINT AS who, epoch_us", 1),
    ),
    "correlation_nested": (
        correlated("temporal", "[errors, clicks]", "2d", more="---\ntitle: errors\nname: errors\ncorrelation: {type: event_count, rules: error, timespan: 1d, group-by: [user_id], condition: {gte: 2}}\n---\ntitle: clicks\nname: clicks\ncorrelation: {type: event_count, rules: click, timespan: 1d, group-by: [user_id], condition: {gte: 2}}\n"),
        f"SELECT user_id, epoch_us(ts) AS ts, value FROM (SELECT user_id, ts, count(DISTINCT k) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS value FROM (SELECT user_id, ts, 'e' AS k FROM {_COUNT2.format('error')} WHERE n >= 2 UNION ALL SELECT user_id, ts, 'c' FROM {_COUNT2.format('click')} WHERE n >= 2)) WHERE value >= 2",
    ),
}

CORRELATIONS["correlation_across_sources"] = (
    correlated(
        "event_count", "[error, big]", "30d", "{gte: 2}", "[who]",
        "  aliases: {who: {error: user_id, big: o_custkey}}\n---\ntitle: big\nname: big\nlogsource: {category: sales, service: orders}\ndetection: {sel: {o_totalprice|gt: 200000}, condition: sel}\n", "tumbling",
    ),
    "SELECT who, epoch_us(b) AS window_start, epoch_us(b) + 2592000000000 AS ts, value FROM (SELECT who, time_bucket(INTERVAL 2592000 SECOND, ts, TIMESTAMP '1970-01-01') AS b, count(*) AS value "
    "FROM (SELECT user_id AS who, ts FROM events WHERE event_type = 'error' UNION ALL SELECT o_custkey, o_orderdate FROM orders WHERE o_totalprice > 200000) GROUP BY ALL) WHERE value >= 2",
)

MANY = "\n---\n".join(
    f"title: rule {i}\nname: r{i}\nlevel: {level}\ntags: [attack.t{i}]\nlogsource: {{product: app, service: events}}\ndetection: {{sel: {{{item}}}, condition: sel}}"
    for i, (level, item) in enumerate([("low", "event_type: error"), ("high", "value|gte: 90"), ("medium", "event_type|contains: i, value|lt: 5"), ("low", "user_id: [1, 2, 3]"), ("critical", "ts|hour: 3, event_type: [click, view]"), ("low", "props.k|gte: 98")])
)
_MANY_WHERE = ["event_type = 'error'", "value >= 90", "contains(event_type, 'i') AND value < 5", "user_id IN (1, 2, 3)", "hour(ts) = 3 AND event_type IN ('click', 'view')", "try_cast(json_extract_string(props, '$.k') AS DOUBLE) >= 98"]
_LEVELS = ["low", "high", "medium", "low", "critical", "low"]


def fused_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rules in one scan."""
    return Engine(spark, catalog(spark, sf_dir)).tagged(list(Collection.from_yaml(MANY)), ["event_id"]).drop("tags")  # type: ignore[arg-type]


def hundred_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rules over line items in one scan, counted by rule."""
    text = "\n---\n".join(
        f"title: rule {i}\nname: q{i}\nlogsource: {SOURCES['lineitem']}\ndetection: {{sel: {{l_quantity|gte: {i % 50}, l_discount|lt: {(i % 7) / 100 + 0.01:.2f}, l_returnflag: {'ANR'[i % 3]}}}, condition: sel}}" for i in range(100)
    )
    tagged = Engine(spark, catalog(spark, sf_dir)).tagged(list(Collection.from_yaml(text)), ["l_orderkey"])  # type: ignore[arg-type]
    return tagged.groupBy("rule_id").agg(F.count("*").alias("n"))


def thousand_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand rules over line items in one scan, counted by rule."""
    text = "\n---\n".join(
        f"title: rule {i}\nname: q{i}\nlogsource: {SOURCES['lineitem']}\ndetection: {{sel: {{l_quantity|gte: {i % 50}, l_discount|lt: {(i % 7) / 100 + 0.01:.2f}, l_returnflag: {'ANR'[i % 3]}}}, condition: sel}}" for i in range(1000)
    )
    tagged = Engine(spark, catalog(spark, sf_dir)).tagged(list(Collection.from_yaml(text)), ["l_orderkey"])  # type: ignore[arg-type]
    return tagged.groupBy("rule_id").agg(F.count("*").alias("n"))


def carried_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlation with the values of a field that its rule asks for."""
    text = (
        f"title: error\nname: error\nlogsource: {SOURCES['events']}\nfields: [event_type]\ndetection: {{sel: {{value|gte: 50}}, condition: sel}}\n"
        "---\ntitle: c\nname: c\ncorrelation: {type: event_count, rules: error, timespan: 1d, group-by: [user_id], condition: {gte: 2}}\n"
    )
    collection = Collection.from_yaml(text)
    return _comparable(Engine(spark, catalog(spark, sf_dir), method="tumbling").matches(collection["c"], collection)[0])


def as_text(pipeline: str) -> Query:
    """The texts of two rules, finished by a pipeline, and run as SQL."""
    text = "\n---\n".join(f"title: {n}\nname: {n}\nlogsource: {SOURCES['events']}\nfields: [event_id]\ndetection: {{sel: {{event_type: {n}}}, condition: sel}}" for n in ("error", "click"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
        out = Engine(spark, catalog(spark, sf_dir), Pipeline.from_yaml(pipeline)).run(Collection.from_yaml(text), "sql")
        found = [spark.sql(x if isinstance(x, str) else x[1]) for x in ([out] if isinstance(out, str) else out)]  # type: ignore[union-attr]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    return run


def rule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of three rules, by check."""
    text = (
        "title: one\nid: 9f1f4d2e-4f0a-4a7e-8d39-1f4c3f6f0a01\nrlated: x\ntags: [nothing.here, tlp.purple, attack.t1059, attack.t1059]\nreferences: [a, a]\nlogsource: {product: windows, service: sysmon}\n"
        "detection: {sel: {EventID: 22, a|all: [x, y]}, other: {b: 'a**b'}, condition: sel}\n---\n"
        "title: one\nauthour: me\nlogsource: {product: app, service: events}\ndetection: {sel: {c: '7', d: '*x*'}, condition: all of them}\n---\n"
        "title: two\nid: 9f1f4d2e-4f0a-4a7e-8d39-1f4c3f6f0a01\nlogsource: {product: app, where: x}\ndetection: {sel: {c|windash|contains|all: [-a, -b]}, condition: sel and gone}\n"
    )
    found = Validator().validate(Collection.from_yaml(text, collect_errors=True))
    return spark.createDataFrame([(i.check, i.severity) for i in found], "issue string, severity string").groupBy("issue", "severity").agg(F.count("*").alias("n"))


def multi_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule with two conditions gives a query for each."""
    text = "title: t\nlogsource: {product: app, service: events}\nfields: [event_id]\ndetection:\n  a: {event_type: error}\n  b: {value|gte: 80}\n  condition: [a and b, a and not b]\n"
    found = Engine(spark, catalog(spark, sf_dir)).matches(Collection.from_yaml(text)[0])
    return found[0].withColumn("query", F.lit(0)).unionByName(found[1].withColumn("query", F.lit(1)))


def all_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, repeated by an action, and a correlation, as one table of detections."""
    text = (
        "action: global\nlogsource: {product: app, service: events}\n---\ntitle: errors\nname: errors\ndetection: {sel: {event_type: error}, condition: sel}\n---\n"
        "action: repeat\ntitle: many errors\nname: high\nlevel: high\ndetection: {sel: {value|gte: 95}}\n---\naction: reset\n---\n"
        "title: burst\nname: burst\ncorrelation: {type: event_count, rules: [errors], timespan: 1d, group-by: [user_id], condition: {gte: 3}, generate: true}\n"
    )
    out = detections(Engine(spark, catalog(spark, sf_dir), method="tumbling"), Collection.from_yaml(text))
    return out.groupBy("rule_id", "rule_title", "level").agg(F.count("*").alias("n"))


def windows_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundled pipeline adds the channel of a service; here events stand in for the log."""
    pipeline = bundled()["windows_channels"]() + Pipeline.from_yaml(
        "transformations: [{type: field_name_mapping, mapping: {Channel: event_type}}, {type: map_string, mapping: {Security: error}}, {type: set_state, key: table, val: events}]"
    )
    text = "title: t\nlogsource: {product: windows, service: security}\nfields: [event_id]\ndetection: {sel: {value|gte: 50}, condition: sel}\n"
    return Engine(spark, catalog(spark, sf_dir), pipeline).matches(Collection.from_yaml(text)[0])[0]


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A placeholder stands for a table of values: a semi-join."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal < 0").select("c_custkey").createOrReplaceTempView("vigil_debtors")
    pipeline = Pipeline.from_yaml("transformations: [{type: query_expression_placeholders, expression: '{field} IN (SELECT c_custkey FROM {id})', mapping: {debtors: vigil_debtors}}]")
    text = f"title: t\nlogsource: {SOURCES['orders']}\nfields: [o_orderkey]\ndetection: {{sel: {{o_custkey|expand: '%debtors%', o_totalprice|gt: 1000}}, condition: sel}}\n"
    return Engine(spark, catalog(spark, sf_dir), pipeline).matches(Collection.from_yaml(text)[0])[0]


def live_events(spark: SparkSession, sf_dir: str) -> Catalog:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = Catalog()
    # a pattern, since the table may be one file or a folder
    out.add(lambda: spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"), product="app", service="events", name="events", time="ts")
    return out


def streamed(kind: str, rules: str, condition: str) -> Query:
    text = f"{BASE}title: c\nname: c\ncorrelation: {{type: {kind}, rules: {rules}, timespan: 1d, group-by: [user_id]{condition}}}\n"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        collection = Collection.from_yaml(text)
        engine = Engine(spark, live_events(spark, sf_dir))
        return _comparable(run_once(stream_correlation(engine, collection["c"], collection, "1 hour")))  # type: ignore[arg-type]

    return run


def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    collection = Collection.from_yaml(BASE)
    return run_once(stream_matches(Engine(spark, live_events(spark, sf_dir)), list(collection), ["event_id"]).drop("tags"))  # type: ignore[arg-type]


def _closed(sql: str, where: str) -> str:
    """Windows that the watermark, an hour behind the last event, has passed."""
    return f"SELECT * FROM ({sql}) WHERE ts <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events WHERE {where})"


STREAMS: dict[str, tuple[Query, str]] = {
    "stream_filter": (stream_filter, "SELECT event_type AS rule_id, event_type AS rule_title, NULL::VARCHAR AS level, event_id FROM events WHERE event_type IN ('error', 'click', 'purchase')"),
    "stream_event_count": (streamed("event_count", "error", ", condition: {gte: 2}"), _closed(_buckets("count(*)", "event_type = 'error'", "value >= 2", 86400), "event_type = 'error'")),
    "stream_value_count": (streamed("value_count", "[error, click, purchase]", ", condition: {gte: 3, field: event_type}"), _closed(_buckets("count(DISTINCT event_type)", ANY, "value >= 3", 86400), ANY)),
    "stream_temporal": (streamed("temporal", "[error, purchase]", ""), _closed(_buckets("count(DISTINCT event_type)", "event_type IN ('error', 'purchase')", "value >= 2", 86400), "event_type IN ('error', 'purchase')")),
}


OTHERS: dict[str, tuple[Query, str]] = {
    "multi_rule_fused": (fused_rules, " UNION ALL ".join(f"SELECT 'r{i}' AS rule_id, 'rule {i}' AS rule_title, '{lv}' AS level, event_id FROM events WHERE {w}" for i, (w, lv) in enumerate(zip(_MANY_WHERE, _LEVELS, strict=True)))),
    "hundred_rules_fused": (hundred_rules, " UNION ALL ".join(f"SELECT 'q{i}' AS rule_id, count(*) AS n FROM lineitem WHERE l_quantity >= {i % 50} AND l_discount < {(i % 7) / 100 + 0.01:.2f}::DOUBLE AND l_returnflag = '{'ANR'[i % 3]}' HAVING count(*) > 0" for i in range(100))),
    "thousand_rules_fused": (
        thousand_rules,
        "SELECT 'q' || i AS rule_id, count(*) AS n FROM range(1000) t(i) JOIN lineitem ON l_quantity >= i % 50 AND l_discount < round((i % 7) / 100.0 + 0.01, 2) AND l_returnflag = substr('ANR', (i % 3 + 1)::INT, 1) GROUP BY 1",
    ),
    "carried_fields": (
        carried_fields,
        "SELECT user_id, epoch_us(b) AS window_start, epoch_us(b) + 86400000000 AS ts, n AS value, k AS event_type FROM (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS b, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS k FROM events WHERE value >= 50 GROUP BY ALL) WHERE n >= 2",
    ),
    "text_embed": (as_text("postprocessing: [{type: embed, prefix: 'SELECT count(*) AS n FROM (', suffix: ')'}]"), "SELECT count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT count(*) FROM events WHERE event_type = 'click'"),
    "text_template": (as_text("postprocessing: [{type: simple_template, template: \"SELECT '{rule.title}' AS rule, max(event_id) AS top FROM ({query})\"}]"), "SELECT event_type AS rule, max(event_id) AS top FROM events WHERE event_type IN ('error', 'click') GROUP BY 1"),
    "text_replace": (as_text("postprocessing: [{type: replace, pattern: 'SELECT `event_id`', replacement: 'SELECT event_id + 1 AS next'}]"), "SELECT event_id + 1 AS next FROM events WHERE event_type IN ('error', 'click')"),
    "text_concat": (as_text("postprocessing: [{type: nest, items: [{type: embed, prefix: '(', suffix: ')'}]}]\nfinalizers: [{type: concat, separator: ' UNION ALL ', prefix: 'SELECT count(*) AS n FROM (', suffix: ')'}]"), "SELECT count(*) AS n FROM events WHERE event_type IN ('error', 'click')"),
    "multi_condition": (multi_condition, "SELECT event_id, CASE WHEN value >= 80 THEN 0 ELSE 1 END::INT AS query FROM events WHERE event_type = 'error'"),
    "detections_table": (
        all_detections,
        "SELECT 'errors' AS rule_id, 'errors' AS rule_title, NULL::VARCHAR AS level, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'high', 'many errors', 'high', count(*) FROM events WHERE event_type = 'error' AND value >= 95 HAVING count(*) > 0 "
        "UNION ALL SELECT 'burst', 'burst', NULL, count(*) FROM (SELECT 1 FROM events WHERE event_type = 'error' GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') HAVING count(*) >= 3) HAVING count(*) > 0",
    ),
    "lookup_semi_join": (lookup, "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"),
    "windows_channels": (windows_channels, "SELECT event_id FROM events WHERE event_type = 'error' AND value >= 50"),
}


def queries() -> dict[str, Query]:
    return {n: s.query(n) for n, s in SPECS.items()} | {n: q for n, (q, _) in (CORRELATIONS | STREAMS | OTHERS).items()}


def oracle_sql() -> dict[str, str]:
    return {n: s.sql() for n, s in SPECS.items()} | {n: s for n, (_, s) in (CORRELATIONS | STREAMS | OTHERS).items()}
