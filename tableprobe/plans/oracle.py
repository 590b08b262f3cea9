"""SQL for DuckDB of what queries.py computes with Spark."""

from __future__ import annotations

import re

from tableprobe.operators.quality import COUNTED
from tableprobe.plans.dirty import COLUMNS, DIRTY, sql

NUMBERS, TEXTS, AS_OF = ("qty", "age"), [c for c in COLUMNS if c not in ("qty", "age")], "2024-12-31"
# The shapes of blanks, dates and numbers, as in functions/values.py and functions/dates.py. The separators of
# a date in numbers are compared apart (_SEPS), as this engine's patterns have no back-references.
_BLANK = r"'^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$'"
_ISO = r"'(?i)^\d{4}-(\d{2})-(\d{2})(t\d{2}:\d{2}(:\d{2})?(\.\d+)?(z|[+-]\d{2}:?\d{2})?)?$'"
_SHORT = r"'^(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}$'"
_NUMBER = r"'^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$'"
_FULL = r"'(?i)^(\d{4})-(\d{2})-(\d{2})(?:[t ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:z|[+-]\d{2}:?\d{2})?)?$'"
_PARTS = r"'^(\d{1,4})[/.-](\d{1,2})[/.-](\d{1,4})$'"
_SEPS = r"'^\d{1,4}([/.-])\d{1,2}([/.-])\d{1,4}$'"


def trim(c: str) -> str:
    return f"regexp_replace({c}, {_BLANK}, '', 'g')"


def empty(c: str) -> str:
    return f"({c} IS NULL)" if c in NUMBERS else f"({c} IS NULL OR {trim(c)} = '')"


def _date_like(t: str) -> str:
    part = lambda shape: f"(regexp_matches({t}, {shape}) AND try_cast(regexp_extract({t}, {shape}, 1) AS INT) BETWEEN 1 AND 12 AND try_cast(regexp_extract({t}, {shape}, 2) AS INT) BETWEEN 1 AND 31)"
    return f"({part(_ISO)} OR {part(_SHORT)})"


def bucket(c: str, fine: bool) -> str:
    if c in NUMBERS:
        return f"CASE WHEN {c} IS NULL THEN NULL ELSE '{'integer' if fine else 'number'}' END"
    t = trim(c)
    number = (
        rf"WHEN regexp_matches({t}, '^[+-]?\d+$') THEN 'integer' WHEN regexp_matches({t}, '^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$') THEN 'float'"
        if fine
        else f"WHEN regexp_matches({t}, {_NUMBER}) THEN 'number'"
    )
    return f"CASE WHEN {empty(c)} THEN NULL WHEN lower({t}) IN ('true','false','yes','no') THEN 'boolean' {number} WHEN {_date_like(t)} THEN 'date' ELSE 'string' END"


def number(c: str) -> str:
    return f"cast({c} AS DOUBLE)" if c in NUMBERS else f"CASE WHEN regexp_matches({trim(c)}, {_NUMBER}) THEN try_cast({trim(c)} AS DOUBLE) END"


def long(value, columns=COLUMNS) -> str:
    """row_id, "column", idx and v of every cell."""
    return " UNION ALL ".join(f"SELECT row_id, '{c}' AS \"column\", {COLUMNS.index(c)} AS idx, {value(c)} AS v FROM d" for c in columns)


def severity(count: str, pct: str, error: int, warning: int) -> str:
    return f"CASE WHEN {count} = 0 THEN 'info' WHEN {pct} >= {error} THEN 'error' WHEN {pct} >= {warning} THEN 'warning' ELSE 'info' END"


_FINDING = 'check_name, "column", idx, count, round(percentage, 6) AS percentage, severity'
_MISSING = f"""miss AS (SELECT 'missing-values' AS check_name, "column", idx, count, percentage, {severity("count", "percentage", 30, 5)} AS severity
 FROM (SELECT "column", idx, sum(v)::BIGINT AS count, sum(v) * 100.0 / count(*) AS percentage FROM ({long(lambda c: f"CASE WHEN {empty(c)} THEN 1 ELSE 0 END")}) GROUP BY ALL))"""
_DUPS = f"""dg AS (SELECT count(*) AS n FROM d GROUP BY {", ".join(COLUMNS)} HAVING count(*) > 1),
dup AS (SELECT 'duplicate-rows' AS check_name, '' AS "column", -1 AS idx, count, percentage, {severity("count", "percentage", 5, 1)} AS severity, groups
 FROM (SELECT coalesce(sum(n - 1), 0)::BIGINT AS count, count(*) AS groups, coalesce(sum(n - 1), 0) * 100.0 / (SELECT count(*) FROM d) AS percentage FROM dg))"""
_BUCKETS = f"""tb AS (SELECT "column", idx, v AS bucket, count(*) AS n, min(row_id) AS first_row FROM ({long(lambda c: bucket(c, False))}) WHERE v IS NOT NULL GROUP BY ALL)"""
_MIXED = f"""{_BUCKETS}, tr AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, first_row) AS r FROM tb),
mix AS (SELECT 'mixed-types' AS check_name, "column", idx, count, percentage, {severity("count", "percentage", 20, 5)} AS severity, dominant
 FROM (SELECT "column", idx, sum(CASE WHEN r > 1 THEN n ELSE 0 END)::BIGINT AS count, sum(CASE WHEN r > 1 THEN n ELSE 0 END) * 100.0 / sum(n) AS percentage,
  max(CASE WHEN r = 1 THEN bucket END) AS dominant FROM tr GROUP BY ALL HAVING count(*) > 1))"""
_VALUES = f"""cvv AS (SELECT "column", idx, v AS value, count(*) AS n FROM ({long(lambda c: f"CASE WHEN {empty(c)} THEN NULL ELSE {c} END", TEXTS)}) WHERE v IS NOT NULL GROUP BY ALL),
cv AS (SELECT * FROM cvv WHERE "column" IN (SELECT "column" FROM cvv GROUP BY 1 HAVING count(*) <= 49)),
nv AS (SELECT "column", value, regexp_replace(lower({trim("value")}), '\\s+', ' ', 'g') AS norm FROM cv),
pairs AS (SELECT x."column", x.value AS a, y.value AS b FROM nv x JOIN nv y ON x."column" = y."column" AND x.value < y.value
 WHERE x.norm = y.norm OR (floor(greatest(length(x.norm), length(y.norm)) / 3) >= 1 AND levenshtein(x.norm, y.norm) <= least(2, floor(greatest(length(x.norm), length(y.norm)) / 3))))"""
_CLUSTERS = f"""{_VALUES},
sym AS (SELECT "column", a, b FROM pairs UNION SELECT "column", b, a FROM pairs),
reach AS (SELECT "column", a AS value, a AS c FROM sym UNION SELECT r."column", s.b, r.c FROM reach r JOIN sym s ON r."column" = s."column" AND r.value = s.a),
cl AS (SELECT "column", value, min(c) AS cluster FROM reach GROUP BY ALL),
inc AS (SELECT 'inconsistent-categoricals' AS check_name, q."column", q.idx, q.count, q.percentage, CASE WHEN q.percentage >= 50 THEN 'error' ELSE 'warning' END AS severity, q.clusters
 FROM (SELECT cl."column", t.idx, count(*) AS count, count(*) * 100.0 / any_value(t.total) AS percentage, count(DISTINCT cluster) AS clusters
  FROM cl JOIN (SELECT "column", idx, count(*) AS total FROM cv GROUP BY ALL) t ON cl."column" = t."column" GROUP BY ALL) q)"""
_REPORT = f"""{_MISSING}, {_DUPS}, {_CLUSTERS}, {_MIXED},
rep AS (SELECT {_FINDING}, 0 AS check_order FROM miss UNION ALL SELECT {_FINDING}, 1 FROM dup UNION ALL SELECT {_FINDING}, 2 FROM inc UNION ALL SELECT {_FINDING}, 3 FROM mix)"""
_RANK = "CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
_SAMPLES = f"""sv AS (SELECT "column", idx, v AS value, row_number() OVER (PARTITION BY "column" ORDER BY row_id) AS r
 FROM ({long(lambda c: f"CASE WHEN {empty(c)} THEN NULL ELSE cast({c} AS VARCHAR) END")}) WHERE v IS NOT NULL)"""
_TYPES = f"""tc AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY row_id) AS r FROM ({long(lambda c: bucket(c, True))}) WHERE v IS NOT NULL),
ts AS (SELECT "column", count(*) AS t, count(*) FILTER (v = 'boolean') AS b, count(*) FILTER (v = 'integer') AS i, count(*) FILTER (v = 'float') AS f, count(*) FILTER (v = 'date') AS dt FROM tc WHERE r <= 200 GROUP BY 1),
names AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(COLUMNS))}) x("column", idx)),
types AS (SELECT names."column", names.idx, CASE WHEN t IS NULL THEN 'null' WHEN b / t >= 0.7 THEN 'boolean' WHEN i / t >= 0.7 THEN 'integer' WHEN (i + f) / t >= 0.7 THEN 'float' WHEN dt / t >= 0.7 THEN 'date' ELSE 'string' END AS data_type
 FROM names LEFT JOIN ts ON names."column" = ts."column")"""
_PROFILE = f"""{_TYPES}, {_SAMPLES}, prof AS (SELECT types."column", types.idx, data_type, coalesce(s, '') AS samples
 FROM types LEFT JOIN (SELECT "column", string_agg(value, ' | ' ORDER BY r) AS s FROM sv WHERE r <= 5 GROUP BY 1) q ON types."column" = q."column")"""


def describe(source: str, columns: dict[str, str], order: list[str]) -> str:
    """ds: a row per column of its finite numbers. columns: name -> SQL of the number."""
    one = lambda c, e: f"SELECT '{c}' AS \"column\", {order.index(c)} AS idx, {e} AS x FROM {source}"
    return f"""nums AS ({" UNION ALL ".join(one(c, e) for c, e in columns.items())}),
mo AS (SELECT "column", x AS mode FROM (SELECT "column", x, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, x) AS r FROM nums WHERE x IS NOT NULL GROUP BY "column", x) WHERE r = 1),
ds AS (SELECT nums."column", idx, count(x) AS n, min(x) AS min, max(x) AS max, avg(x) AS mean, quantile_cont(x, 0.5) AS median, any_value(mo.mode) AS mode,
 coalesce(stddev_samp(x), 0) AS stddev, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3,
 quantile_cont(x, 0.25) - 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS lo, quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS hi
 FROM nums JOIN mo ON nums."column" = mo."column" GROUP BY nums."column", idx)"""


_STATS = ", ".join(f"round({c}, 4) AS {c}" for c in ("min", "max", "mean", "median", "mode", "stddev", "q1", "q3", "lo", "hi"))
_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_DN = describe("d", {c: number(c) for c in ("total_amount", "qty")}, ["total_amount", "qty"])
_OUT = f"""{_DN}, outs AS (SELECT c."column", c.row_id, c.x AS value FROM (SELECT row_id, 'total_amount' AS "column", {number("total_amount")} AS x FROM d UNION ALL SELECT row_id, 'qty', {number("qty")} FROM d) c
 JOIN ds ON c."column" = ds."column" WHERE c.x < ds.lo OR c.x > ds.hi),
oc AS (SELECT "column", idx, n_outliers, percentage, {severity("n_outliers", "percentage", 5, 1)} AS severity FROM (SELECT ds."column", ds.idx, count(o.row_id) AS n_outliers, count(o.row_id) * 100.0 / any_value(ds.n) AS percentage
 FROM ds LEFT JOIN outs o ON ds."column" = o."column" GROUP BY ds."column", ds.idx))"""


def parsed(c: str) -> tuple[str, str]:
    """(day, format) of a text column."""
    t = trim(c)
    part = lambda k: f"regexp_extract({t}, {_PARTS}, {k})"
    day = lambda y, m, x: f"try_cast(lpad(cast({y} AS VARCHAR), 4, '0') || '-' || lpad(cast({m} AS VARCHAR), 2, '0') || '-' || lpad(cast({x} AS VARCHAR), 2, '0') AS DATE)"
    a, b, last = (f"try_cast({part(k)} AS INT)" for k in (1, 2, 3))
    year = f"CASE WHEN length({part(3)}) >= 4 THEN {last} WHEN {last} <= 68 THEN {last} + 2000 ELSE {last} + 1900 END"
    is_parts = f"(regexp_matches({t}, {_PARTS}) AND regexp_extract({t}, {_SEPS}, 1) = regexp_extract({t}, {_SEPS}, 2))"
    full = day(*(f"regexp_extract({t}, {_FULL}, {k})" for k in (1, 2, 3)))
    d = f"""CASE WHEN regexp_matches({t}, {_FULL}) THEN {full} WHEN {is_parts} THEN CASE WHEN length({part(1)}) = 4 THEN {day(a, b, last)} WHEN {a} > 12 AND {b} <= 12 THEN {day(year, b, a)} WHEN {a} <= 12 THEN {day(year, a, b)} END
      ELSE try_strptime({t}, ['%B %d, %Y', '%b %d, %Y', '%d %B %Y', '%d %b %Y'])::DATE END"""
    f = f"CASE WHEN regexp_matches({t}, {_FULL}) THEN 'ISO-8601' WHEN {is_parts} THEN CASE WHEN length({part(1)}) = 4 THEN 'ISO-like-slash' WHEN {a} > 12 AND {b} <= 12 THEN 'EU-slash' ELSE 'US-slash' END ELSE 'Other' END"
    return d, f


_DAY, _FORM = parsed("order_date")
_DATES = f"""pd AS (SELECT row_id, order_date AS original, {_DAY} AS day, {_FORM} AS f FROM d),
dv AS (SELECT row_id, original, day, strftime(day, '%Y-%m-%d') AS normalized, CASE WHEN day IS NOT NULL THEN f END AS format,
 CASE WHEN year(day) < 1900 THEN 'too-old' WHEN day > DATE '{AS_OF}' THEN 'future' END AS flag FROM pd)"""
_DATE_COLUMNS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {COLUMNS.index(c)} AS idx, count({parsed(c)[0]}) AS n_parsed, count(*) FILTER (NOT {empty(c)}) AS n_filled FROM d"
    if c not in NUMBERS
    else f"SELECT '{c}', {COLUMNS.index(c)}, 0, count({c}) FROM d"
    for c in COLUMNS
)


def fold(source: str) -> str:
    """Groups (name, value, seen) beyond six as five and the rest."""
    return f"""fr AS (SELECT name, value, row_number() OVER (ORDER BY value DESC, seen) AS r, count(*) OVER () AS k FROM ({source})),
fo AS (SELECT CASE WHEN k > 6 AND r >= 6 THEN 'Other' ELSE name END AS name, CASE WHEN k > 6 AND r >= 6 THEN 6 ELSE r END::INT AS place, sum(value) AS value FROM fr GROUP BY ALL)"""


def _cat(c: str) -> str:
    return f"CASE WHEN {trim(c)} <> '' THEN {trim(c)} END"


_AMOUNT = number("total_amount")
_CATS = f"""dc AS (SELECT "column", idx, count(*)::INT AS n_values, list(v ORDER BY v) AS vals FROM (SELECT DISTINCT "column", idx, v FROM ({long(_cat, TEXTS)}) WHERE v IS NOT NULL) GROUP BY ALL HAVING count(*) BETWEEN 2 AND 15)"""


def _clean() -> str:
    """cl: the staged columns of the fixed plan; fin: the cleaned rows."""
    v = "CASE WHEN channel = ' Web ' THEN 'web' ELSE channel END"
    channel = f"CASE WHEN ({v}) = 'WEB' THEN 'web' WHEN ({v}) = 'Store' THEN 'store' ELSE {v} END"
    iso = rf"regexp_matches({trim('order_date')}, '^\d{{4}}-\d{{2}}-\d{{2}}$')"
    made_date = f"CASE WHEN {iso} THEN {trim('order_date')} ELSE strftime({_DAY}, '%Y-%m-%d') END"
    gift = f"CASE WHEN lower({trim('is_gift')}) IN ('true','yes','1') THEN 'true' WHEN lower({trim('is_gift')}) IN ('false','no','0') THEN 'false' END"
    return f"""st AS (SELECT *, {v} AS ch1, {channel} AS ch2, CASE WHEN status = 'Fulfiled' THEN 'Fulfilled' ELSE status END AS st2, CASE WHEN {empty("order_date")} THEN NULL ELSE {made_date} END AS od, {gift} AS gf,
  CASE WHEN NOT {empty("total_amount")} THEN {_AMOUNT} END AS ta FROM d),
fin AS (SELECT row_id, order_id, CASE WHEN ch2 IS NULL OR {trim("ch2")} = '' THEN 'unknown' ELSE ch2 END AS channel, st2 AS status, segment_cd, coalesce(round(ta, 2), -1) AS amount, total_amount AS raw_amount, qty, age, coalesce(od, order_date) AS order_date, coalesce(gf, is_gift) AS is_gift, notes
 FROM st WHERE NOT {empty("segment_cd")}),
audit AS (SELECT seq::INT AS seq, "column", change_type, detail, affected_rows::BIGINT AS affected_rows, failed_rows::BIGINT AS failed_rows, (affected_rows > 0 AND detail <> 'leave-null') AS applied FROM (
 SELECT 0 AS seq, 'channel' AS "column", 'value-mapping' AS change_type, ' Web  -> web' AS detail, (SELECT count(*) FROM d WHERE channel = ' Web ') AS affected_rows, 0 AS failed_rows
 UNION ALL SELECT 1, 'channel', 'value-mapping', 'WEB -> web', (SELECT count(*) FROM st WHERE ch1 = 'WEB'), 0
 UNION ALL SELECT 2, 'channel', 'value-mapping', 'Store -> store', (SELECT count(*) FROM st WHERE ch1 = 'Store'), 0
 UNION ALL SELECT 3, 'status', 'value-mapping', 'Fulfiled -> Fulfilled', (SELECT count(*) FROM d WHERE status = 'Fulfiled'), 0
 UNION ALL SELECT 4, 'total_amount', 'type-coercion', 'float', (SELECT count(ta) FROM st), (SELECT count(*) FROM st WHERE ta IS NULL AND NOT {empty("total_amount")})
 UNION ALL SELECT 5, 'order_date', 'type-coercion', 'date', (SELECT count(od) FROM st), (SELECT count(*) FROM st WHERE od IS NULL AND NOT {empty("order_date")})
 UNION ALL SELECT 6, 'is_gift', 'type-coercion', 'boolean', (SELECT count(gf) FROM st), 0
 UNION ALL SELECT 7, 'no_such_column', 'skipped-invalid-column', '', 0, 0
 UNION ALL SELECT 8, 'channel', 'missing-value', 'fill-default', (SELECT count(*) FROM st WHERE ch2 IS NULL OR {trim("ch2")} = ''), 0
 UNION ALL SELECT 9, 'segment_cd', 'missing-value', 'drop-row', (SELECT count(*) FROM d WHERE {empty("segment_cd")}), 0
 UNION ALL SELECT 10, 'notes', 'missing-value', 'leave-null', (SELECT count(*) FROM d WHERE {empty("notes")}), 0))"""


_CLEAN = _clean()
_CHARTS = f"""c1 AS (SELECT 1 AS chart, 'trend' AS id, row_number() OVER (ORDER BY m)::INT AS place, m AS label, n::DOUBLE AS value FROM (SELECT strftime(day, '%Y-%m') AS m, count(*) AS n FROM dv WHERE day IS NOT NULL GROUP BY 1)),
{fold(f"SELECT coalesce({_cat('segment_cd')}, '(missing)') AS name, sum({_AMOUNT}) AS value, min(row_id) AS seen FROM d WHERE {_AMOUNT} IS NOT NULL GROUP BY 1")},
c2 AS (SELECT 2 AS chart, 'breakdown-segment_cd' AS id, place, name AS label, value FROM fo)"""

_CELLS = ", ".join(f"coalesce(cast({c} AS VARCHAR), '')" for c in COLUMNS)
_DETAIL = """SELECT prof."column", prof.idx, data_type, samples, round(ds.mean, 4) AS mean, CASE WHEN prof."column" = 'order_date' THEN (SELECT min(normalized) FROM dv) END AS earliest,
 coalesce(q.n, 0) AS n_findings, coalesce(q.checks, '') AS checks FROM prof LEFT JOIN ds ON prof."column" = ds."column"
 LEFT JOIN (SELECT "column", count(*) AS n, string_agg(DISTINCT check_name, ', ' ORDER BY check_name) AS checks FROM rep WHERE count > 0 AND "column" <> '' GROUP BY 1) q ON prof."column" = q."column" """
_EXAMPLES = f"""{_MIXED}, ce AS (SELECT l."column", l.row_id, l.v.b AS bucket, l.v.t AS value FROM ({long(lambda c: f"{{'b': {bucket(c, False)}, 't': cast({c} AS VARCHAR)}}")}) l WHERE l.v.b IS NOT NULL AND l."column" IN (SELECT "column" FROM mix)),
 e1 AS (SELECT *, row_number() OVER (PARTITION BY "column", bucket ORDER BY row_id) AS nth, min(row_id) OVER (PARTITION BY "column", bucket) AS seen FROM ce),
 e2 AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY seen, row_id) AS place FROM e1 WHERE nth <= 5)"""


def _eda() -> str:
    """Types and samples of the raw table (raw), all else of the cleaned one (d)."""
    of_raw = lambda text: re.sub(r"\bFROM d\b", "FROM raw", text)
    cleaned = ", ".join("raw_amount AS total_amount" if c == "total_amount" else c for c in COLUMNS)
    numbers = describe("d", {c: number(c) for c in ("total_amount", "qty", "age")}, COLUMNS)
    return f"""WITH RECURSIVE raw AS ({DIRTY.format(orders="orders")}), {of_raw(_CLEAN)}, d AS (SELECT row_id, {cleaned} FROM fin), {of_raw(_PROFILE)}, {_REPORT}, {numbers}, {_DATES} {_DETAIL}"""


_NOTICES = f""", {_REPORT}, {_OUT}, nt AS (
 SELECT 'missing-' || "column" AS id, severity, count, 0 AS kind, row_number() OVER (ORDER BY count DESC, idx) AS nth FROM rep WHERE check_name = 'missing-values' AND count > 0 QUALIFY nth <= 2
 UNION ALL SELECT 'duplicates', severity, count, 1, 1 FROM rep WHERE check_name = 'duplicate-rows' AND count > 0
 UNION ALL (SELECT 'outliers-' || "column", 'warning', n_outliers, 2, row_number() OVER (ORDER BY n_outliers DESC, idx) AS nth FROM oc WHERE n_outliers > 0 QUALIFY nth <= 2)
 UNION ALL (SELECT 'inconsistent-' || "column", severity, count, 3, row_number() OVER (ORDER BY idx) AS nth FROM rep WHERE check_name = 'inconsistent-categoricals' QUALIFY nth <= 1))
 SELECT row_number() OVER (ORDER BY {_RANK}, kind, nth)::INT AS rank, id, severity, count FROM nt QUALIFY rank <= 4"""


def each_segment(query: str) -> str:
    """The query over all rows and over the rows of each segment of the planted table, apart."""
    views = [("NULL::VARCHAR", "true"), *((f"'S{k}'", f"{trim('segment_cd')} = 'S{k}'") for k in range(8))]
    parts = [f"SELECT {name} AS segment, v{k}.* FROM (WITH RECURSIVE d AS (SELECT * FROM dd WHERE {rule}){query}) v{k}" for k, (name, rule) in enumerate(views)]
    return f"WITH dd AS MATERIALIZED ({DIRTY.format(orders='orders')}) " + " UNION ALL ".join(parts)


ORACLE: dict[str, str] = {
    "table_stats": sql(f" SELECT count(*) AS n_rows, {len(COLUMNS) + 1}::BIGINT AS n_columns FROM d"),
    "classify_values": sql(f' SELECT "column", v AS class, count(*) AS n FROM ({long(lambda c: bucket(c, True))}) WHERE v IS NOT NULL GROUP BY ALL'),
    "infer_types": sql(f', {_TYPES} SELECT "column", idx, data_type FROM types'),
    "sample_values": sql(f', {_SAMPLES} SELECT "column", idx, value, r::INT AS rank FROM sv WHERE r <= 5'),
    "structural_profile": sql(f", {_PROFILE} SELECT * FROM prof"),
    "structural_gaps": sql(f""", {_PROFILE} SELECT "column", idx FROM prof WHERE data_type = 'null'"""),
    "dictionary_tags": sql(f""", {_PROFILE} SELECT "column", idx, array_to_string(list_filter(['type:' || data_type, CASE WHEN data_type = 'null' THEN 'quality:all-null' END, CASE WHEN samples = '' THEN 'quality:no-sample-values' END], lambda x: x IS NOT NULL), ',') AS tags FROM prof"""),
    "tag_facets": sql(f""", {_PROFILE}, tg AS (SELECT unnest(['type:' || data_type, CASE WHEN data_type = 'null' THEN 'quality:all-null' END, CASE WHEN samples = '' THEN 'quality:no-sample-values' END]) AS tag FROM prof) SELECT tag, count(*) AS n_items FROM tg WHERE tag IS NOT NULL GROUP BY 1"""),
    "missing_values": sql(f", {_MISSING} SELECT {_FINDING} FROM miss"),
    "missing_ranked": sql(f""", {_MISSING} SELECT "column", idx, count FROM miss WHERE count > 0"""),
    "duplicate_rows": sql(f", {_DUPS} SELECT {_FINDING}, groups FROM dup"),
    "duplicate_samples": sql(f" SELECT row_id, order_id FROM (SELECT row_id, order_id, row_number() OVER (PARTITION BY {', '.join(COLUMNS)} ORDER BY row_id) AS nth FROM d) WHERE nth > 1 ORDER BY row_id LIMIT 5"),
    "mixed_types": sql(f", {_MIXED} SELECT {_FINDING}, dominant FROM mix"),
    "mixed_type_examples": sql(f""", {_EXAMPLES} SELECT "column", place::INT AS place, bucket, value FROM e2 WHERE place <= 5"""),
    "category_values": sql(f', {_VALUES} SELECT "column", idx, value, n FROM cv'),
    "near_duplicate_pairs": sql(f', {_VALUES} SELECT "column", a, b FROM pairs'),
    "inconsistent_categoricals": sql(f", {_CLUSTERS} SELECT {_FINDING}, clusters FROM inc"),
    "quality_report": sql(f", {_REPORT} SELECT * FROM rep"),
    "quality_highlights": sql(f""", {_REPORT} SELECT check_name, "column", count, percentage, severity FROM rep WHERE count > 0 ORDER BY {_RANK}, check_order, idx LIMIT 10"""),
    "quality_concerns": sql(f""", {_REPORT} SELECT check_name, "column", count FROM rep WHERE severity <> 'info' AND count > 0"""),
    "quality_totals": sql(f""", {_REPORT}, {_OUT} SELECT sum(CASE WHEN check_name = 'missing-values' THEN count ELSE 0 END)::BIGINT AS missing_cells, count(*) FILTER (check_name = 'missing-values' AND count > 0) AS columns_missing,
 sum(CASE WHEN check_name = 'duplicate-rows' THEN count ELSE 0 END)::BIGINT AS duplicates, min(CASE WHEN count > 0 THEN {_RANK} END) AS worst, (SELECT sum(n_outliers)::BIGINT FROM oc) AS outliers FROM rep"""),
    "dashboard_notices": sql(_NOTICES),
    "segment_notices": each_segment(_NOTICES),
    "segment_quality_report": each_segment(f", {_REPORT} SELECT * FROM rep"),
    "numeric_describe": sql(f', {_DN} SELECT "column", idx, n, {_STATS} FROM ds'),
    "numeric_describe_lineitem": f'WITH {describe("lineitem", {c: c for c in _MEASURES}, _MEASURES)} SELECT "column", idx, n, {_STATS} FROM ds',
    "exact_quantiles": "SELECT share, round(quantile, 4) AS value FROM (SELECT unnest([0.05, 0.5, 0.95]) AS share, unnest(quantile_cont(l_extendedprice, [0.05, 0.5, 0.95])) AS quantile FROM lineitem)",
    "outlier_rows": sql(f', {_OUT} SELECT "column", row_id, value FROM outs'),
    "outlier_counts": sql(f', {_OUT} SELECT "column", idx, n_outliers, round(percentage, 6) AS percentage, severity FROM oc'),
    "numeric_distribution": """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, (max(l_extendedprice) - min(l_extendedprice)) / 6 AS w FROM lineitem),
 c AS (SELECT least(5, floor((l_extendedprice - e.lo) / e.w))::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
 SELECT b.bin::INT AS bin, round(e.lo + b.bin * e.w, 4) AS lo, round(CASE WHEN b.bin = 5 THEN e.hi ELSE e.lo + (b.bin + 1) * e.w END, 4) AS hi, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(0, 6)) AS bin) b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin""",
    "date_values": sql(f", {_DATES} SELECT row_id, original, normalized, format, flag FROM dv"),
    "typed_date_values": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS normalized, 'Date-object' AS format, count(*) AS n FROM orders GROUP BY ALL",
    "flagged_dates": sql(f", {_DATES} SELECT row_id, original, normalized, flag AS reason FROM dv WHERE flag IS NOT NULL"),
    "detect_date_columns": sql(f' SELECT "column", idx, n_parsed, n_filled, coalesce(n_parsed / nullif(n_filled, 0) >= 0.7, false) AS is_date FROM ({_DATE_COLUMNS})'),
    "date_profile": sql(f""", {_DATES} SELECT 'order_date' AS "column", 0 AS idx, min(normalized) AS earliest, max(normalized) AS latest, date_diff('day', min(day), max(day))::INT AS duration_days,
 (SELECT string_agg(DISTINCT format, ', ' ORDER BY format) FROM dv) AS formats, count(flag) AS n_flagged FROM dv"""),
    "trend_monthly": sql(f", {_DATES} SELECT strftime(day, '%Y-%m') AS month, count(*) AS n FROM dv WHERE day IS NOT NULL GROUP BY 1"),
    "apply_cleaning_plan": sql(f", {_CLEAN} SELECT row_id, order_id, channel, status, segment_cd, amount, qty::BIGINT AS qty, order_date, is_gift, notes FROM fin"),
    "typed_cleaning_plan": sql(f""", {_CLEAN} SELECT row_id, CASE WHEN ch2 IS NULL OR {trim("ch2")} = '' THEN 'unknown' ELSE ch2 END AS channel, round(ta, 2) AS total_amount,
 CASE WHEN ta IS NULL AND NOT {empty("total_amount")} THEN total_amount END AS total_amount_uncoerced, try_cast(od AS DATE)::VARCHAR AS order_date,
 CASE WHEN try_cast(od AS DATE) IS NULL AND NOT {empty("order_date")} THEN order_date END AS order_date_uncoerced, gf = 'true' AS is_gift, CASE WHEN gf IS NULL AND NOT {empty("is_gift")} THEN is_gift END AS is_gift_uncoerced
 FROM st WHERE NOT {empty("segment_cd")}"""),
    "audit_counts": sql(f", {_CLEAN} SELECT * FROM audit"),
    "cleaning_summary": sql(f", {_CLEAN} SELECT change_type, count(*) AS entries, sum(CASE WHEN applied THEN affected_rows ELSE 0 END)::BIGINT AS applied_rows FROM audit GROUP BY 1"),
    "changed_columns": sql(f""", {_CLEAN} SELECT DISTINCT "column" FROM audit WHERE applied AND change_type IN ('value-mapping', 'type-coercion')"""),
    "raw_vs_cleaned": sql(f""", {_CLEAN} SELECT (SELECT count(*) FROM d) AS raw_rows, (SELECT count(*) FROM fin) AS cleaned_rows, (SELECT count(DISTINCT "column") FROM audit WHERE applied AND change_type IN ('value-mapping', 'type-coercion')) AS n_changed_columns"""),
    "preview": sql(" SELECT row_id, order_id, channel, status FROM d ORDER BY row_id LIMIT 50"),
    "filter_by_category": sql(f" SELECT row_id, channel FROM d WHERE {trim('channel')} = 'Web'"),
    "kpi_rows_in_view": sql(f" SELECT count(*) AS n_rows, round(count(*) * 100.0 / (SELECT count(*) FROM d), 6) AS percentage FROM d WHERE {trim('segment_cd')} = 'S3'"),
    "kpi_measure": sql(f" SELECT round(sum({_AMOUNT}), 2) AS total, round(avg({_AMOUNT}), 4) AS mean, count({_AMOUNT}) AS n FROM d WHERE {trim('segment_cd')} = 'S3'"),
    "kpi_top_category": sql(f" SELECT {trim('status')} AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM d), 6) AS percentage FROM d GROUP BY 1 ORDER BY n DESC, min(row_id) LIMIT 1"),
    "segment_kpis": sql(f""", b AS (SELECT {_cat("segment_cd")} AS segment, {_AMOUNT} AS x FROM d)
 SELECT segment, is_total, n_rows, round(n_rows * 100.0 / (SELECT count(*) FROM b), 6) AS percentage, round(total, 2) AS total, round(mean, 4) AS mean FROM (SELECT segment, grouping(segment) = 1 AS is_total, count(*) AS n_rows, sum(x) AS total, avg(x) AS mean FROM b GROUP BY ROLLUP (segment)) WHERE is_total OR segment IS NOT NULL"""),
    "row_index": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS n, p_partkey FROM part",  # the file is in the order of its key
    "category_breakdown": f"WITH {fold('SELECT p_brand AS name, count(*) AS value, min(p_partkey) AS seen FROM part GROUP BY 1')} SELECT name, place, value::BIGINT AS value FROM fo",
    "category_measure_breakdown": f"WITH {fold('SELECT l_returnflag AS name, sum(l_extendedprice) AS value, min(l_orderkey) AS seen FROM lineitem GROUP BY 1')} SELECT name, place, round(value, 2) AS value FROM fo",
    "distinct_categories": sql(f""", {_CATS} SELECT "column", idx, n_values, array_to_string(vals, '|') AS vals FROM dc"""),
    "rank_filter_columns": sql(f""", {_CATS}, {_CLUSTERS} SELECT dc."column", n_values, coalesce(inc.clusters, 0) AS messiness, row_number() OVER (ORDER BY coalesce(inc.clusters, 0), n_values DESC, dc.idx)::INT AS rank FROM dc LEFT JOIN inc ON dc."column" = inc."column" """),
    "choose_charts": sql(f", {_DATES}, {_CHARTS} SELECT chart::INT AS chart, id, place, label, round(value, 2) AS value FROM c1 UNION ALL SELECT chart::INT, id, place, label, round(value, 2) FROM c2"),
    "normalize_category": sql(f" SELECT regexp_replace(lower({trim('channel')}), '\\s+', ' ', 'g') AS norm, count(*) AS n FROM d WHERE NOT {empty('channel')} GROUP BY 1"),
    "escape_cell": """SELECT event_id, CASE WHEN regexp_matches(props, '[",\\r\\n]') THEN '"' || replace(props, '"', '""') || '"' ELSE props END AS csv, replace(props, '|', '\\|') AS markdown FROM events""",
    "column_detail": sql(f", {_PROFILE}, {_REPORT}, {_DN}, {_DATES} {_DETAIL}"),
    "eda": _eda(),
    "column_structure_report": sql(f""", {_PROFILE}, {_DN}, {_DATES} SELECT prof."column", prof.idx, data_type, CASE WHEN prof."column" = 'order_date' THEN (SELECT min(normalized) || ' to ' || max(normalized) FROM dv)
 WHEN mean IS NOT NULL THEN 'mean ' || round(mean, 2) || ' min ' || round(min, 2) || ' max ' || round(max, 2) ELSE '' END AS note FROM prof LEFT JOIN ds ON prof."column" = ds."column" """),
    "dictionary_attach": sql(f', {_PROFILE} SELECT idx AS place, samples AS description, "column", data_type FROM prof'),
    "tag_filter": sql(f""", {_PROFILE} SELECT "column", idx FROM prof WHERE data_type = 'string'"""),
    "tag_union": sql(f""", {_PROFILE} SELECT "column", idx, 'type:' || data_type || CASE WHEN data_type = 'null' THEN ',quality:all-null' ELSE '' END || CASE WHEN samples = '' THEN ',quality:no-sample-values' ELSE '' END
 || CASE WHEN data_type <> 'string' THEN ',type:string' ELSE '' END || ',reviewed' AS tags FROM prof"""),
    "outliers_ranked": sql(f', {_OUT} SELECT "column", idx, n_outliers FROM oc WHERE n_outliers > 0'),
    "finding_details": sql(f""", {_REPORT} SELECT check_name, "column", count || ' ' || CASE check_name {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTED.items())} END || CASE WHEN "column" <> '' THEN ' in ' || "column" ELSE '' END
 || ' (' || round(percentage, 1) || ' %)' AS description, CASE WHEN "column" = '' THEN '{",".join(COLUMNS)}' ELSE "column" END AS affected FROM rep WHERE count > 0"""),
    "finding_samples": sql(f""", {_CLUSTERS}, {_EXAMPLES}, dn AS (SELECT *, row_number() OVER (PARTITION BY {", ".join(COLUMNS)} ORDER BY row_id) AS nth FROM d),
 dp AS (SELECT array_to_string([{_CELLS}], '|') AS sample, row_number() OVER (ORDER BY row_id)::INT AS place FROM dn WHERE nth > 1),
 cg AS (SELECT "column", string_agg(value, ' / ' ORDER BY value) AS sample, row_number() OVER (PARTITION BY "column" ORDER BY cluster)::INT AS place FROM cl GROUP BY "column", cluster)
 SELECT 'duplicate-rows' AS check_name, '' AS "column", place, sample FROM dp WHERE place <= 5 UNION ALL SELECT 'inconsistent-categoricals', "column", place, sample FROM cg WHERE place <= 5
 UNION ALL SELECT 'mixed-types', "column", place::INT, bucket || ': ' || value FROM e2 WHERE place <= 5"""),
    "importance_sort": sql(f""", {_REPORT} SELECT check_name, "column", priority, CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS grade FROM (SELECT *, CASE severity WHEN 'error' THEN 'high' WHEN 'info' THEN 'low' ELSE 'medium' END AS priority FROM rep)"""),
    "item_bounds_check": sql(f""", {_REPORT} SELECT check_name AS group_id, CASE WHEN count > 0 THEN 'kpi' ELSE 'note' END AS type, count(*) AS n, count(*) FILTER ("column" = '') AS bad, count(*) BETWEEN 1 AND CASE WHEN count > 0 THEN 4 ELSE 9 END AS within_bounds FROM rep GROUP BY 1, 2, count > 0"""),
}
