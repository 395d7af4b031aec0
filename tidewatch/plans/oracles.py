"""SQL counterparts of the registered queries, written for DuckDB."""

from __future__ import annotations

from tidewatch.plans.standins import FLOW_EXPRESSIONS, NUMERIC, RAW_LABELS, ROW_KEY
from tidewatch.schema import (
    CATEGORICAL, DICTIONARY, FEATURE_NAMES, FLOW_SCHEMA,
)

KEYS = ", ".join(ROW_KEY)
ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def raw_label(number: str) -> str:
    return f"list_extract([{', '.join(map(text, RAW_LABELS))}], ({number} % {len(RAW_LABELS)} + 1)::int)"


# Written out here, not taken from the package: a wrong value there must show.
CATEGORY_CASE = """CASE lower({0})
  WHEN 'normal' THEN 'normal'
  WHEN 'back' THEN 'dos' WHEN 'land' THEN 'dos' WHEN 'neptune' THEN 'dos' WHEN 'pod' THEN 'dos'
  WHEN 'smurf' THEN 'dos' WHEN 'teardrop' THEN 'dos' WHEN 'apache2' THEN 'dos'
  WHEN 'udpstorm' THEN 'dos' WHEN 'processtable' THEN 'dos' WHEN 'mailbomb' THEN 'dos'
  WHEN 'satan' THEN 'probe' WHEN 'ipsweep' THEN 'probe' WHEN 'nmap' THEN 'probe'
  WHEN 'portsweep' THEN 'probe' WHEN 'mscan' THEN 'probe' WHEN 'saint' THEN 'probe'
  WHEN 'guess_passwd' THEN 'r2l' WHEN 'ftp_write' THEN 'r2l' WHEN 'imap' THEN 'r2l'
  WHEN 'phf' THEN 'r2l' WHEN 'multihop' THEN 'r2l' WHEN 'warezmaster' THEN 'r2l'
  WHEN 'warezclient' THEN 'r2l' WHEN 'spy' THEN 'r2l' WHEN 'xlock' THEN 'r2l'
  WHEN 'xsnoop' THEN 'r2l' WHEN 'snmpguess' THEN 'r2l' WHEN 'snmpgetattack' THEN 'r2l'
  WHEN 'httptunnel' THEN 'r2l' WHEN 'sendmail' THEN 'r2l' WHEN 'named' THEN 'r2l'
  WHEN 'buffer_overflow' THEN 'u2r' WHEN 'loadmodule' THEN 'u2r' WHEN 'rootkit' THEN 'u2r'
  WHEN 'perl' THEN 'u2r' WHEN 'sqlattack' THEN 'u2r' WHEN 'xterm' THEN 'u2r' WHEN 'ps' THEN 'u2r'
  ELSE 'unknown' END"""
LEVELS = {
    "CRITICAL": "land hot num_failed_logins num_compromised root_shell",
    "HIGH": "duration protocol_type flag src_bytes dst_bytes wrong_fragment logged_in su_attempted "
            "num_root num_shells num_access_files count srv_count serror_rate rerror_rate "
            "dst_host_serror_rate",
    "MEDIUM": "service urgent num_file_creations num_outbound_cmds is_guest_login srv_serror_rate "
              "srv_rerror_rate same_srv_rate diff_srv_rate srv_diff_host_rate "
              "dst_host_same_srv_rate dst_host_diff_srv_rate dst_host_srv_diff_host_rate "
              "dst_host_srv_serror_rate dst_host_rerror_rate dst_host_srv_rerror_rate",
    "LOW": "is_host_login dst_host_count dst_host_srv_count dst_host_same_src_port_rate",
}
LEVEL = {name: level for level, names in LEVELS.items() for name in names.split()}

SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
FLOW_SELECT = ", ".join(
    f'CAST({raw_label("l_orderkey") if f.name == "label" else FLOW_EXPRESSIONS[f.name]} '
    f'AS {SQL_TYPES[f.dataType.simpleString()]}) AS "{f.name}"' for f in FLOW_SCHEMA)
FLOWS = f"flows AS (SELECT {KEYS}, {FLOW_SELECT} FROM lineitem)"
FLOW_FEATURES = ", ".join(f'"{c}"' for c in FEATURE_NAMES)
FLOW_NUMERIC = [c for c in FEATURE_NAMES if c not in CATEGORICAL]
CLEAN = "replace(label, '.', '')"
EVENT_LABELS = f"e AS (SELECT event_id, {raw_label('event_id')} AS label FROM events)"

# --- sources, labels, projections -------------------------------------------------------------

ORACLES["scan_flows"] = f"""
WITH {FLOWS} SELECT {FLOW_FEATURES}, {CATEGORY_CASE.format(CLEAN)} AS label FROM flows"""
ORACLES["scan_flows_binary"] = f"""
WITH {FLOWS} SELECT CASE WHEN {CLEAN} = 'normal' THEN 'normal' ELSE 'attack' END AS label,
  count(*) AS count FROM flows GROUP BY 1"""
ORACLES["scan_unlabelled"] = f"WITH {FLOWS} SELECT {FLOW_FEATURES} FROM flows"
REQUESTS = """q AS (SELECT vec_id // 50 AS request_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(vec_id) AS ts, (vec_id % 50)::int AS pos,
  embedding::DOUBLE[] AS features, vec_id FROM embeddings)"""
ORACLES["scan_requests"] = f"""
WITH {REQUESTS} SELECT request_id, ts, pos, len(features)::int AS n_features,
  {r6('list_sum(features)', 'feature_sum')} FROM q"""
ORACLES["scan_nested_requests"] = f"""
WITH {REQUESTS} SELECT request_id, min(ts) OVER (PARTITION BY request_id) AS ts, pos, len(features)::int AS n_features,
  {r6('list_sum(features)', 'feature_sum')}, request_id % 2 = 0 AS return_scores FROM q"""
ORACLES["label_clean"] = f"WITH {EVENT_LABELS} SELECT event_id, {CLEAN} AS label FROM e"
ORACLES["label_binary"] = f"""
WITH {EVENT_LABELS} SELECT event_id,
  CASE WHEN {CLEAN} = 'normal' THEN 'normal' ELSE 'attack' END AS label FROM e"""
ORACLES["label_category"] = f"""
WITH {EVENT_LABELS} SELECT event_id, {CATEGORY_CASE.format(CLEAN)} AS category FROM e"""
ORACLES["split_columns"] = f"""
WITH {FLOWS} SELECT {', '.join(r6(f'sum("{c}"::double)', f'"{c}"') for c in FLOW_NUMERIC)}
FROM flows"""
ORACLES["high_importance"] = f"""
WITH {FLOWS} SELECT {KEYS}, {', '.join(f'"{n}"' for n in FEATURE_NAMES
                                       if LEVEL[n] in ('HIGH', 'CRITICAL'))} FROM flows"""
ORACLES["feature_dictionary"] = f"""
WITH {FLOWS}, d(ordinal, feature, importance, description) AS (VALUES
{', '.join(f'({i}, {text(n)}, {text(LEVEL[n])}, {text(note)})'
           for i, (n, _, note) in enumerate(DICTIONARY))}),
m AS (SELECT {', '.join(f'stddev_pop("{c}"::double) AS "{c}"' for c in FLOW_NUMERIC)} FROM flows),
u AS (UNPIVOT m ON COLUMNS(*) INTO NAME feature VALUE scale)
SELECT d.ordinal::int AS ordinal, d.feature, d.description, d.importance AS importance_level,
  {r6('CASE WHEN u.scale = 0 THEN 1.0 ELSE u.scale END', 'scale')} FROM u JOIN d USING (feature)"""
CONNS = """c AS (SELECT ts, event_id AS conn_id, (event_id * 7 % 40)::varchar AS src_ip,
  (props->>'$.k')::int AS src_port, user_id::varchar AS dst_ip,
  ((props->>'$.k')::int % 5 * 10) AS dst_port, ((props->>'$.k')::int % 5)::varchar AS service,
  (event_type = 'error')::int AS syn, (event_type = 'signup')::int AS rej FROM events)"""
ORACLES["land"] = f"""
WITH {CONNS} SELECT conn_id, (src_ip = dst_ip AND src_port = dst_port)::int AS land FROM c"""
GRADE = """CASE WHEN {0} >= 0.8 THEN 'high' WHEN {0} >= 0.6 THEN 'medium'
  WHEN {0} >= 0.3 THEN 'low' ELSE 'none' END"""
ORACLES["severity_grades"] = f"""
WITH s AS (SELECT event_id, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())
  AS score FROM events)
SELECT event_id, {r6('score', 'score')}, {GRADE.format('score')} AS severity FROM s"""

# --- data-set summaries -----------------------------------------------------------------------

ORACLES["dataset_summary"] = "SELECT count(*) AS samples, 41 AS features FROM lineitem"
ORACLES["label_distribution"] = f"""
WITH {FLOWS} SELECT {CATEGORY_CASE.format(CLEAN)} AS label, count(*) AS count
FROM flows GROUP BY 1"""
ORACLES["class_weights"] = f"""
WITH {FLOWS}, n AS (SELECT {CATEGORY_CASE.format(CLEAN)} AS label, count(*) AS n
  FROM flows GROUP BY 1)
SELECT label, n, {r6('(SELECT sum(n) FROM n)::double / ((SELECT count(*) FROM n) * n)', 'weight')}
FROM n"""


def unit(string: str) -> str:
    return f"(('0x' || substr(md5({string}), 1, 8))::bigint / 4294967296.0)"


ROW_TEXT = " || '|' || ".join(ROW_KEY)
ORACLES["hash_split"] = f"""
SELECT {KEYS}, CASE WHEN {unit("'42|split|' || " + ROW_TEXT)} < 0.2 THEN 'test'
  ELSE 'train' END AS part FROM lineitem"""

# --- scaling and encoding ---------------------------------------------------------------------


def _scale(centre: str, spread: str) -> str:
    stats = ", ".join(f"{centre.format(c)} AS c_{c}, {spread.format(c)} AS s_{c}" for c in NUMERIC)
    out = ", ".join(r6(f"({c} - c_{c}) / s_{c}", f"{c}_scaled") for c in NUMERIC)
    return f"WITH s AS (SELECT {stats} FROM lineitem) SELECT {KEYS}, {out} FROM lineitem, s"


ORACLES["scale_standard"] = _scale("avg({0})", "stddev_pop({0})")
ORACLES["scale_minmax"] = _scale("min({0})", "max({0}) - min({0})")
ORACLES["scale_robust"] = _scale(
    "quantile_cont({0}, 0.5)", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)")
ORACLES["robust_parameters"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'quantile_cont({c}, 0.25)', 'q1')}, "
    f"{r6(f'quantile_cont({c}, 0.5)', 'median')}, {r6(f'quantile_cont({c}, 0.75)', 'q3')} "
    f"FROM lineitem" for c in NUMERIC)
ORACLES["encode_onehot"] = f"""
SELECT {KEYS}, (l_returnflag = 'A')::int AS flag_a, (l_returnflag = 'R')::int AS flag_r,
  (l_linestatus = 'F')::int AS status_f, (l_linestatus = 'O')::int AS status_o FROM lineitem"""
ORACLES["encode_label"] = f"""
SELECT {KEYS}, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE -1 END AS flag_code,
  CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS status_code FROM lineitem"""
_orders = "(SELECT count(DISTINCT l_orderkey) FROM lineitem)"
ORACLES["encode_wide"] = f"""
SELECT {KEYS}, 4 + {_orders} + (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS size, 6 AS filled,
  3 + dense_rank() OVER (ORDER BY l_orderkey::varchar) AS order_slot,
  3 + {_orders} + dense_rank() OVER (ORDER BY l_returnflag) AS flag_slot,
  {r6(f"({NUMERIC[0]} - avg({NUMERIC[0]}) OVER ()) / stddev_pop({NUMERIC[0]}) OVER ()", 's0')}, 1.0::double AS s5 FROM lineitem"""
_slots = [f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in NUMERIC] + [
    f"(l_returnflag = '{v}')::int::double" for v in "ANR"] + [
    f"(l_linestatus = '{v}')::int::double" for v in "FO"]
ORACLES["assemble_features"] = f"""
SELECT {KEYS}, {', '.join(r6(e, f's{i}') for i, e in enumerate(_slots))} FROM lineitem"""
_seen = (("protocol_type", ["icmp", "tcp", "udp"]),
         ("service", ["domain", "ftp", "http", "private", "smtp"]), ("flag", ["REJ", "S0", "SF"]))
_stats = ", ".join(f'avg("{c}"::double) AS "m_{c}", stddev_pop("{c}"::double) AS "d_{c}"'
                   for c in FLOW_NUMERIC)
_standard = [r6(f'(f."{c}"::double - m."m_{c}") / CASE WHEN m."d_{c}" = 0 THEN 1 ELSE m."d_{c}" END',
                f'"{c}"') for c in FLOW_NUMERIC]
_named = [f'(f.{c} = \'{v}\')::int::double AS "{c}_{v}"' for c, seen in _seen for v in seen]
ORACLES["flow_preprocess"] = f"""
WITH {FLOWS}, m AS (SELECT {_stats} FROM flows)
SELECT {KEYS}, {', '.join(_standard + _named)} FROM flows f, m"""

# --- isolation forest -------------------------------------------------------------------------


def forest(source: str, width: int, trees: int = 100, psi: int = 256, seed: int = 42,
           contamination: float = 0.1, depth: int = 8, fit_on: str = "true") -> str:
    """CTEs of a forest over ``source``, a query giving ``key`` (text), ``x`` (list) and more.

    ``grow`` carries the sampled rows down, ``splits`` the split of each inner node, ``nodes``
    the node table, ``scores`` the score of every row, ``cut`` threshold, least and greatest.
    Rows that are not ``fit_on`` are scored only.
    """
    path = ("depth + CASE WHEN n <= 1 THEN 0.0 WHEN n = 2 THEN 1.0 ELSE "
            "2.0 * (ln(n - 1.0::double) + 0.5772156649015329::double) - 2.0 * (n - 1.0::double) / n END")
    name = f"'{seed}|' || tree || '|' || node || '|"

    def split_of(rows: str) -> str:
        return f"""(SELECT tree, node, depth, f, CASE WHEN t >= hi THEN lo ELSE t END AS threshold
      FROM (SELECT tree, node, depth, p.f AS f, p.lo AS lo, p.hi AS hi,
          p.lo + {unit(name + "t'")} * (p.hi - p.lo) AS t
        FROM (SELECT tree, node, depth, c[1 + floor({unit(name + "f'")} * len(c))::int] AS p
          FROM (SELECT tree, node, depth,
              list({{'f': f, 'lo': lo, 'hi': hi}} ORDER BY f) AS c
            FROM (SELECT tree, node, depth, f, min(v) AS lo, max(v) AS hi
              FROM (SELECT tree, node, depth, unnest(range({width})) AS f, unnest(x) AS v
                FROM {rows} WHERE depth < {depth})
              GROUP BY tree, node, depth, f)
            WHERE lo < hi GROUP BY tree, node, depth))))"""

    return f"""
src AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM ({source})),
hashed AS MATERIALIZED (SELECT key, x, ('0x' || substr(md5('{seed}|' || key), 1, 8))::bigint AS a,
  ('0x' || substr(md5('{seed}|' || key), 9, 8))::bigint AS b FROM src WHERE {fit_on}),
drawn AS (SELECT tree::int AS tree, key, x, (a + tree * b) % 4294967296 AS h
  FROM hashed, range({trees}) t(tree)),
sample AS MATERIALIZED (SELECT * FROM (
  SELECT tree, key, x, row_number() OVER (PARTITION BY tree ORDER BY h, key) AS rank
  FROM drawn) WHERE rank <= {psi}),
grow AS (
  SELECT tree, 1::bigint AS node, 0 AS depth, x FROM sample
  UNION ALL
  SELECT g.tree, CASE WHEN g.x[s.f + 1] <= s.threshold THEN 2 * g.node ELSE 2 * g.node + 1 END,
    g.depth + 1, g.x
  FROM grow g JOIN {split_of('grow')} s ON g.tree = s.tree AND g.node = s.node),
splits AS MATERIALIZED {split_of('grow')},
nodes AS MATERIALIZED (
  SELECT n.tree, n.node, n.depth, coalesce(s.f, -1)::int AS feature, s.threshold, n.n,
    CASE WHEN s.f IS NULL THEN {path.replace('depth +', 'n.depth +', 1).replace('n - 1', 'n.n - 1')
                                .replace('n <= 1', 'n.n <= 1').replace('n = 2', 'n.n = 2')
                                .replace('/ n END', '/ n.n END')} END AS path
  FROM (SELECT tree, node, depth, count(*) AS n FROM grow GROUP BY tree, node, depth) n
  LEFT JOIN splits s ON n.tree = s.tree AND n.node = s.node),
walk AS (
  SELECT id, tree::int AS tree, 1::bigint AS node, 0 AS depth FROM src, range({trees}) t(tree)
  UNION ALL
  SELECT w.id, w.tree, CASE WHEN src.x[s.f + 1] <= s.threshold THEN 2 * w.node
    ELSE 2 * w.node + 1 END, w.depth + 1
  FROM walk w JOIN splits s ON w.tree = s.tree AND w.node = s.node JOIN src ON src.id = w.id),
scores AS MATERIALIZED (
  SELECT id, power(2.0, -(list_sum(list(n.path ORDER BY n.tree)) / {trees})
      / (2.0 * (ln(c - 1.0::double) + 0.5772156649015329::double) - 2.0 * (c - 1.0::double) / c))
    AS score
  FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node AND n.feature = -1,
    (SELECT least({psi}, count(*)) AS c FROM src WHERE {fit_on})
  GROUP BY id, c),
cut AS MATERIALIZED (SELECT quantile_cont(score, {1 - contamination}) AS threshold,
  min(score) AS low, max(score) AS high FROM scores JOIN src USING (id) WHERE {fit_on})"""


ITEM_SOURCE = f"SELECT {ROW_TEXT} AS key, [{', '.join(NUMERIC)}] AS x, * FROM lineitem"
ITEMS = f"WITH RECURSIVE {forest(ITEM_SOURCE, 4)}"
ITEM_ROWS = """rows AS (SELECT src.*, s.score, cut.threshold, cut.low, cut.high,
  CASE WHEN s.score > cut.threshold THEN 'anomaly' ELSE 'normal' END AS prediction
  FROM src JOIN scores s ON s.id = src.id, cut)"""
NORMAL = "(score - low) / (high - low)"

ORACLES["if_sample"] = f"{ITEMS} SELECT tree, rank, key FROM sample"
ORACLES["if_nodes"] = f"""{ITEMS}
SELECT tree, node, depth, feature, {r6('threshold', 'threshold')}, n, {r6('path', 'path')}
FROM nodes"""
ORACLES["if_scores"] = f"""{ITEMS}, {ITEM_ROWS}
SELECT {KEYS}, {r6('score', 'anomaly_score')} FROM rows"""
ORACLES["if_threshold"] = f"""{ITEMS}
SELECT (SELECT count(*) FROM src) AS total, {r6('threshold', 'threshold')},
  {r6('low', 'min_score')}, {r6('high', 'max_score')} FROM cut"""
ORACLES["if_detect"] = f"""{ITEMS}, {ITEM_ROWS}
SELECT {KEYS}, {r6('score', 'anomaly_score')}, prediction FROM rows"""
ORACLES["if_normalised"] = f"""{ITEMS}, {ITEM_ROWS}
SELECT {KEYS}, {r6(NORMAL, 'score')}, {GRADE.format(NORMAL)} AS severity FROM rows"""
ORACLES["if_normalised_train_scope"] = f"""{ITEMS}, {ITEM_ROWS}
SELECT {KEYS}, {r6(NORMAL, 'score')} FROM rows"""
ORACLES["anomaly_summary"] = f"""{ITEMS}, {ITEM_ROWS}
SELECT count(*) AS total_samples, count_if(prediction = 'anomaly') AS anomalies_found,
  {r6("100.0 * count_if(prediction = 'anomaly') / count(*)", 'anomaly_rate')} FROM rows"""
ORACLES["detections_sink"] = f"""{ITEMS}, {ITEM_ROWS}
SELECT {KEYS}, {', '.join(NUMERIC)}, prediction, {r6(NORMAL, 'anomaly_score')} FROM rows"""
ORACLES["security_event_log"] = f"""{ITEMS}, {ITEM_ROWS}
SELECT 'anomaly' AS event_type, {GRADE.format(NORMAL)} AS severity,
  l_suppkey::varchar AS source_ip, l_partkey::varchar AS destination_ip,
  l_orderkey::varchar AS details_order, l_linenumber::varchar AS details_line
FROM rows WHERE prediction = 'anomaly'"""
ORACLES["security_events_stored"] = f"""{ITEMS}, {ITEM_ROWS}
SELECT 'anomaly' AS event_type, {GRADE.format(NORMAL)} AS severity,
  l_suppkey::varchar AS source_ip, l_partkey::varchar AS destination_ip,
  l_orderkey::varchar AS details_order, l_linenumber::varchar AS details_line, date_trunc('year', l_shipdate)::date AS day
FROM rows WHERE prediction = 'anomaly' AND l_shipdate >= '1999-01-01'"""
ORACLES["model_roundtrip"] = ORACLES["if_detect"]
ORACLES["stream_scores"] = ORACLES["if_detect"]
STATS = f"""SELECT count(*) AS total_traffic_analyzed,
  count_if(prediction = 'anomaly') AS total_anomalies_detected,
  {r6("100.0 * count_if(prediction = 'anomaly') / count(*)", 'detection_rate')} FROM rows"""
ORACLES["stream_stats"] = f"{ITEMS}, {ITEM_ROWS} {STATS}"

VECTORS = ("WITH RECURSIVE " + forest(
    "SELECT vec_id::varchar AS key, embedding::DOUBLE[] AS x FROM embeddings", 64))
VECTOR_ROWS = f"""{REQUESTS}, rows AS (SELECT q.*, s.score,
  CASE WHEN s.score > cut.threshold THEN 'anomaly' ELSE 'normal' END AS prediction
  FROM q JOIN src ON src.key = q.vec_id::varchar JOIN scores s ON s.id = src.id, cut)"""
ORACLES["system_stats"] = f"{VECTORS}, {VECTOR_ROWS} {STATS}"
ORACLES["request_summary"] = f"""{VECTORS}, {VECTOR_ROWS}
SELECT request_id, count(*) AS total_samples, count_if(prediction = 'anomaly') AS anomalies_found
FROM rows GROUP BY request_id"""
REQUEST_SCORE = """CASE WHEN max(score) OVER p > min(score) OVER p
  THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 0.0 END"""
ORACLES["request_scores"] = f"""{VECTORS}, {VECTOR_ROWS}
SELECT request_id, pos, prediction, {r6(REQUEST_SCORE, 'anomaly_score')}
FROM rows WINDOW p AS (PARTITION BY request_id)"""
ORACLES["stream_request_scores"] = f"""{VECTORS}, {VECTOR_ROWS}
SELECT request_id, pos, prediction, {r6(REQUEST_SCORE, 'anomaly_score')}, 1 AS model_version
FROM rows WINDOW p AS (PARTITION BY request_id)"""
ALERTS = """a AS (SELECT 'alert_' || request_id AS id, max(ts) AS timestamp,
  count_if(prediction = 'anomaly') AS anomalies_found, count(*) AS total_samples
  FROM rows GROUP BY request_id HAVING count_if(prediction = 'anomaly') > 0)"""
ORACLES["alerts"] = f"""{VECTORS}, {VECTOR_ROWS}, {ALERTS}
SELECT id, timestamp, anomalies_found, total_samples FROM a"""
ORACLES["stream_alerts"] = ORACLES["alerts"]
ORACLES["recent_alerts"] = f"""{VECTORS}, {VECTOR_ROWS}, {ALERTS}
SELECT id, timestamp, anomalies_found, total_samples, (SELECT count(*) FROM a) AS total_alerts
FROM a ORDER BY timestamp DESC, length(id) DESC, id DESC LIMIT 5"""
ORACLES["stream_recent_alerts"] = ORACLES["recent_alerts"]
# Half a request's vectors are a day later; halves on both sides of a closing are two alerts, of
# closed days (before the third, before the fourth) or open ones.
ORACLES["latest_alerts_of_days"] = f"""{VECTORS}, {VECTOR_ROWS},
p AS (SELECT request_id, prediction,
        ts + to_days((request_id % 5 + CASE WHEN pos < 20 THEN 0 ELSE 1 END)::int) AS ts FROM rows),
e AS (SELECT *, CASE WHEN ts < '2024-01-03' THEN 1 WHEN ts < '2024-01-04' THEN 2 ELSE 3 END AS era FROM (
        SELECT request_id, prediction, max(ts) OVER (PARTITION BY request_id, ts::date) AS ts FROM p)),
a AS (SELECT 'alert_' || request_id AS id, max(ts) AS timestamp, count_if(prediction = 'anomaly') AS anomalies_found,
        count(*) AS total_samples FROM e GROUP BY request_id, era HAVING count_if(prediction = 'anomaly') > 0)
SELECT id, timestamp, anomalies_found, total_samples, (SELECT count(*) FROM a) AS total_alerts
FROM a ORDER BY timestamp DESC, length(id) DESC, id DESC LIMIT 5"""
_minmax = [f"""((f."{c}"::double - m."lo_{c}"::double)
  / CASE WHEN m."hi_{c}" = m."lo_{c}" THEN 1.0::double
      ELSE (m."hi_{c}" - m."lo_{c}")::double END)""" for c in FLOW_NUMERIC]
_onehot = [f"(f.{c} = '{v}')::int::double" for c, seen in _seen for v in seen]
_limits = ", ".join(f'min("{c}") AS "lo_{c}", max("{c}") AS "hi_{c}"' for c in FLOW_NUMERIC)
ORACLES["detect_flows"] = f"""
WITH RECURSIVE {FLOWS}, m AS (SELECT {_limits} FROM flows),
{forest(f"SELECT {ROW_TEXT} AS key, [{', '.join(_minmax + _onehot)}] AS x, {KEYS} FROM flows f, m",
        len(_minmax + _onehot))}, {ITEM_ROWS}
SELECT {KEYS}, prediction, {r6(NORMAL, 'anomaly_score')} FROM rows"""
ORACLES["detect_report"] = f"""
WITH d AS ({ORACLES["detect_flows"]})
SELECT count(*) AS rows_written, count_if(prediction = 'anomaly') AS anomalies_written,
  count(*) AS total_samples, count_if(prediction = 'anomaly') AS anomalies_found,
  {r6("100.0 * count_if(prediction = 'anomaly') / count(*)", 'anomaly_rate')} FROM d"""
ORACLES["detect_without_score"] = f"{ITEMS}, {ITEM_ROWS} SELECT {KEYS}, prediction FROM rows"
ORACLES["load_flow_sets"] = f"""
WITH {FLOWS}, b AS (SELECT *, CASE WHEN {CLEAN} = 'normal' THEN 'normal' ELSE 'attack' END AS kind
  FROM flows)
SELECT part, kind AS label, count(*) AS flows, sum(src_bytes)::bigint AS src_bytes
FROM b, (VALUES ('train'), ('test')) p(part)
WHERE part = 'train' OR protocol_type = 'tcp' GROUP BY ALL"""

# --- random forest ----------------------------------------------------------------------------

# Every cut of every feature, by the weighted Gini impurity of the two sides.
ORACLES["rf_stump"] = f"""
WITH l AS (SELECT *, (l_quantity + 3 * l_linenumber > 45)::int AS y FROM lineitem),
k AS (SELECT y, count(*)::double AS n FROM l GROUP BY y),
w AS (SELECT l.*, (SELECT count(*) FROM l) / (2.0 * k.n) AS w FROM l JOIN k USING (y)),
long AS (UNPIVOT (SELECT y, w, l_quantity::double AS l_quantity, l_linenumber::double AS l_linenumber,
  l_discount::double AS l_discount FROM w) ON l_quantity, l_linenumber, l_discount INTO NAME f VALUE v),
cells AS (SELECT f, v, sum(w * y) AS a, sum(w) AS n FROM long GROUP BY f, v),
sides AS (SELECT f, v, sum(a) OVER up AS a, sum(n) OVER up AS n, sum(a) OVER (PARTITION BY f) AS ta,
  sum(n) OVER (PARTITION BY f) AS tn FROM cells WINDOW up AS (PARTITION BY f ORDER BY v)),
cut AS (SELECT f, v, a / n AS left_p, (ta - a) / (tn - n) AS right_p FROM sides WHERE tn - n > 1e-9
  ORDER BY n * 2 * (a / n) * (1 - a / n) + (tn - n) * 2 * ((ta - a) / (tn - n)) * (1 - (ta - a) / (tn - n))
  LIMIT 1),
p AS (SELECT l.*, cut.f, CASE WHEN (CASE cut.f WHEN 'l_quantity' THEN l_quantity
    WHEN 'l_linenumber' THEN l_linenumber ELSE l_discount END) <= cut.v THEN left_p ELSE right_p END AS p
  FROM l, cut)
SELECT {KEYS}, CASE WHEN y = 1 THEN 'attack' ELSE 'normal' END AS label,
  CASE WHEN p >= 0.5 THEN 'attack' ELSE 'normal' END AS predicted, {r6('p', 'p_attack')},
  {r6('1 - p', 'p_normal')}, f AS top_feature, 1.0::double AS importance FROM p"""
ORACLES["rf_predict"] = """
SELECT vec_id, label, (SELECT count(DISTINCT label) FROM embeddings)::int AS classes,
  1.0::double AS probability_sum, true AS predicts_likeliest FROM embeddings"""
ORACLES["rf_importance"] = """
SELECT max(len(embedding))::int AS features, max(len(embedding)) AS slots,
  1.0::double AS importance_sum, true AS none_negative, 10::bigint AS top FROM embeddings"""
ORACLES["rf_evaluate"] = """
SELECT 'class' AS kind, label::varchar AS class, count(*) AS support, true AS beats_majority
FROM embeddings GROUP BY label
UNION ALL SELECT k, k, (SELECT count(*) FROM embeddings), true
FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) v(k)"""
ORACLES["rf_flows"] = f"""
WITH {FLOWS} SELECT count(*) AS test_rows, (SELECT count(DISTINCT CASE WHEN flag = 'S0' THEN 'dos'
  WHEN protocol_type = 'icmp' THEN 'probe' ELSE 'normal' END) FROM flows)::int AS classes,
  true AS accurate
FROM flows WHERE {unit("'42|split|' || " + ROW_TEXT)} < 0.2"""
ORACLES["zscore_verdict"] = f"""
WITH z AS (SELECT abs((l_extendedprice - avg(l_extendedprice) OVER ())
  / stddev_pop(l_extendedprice) OVER ()) > 1.5 AS hit FROM lineitem)
SELECT count(*) AS total_samples, count_if(hit) AS anomalies_found,
  {r6('100.0 * count_if(hit) / count(*)', 'anomaly_rate')} FROM z"""

# --- metrics ----------------------------------------------------------------------------------

QUALITY = "j AS (SELECT toxic AS truth, 1 - quality AS flag FROM labels)"
JUDGED = f"""{ITEM_ROWS}, j AS (SELECT (l_returnflag = 'R')::int AS truth,
  (prediction = 'anomaly')::int AS flag, score FROM rows)"""
CELLS = """SELECT a.v::int AS actual, p.v::int AS predicted,
  (SELECT count(*) FROM j WHERE truth = a.v AND flag = p.v) AS n
FROM range(2) a(v), range(2) p(v)"""
COUNTS = """k AS (SELECT count(*)::double AS n, count_if(truth = flag)::double AS hits,
  count_if(truth = 1 AND flag = 1)::double AS tp, count_if(flag = 1)::double AS flagged,
  count_if(truth = 1)::double AS pos FROM j),
rates AS (SELECT hits / n AS accuracy, CASE WHEN flagged = 0 THEN 0.0 ELSE tp / flagged END AS p,
  CASE WHEN pos = 0 THEN 0.0 ELSE tp / pos END AS r FROM k)"""
BINARY = ", ".join([r6("accuracy", "accuracy"), r6("p", '"precision"'), r6("r", "recall"),
                    r6("CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END", "f1_score")])


def auc(rows: str) -> str:
    """Share of (positive, negative) pairs ranked right, equal scores at half."""
    return f"""(SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) FROM (
    SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0)::double AS below
    FROM (SELECT score, count_if(truth = 1)::double AS pos, count_if(truth = 0)::double AS neg
      FROM {rows} GROUP BY score)))"""


ORACLES["confusion_matrix"] = f"WITH {QUALITY} {CELLS}"
ORACLES["binary_metrics"] = f"WITH {QUALITY}, {COUNTS} SELECT {BINARY} FROM rates"
ORACLES["if_confusion_matrix"] = f"{ITEMS}, {JUDGED} {CELLS}"
ORACLES["if_evaluate"] = f"""{ITEMS}, {JUDGED}, {COUNTS}
SELECT {BINARY}, {r6(auc('j'), 'roc_auc')} FROM rates"""
ORACLES["roc_auc"] = f"""
WITH j AS (SELECT (l_returnflag = 'R')::int AS truth, floor(l_extendedprice) AS score
  FROM lineitem)
SELECT (SELECT count(*) FROM j) AS n, {r6(auc('j'), 'roc_auc')}"""
PER_CLASS = """t AS (SELECT l_returnflag AS actual, CASE l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N'
  ELSE 'X' END AS predicted FROM lineitem),
n AS (SELECT class, (SELECT count(*) FROM t WHERE actual = class) AS support,
    (SELECT count(*) FROM t WHERE predicted = class)::double AS guessed,
    (SELECT count(*) FROM t WHERE actual = class AND predicted = class)::double AS hits
  FROM (SELECT actual AS class FROM t UNION SELECT predicted FROM t)),
pr AS (SELECT *, CASE WHEN guessed = 0 THEN 0.0 ELSE hits / guessed END AS p,
  CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS r FROM n),
c AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM pr)"""
ORACLES["weighted_metrics"] = f"""
WITH {PER_CLASS} SELECT {r6('sum(hits) / sum(support)', 'accuracy')},
  {r6('sum(p * support) / sum(support)', '"precision"')},
  {r6('sum(r * support) / sum(support)', 'recall')},
  {r6('sum(f * support) / sum(support)', 'f1_score')} FROM c"""
ORACLES["class_report"] = f"""
WITH {PER_CLASS}, o AS (
SELECT 'class' AS kind, class, p, r, f, support FROM c
UNION ALL SELECT 'accuracy', 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support),
  sum(hits) / sum(support), sum(support)::bigint FROM c
UNION ALL SELECT 'macro avg', 'macro avg', avg(p), avg(r), avg(f), sum(support)::bigint FROM c
UNION ALL SELECT 'weighted avg', 'weighted avg', sum(p * support) / sum(support),
  sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support)::bigint FROM c)
SELECT kind, class, {r6('p', '"precision"')}, {r6('r', 'recall')}, {r6('f', 'f1_score')}, support
FROM o"""

_train_limits = ", ".join(f'min("{c}") AS "lo_{c}", max("{c}") AS "hi_{c}"' for c in FLOW_NUMERIC)
_in_train = f"""{unit("'42|split|' || " + ROW_TEXT)} >= 0.2"""
ORACLES["train_detector"] = f"""
WITH RECURSIVE {FLOWS}, m AS (SELECT {_train_limits} FROM flows WHERE {_in_train}),
{forest(f"SELECT {ROW_TEXT} AS key, [{', '.join(_minmax + _onehot)}] AS x, {_in_train} AS train, "
        f"({CLEAN} <> 'normal')::int AS truth FROM flows f, m",
        len(_minmax + _onehot), fit_on="train")}, {ITEM_ROWS},
j AS (SELECT truth, (prediction = 'anomaly')::int AS flag, score FROM rows WHERE NOT train),
{COUNTS}
SELECT {', '.join(f"(SELECT count(*) FROM j WHERE truth = {t} AND flag = {f}) AS {n}"
                  for n, t, f in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))},
  {BINARY}, {r6(auc('j'), 'roc_auc')} FROM rates"""

# --- windowed traffic features ----------------------------------------------------------------


def windows(seconds: int) -> str:
    frame = f"ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW"
    return f"""{CONNS}, w AS (SELECT *,
  count(*) OVER h AS hn, sum(syn) OVER h AS hs, sum(rej) OVER h AS hr,
  count(*) OVER s AS sn, sum(syn) OVER s AS ss, sum(rej) OVER s AS sr, count(*) OVER p AS pn,
  list({{'v': service, 'i': src_ip, 'p': src_port, 's': syn, 'r': rej}}) OVER l AS l
  FROM c WINDOW h AS (PARTITION BY dst_ip {frame}), s AS (PARTITION BY service {frame}),
    p AS (PARTITION BY dst_ip, service {frame}),
    l AS (PARTITION BY dst_ip ORDER BY ts, conn_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
v AS (SELECT *, list_filter(l, lambda x: x.v = service) AS sl FROM w)"""


TIME_COLUMNS = ", ".join([
    'hn AS "count"', "sn AS srv_count", r6("hs / hn", "serror_rate"),
    r6("ss / sn", "srv_serror_rate"), r6("hr / hn", "rerror_rate"),
    r6("sr / sn", "srv_rerror_rate"), r6("pn / hn", "same_srv_rate"),
    r6("(hn - pn) / hn", "diff_srv_rate"), r6("(sn - pn) / sn", "srv_diff_host_rate")])
HOST_COLUMNS = ", ".join([
    "len(l) AS dst_host_count", "len(sl) AS dst_host_srv_count",
    r6("len(sl) / len(l)", "dst_host_same_srv_rate"),
    r6("(len(l) - len(sl)) / len(l)", "dst_host_diff_srv_rate"),
    r6("len(list_filter(l, lambda x: x.p = src_port)) / len(l)", "dst_host_same_src_port_rate"),
    r6("len(list_filter(sl, lambda x: x.i <> src_ip)) / len(sl)", "dst_host_srv_diff_host_rate"),
    r6("len(list_filter(l, lambda x: x.s = 1)) / len(l)", "dst_host_serror_rate"),
    r6("len(list_filter(sl, lambda x: x.s = 1)) / len(sl)", "dst_host_srv_serror_rate"),
    r6("len(list_filter(l, lambda x: x.r = 1)) / len(l)", "dst_host_rerror_rate"),
    r6("len(list_filter(sl, lambda x: x.r = 1)) / len(sl)", "dst_host_srv_rerror_rate")])
ORACLES["win_time"] = f"WITH {windows(2)} SELECT conn_id, {TIME_COLUMNS} FROM v"
ORACLES["win_time_hour"] = f"WITH {windows(3600)} SELECT conn_id, {TIME_COLUMNS} FROM v"
ORACLES["win_last100"] = f"WITH {windows(2)} SELECT conn_id, {HOST_COLUMNS} FROM v"
ORACLES["stream_flow_features"] = f"""
WITH {windows(3600)} SELECT conn_id, {TIME_COLUMNS}, {HOST_COLUMNS} FROM v"""
ORACLES["stream_tumbling"] = """
WITH w AS (SELECT date_trunc('day', ts) AS window_start, value FROM events),
g AS (SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS total_samples,
  count_if(value > 100.0) AS anomalies_found FROM w GROUP BY 1)
SELECT * FROM g WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
ORACLES["stream_flow_state"] = f"""
WITH {windows(3600)} SELECT conn_id, 0.0::double AS behind_seconds, {TIME_COLUMNS}, {HOST_COLUMNS} FROM v"""

# Slices of equal time, in the order they are sent; a row is late if it is no later than two days
# before the latest of the slices sent before.
ORACLES["stream_late_rows"] = """
WITH ends AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events),
cut AS (SELECT epoch_us(ts) AS t, least((epoch_us(ts) - a) * 4 // (b - a + 1), 3) AS part FROM events, ends),
sent AS (SELECT t, CASE part WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE part + 1 END AS slice FROM cut),
latest AS (SELECT slice, max(max(t)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t
           FROM sent GROUP BY slice),
marks AS (SELECT slice, (t // 1000 - 2 * 86400000) * 1000 AS mark FROM latest)
SELECT slice::int AS slice, count(*) AS input_rows, count_if(mark IS NOT NULL AND t <= mark) AS dropped_rows
FROM sent JOIN marks USING (slice) GROUP BY slice"""

ORACLES["stream_truth"] = """
WITH d AS (SELECT event_id, ts, CASE WHEN value > 100.0 THEN 'anomaly' WHEN value IS NOT NULL THEN 'normal' END AS prediction
           FROM events),
l AS (SELECT event_id, ts + INTERVAL 15 MINUTE * (event_id % 7 - 1) AS given,
             CASE WHEN event_type = 'error' THEN 'attack' ELSE 'normal' END AS label
      FROM events WHERE event_id % 7 <> 0),
mark AS (SELECT least((SELECT max(ts) FROM d), (SELECT max(given) FROM l)) - INTERVAL 10 MINUTE AS w),
j AS (SELECT event_id, prediction, label, ts FROM d LEFT JOIN (SELECT event_id AS k, given, label FROM l)
      ON event_id = k AND given >= ts AND given <= ts + INTERVAL 40 MINUTE)
SELECT event_id, prediction, label FROM j, mark WHERE label IS NOT NULL OR ts + INTERVAL 40 MINUTE < w"""

ORACLES["stream_enriched"] = """
WITH ends AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events),
cut AS (SELECT event_id, user_id, least((epoch_us(ts) - a) * 2 // (b - a + 1), 1) + 1 AS v FROM events, ends)
SELECT event_id, user_id, CASE WHEN v = 1 THEN c_mktsegment ELSE lower(c_mktsegment) END AS segment,
  v::int AS table_version FROM cut LEFT JOIN customer ON user_id = c_custkey"""

SESSIONS = f"""WITH {CONNS}, g AS (SELECT c.*, value AS bytes,
  CASE WHEN ts - lag(ts) OVER h <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
  FROM c JOIN (SELECT event_id AS conn_id, value FROM events) USING (conn_id) WINDOW h AS (PARTITION BY dst_ip ORDER BY ts)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY dst_ip ORDER BY ts) AS session FROM g),
s AS (SELECT dst_ip, min(ts) AS session_start, max(ts) AS session_end, count(*) AS connections,
  sum(bytes) AS bytes, sum(syn)::bigint AS syn_errors, sum(rej)::bigint AS rejections FROM n GROUP BY dst_ip, session)"""
ORACLES["sessions"] = f"""{SESSIONS} SELECT dst_ip, session_start, session_end, connections,
  {r6("bytes", "bytes")}, syn_errors, rejections FROM s"""
ORACLES["stream_sessions"] = f"""{SESSIONS} SELECT dst_ip, session_start, session_end, connections FROM s
WHERE session_end + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM c)"""
ORACLES["stream_alerts_resent"] = ORACLES["stream_alerts"]
ORACLES["detect_flows_sparse"] = ORACLES["detect_flows"]
ORACLES["sketched_quartiles"] = f"""
SELECT c AS "column", p::double AS prob, (SELECT count(*) FROM lineitem) AS n, true AS within
FROM unnest([{', '.join(text(c) for c in NUMERIC)}]) AS a(c), unnest([0.25, 0.5, 0.75]) AS b(p)"""
