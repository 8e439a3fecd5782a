"""The same queries in DuckDB SQL."""

from __future__ import annotations

from scanloom.functions import kernel as K
from scanloom.plans import queries as Q

GRID = """grid AS (
  SELECT vec_id AS r, i - 1 AS o, least(255, greatest(0, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5) AS INT))) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
)"""
EVENTS = "grid AS (SELECT user_id AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o, CAST(floor(value) AS INT) % 256 AS v FROM events)"
SHORT = """grid AS (
  SELECT l_orderkey AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS o,
    CAST(l_quantity AS INT) AS v
  FROM lineitem
)"""


def value(taps, policy: str) -> str:
    half, terms = len(taps) // 2, []
    for k, tap in enumerate(taps):
        if float(tap) == 0:
            continue
        edge = {K.ZERO_PAD: "0", K.REPLICATE: f"{'first' if k < half else 'last'}_value(v) OVER whole"}[policy]
        v = "v" if k == half else f"coalesce({'lag' if k < half else 'lead'}(v, {abs(k - half)}) OVER line, {edge})"
        terms.append(f"CAST({v} AS FLOAT) * CAST({tap} AS FLOAT)")
    return " + ".join(terms)


WINDOWS = "WINDOW line AS (PARTITION BY r ORDER BY o), whole AS (PARTITION BY r ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def bits(source: str, taps=K.DEFAULT_TAPS, tv: int = 0, policy: str = K.REPLICATE) -> str:
    return f"""{source},
bits AS (SELECT r, row_number() OVER line - 1 AS c, CASE WHEN {value(taps, policy)} >= CAST({tv} AS FLOAT) THEN 1 ELSE 0 END AS b FROM grid {WINDOWS}),
packets AS (
  SELECT r AS "row", c - c % 2 AS col, max(CASE WHEN c % 2 = 0 THEN b END) AS b1, coalesce(max(CASE WHEN c % 2 = 1 THEN b END), 0) AS b2
  FROM bits GROUP BY r, c - c % 2
)"""


def packets(*args) -> str:
    return f'WITH {bits(*args)} SELECT "row", col, b1, b2 FROM packets'


EVENT_BITS = bits(EVENTS, K.DEFAULT_TAPS, Q.EVENT_TV)
GAPS = "gaps AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY event_id) AS gap FROM events), g AS (SELECT gap FROM gaps WHERE gap IS NOT NULL), s AS (SELECT list(gap ORDER BY gap) AS l FROM g)"
RANK = "(SELECT l[1 + least(CAST(floor(CAST({q} AS DOUBLE) * len(l)) AS BIGINT), len(l) - 1)] FROM s) AS {name}"
STATS = "count(*) AS samples, min(gap) AS min_gap, max(gap) AS max_gap, CAST(sum(gap) AS DOUBLE) / count(*) AS avg_gap"
LINES = "raw AS (SELECT l_orderkey AS r, list(CAST(l_quantity AS INT) * 7 % 256 ORDER BY CAST(l_quantity AS INT)) AS px FROM lineitem GROUP BY l_orderkey)"
FLAT = 'SELECT r AS "row", CAST(i - 1 AS BIGINT) AS col, CAST(px[i] AS INT) AS v FROM (SELECT r, px, unnest(range(1, len(px) + 1)) AS i FROM fit)'

GAP_ROWS = "g AS (SELECT gap FROM gaps WHERE gap IS NOT NULL), s AS (SELECT list(gap ORDER BY gap) AS l FROM g)"
ARRIVAL = f"gaps AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY user_id, event_id) AS gap FROM events), {GAP_ROWS}"
ARRIVAL_LINEAR = ARRIVAL.replace("gap IS NOT NULL", "gap >= 0")
FILE = """texts AS (SELECT l_orderkey AS k, list(CAST(l_quantity AS INT) * 7 % 256 ORDER BY CAST(l_quantity AS INT)) AS px FROM lineitem GROUP BY l_orderkey),
raw AS (SELECT row_number() OVER (ORDER BY k) - 1 AS r, px FROM texts), width AS (SELECT len(px) - len(px) % 2 AS w FROM raw WHERE r = 0)"""
FILE_PAD = "fit AS (SELECT r, list_concat(px, list_transform(range(w), lambda x: 0))[1:w] AS px FROM raw, width)"
FILE_GRID = "grid AS (SELECT r, i AS o, CAST(px[i] AS INT) AS v FROM (SELECT r, px, unnest(range(1, len(px) + 1)) AS i FROM fit))"
COUNTS = """count(*) AS packets, 2 * count(*) AS pixels, CAST(sum(b1 + b2) AS BIGINT) AS ones, 2 * count(*) - CAST(sum(b1 + b2) AS BIGINT) AS zeros, count(DISTINCT "row") AS rows, greatest(count(DISTINCT "row") - 1, 0) AS rows_emitted"""


def pixel_grid(rows: int, m: int, seed: int) -> str:
    """made(r, o, v): the pixels of a seeded random grid."""
    step = "(xor(x, x >> 16) * 73244475) % 4294967296"
    return f"""p0 AS (SELECT r, (r * 1000003 + {seed}) % 4294967296 AS x FROM (SELECT unnest(range({rows})) AS r)),
p1 AS (SELECT r, {step} AS x FROM p0), p2 AS (SELECT r, {step} AS x FROM p1), p3 AS (SELECT r, o, x + o * 40503 AS y FROM p2, (SELECT unnest(range({m})) AS o)),
made AS (SELECT r, o, CAST(((xor(y, y >> 15) * 73244475) >> 20) & 255 AS INT) AS v FROM p3)"""


SQL: dict[str, str] = {
    "scan_filter_replicate": packets(GRID, K.DEFAULT_TAPS, Q.GRID_TV, K.REPLICATE),
    "scan_filter_zero_pad": packets(GRID, K.DEFAULT_TAPS, Q.GRID_TV, K.ZERO_PAD),
    "filtered_values_f32": f'WITH {GRID} SELECT r AS "row", o AS col, {value(K.DEFAULT_TAPS, K.REPLICATE)} AS f FROM grid {WINDOWS}',
    "event_line_filter": packets(EVENTS, K.DEFAULT_TAPS, Q.EVENT_TV),
    "event_line_filter_zero_pad": packets(EVENTS, K.DEFAULT_TAPS, Q.EVENT_TV, K.ZERO_PAD),
    "short_line_filter": packets(SHORT, K.DEFAULT_TAPS, Q.SHORT_TV),
    "kernel_identity": packets(EVENTS, K.IDENTITY_TAPS, Q.EVENT_TV),
    "kernel_uniform": packets(EVENTS, K.UNIFORM_TAPS, Q.EVENT_TV),
    "kernel_3tap": packets(EVENTS, Q.THREE, Q.EVENT_TV),
    "kernel_5tap": packets(EVENTS, Q.FIVE, Q.EVENT_TV),
    "threshold_inclusive": packets(GRID, K.IDENTITY_TAPS, Q.GRID_TV),
    "threshold_zero": packets(GRID, K.IDENTITY_TAPS, 0),
    "threshold_max": packets(GRID, K.IDENTITY_TAPS, 255),
    "threshold_column": f"""WITH {GRID}, f AS (SELECT r, o, {value(K.DEFAULT_TAPS, K.REPLICATE)} AS f FROM grid {WINDOWS})
SELECT r AS "row", o AS col, CASE WHEN f >= CAST(label + 120 AS FLOAT) THEN 1 ELSE 0 END AS b FROM f JOIN embeddings ON vec_id = r""",
    "pair_packets": packets(EVENTS, K.IDENTITY_TAPS, 50),
    "unpair_packets": f'WITH {EVENT_BITS} SELECT "row", col, b1 AS b FROM packets UNION ALL SELECT "row", col + 1 AS col, b2 AS b FROM packets',
    "raw_packets": f"""WITH {GRID} SELECT r AS "row", o - o % 2 AS col, max(CASE WHEN o % 2 = 0 THEN v END) AS v1, coalesce(max(CASE WHEN o % 2 = 1 THEN v END), 0) AS v2 FROM grid GROUP BY r, o - o % 2""",
    "lines_round_trip": f'WITH {EVENTS} SELECT r AS "row", o - 1 AS col, v FROM grid',
    "row_limit_exact": packets(GRID.replace("FROM embeddings", "FROM embeddings WHERE vec_id < 100"), K.DEFAULT_TAPS, Q.GRID_TV),
    "row_limit_leaky": packets(GRID.replace("FROM embeddings)", "FROM embeddings) WHERE vec_id < 100 OR (vec_id = 100 AND i <= 2)"), K.DEFAULT_TAPS, Q.GRID_TV),
    "ones_zeros_summary": f"""WITH {EVENT_BITS} SELECT count(*) AS packets, 2 * count(*) AS pixels, CAST(sum(b1 + b2) AS BIGINT) AS ones, 2 * count(*) - CAST(sum(b1 + b2) AS BIGINT) AS zeros,
  count(DISTINCT "row") AS rows, greatest(count(DISTINCT "row") - 1, 0) AS rows_emitted FROM packets""",
    "rows_per_scan": f'WITH {EVENT_BITS} SELECT "row", count(*) AS packets, CAST(sum(b1 + b2) AS BIGINT) AS ones, 2 * count(*) - CAST(sum(b1 + b2) AS BIGINT) AS zeros FROM packets GROUP BY "row"',
    "event_gaps": f"WITH {GAPS} SELECT gap FROM g",
    "gap_stats": f"WITH {GAPS} SELECT {STATS}, {RANK.format(q=0.99, name='p99_gap')} FROM g",
    "gap_stats_linear": f"WITH {GAPS} SELECT {STATS}, {RANK.format(q=0.5, name='p50_gap')}, {RANK.format(q=0.99, name='p99_gap')} FROM g",
    "gap_verdict": f"""WITH {GAPS} SELECT CASE WHEN max(gap) <= {Q.BUDGET_US} THEN 'PASS' ELSE 'FAIL' END AS threaded,
  CASE WHEN max(gap) <= {Q.BUDGET_US} THEN 'PASS' WHEN avg(gap) <= {Q.BUDGET_US} THEN 'AVG PASS / MAX FAIL' ELSE 'FAIL' END AS linear FROM g""",
    "queue_occupancy": """WITH m AS (SELECT event_id, epoch_us(ts) AS t, 1 AS c FROM events UNION ALL SELECT event_id, epoch_us(ts) + 3600000000, -1 FROM events)
SELECT CAST(max(n) AS BIGINT) AS peak, max(n) <= 65 AS memory_ok FROM (SELECT sum(c) OVER (ORDER BY t, c, event_id ROWS UNBOUNDED PRECEDING) AS n FROM m)""",
    "csv_mismatch_truncate": f"WITH {LINES}, stop AS (SELECT min(r) AS s FROM raw WHERE len(px) < 2), fit AS (SELECT r, px[1:2] AS px FROM raw, stop WHERE len(px) >= 2 AND (s IS NULL OR r < s)) {FLAT}",
    "csv_mismatch_truncate_all": f"WITH {LINES}, stop AS (SELECT min(r) AS s FROM raw WHERE len(px) < 1), fit AS (SELECT r, px[1:1] AS px FROM raw, stop WHERE len(px) >= 1 AND (s IS NULL OR r < s)) {FLAT}",
    "csv_mismatch_skip": f"WITH {LINES}, fit AS (SELECT r, px[1:{Q.WIDTH}] AS px FROM raw WHERE len(px) >= {Q.WIDTH}) {FLAT}",
    "csv_mismatch_zero_pad": f"WITH {LINES}, fit AS (SELECT r, list_concat(px, [0, 0, 0, 0])[1:{Q.WIDTH}] AS px FROM raw) {FLAT}",
    "csv_mismatch_reject": f'WITH {GRID} SELECT r AS "row", o AS col, v FROM grid',
    "segments": """WITH c AS (SELECT user_id, event_id, ts, coalesce(CAST(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT), 1) AS x FROM events)
SELECT user_id, event_id, CAST(sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS segment FROM c""",
    "stdout_lines": f"""WITH {bits(GRID, K.DEFAULT_TAPS, Q.GRID_TV)}
SELECT 'row=' || "row" || ' col=' || col || ' b1=' || b1 || ' b2=' || b2 AS line FROM packets""",
    "arrival_gaps": f"WITH {ARRIVAL} SELECT gap FROM g",
    "arrival_gap_stats": f"WITH {ARRIVAL} SELECT {STATS}, {RANK.format(q=0.99, name='p99_gap')} FROM g",
    "arrival_gap_stats_linear": f"WITH {ARRIVAL_LINEAR} SELECT {STATS}, {RANK.format(q=0.5, name='p50_gap')}, {RANK.format(q=0.99, name='p99_gap')} FROM g",
    "bounded_queue": f"""WITH m AS (SELECT user_id, epoch_us(ts) AS t, 1 AS c FROM events UNION ALL SELECT user_id, epoch_us(ts) + 86400000000, -1 FROM events),
l AS (SELECT user_id, list({{'c': CAST(c AS BIGINT), 'level': CAST(0 AS BIGINT), 'dropped': CAST(0 AS BIGINT), 'peak': CAST(0 AS BIGINT)}} ORDER BY t, c) AS l FROM m GROUP BY user_id),
q AS (
  SELECT user_id, list_reduce(list_concat([{{'c': CAST(0 AS BIGINT), 'level': CAST(0 AS BIGINT), 'dropped': CAST(0 AS BIGINT), 'peak': CAST(0 AS BIGINT)}}], l), lambda s, x: {{
    'c': x.c, 'level': least({Q.QUEUE}, greatest(0, s.level + x.c)), 'dropped': s.dropped + CASE WHEN x.c > 0 AND s.level >= {Q.QUEUE} THEN 1 ELSE 0 END,
    'peak': greatest(s.peak, least({Q.QUEUE}, greatest(0, s.level + x.c)))}}) AS s FROM l
)
SELECT user_id AS source, CAST(s.dropped AS BIGINT) AS dropped, CAST(s.peak AS BIGINT) AS peak FROM q""",
    "ring_capacity": """WITH h AS (SELECT o_orderkey AS ring, o_orderkey % 300 AS hint, o_orderkey % 7 * 20 AS logical FROM orders),
p AS (SELECT CAST(2 ** i AS BIGINT) AS p FROM (SELECT unnest(range(1, 20)) AS i)),
s AS (SELECT ring, hint, logical, min(p) AS slots FROM h JOIN p ON p >= hint GROUP BY ALL)
SELECT ring, slots, CASE WHEN hint > 0 THEN least(hint, slots - 1) ELSE slots - 1 END AS places,
  CASE WHEN logical > 0 THEN least(logical, slots - 1) WHEN hint > 0 THEN least(hint, slots - 1) ELSE slots - 1 END AS limited FROM s""",
    "csv_file_zero_pad": f"WITH {FILE}, {FILE_PAD} {FLAT}",
    "csv_file_truncate": f"WITH {FILE}, stop AS (SELECT min(r) AS s FROM raw, width WHERE len(px) < w), fit AS (SELECT r, px[1:w] AS px FROM raw, width, stop WHERE len(px) >= w AND (s IS NULL OR r < s)) {FLAT}",
    "csv_file_skip": f"WITH {FILE}, fit AS (SELECT r, px[1:w] AS px FROM raw, width WHERE len(px) >= w) {FLAT}",
    "csv_file_filter": f"""WITH {FILE}, {FILE_PAD}, {bits(FILE_GRID, K.DEFAULT_TAPS, Q.GRID_TV, K.ZERO_PAD)} SELECT "row", col, b1, b2 FROM packets""",
    "csv_reject_messages": f"""WITH {FILE} SELECT r AS "row", 'CSV row ' || r || ' has ' || len(px) || ' values, expected ' || w AS message FROM raw, width WHERE len(px) <> w""",
    "csv_sink": packets(GRID, K.DEFAULT_TAPS, Q.GRID_TV, K.REPLICATE),
    "configured_run": f"""WITH {FILE}, {FILE_PAD}, {bits(FILE_GRID.replace("FROM fit", "FROM fit WHERE r < 50"), ("0.25", "0.5", "0.25"), 384 % 256, K.ZERO_PAD)}
SELECT {COUNTS}, CASE WHEN (SELECT count(*) FROM raw) >= 50 THEN 'max_rows' ELSE 'source exhausted' END AS cause, '128' AS threshold, count(*) AS packets_written FROM packets""",
    "configured_run_to_its_end": f"WITH {bits(GRID, K.DEFAULT_TAPS, Q.GRID_TV)} SELECT {COUNTS}, 'source exhausted' AS cause FROM packets",
    "config_values": """SELECT * FROM (VALUES ('m', '130'), ('T', '500'), ('threshold', '44'), ('mode', 'random'), ('input_file', 'scan.csv'), ('kernel', '0.25,0.5,0.25'), ('run_duration_ms', '0'), ('max_rows', '7'),
  ('boundary_policy', 'zero_pad'), ('csv_mismatch_policy', 'reject'), ('write_output', 'False'), ('output_file', 'output.csv')) AS t(key, value)""",
    "config_errors": """SELECT * FROM (VALUES ('odd m', 'm must be even and at least 2 in random mode'), ('small m', 'm must be even and at least 2 in random mode'), ('no T', 'T must be over 0 ns'), ('even kernel', 'the kernel needs an odd number of taps'),
  ('no number', 'not a number: ''x'''), ('infinite tap', 'kernel taps must be finite: ''inf'''), ('no file', 'csv mode needs input_file'), ('good', NULL), ('good csv', NULL)) AS t(name, problem)""",
    "random_grid": f"""WITH {pixel_grid(1000, 130, 1)}, {bits("grid AS (SELECT * FROM made)", K.DEFAULT_TAPS, Q.GRID_TV)} SELECT "row", col, b1, b2 FROM packets""",
    "stream_line_filter": packets(GRID, K.DEFAULT_TAPS, Q.GRID_TV, K.REPLICATE),
    "stream_packet_filter": f'WITH {bits(GRID, K.DEFAULT_TAPS, Q.GRID_TV)} SELECT CAST("row" % 4 AS INT) AS source, "row", col, b1, b2 FROM packets',
    "stream_paced": f"""WITH {pixel_grid(Q.PACED * 2 // Q.PACED_M, Q.PACED_M, 3)}
SELECT 0 AS source, r AS "row", o - o % 2 AS col, max(CASE WHEN o % 2 = 0 THEN v END) AS v1, max(CASE WHEN o % 2 = 1 THEN v END) AS v2 FROM made GROUP BY r, o - o % 2""",
}
