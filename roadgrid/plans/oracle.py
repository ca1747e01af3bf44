"""The queries as DuckDB SQL."""

from __future__ import annotations

from roadgrid import config as C

_BLACK = ", ".join(f"'{w}'" for w in C.WORD_BLACKLIST)
_NORM = "regexp_replace(upper(replace(coalesce({0}, ''), 'ß', 'ss')), '[^A-Z0-9]', '', 'g')"

_PATHS = "paths AS (SELECT page_id, 'img_' || page_id || (['.JPG', '.jpeg', '.png', '.bmp', '.webp', '.txt', ''])[page_id % 7 + 1] AS image FROM pages)"
_FOUND = _PATHS + ", found AS (SELECT * FROM paths WHERE page_id % 7 < 5)"
_TOKENS = f"tokens AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents), normal AS (SELECT doc_id, {_NORM.format('token')} AS t FROM tokens)"
_LIST = """raw AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN '  ' || lower(replace(p_brand, '#', '')) || ' - ' || p_size ELSE p_brand || '-' || p_size END AS value FROM part WHERE p_partkey % 97 = 0
), listed AS (
  SELECT DISTINCT replace(replace(upper(trim(value)), ' ', ''), '-', '') AS plate FROM raw WHERE replace(replace(upper(trim(value)), ' ', ''), '-', '') <> ''
), readings AS (
  SELECT p_partkey AS id, p_brand || '-' || p_size AS raw, regexp_replace(upper(p_brand || '-' || p_size), '[^A-Z0-9]', '', 'g') AS plate_text, 'img_' || p_partkey || '.jpg' AS image FROM part
), matched AS (
  SELECT *, CASE WHEN plate_text = '' THEN 'NAO_IDENTIFICADA' WHEN plate_text IN (SELECT plate FROM listed) THEN 'ROUBADO' ELSE 'OK' END AS status FROM readings
), new AS (
  SELECT DISTINCT replace(replace(upper(raw), ' ', ''), '-', '') AS plate FROM readings
)"""
_BOXES = """boxes AS (
  SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS pos, l_discount AS conf,
    l_partkey % 700 - 30.5::DOUBLE AS x1, l_partkey % 500 - 10.5::DOUBLE AS y1, l_partkey % 700 - 30.5::DOUBLE + 3 * l_quantity - 6 AS x2, l_partkey % 500 - 10.5::DOUBLE + l_suppkey % 40 - 2 AS y2
  FROM lineitem
), clamped AS (
  SELECT image, pos, conf, greatest(trunc(x1)::INT, 0) AS x1, greatest(trunc(y1)::INT, 0) AS y1, least(trunc(x2)::INT, 640) AS x2, least(trunc(y2)::INT, 480) AS y2 FROM boxes
), valid AS (
  SELECT * FROM clamped WHERE x2 > x1 AND y2 > y1
), padded AS (
  SELECT image, pos, conf, greatest(0, x1 - dx) AS x1, greatest(0, y1 - dy) AS y1, least(640, x2 + dx) AS x2, least(480, y2 + dy) AS y2
  FROM (SELECT *, trunc((x2 - x1) * 0.08::DOUBLE)::INT AS dx, trunc((y2 - y1) * 0.08::DOUBLE)::INT AS dy FROM valid)
), best AS (
  SELECT * FROM padded QUALIFY row_number() OVER (PARTITION BY image ORDER BY conf DESC, pos) = 1
)"""
_RUNS = """results AS (
  SELECT ts::DATE AS run, event_id, value / 100 AS total_time_s, value / 100 * 0.68::DOUBLE AS yolo_time_s, value / 100 * 0.32::DOUBLE AS ocr_time_s, event_type <> 'error' AS plate_detected,
    CASE event_type WHEN 'purchase' THEN 'ROUBADO' WHEN 'error' THEN 'NAO_IDENTIFICADA' ELSE 'OK' END AS status
  FROM events
)"""
_METRICS = """count(*) AS total_images, round(sum(total_time_s), 6) AS total_processing_time_s, round(sum(yolo_time_s), 6) AS yolo_stage_time_s, round(sum(ocr_time_s), 6) AS ocr_stage_time_s,
  round(sum(total_time_s) / count(*), 6) AS avg_time_per_image_s, round(min(total_time_s), 6) AS min_time_per_image_s, round(max(total_time_s), 6) AS max_time_per_image_s,
  round(count(*) / sum(total_time_s), 6) AS throughput_img_per_s, count(*) FILTER (plate_detected) AS images_with_plate, count(*) FILTER (NOT plate_detected) AS images_without_plate,
  count(*) FILTER (status = 'OK') AS ok_count, count(*) FILTER (status = 'ROUBADO') AS roubado_count, count(*) FILTER (status = 'NAO_IDENTIFICADA') AS nao_identificada_count, count(*) FILTER (status = 'ERRO') AS error_count"""
_PIXELS = """pixels AS (
  SELECT image, i, floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (x::DOUBLE + 1) * 127.5::DOUBLE)))::INT AS value
  FROM (SELECT vec_id AS image, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
), bins AS (
  SELECT image, value::BIGINT AS v, count(*) AS c FROM pixels GROUP BY ALL
), sums AS (
  SELECT image, v, sum(c) OVER r AS n0, sum(c * v) OVER r AS s0, sum(c) OVER w AS n, sum(c * v) OVER w AS s FROM bins
  WINDOW r AS (PARTITION BY image ORDER BY v), w AS (PARTITION BY image)
), otsu AS (
  SELECT image, v AS threshold FROM (
    SELECT *, CASE WHEN n > n0 THEN (s0 * n - s * n0)::DOUBLE * (s0 * n - s * n0)::DOUBLE / (n0::DOUBLE * (n - n0)) ELSE -1 END AS b FROM sums
  ) QUALIFY row_number() OVER (PARTITION BY image ORDER BY b DESC, v) = 1
)"""
_BOX = "image, pos, conf, x1, y1, x2, y2"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_TAPS = """, far AS (
  SELECT a AS place, least(7, greatest(0, floor(a / 2.0::DOUBLE - 0.25::DOUBLE)::INT + k)) AS source, abs(a / 2.0::DOUBLE - 0.25::DOUBLE - floor(a / 2.0::DOUBLE - 0.25::DOUBLE) - k) AS d
  FROM (SELECT unnest(range(16)) AS a), (SELECT unnest(range(-1, 3)) AS k)
), taps AS (
  SELECT place, source, sum(CASE WHEN d <= 1 THEN 1.25::DOUBLE * d * d * d - 2.25::DOUBLE * d * d + 1 ELSE -0.75::DOUBLE * d * d * d + 3.75::DOUBLE * d * d - 6 * d + 3 END) AS w FROM far GROUP BY place, source
)"""

ORACLE_SQL = {
    "image_scan_filter": _with(_FOUND, "SELECT page_id, image FROM found"),
    "path_parts": _with(_PATHS, "SELECT page_id, image AS name, CASE WHEN page_id % 7 = 6 THEN image ELSE string_split(image, '.')[1] END AS stem, CASE WHEN page_id % 7 = 6 THEN '' ELSE '.' || string_split(image, '.')[2] END AS suffix FROM paths"),
    "batch_index": _with(_FOUND, "SELECT image, row_number() OVER (ORDER BY image) AS position, ((row_number() OVER (ORDER BY image) - 1) // 8)::BIGINT AS batch FROM found"),
    "normalize_ocr": _with(_TOKENS, "SELECT t AS plate_text, count(*) AS n FROM normal GROUP BY t"),
    "normalize_watchlist": _with(_LIST, "SELECT plate FROM listed"),
    "char_confidence": "SELECT vec_id AS id, round(m, 9) AS confidence, NOT (m < 0.2::DOUBLE) AS kept FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE) * 2)) / len(embedding) AS m FROM embeddings)",
    "ocr_cascade": _with(
        _TOKENS + ", probs AS (SELECT vec_id AS id, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE) * 2)) / len(embedding) AS m FROM embeddings), keyed AS (SELECT t, coalesce(m, 1) AS m FROM normal LEFT JOIN probs ON id = doc_id % (SELECT max(vec_id) + 1 FROM embeddings))",
        f"SELECT reason, count(*) AS n, count(DISTINCT CASE WHEN reason = 'kept' THEN t ELSE '' END) AS texts FROM (SELECT t, CASE WHEN t = '' THEN 'empty' WHEN length(t) < 4 THEN 'length' WHEN m < 0.2::DOUBLE THEN 'confidence' WHEN t IN ({_BLACK}) THEN 'blacklist' ELSE 'kept' END AS reason FROM keyed) GROUP BY reason",
    ),
    "plate_pipeline": _with(
        _LIST + f", seen AS (SELECT *, id % 5 <> 0 AS det, id % 10 / 8.0::DOUBLE AS sure FROM matched), judged AS (SELECT *, det AND id % 11 <> 0 AND length(plate_text) >= 4 AND sure >= 0.2::DOUBLE AND plate_text NOT IN ({_BLACK}) AS good FROM seen)",
        "SELECT 'img_' || id || '.jpg' AS image, det AS plate_detected, CASE WHEN good THEN plate_text ELSE '' END AS plate_text, CASE WHEN good THEN status ELSE 'NAO_IDENTIFICADA' END AS status, id / 8.0::DOUBLE AS yolo_time_s, CASE WHEN det THEN id / 16.0::DOUBLE ELSE 0.0::DOUBLE END AS ocr_time_s, id / 8.0::DOUBLE + CASE WHEN det THEN id / 16.0::DOUBLE ELSE 0.0::DOUBLE END AS total_time_s, CASE WHEN good THEN sure ELSE 0.0::DOUBLE END AS ocr_confidence, (id % 4)::BIGINT AS worker_id, CASE WHEN det THEN 'crops/img_' || id || '_' || md5('in/img_' || id || '.jpg') || '_crop.png' ELSE '' END AS crop_path, '' AS preprocessed_path, '' AS error FROM judged",
    ),
    "blacklist_hits": _with(_TOKENS, f"SELECT t AS word, count(*) AS n, CASE WHEN length(t) < 4 THEN 'length' ELSE 'blacklist' END AS reason FROM normal WHERE t IN ({_BLACK}) GROUP BY t"),
    "box_clamp": _with(_BOXES, f"SELECT {_BOX} FROM clamped"),
    "box_valid": _with(_BOXES, "SELECT image, pos FROM valid"),
    "box_expand": _with(_BOXES, f"SELECT {_BOX} FROM padded"),
    "best_detection": _with(_BOXES, f"SELECT {_BOX} FROM best"),
    "best_detection_array": _with(_BOXES, f"SELECT {_BOX} FROM best"),
    "images_without_detection": _with(_BOXES, "SELECT o_orderkey AS image FROM orders WHERE o_orderkey NOT IN (SELECT image FROM best)"),
    "detections_outer": _with(_BOXES, "SELECT o_orderkey::VARCHAR AS image, b.image IS NOT NULL AS plate_detected, '' AS plate_text, 'NAO_IDENTIFICADA' AS status, 0.0::DOUBLE AS ocr_confidence, '' AS error FROM orders LEFT JOIN best b ON b.image = o_orderkey"),
    "assign_status": _with(_LIST, "SELECT id, plate_text, status FROM matched"),
    "stolen_alerts": _with(_LIST, "SELECT id, plate_text FROM matched WHERE status = 'ROUBADO'"),
    "stolen_semi_join": _with(_LIST, "SELECT id, plate_text FROM matched WHERE status = 'ROUBADO'"),
    "status_counts": _with(_LIST, "SELECT s.status, count(m.status) AS n FROM (VALUES ('OK'), ('ROUBADO'), ('NAO_IDENTIFICADA'), ('ERRO')) s(status) LEFT JOIN matched m ON m.status = s.status GROUP BY s.status"),
    "with_plate_counts": _with(_BOXES, "SELECT count(b.image) AS with_plate, count(*) - count(b.image) AS without_plate FROM orders LEFT JOIN best b ON b.image = o_orderkey"),
    "run_metrics": _with(_RUNS, f"SELECT {_METRICS} FROM results"),
    "run_metrics_by_day": _with(_RUNS, f"SELECT run::VARCHAR AS run, {_METRICS} FROM results GROUP BY run"),
    "stage_share": _with(_RUNS, "SELECT run::VARCHAR AS run, round(sum(yolo_time_s) / (sum(yolo_time_s) + sum(ocr_time_s)) * 100, 6) AS yolo_percent, round(sum(ocr_time_s) / (sum(yolo_time_s) + sum(ocr_time_s)) * 100, 6) AS ocr_percent FROM results GROUP BY run"),
    "run_log_append": _with(_RUNS, "SELECT run::VARCHAR AS run, count(*) AS total_images, count(*) FILTER (status = 'OK') AS ok_count, count(*) FILTER (status = 'ROUBADO') AS roubado_count, count(*) FILTER (status = 'NAO_IDENTIFICADA') AS nao_identificada_count, 0::BIGINT AS error_count FROM results GROUP BY run"),
    "watchlist_add": _with(_LIST, "SELECT plate, plate NOT IN (SELECT plate FROM listed) AS added FROM (SELECT plate FROM listed UNION SELECT plate FROM new)"),
    "watchlist_remove": _with(_LIST, "SELECT plate FROM new EXCEPT SELECT plate FROM listed"),
    "watchlist_removed": _with(_LIST, "SELECT plate FROM listed"),
    "watchlist_list": _with(_LIST, "SELECT plate FROM listed ORDER BY plate"),
    "watchlist_raw_list": _with(_LIST, "SELECT DISTINCT upper(trim(value)) AS plate FROM raw WHERE trim(value) <> ''"),
    "detected_plates": _with(_LIST, "SELECT DISTINCT plate_text AS plate FROM matched WHERE status IN ('OK', 'ROUBADO')"),
    "html_escaped": _with(
        _LIST,
        r"""SELECT id, '{"id":' || id || ',"image":"' || image || '","error":"' || CASE WHEN id % 4 = 0 THEN 'YOLO: \"' || image || '\",\n  line 2, ' || plate_text || '<\/script>' ELSE '' END || '"}' AS j FROM matched""",
    ),
    "results_csv": _with(
        _LIST,
        "SELECT CASE WHEN id % 4 = 0 THEN 'YOLO: \"' || image || '\",' || chr(10) || '  line 2, ' || plate_text ELSE '' END AS error, status, image, plate_text, id / 8.0::DOUBLE AS ocr_confidence, id % 3 AS worker_id, id % 2 = 0 AS plate_detected FROM matched",
    ),
    "results_csv_plates": _with(
        _LIST,
        "SELECT DISTINCT plate_text AS plate, 0::BIGINT AS n FROM matched WHERE status IN ('OK', 'ROUBADO') AND id % 5 <> 0 UNION ALL SELECT 'ocr_confidence', count(*) FROM matched WHERE id % 5 = 0 HAVING count(*) > 0",
    ),
    "demo_sample": _with(_LIST, "SELECT plate FROM listed UNION (SELECT plate_text FROM (SELECT DISTINCT plate_text FROM matched WHERE status IN ('OK', 'ROUBADO')) ORDER BY md5(plate_text || 'demo'), plate_text LIMIT 5)"),
    "no_plate_preview": _with(_BOXES + ", missing AS (SELECT 'img_' || lpad(o_orderkey::VARCHAR, 12, '0') AS name FROM orders WHERE o_orderkey NOT IN (SELECT image FROM best))", "SELECT name, greatest(0, (SELECT count(*) FROM missing) - 6)::BIGINT AS more FROM (SELECT name FROM missing ORDER BY name LIMIT 6)"),
    "report_search": _with(_LIST, "SELECT id, plate_text FROM matched WHERE status = 'OK' AND (contains(lower(plate_text), 'brand1') OR contains(lower(image), 'brand1'))"),
    "report_rows": _with(
        _LIST,
        "SELECT id, id - 1 AS idx, CASE WHEN id % 3 = 0 THEN 'crops/' || id || '_crop.png' ELSE '' END AS crop_rel, '../input/' || image AS original_rel, floor(id % 100 / 128.0::DOUBLE * 100 + 0.5)::BIGINT AS confidence_percent, CASE status WHEN 'NAO_IDENTIFICADA' THEN 'NÃO IDENTIFICADA' ELSE status END AS label, CASE status WHEN 'OK' THEN 'ok' WHEN 'ROUBADO' THEN 'stolen' ELSE 'unident' END AS label_class, CASE status WHEN 'OK' THEN 'green' WHEN 'ROUBADO' THEN 'red' ELSE 'yellow' END AS colour FROM matched",
    ),
    "result_line": _with(
        _LIST,
        "SELECT id, CASE WHEN status = 'ROUBADO' THEN '🚨 ' ELSE '  ' END || '[' || lpad(id::VARCHAR, length(total::VARCHAR)::INT, ' ') || '/' || total || '] ' || rpad(image, 40, ' ') || ' placa=' || CASE WHEN length(plate_text) < 10 THEN rpad(plate_text, 10, ' ') ELSE plate_text END || ' status=' || rpad(status, 17, ' ') || ' pid=' || ((id * 99991) & 16777215) || '  ' || printf('%.3f', id / 8.0::DOUBLE) || 's' || CASE WHEN status = 'ROUBADO' THEN '  ⚠️  ALERTA' ELSE '' END AS line FROM matched, (SELECT count(*) AS total FROM part)",
    ),
    "short_name": _with(_PATHS + ", named AS (SELECT page_id, 'img_' || repeat(image, page_id % 9) AS n FROM paths)", "SELECT page_id, CASE WHEN length(n) <= 40 THEN rpad(n, 40, ' ') ELSE n[1:37] || '...' END AS name FROM named"),
    "timestamp_formats": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS log, strftime(ts, '%d/%m/%Y às %H:%M:%S') AS report FROM events",
    "amdahl_curve": "WITH f AS (SELECT event_type, sum(value) / (SELECT sum(value) FROM events) AS f FROM events GROUP BY event_type)\nSELECT event_type, p, round(1 / (f + (1 - f) / p), 6) AS speedup, round(1 / f, 6) AS most FROM f, (SELECT unnest([1, 2, 4, 8, 12]) AS p)",
    "speedup_table": "WITH e AS (SELECT event_id % 4 AS k, sum(value) AS s FROM events GROUP BY k), r AS (SELECT pow(2, k)::INT AS threads, s / pow(1.6::DOUBLE, k) AS seconds FROM e), g AS (SELECT *, first_value(seconds) OVER (ORDER BY threads) / seconds AS speedup FROM r)\nSELECT threads, round(seconds, 6) AS seconds, round(speedup, 6) AS speedup, round(speedup / threads, 6) AS efficiency, CASE WHEN speedup / threads >= 0.8 THEN 'green' WHEN speedup / threads >= 0.5 THEN 'yellow' ELSE 'red' END AS band FROM g",
    "worker_advice": """WITH r AS (
  SELECT *, least(physical, greatest(1, trunc(ram / 0.15::DOUBLE)::INT)) AS recommended
  FROM (SELECT c_custkey AS machine, (c_custkey % 16 + 1)::INT AS requested, (c_nationkey % 8 + 1)::INT AS physical, greatest(c_acctbal, 0) / 1000 AS ram FROM customer)
)
SELECT machine, recommended, CASE WHEN requested <= physical THEN 'ideal' WHEN requested <= physical * 2 THEN 'hyperthreading' ELSE 'oversubscription' END AS fit,
  CASE WHEN ram < 0.5 THEN 'very_low' WHEN ram < requested * 0.15::DOUBLE THEN 'insufficient' ELSE 'none' END AS warning, CASE WHEN requested = recommended THEN recommended::VARCHAR ELSE recommended || ' (solicitado: ' || requested || ')' END AS label FROM r""",
    "progress_eta": _with(
        _RUNS,
        "SELECT event_id, done, CASE WHEN done < total THEN elapsed / done * (total - done) END AS eta, CASE WHEN done < total THEN 'remaining' ELSE 'finished' END AS state, repeat('█', floor(20 * (done / total))::INT) || repeat('░', 20 - floor(20 * (done / total))::INT) AS bar FROM (SELECT run, event_id, count(*) OVER r AS done, sum(round(total_time_s * 10000)::BIGINT) OVER r / 10000.0::DOUBLE AS elapsed, count(*) OVER (PARTITION BY run) AS total FROM results WINDOW r AS (PARTITION BY run ORDER BY event_id))",
    ),
    "gray_convert": _with(_PIXELS, "SELECT image, i // 3 AS pixel, floor(coalesce(max(CASE WHEN i % 3 = 0 THEN value END), 0) * 0.114::DOUBLE + coalesce(max(CASE WHEN i % 3 = 1 THEN value END), 0) * 0.587::DOUBLE + coalesce(max(CASE WHEN i % 3 = 2 THEN value END), 0) * 0.299::DOUBLE + 0.5::DOUBLE)::INT AS grey FROM pixels GROUP BY image, i // 3"),
    "otsu_threshold": _with(_PIXELS, "SELECT image, threshold FROM otsu"),
    "binarised_pixels": _with(_PIXELS, "SELECT image, count(*) FILTER (value > threshold) AS white, count(*) AS n FROM pixels JOIN otsu USING (image) GROUP BY image"),
    "equalised_pixels": _with(
        _PIXELS,
        """SELECT image, y, x, least(255, greatest(0, round_even((m[1] * (1 - fx) + m[2] * fx) * (1 - fy) + (m[3] * (1 - fx) + m[4] * fx) * fy, 0)))::INT AS value FROM (
  SELECT image, y, x, y / 2.0::DOUBLE - 0.5::DOUBLE - floor(y / 2.0::DOUBLE - 0.5::DOUBLE) AS fy, x / 2.0::DOUBLE - 0.5::DOUBLE - floor(x / 2.0::DOUBLE - 0.5::DOUBLE) AS fx, list(level ORDER BY k) AS m FROM (
    SELECT p.image, p.y, p.x, k, lut.levels[p.value + 1] AS level FROM (
      SELECT image, i // 8 AS y, i % 8 AS x, value, k, least(3, greatest(0, floor(i // 8 / 2.0::DOUBLE - 0.5::DOUBLE)::INT + k // 2)) AS ti, least(3, greatest(0, floor(i % 8 / 2.0::DOUBLE - 0.5::DOUBLE)::INT + k % 2)) AS tj
      FROM pixels, (SELECT unnest(range(4)) AS k)
    ) p JOIN (
      SELECT image, ti, tj, list(least(255, round_even(upto * (255 / 4.0::DOUBLE), 0)) ORDER BY v) AS levels FROM (
        SELECT *, sum(least(c, 1) + (over_ // 256) + (CASE WHEN over_ % 256 > 0 AND v % (256 // greatest(over_ % 256, 1)) = 0 AND v // (256 // greatest(over_ % 256, 1)) < over_ % 256 THEN 1 ELSE 0 END)) OVER (PARTITION BY image, ti, tj ORDER BY v) AS upto FROM (
          SELECT *, sum(greatest(c - 1, 0)) OVER (PARTITION BY image, ti, tj) AS over_ FROM (
            SELECT image, ti, tj, v, count(*) FILTER (value = v) AS c FROM (SELECT image, i // 8 // 2 AS ti, i % 8 // 2 AS tj, value FROM pixels), (SELECT unnest(range(256)) AS v) GROUP BY ALL)))
      GROUP BY image, ti, tj
    ) lut ON lut.image = p.image AND lut.ti = p.ti AND lut.tj = p.tj)
  GROUP BY image, y, x)""",
    ),
    "enlarged_pixels": _with(
        _PIXELS + _TAPS,
        """SELECT image, y, x, least(255, greatest(0, round_even(sum(value * wy * wx), 0)))::INT AS value FROM (
  SELECT p.image, a.place AS y, b.place AS x, p.value, a.w AS wy, b.w AS wx FROM pixels p JOIN taps a ON a.source = p.i // 8 JOIN taps b ON b.source = p.i % 8) GROUP BY image, y, x""",
    ),
}
