"""The same queries as SQL over the driver's tables, written independently of the operators.

`WITH` blocks are named and pulled in by need; every query reads the whole tables.
"""

from __future__ import annotations

import re

from annolytics import settings
from annolytics.workloads import fixtures as fx

# --- building blocks ------------------------------------------------------------------------------


def _values(rows: list[tuple], columns: str) -> str:
    def one(value: object) -> str:
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) v({columns})"


def _project(columns: dict[str, str], table: str, where: str = "") -> str:
    body = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"SELECT {body} FROM {table} {where}"


def _label_text(line) -> str:
    a = f"(length(x) * 7 + i * 13 + {fx.SEED})"
    return (
        "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: "
        f"CASE WHEN length(x) = 0 THEN '' ELSE {line(a)} END), chr(10))"
    )


_STEM = (
    "source || '_g' || (doc_id // 40) || CASE WHEN doc_id % 5 = 0 THEN '_' || doc_id "
    "ELSE '.rf.' || substr(sha256(text), 1, 8) || '_' || doc_id END"
)
_FLOAT = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(nan|inf|infinity)$"
_CLASSES = list(enumerate(fx.SOURCE_CLASSES))
_TARGET = list(enumerate(settings.TARGET_CLASSES))
_FINAL = list(enumerate(settings.FINAL_CLASSES))
_NEW_NAMES = [(k, settings.CLASS_SYNONYMS.get(name)) for k, name in _CLASSES]
_NEW_IDS = [(k, settings.TARGET_CLASSES.index(n)) for k, n in _NEW_NAMES if n is not None]


def _counts(ids: list[int], source: str) -> str:
    """Counts per class as comma-joined text over a column of class ids in `source`."""
    return " || ',' || ".join(f"count(*) FILTER (WHERE {source} = {k})" for k in ids)


BLOCKS: dict[str, str] = {
    "classes": _values(_CLASSES, "class_id, class_name"),
    "target": _values(_TARGET, "class_id, class_name"),
    "finals": _values(_FINAL, "class_id, class_name"),
    "new_ids": _values(_NEW_IDS, "old_id, new_id"),
    "splits": _values([(s,) for s in fx.SPLITS], "split"),
    "docs": f"SELECT *, {fx.SPLIT} AS split, {_STEM} AS stem FROM documents",
    "images": f"""SELECT doc_id AS image_id, split, '/ds/' || split || '/images/' || stem || '.jpg' AS path,
        640 AS width, CASE WHEN doc_id % 2 = 0 THEN 480 ELSE 640 END AS height,
        CASE WHEN {fx.MISSING_IMAGE} THEN NULL WHEN {fx.UNREADABLE_IMAGE} THEN encode(text)
             ELSE '\\xFF\\xD8\\xFF\\xE0'::BLOB || encode(text) END AS content,
        NOT ({fx.UNREADABLE_IMAGE}) AND NOT ({fx.MISSING_IMAGE}) AS readable FROM docs""",
    "label_files": f"""SELECT '/ds/' || split || '/labels/' || stem || '.txt' AS label_path, split AS label_split,
        CASE WHEN {fx.EMPTY_LABEL} THEN '' WHEN {fx.UNDECODABLE_LABEL} THEN NULL
             ELSE {_label_text(fx.label_line)} END AS txt FROM docs WHERE NOT ({fx.MISSING_LABEL})""",
    "items": """SELECT i.*, content IS NOT NULL AS present, sha256(content) AS digest,
        replace(regexp_replace(path, '[.]jpg$', '.txt'), '/images/', '/labels/') AS label_path,
        l.label_path IS NOT NULL AS has_label, l.txt
        FROM images i LEFT JOIN label_files l
          ON l.label_path = replace(regexp_replace(i.path, '[.]jpg$', '.txt'), '/images/', '/labels/')""",
    "raw_lines": """SELECT path, split, label_path, present, readable, width, height, n AS line_no, trim(line) AS line,
        regexp_split_to_array(trim(line), '\\s+') AS f FROM (
          SELECT *, unnest(string_split(txt, chr(10))) AS line,
                 generate_subscripts(string_split(txt, chr(10)), 1) AS n FROM items) WHERE trim(line) <> ''""",
    "numbers": f"""SELECT *, CASE WHEN regexp_matches(f[1], '^[+-]?[0-9]+$') THEN try_cast(f[1] AS BIGINT) END AS class_id,
        CASE WHEN len(f) = 5 THEN
          len(list_filter(f[2:5], lambda v: regexp_matches(lower(v), '{_FLOAT}'))) = 4 ELSE false END AS numeric,
        try_cast(f[2] AS DOUBLE) AS x, try_cast(f[3] AS DOUBLE) AS y,
        try_cast(f[4] AS DOUBLE) AS w, try_cast(f[5] AS DOUBLE) AS h FROM raw_lines""",
    "lines": f"""SELECT *, CASE
          WHEN len(f) <> 5 THEN 'Expected 5 values, found ' || len(f) || '.'
          WHEN NOT regexp_matches(f[1], '^[+-]?[0-9]+$') THEN 'Class ID must be an integer, found ''' || f[1] || '''.'
          WHEN class_id NOT BETWEEN 0 AND 15 THEN 'Class ID ' || class_id || ' is not declared in data.yaml.'
          WHEN NOT numeric THEN '{settings.NOT_NUMERIC}'
          WHEN NOT (isfinite(x) AND isfinite(y) AND isfinite(w) AND isfinite(h)) THEN '{settings.NOT_FINITE}'
          WHEN NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1) THEN '{settings.CENTRE_OUTSIDE}'
          WHEN NOT (w > 0 AND w <= 1 AND h > 0 AND h <= 1) THEN '{settings.SIZE_OUTSIDE}'
          WHEN x - w / 2 < -1e-6 OR x + w / 2 > 1 + 1e-6 OR y - h / 2 < -1e-6 OR y + h / 2 > 1 + 1e-6
            THEN '{settings.EDGE_OUTSIDE}' END AS message,
        CASE WHEN len(f) <> 5 THEN 'invalid_label_format'
          WHEN NOT regexp_matches(f[1], '^[+-]?[0-9]+$') OR class_id NOT BETWEEN 0 AND 15 THEN 'invalid_class_id'
          ELSE 'invalid_bbox' END AS code FROM numbers""",
    "valid": "SELECT * FROM lines WHERE message IS NULL",
    "copies": """SELECT digest, count(*) AS copies, string_agg(DISTINCT split, ',' ORDER BY split) AS splits
        FROM items WHERE digest IS NOT NULL GROUP BY digest HAVING count(*) > 1""",
    "issues": """
        SELECT 'error' AS severity, 'missing_image' AS code, 'Image listed in split does not exist.' AS message,
               split, path AS image_path, NULL AS label_path, NULL::BIGINT AS line FROM items WHERE NOT present
        UNION ALL SELECT 'error', 'unreadable_image', 'Image cannot be decoded.', split, path, NULL, NULL
          FROM items WHERE present AND NOT readable
        UNION ALL SELECT 'error', 'missing_label', 'No matching YOLO label file was found.', split, path, label_path, NULL
          FROM items WHERE present AND NOT has_label
        UNION ALL SELECT 'error', 'unreadable_label', 'Label file cannot be read as UTF-8 text.', split, path, label_path, NULL
          FROM items WHERE present AND has_label AND txt IS NULL
        UNION ALL SELECT 'warning', 'empty_label',
               'Label file contains no annotations; this may be a valid negative image.', split, path, label_path, NULL
          FROM items WHERE present AND txt IS NOT NULL AND path NOT IN (SELECT path FROM raw_lines)
        UNION ALL SELECT 'error', code, message, split, path, label_path, line_no
          FROM lines WHERE present AND message IS NOT NULL
        UNION ALL SELECT 'warning', 'duplicate_image',
               'Identical image content appears ' || copies || ' times (SHA-256: ' || digest || ').', NULL, NULL, NULL, NULL
          FROM copies""",
    "grid": """SELECT s.split, c.class_id::BIGINT AS class_id, c.class_name, count(v.path)::BIGINT AS annotations,
        count(DISTINCT v.path)::BIGINT AS images FROM splits s CROSS JOIN classes c
        LEFT JOIN (SELECT * FROM valid WHERE present) v ON v.split = s.split AND v.class_id = c.class_id GROUP BY ALL""",
    # clean dataset
    "clean": f"""SELECT '/ds/' || split || '/images/' || stem || '.jpg' AS path, split,
        '/ds/' || split || '/labels/' || stem || '.txt' AS label_path, sha256(text) AS digest,
        CASE WHEN contains(stem, '.rf.') THEN split_part(stem, '.rf.', 1) ELSE stem END AS source_key,
        {_label_text(fx.clean_line)} AS txt FROM docs""",
    "clean_lines": """SELECT path, n AS line_no, line, split_part(line, ' ', 1)::INT AS class_id FROM (
        SELECT path, unnest(string_split(txt, chr(10))) AS line,
               generate_subscripts(string_split(txt, chr(10)), 1) AS n FROM clean) WHERE line <> ''""",
    "outlines": """SELECT path, string_agg(line, chr(10) ORDER BY line_no) AS body, count(*) AS objects
        FROM clean_lines WHERE class_id < 7 GROUP BY path""",
    "records": """SELECT c.*, coalesce(o.body, '') AS body, coalesce(o.objects, 0)::BIGINT AS object_count
        FROM clean c LEFT JOIN outlines o USING (path)""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY digest ORDER BY object_count DESC, path) AS rk,
        count(*) OVER (PARTITION BY digest) AS copies,
        first(path) OVER (PARTITION BY digest ORDER BY object_count DESC, path) AS kept_image,
        first(label_path) OVER (PARTITION BY digest ORDER BY object_count DESC, path) AS kept_label FROM records""",
    "kept": "SELECT * FROM ranked WHERE rk = 1",
    "retained": "SELECT * FROM kept WHERE object_count > 0",
    "objects": """SELECT r.source_key, r.path, l.class_id FROM retained r
        JOIN clean_lines l USING (path) WHERE l.class_id < 7""",
    "groups": "SELECT source_key, count(*) AS size FROM retained GROUP BY source_key",
    "group_classes": """SELECT source_key, class_id, count(*) AS annotations, count(DISTINCT path) AS images
        FROM objects GROUP BY ALL""",
    "strata": """SELECT source_key, arg_min(class_id, (t.images, class_id)) AS stratum FROM group_classes
        JOIN (SELECT class_id, sum(images) AS images FROM group_classes GROUP BY class_id) t USING (class_id)
        GROUP BY source_key""",
    "placed": """SELECT source_key, size, stratum,
        sum(size) OVER (PARTITION BY stratum ORDER BY sha256('42:' || source_key), source_key
                        ROWS UNBOUNDED PRECEDING) AS upto,
        sum(size) OVER (PARTITION BY stratum) AS total FROM groups JOIN strata USING (source_key)""",
    "assigned": """SELECT source_key, size, stratum, CASE
        WHEN (upto * 2 - size)::DOUBLE / 2 < 0.7::DOUBLE * total THEN 'train'
        WHEN (upto * 2 - size)::DOUBLE / 2 < (0.7::DOUBLE + 0.2::DOUBLE) * total THEN 'valid'
        ELSE 'test' END AS split FROM placed""",
    "final": """SELECT a.split, a.split || '/images/' || split_part(path, '/', 5) AS image,
        a.split || '/labels/' || regexp_replace(split_part(path, '/', 5), '[.]jpg$', '.txt') AS label,
        digest AS image_sha256, sha256(body || chr(10)) AS label_sha256, path AS source_image, source_key, object_count
        FROM retained JOIN assigned a USING (source_key)""",
    "final_classes": """SELECT o.source_key, o.path, o.class_id, a.split FROM objects o
        JOIN assigned a USING (source_key)""",
    "out_splits": _values([(s, r) for s, r in settings.SPLIT_RATIOS.items()], "split, ratio"),
    "sums": """SELECT s.split, s.ratio::DOUBLE AS ratio, c.class_id, count(o.path) AS annotations,
        count(DISTINCT o.path) AS covered FROM out_splits s CROSS JOIN finals c
        LEFT JOIN final_classes o ON o.split = s.split AND o.class_id = c.class_id GROUP BY ALL""",
    "split_sizes": """SELECT s.split, s.ratio::DOUBLE AS ratio, count(f.image) AS images,
        coalesce(sum(f.object_count), 0) AS annotations FROM out_splits s LEFT JOIN final f USING (split) GROUP BY ALL""",
    # boxes
    "truth": _project(fx.TRUTH, "lineitem"),
    "predictions": _project(fx.PREDICTIONS, "lineitem"),
    "active": "SELECT * FROM predictions WHERE conf >= 0.25",
    "matches": "",
    "unmatched": """SELECT 'missed' AS side, t.image_id, t.class_id, t.idx, x1, y1, x2, y2 FROM truth t
          WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.image_id = t.image_id AND m.gi = t.idx)
        UNION ALL SELECT 'extra', p.image_id, p.class_id, p.idx, x1, y1, x2, y2 FROM active p
          WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.image_id = p.image_id AND m.pi = p.idx)""",
    "confusions": "",
    "overlapped": "",
    "image_errors": """SELECT image_id, sum(low)::BIGINT AS low_confidence,
        sum(missed)::BIGINT AS suspected_missed_detection, sum(extra)::BIGINT AS suspected_false_positive,
        sum(confused)::BIGINT AS class_confusion, sum(small)::BIGINT AS small_object_failure,
        sum(occluded)::BIGINT AS occlusion_scene_failure,
        (CASE WHEN sum(gt) >= 8 THEN sum(missed) + sum(extra) ELSE 0 END)::BIGINT AS dense_scene_failure FROM (
          SELECT image_id, 1 AS gt, 0 AS low, 0 AS missed, 0 AS small, 0 AS extra, 0 AS confused, 0 AS occluded FROM truth
          UNION ALL SELECT image_id, 0, 1, 0, 0, 0, 0, 0 FROM predictions WHERE conf >= 0.10 AND conf < 0.25
          UNION ALL SELECT image_id, 0, 0, 1,
              (greatest(x2 - x1, 0) * greatest(y2 - y1, 0) / (640 * 640) < 0.01::DOUBLE)::INT, 0, 0, 0
            FROM unmatched WHERE side = 'missed'
          UNION ALL SELECT image_id, 0, 0, 0, 0, 1, 0, 0 FROM unmatched WHERE side = 'extra'
          UNION ALL SELECT image_id, 0, 0, 0, 0, 0, 1, 0 FROM confusions
          UNION ALL SELECT u.image_id, 0, 0, 0, 0, 0, 0, 1 FROM unmatched u JOIN overlapped o
            ON o.image_id = u.image_id AND o.idx = u.idx WHERE u.side = 'missed') GROUP BY image_id""",
    "events_long": """SELECT image_id, category, n AS events FROM (SELECT image_id, unnest([
        {'c': 'low_confidence', 'n': low_confidence},
        {'c': 'suspected_missed_detection', 'n': suspected_missed_detection},
        {'c': 'suspected_false_positive', 'n': suspected_false_positive},
        {'c': 'class_confusion', 'n': class_confusion},
        {'c': 'small_object_failure', 'n': small_object_failure},
        {'c': 'occlusion_scene_failure', 'n': occlusion_scene_failure},
        {'c': 'dense_scene_failure', 'n': dense_scene_failure}], recursive := true) FROM image_errors) t(image_id, category, n)""",
    "floor_matches": "",
    "hits": """SELECT p.image_id, p.class_id, p.idx, p.conf, m.iou AS match_iou FROM predictions p
        LEFT JOIN floor_matches m ON m.image_id = p.image_id AND m.pi = p.idx WHERE p.conf >= 0.001""",
    "thresholds": "SELECT unnest([50, 55, 60, 65, 70, 75, 80, 85, 90, 95]) / 100e0 AS iou_threshold",
    "curve": """SELECT class_id, iou_threshold, conf, tp::BIGINT AS tp, predicted::BIGINT AS predicted, truth_count,
        tp::DOUBLE / predicted AS precision, tp::DOUBLE / truth_count AS recall FROM (
          SELECT class_id, iou_threshold, conf, truth_count,
            sum(hit) OVER (PARTITION BY class_id, iou_threshold ORDER BY conf DESC) AS tp,
            sum(n) OVER (PARTITION BY class_id, iou_threshold ORDER BY conf DESC) AS predicted FROM (
              SELECT class_id, iou_threshold, conf, count(*) AS n, count(*) FILTER (WHERE match_iou >= iou_threshold) AS hit
              FROM hits CROSS JOIN thresholds GROUP BY ALL)
          JOIN (SELECT class_id, count(*) AS truth_count FROM truth GROUP BY class_id) USING (class_id))""",
    "ap": """SELECT class_id, iou_threshold, avg(best) AS ap FROM (
        SELECT k.class_id, k.iou_threshold, q, coalesce(max(c.precision), 0) AS best
        FROM (SELECT DISTINCT class_id, iou_threshold FROM curve) k CROSS JOIN range(101) r(q)
        LEFT JOIN curve c ON c.class_id = k.class_id AND c.iou_threshold = k.iou_threshold AND c.recall >= q / 100e0
        GROUP BY ALL) GROUP BY ALL""",
    "metrics": """SELECT c.class_id::BIGINT AS class_id, c.class_name,
        coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(tp::DOUBLE / truth_count, 0) AS recall,
        coalesce(ap50, 0) AS ap50, coalesce(ap50_95, 0) AS ap50_95 FROM target c
        LEFT JOIN (SELECT class_id, count(*) FILTER (WHERE conf >= 0.25) AS predicted,
            count(*) FILTER (WHERE conf >= 0.25 AND match_iou >= 0.5) AS tp FROM hits GROUP BY 1) USING (class_id)
        LEFT JOIN (SELECT class_id, count(*) AS truth_count FROM truth GROUP BY 1) USING (class_id)
        LEFT JOIN (SELECT class_id, max(ap) FILTER (WHERE iou_threshold = 0.5) AS ap50, avg(ap) AS ap50_95
            FROM ap GROUP BY 1) USING (class_id)""",
    # experiments
    "runs": _project(fx.RUNS, "customer"),
    "resumes": _project(fx.RESUMES, "customer"),
    "epochs": _project(fx.EPOCHS, "orders"),
    "test_metrics": _project(fx.TEST_METRICS, "customer", f"WHERE {fx.TESTED}"),
    "performance": _project(fx.PERFORMANCE, "customer", f"WHERE {fx.MEASURED}"),
    "per_class": f"""SELECT 'run_' || c_custkey AS run, class_order, class_name, {fx.CLASS_AP} AS ap50_95
        FROM customer CROSS JOIN (SELECT class_id AS class_order, class_name FROM finals) WHERE {fx.TESTED}""",
    "best": """SELECT run, epoch AS best_epoch, completed_epochs, precision, recall, map50, map50_95 FROM (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY map50_95 DESC, epoch) AS rk,
               count(*) OVER (PARTITION BY run) AS completed_epochs FROM epochs) WHERE rk = 1""",
    "summary": """SELECT r.run, r.position, r.imgsz,
        split_part(split_part(r.model, '/', 2), '.', 1) AS model,
        split_part(split_part(r.model, '/', 2), '.', 1) || ' / ' || r.imgsz || 'px / ' || r.target_epochs || 'ep' AS label,
        CASE WHEN s.run IS NOT NULL THEN 'completed' ELSE r.status END AS status, s.run IS NOT NULL AS resumed,
        r.duration_seconds + coalesce(s.duration_seconds, 0) AS duration_seconds,
        CASE WHEN s.run IS NOT NULL THEN s.completed_epochs ELSE r.completed_epochs END AS completed_epochs,
        r.target_epochs, b.best_epoch, b.completed_epochs AS logged_epochs, b.map50, b.map50_95,
        t.test_map50_95, p.mean_latency_ms, p.p95_latency_ms, p.model_size_mib
        FROM runs r LEFT JOIN best b USING (run) LEFT JOIN (SELECT * FROM resumes WHERE status = 'completed') s USING (run)
        LEFT JOIN test_metrics t USING (run) LEFT JOIN performance p USING (run)""",
    "baseline": "SELECT * FROM summary ORDER BY position LIMIT 1",
    "selected": "SELECT * FROM summary ORDER BY map50_95 DESC, position LIMIT 1",
    "class_pairs": """SELECT s.class_order, s.class_name, b.ap50_95 AS base, s.ap50_95 AS sel FROM per_class s
        JOIN per_class b USING (class_name)
        WHERE s.run = (SELECT run FROM selected) AND b.run = (SELECT run FROM baseline)""",
    # sessions
    "frames": f"""SELECT user_id AS session_id, event_id AS frame, ts, list_transform(
          list_filter([0, 1, 2, 3], lambda i: i < event_id % 4), lambda i: {{
            'name': {[name for name in settings.FINAL_CLASSES]}[((event_id + i) % 7 + 1)::INT],
            'confidence': ((event_id * 31 + i * 17) % 1000) / 1000e0}}) AS d FROM events""",
    "seen": "SELECT session_id, frame, ts, unnest(d) AS o FROM frames",
    "bad_frames": """SELECT session_id, frame, ts, list_filter(d, lambda o: o.name IN ('no_helmet', 'no_vest')) AS v, len(d) AS n
        FROM frames""",
    "meta": """SELECT DISTINCT user_id AS session_id, user_id % 6 * 5 AS fps, user_id * 37 % 4000 AS frame_total,
        CASE WHEN user_id % 6 * 5 > 0 THEN (user_id % 6 * 5)::DOUBLE ELSE 25 END AS rate FROM events""",
    # preview
    "cand": """SELECT i.split, i.path, i.present AND i.readable AND i.has_label AS opened,
        count(l.path) FILTER (WHERE l.message IS NULL) AS objects,
        count(l.path) FILTER (WHERE l.message IS NOT NULL) + CASE WHEN i.txt IS NULL THEN 1 ELSE 0 END AS bad
        FROM items i LEFT JOIN lines l ON l.path = i.path GROUP BY i.split, i.path, i.present, i.readable, i.has_label, i.txt""",
    "drawn": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256('42:' || path), path) AS rank
        FROM cand WHERE opened AND objects > 0) WHERE rank <= 8""",
}


def _iou(a: str, b: str) -> str:
    inter = (
        f"greatest(0e0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
        f" * greatest(0e0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    )
    area = "greatest(0e0, {0}.x2 - {0}.x1) * greatest(0e0, {0}.y2 - {0}.y1)"
    union = f"({area.format(a)} + {area.format(b)} - {inter})"
    return f"CASE WHEN {union} <> 0 THEN {inter} / {union} ELSE 0 END"


def _candidates(predictions: str, least: float = 0.5) -> str:
    return f"""SELECT * FROM (SELECT t.image_id, t.class_id, t.idx AS gi, p.idx AS pi, {_iou('t', 'p')} AS iou
        FROM truth t JOIN {predictions} p ON p.image_id = t.image_id AND p.class_id = t.class_id) WHERE iou >= {least}"""


def _greedy(predictions: str) -> str:
    """Candidates in falling order, folded with the lists of boxes that are already taken."""
    return f"""SELECT image_id, class_id, m.gi AS gi, m.pi AS pi, m.iou AS iou FROM (
        SELECT image_id, class_id, unnest(list_reduce(
            list_prepend({{'iou': 0e0, 'gi': 0::BIGINT, 'pi': 0::BIGINT, 'taken': []::STRUCT(iou DOUBLE, gi BIGINT, pi BIGINT)[]}},
              list({{'iou': iou, 'gi': gi, 'pi': pi, 'taken': []::STRUCT(iou DOUBLE, gi BIGINT, pi BIGINT)[]}}
                   ORDER BY iou DESC, gi DESC, pi DESC)),
            lambda s, c: {{'iou': 0e0, 'gi': 0::BIGINT, 'pi': 0::BIGINT, 'taken':
              CASE WHEN len(list_filter(s.taken, lambda t: t.gi = c.gi OR t.pi = c.pi)) > 0 THEN s.taken
                   ELSE list_append(s.taken, {{'iou': c.iou, 'gi': c.gi, 'pi': c.pi}}) END}}).taken) AS m
        FROM ({_candidates(predictions)}) GROUP BY image_id, class_id)"""


BLOCKS["matches"] = _greedy("active")
BLOCKS["floor_matches"] = _greedy("(SELECT * FROM predictions WHERE conf >= 0.001)")
BLOCKS["missed_boxes"] = "SELECT * FROM unmatched WHERE side = 'missed'"
BLOCKS["extra_boxes"] = "SELECT * FROM unmatched WHERE side = 'extra'"
BLOCKS["facing"] = f"""SELECT m.image_id, m.idx AS gi, e.idx AS pi, m.class_id AS truth_class,
    e.class_id AS predicted_class, {_iou('m', 'e')} AS iou FROM missed_boxes m JOIN extra_boxes e ON e.image_id = m.image_id"""
BLOCKS["confusions"] = "SELECT * FROM facing WHERE truth_class <> predicted_class AND iou >= 0.5"
BLOCKS["overlapped"] = f"""SELECT DISTINCT a.image_id, a.idx FROM truth a JOIN truth b
    ON b.image_id = a.image_id AND b.idx <> a.idx WHERE {_iou('a', 'b')} >= 0.1"""


def _colour() -> str:
    hue = f"(class_id * {settings.HUE_STEP!r}::DOUBLE) % 1"
    s, v = "0.78::DOUBLE", "0.95::DOUBLE"
    p, q = f"({v} * (1 - {s}))", f"({v} * (1 - {s} * part))"
    t = f"({v} * (1 - {s} * (1 - part)))"
    wheel = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    channels = []
    for c in range(3):
        cases = " ".join(f"WHEN {k} THEN {row[c]}" for k, row in enumerate(wheel))
        channels.append(f"lpad(lower(hex(round_even((CASE six {cases} END) * 255, 0)::INT)), 2, '0')")
    # hex of an INT is unpadded in this engine
    return f"""SELECT class_id, objects, '#' || {' || '.join(channels)} AS color FROM (
        SELECT class_id, count(*) AS objects, floor({hue} * 6)::INT % 6 AS six,
               {hue} * 6 - floor({hue} * 6) AS part FROM valid GROUP BY class_id)"""


def _per_class_text(table: str, key: str) -> str:
    return (
        f"SELECT {key}, string_agg(n::VARCHAR, ',' ORDER BY class_id) AS class_counts, "
        f"string_agg(m::VARCHAR, ',' ORDER BY class_id) AS class_image_counts FROM {table} GROUP BY {key}"
    )


_ATTEMPTS = """SELECT 'run_' || o_custkey AS run, o_orderkey AS attempt_id,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS attempt,
    CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'interrupted' END AS outcome FROM orders WHERE o_orderstatus IN ('F', 'O')"""
_SESSIONS = """SELECT f.session_id, CASE WHEN sum(len(v)) > 0 THEN 'violation_detected' ELSE 'no_violation_detected' END AS status,
    count(*) AS frames_processed, count(*) FILTER (WHERE len(v) > 0) AS frames_with_violations,
    sum(n)::BIGINT AS total_detection_events, sum(len(v))::BIGINT AS violation_detection_events,
    max(n) AS max_detections_in_frame, max(len(v)) AS max_violations_in_frame,
    coalesce(any_value(c.t), '') AS class_counts, any_value(z.t) AS violation_counts FROM bad_frames f
    LEFT JOIN (SELECT session_id, string_agg(name || '=' || k, ',' ORDER BY name) AS t FROM (
        SELECT session_id, o.name AS name, count(*) AS k FROM seen GROUP BY ALL) GROUP BY session_id) c USING (session_id)
    LEFT JOIN (SELECT session_id, 'no_helmet=' || count(*) FILTER (WHERE o.name = 'no_helmet') || ',no_vest='
        || count(*) FILTER (WHERE o.name = 'no_vest') AS t FROM (
          SELECT session_id, unnest(CASE WHEN len(d) = 0 THEN [NULL] ELSE d END) AS o FROM frames) GROUP BY session_id) z
      USING (session_id) GROUP BY f.session_id"""
_FRAMES = """SELECT session_id, frame, {time} array_to_string(list_transform(v, lambda o: o.name || ':' || o.confidence), ',')
    AS violations FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame) AS rk FROM bad_frames
    WHERE len(v) > 0) JOIN meta USING (session_id) WHERE rk <= 100"""
_RATES = """SELECT date_trunc('hour', ts) AS window_start, count(DISTINCT f.frame) AS frames, c.class_name,
    count(*) FILTER (WHERE o.name = c.class_name) AS detections
    FROM (SELECT frame, ts, unnest(CASE WHEN len(d) = 0 THEN [NULL] ELSE d END) AS o FROM frames) f
    CROSS JOIN (VALUES ('no_helmet'), ('no_vest')) c(class_name) GROUP BY ALL"""
_DIGEST_LINES = "image || '|' || image_sha256 || '|' || label || '|' || label_sha256 || chr(10)"
_SPLIT_ORDER = "CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END"
_DIGEST = (
    f"SELECT sha256(string_agg({_DIGEST_LINES}, '' ORDER BY {_SPLIT_ORDER}, image)) AS dataset_sha256, "
    "count(*) AS files, 'sha256-ordered' AS hash_scheme FROM final"
)

def _tree(files: str) -> str:
    return f"""WITH l0 AS (SELECT sha256({_DIGEST_LINES}) AS h FROM {files}),
        l1 AS (SELECT substr(h, 1, 6) AS k, sha256(string_agg(h, '' ORDER BY h)) AS h FROM l0 GROUP BY 1),
        l2 AS (SELECT substr(k, 1, 4) AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM l1 GROUP BY 1),
        l3 AS (SELECT substr(k, 1, 2) AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM l2 GROUP BY 1)
        SELECT sha256(string_agg(h, '' ORDER BY k)) AS dataset_sha256, (SELECT count(*) FROM {files}) AS files,
               'sha256-tree' AS hash_scheme FROM l3"""


_TREE_DIGEST = _tree("final")

QUERIES: dict[str, str] = {
    "annotation_counts_by_split_class": "SELECT * FROM grid",
    "validation_split_counts": """SELECT i.split, count(*) AS images, count(*) FILTER (WHERE present) AS images_present,
        count(*) FILTER (WHERE present AND has_label) AS label_files, coalesce(sum(n), 0)::BIGINT AS annotation_lines,
        FROM items i LEFT JOIN (SELECT path, count(*) AS n FROM raw_lines WHERE present GROUP BY path) l USING (path)
        GROUP BY i.split""",
    "validation_issues": "SELECT * FROM issues",
    "validation_issue_counts": "SELECT severity, code, count(*) AS issues FROM issues GROUP BY ALL",
    "validation_verdict": """SELECT count(*) FILTER (WHERE severity = 'error') AS errors,
        count(*) FILTER (WHERE severity = 'warning') AS warnings,
        count(*) FILTER (WHERE severity = 'error') = 0 AS valid FROM issues""",
    "validation_rollup": """SELECT class_id, split, sum(annotations)::BIGINT AS annotations, sum(images)::BIGINT AS images
        FROM grid GROUP BY ROLLUP (class_id, split)""",
    "class_shares": """SELECT class_id, class_name, sum(annotations)::BIGINT AS annotations,
        sum(annotations)::DOUBLE / (SELECT sum(annotations) FROM grid) AS share FROM grid GROUP BY ALL""",
    "duplicate_contents": "SELECT * FROM copies",
    "duplicate_members": "SELECT digest, copies, split, path FROM items JOIN (SELECT digest, copies FROM copies) USING (digest)",
    "valid_annotations": "SELECT path, line_no, class_id, x, y, w, h FROM valid",
    "label_paths": """SELECT path, replace(regexp_replace(path, '[.]jpg$', '.txt'), '/images/', '/labels/') AS label_path,
        '/ds/labels/' || replace(substr(regexp_replace(path, '[.]jpg$', '.txt'), 5), '/images/', '/pictures/') AS mirrored_path
        FROM images""",
    "source_keys": """SELECT path, CASE WHEN contains(path, '.rf.') THEN split_part(split_part(path, '/', 5), '.rf.', 1)
        ELSE regexp_replace(split_part(path, '/', 5), '[.]jpg$', '') END AS source_key FROM images""",
    "relative_paths": """SELECT path, CASE split WHEN 'val' THEN 'images/' ELSE '' END || split_part(path, '/', 5)
        AS relative_path FROM images""",
    "media_routes": """SELECT CASE o_orderstatus WHEN 'F' THEN 'video' WHEN 'O' THEN 'image' END AS media_type,
        count(*) AS files FROM orders GROUP BY ALL""",
    "class_colors": _colour(),
    "taxonomy_diff": f"""WITH names AS (SELECT DISTINCT coalesce(class_name, f[1]) AS name FROM numbers LEFT JOIN classes USING (class_id)),
        rules AS ({_values([(r,) for r in [*settings.CLASS_SYNONYMS, *settings.REMOVED_SOURCE_CLASSES, 'face shield']], 'name')})
        SELECT 'without_rule' AS side, name FROM (SELECT name FROM names EXCEPT SELECT name FROM rules)
        UNION ALL SELECT 'unused_rule', name FROM (SELECT name FROM rules EXCEPT SELECT name FROM names)""",
    "remap_labels": """SELECT i.path, replace(i.split, 'val', 'valid') || '/images/' || split_part(i.path, '/', 5) AS output_image,
        replace(i.split, 'val', 'valid') || '/labels/' || regexp_replace(split_part(i.path, '/', 5), '[.]jpg$', '.txt') AS output_label,
        coalesce(string_agg(new_id || ' ' || f[2] || ' ' || f[3] || ' ' || f[4] || ' ' || f[5] || chr(10), '' ORDER BY line_no), '') AS new_text
        FROM items i LEFT JOIN (SELECT * FROM valid JOIN new_ids ON old_id = class_id) v ON v.path = i.path
        WHERE i.txt IS NOT NULL GROUP BY i.path, i.split""",
    "remap_counts": f"""SELECT i.split, count(DISTINCT i.path) AS images, count(v.path) AS source_annotations,
        count(v.new_id) AS written_annotations, count(v.path) - count(v.new_id) AS removed_annotations,
        count(DISTINCT i.path) - count(DISTINCT CASE WHEN v.new_id IS NOT NULL THEN i.path END) AS emptied_images,
        {_counts(list(range(16)), 'v.class_id')} AS old_counts, {_counts(list(range(9)), 'v.new_id')} AS new_counts
        FROM items i LEFT JOIN (SELECT * FROM valid LEFT JOIN new_ids ON old_id = class_id) v ON v.path = i.path
        WHERE i.txt IS NOT NULL GROUP BY i.split""",
    "remap_class_counts": """SELECT t.class_id::BIGINT AS class_id, t.class_name, count(v.path) AS annotations FROM target t
        LEFT JOIN (SELECT * FROM valid JOIN new_ids ON old_id = class_id) v ON v.new_id = t.class_id GROUP BY ALL""",
    "emptied_images": """SELECT split, path FROM items WHERE txt IS NOT NULL AND path NOT IN (
        SELECT path FROM valid JOIN new_ids ON old_id = class_id)""",
    "duplicate_consistency": """SELECT digest, count(*) AS copies, any_value(kept_image) AS kept_image,
        any_value(kept_label) AS kept_label, count(DISTINCT body) = 1 AS consistent FROM ranked GROUP BY digest HAVING count(*) > 1""",
    "dedup_kept": f"""SELECT k.path, k.digest, k.object_count, {_counts(list(range(7)), 'l.class_id')} AS class_counts
        FROM kept k LEFT JOIN clean_lines l ON l.path = k.path GROUP BY ALL""",
    "removed_files": """SELECT CASE WHEN rk > 1 THEN 'duplicate_sha256' ELSE 'empty_after_class_filter' END AS reason,
        path AS image, label_path AS label, digest, CASE WHEN rk > 1 THEN kept_image END AS kept_image
        FROM ranked WHERE rk > 1 OR object_count = 0""",
    "removed_class_totals": """SELECT class_name, count(l.path) AS annotations FROM target t LEFT JOIN clean_lines l USING (class_id)
        WHERE class_name IN ('no_gloves', 'no_boots') GROUP BY ALL""",
    "source_groups": f"""SELECT g.source_key, g.size, t.class_counts, t.class_image_counts FROM groups g JOIN ({_per_class_text(
        '''(SELECT g.source_key, c.class_id, coalesce(annotations, 0) AS n, coalesce(images, 0) AS m FROM groups g
            CROSS JOIN finals c LEFT JOIN group_classes k ON k.source_key = g.source_key AND k.class_id = c.class_id)''',
        'source_key')}) t USING (source_key)""",
    "split_assignment": "SELECT source_key, size, stratum::BIGINT AS stratum, split FROM assigned",
    "split_stats": f"""SELECT f.split, count(*) AS images, count(*) AS labels, sum(object_count)::BIGINT AS annotations,
        any_value(t.class_counts) AS class_counts, any_value(t.class_image_counts) AS class_image_counts FROM final f
        JOIN ({_per_class_text('(SELECT split, class_id, annotations AS n, covered AS m FROM sums)', 'split')}) t USING (split)
        GROUP BY f.split""",
    "split_ratios": """SELECT split, images, annotations::BIGINT AS annotations,
        round(images::DOUBLE / sum(images) OVER (), 9) AS actual_ratio, round(ratio, 9) AS target_ratio,
        round(images::DOUBLE / sum(images) OVER () - ratio, 9) AS ratio_deviation FROM split_sizes""",
    "split_class_shares": """SELECT s.split, s.class_id::BIGINT AS class_id, c.class_name, s.annotations, s.covered AS images,
        round(coalesce(s.annotations::DOUBLE / nullif(sum(s.annotations) OVER (PARTITION BY s.split), 0), 0), 9) AS share
        FROM sums s JOIN finals c USING (class_id)""",
    "split_objective": """SELECT round(sum(weight * ((value - target) / target) ** 2), 9) AS objective FROM (
        SELECT 8 AS weight, images::DOUBLE AS value, greatest(sum(images) OVER () * ratio, 1) AS target FROM split_sizes
        UNION ALL SELECT 1, annotations::DOUBLE, greatest(sum(annotations) OVER (PARTITION BY class_id) * ratio, 1) FROM sums
        UNION ALL SELECT 4, covered::DOUBLE, greatest(sum(covered) OVER (PARTITION BY class_id) * ratio, 1) FROM sums)""",
    "split_best_moves": """WITH measures AS (
          SELECT source_key, -1 AS class_id, 8 AS weight, size::DOUBLE AS v FROM groups
          UNION ALL SELECT g.source_key, c.class_id, 1, coalesce(o.annotations, 0)::DOUBLE FROM groups g CROSS JOIN finals c
            LEFT JOIN group_classes o ON o.source_key = g.source_key AND o.class_id = c.class_id
          UNION ALL SELECT g.source_key, c.class_id, 4, coalesce(o.images, 0)::DOUBLE FROM groups g CROSS JOIN finals c
            LEFT JOIN group_classes o ON o.source_key = g.source_key AND o.class_id = c.class_id),
        goals AS (
          SELECT split, -1 AS class_id, 8 AS weight, images::DOUBLE AS t, greatest(sum(images) OVER () * ratio, 1) AS g FROM split_sizes
          UNION ALL SELECT split, class_id, 1, annotations::DOUBLE, greatest(sum(annotations) OVER (PARTITION BY class_id) * ratio, 1) FROM sums
          UNION ALL SELECT split, class_id, 4, covered::DOUBLE, greatest(sum(covered) OVER (PARTITION BY class_id) * ratio, 1) FROM sums),
        changes AS (SELECT source_key, split, sum(weight * v * (v + 2 * (t - g)) / g ** 2) AS enter,
                           sum(weight * v * (v - 2 * (t - g)) / g ** 2) AS leave
          FROM measures JOIN goals USING (class_id, weight) GROUP BY ALL),
        options AS (SELECT a.source_key, a.split, e.split AS target, CASE WHEN e.split = a.split THEN 0.0 ELSE l.leave + e.enter END AS delta
          FROM assigned a JOIN changes l USING (source_key, split) JOIN changes e ON e.source_key = a.source_key)
        SELECT source_key, split, CASE WHEN delta < -1e-12 THEN target END AS target, round(delta, 9) AS delta FROM options
        QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY delta, target) = 1""",
    "split_refinement_check": "SELECT count(*) AS groups, sum(size)::BIGINT AS images, true AS not_worse FROM groups",
    "coverage_gaps": "SELECT split, class_name FROM sums JOIN finals USING (class_id) WHERE covered = 0",
    "leakage_audit": """WITH d AS (SELECT count(DISTINCT split) AS s FROM records GROUP BY digest HAVING count(*) > 1),
        k AS (SELECT 1 FROM records GROUP BY source_key HAVING count(DISTINCT split) > 1)
        SELECT *, duplicate_sha256_groups + cross_split_sha256_groups + cross_split_source_groups = 0 AS passed FROM (
          SELECT (SELECT count(*) FROM d) AS duplicate_sha256_groups, (SELECT count(*) FROM d WHERE s > 1) AS cross_split_sha256_groups,
                 (SELECT count(*) FROM k) AS cross_split_source_groups)""",
    "source_leakage": """SELECT source_key, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM records
        GROUP BY source_key HAVING count(DISTINCT split) > 1""",
    "leakage_audit_frozen": """WITH d AS (SELECT count(DISTINCT split) AS s FROM final GROUP BY image_sha256 HAVING count(*) > 1),
        k AS (SELECT 1 FROM final GROUP BY source_key HAVING count(DISTINCT split) > 1)
        SELECT *, duplicate_sha256_groups + cross_split_sha256_groups + cross_split_source_groups = 0 AS passed FROM (
          SELECT (SELECT count(*) FROM d) AS duplicate_sha256_groups, (SELECT count(*) FROM d WHERE s > 1) AS cross_split_sha256_groups,
                 (SELECT count(*) FROM k) AS cross_split_source_groups)""",
    "pairing_audit": """WITH i AS (SELECT split, regexp_replace(split_part(path, '/', 5), '[.]jpg$', '') AS stem FROM images WHERE content IS NOT NULL),
        l AS (SELECT label_split AS split, regexp_replace(split_part(label_path, '/', 5), '[.]txt$', '') AS stem FROM label_files)
        SELECT split, stem, 'label' AS missing FROM (SELECT * FROM i EXCEPT SELECT * FROM l)
        UNION ALL SELECT split, stem, 'image' FROM (SELECT * FROM l EXCEPT SELECT * FROM i)""",
    "name_collisions": """SELECT split, regexp_replace(split_part(path, '/', 5), '([.]rf[.][0-9a-f]+)?_[0-9]+[.]jpg$', '.jpg') AS name,
        count(*) AS images FROM images GROUP BY ALL HAVING count(*) > 1""",
    "freeze_manifest": "SELECT split, image, label, image_sha256, label_sha256, source_image, source_key FROM final",
    "dataset_digest": _DIGEST,
    "dataset_tree_digest": _TREE_DIGEST,
    "manifest_status": """SELECT image, label, CASE regexp_extract(image, '_([0-9]+)[.]jpg$', 1)::BIGINT % 50
        WHEN 7 THEN 'missing_file' WHEN 8 THEN 'image_mismatch' WHEN 9 THEN 'label_mismatch' ELSE 'ok' END AS status FROM final""",
    "manifest_changes": """WITH numbered AS (SELECT image, regexp_extract(image, '_([0-9]+)[.]jpg$', 1)::BIGINT % 50 AS number FROM final)
        SELECT image, CASE number WHEN 8 THEN 'image' WHEN 9 THEN 'label' WHEN 10 THEN 'image_and_label' ELSE 'removed' END AS change
        FROM numbered WHERE number BETWEEN 6 AND 10
        UNION ALL SELECT image || '.moved', 'added' FROM numbered WHERE number = 6""",
    "manifest_verification": f"""WITH numbered AS (SELECT *, regexp_extract(image, '_([0-9]+)[.]jpg$', 1)::BIGINT % 50 AS number FROM final),
        altered AS (SELECT * REPLACE (CASE number WHEN 8 THEN sha256('altered') ELSE image_sha256 END AS image_sha256,
                                      CASE number WHEN 9 THEN sha256('altered') ELSE label_sha256 END AS label_sha256) FROM numbered),
        sealed AS ({_TREE_DIGEST}), found AS ({_tree("altered")}),
        verified AS (SELECT 'as frozen' AS state, f.dataset_sha256 AS e, f.dataset_sha256 AS c, f.files, 0::BIGINT AS bad FROM sealed f
                 UNION ALL SELECT 'altered', f.dataset_sha256, g.dataset_sha256, g.files,
                                  (SELECT count(*) FROM numbered WHERE number IN (8, 9)) FROM sealed f, found g)
        SELECT state, e AS expected_sha256, e AS manifest_sha256, c AS computed_sha256, files AS files_verified,
               bad AS bad_files, e = c AND bad = 0 AS passed FROM verified""",
    "freeze_summary": """SELECT (SELECT count(*) FROM records) AS input_images,
        (SELECT count(*) FROM (SELECT 1 FROM records GROUP BY digest HAVING count(*) > 1)) AS duplicate_groups,
        (SELECT count(*) FROM (SELECT 1 FROM records GROUP BY digest HAVING count(*) > 1 AND count(DISTINCT body) > 1)) AS inconsistent_groups,
        (SELECT count(*) FROM ranked WHERE rk > 1) AS duplicates_removed,
        (SELECT count(*) FROM kept WHERE object_count = 0) AS emptied_removed,
        (SELECT count(*) FROM retained) AS final_images, (SELECT sum(object_count)::BIGINT FROM retained) AS final_annotations,
        (SELECT count(*) FROM groups) AS source_groups,
        (SELECT count(*) FROM clean_lines WHERE class_id = 7) AS input_no_gloves,
        (SELECT count(*) FROM clean_lines WHERE class_id = 8) AS input_no_boots""",
    "iou_candidates": _candidates("predictions"),
    "greedy_matches": "SELECT * FROM matches",
    "match_components": f"""SELECT image_id, class_id, gi, min(reached) AS part FROM (
        WITH RECURSIVE found AS MATERIALIZED ({_candidates("predictions", settings.OCCLUSION_IOU)}),
            linked AS MATERIALIZED (SELECT DISTINCT a.image_id, a.class_id, a.gi, b.gi AS other
                                    FROM found a JOIN found b USING (image_id, class_id, pi)),
            reach AS (SELECT image_id, class_id, gi, other AS reached FROM linked
                      UNION SELECT r.image_id, r.class_id, r.gi, l.other FROM reach r
                            JOIN linked l ON l.image_id = r.image_id AND l.class_id = r.class_id AND l.gi = r.reached)
        SELECT * FROM reach) GROUP BY image_id, class_id, gi""",
    "missed_and_extra": "SELECT side, image_id, class_id, idx FROM unmatched",
    "class_confusions": "SELECT * FROM confusions",
    "overlapping_truth": "SELECT * FROM overlapped",
    "image_errors": "SELECT * FROM image_errors",
    "error_categories": """SELECT category, sum(events)::BIGINT AS events, count(*) FILTER (WHERE events > 0) AS images
        FROM events_long GROUP BY category""",
    "error_examples_topk": """SELECT * FROM (SELECT image_id, category, events,
        row_number() OVER (PARTITION BY category ORDER BY image_id) AS rank FROM events_long WHERE events > 0) WHERE rank <= 20""",
    "prediction_count": "SELECT count(*) AS prediction_boxes FROM predictions WHERE conf >= 0.001",
    "pr_curve": "SELECT * FROM curve",
    "average_precision": "SELECT class_id, iou_threshold, round(ap, 9) AS ap FROM ap",
    "detection_metrics": """SELECT class_id, class_name, round(precision, 9) AS precision, round(recall, 9) AS recall,
        round(ap50, 9) AS ap50, round(ap50_95, 9) AS ap50_95 FROM metrics""",
    "mean_metrics": """SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall,
        round(avg(ap50), 9) AS map50, round(avg(ap50_95), 9) AS map50_95 FROM metrics""",
    "latency_summary": """SELECT event_type, count(value) AS samples, round(avg(value), 9) AS mean_ms,
        round(quantile_cont(value, 0.5), 9) AS p50_ms, round(quantile_cont(value, 0.95), 9) AS p95_ms FROM events GROUP BY event_type""",
    "best_epochs": "SELECT * FROM best",
    "run_summary": """SELECT run, label, model, status, resumed,
        status = 'completed' AND coalesce(completed_epochs, logged_epochs) < target_epochs AS stopped_early,
        best_epoch, logged_epochs, completed_epochs, map50_95, test_map50_95, mean_latency_ms,
        round(duration_seconds, 6) AS duration_seconds FROM summary""",
    "model_selection": """SELECT b.run AS baseline_experiment, s.run AS selected_experiment, s.map50_95 AS selected_map50_95,
        s.map50_95 - b.map50_95 AS validation_delta, s.test_map50_95 - b.test_map50_95 AS test_delta FROM baseline b CROSS JOIN selected s""",
    "attempts": _ATTEMPTS,
    "ranked_experiments": """SELECT run AS experiment, label, model, imgsz, best_epoch, map50_95 AS validation_map50_95,
        map50 AS validation_map50, test_map50_95, mean_latency_ms, p95_latency_ms, model_size_mib FROM summary""",
    "per_class_long": """SELECT class_order::BIGINT AS class_order, class_name, 'Baseline' AS experiment, base AS ap50_95, 0e0 AS delta FROM class_pairs
        UNION ALL SELECT class_order, class_name, 'Selected', sel, sel - base FROM class_pairs""",
    "comparison_headline": """SELECT s.map50_95 AS selected_validation_map50_95, s.map50_95 - b.map50_95 AS validation_delta,
        s.test_map50_95 AS selected_test_map50_95, s.test_map50_95 - b.test_map50_95 AS test_delta,
        (SELECT sel FROM class_pairs WHERE class_name = 'no_helmet') AS no_helmet_ap50_95,
        (SELECT sel - base FROM class_pairs WHERE class_name = 'no_helmet') AS no_helmet_delta,
        (SELECT sel FROM class_pairs WHERE class_name = 'no_vest') AS no_vest_ap50_95,
        (SELECT sel - base FROM class_pairs WHERE class_name = 'no_vest') AS no_vest_delta,
        s.mean_latency_ms FROM baseline b CROSS JOIN selected s WHERE EXISTS (SELECT 1 FROM class_pairs)""",
    "first_images": "SELECT path FROM images WHERE split = 'test' ORDER BY path LIMIT 100",
    "session_summary": _SESSIONS,
    "session_summary_stream": _SESSIONS,
    "violation_frames": _FRAMES.format(time="round(frame / rate, 3) AS time_seconds,"),
    "violation_frames_stream": _FRAMES.format(time=""),
    "session_limits": """SELECT m.session_id, round(rate, 3) AS fps, count(f.frame) AS frames,
        round(count(f.frame) / rate, 3) AS duration_seconds,
        CASE WHEN frame_total / rate > 120 THEN 'too_long' WHEN count(f.frame) > greatest(1, floor(120 * rate)) THEN 'too_many_frames'
             WHEN count(f.frame) = 0 THEN 'no_frames' ELSE 'ok' END AS verdict
        FROM meta m LEFT JOIN frames f USING (session_id) GROUP BY m.session_id, rate, frame_total""",
    "violation_rate_hourly": _RATES,
    "violation_rate_stream": _RATES,
    "detection_normalisation": """SELECT image_id, idx, class_id, class_name, round(conf / 7, 6) AS confidence,
        round(x1, 2) AS x1, round(y1, 2) AS y1, round(x2, 2) AS x2, round(y2, 2) AS y2 FROM predictions JOIN finals USING (class_id)""",
    "preview_sample": """SELECT split, path, rank, objects, 'sample_' || lpad('' || rank, 3, '0') || '_' ||
        trim(regexp_replace(regexp_replace(split_part(path, '/', 5), '[.]jpg$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '._')
        || '_' || substr(sha256(path), 1, 8) || '.png' AS output_name FROM drawn""",
    "preview_summary": """SELECT split, 8::BIGINT AS requested, count(*) FILTER (WHERE opened AND objects > 0) AS available,
        count(*) FILTER (WHERE NOT (opened AND objects > 0)) AS skipped,
        coalesce(sum(bad) FILTER (WHERE opened), 0)::BIGINT AS invalid_lines, any_value(d.images) AS images,
        any_value(d.total) AS objects, any_value(round(d.total::DOUBLE / d.images, 4)) AS average_objects,
        any_value(d.images < 8) AS short FROM cand JOIN (
          SELECT split, count(*) AS images, sum(objects)::BIGINT AS total FROM drawn GROUP BY split) d USING (split) GROUP BY split""",
    "preview_distribution": """WITH g AS (SELECT d.split, c.class_id::BIGINT AS class_id, c.class_name, count(v.path) AS objects
        FROM (SELECT DISTINCT split FROM drawn) d CROSS JOIN classes c
        LEFT JOIN (SELECT v.* FROM valid v JOIN drawn USING (path)) v ON v.split = d.split AND v.class_id = c.class_id GROUP BY ALL)
        SELECT class_id, class_name, split, objects FROM g
        UNION ALL SELECT class_id, class_name, NULL, sum(objects)::BIGINT FROM g GROUP BY class_id, class_name""",
    "pixel_boxes": """SELECT path, line_no,
        greatest(0, least(width - 1, round_even((x - w / 2) * width, 0)::INT)) AS x1,
        greatest(0, least(height - 1, round_even((y - h / 2) * height, 0)::INT)) AS y1,
        greatest(0, least(width - 1, round_even((x + w / 2) * width, 0)::INT)) AS x2,
        greatest(0, least(height - 1, round_even((y + h / 2) * height, 0)::INT)) AS y2 FROM valid""",
    "batched_inference_stub": """SELECT doc_id AS image_id, doc_id % 7 AS class_id, (doc_id * 37 % 101) / 101e0 AS conf FROM documents""",
}


# The chain from boxes to errors once more, over boxes from label lines.
BLOCKS["label_truth"] = f"""SELECT image_id, line_no AS idx, class_id, (x - w / 2) * width AS x1, (y - h / 2) * height AS y1,
    (x + w / 2) * width AS x2, (y + h / 2) * height AS y2, width, height FROM (
      SELECT doc_id AS image_id, line_no, l.class_id::BIGINT AS class_id, {fx.WIDTH}::INT AS width, {fx.HEIGHT}::INT AS height,
             split_part(line, ' ', 2)::DOUBLE AS x, split_part(line, ' ', 3)::DOUBLE AS y,
             split_part(line, ' ', 4)::DOUBLE AS w, split_part(line, ' ', 5)::DOUBLE AS h
      FROM docs JOIN clean_lines l ON l.path = '/ds/' || split || '/images/' || stem || '.jpg')"""
BLOCKS["label_predictions"] = _project(fx.LABEL_PREDICTIONS, "label_truth")
_CHAIN = "active matches unmatched missed_boxes extra_boxes facing confusions overlapped image_errors events_long".split()
for _name in _CHAIN:
    _sql = re.sub(rf"\b(FROM|JOIN)\s+(truth|predictions|{'|'.join(_CHAIN)})\b", r"\1 label_\2", BLOCKS[_name])
    BLOCKS[f"label_{_name}"] = _sql.replace("(640 * 640)", "(width * height)").replace(
        "FROM label_unmatched WHERE side = 'missed'",
        "FROM label_unmatched JOIN (SELECT DISTINCT image_id, width, height FROM label_truth) USING (image_id) WHERE side = 'missed'",
    )
QUERIES["image_sizes"] = (
    f"SELECT '/ds/' || split || '/images/' || stem || '.jpg' AS path, {fx.WIDTH}::INT AS width, {fx.HEIGHT}::INT AS height FROM docs"
)
QUERIES["truth_from_labels"] = "SELECT image_id, idx, class_id, x1, y1, x2, y2, width, height FROM label_truth"
QUERIES["error_categories_from_labels"] = re.sub(r"\bevents_long\b", "label_events_long", QUERIES["error_categories"])

# The refinement and the coverage repair, round by round.  Every state lists the groups with their splits.
BLOCKS["counts"] = """SELECT g.source_key, c.class_id, coalesce(o.annotations, 0) AS annotations, coalesce(o.images, 0) AS images
    FROM groups g CROSS JOIN finals c LEFT JOIN group_classes o ON o.source_key = g.source_key AND o.class_id = c.class_id"""
BLOCKS["group_measures"] = """SELECT source_key, -1 AS class_id, 8 AS weight, size::DOUBLE AS v FROM groups
    UNION ALL SELECT source_key, class_id, 1, annotations::DOUBLE FROM counts
    UNION ALL SELECT source_key, class_id, 4, images::DOUBLE FROM counts"""
BLOCKS["split_goals"] = """SELECT split, class_id, weight, greatest(n * ratio::DOUBLE, 1) AS g FROM out_splits
    CROSS JOIN (SELECT class_id, weight, sum(v) AS n FROM group_measures GROUP BY ALL)"""


def _changes(state: str) -> dict[str, str]:
    """Sums of a state, and what entering or leaving a split changes for every group."""
    return {
        f"totals_{state}": f"""SELECT g.split, g.class_id, g.weight, g.g, coalesce(any_value(s.t), 0) AS t FROM split_goals g LEFT JOIN (
            SELECT split, class_id, weight, sum(v) AS t FROM state_{state} JOIN group_measures USING (source_key) GROUP BY ALL) s
            USING (split, class_id, weight) GROUP BY g.split, g.class_id, g.weight, g.g""",
        f"changes_{state}": f"""SELECT source_key, split, sum(weight * v * (v + 2 * (t - g)) / g ** 2) AS enter,
            sum(weight * v * (v - 2 * (t - g)) / g ** 2) AS leave
            FROM group_measures JOIN totals_{state} USING (class_id, weight) GROUP BY ALL""",
    }


def _round(turn: int, state: str, following: str, before: str | None) -> dict[str, str]:
    """One round of moves; `before` is the round that must have moved something."""
    unless_stopped = f"AND EXISTS (SELECT 1 FROM choice_{before})" if before else ""
    return _changes(state) | {
        f"moves_{state}": f"""SELECT a.source_key, a.split, e.split AS target, least(24, floor(32 - log2(
              ('0x' || substr(sha256('42:{turn}:' || a.source_key), 1, 8))::BIGINT + 1)))::INT AS halvings FROM state_{state} a
            JOIN changes_{state} l USING (source_key, split) JOIN changes_{state} e ON e.source_key = a.source_key AND e.split <> a.split
            WHERE l.leave + e.enter < -1e-12
            QUALIFY row_number() OVER (PARTITION BY a.source_key ORDER BY l.leave + e.enter, e.split) = 1""",
        f"flows_{state}": f"""SELECT halvings, u.split, class_id, weight, sum(sign * v) AS v FROM (
            SELECT source_key, halvings, split, -1 AS sign FROM moves_{state}
            UNION ALL SELECT source_key, halvings, target, 1 FROM moves_{state}) u JOIN group_measures USING (source_key) GROUP BY ALL""",
        f"scores_{state}": f"""SELECT smallest, sum(weight * ((t + moved - g) / g) ** 2) AS score FROM (
            SELECT smallest, x.split, x.class_id, x.weight, x.t, x.g, coalesce(sum(f.v), 0) AS moved
            FROM (SELECT DISTINCT halvings AS smallest FROM moves_{state}) h CROSS JOIN totals_{state} x
            LEFT JOIN flows_{state} f ON f.halvings >= smallest AND f.split = x.split AND f.class_id = x.class_id AND f.weight = x.weight
            GROUP BY ALL) GROUP BY smallest""",
        f"choice_{state}": f"""SELECT smallest FROM scores_{state} WHERE score <
            (SELECT sum(weight * ((t - g) / g) ** 2) FROM totals_{state}) - 1e-12 {unless_stopped} ORDER BY score, smallest LIMIT 1""",
        f"state_{following}": f"""SELECT a.source_key, CASE WHEN m.halvings >= (SELECT smallest FROM choice_{state}) THEN m.target
            ELSE a.split END AS split FROM state_{state} a LEFT JOIN moves_{state} m USING (source_key)""",
    }


def _repair(state: str, following: str, target: str, place: int, places: list[int]) -> dict[str, str]:
    """Close the gap of class `place` in `target`, if there is one."""
    return _changes(state) | {
        f"donor_{state}": f"""SELECT a.source_key FROM state_{state} a JOIN changes_{state} l USING (source_key, split)
            JOIN changes_{state} e ON e.source_key = a.source_key AND e.split = '{target}'
            JOIN counts c ON c.source_key = a.source_key AND c.class_id = {place} AND c.images > 0
            WHERE a.split <> '{target}'
              AND (SELECT t FROM totals_{state} WHERE split = '{target}' AND class_id = {place} AND weight = 4) = 0
              AND NOT EXISTS (SELECT 1 FROM counts k JOIN totals_{state} x ON x.class_id = k.class_id AND x.weight = 4
                WHERE k.source_key = a.source_key AND x.split = a.split AND k.images > 0 AND x.t <= k.images
                  AND k.class_id IN ({", ".join(map(str, places))}))
            ORDER BY l.leave + e.enter, a.source_key LIMIT 1""",
        f"state_{following}": f"""SELECT source_key, CASE WHEN source_key IN (SELECT source_key FROM donor_{state})
            THEN '{target}' ELSE split END AS split FROM state_{state}""",
    }


_ROUNDS = "abcdef"
_REQUIRED = [settings.FINAL_CLASSES.index(name) for name in settings.VIOLATION_CLASSES]
BLOCKS["state_a"] = "SELECT source_key, split FROM assigned"
for _turn, (_now, _next) in enumerate(zip(_ROUNDS, _ROUNDS[1:])):
    BLOCKS |= _round(_turn, _now, _next, _ROUNDS[_turn - 1] if _turn else None)
_GAPS = [(split, place) for split in settings.SPLIT_RATIOS for place in _REQUIRED]


def _repairs(prefix: str, start: str) -> str:
    """Blocks for every possible gap; returns the last state."""
    state = start
    for number, (split, place) in enumerate(_GAPS):
        following = f"{prefix}_{chr(ord('a') + number)}"
        BLOCKS.update(_repair(state, following, split, place, _REQUIRED))
        state = following
    return state


_DONE = _repairs("frozen", _ROUNDS[-1])
BLOCKS["frozen"] = BLOCKS["final"].replace("JOIN assigned a", f"JOIN state_{_DONE} a")
BLOCKS["frozen_classes"] = BLOCKS["final_classes"].replace("JOIN assigned a", f"JOIN state_{_DONE} a")
BLOCKS["frozen_sums"] = BLOCKS["sums"].replace("final_classes", "frozen_classes")
BLOCKS["state_bare"] = f"""SELECT source_key, CASE WHEN source_key IN (SELECT source_key FROM counts
    WHERE images > 0 AND class_id IN ({", ".join(map(str, _REQUIRED))})) THEN 'train' ELSE split END AS split FROM assigned"""
_COVERED = _repairs("covered", "bare")
QUERIES["split_refined"] = "SELECT source_key, size, split FROM state_f JOIN groups USING (source_key)"
QUERIES["frozen_manifest"] = QUERIES["freeze_manifest"].replace("FROM final", "FROM frozen")
QUERIES["frozen_digest"] = _tree("frozen")
QUERIES["frozen_split_stats"] = re.sub(r"\b(FROM) (final|sums)\b", r"\1 frozen_\2", QUERIES["split_stats"]).replace(
    "frozen_final", "frozen"
)
QUERIES["coverage_gaps_forced"] = f"""SELECT x.split, class_name FROM totals_bare x JOIN finals USING (class_id)
    WHERE weight = 4 AND t = 0 AND class_id IN ({", ".join(map(str, _REQUIRED))})"""
QUERIES["coverage_moves"] = f"""SELECT source_key, b.split, a.split AS target FROM state_bare b JOIN state_{_COVERED} a USING (source_key)
    WHERE a.split <> b.split"""
QUERIES["coverage_repaired"] = f"""SELECT split, c.class_name, coalesce(sum(k.images), 0)::BIGINT AS images FROM out_splits
    CROSS JOIN finals c LEFT JOIN state_{_COVERED} a USING (split)
    LEFT JOIN counts k ON k.source_key = a.source_key AND k.class_id = c.class_id
    WHERE c.class_id IN ({", ".join(map(str, _REQUIRED))}) GROUP BY ALL"""


def _stretches(rows: str) -> str:
    """Rows with the number of their stretch: 18 hours without a row start a new one."""
    return f"""SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS stretch FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) < INTERVAL 18 HOUR THEN 0 ELSE 1 END AS opens
        FROM {rows})"""


def _ended(ts: str) -> str:
    return f"""SELECT session_id, stretch, min({ts}) AS started, max({ts}) + INTERVAL 18 HOUR AS ended FROM {{0}}
        GROUP BY ALL HAVING max({ts}) + INTERVAL 18 HOUR <= (SELECT date_trunc('millisecond', max({ts})) - INTERVAL 1 HOUR FROM {{0}})"""


BLOCKS["stretches"] = _stretches("bad_frames")
BLOCKS["ended"] = _ended("ts").format("stretches")
# The violations are timed in milliseconds.
BLOCKS["violating"] = _stretches(
    "(SELECT session_id, frame, date_trunc('millisecond', ts) AS ts, v FROM bad_frames WHERE len(v) > 0)"
)
BLOCKS["ended_violating"] = _ended("ts").format("violating")
BLOCKS["ended_frames"] = "SELECT s.*, e.started, e.ended FROM stretches s JOIN ended e USING (session_id, stretch)"
BLOCKS["ended_classes"] = """SELECT session_id, stretch, string_agg(name || '=' || k, ',' ORDER BY name) AS t FROM (
    SELECT session_id, stretch, o.name AS name, count(*) AS k
    FROM (SELECT session_id, stretch, unnest(d) AS o FROM ended_frames JOIN frames USING (session_id, frame)) GROUP BY ALL) GROUP BY ALL"""
QUERIES["ended_sessions_stream"] = """SELECT f.session_id, started, ended,
    CASE WHEN sum(len(v)) > 0 THEN 'violation_detected' ELSE 'no_violation_detected' END AS status,
    count(*) AS frames_processed, count(*) FILTER (WHERE len(v) > 0) AS frames_with_violations,
    sum(len(v))::BIGINT AS violation_detection_events, max(len(v)) AS max_violations_in_frame,
    coalesce(any_value(c.t), '') AS class_counts,
    'no_helmet=' || sum(len(list_filter(v, lambda o: o.name = 'no_helmet'))) ||
    ',no_vest=' || sum(len(list_filter(v, lambda o: o.name = 'no_vest'))) AS violation_counts
    FROM ended_frames f LEFT JOIN ended_classes c USING (session_id, stretch) GROUP BY f.session_id, stretch, started, ended"""
QUERIES["ended_violations_stream"] = """SELECT session_id, ended, frame,
    array_to_string(list_transform(v, lambda o: o.name || ':' || o.confidence), ',') AS violations FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id, stretch ORDER BY frame) AS rk
      FROM violating JOIN ended_violating USING (session_id, stretch)) WHERE rk <= 5"""


def _sources(sql: str) -> list[str]:
    """Blocks that `sql` reads from."""
    return [name for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", sql) if name in BLOCKS]


def _needed(sql: str, order: list[str] | None = None) -> list[str]:
    """Blocks that `sql` needs, each after those it needs itself."""
    order = [] if order is None else order
    for name in _sources(sql):
        if name not in order:
            _needed(BLOCKS[name], order)
            order.append(name)
    return order


_FOLDS = ("truth", "matches", "floor_matches", "unmatched", "missed_boxes", "extra_boxes", "facing")
_KEPT = (*_FOLDS, *(f"label_{name}" for name in _FOLDS))


_STEPS = ("counts", "group_measures", "state_", "totals_", "changes_", "moves_", "choice_")


def _assemble(sql: str) -> str:
    blocks = ", ".join(
        f"{name} AS {'MATERIALIZED ' if name in _KEPT or name.startswith(_STEPS) else ''}({BLOCKS[name]})" for name in _needed(sql)
    )
    if not blocks:
        return sql
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {blocks}, " + sql.lstrip()[5:]
    return f"WITH {blocks} {sql}"


ORACLE = {name: _assemble(sql) for name, sql in QUERIES.items()}
