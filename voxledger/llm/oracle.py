"""DuckDB SQL of those queries that SQL can express, written apart from them."""

NAME = r"""regexp_extract(replace(replace(replace(replace(lower(audio_path), '%5f', '_'), '%20', ' '), '%2b', '+'), '%26', '&'), '[^/\\]*$')"""
TAIL = r"[_\- ]\d{4}[_\-]?\d{2}[_\-]?\d{2}[_\- ](\d+)[_\- ](\d+)[_\- ][0-9a-f]{8}(?:\.\w+)*\s*$"
CASES = rf"list_transform(regexp_extract_all(regexp_extract({NAME}, '(case.*?){TAIL}', 1), '\d+'), lambda x: CAST(x AS BIGINT))"

GROUPS = f"""WITH RECURSIVE named AS (SELECT row_id, {CASES} AS cases FROM train WHERE audio_path IS NOT NULL),
 links AS (SELECT DISTINCT cases[1] AS a, unnest(cases[2:]) AS b FROM named WHERE len(cases) > 1),
 ties AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach AS (SELECT a AS x, a AS y FROM ties UNION SELECT reach.x, ties.b FROM reach JOIN ties ON reach.y = ties.a),
 least AS (SELECT x, min(y) AS low FROM reach GROUP BY x),
 grouped AS (SELECT row_id, coalesce(low, cases[1]) AS low FROM named LEFT JOIN least ON x = cases[1])"""

COUNT = r"len(regexp_extract_all(replace({}, '<space>', ' '), '[^\s|]*\w[^\s|]*'))"
LONG = rf"""WITH s AS (SELECT segment_id, case_id, seg_no, {COUNT.format("transcript")} AS n, CASE WHEN end_sec > start_sec THEN end_sec - start_sec END AS raw FROM segment_ctm),
 u AS (SELECT case_id, sum(raw) FILTER (WHERE n > 0) / sum(n) FILTER (WHERE raw IS NOT NULL) AS per FROM s GROUP BY case_id),
 t AS (SELECT s.*, round(raw * CASE WHEN per < 60 OR per IS NULL THEN 1.0::DOUBLE WHEN per < 1600 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE / 16000 END, 2) AS sec FROM s LEFT JOIN u USING (case_id)),
 k AS (SELECT case_id, seg_no, max(sec) AS whole, max(n) AS seg_n FROM t WHERE sec IS NOT NULL GROUP BY ALL),
 r AS (SELECT row_id, CASE WHEN length > 0 THEN length END AS length, 'case' || CAST({CASES}[1] AS VARCHAR) AS case_id, TRY_CAST(regexp_extract({NAME}, '{TAIL}', 1) AS INTEGER) AS seg_no, CASE WHEN {COUNT.format("transcription")} > 0 THEN {COUNT.format("transcription")} END AS n FROM train),
 e AS (SELECT row_id, length, whole, coalesce(whole * coalesce(least(1.0::DOUBLE, n / CASE WHEN seg_n > 0 THEN seg_n END), 1.0::DOUBLE), 0.4::DOUBLE * n, 10.0::DOUBLE) AS want FROM r LEFT JOIN k USING (case_id, seg_no)),
 f AS (SELECT row_id, round(coalesce(length * list_sort(list_transform([1.0::DOUBLE, 0.001::DOUBLE, 1.0::DOUBLE / 16000], lambda x: struct_pack(off := abs(ln(length * x / want)), unit := x)))[1].unit, whole), 2) AS sec FROM e)"""

SQL: dict[str, str] = {
    "p1_found": f"{GROUPS} SELECT row_id, 'case' || CAST(low AS VARCHAR) AS group_case FROM grouped",
    "p2_found": f"{LONG} SELECT 'segment_ctm' AS source_table, segment_id AS item_id FROM t WHERE sec > 30 UNION ALL SELECT 'train', row_id FROM f WHERE sec > 30",
}
