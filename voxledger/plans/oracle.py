"""DuckDB SQL that the queries are compared with, stated from what the operators have to give."""

EXTRA = """CASE turn_id % 8 WHEN 0 THEN ' I''m sure we''re done, i''ll go' WHEN 1 THEN ' um Uh you know well' WHEN 2 THEN ' (12%) of 1192-1195 see Section 6A2'
 WHEN 3 THEN ' [UNCLEAR] [noise] [INAUDIBLE] on' WHEN 4 THEN ' at 11:30 AM, 12.5 of 1,000; 10:15:20:30 ok?' WHEN 5 THEN ' the 1 st, 2 nd' WHEN 6 THEN '... so;: be it!' ELSE ' Page 12b.''' END"""
BASE = f"(SELECT turn_id, dialogue || {EXTRA} AS t FROM spk_dialg_json WHERE dialogue IS NOT NULL)"


def sub(x: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', '{flags}')"


def squeeze(x: str) -> str:
    return f"trim({sub(x, '[ \\t\\n\\r\\f\\v]+', ' ')})"


def contractions(x: str) -> str:
    for a, b in (("aren''t", "are not"), ("I''m", "I am"), ("you''re", "you are"), ("we''re", "we are"), ("they''re", "they are"), ("there''s", "there is"), ("I''ve", "I have"), ("you''ve", "you have"), ("we''ve", "we have"), ("they''ve", "they have"), ("he''s", "he is"), ("she''s", "she is"), ("i''ll", "i will"), ("you''ll", "you will"), ("we''ll", "we will")):
        x = sub(x, rf"\b{a}\b", b)
    return x


def fillers(x: str) -> str:
    return f"trim({sub(x, r'\b(um|uh|you know)\b', '', 'gi')})"


def percent(x: str) -> str:
    return squeeze(sub(x, r"\b(\d+)%", r"\1 percent "))


def citations(x: str) -> str:
    x = sub(f"replace(replace({x}, '(', ''), ')', '')", r"(\d+)-(\d+)", r"\1 to \2")
    x = sub(f"replace({x}, '-', ' ')", r"\b((?:Article|Section|Page)\s+)?(\d+)([a-zA-Z])", r"\1\2 \3", "gi")
    return sub(x, r"\b(\d+)([a-zA-Z])", r"\1 \2", "gi")


def placeholders(x: str) -> str:
    return sub(f"replace(replace({x}, '[UNCLEAR]', 'UNCLEAR'), '[INAUDIBLE]', 'INAUDIBLE')", r"\[[^\]\n]*\]", "")


def punctuation(x: str) -> str:
    x = sub(x, r"(\d+)\s*(st|nd|rd|th)(\s|$)", r"\1\2\3", "gi")
    # a clock time ends after its third field
    x = sub(x, r"\b(\d{1,2}):(\d{2}):(\d{2})", r"\1~C~\2~C~\3~E~")
    x = sub(x, r"\b(\d{1,2}):(\d{2})", r"\1~C~\2")
    x = sub(x, r"\b(\d+)\.(\d+)\b", r"\1~D~\2")
    x = sub(x, r'[.,!?;"]+(\s|$)', r"\1")
    x = sub(x, r'[.,!?;"]+([.,!?;"])', r"\1")
    x = sub(sub(x, r"\.{2,}", ""), "[;:]", "")
    return squeeze(f"replace(replace(replace({x}, '~C~', ':'), '~D~', '.'), '~E~', '')")


def clean(x: str) -> str:
    x = sub(f"trim({sub(x, r'\d+$', '')})", r"[^\x00-\x7f]", "")
    return f"lower({punctuation(placeholders(citations(percent(fillers(contractions(x))))))})"


def of_text(x: str) -> str:
    return f"SELECT turn_id, {x} AS text FROM {BASE}"


ONCE = "(SELECT case_id, dialogue_no, arg_min(struct_pack(s := real_speaker, d := dialogue), turn_id) AS r FROM spk_dialg_json GROUP BY ALL)"
LINES = f"""(SELECT case_id, dialogue_no AS page, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM
 (SELECT case_id, dialogue_no, string_split(CASE WHEN r.s IS NULL THEN '' ELSE upper(r.s) || ': ' END || r.d || CASE dialogue_no % 6 WHEN 0 THEN chr(10) || '7 11:30 AM' WHEN 1 THEN chr(10) || '11:30 AM IST' WHEN 2 THEN chr(10) || '9 42' || chr(10) || '43' WHEN 3 THEN chr(10) || '12 and so on' WHEN 4 THEN chr(10) || 'at 10:15:20:30 sharp' ELSE '' END, chr(10)) AS p FROM {ONCE} WHERE r.d IS NOT NULL))"""
BOILER = r"regexp_matches(trim(line), 'Transcribed by TERES|END OF DAY.?S PROCEEDINGS|^\d+$|END OF THIS PROCEEDING', 'i')"
CLOCK = rf"(regexp_matches(trim(line), '^\d{{1,2}}:\d{{2}}(:\d{{2}})?\s*(AM|PM)?\s*(IST|EST|GMT|UTC)?$') OR {BOILER})"
LETTERS = r"regexp_replace(split_part(trim(line), ':', 1), '[^\p{L}]', '', 'g')"
SPEAKER = rf"(contains(line, ':') AND NOT {BOILER} AND {LETTERS} <> '' AND {LETTERS} = upper({LETTERS}))"

SEGMENTS = "(SELECT case_id, seg_no, CAST(round(r.s * 1000) AS BIGINT) AS start_ms, CAST(round(r.e * 1000) AS BIGINT) AS end_ms, replace(r.t, '<space>', ' ') AS text FROM (SELECT case_id, seg_no, arg_min(struct_pack(s := start_sec, e := end_sec, t := transcript), segment_id) AS r FROM segment_ctm GROUP BY ALL))"
WORDS = f"(SELECT case_id, seg_no * 100000 + k AS word_no, word, start_ms + k * 400 AS start_ms, start_ms + k * 400 + 400 AS end_ms FROM (SELECT case_id, seg_no, start_ms, unnest(range(len(w))) AS k, unnest(w) AS word FROM (SELECT case_id, seg_no, start_ms, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM {SEGMENTS})))"
CTM = "(SELECT segment_id, CAST(round(round(start_sec, 2) * 1000) AS BIGINT) AS start_ms, CAST(round((round(start_sec, 2) + round(end_sec - start_sec, 2)) * 1000) AS BIGINT) AS end_ms, transcript FROM segment_ctm)"

NAME = r"regexp_extract(audio_path, '([^/\\]*)$', 1)"
STEM = r"regexp_extract(audio_path, '([^/\\]+?)(?:\.[^./\\]*)?$', 1)"
SCORED = r"""(SELECT id, audio_path, r, list_filter(string_split(array_to_string(h, ' '), ' '), lambda x: x <> '') AS h FROM (SELECT row_id AS id, audio_path, w AS r, list_transform(w, lambda x, i:
 CASE WHEN (row_id + i - 1) % 11 = 5 THEN '' WHEN (row_id + i - 1) % 7 = 3 THEN 'zz' WHEN (row_id + i - 1) % 13 = 1 THEN x || ' ' || x WHEN row_id % 17 = 0 THEN x || ' yy yy' ELSE x END) AS h
 FROM (SELECT row_id, audio_path, list_filter(regexp_split_to_array(lower(transcription), '\s+'), lambda x: x <> '') AS w FROM validation WHERE transcription IS NOT NULL)))"""
# of rows that name one file the last counts
FILES = f"(SELECT f AS id, last.r AS r, last.h AS h FROM (SELECT coalesce({STEM}, CAST(id AS VARCHAR)) AS f, arg_max(struct_pack(r := r, h := h), id) AS last FROM {SCORED} GROUP BY 1))"


def distance(rows: str) -> str:
    """CTEs p (id, r, h), d with a row of the table of costs per prefix of r, and e (id, n, wrong)."""
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT id, r, h FROM {rows}), d AS (
 SELECT id, 0 AS i, CAST(range(0, len(h) + 1) AS BIGINT[]) AS prev FROM p
 UNION ALL
 SELECT id, i + 1, list_transform(t, lambda x, j: j - 1 + list_min(list_transform(t[1:j], lambda y, k: y - k + 1))) FROM (
  SELECT d.id, d.i, list_prepend(CAST(d.i + 1 AS BIGINT), list_transform(range(1, len(h) + 1), lambda k: least(prev[k + 1] + 1, prev[k] + CASE WHEN h[k] = r[d.i + 1] THEN 0 ELSE 1 END))) AS t FROM d JOIN p USING (id) WHERE d.i < len(r))),
 e AS (SELECT id, CAST(len(r) AS BIGINT) AS n, prev[len(h) + 1] AS wrong FROM d JOIN p USING (id) WHERE i = len(r))"""


def walk(rows: str) -> str:
    """``distance``, and w (id, step, i, j, op): the way back through the table; equal words first, then substitution, insertion, deletion. f has the diff and counts."""
    return distance(rows) + """, w AS (
 SELECT id, 0 AS step, len(r) AS i, len(h) AS j, '' AS op FROM p
 UNION ALL
 SELECT id, step + 1, CASE WHEN o IN ('M', 'S', 'D') THEN i - 1 ELSE i END, CASE WHEN o IN ('M', 'S', 'I') THEN j - 1 ELSE j END, o FROM (
  SELECT w.id, w.step, w.i, w.j, CASE WHEN w.i > 0 AND w.j > 0 AND r[w.i] = h[w.j] THEN 'M' WHEN w.i > 0 AND w.j > 0 AND up.prev[w.j] + 1 = d.prev[w.j + 1] THEN 'S'
   WHEN w.j > 0 AND (w.i = 0 OR d.prev[w.j] + 1 = d.prev[w.j + 1]) THEN 'I' ELSE 'D' END AS o
  FROM w JOIN p USING (id) JOIN d ON d.id = w.id AND d.i = w.i LEFT JOIN d up ON up.id = w.id AND up.i = w.i - 1 WHERE w.i > 0 OR w.j > 0)),
 g AS (SELECT w.id, step, i, j, op, CASE WHEN op IN ('M', 'S', 'D') THEN r[i + 1] END AS rw, CASE WHEN op IN ('S', 'I') THEN h[j + 1] END AS hw,
  sum(CASE WHEN op = 'M' THEN 1 ELSE 0 END) OVER (PARTITION BY w.id ORDER BY step DESC) AS gap FROM w JOIN p USING (id) WHERE op <> ''),
 pieces AS (SELECT id, gap, 0 AS kind, rw AS piece FROM g WHERE op = 'M' UNION ALL
  SELECT id, gap, 1, '(' || coalesce(string_agg(rw, ' ' ORDER BY step DESC), '*') || '->' || coalesce(string_agg(hw, ' ' ORDER BY step DESC), '*') || ')' FROM g WHERE op <> 'M' GROUP BY id, gap),
 shown AS (SELECT id, string_agg(piece, ' ' ORDER BY gap, kind) AS diff FROM pieces GROUP BY id),
 f AS (SELECT p.id, CAST(len(r) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE op = 'M') AS BIGINT) AS cor, CAST(count(*) FILTER (WHERE op = 'I') AS BIGINT) AS ins, CAST(count(*) FILTER (WHERE op = 'D') AS BIGINT) AS del, CAST(count(*) FILTER (WHERE op = 'S') AS BIGINT) AS sub,
  CAST(count(*) FILTER (WHERE op IN ('I', 'D', 'S')) AS BIGINT) AS wrong, any_value(array_to_string(r, ' ')) AS reference, any_value(array_to_string(h, ' ')) AS hypothesis, coalesce(string_agg(i || '-' || j, ' ' ORDER BY step DESC) FILTER (WHERE op = 'M'), '') AS path
  FROM p LEFT JOIN g USING (id) GROUP BY p.id, len(r))"""


CORPUS = "CAST(sum(n) AS BIGINT) AS n, CAST(sum(wrong) AS BIGINT) AS wrong, count(*) AS sentences, CAST(sum(CASE WHEN wrong > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wrong_sentences, round(sum(wrong) * 100.0 / sum(n), 2)::DOUBLE AS rate, round(sum(CASE WHEN wrong > 0 THEN 1 ELSE 0 END) * 100.0 / count(*), 2)::DOUBLE AS sentence_rate"
PERCENT = "CASE WHEN n > 0 THEN printf('%.2f', {} * 100.0::DOUBLE / n) END"


def basic(x: str) -> str:
    return squeeze(sub(sub(sub(f"lower({x})", r"[<\[][^>\]]*[>\]]", ""), r"\([^)]+\)", ""), r"[\p{M}\p{S}\p{P}]", " "))


NORMAL = f"(SELECT id, list_filter(string_split({basic("array_to_string(r, ' ') || '. (Aside) [x] A-b!'")}, ' '), lambda x: x <> '') AS r, list_filter(string_split({basic("array_to_string(h, ' ') || ' a b'")}, ' '), lambda x: x <> '') AS h FROM {FILES})"

# one step per word of a segment and attempt: a word that doesn't fit closes the chunk and is tried once more
CHUNKS = f"""WITH RECURSIVE x AS MATERIALIZED (SELECT s.case_id, s.seg_no, s.start_ms AS s, s.end_ms AS e, w.start_ms AS a, w.end_ms AS b, w.word, row_number() OVER (PARTITION BY s.case_id, s.seg_no ORDER BY w.start_ms, w.word_no) AS k
  FROM {SEGMENTS} s JOIN {WORDS} w ON s.case_id = w.case_id AND w.end_ms > s.start_ms AND w.start_ms < s.end_ms),
 c AS (SELECT DISTINCT case_id, seg_no, 1 AS k, s AS cs, s AS ce, CAST(NULL AS VARCHAR) AS held, 0 AS chunk_no, CAST(NULL AS BIGINT) AS out_start, CAST(NULL AS BIGINT) AS out_end, CAST(NULL AS VARCHAR) AS out_text, false AS done FROM x
 UNION ALL
 SELECT case_id, seg_no, CASE WHEN move IN ('skip', 'take') THEN k + 1 ELSE k END, CASE WHEN move = 'close' THEN ce ELSE cs END, CASE WHEN move = 'take' THEN b ELSE ce END,
  CASE move WHEN 'close' THEN NULL WHEN 'take' THEN concat_ws(' ', held, word) ELSE held END, CASE WHEN move = 'close' THEN chunk_no + 1 ELSE chunk_no END,
  CASE WHEN move = 'close' THEN cs END, CASE WHEN move = 'close' THEN ce END, CASE WHEN move = 'close' THEN held END, move = 'stop' FROM (
   SELECT c.*, x.b, x.word, CASE WHEN (x.k IS NULL OR x.a >= x.e) AND held IS NULL THEN 'stop' WHEN held IS NULL AND c.cs >= x.e THEN 'stop' WHEN x.k IS NULL OR x.a >= x.e THEN 'close' WHEN x.a < c.cs THEN 'skip'
    WHEN x.b - c.cs <= 30000 THEN 'take' WHEN held IS NULL THEN 'stop' ELSE 'close' END AS move
   FROM c LEFT JOIN x ON x.case_id = c.case_id AND x.seg_no = c.seg_no AND x.k = c.k WHERE NOT done)),
 made AS (SELECT case_id, seg_no, chunk_no - 1 AS chunk_no, out_start AS start_ms, out_end AS end_ms, out_text AS text FROM c WHERE out_text IS NOT NULL)"""
CHUNK_NAME = "case_id || '_' || {0} || '_' || chunk_no || '_' || substr(md5(case_id || '|' || {0} || '|' || chunk_no || '|' || text), 1, 8) || '.wav'"
SPOKEN = f"(SELECT s.case_id, s.seg_no, min(d.dialogue_no) AS dialogue_no FROM {SEGMENTS} s JOIN (SELECT case_id, dialogue_no, lower(arg_min(dialogue, turn_id)) AS d FROM spk_dialg_json WHERE dialogue IS NOT NULL GROUP BY case_id, dialogue_no) d ON s.case_id = d.case_id AND contains(d.d, s.text) GROUP BY ALL)"
LENGTHS = r"list_transform(list_filter(regexp_split_to_array(lower(coalesce(transcription, '')), '\s+'), lambda x: x <> ''), lambda x: len(x))"
ASIDE = "transcription || ' (aside) [x] <y> A-b!'"
MEMBERS = "(SELECT row_id, speaker, CASE WHEN n < 5 THEN 'train' WHEN k <= ceil(n * 0.1) THEN 'test' WHEN k <= ceil(n * 0.1) + ceil((n - ceil(n * 0.1)) * (CAST(0.2 AS DOUBLE) / (CAST(0.7 AS DOUBLE) + CAST(0.2 AS DOUBLE)))) THEN 'validation' ELSE 'train' END AS split FROM (SELECT row_id, speaker, count(*) OVER (PARTITION BY speaker) AS n, row_number() OVER (PARTITION BY speaker ORDER BY md5(CAST(row_id AS VARCHAR))) AS k FROM train))"

REPAIRED = f"replace({sub('t', r'(\b\d+)\s+((?:st|nd|rd|th)\b)', r'\1\2', 'gi')}, '.''', '')"

SQL: dict[str, str] = {
    "contractions": of_text(contractions("t")),
    "fillers": of_text(fillers("t")),
    "ascii_fold": r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7f]', '', 'g') AS text FROM (SELECT doc_id, replace(text, '…', '...') AS text FROM documents)",
    "percent_words": of_text(percent("t")),
    "citations": of_text(citations("t")),
    "placeholders": of_text(placeholders("t")),
    "punctuation": of_text(punctuation("t")),
    "ordinals": of_text(REPAIRED),
    "clean_text": of_text(clean("t")),
    "basic_normal": f"SELECT row_id, {basic(ASIDE)} AS text FROM train WHERE transcription IS NOT NULL",
    "speakers": r"SELECT turn_id, upper(trim(regexp_replace(real_speaker, '\d+', '', 'g'))) AS speaker, regexp_replace(coalesce(list_filter(regexp_split_to_array(trim(real_speaker), '\s+'), lambda p: length(p) >= 3 AND right(p, 1) <> '.')[-1], 'Unknown'), '[^a-zA-Z0-9]', '_', 'g') AS folder FROM spk_dialg_json WHERE real_speaker IS NOT NULL",
    "line_kinds": f"SELECT {BOILER} AS boilerplate, {CLOCK} AS clock, {SPEAKER} AS speaker, count(*) AS n FROM {LINES} GROUP BY ALL",
    "dialogue_turns": rf"""WITH l AS (SELECT case_id, page, line_no, line FROM (SELECT case_id, page, line_no, trim(regexp_replace(trim(line), '^\d+\s+', '')) AS line FROM {LINES} WHERE NOT {CLOCK}) WHERE line <> '' AND NOT {BOILER}),
 o AS (SELECT *, CASE WHEN {SPEAKER} THEN 1 ELSE 0 END AS opens FROM l),
 t AS (SELECT *, sum(opens) OVER (PARTITION BY case_id ORDER BY page, line_no) AS turn FROM o),
 g AS (SELECT case_id, turn, max(CASE WHEN opens = 1 THEN trim(regexp_replace(split_part(line, ':', 1), '\d+', '', 'g')) END) AS real_speaker,
  string_agg(part, ' ' ORDER BY page, line_no) FILTER (WHERE part <> '') AS raw FROM (SELECT *, CASE WHEN opens = 1 THEN trim(substr(line, strpos(line, ':') + 1)) ELSE line END AS part FROM t WHERE turn > 0) GROUP BY ALL),
 c AS (SELECT case_id, turn, upper(real_speaker) AS real_speaker, {clean("raw")} AS dialogue FROM g WHERE raw IS NOT NULL AND NOT {BOILER.replace("line", "raw")})
 SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY turn) AS INTEGER) AS dialogue_no, real_speaker, dialogue FROM c WHERE dialogue NOT IN ('unclear', 'inaudible')""",
    "manifest": "SELECT 'audio/' || case_id || '.wav' AS audio_filepath, string_agg(d, ' | ' ORDER BY dialogue_no) AS text FROM (SELECT case_id, dialogue_no, arg_min(dialogue, turn_id) AS d FROM spk_dialg_json WHERE dialogue IS NOT NULL GROUP BY ALL) GROUP BY case_id",
    "catalog_keys": "SELECT case_id, concat_ws('_', case_id, strftime(hearing_date, '%Y_%m_%d')) AS file_key, CASE WHEN contains(l, 'dropbox.com') THEN replace(replace(l, 'dl=0', 'raw=1'), 'dl=1', 'raw=1') ELSE l END AS link FROM (SELECT *, CASE WHEN length(case_id) % 2 = 0 THEN mp3_format_link || '?at=www.dropbox.com&dl=0' ELSE mp3_format_link || '?dl=0' END AS l FROM case_catalog WHERE mp3_format_link IS NOT NULL)",
    "catalog_counts": "SELECT count(*) AS n_cases, count(transcript_link) AS n_transcripts, count(mp3_format_link) AS n_recordings FROM case_catalog",
    "ctm_segments": f"SELECT segment_id, start_ms, end_ms, replace(transcript, '<space>', ' ') AS text FROM {CTM}",
    "ctm_words": f"SELECT segment_id, start_ms, end_ms, replace(transcript, ' ', '<space>') AS word FROM {CTM}",
    "segment_words": f"SELECT s.case_id, s.seg_no, count(*) AS n_words, CAST(sum(w.word_no) AS BIGINT) AS sum_word_no, min(w.start_ms) AS first_ms, max(w.end_ms) AS last_ms FROM {SEGMENTS} s JOIN {WORDS} w ON s.case_id = w.case_id AND w.end_ms > s.start_ms AND w.start_ms < s.end_ms GROUP BY ALL",
    "segment_speaker": f"SELECT * FROM {SPOKEN}",
    "vad_timeline": f"SELECT case_id, seg_no, CAST(e - (end_ms - start_ms) AS BIGINT) AS new_start_ms, CAST(e AS BIGINT) AS new_end_ms FROM (SELECT *, sum(end_ms - start_ms) OVER (PARTITION BY case_id ORDER BY seg_no) AS e FROM {SEGMENTS})",
    "speech_length": f"SELECT case_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, max(end_ms) AS whole_ms FROM {SEGMENTS} GROUP BY case_id",
    "split_members": f"SELECT * FROM {MEMBERS}",
    "split_counts": f"SELECT speaker, split, count(*) AS n FROM {MEMBERS} GROUP BY ALL",
    "wer_distance": f"{distance(SCORED)} SELECT id, n, wrong FROM e",
    "wer_filter": f"{distance(SCORED)} SELECT id FROM e WHERE n > 0 AND wrong <= n",
    "corpus_wer": f"{distance(FILES)} SELECT {CORPUS} FROM e",
    "corpus_cer": f"SELECT CAST(sum(len(r)) AS BIGINT) AS n, CAST(sum(levenshtein(r, h)) AS BIGINT) AS wrong, round(sum(levenshtein(r, h)) * 100.0 / sum(len(r)), 2)::DOUBLE AS rate FROM (SELECT array_to_string(r, ' ') AS r, array_to_string(h, ' ') AS h FROM {FILES})",
    "lookup_last": f"SELECT {STEM} AS id, min(row_id) AS row_id, arg_max(struct_pack(t := transcription, l := length), row_id).t AS transcription, arg_max(struct_pack(t := transcription, l := length), row_id).l AS length FROM test WHERE audio_path IS NOT NULL GROUP BY 1",
    "test_files": f"SELECT DISTINCT {NAME} AS name FROM train WHERE audio_path IS NOT NULL AND {NAME} IN (SELECT {NAME} FROM test WHERE audio_path IS NOT NULL)",
    "pending_files": "SELECT DISTINCT case_id || '_' || seg_no AS name FROM segment_ctm EXCEPT SELECT case_id || '_' || seg_no FROM segment_ctm WHERE segment_id % 3 = 0",
    "mixed_train": f"SELECT row_id, prompt, CAST(len(x) AS BIGINT) AS n_labels FROM (SELECT row_id, prompt, {LENGTHS} AS x FROM (SELECT row_id, 'indo' AS prompt, transcription FROM train UNION ALL SELECT row_id, 'dra', transcription FROM validation)) WHERE len(x) > 0 AND len(x) < 448",
    "eval_limit": "SELECT row_id FROM test ORDER BY md5(CAST(row_id AS VARCHAR)) LIMIT 50",
    "collate_labels": f"WITH v AS (SELECT row_id, {LENGTHS} AS x FROM validation), m AS (SELECT max(len(x)) AS width FROM v) SELECT row_id, array_to_string(list_transform(range(width), lambda i: CASE WHEN i < 2 OR i >= len(x) THEN -100 ELSE x[i + 1] END), ',') AS labels, array_to_string(list_transform(range(width), lambda i: CASE WHEN i = 0 THEN 1 WHEN i > len(x) THEN 0 ELSE x[i] END), ',') AS inputs, CAST(len(x) AS BIGINT) AS attended FROM v, m",
    "embedding_cosine": "SELECT a.vec_id, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "weighted_score": "SELECT label, round(sum(w * m) / sum(w), 6) AS score, count(*) AS n FROM (SELECT label, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS w, (vec_id % 7) / 7.0::DOUBLE AS m FROM embeddings) GROUP BY label",
    "mean_vector": "SELECT label, CAST(p AS INTEGER) AS position, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS p, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL",
    "mean_scores": "SELECT lang, count(*) AS n_samples, avg(n_chars % 100) AS mean_bert_score, avg(doc_id % 10) AS mean_sema_score FROM documents GROUP BY lang",
    "speaker_files": f"SELECT speaker, count(DISTINCT {STEM}) AS n_files, string_agg(DISTINCT {STEM}, '|' ORDER BY {STEM}) AS files FROM test WHERE speaker IS NOT NULL AND audio_path IS NOT NULL GROUP BY speaker",
    "ordinal_repairs": f"SELECT count(*) AS n_dialogues, CAST(sum(CASE WHEN {REPAIRED} <> t THEN 1 ELSE 0 END) AS BIGINT) AS n_modified FROM {BASE}",
    "row_numbers": "SELECT row_id, row_number() OVER (ORDER BY coalesce(length, 0.0), row_id) - 1 AS idx FROM test",
    "train_files": f"SELECT {STEM} AS id, count(*) AS n, CAST(sum(CAST(round(length * 100) AS BIGINT)) AS BIGINT) AS cs FROM train WHERE audio_path IS NOT NULL AND length > 0 GROUP BY 1",
    "numbered_cases": "SELECT case_id AS was, 'case' || row_number() OVER (ORDER BY hearing_date NULLS FIRST, case_id) AS case_id FROM case_catalog",
    "corpus_wer_normal": f"{distance(NORMAL)} SELECT {CORPUS} FROM e",
    "corpus_counts": f"{walk(FILES)} SELECT CAST(sum(cor) AS BIGINT) AS cor, CAST(sum(ins) AS BIGINT) AS ins, CAST(sum(del) AS BIGINT) AS del, CAST(sum(sub) AS BIGINT) AS sub, {CORPUS} FROM f",
    "alignment_detail": f"{walk(SCORED)} SELECT f.id, n, cor, ins, del, sub, wrong, {PERCENT.format('cor')} AS corr, {PERCENT.format('wrong')} AS wer, reference, hypothesis, path, coalesce(diff, '') AS diff FROM f LEFT JOIN shown USING (id)",
    "report_lines": f"""{walk(FILES)}, t AS (SELECT f.id, n, cor, ins, del, sub, {PERCENT.format('cor')} AS corr, {PERCENT.format('wrong')} AS wer, reference, hypothesis, coalesce(diff, '') AS diff FROM f LEFT JOIN shown USING (id))
 SELECT unnest([id || '(nwords=' || n || ',cor=' || cor || ',ins=' || ins || ',del=' || del || ',sub=' || sub || ') corr:' || coalesce(corr || '%', '-') || ',wer:' || coalesce(wer || '%', '-'), 'ref:' || chr(9) || reference, 'hyp:' || chr(9) || hypothesis, 'diff:' || chr(9) || diff]) AS value FROM t""",
    "chunks": f"{CHUNKS} SELECT case_id, seg_no, chunk_no, start_ms, end_ms, text, round((end_ms - start_ms) / 1000.0::DOUBLE, 2) AS length, {CHUNK_NAME.format('seg_no')} AS file_name FROM made",
    "corpus_chunks": f"""{CHUNKS} SELECT made.case_id, dialogue_no, seg_no, chunk_no, start_ms, end_ms, text, real_speaker, {CHUNK_NAME.format('dialogue_no').replace("case_id", "made.case_id")} AS file_name FROM made JOIN {SPOKEN} AS sp USING (case_id, seg_no)
 JOIN (SELECT case_id, dialogue_no, arg_min(struct_pack(s := real_speaker), turn_id).s AS real_speaker FROM spk_dialg_json WHERE dialogue IS NOT NULL GROUP BY ALL) AS t USING (case_id, dialogue_no) WHERE made.case_id IN (SELECT case_id FROM case_catalog WHERE mp3_format_link IS NOT NULL)""",
    "texts_of_files": f"SELECT {STEM} AS id, arg_max(struct_pack(t := transcription), row_id).t AS transcription FROM test WHERE audio_path IS NOT NULL GROUP BY 1",
    "embedded_tokens": "SELECT id, array_to_string(x, ' ') AS pieces, CAST(len(x) AS INTEGER) AS n_vectors FROM (SELECT id, flatten(list_transform(w, lambda t: list_transform(range(0, len(t), 5), lambda k: CASE WHEN k > 0 THEN '##' ELSE '' END || substr(t, k + 1, 5)))) AS x FROM (SELECT row_id AS id, list_filter(regexp_split_to_array(transcription, '\\s+'), lambda x: x <> '') AS w FROM validation WHERE transcription IS NOT NULL))",
}
