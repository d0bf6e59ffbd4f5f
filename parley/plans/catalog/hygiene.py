"""Transcript hygiene over segments made of document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import hygiene as hy
from parley.plans.catalog.base import cte, query

_S = cte("segments") + ", "
_WORDS = (
    "words AS (SELECT call_id, seq, CAST(unnest(range(len(w))) AS INT) AS i, unnest(w) AS token FROM "
    "(SELECT call_id, seq, regexp_extract_all(text, '[^\\s]+') AS w FROM segments WHERE text IS NOT NULL)), "
    "norms AS (SELECT call_id, seq, i, token, lower(translate(regexp_replace(regexp_replace(token, "
    "'^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g'), '[ً-ْـ]', '', 'g'), 'أإآٱى', 'ااااي')) AS norm FROM words)"
)
_RUNS = (
    "flagged AS (SELECT *, CASE WHEN norm = lag(norm) OVER w THEN 0 ELSE 1 END AS cut FROM norms WINDOW w AS (PARTITION BY call_id, seq ORDER BY i)), "
    "islands AS (SELECT *, sum(cut) OVER (PARTITION BY call_id, seq ORDER BY i) AS island FROM flagged), "
    "runs AS MATERIALIZED (SELECT call_id, seq, island, min(i) AS at, arg_min(token, i) AS token, any_value(norm) AS norm, count(*) AS run "
    "FROM islands WHERE norm <> '' GROUP BY call_id, seq, island HAVING count(*) >= 6)"
)
# Matches of the removed families, in an expression language without look-around:
# the neighbour is consumed instead, which is the same here as matches never touch.
_CHAIN = "(?:https?\\s*:\\s*//\\s*)?[A-Za-z0-9_\\-]+(?:\\s*\\.\\s*[A-Za-z0-9_\\-]+){2,}(?:\\s*/\\s*[^\\s،؛!?]*)?"
_CREDIT = "التفريغ\\s*(?:و|وال)?\\s*التدقيق(?:\\s*(?:من|بواسط[ةه]|اعداد)\\s*)?\\s+قص[يى]\\s+البيات[يى]"
_DOMAIN = (
    "(?i)(?:موقع\\s+الدراس[ةه]\\s+الجزائر[يى]\\s*[:：\\-–—]?\\s*)?(?:https?\\s*:\\s*//\\s*)?(?:www\\s*\\.\\s*)?eddirasa\\s*\\.\\s*com"
    "(?:\\s*\\.\\s*[a-z]{2,3})*(?:\\s*/\\s*[^\\s،؛!?]*)?"
)
_BLANK_MARK = "@{3,}\\s*فراغ"


def _find(pid: str, pattern: str) -> str:
    return (
        f"SELECT call_id, seq, '{pid}' AS pid, unnest(regexp_extract_all(text, '{pattern}')) AS hit, "
        f"unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS k, string_split_regex(text, '{pattern}') AS rest, "
        f"regexp_extract_all(text, '{pattern}') AS hits FROM segments WHERE text IS NOT NULL"
    )


_SPANS = (
    "raw_hits AS (" + " UNION ALL ".join(
        _find(p, rx) for p, rx in (
            ("url_garbage_v1", _CHAIN), ("qusay_credit_v1", _CREDIT), ("eddirasa_domain_v1", _DOMAIN), ("atsign_blank_v1", _BLANK_MARK),
        )
    ) + "), "
    # a match starts after the k+1 pieces and k matches before it
    "located AS (SELECT call_id, seq, pid, hit, CAST(list_sum(list_transform(rest[1:k + 1], lambda x: length(x))) + "
    "coalesce(list_sum(list_transform(hits[1:k], lambda x: length(x))), 0) AS INT) AS s, "
    "lower(regexp_replace(hit, '\\s+', '', 'g')) AS flat FROM raw_hits), "
    "spans AS (SELECT call_id, seq, pid, s, CAST(s + length(hit) AS INT) AS e FROM located WHERE pid <> 'url_garbage_v1' OR "
    "((contains(flat, 'eddirasa') OR contains(flat, 'fontsalon')) AND contains(flat, '.')) OR "
    "(length(flat) - length(replace(flat, '.', '')) >= 5 AND length(flat) >= 25) OR "
    "(length(flat) - length(replace(flat, '.', '')) >= 3 AND len(list_filter(list_distinct(string_split_regex(flat, '[./:]+')), "
    "lambda a: length(a) BETWEEN 2 AND 4 AND len(list_filter(string_split_regex(flat, '[./:]+'), lambda b: b = a)) >= 3)) > 0))"
)
_WHERE = (
    # only segments with a hard run; words and blanks are laid out in one unnest, so nothing is joined by place
    "hard AS MATERIALIZED (SELECT r.call_id, r.seq, r.at AS first, r.run FROM runs r WHERE r.run >= 16), "
    "laid AS (SELECT call_id, seq, unnest(g) AS blank, unnest(w) AS token, unnest(range(len(w))) AS i FROM "
    "(SELECT call_id, seq, string_split_regex(text, '[^\\s]+') AS g, regexp_extract_all(text, '[^\\s]+') AS w FROM segments "
    "WHERE text IS NOT NULL AND (call_id, seq) IN (SELECT call_id, seq FROM hard))), "
    "begins AS MATERIALIZED (SELECT call_id, seq, i, length(token) AS n, sum(length(blank) + length(token)) "
    "OVER (PARTITION BY call_id, seq ORDER BY i) - length(token) AS s FROM laid WHERE token IS NOT NULL), "
    "loops AS (SELECT r.call_id, r.seq, 'hard_token_run_' || r.run AS pid, CAST(b.s AS INT) AS s, CAST(l.s + l.n AS INT) AS e "
    "FROM hard r JOIN begins b ON b.call_id = r.call_id AND b.seq = r.seq AND b.i = r.first + 3 "
    "JOIN begins l ON l.call_id = r.call_id AND l.seq = r.seq AND l.i = r.first + r.run - 1)"
)
_MERGED = (
    "every AS (SELECT * FROM spans UNION ALL SELECT * FROM loops), "
    "reach AS (SELECT v.*, t.text, max(e) OVER (PARTITION BY v.call_id, v.seq ORDER BY s, e, pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far "
    "FROM every v JOIN segments t USING (call_id, seq)), "
    "cuts AS (SELECT *, CASE WHEN far IS NOT NULL AND (s <= far OR trim(substr(text, CAST(far + 1 AS INT), CAST(s - far AS INT))) = '') THEN 0 ELSE 1 END AS cut FROM reach), "
    "grp AS (SELECT *, sum(cut) OVER (PARTITION BY call_id, seq ORDER BY s, e, pid ROWS UNBOUNDED PRECEDING) AS g FROM cuts), "
    "ops AS (SELECT call_id, seq, g, CAST(min(s) AS INT) AS raw_start, CAST(max(e) AS INT) AS raw_end, any_value(text) AS text, "
    "array_to_string(list_distinct(list(pid ORDER BY s, e, pid)), '+') AS pids, count(DISTINCT pid) AS n_pids FROM grp GROUP BY call_id, seq, g)"
)
_CLEAN = (
    "pieces AS (SELECT *, lag(raw_end, 1, 0) OVER (PARTITION BY call_id, seq ORDER BY g) AS from_, "
    "lead(g) OVER (PARTITION BY call_id, seq ORDER BY g) AS more FROM ops), "
    "built AS (SELECT call_id, seq, string_agg(substr(text, CAST(from_ + 1 AS INT), CAST(raw_start - from_ AS INT)) || '[[ASR_GAP]]' || "
    "CASE WHEN more IS NULL THEN substr(text, raw_end + 1) ELSE '' END, '' ORDER BY g) AS clean_text, count(*) AS n_ops FROM pieces GROUP BY call_id, seq), "
    "cleaned AS (SELECT s.call_id, s.seq, s.failed, s.seconds, coalesce(s.text, '') AS raw_text, coalesce(b.clean_text, s.text, '') AS clean_text, "
    "coalesce(b.n_ops, 0) AS n_ops FROM segments s LEFT JOIN built b USING (call_id, seq))"
)
_CHAINED = _S + ", ".join((_WORDS, _RUNS, _SPANS, _WHERE, _MERGED, _CLEAN))
_DIGITS = ", ".join(f"'{w}'" for w in hy.DIGIT_WORDS)
_NGRAMS = (
    "sized AS (SELECT call_id, seq, list(norm ORDER BY i) AS w FROM norms GROUP BY call_id, seq HAVING count(*) >= 20), "
    "grams AS (SELECT call_id, seq, z, p, array_to_string(w[p:p + z - 1], chr(1)) AS g FROM (SELECT call_id, seq, w, z, "
    "unnest(range(1, CAST(len(w) - z + 2 AS BIGINT))) AS p FROM sized, (VALUES (2), (3), (4), (5)) v(z))), "
    "often AS (SELECT *, count(*) OVER (PARTITION BY call_id, seq, z, g) AS n FROM grams), "
    "cover AS (SELECT DISTINCT call_id, seq, unnest(range(p, p + z)) AS p FROM often WHERE n >= 3), "
    "covered AS (SELECT call_id, seq, count(*) AS n FROM cover GROUP BY call_id, seq), "
    "fraction AS (SELECT s.call_id, s.seq, round_even(coalesce(c.n, 0) / CAST(len(s.w) AS DOUBLE), 3) AS ngram_fraction "
    "FROM sized s LEFT JOIN covered c USING (call_id, seq))"
)


@query("token_runs", _S + _WORDS + ", " + _RUNS + " SELECT call_id, seq, token, norm, run FROM runs")
def token_runs(t):
    df = hy.with_norms(t.segments).withColumn("text", F.coalesce("text", F.lit("")))
    runs = hy.token_runs(F.col("text"), F.col("norm"))
    return df.select("call_id", "seq", F.inline(runs)).select("call_id", "seq", "token", "norm", "run")


@query("contamination_spans", _S + _SPANS + " SELECT call_id, seq, pid, s, e FROM spans WHERE pid <> 'url_garbage_v1'")
def contamination_spans(t):
    return t.segments.select("call_id", "seq", F.inline(hy.contamination_spans(F.col("text")))).select("call_id", "seq", "pid", "s", "e")


@query("url_garbage", _S + _SPANS + " SELECT call_id, seq, s, e FROM spans WHERE pid = 'url_garbage_v1'")
def url_garbage(t):
    return t.segments.select("call_id", "seq", F.inline(hy.url_garbage(F.col("text")))).select("call_id", "seq", "s", "e")


@query("loop_truncation", _S + ", ".join((_WORDS, _RUNS, _WHERE)) + " SELECT call_id, seq, pid, s, e FROM loops")
def loop_truncation(t):
    df = hy.with_norms(t.segments).withColumn("text", F.coalesce("text", F.lit("")))
    spans = hy._loop_spans(hy.token_runs(F.col("text"), F.col("norm")))
    return df.select("call_id", "seq", F.inline(spans)).select("call_id", "seq", "pid", "s", "e")


@query("clean_segments", _CHAINED + " SELECT call_id, seq, clean_text, n_ops FROM cleaned")
def clean_segments(t):
    return hy.clean_segments(t.segments).select("call_id", "seq", "clean_text", F.size("ops").alias("n_ops"))


@query("removal_ledger", _CHAINED + " SELECT call_id, seq, raw_start, raw_end, substr(text, raw_start + 1, raw_end - raw_start) AS removed_text, "
       "n_pids FROM ops")
def removal_ledger(t):
    ops = hy.clean_segments(t.segments).select("call_id", "seq", F.inline("ops"))
    return ops.select(
        "call_id", "seq", "raw_start", "raw_end", "removed_text",
        F.size(F.split("pattern_id", r"\+")).alias("n_pids"),
    )


@query("reconstruct_raw", _S[:-2] + " SELECT call_id, seq, coalesce(text, '') AS rebuilt FROM segments")
def reconstruct_raw(t):
    c = hy.clean_segments(t.segments)
    return c.select("call_id", "seq", hy.reconstruct_raw(F.col("clean_text"), F.col("ops")).alias("rebuilt"))


_FLAGS = (
    "names AS (SELECT call_id, seq, 'suspect_name' AS flag, unnest(regexp_extract_all(text, '(?:عبد\\s+الناصر\\s+عاشور|جواد\\s+الخفا[جح][يى])')) AS text "
    "FROM segments), warned AS (SELECT call_id, seq, 'token_run_6_15' AS flag, token AS text FROM runs WHERE run < 16 AND norm NOT IN ("
    + _DIGITS + ") AND NOT regexp_matches(norm, '^\\p{Nd}+$'))"
)


@query("tier2_flags", _S + ", ".join((_WORDS, _RUNS, _FLAGS)) + " SELECT * FROM names UNION ALL SELECT * FROM warned")
def tier2_flags(t):
    flags = hy.clean_segments(t.segments).select("call_id", "seq", F.inline("flags"))
    return flags.select("call_id", "seq", "flag", F.coalesce("text", "token").alias("text"))


@query("repeated_ngram_fraction", _S + _WORDS + ", " + _NGRAMS + " SELECT s.call_id, s.seq, coalesce(ngram_fraction, 0.0) AS ngram_fraction "
       "FROM segments s LEFT JOIN fraction USING (call_id, seq)")
def repeated_ngram_fraction(t):
    return hy.with_norms(t.segments).select(
        "call_id", "seq", hy.repeated_ngram_fraction(F.col("norm")).alias("ngram_fraction")
    )


_GATE = (
    "chunk AS (SELECT c.*, coalesce(f.ngram_fraction, 0) AS ngram, coalesce(h.hard, false) AS hard, coalesce(w.warn, 0) AS warn, "
    "coalesce(w.n, 0) + coalesce(m.n, 0) AS n_flags, coalesce(o.removed, 0) AS removed FROM cleaned c "
    "LEFT JOIN fraction f USING (call_id, seq) "
    "LEFT JOIN (SELECT call_id, seq, true AS hard FROM runs WHERE run >= 16 GROUP BY ALL) h USING (call_id, seq) "
    "LEFT JOIN (SELECT r.call_id, r.seq, max(r.run) AS warn, count(*) AS n FROM runs r WHERE run < 16 AND norm NOT IN (" + _DIGITS
    + ") AND NOT regexp_matches(norm, '^\\p{Nd}+$') GROUP BY ALL) w USING (call_id, seq) "
    "LEFT JOIN (SELECT call_id, seq, count(*) AS n FROM names GROUP BY ALL) m USING (call_id, seq) "
    "LEFT JOIN (SELECT call_id, seq, sum(raw_end - raw_start) AS removed FROM ops WHERE NOT contains(pids, 'hard_token_run') GROUP BY ALL) o USING (call_id, seq)), "
    "call AS (SELECT call_id, count(*) AS chunks_total, count(*) FILTER (WHERE failed) AS chunks_failed, "
    "count(*) FILTER (WHERE NOT failed AND raw_text = '') AS chunks_empty, round_even(sum(seconds), 2) AS duration, "
    "length(trim(coalesce(string_agg(raw_text, ' ' ORDER BY seq) FILTER (WHERE raw_text <> ''), ''), ' ')) AS chars, "
    "length(replace(trim(coalesce(string_agg(clean_text, ' ' ORDER BY seq) FILTER (WHERE clean_text <> ''), ''), ' '), '[[ASR_GAP]]', '')) AS clean_chars "
    "FROM chunk GROUP BY call_id), "
    "dens AS (SELECT *, CASE WHEN duration > 0 THEN chars / CAST(duration AS DOUBLE) ELSE 0 END AS density FROM call), "
    "judged AS (SELECT k.*, d.duration, d.density, (failed OR hard OR (warn > 0 AND (ngram >= 0.45 OR density > 22))) AS invalid "
    "FROM chunk k JOIN dens d USING (call_id)), "
    "valid_before AS (SELECT *, sum(CASE WHEN invalid THEN 0 ELSE 1 END) OVER (PARTITION BY call_id ORDER BY seq) AS isle FROM judged), "
    "longest AS (SELECT call_id, max(n) AS longest FROM (SELECT call_id, isle, sum(seconds) AS n FROM valid_before WHERE invalid GROUP BY ALL) GROUP BY 1), "
    "totals AS (SELECT call_id, coalesce(sum(seconds) FILTER (WHERE invalid), 0) AS invalid_s, CAST(sum(removed) AS INT) AS tier1, bool_or(n_ops > 0) AS any_op, "
    "bool_or(n_flags > 0) AS any_flag, bool_or(warn > 0 AND NOT invalid) AS warn_only, bool_or(hard) AS any_hard FROM judged GROUP BY 1), "
    "gate AS (SELECT d.*, t.*, coalesce(l.longest, 0) AS longest, CASE WHEN clean_chars < 20 OR (duration > 0 AND invalid_s > 0.2::DOUBLE * duration) "
    "OR coalesce(l.longest, 0) >= 60 OR (tier1 >= 40 AND chars > 0 AND tier1 >= 0.25 * chars) THEN 'red' "
    "WHEN invalid_s > 0 OR warn_only OR any_op OR any_flag OR (duration >= 30 AND density < 3) OR chunks_empty > 0 OR (density > 22 AND NOT any_hard) "
    "THEN 'amber' ELSE 'green' END AS status FROM dens d JOIN totals t USING (call_id) LEFT JOIN longest l USING (call_id))"
)
_GATED = _CHAINED + ", " + ", ".join((_FLAGS, _NGRAMS, _GATE))


@query(
    "assess_calls",
    _GATED + " SELECT call_id, chunks_total, chunks_failed, chunks_empty, CAST(duration AS DOUBLE) AS duration, chars, clean_chars, "
    "round_even(density, 2) AS chars_per_audio_sec, round_even((chunks_total - chunks_failed) / CAST(chunks_total AS DOUBLE), 2) AS confidence, "
    "round_even(invalid_s, 2) AS invalid_seconds, "
    "round_even(longest, 2) AS longest_invalid_span_seconds, tier1 AS tier1_chars_removed, status FROM gate",
)
def assess_calls(t):
    return hy.assess_calls(hy.clean_segments(t.segments, False)).select(
        "call_id", "chunks_total", "chunks_failed", "chunks_empty", "duration", "chars", "clean_chars",
        "chars_per_audio_sec", "confidence", "invalid_seconds", "longest_invalid_span_seconds", "tier1_chars_removed", "status",
    )


@query("longest_invalid_span", _GATED + " SELECT call_id, round_even(longest, 2) AS longest FROM longest")
def longest_invalid_span(t):
    return hy.assess_calls(hy.clean_segments(t.segments, False)).where("invalid_seconds > 0").select(
        "call_id", F.col("longest_invalid_span_seconds").alias("longest")
    )


@query("gate_red_to_dead_letter", _GATED + " SELECT call_id, 'dead_letter' AS job_status FROM gate WHERE status = 'red'")
def gate_red_to_dead_letter(t):
    return hy.gate_red(hy.assess_calls(hy.clean_segments(t.segments, False))).select("call_id", "job_status")


_EXACT = (
    "tok AS (SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY seq, i) AS p, token FROM words), "
    "fl AS (SELECT *, CASE WHEN token = lag(token) OVER w THEN 0 ELSE 1 END AS cut FROM tok WINDOW w AS (PARTITION BY call_id ORDER BY p)), "
    "il AS (SELECT *, sum(cut) OVER (PARTITION BY call_id ORDER BY p) AS isle FROM fl), "
    "best AS (SELECT call_id, max(n) AS run FROM (SELECT call_id, isle, count(*) AS n FROM il GROUP BY ALL) GROUP BY 1)"
)


@query(
    "asr_health",
    _S + _WORDS + ", " + _EXACT + ", c AS (SELECT call_id, count(*) AS chunks_total, count(*) FILTER (WHERE failed) AS chunks_failed FROM segments GROUP BY 1) "
    "SELECT c.call_id, chunks_total, chunks_failed, round_even((chunks_total - chunks_failed) / CAST(chunks_total AS DOUBLE), 2) AS confidence, "
    "CAST(coalesce(run, 0) AS INT) AS max_token_run, coalesce(run, 0) >= 6 AS repetition_suspect FROM c LEFT JOIN best USING (call_id)",
)
def asr_health(t):
    return hy.asr_health(hy.clean_segments(t.segments, False)).select(
        "call_id", "chunks_total", "chunks_failed", "confidence", "max_token_run", "repetition_suspect"
    )
