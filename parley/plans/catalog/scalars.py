"""Scalar rules over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import clock, phone
from parley.functions import payload as P
from parley.functions import text as T
from parley.operators import calls as ca
from parley.operators import rollups as ro
from parley.operators import scoring as sc
from parley.plans import binding
from parley.plans.catalog.base import cte, query
from parley.plans.catalog.judgement_sql import LEVEL_SQL, SCORES_SQL
from parley.sources import payloads as pl

_REGION_SQL = (
    "r AS (SELECT row_id, raw, upper(region) AS region, regexp_replace(raw, '[^\\p{Nd}+]', '', 'g') AS k0 FROM phones), "
    "n AS (SELECT *, CASE WHEN k0 LIKE '00%' THEN '+' || substr(k0, 3) ELSE k0 END AS k FROM r), "
    "g AS (SELECT n.*, v.cc, v.len, v.pre FROM n LEFT JOIN (VALUES ('SA','966',9,'5'), ('EG','20',10,'1'), "
    "('AE','971',9,'5'), ('KW','965',8,'5'), ('QA','974',8,'3')) v(reg, cc, len, pre) ON n.region = v.reg), "
    "e AS (SELECT *, CASE WHEN k IS NULL OR k = '' THEN NULL "
    "WHEN k LIKE '+%' THEN CASE WHEN length(k) - 1 BETWEEN 7 AND 15 AND substr(k, 2, 1) <> '0' THEN k END "
    "WHEN starts_with(k, cc) AND length(k) = length(cc) + len THEN '+' || k "
    "WHEN k LIKE '0%' AND length(k) = len + 1 THEN '+' || cc || substr(k, 2) "
    "WHEN length(k) = len AND starts_with(k, pre) THEN '+' || cc || k END AS e164 FROM g)"
)


@query(
    "normalize_phone",
    cte("phones") + ", " + _REGION_SQL + " SELECT row_id, e164, "
    "e164 IS NULL AND k IS NOT NULL AND k <> '' AS refused, "
    "e164 IS NULL OR regexp_matches(e164, '^\\+[1-9][0-9]{6,14}$') AS is_e164, "
    "raw IS NULL OR regexp_matches(raw, '^\\+[1-9][0-9]{6,14}$') AS raw_is_e164 FROM e",
)
def normalize_phone(t):
    p = F.col("p")
    return t.phones.select("row_id", "raw", phone.normalize_phone(F.col("raw"), F.col("region")).alias("p")).select(
        "row_id", p["e164"].alias("e164"), p["error"].isNotNull().alias("refused"),
        phone.is_e164(p["e164"]).alias("is_e164"), phone.is_e164(F.col("raw")).alias("raw_is_e164"),
    )


@query(
    "fold_name",
    "SELECT doc_id, trim(regexp_replace(lower(replace(strip_accents(text), 'ß', 'ss')), '\\s+', ' ', 'g'), ' ') AS folded "
    "FROM documents",
)
def fold_name(t):
    return t.scan("documents").select("doc_id", T.fold_name(F.col("text")).alias("folded"))


_AR = "translate(regexp_replace({0}, '[ً-ْـ]', '', 'g'), 'أإآٱىة', 'اااايه')"


@query(
    "fold_arabic",
    cte("messages") + " SELECT message_id, trim(regexp_replace(" + _AR.format("body || ' أُمَّة مدرسـة إلى '")
    + ", '\\s+', ' ', 'g')) AS folded FROM messages",
)
def fold_arabic(t):
    return t.messages.select(
        "message_id", T.fold_arabic(F.concat("body", F.lit(" أُمَّة مدرسـة إلى "))).alias("folded")
    )


@query(
    "norm_token",
    "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\s]+')) AS token FROM documents), "
    "n AS (SELECT token, lower(regexp_replace(token, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')) AS norm FROM w) "
    "SELECT norm, count(*) AS uses, count(DISTINCT token) AS spellings FROM n GROUP BY norm",
)
def norm_token(t):
    words = t.scan("documents").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    # one row per spelling before the shuffle that counts the normal forms
    spelled = words.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    return spelled.groupBy(T.norm_token(F.col("token")).alias("norm")).agg(
        F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("spellings")
    )


@query(
    "text_hash",
    cte("messages") + " SELECT message_id, sha256(body) AS body_hash, "
    "sha256('p1' || chr(0) || body || chr(0)) AS input_hash FROM messages",
)
def text_hash(t):
    return t.messages.select(
        "message_id", T.text_hash(F.col("body")).alias("body_hash"),
        T.input_hash(F.lit("p1"), F.col("body")).alias("input_hash"),
    )


@query(
    "map_channel",
    cte("payloads") + ", b AS (SELECT arrival_id, CASE arrival_id % 5 WHEN 0 THEN payload->'$.body' WHEN 1 THEN payload->'$[0]' "
    "ELSE payload::JSON END AS b FROM payloads), s AS (SELECT arrival_id, coalesce(b->>'$.deal_info.SOURCE_ID', b->>'$.channel', '') "
    "AS src FROM b) SELECT arrival_id, src, CASE upper(string_split(src, '|')[-1]) WHEN 'FACEBOOK' THEN 'facebook' "
    "WHEN 'INSTAGRAM' THEN 'instagram' WHEN 'WHATSAPP' THEN 'whatsapp' WHEN 'TELEGRAM' THEN 'telegram' "
    "WHEN 'LIVECHAT' THEN 'webchat' WHEN 'OPENLINE' THEN 'webchat' ELSE 'other' END AS channel FROM s",
)
def map_channel(t):
    rows = pl.first_element(t.payloads)
    body = F.coalesce(P.get(F.col("v"), "body"), F.col("v"))
    src = F.coalesce(P.get(F.col("b"), "deal_info.SOURCE_ID", "string"), P.get(F.col("b"), "channel", "string"), F.lit(""))
    return rows.select("arrival_id", body.alias("b")).select("arrival_id", src.alias("src")).select(
        "arrival_id", "src", P.map_channel(F.col("src")).alias("channel")
    )


@query(
    "map_role",
    "SELECT conv_id, turn, CASE WHEN lower(role) IN ('customer','client','user') THEN 'customer' "
    "WHEN role = 'bot' OR (conv_id + turn) % 4 = 0 THEN 'bot' "
    "WHEN lower(CASE role WHEN 'assistant' THEN 'Operator' ELSE role END) IN ('agent','operator','manager','employee') THEN 'agent' "
    "WHEN role = 'system' THEN 'system' ELSE 'unknown' END AS sender FROM conversations",
)
def map_role(t):
    said = F.when(F.col("role") == "assistant", " Operator ").otherwise(F.col("role"))
    return t.scan("conversations").select(
        "conv_id", "turn", P.map_role(said, (F.col("conv_id") + F.col("turn")) % 4 == 0).alias("sender")
    )


@query(
    "parse_ts",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 3 HOUR "
    "WHEN 2 THEN date_trunc('second', ts) END AS parsed, event_id % 4 = 3 AS unreadable FROM events",
)
def parse_ts(t):
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    written = (
        F.when(F.col("event_id") % 4 == 0, iso)
        .when(F.col("event_id") % 4 == 1, F.concat(F.replace(iso, F.lit(" "), F.lit("T")), F.lit("+03:00")))
        .when(F.col("event_id") % 4 == 2, F.concat(iso, F.lit("Z")))
        .otherwise(F.concat(F.lit("in "), F.col("event_id").cast("string"), F.lit(" days")))
    )
    return t.scan("events").select("event_id", clock.parse_ts(written).alias("parsed")).select(
        "event_id", "parsed", F.col("parsed").isNull().alias("unreadable")
    )


@query(
    "is_after_hours",
    cte("contacts") + " SELECT interaction_id, NOT (CAST(started_at + INTERVAL 3 HOUR AS TIME) BETWEEN TIME '09:00:00' "
    "AND TIME '21:00:00') AS after_hours, datediff('day', CAST(started_at AS DATE), DATE '2001-06-01') AS days_since, "
    "round_even(abs(epoch_us(started_at) - epoch_us(TIMESTAMP '2001-06-01')) / 3.6e9::DOUBLE, 2) AS hours_between FROM contacts",
)
def is_after_hours(t):
    at = F.col("started_at")
    return t.contacts.select(
        "interaction_id", clock.is_after_hours(at).alias("after_hours"),
        clock.days_since(t.as_of, at).alias("days_since"), clock.hours_between(at, t.as_of).alias("hours_between"),
    )


@query(
    "is_arabic",
    cte("messages") + ", l AS (SELECT message_id, regexp_replace(body, '[^\\p{L}]', '', 'g') AS s FROM messages) "
    "SELECT message_id, length(regexp_replace(s, '[^\\x{0600}-\\x{06FF}]', '', 'g')) * 2 > length(s) AS arabic FROM l",
)
def is_arabic(t):
    return t.messages.select("message_id", T.is_arabic(F.col("body")).alias("arabic"))


_FURNITURE = "(?m)^\\s*\\[\\d{1,2}:\\d{2}(?::\\d{2})?\\]\\s*(?:[A-Z_]{3,12}:)?\\s*"


@query(
    "spoken_content",
    "WITH s AS (SELECT conv_id, turn, '[00:0' || CAST(turn AS STRING) || '] AGENT: ' || "
    "CASE WHEN turn % 3 = 0 THEN 'short' ELSE text END AS x FROM conversations), "
    "c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(x, '" + _FURNITURE + "', '', 'g'), '\\s+', ' ', 'g')) AS spoken FROM s) "
    "SELECT conv_id, turn, spoken, length(spoken) < 20 AS refused FROM c",
)
def spoken_content(t):
    said = F.when(F.col("turn") % 3 == 0, "short").otherwise(F.col("text"))
    x = F.concat(F.lit("[00:0"), F.col("turn").cast("string"), F.lit("] AGENT: "), said)
    return t.scan("conversations").select(
        "conv_id", "turn", T.spoken_content(x).alias("spoken"), T.unscoreable_reason(x).isNotNull().alias("refused")
    )


@query(
    "performance_level",
    cte("judgements") + ", " + SCORES_SQL + " SELECT interaction_id, final_score, " + LEVEL_SQL + " AS level FROM scored",
)
def performance_level(t):
    return sc.final_scores(t.parsed).select("interaction_id", "final_score", F.col("performance_level").alias("level"))


@query(
    "confidence_bucket",
    cte("contacts", "transcripts") + " SELECT c.interaction_id, CASE WHEN coalesce(t.asr_confidence, 1) >= 1 THEN 6 "
    "ELSE CAST(floor(t.asr_confidence * 5) AS INT) + 1 END AS bucket FROM contacts c LEFT JOIN transcripts t USING (interaction_id)",
)
def confidence_bucket(t):
    # the transcript's own rule gives the confidence, so no join is needed here
    line = t.scan("lineitem").selectExpr(
        f"{binding.CONTACTS['interaction_id']} AS interaction_id",
        f"{binding.TRANSCRIPTS['asr_confidence']} AS asr_confidence",
    )
    return line.select("interaction_id", ro.confidence_bucket(F.col("asr_confidence")).alias("bucket"))


@query(
    "json_paths",
    cte("analyses") + " SELECT interaction_id, substr(payload->>'$.language', 1, 2) AS language, "
    "nullif(payload->>'$.commercial.buying_stage', '') AS stage, "
    "CAST(payload->>'$.real_ask.is_real_inquiry' AS BOOLEAN) AS is_real, "
    "TRY_CAST(payload->>'$.confidence' AS DOUBLE) AS confidence, "
    "CAST(json_array_length(payload, '$.trip.destinations') AS INT) AS n_legs, "
    "coalesce(CAST(payload->'$.uncertain_fields' AS VARCHAR), '[]') AS uncertain, "
    "json_array_length(payload, '$.commercial.objections') > 0 AS has_objections FROM analyses",
)
def json_paths(t):
    v = t.analyses.select("interaction_id", F.try_parse_json("payload").alias("v"))
    def get(path, kind="string"):
        return F.try_variant_get("v", path, kind)

    return v.select(
        "interaction_id", F.substring(get("$.language"), 1, 2).alias("language"),
        F.nullif(get("$.commercial.buying_stage"), F.lit("")).alias("stage"),
        get("$.real_ask.is_real_inquiry", "boolean").alias("is_real"),
        get("$.confidence", "double").alias("confidence"),
        F.size(get("$.trip.destinations", "array<variant>")).alias("n_legs"),
        F.coalesce(F.to_json(get("$.uncertain_fields", "variant")), F.lit("[]")).alias("uncertain"),
        (F.size(get("$.commercial.objections", "array<variant>")) > 0).alias("has_objections"),
    )


@query(
    "error_text",
    "SELECT doc_id, substr('asr: ' || text, 1, 500) AS last_error, "
    "lpad(CAST(n_chars // 60 AS STRING), CAST(greatest(2, length(CAST(n_chars // 60 AS STRING))) AS INT), '0') || ':' || "
    "lpad(CAST(n_chars % 60 AS STRING), 2, '0') AS at FROM documents",
)
def error_text(t):
    return t.scan("documents").select(
        "doc_id", T.error_text("asr: ", F.col("text")).alias("last_error"), T.mmss(F.col("n_chars")).alias("at")
    )


@query(
    "strip_code_fence",
    cte("judgements") + " SELECT interaction_id, CASE WHEN length(interaction_id) % 3 = 2 THEN NULL ELSE payload END AS body "
    "FROM judgements",
)
def strip_code_fence(t):
    n = F.length("interaction_id") % 3
    reply = (
        F.when(n == 0, F.concat(F.lit("```json\n"), "payload", F.lit("\n```")))
        .when(n == 1, F.concat(F.lit("  "), "payload", F.lit(" \n")))
        .otherwise(F.concat(F.lit("Sure! "), "payload"))
    )
    body = T.strip_code_fence(F.col("reply"))
    return t.judgements.select("interaction_id", reply.alias("reply")).select(
        "interaction_id", body.alias("body")
    ).select("interaction_id", F.when(T.is_json(F.col("body")), F.col("body")).alias("body"))


@query(
    "usable_transcript",
    cte("transcripts") + " SELECT interaction_id, asr_confidence FROM transcripts WHERE asr_confidence >= 0.7",
)
def usable_transcript(t):
    rows = t.transcripts.withColumns({"full_text": F.col("interaction_id"), "error": F.lit(None).cast("string")})
    return ca.usable_transcript(rows).select("interaction_id", "asr_confidence")


@query(
    "synthetic_deal_id",
    cte("deals") + " SELECT deal_id, CASE WHEN deal_id % 3 = 0 THEN 'synthetic:chat' || CAST(deal_id AS STRING) "
    "ELSE CAST(deal_id AS STRING) END AS stored, deal_id % 3 = 0 AS is_synthetic FROM deals",
)
def synthetic_deal_id(t):
    found = F.when(F.col("deal_id") % 3 != 0, F.col("deal_id").cast("string"))
    stored = F.coalesce(found, F.concat(F.lit(P.SYNTHETIC), F.lit("chat"), F.col("deal_id").cast("string")))
    return t.deals.select("deal_id", stored.alias("stored")).select(
        "deal_id", "stored", P.is_synthetic(F.col("stored")).alias("is_synthetic")
    )


@query(
    "exclude_synthetic",
    cte("deals") + " SELECT currency, count(*) AS deals, CAST(sum(amount) AS DOUBLE) AS amount FROM deals "
    "WHERE deal_id % 3 <> 0 GROUP BY currency",
)
def exclude_synthetic(t):
    stored = F.when(F.col("deal_id") % 3 == 0, F.concat(F.lit(P.SYNTHETIC), F.col("deal_id").cast("string"))).otherwise(
        F.col("deal_id").cast("string")
    )
    kept = t.deals.where(~P.is_synthetic(stored))
    return kept.groupBy("currency").agg(F.count(F.lit(1)).alias("deals"), F.sum("amount").alias("amount"))
