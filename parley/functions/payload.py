"""Reading chat payloads of two vocabularies held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import clock
from parley.functions import text as T

# Field aliases in order of precedence, and the closed lists.
ID_KEYS = ("dialog_id", "Dialog", "Dialoug", "conversation_id", "id")
HISTORY_KEYS = ("conversation_history", "messages", "ConversationHistory")
TEXT_KEYS = ("message", "content", "text")
SENDER_KEYS = ("sender", "sender_role", "role")
TIME_KEYS = ("timestamp", "sent_at", "created_at", "DATE_CREATE")
DEAL_ID_KEYS = ("crm_entity_id", "deal_id", "dealid", "DealId", "bitrix_deal_id")
DEAL_KEYS = ("deal_info", "deal_info_response.result", "DealInfo.result")
PHONE_KEYS = ("phone", "customer_phone", "user_phone")
CONTACT_KEYS = ("contact_id", "ContactId")
ENVELOPE_KEYS = ("conversations", "deals", "items", "results", "data", "rows")
CHANNELS = {
    "FACEBOOK": "facebook",
    "INSTAGRAM": "instagram",
    "WHATSAPP": "whatsapp",
    "TELEGRAM": "telegram",
    "LIVECHAT": "webchat",
    "OPENLINE": "webchat",
}
CUSTOMER_NAMES = ("customer", "client", "user")
AGENT_NAMES = ("agent", "operator", "manager", "employee")
TEXT_TYPES = ("", "text", "plain", "message")
DEAL_ALLOWED = (
    "ID", "TITLE", "STAGE_ID", "STAGE_SEMANTIC_ID", "CATEGORY_ID", "OPPORTUNITY", "CURRENCY_ID",
    "CONTACT_ID", "ASSIGNED_BY_ID", "SOURCE_ID", "DATE_CREATE", "DATE_MODIFY", "BEGINDATE", "CLOSEDATE",
)
DEAL_DENIED = ("UF_CRM_1781281581",)
SYNTHETIC = "synthetic:"

_EMPTY = ("null", '""', "[]", "{}")


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, "$." + path, kind)


def present(x: Column) -> Column:
    """``x`` unless it is missing, null, or an empty string, array or object."""
    return F.when(~F.to_json(x).isin(*_EMPTY), x)


def pick(v: Column, *paths: str) -> Column:
    """First present value along a list of paths, as VARIANT."""
    return F.coalesce(*[present(get(v, p)) for p in paths])


def pick_text(v: Column, *paths: str) -> Column:
    """``pick`` as text. Only the text of an empty array or object is looked at
    twice, to tell it from a string that reads the same."""
    def one(path: str) -> Column:
        def judge(s: Column) -> Column:
            hollow = s.isin("[]", "{}") & ~F.to_json(get(v, path)).startswith('"')
            return F.when((s != "") & ~hollow, s)

        return T.let(get(v, path, "string"), judge)

    return F.coalesce(*[one(p) for p in paths])


def as_text(x: Column) -> Column:
    return F.try_variant_get(x, "$", "string")


def as_list(x: Column) -> Column:
    return F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.expr("CAST(array() AS ARRAY<VARIANT>)"))


def map_channel(source: Column) -> Column:
    key = F.upper(F.element_at(F.split(source, r"\|"), -1))
    out = F.lit("other")
    for name, channel in CHANNELS.items():
        out = F.when(key == name, channel).otherwise(out)
    return out


def map_role(sender: Column, is_bot: Column) -> Column:
    s = F.lower(F.btrim(F.coalesce(sender, F.lit(""))))
    return (
        F.when(s.isin(*CUSTOMER_NAMES), "customer")
        .when((s == "bot") | F.coalesce(is_bot, F.lit(False)), "bot")
        .when(s.isin(*AGENT_NAMES), "agent")
        .when(s == "system", "system")
        .otherwise("unknown")
    )


def safe_deal_fields(fields: Column, denied: tuple[str, ...] = DEAL_DENIED) -> Column:
    """Allow-listed, not deny-listed entries of an open field map."""
    return F.map_filter(fields, lambda k, _: k.isin(*DEAL_ALLOWED) & ~k.isin(*denied))


def is_synthetic(deal_id: Column) -> Column:
    return deal_id.startswith(SYNTHETIC)


def message_struct(item: Column) -> Column:
    """One history row, read under either vocabulary."""
    kind = F.lower(F.btrim(F.coalesce(get(item, "content_type", "string"), F.lit(""))))
    body = F.btrim(F.coalesce(pick_text(item, *TEXT_KEYS), F.lit("")), F.lit(" \t\n\r\f\v"))
    said = T.let(
        pick_text(item, *SENDER_KEYS), lambda s: map_role(s, get(item, "is_bot", "boolean"))
    )
    at = T.let(pick_text(item, *TIME_KEYS), clock.parse_ts)
    return T.let(
        F.struct(kind.alias("kind"), body.alias("body")),
        lambda m: F.struct(
            m["kind"].alias("content_type"), said.alias("sender"), m["body"].alias("body"),
            at.alias("sent_at"), pick_text(item, *DEAL_ID_KEYS).alias("deal_id"),
            (m["kind"].isin(*TEXT_TYPES) & (m["body"] != "")).alias("scoreable"),
        ),
    )
