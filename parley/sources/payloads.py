"""Chat payloads: scanning, landing once, unwrapping and parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import payload as P
from parley.functions import clock, phone, text
from parley.operators import conversations
from parley.sources import listing, recordings


#: bytes of payloads that a reading task holds at once, about
READ_BYTES = 8 << 20


def read_raw_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One payload per file; the first element where a file holds an array.

    The driver sees the folders below ``path`` only. Tasks list the files in them, at any depth, and
    read them, so that no list of all files is ever held in one place.
    """
    system, root = listing._system(path)
    if system.get_file_info(root).type != pafs.FileType.Directory:
        # one file, or a pattern
        texts = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file"))
        return first_element(texts)
    names = recordings.list_recordings(spark, path, suffix="").select("file_id")
    # as Spark's readers, nothing below a folder of unfinished work
    names = names.where(~F.substring("file_id", len(root.rstrip("/")) + 1, 1 << 20).rlike(r"/(\.|_(?![^/]*=))[^/]*/"))
    # a set number, as the adaptive size of partitions counts bytes of names, not of files
    dealt = names.repartition(4 * spark.sparkContext.defaultParallelism, "file_id")
    read = dealt.mapInArrow(_read_files(path), "payload binary, file string")
    return first_element(read.select(F.col("payload").cast("string").alias("payload"), "file"))


def _read_files(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = listing._system(root)
        names, texts, held = [], [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(name) as f:
                    texts.append(f.read())
                names.append(_uri(root, name))
                held += len(texts[-1])
                if held >= READ_BYTES:
                    yield _files(names, texts)
                    names, texts, held = [], [], 0
        if names:
            yield _files(names, texts)

    return read


def _files(names: list[str], texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(names, pa.string())], ["payload", "file"])


def _uri(root: str, name: str) -> str:
    """A listed file's name as Spark gives it, with its scheme and escapes."""
    escaped = "".join(c if ord(c) > 127 else quote(c, "/!$&'()*+,;=:@~-._") for c in name)
    scheme, found, rest = root.partition("://")
    if not found or scheme == "file":
        return f"file:{escaped}"
    return f"{scheme}://{rest.partition('/')[0] if name.startswith('/') else ''}{escaped}"


def first_element(df: DataFrame) -> DataFrame:
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    return df.withColumn("v", F.try_parse_json("payload")).withColumn(
        "v", F.when(is_list, F.try_variant_get("v", "$[0]", "variant")).otherwise(F.col("v"))
    )


def hashed(df: DataFrame, source: str) -> DataFrame:
    return df.select(
        F.lit(source).alias("source"), "*", text.text_hash(F.col("payload")).alias("payload_hash")
    )


def land_raw(df: DataFrame, landed: DataFrame, source: str) -> DataFrame:
    """Arrivals with ``is_new``: the first copy of a payload not landed before.

    One aggregate finds the first copy per hash, so a payload sent a million times
    is one row in the join with what has landed.
    """
    rows = hashed(df, source)
    keys = ["source", "payload_hash"]
    first = rows.groupBy(*keys).agg(
        F.min("arrival_id").alias("arrival_id"), F.count(F.lit(1)).alias("copies")
    )
    known = landed.select(*keys).distinct().withColumn("__known", F.lit(True))
    return first.join(known, keys, "left").select(
        *keys, "arrival_id", "copies", F.col("__known").isNull().alias("is_new")
    )


def unwrap_rows(df: DataFrame) -> DataFrame:
    """Rows of the list inside an envelope, or of a bare list, as VARIANT."""
    v = F.try_parse_json("payload")

    def listed(x: Column) -> Column:
        return F.when(F.schema_of_variant(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>"))

    found = F.coalesce(listed(F.col("v")), *[listed(P.get(F.col("v"), k)) for k in P.ENVELOPE_KEYS])
    return df.withColumn("v", v).select(
        *df.columns, F.posexplode(found).alias("position", "row")
    )


def parse_chats(
    df: DataFrame, region: str = "SA", synthetic_deals: bool = False, score_bot_only: bool = False
) -> DataFrame:
    """Conversations out of payloads of either vocabulary: one row in, one row out.

    Payloads without an id under any alias come back with a null ``external_id``.
    """
    body = F.coalesce(P.get(F.col("v"), "body"), F.col("v"))
    rows = first_element(df).select(*df.columns, body.alias("b")).select(
        *df.columns, "b",
        P.pick(F.col("b"), *P.DEAL_KEYS).alias("deal"),
        P.as_list(P.pick(F.col("b"), *P.HISTORY_KEYS)).alias("history"),
    )
    rows = rows.withColumn("items", F.transform("history", P.message_struct))
    b, deal = F.col("b"), F.col("deal")

    def deal_text(name: str) -> Column:
        return F.nullif(P.get(deal, name, "string"), F.lit(""))

    kept = F.filter("items", lambda m: m["scoreable"])
    messages = F.transform(
        kept, lambda m, i: F.struct((i + 1).alias("seq"), m["sender"].alias("sender"), m["body"].alias("body"), m["sent_at"].alias("sent_at")),
    )
    source = F.coalesce(deal_text("SOURCE_ID"), P.pick_text(b, "channel", "source"), F.lit(""))
    on_rows = F.get(F.filter(F.transform("items", lambda m: m["deal_id"]), lambda d: d.isNotNull()), F.lit(0))
    declared = P.get(b, "message_count", "int")
    dropped = F.transform(
        F.filter("items", lambda m: ~m["scoreable"]),
        lambda m: F.when(m["content_type"] == "", "empty").otherwise(m["content_type"]),
    )
    number = P.pick_text(b, *P.PHONE_KEYS)
    out = rows.select(
        *df.columns,
        P.pick_text(b, *P.ID_KEYS).alias("external_id"),
        P.map_channel(source).alias("channel"),
        messages.alias("messages"),
        number.alias("customer_phone_raw"),
        phone.normalize_phone(number, region).alias("__phone"),
        deal_text("ASSIGNED_BY_ID").alias("agent_external_id"),
        P.pick_text(b, *P.CONTACT_KEYS).alias("contact_id"),
        F.coalesce(P.pick_text(b, *P.DEAL_ID_KEYS), on_rows, deal_text("ID")).alias("__deal"),
        declared.alias("declared_message_count"),
        F.size("history").alias("received_message_count"),
        F.coalesce(declared > F.size("history"), F.lit(False)).alias("truncated"),
        dropped.alias("dropped_non_text"),
        P.safe_deal_fields(
            F.coalesce(F.try_variant_get(deal, "$", "map<string,string>"), F.expr("CAST(map() AS MAP<STRING,STRING>)"))
        ).alias("deal_safe"),
        deal_text("DATE_CREATE").alias("__created"),
    )
    mint = F.lit(synthetic_deals) & F.col("__deal").isNull()
    bot_only = ~F.exists("messages", lambda m: m["sender"] == "agent")
    no_customer = (F.size("messages") > 0) & ~F.exists("messages", lambda m: m["sender"] == "customer")
    return out.select(
        "*",
        F.coalesce(F.get("messages", F.lit(0))["sent_at"], clock.parse_ts(F.col("__created"))).alias("started_at"),
        F.try_element_at("messages", F.lit(-1))["sent_at"].alias("ended_at"),
        F.col("__phone.e164").alias("customer_phone_e164"),
        F.col("__phone.error").alias("phone_error"),
        F.when(mint, F.concat(F.lit(P.SYNTHETIC), "external_id")).otherwise(F.col("__deal")).alias("deal_id"),
        mint.alias("deal_id_is_synthetic"),
        bot_only.alias("is_bot_only"),
        no_customer.alias("has_no_customer_turn"),
        conversations.should_evaluate(bot_only, no_customer, score_bot_only).alias("should_evaluate"),
    ).drop("__phone", "__deal", "__created")


def fetch_since(conversations_: DataFrame, since: Column) -> DataFrame:
    return conversations_.where(F.col("started_at") >= since)


def fetch_one(conversations_: DataFrame, external_id: str) -> DataFrame:
    return conversations_.where(F.col("external_id") == external_id)


def messages_of(parsed: DataFrame) -> DataFrame:
    """Message rows of parsed conversations, with the hash used as their identity.

    The list is named twice: of a plain column the optimiser infers a filter, which it pushes
    below the parse and so repeats the parse many times.
    """
    listed = F.when(F.size("messages") > 0, F.col("messages"))
    return parsed.select(F.col("external_id").alias("interaction_id"), F.inline(listed)).withColumn(
        "body_hash", text.text_hash(F.col("body"))
    )


def dedup_messages(messages: DataFrame) -> DataFrame:
    """One row per (thread, sender, time, body), the lowest ``seq`` kept."""
    keys = ["interaction_id", "sender", "sent_at", "body_hash"]
    return messages.groupBy(*keys).agg(F.min_by(F.struct("seq", "body"), "seq").alias("m")).select(
        *keys, "m.seq", "m.body"
    )
