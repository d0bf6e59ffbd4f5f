"""Replies of a model: their code fence, and whether they are JSON."""

import re

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import scoring as sc

FENCE = re.compile(r"(?s)\A```(?:json)?[ \t\n\x0b\f\r]*(.*?)[ \t\n\x0b\f\r]*```\Z")


def unfenced(reply):
    if reply is None:
        return None
    reply = reply.strip(" \t\n\x0b\f\r")
    found = FENCE.match(reply)
    return found.group(1) if found else reply


REPLIES = [
    None, "", " ", "{}", " {} \n", "```{}```", "```json{}```", "```json\n{}\n```", " ```json \x0b{} \f\r``` ", "```js{}```", "```jsonjson```",
    "```", "`````", "``````", "```json```", "```json``", "```\n \n```", "```a```b```", "x ```{}```", "```{}``` x", " {} ", "``` {}```",
    "```json\n{\"a\": \"``` é\"}\n```", "Sure! {}", "[1]", "-1", "nul", "null", "true", "Infinity", "\"a", "\"a\"", "{\"a\": 1, \"a\": 2}", "﻿{}", "{} {}",
]


def test_fences_are_found_at_the_ends(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "i int, payload string")
    got = df.select("i", T.strip_code_fence(F.col("payload")).alias("body"), T.is_json(F.col("payload")).alias("json"), F.try_parse_json("payload").isNotNull().alias("want"))
    for r in got.collect():
        assert (r.body, r.json) == (unfenced(REPLIES[r.i]), r.want), REPLIES[r.i]
    bad = {r.payload for r in sc.malformed(df).collect()}
    assert None in bad and "Sure! {}" in bad and "```json\n{}\n```" not in bad and "```{}``` x" in bad
    # patterns over the whole reply took most of the time
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp" not in plan
