"""The registered queries of the pipeline operators, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.bpe import encode
from parley.llm.graph import small
from parley.llm.hamming import simhash_components
from parley.llm.jaccard import similar_components
from parley.llm.langid import learn
from parley.llm.linear import MAX_ROWS, fit, remainder, sample, style_features
from parley.llm.perplexity import quality
from parley.llm.reputation import judge
from parley.llm.substrings import remove_repeats
from parley.llm.tokencounts import Rollup, count_tokens, deletes, inserts, revisions
from parley.llm.variants import count_words, group_variants
from parley.llm.weak import toxicity_model
from parley.llm.whitening import fit as fit_whitening
from parley.llm.whitening import usable
from parley.llm.winnow import contamination
from parley.session import persist, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_perplexity", "low", "high")
    return quality(table(spark, sf_dir, "documents"), held_out=True).select(*names)


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT item_id, 13 AS n, array_to_string(w[i : i + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b WHERE len(w) >= 13)
  UNION ALL SELECT item_id, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 12),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM iw) ON len(w) >= n),
occ AS (SELECT doc_id, item_id, i, n FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM places) JOIN iw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS t
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


@query()
def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^ 	-
]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.y FROM reach r JOIN link l ON r.b = l.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)
""")
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), n=4, percent=85)


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM places),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM hit)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(remainder("doc_id", 5) != 0), public_tokenizers.path("piece_bpe_32k.model"))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return model.identify(docs).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = sample(labels.where(remainder("doc_id", 5) != 0).withColumn("y", F.col("quality")), MAX_ROWS)
    model = fit(docs, persist(known, "sample"), style_features, counted=True)
    return judged(model.scores(docs), 5, 0)


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity_model(docs, labels.where(remainder("doc_id", 4) != 2))
    return judged(model.scores(docs), 4, 2)


#: (verdict, host and path)
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _strength(level: str, name: str) -> str:
    """SQL of the share and the prior's strength over the rows of a level."""
    return (
        f"{name} AS (SELECT mu, least(greatest(CASE WHEN between_ > 0 THEN within_ / between_ - 1 ELSE 1000 END, 2), 1000) AS m FROM ("
        "SELECT mu, within_, CASE WHEN t - nn / t > 0 THEN (kk - t * mu * mu - (c - 1) * within_) / (t - nn / t) ELSE 0 END AS between_ FROM ("
        "SELECT k / t AS mu, k / t * (1 - k / t) AS within_, t, c, kk, nn FROM (SELECT CAST(sum(bad) AS DOUBLE) AS k, CAST(sum(n) AS DOUBLE) AS t, "
        f"count(*) AS c, sum(bad * bad / CAST(n AS DOUBLE)) AS kk, CAST(sum(n * n) AS DOUBLE) AS nn FROM {level} WHERE n > 0))))"
    )


URL_SQL = (
    r"""
WITH lab AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
p AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
  try_cast(nullif(regexp_extract(url, '://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})(?:\.html|/)?(?:[?#].*)?$', 1), '') AS BIGINT) AS doc_id FROM pages),
outcome AS (SELECT page_id, max(bad) AS bad FROM p JOIN lab USING (doc_id) GROUP BY page_id),
cut AS (SELECT host, string_split(host, '.') AS s, count(CASE WHEN host <> '' THEN bad END) AS n, coalesce(sum(CASE WHEN host <> '' THEN bad END), 0) AS bad
  FROM p LEFT JOIN outcome USING (page_id) GROUP BY host),
named AS (SELECT host, n, bad, CASE WHEN len(s) < 2 THEN host
  WHEN len(s) >= 3 AND length(s[-1]) = 2 AND s[-2] IN ('co', 'com', 'net', 'org', 'ac', 'gov', 'edu') THEN array_to_string(s[-3:], '.')
  ELSE array_to_string(s[-2:], '.') END AS domain FROM cut),
hosts AS (SELECT *, regexp_replace(domain, '^[^.]*\.?', '') AS suffix FROM named),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
"""
    + ", ".join(_strength(f"{x}s" if x != "suffix" else "suffixes", f"m_{x}") for x in ("suffix", "domain", "host"))
    + """,
s AS (SELECT suffix, (bad + m * mu) / (n + m) AS prior FROM suffixes, m_suffix),
d AS (SELECT domain, (bad + m * prior) / (n + m) AS prior FROM domains JOIN s USING (suffix), m_domain),
h AS (SELECT host, bad + m * prior AS a, n - bad + m * (1 - prior) AS b FROM hosts JOIN d USING (domain), m_host),
r AS (SELECT host, a / (a + b) AS share, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM h),
ruled AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict, share, low
FROM ruled LEFT JOIN r USING (host)
"""
)


@query(URL_SQL)
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # a page's address ends in the number of its document, whose labels are the page's outcome
    number = F.regexp_extract("url", r"://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})(?:\.html|/)?(?:[?#].*)?$", 1)
    named = pages.select(F.col("page_id").alias("page"), F.when(number != "", number).cast("long").alias("doc_id"))
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    outcomes = named.join(labels.select("doc_id", bad.alias("bad")), "doc_id").groupBy("page").agg(F.max("bad").alias("bad"))
    return judge(pages, outcomes, RULES)


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: all documents come in, toxic ones go, low-quality ones lose repeated lines; the third comes twice."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = docs.select("doc_id", "source", "lang", "text", F.lit("byte_bpe_50k").alias("tokenizer_version"))
    counted = persist(count_tokens(docs, path), "counted")
    rollup = Rollup(spark, shared_folder(spark, "token-rollup"))
    rollup.commit(1, inserts(counted))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    rollup.commit(2, deletes(counted.join(toxic, "doc_id", "left_semi")))
    poor = small(persist(labels.where("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti"), "poor"))
    # each line once, in order; old and new text are counted on the same row, as ids may repeat
    lines = docs.join(poor, "doc_id", "left_semi").withColumn("lines", F.array_join(F.array_distinct(F.split("text", "\n")), "\n"))
    old = count_tokens(lines, path).withColumnRenamed("n_tokens", "old_tokens")
    revised = revisions(count_tokens(old, path, "lines"))
    rollup.commit(3, revised)
    rollup.commit(3, revised)
    rollup.compact()
    return rollup.totals()


def misspelt(doc_id: Column, word: Column) -> Column:
    """``word`` without one code point where 97 divides the crc32 of `<doc_id>:<word>`; null for a null id."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word))
    at = F.pmod(h, F.length(word).cast("long")).cast("int")
    return F.when(h.isNotNull(), F.when(h % 97 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word))


#: crc32 over a list of bytes, by its table of 256 remainders
CRC = "list_reduce(list_concat([4294967295::BIGINT], {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"


@query(
    r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
each AS (SELECT doc_id, r, count(*) AS n FROM run GROUP BY ALL),
coded AS (SELECT r, n, hex(encode(doc_id || ':' || r)) AS x FROM each),
hashed AS (SELECT r, n, xor(4294967295, """
    + CRC.format(bytes="list_transform(range(0, length(x), 2), lambda k: CAST('0x' || x[k + 1 : k + 2] AS BIGINT))")
    + r""") AS h FROM coded, crc),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, CAST(h % length(r) AS INTEGER)) || substr(r, CAST(h % length(r) AS INTEGER) + 2) ELSE r END AS w, n FROM hashed),
word AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
place AS (SELECT w, n, unnest(range(length(w))) AS i FROM word),
cut AS (SELECT w, n, i, left(w, i) AS a, substr(w, i + 2) AS b FROM place),
near AS (SELECT x.w, y.w AS v, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.w <> y.w
  UNION SELECT x.w, y.w, y.n FROM cut x JOIN word y ON x.a || x.b = y.w
  UNION SELECT y.w, x.w, x.n FROM cut x JOIN word y ON x.a || x.b = y.w),
best AS (SELECT w, count(*) AS n_near, arg_max(v, m * 1000000000 - rank) AS v, max(m) AS m
  FROM (SELECT *, row_number() OVER (ORDER BY encode(v)) AS rank FROM near) GROUP BY w),
form AS (SELECT word.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN v END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM word LEFT JOIN best USING (w)),
chain AS (SELECT w, w AS last, 0 AS step FROM form UNION ALL SELECT chain.w, form.form, step + 1 FROM chain JOIN form ON chain.last = form.w WHERE form.form IS NOT NULL)
SELECT w AS word, form, root, n, n_near, form_n FROM form JOIN (SELECT w, arg_max(last, step) AS root FROM chain GROUP BY w) USING (w)
"""
)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(table(spark, sf_dir, "documents"), edit=misspelt))


@query()
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), n=4, distance=4)


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    model = fit_whitening(vectors, components=32)
    error = model.identity_error(vectors)
    white = model.apply(vectors).select(F.col("id").alias("vec_id"), F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*(F.lit(e) for e in model.explained)).cast("array<double>")
    return white.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def judged(scores: DataFrame, modulus: int, held: int) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", modulus) == held, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
