"""Transcript hygiene: contamination, loops, the ledger of removals and the gate.

A segment is one row and its text one value, so cleaning is a projection over the
whole text with no shuffle. Only the gate groups, by call, with combined sums.
Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import ordered, session
from parley.functions import text as T
from parley.functions.text import GAP

POLICY = "asr-q1"

# The gate's limits. Seconds, characters, characters a second, shares.
RED_CHARS, RED_SHARE, RED_SPAN = 20, 0.20, 60
REMOVED_CHARS, REMOVED_SHARE = 40, 0.25
THIN_SECONDS, THIN_DENSITY, DENSE, LOOPED_SHARE = 30, 3, 22, 0.45

# The contamination families that are removed, then those that are
# only flagged, as regular expressions; and the words and limits beside them.
PATTERNS = (
    (
        "qusay_credit_v1",
        r"(?U)(?<![ء-ي])التفريغ\s*(?:و|وال)?\s*التدقيق(?:\s*(?:من|بواسط[ةه]|اعداد)\s*)?"
        r"\s+قص[يى]\s+البيات[يى](?:(?:\s*[-.،,:]{1,3}\s*|\s+)"
        r"(?:عبد\s+الناصر\s+عاشور|جواد\s+الخفا[جح][يى])){0,2}(?![ء-ي])",
    ),
    (
        "eddirasa_domain_v1",
        r"(?iU)(?:(?<![ء-ي])موقع\s+الدراس[ةه]\s+الجزائر[يى]\s*[:：\-–—]?\s*)?"
        r"(?:https?\s*:\s*//\s*)?(?:www\s*\.\s*)?eddirasa\s*\.\s*com"
        r"(?:\s*\.\s*[a-z]{2,3})*(?:\s*/\s*[^\s،؛!?]*)?",
    ),
    ("atsign_blank_v1", r"(?U)(?<!@)@{3,}\s*فراغ(?![ء-ي])"),
)
FLAG_PATTERNS = (
    ("site_label_only", r"(?U)(?<![ء-ي])موقع\s+الدراس[ةه]\s+الجزائر[يى](?![ء-ي])"),
    (
        "generic_credit",
        r"(?U)(?<![ء-ي])(?:الترجم[ةه]|التفريغ|التدقيق)"
        r"(?:\s*(?:و|وال)\s*(?:الترجم[ةه]|التفريغ|التدقيق)){1,2}"
        r"(?:\s+(?:بواسط[ةه]|اعداد|من))?(?:\s+[ء-ي]{2,}){1,4}",
    ),
    ("suspect_name", r"(?U)(?<![ء-ي])(?:عبد\s+الناصر\s+عاشور|جواد\s+الخفا[جح][يى])(?![ء-ي])"),
)
DOMAIN_CHAIN = (
    r"(?U)(?:https?\s*:\s*//\s*|(?<![A-Za-z0-9_\-]))[A-Za-z0-9_\-]++"
    r"(?:\s*+\.\s*+[A-Za-z0-9_\-]++){2,}+(?:\s*/\s*[^\s،؛!?]*)?"
)
# Plain text that every match of a pattern holds: a byte search spares most texts
# the expression itself.
HINTS = {
    "qusay_credit_v1": ("التفريغ",),
    "eddirasa_domain_v1": ("edd",),
    "atsign_blank_v1": ("@@@",),
    "url_garbage_v1": (".",),
    "site_label_only": ("موقع",),
    "generic_credit": ("الترجم", "التفريغ", "التدقيق"),
    "suspect_name": ("عبد", "جواد"),
}
KNOWN_LABELS = ("eddirasa", "fontsalon")
DIGIT_WORDS = (
    "صفر", "واحد", "اثنين", "اتنين", "ثلاثه", "ثلاثة", "تلاته", "تلاتة", "اربعه", "اربعة", "خمسه",
    "خمسة", "سته", "ستة", "سبعه", "سبعة", "ثمانيه", "ثمانية", "تمانيه", "تمانية", "تسعه", "تسعة",
    "عشره", "عشرة",
)
HARD_RUN, WARN_RUN, KEPT = 16, 6, 3
NGRAM_MIN_TOKENS = 20

_SPAN = "STRUCT<s: INT, e: INT, pid: STRING>"
_RUN = "STRUCT<token: STRING, norm: STRING, run: INT, cut_from: INT, cut_to: INT>"
_FLAG = "STRUCT<flag: STRING, run: INT, token: STRING, text: STRING>"
_OP = "STRUCT<pattern_id: STRING, raw_start: INT, raw_end: INT, removed_text: STRING, replacement_text: STRING>"
# Noncharacters that bracket a match while it is located.
OPEN, CLOSE, OTHER = "\ufdd0", "\ufdd1", "\ufffd"


def _empty(kind: str) -> Column:
    return F.expr(f"CAST(array() AS ARRAY<{kind}>)")


def _piece(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, end - start)


def find(text: Column, pattern: str, pid: str) -> Column:
    """Spans of every match, in order, with exact code-point offsets.

    Matches are bracketed by two noncharacters and located by adding up lengths;
    any such character already in the text is first replaced one for one.
    """
    safe = F.translate(text, OPEN + CLOSE, OTHER * 2)
    pieces = F.split(F.regexp_replace(safe, f"({pattern})", f"{OPEN}$1{CLOSE}"), OPEN)

    def add(acc: Column, piece: Column) -> Column:
        n = F.instr(piece, CLOSE) - 1
        return F.struct(
            (acc["at"] + F.length(piece) - F.when(n >= 0, 1).otherwise(0)).cast("int").alias("at"),
            F.when(
                n >= 0,
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            acc["at"].alias("s"), (acc["at"] + n).cast("int").alias("e"),
                            F.lit(pid).alias("pid"),
                        )
                    ),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), _empty(_SPAN).alias("spans"))
    found = F.aggregate(pieces, start, add, lambda acc: acc["spans"])
    held = F.lower(text) if "(?i" in pattern else text
    hinted = F.lit(False)
    for hint in HINTS[pid]:
        hinted = hinted | held.contains(hint)
    return F.when(hinted & text.rlike(pattern), found).otherwise(_empty(_SPAN))


def is_url_garbage(candidate: Column) -> Column:
    def judge(flat: Column) -> Column:
        dots = F.length(flat) - F.length(F.replace(flat, F.lit("."), F.lit("")))
        labels = F.filter(F.split(flat, "[./:]+"), lambda p: p != "")
        known = F.lit(False)
        for label in KNOWN_LABELS:
            known = known | flat.contains(label)
        chained = T.let(
            labels,
            lambda ls: F.exists(
                ls,
                lambda a: F.length(a).between(2, 4) & (F.size(F.filter(ls, lambda b: b == a)) >= 3),
            ),
        )
        return (known & (dots >= 1)) | ((dots >= 5) & (F.length(flat) >= 25)) | ((dots >= 3) & chained)

    return T.let(F.lower(F.regexp_replace(T.plain_blanks(candidate), r"\s+", "")), judge)


def url_garbage(text: Column) -> Column:
    return F.filter(
        find(text, DOMAIN_CHAIN, "url_garbage_v1"),
        lambda x: is_url_garbage(_piece(text, x["s"], x["e"])),
    )


def contamination_spans(text: Column) -> Column:
    return F.concat(*[find(text, rx, pid) for pid, rx in PATTERNS])


# A normalised token followed by itself five times or more.
_REPEATED = r"(?<![^ ])([^ ]++)(?: \1(?![^ ])){5}"


def token_runs(text: Column, norm: Column, at_least: int = WARN_RUN) -> Column:
    """Maximal runs of one normalised token, at least ``at_least`` (six or more)
    long, with the range from the fourth occurrence to the end of the run.

    ``norm`` is the normalised text. A back-reference finds the few texts that hold
    a run; only those are walked token by token.
    """
    gaps = F.split(T.plain_blanks(text), r"\S+")
    pairs = F.arrays_zip(
        F.split(T.collapse_blanks(text), " ").alias("tok"), F.split(norm, " ").alias("norm"), gaps.alias("gap")
    )

    def close(acc: Column) -> Column:
        run = F.struct(
            acc["token"].alias("token"), acc["norm"].alias("norm"), acc["n"].alias("run"),
            acc["cut"].alias("cut_from"), acc["end"].alias("cut_to"),
        )
        return F.when(
            (acc["n"] >= at_least) & (acc["norm"] != ""), F.concat(acc["runs"], F.array(run))
        ).otherwise(acc["runs"])

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = (begin + F.length(x["tok"])).cast("int")
        same = x["norm"] == acc["norm"]
        # the blank run after the last token has no token beside it
        moved = F.struct(
            end.alias("at"),
            F.when(same, acc["token"]).otherwise(x["tok"]).alias("token"),
            x["norm"].alias("norm"),
            F.when(same, acc["n"] + 1).otherwise(1).alias("n"),
            F.when(same & (acc["n"] >= KEPT + 1), acc["cut"]).otherwise(begin).cast("int").alias("cut"),
            end.alias("end"),
            F.when(same, acc["runs"]).otherwise(close(acc)).alias("runs"),
        )
        return F.when(x["tok"].isNull() | (x["tok"] == ""), acc).otherwise(moved)

    start = F.struct(
        F.lit(0).alias("at"), F.lit("").alias("token"), F.lit("").alias("norm"), F.lit(0).alias("n"),
        F.lit(0).alias("cut"), F.lit(0).alias("end"), _empty(_RUN).alias("runs"),
    )
    return F.when(norm.rlike(_REPEATED), F.aggregate(pairs, start, step, close)).otherwise(_empty(_RUN))


def is_numeric_token(norm: Column) -> Column:
    return norm.isin(*DIGIT_WORDS) | norm.rlike(r"^\p{Nd}+$")


def repeated_ngram_fraction(norm: Column) -> Column:
    """Share of tokens lying in 2- to 5-grams seen three times or more.

    A longer gram seen three times is made of pairs seen three times, so the pairs
    alone cover the same tokens. The pairs are sorted with their positions; in
    sorted order a pair occurs three times exactly when it equals two neighbours.
    """
    def pairs(toks: Column) -> Column:
        return F.array_sort(
            F.transform(
                F.slice(toks, F.lit(1), F.size(toks) - 1),
                lambda a, i: F.struct(a.alias("a"), F.get(toks, i + 1).alias("b"), i.alias("i")),
            )
        )

    def covered(sorted_: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            y = F.get(sorted_, k)
            return F.coalesce((y["a"] == x["a"]) & (y["b"] == x["b"]), F.lit(False))

        def thrice(x: Column, k: Column) -> Column:
            return same(x, k - 2) | same(x, k + 2) | (same(x, k - 1) & same(x, k + 1))

        hits = F.transform(F.filter(sorted_, thrice), lambda x: x["i"])
        return F.size(F.array_distinct(F.concat(hits, F.transform(hits, lambda i: i + 1))))

    def fraction(toks: Column) -> Column:
        return F.when(
            F.size(toks) >= NGRAM_MIN_TOKENS, F.bround(T.let(pairs(toks), covered) / F.size(toks), 3)
        ).otherwise(F.lit(0.0))

    return T.let(F.split(norm, " "), fraction)


def merge_spans(text: Column, spans: Column) -> Column:
    """Overlapping or blank-separated spans joined, their pattern ids with ``+``."""
    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        between = _piece(text, last["e"], x["s"])
        touches = (x["s"] <= last["e"]) | (T.collapse_blanks(between) == "")
        joined = F.struct(
            last["s"].alias("s"),
            F.greatest(last["e"], x["e"]).alias("e"),
            F.when(last["pid"].contains(x["pid"]), last["pid"])
            .otherwise(F.concat(last["pid"], F.lit("+"), x["pid"])).alias("pid"),
        )
        return F.when(F.size(acc) == 0, F.array(x)).otherwise(
            F.when(
                touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))
            ).otherwise(F.concat(acc, F.array(x)))
        )

    return F.aggregate(F.array_sort(spans), _empty(_SPAN), add)


def _cut(text: Column, merged: Column) -> Column:
    """The text with every merged span replaced by the gap marker."""
    def kept(m: Column) -> Column:
        n = F.size(m)
        return F.transform(
            F.sequence(F.lit(0), n),
            lambda i: _piece(
                text,
                F.when(i == 0, 0).otherwise(F.get(m, i - 1)["e"]),
                F.when(i == n, F.length(text)).otherwise(F.get(m, i)["s"]),
            ),
        )

    return F.array_join(T.let(merged, kept), GAP)


def tier2_flags(text: Column, merged: Column) -> Column:
    """Suspicious text that is kept, unless a removal already covers it."""
    def outside(x: Column, removed: Column) -> Column:
        return ~F.exists(
            removed,
            lambda m: ((m["s"] <= x["s"]) & (x["s"] < m["e"])) | ((m["s"] < x["e"]) & (x["e"] <= m["e"])),
        )

    spans = F.concat(*[find(text, rx, pid) for pid, rx in FLAG_PATTERNS])
    return F.transform(
        T.let(merged, lambda removed: F.filter(spans, lambda x: outside(x, removed))),
        lambda x: F.struct(
            x["pid"].alias("flag"), F.lit(None).cast("int").alias("run"),
            F.lit(None).cast("string").alias("token"),
            F.substring(_piece(text, x["s"], x["e"]), 1, 80).alias("text"),
        ),
    )


def _loop_spans(runs: Column) -> Column:
    return F.transform(
        F.filter(runs, lambda r: r["run"] >= HARD_RUN),
        lambda r: F.struct(
            r["cut_from"].alias("s"), r["cut_to"].alias("e"),
            F.concat(F.lit("hard_token_run_"), r["run"].cast("string")).alias("pid"),
        ),
    )


def _warn_runs(runs: Column) -> Column:
    return F.filter(
        runs,
        lambda r: r["run"].between(WARN_RUN, HARD_RUN - 1) & ~is_numeric_token(r["norm"]),
    )


def with_norms(segments: DataFrame) -> DataFrame:
    """Add ``norm``, the normalised text. Text outside the common scripts is split
    before it is normalised, because normalising can add blanks."""
    words = F.array_join(T.tokens(F.col("text")), "\x1f")
    folded = F.transform(
        "__nfkc", lambda t: F.translate(T.norm_token(t, normalise=False), " ", "\x1f")
    )
    return segments.withColumn("__nfkc", T.nfkc_tokens(F.when(T.is_odd(F.col("text")), words))).withColumn(
        "norm",
        F.when(F.col("__nfkc").isNull(), T.norm_text(F.coalesce("text", F.lit(""))))
        .otherwise(F.array_join(folded, " ")),
    ).drop("__nfkc")


def clean_segments(segments: DataFrame, every_fraction: bool = True) -> DataFrame:
    """Clean text, ledger, flags and run measures of every segment.

    A failed segment keeps a null text; the caller tells it from a silent one. The
    n-gram fraction decides only about segments with a warning run; without
    ``every_fraction`` it is left at zero elsewhere.
    """
    raw = F.coalesce("text", F.lit(""))
    fraction = repeated_ngram_fraction(F.col("norm"))
    if not every_fraction:
        fraction = F.when(F.col("warn_run") > 0, fraction).otherwise(F.lit(0.0))
    return (
        with_norms(segments)
        .withColumn("raw_text", raw)
        .withColumn("__runs", token_runs(F.col("raw_text"), F.col("norm")))
        .withColumn(
            "__merged",
            merge_spans(
                F.col("raw_text"),
                F.concat(
                    _loop_spans(F.col("__runs")),
                    url_garbage(F.col("raw_text")),
                    contamination_spans(F.col("raw_text")),
                ),
            ),
        )
        .withColumn("clean_text", _cut(F.col("raw_text"), F.col("__merged")))
        .withColumn(
            "ops",
            F.transform(
                "__merged",
                lambda m: F.struct(
                    m["pid"].alias("pattern_id"), m["s"].alias("raw_start"), m["e"].alias("raw_end"),
                    _piece(F.col("raw_text"), m["s"], m["e"]).alias("removed_text"),
                    F.lit(GAP).alias("replacement_text"),
                ),
            ),
        )
        .withColumn(
            "flags",
            F.concat(
                F.transform(
                    _warn_runs(F.col("__runs")),
                    lambda r: F.struct(
                        F.lit("token_run_6_15").alias("flag"), r["run"].alias("run"),
                        r["token"].alias("token"), F.lit(None).cast("string").alias("text"),
                    ),
                ),
                tier2_flags(F.col("raw_text"), F.col("__merged")),
            ),
        )
        .withColumn("hard_loop", F.exists("__runs", lambda r: r["run"] >= HARD_RUN))
        .withColumn(
            "warn_run", F.coalesce(F.array_max(F.transform(_warn_runs(F.col("__runs")), lambda r: r["run"])), F.lit(0))
        )
        .withColumn("ngram_fraction", fraction)
        .drop("__runs", "__merged", "norm")
    )


def reconstruct_raw(clean: Column, ops: Column) -> Column:
    """The raw text, from the clean text and the ledger's offsets."""
    step = len(GAP)

    def put_back(acc: Column, op: Column) -> Column:
        kept = op["raw_start"] - acc["raw"]
        return F.struct(
            F.concat(
                acc["out"], F.substr(clean, acc["at"] + 1, kept), op["removed_text"]
            ).alias("out"),
            (acc["at"] + kept + step).cast("int").alias("at"),
            op["raw_end"].alias("raw"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("raw"))
    return F.aggregate(
        ops, start, put_back, lambda a: F.concat(a["out"], F.substr(clean, a["at"] + 1))
    )


def longest_invalid_spans(
    chunks: DataFrame, flags: list[str], hot_rows: int = ordered.HOT_ROWS
) -> DataFrame:
    """Longest run of consecutive flagged chunks per call, in seconds, per flag.

    A run is named by the last valid chunk before it, so runs are ordinary groups.
    """
    line = ordered.with_slots(
        chunks.select("call_id", "seq", "seconds", *flags), ["call_id"], F.col("seq"), 1000, hot_rows
    )
    for flag in flags:
        line = ordered.nearest(
            line, ["call_id"], ["seq"], F.when(~F.col(flag), F.col("seq")), f"__after_{flag}"
        )
    runs = F.array(
        *[
            F.when(F.col(flag), F.struct(F.lit(flag).alias("flag"), F.col(f"__after_{flag}").alias("after")))
            for flag in flags
        ]
    )
    spans = (
        line.select("call_id", "seconds", F.inline(F.array_compact(runs)))
        .groupBy("call_id", "flag", "after").agg(F.sum("seconds").alias("span"))
    )
    return spans.groupBy("call_id").agg(
        *[F.max(F.when(F.col("flag") == flag, F.col("span"))).alias(f"longest_{flag}") for flag in flags]
    )


def chunk_measures(cleaned: DataFrame) -> DataFrame:
    """The few numbers of each chunk that the gate needs, written once.

    The gate reads them several times; the written table keeps the cleaning from
    being repeated, and from being lost with an executor.
    """
    sure = F.col("failed") | F.col("hard_loop")
    removed = F.aggregate(
        F.filter("ops", lambda o: ~o["pattern_id"].contains("hard_token_run")),
        F.lit(0), lambda a, o: a + F.length(o["removed_text"]),
    )
    no_gap = F.replace(F.col("clean_text"), F.lit(GAP), F.lit(""))

    def edge(name: str, trim) -> Column:
        blanks = F.translate(T.plain_blanks(F.col(name)), "\t\n\x0b\f\r", " " * 5)
        return F.length(name) - F.length(trim(blanks))

    measures = cleaned.select(
        "call_id", "seq", "seconds", "failed", "hard_loop",
        (sure | ((F.col("warn_run") > 0) & (F.col("ngram_fraction") >= LOOPED_SHARE))).alias("invalid_sparse"),
        (sure | (F.col("warn_run") > 0)).alias("invalid_dense"),
        (F.col("warn_run") > 0).alias("warned"),
        F.length("raw_text").alias("chars"),
        edge("raw_text", F.ltrim).alias("lead"),
        edge("raw_text", F.rtrim).alias("trail"),
        F.length("clean_text").alias("clean_size"),
        edge("clean_text", F.ltrim).alias("clean_lead"),
        edge("clean_text", F.rtrim).alias("clean_trail"),
        F.when(F.length("clean_text") > 0, F.length(no_gap)).alias("clean_chars"),
        removed.alias("removed"),
        (F.size("ops") > 0).alias("has_removal"),
        (F.size("flags") > 0).alias("has_flag"),
    )
    return session.persist(measures, "chunk-measures")


def _joined_size(chunks: DataFrame, size: str, lead: str, trail: str, counted: str, name: str) -> DataFrame:
    """(call_id, name): characters of a call's non-empty chunks joined by blanks, less the blanks at either end.

    ``counted`` is what a chunk adds, which may be less than its ``size``. Chunks of
    blanks only before the first and after the last other chunk do not count at all.
    """
    worded = F.when(F.col(lead) < F.col(size), F.col("seq"))
    ends = chunks.groupBy("call_id").agg(F.min(worded).alias("first"), F.max(worded).alias("last"))
    inner = chunks.where(F.col(size) > 0).join(ends, "call_id").where(F.col("seq").between(F.col("first"), F.col("last")))
    cut = F.when(F.col("seq") == F.col("first"), F.col(lead)).otherwise(0) + F.when(F.col("seq") == F.col("last"), F.col(trail)).otherwise(0)
    return inner.groupBy("call_id").agg((F.sum(F.col(counted) + 1 - cut) - 1).alias(name))


def assess_calls(cleaned: DataFrame, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """Red, amber or green per call, with the measures behind it.

    Whether a warning run counts against a chunk depends on the density of the
    whole call. Both readings are summed and the right one is taken per call, so
    no second pass over the chunks is needed.
    """
    chunks = chunk_measures(cleaned)
    sums = chunks.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("chunks_total"),
        F.count_if("failed").alias("chunks_failed"),
        F.count_if(~F.col("failed") & (F.col("chars") == 0)).alias("chunks_empty"),
        F.bround(F.sum("seconds"), 2).alias("duration"),
        F.coalesce(F.sum(F.when(F.col("invalid_sparse"), F.col("seconds"))), F.lit(0.0)).alias("sec_sparse"),
        F.coalesce(F.sum(F.when(F.col("invalid_dense"), F.col("seconds"))), F.lit(0.0)).alias("sec_dense"),
        F.sum("removed").cast("int").alias("tier1_chars_removed"),
        F.max("has_removal").alias("any_removal"),
        F.max("has_flag").alias("any_flag"),
        F.max(F.col("warned") & ~F.col("invalid_sparse")).alias("warn_sparse"),
        F.max("hard_loop").alias("any_loop"),
    )
    # the ends go before the markers do, so a chunk that is all marker still counts a blank
    raw = _joined_size(chunks, "chars", "lead", "trail", "chars", "chars")
    clean = _joined_size(chunks, "clean_size", "clean_lead", "clean_trail", "clean_chars", "clean_chars")
    sums = sums.join(raw, "call_id", "left").join(clean, "call_id", "left").withColumns(
        {n: F.coalesce(n, F.lit(0)) for n in ("chars", "clean_chars")}
    )
    spans = longest_invalid_spans(chunks, ["invalid_sparse", "invalid_dense"], hot_rows)
    density = F.coalesce(F.col("chars") / F.when(F.col("duration") > 0, F.col("duration")), F.lit(0.0))
    dense = density > DENSE
    zero = F.lit(0.0)

    def chosen(a: str, b: str) -> Column:
        return F.when(dense, F.coalesce(b, zero)).otherwise(F.coalesce(a, zero))

    calls = sums.join(spans, "call_id", "left").select(
        "*",
        F.bround(density, 2).alias("chars_per_audio_sec"),
        chosen("sec_sparse", "sec_dense").alias("invalid"),
        chosen("longest_invalid_sparse", "longest_invalid_dense").alias("longest"),
        (~dense & F.col("warn_sparse")).alias("warn_only"),
        dense.alias("dense"),
        density.alias("density"),
    )
    red = (
        (F.col("clean_chars") < RED_CHARS)
        | ((F.col("duration") > 0) & (F.col("invalid") > F.col("duration") * RED_SHARE))
        | (F.col("longest") >= RED_SPAN)
        | (
            (F.col("tier1_chars_removed") >= REMOVED_CHARS) & (F.col("chars") > 0)
            & (F.col("tier1_chars_removed") >= F.col("chars") * REMOVED_SHARE)
        )
    )
    amber = (
        (F.col("invalid") > 0) | F.col("warn_only") | F.col("any_removal") | F.col("any_flag")
        | ((F.col("duration") >= THIN_SECONDS) & (F.col("density") < THIN_DENSITY)) | (F.col("chunks_empty") > 0)
        | (F.col("dense") & ~F.col("any_loop"))
    )
    return calls.select(
        "call_id", "chunks_total", "chunks_failed", "chunks_empty", "duration", "chars", "clean_chars",
        "chars_per_audio_sec",
        F.bround((F.col("chunks_total") - F.col("chunks_failed")) / F.col("chunks_total"), 2).alias("confidence"),
        F.bround("invalid", 2).alias("invalid_seconds"),
        F.bround("longest", 2).alias("longest_invalid_span_seconds"),
        "tier1_chars_removed",
        F.when(red, "red").when(amber, "amber").otherwise("green").alias("status"),
        F.lit(POLICY).alias("quality_policy_version"),
    )


def max_token_run(segments: DataFrame, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """Longest run of one exact token over a whole call, across its segments.

    Each segment is reduced to its longest inner run and its first and last run;
    only the latter can grow over a segment's edge.
    """
    words = T.tokens(F.coalesce("text", F.lit("")))

    def run(w: Column, begin: Column, end: Column) -> Column:
        return F.struct(F.get(w, begin).alias("token"), (end - begin).cast("int").alias("n"))

    def outer(s: Column) -> Column:
        # places where a run begins, and the end of the last one
        w, at = s["w"], s["at"]
        k = F.size(at) - 1
        first, last = run(w, F.get(at, F.lit(0)), F.get(at, F.lit(1))), run(w, F.get(at, k - 1), F.get(at, k))
        lengths = F.zip_with(F.slice(at, F.lit(2), k - 2), F.slice(at, F.lit(3), k - 2), lambda x, y: y - x)
        inner = F.struct(F.lit(None).cast("string").alias("token"), F.array_max(lengths).cast("int").alias("n"))
        return F.when(k == 1, F.array(first)).when(k == 2, F.array(first, last)).otherwise(F.array(first, inner, last))

    def places(w: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: (i == 0) | (i == F.size(w)) | (F.get(w, i) != F.get(w, i - 1)))
        return F.struct(w.alias("w"), begins.alias("at"))

    walked = T.let(T.let(F.col("words"), places), outer)
    # a filter before the rows are stored would be pushed down and walk every text twice
    runs = segments.select("call_id", "seq", words.alias("words")).select(
        "call_id", "seq", F.when(F.size("words") > 0, walked).alias("runs")
    )
    runs = session.persist(runs, "segment-runs").where(F.size("runs") > 0)
    inner = runs.where(F.size("runs") == 3).select("call_id", F.get("runs", F.lit(1))["n"].alias("n"))
    edges = F.when(F.size("runs") == 1, F.col("runs")).otherwise(
        F.array(F.element_at("runs", 1), F.element_at("runs", -1))
    )
    ends = runs.select("call_id", "seq", F.posexplode(edges).alias("side", "run")).select(
        "call_id", "seq", "side", F.col("run.token").alias("token"), F.col("run.n").alias("n")
    )
    key, order = ["call_id"], ["seq", "side"]
    slots = ordered.with_slots(ends, key, F.col("seq"), 1000, hot_rows)
    before = ordered.nearest(slots, key, order, F.struct("token", "seq"), "prev")
    joins = (F.col("prev.token") == F.col("token")) & (F.col("prev.seq") < F.col("seq"))
    chained = ordered.running_sum(
        before, key, order, F.when(joins, 0).otherwise(1), "island"
    )
    edge = chained.groupBy("call_id", "island").agg(F.sum("n").alias("n")).select("call_id", "n")
    return edge.unionByName(inner).groupBy("call_id").agg(F.max("n").cast("int").alias("max_token_run"))


def asr_health(cleaned: DataFrame, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """The gate's measures with the longest token run beside them."""
    runs = max_token_run(cleaned.select("call_id", "seq", F.col("raw_text").alias("text")), hot_rows)
    longest = F.coalesce("max_token_run", F.lit(0))
    return assess_calls(cleaned, hot_rows).join(runs, "call_id", "left").select(
        "call_id", "chunks_total", "chunks_failed", "chunks_empty", "confidence", "chars", "clean_chars",
        "chars_per_audio_sec", longest.alias("max_token_run"), (longest >= WARN_RUN).alias("repetition_suspect"),
    )


def gate_red(assessed: DataFrame) -> DataFrame:
    """Calls the gate keeps from being graded, as dead-letter rows."""
    return assessed.where(F.col("status") == "red").select(
        "call_id", F.lit("dead_letter").alias("job_status"),
        T.error_text(
            "asr_quality_red: ",
            F.format_string("invalid %.2fs, longest %.2fs, removed %d", "invalid_seconds",
                            "longest_invalid_span_seconds", "tier1_chars_removed"),
        ).alias("last_error"),
    )
