"""N-gram Jaccard join by a token-group matrix.

Documents are sets of hashed word n-grams. Those with equal sets are one. Similar
sets are first gathered into groups: sets that share a minimum hash are compared with
one pivot of that hash, and groups are the components of the links found. Links inside
such a group need no more search. Sets that no link holds but that look like one pivot
share open groups of bounded size. What is left is links between groups, and in open
groups.

For these, the matrix holds, per token, the groups whose union has it. A set that is
``t`` similar to another shares at least ``k`` tokens with it among the
``size - ceil(t * size) + k`` first of each in any fixed order, so only these prefixes
enter the unions. The order puts rare tokens first; rarity comes from a counting
sketch of fixed size over all tokens, which decides the cost but not the result.
A query's bound for a group is the number of its prefix tokens in the group's union;
only groups that reach ``k`` are opened, and the query is compared with their members.

Tokens are 48-bit hashes. Defined cases: null or blank text has an empty set and no
link; fewer words than ``n`` make one n-gram; a null id gets no link and a null
component; rows of one id are one node; without rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import spans
from parley.llm.graph import components, small
from parley.session import persist

U = np.uint64
BITS, MINIMA, AGREE, SHARED = 48, 8, 4, 4
#: sets of one list when groups are opened
LIST = 64
SKETCH_BITS, SKETCH_PARTS = 20, 16
SEEDS = np.array([(0xA24BAED4963EE407 * (2 * j + 1)) % (1 << 64) for j in range(MINIMA)], U)
PROFILE = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("minima", pa.list_(pa.int64())), ("part", pa.int32()), ("counts", pa.binary())])
PROFILE_SQL = "id long, n long, s1 long, s2 long, minima array<long>, part int, counts binary"


def sets(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of every distinct n-gram of the rows, sorted; bounds of the rows are found by search."""
    block = spans.Block(part.column("text"), lower=True)
    block.words()
    h, row = block.hashes(), block.row_of_word()
    g = spans.windows(h, n)
    ok = spans.inside(block.bounds, n, len(g))
    rows, values = row[: len(g)][ok], g[ok]
    for r in np.flatnonzero((block.n_words > 0) & (block.n_words < n)):
        whole = spans.windows(h[block.bounds[r] : block.bounds[r + 1]], int(block.n_words[r]))
        rows, values = np.append(rows, r), np.append(values, whole[0] ^ U(int(block.n_words[r])))
    return spans.dense(rows, values, BITS)


def _sketch(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U(BITS - SKETCH_BITS)).astype(np.int64)


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for whole in batches:
            for part in spans.blocks(whole):
                row, token = sets(part, n)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                counts += np.bincount(_sketch(token), minlength=len(counts)).astype(np.uint32)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                s1, s2 = np.zeros(part.num_rows, U), np.zeros(part.num_rows, U)
                minima = np.zeros((part.num_rows, MINIMA), U)
                if len(some):
                    at = bounds[:-1][some]
                    s1[some] = np.add.reduceat(spans.mix(token + U(1)), at)
                    s2[some] = np.add.reduceat(spans.mix(token ^ U(0x5851F42D4C957F2D)), at)
                    for j in range(MINIMA):
                        minima[some, j] = np.minimum.reduceat(spans.mix(token ^ SEEDS[j]), at)
                lists = pa.ListArray.from_arrays(np.arange(0, part.num_rows * MINIMA + 1, MINIMA, dtype=np.int32), minima.view(np.int64).ravel())
                none = [None] * part.num_rows
                yield spans.batch(PROFILE, [part.column("id"), size, s1.view(np.int64), s2.view(np.int64), lists, none, none])
        for p, piece in enumerate(np.split(counts, SKETCH_PARTS)):
            yield spans.batch(PROFILE, [[None], [None], [None], [None], [None], [p], [spans.pack(piece)]])

    return run


def _add_counts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64)
    for b in batches:
        for x in b.column("counts"):
            total += spans.unpack(x.as_py())[0]
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([spans.pack(total)], pa.binary())], ["part", "counts"])


def _bodies(n: int):
    """id and set of each row, as 6-byte tokens in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in spans.blocks(whole):
                row, token = sets(part, n)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                raw = np.ascontiguousarray(token).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([raw[6 * a : 6 * b] for a, b in zip(bounds, bounds[1:])], pa.binary())], ["id", "body"])

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, and sizes of intersection and union, for rows with both sets."""
    for b in batches:
        inter, union = [], []
        for x, y in zip(b.column("body_a"), b.column("body_b"), strict=True):
            x, y = (np.frombuffer(v.as_py(), np.uint8).reshape(-1, 6) for v in (x, y))
            both = np.zeros((len(x) + len(y), 8), np.uint8)
            both[: len(x), :6], both[len(x) :, :6] = x, y
            v = both.view(np.int64).ravel()
            v.sort()
            inter.append(int((v[1:] == v[:-1]).sum()))
            union.append(len(v) - inter[-1])
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "inter", "all"])


def _prefixes(n: int, percent: int, shards: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = np.frombuffer(sketch.value, np.uint8)
        for whole in batches:
            tokens, ids = [], []
            for part in spans.blocks(whole):
                row, token = sets(part, n)
                order = np.argsort((row.astype(U) << U(BITS)) | (rarity[_sketch(token)].astype(U) << U(42)) | (token & U((1 << 42) - 1)))
                row, token = row[order], token[order]
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                size = np.diff(bounds)
                need = -(-percent * size // 100)
                length = np.where(size > 0, size - need + np.minimum(SHARED, need), 0)
                # of rows with equal sets one is enough; equal sets have equal prefixes and sizes
                at = np.repeat(bounds[:-1], length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                tokens.append(token[at])
                ids.append(np.repeat(part.column("id").to_numpy(zero_copy_only=False), length))
            if not tokens:
                continue
            token, owner = np.concatenate(tokens), np.concatenate(ids)
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            cuts = spans.shard_cuts(token, shards, BITS)
            names = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([spans.pack(np.diff(token[cuts[s] : cuts[s + 1]], prepend=U(0)), owner[cuts[s] : cuts[s + 1]]) for s in names], pa.binary())], ["shard", "body"])

    return run


@spans.giving_back
def _shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one token range: (token, id) where two sets or more have the token."""
    packs = [spans.unpack(x.as_py()) for x in table.column("body")]
    token = np.concatenate([np.cumsum(p[0], dtype=U) for p in packs])
    owner = np.concatenate([p[1] for p in packs])
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    same = token[1:] == token[:-1]
    keep = np.append(same, False) | np.append(False, same)
    return pa.table({"token": pa.array(token[keep].astype(np.int64)), "id": pa.array(owner[keep], pa.int64())})


def _verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Only the texts named by a pair are read into sets."""
    pairs = persist(pairs, "pairs")
    need = persist(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), "need")
    body = docs.join(small(need), "id").mapInArrow(_bodies(n), "id long, body binary")
    both = pairs.join(body.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
    both = both.join(body.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
    out = both.select("a", "b", "body_a", "body_b").mapInArrow(_overlap, "a long, b long, inter long, all long")
    return persist(out.where(F.col("inter") * 100 >= F.col("all") * percent).select("a", "b").distinct(), "links")


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """(grp, name, rows): the rows (id, grp, body) of each group in lists of about ``LIST`` by id hash."""
    counts = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("of"))
    at = F.pmod(F.xxhash64("id"), F.col("of")).alias(name)
    return rows.join(counts, "grp").groupBy("grp", "of", at).agg(F.collect_list(F.struct("id", "body")).alias(f"{name}s"))


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b) for each query of a list and the members of the other list that are similar enough, or the first."""
        for batch in batches:
            found: list[tuple[int, int]] = []
            for queries, members, every in zip(batch.column("qs"), batch.column("ms"), batch.column("open").to_pylist(), strict=True):
                members = members.as_py()
                bodies = [np.frombuffer(m["body"], np.uint8).reshape(-1, 6) for m in members]
                size = np.array([len(x) for x in bodies])
                wide = np.zeros((int(size.sum()), 8), np.uint8)
                wide[:, :6] = np.concatenate(bodies)
                token, owner = wide.view(U).ravel(), np.repeat(np.arange(len(size)), size)
                for q in queries.as_py():
                    mine = np.zeros((len(q["body"]) // 6, 8), np.uint8)
                    mine[:, :6] = np.frombuffer(q["body"], np.uint8).reshape(-1, 6)
                    inter = np.bincount(owner[spans.member(token, mine.view(U).ravel()) >= 0], minlength=len(size))
                    ok = np.flatnonzero(inter * 100 >= (size + len(mine) - inter) * percent)
                    found += [(q["id"], members[i]["id"]) for i in (ok if every else ok[:1]).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return run


def _opened(docs: DataFrame, queries: DataFrame, groups: DataFrame, n: int, percent: int) -> DataFrame:
    """Links of queries (id, grp) to members of the group each has opened, list against list.

    One link a list is enough where the members of a group are connected already.
    """
    members = groups.join(queries.select("grp").distinct(), "grp").select("id", "grp", "open")
    need = persist(queries.select("id").unionAll(members.select("id")).distinct(), "need")
    body = persist(docs.join(small(need), "id").mapInArrow(_bodies(n), "id long, body binary"), "bodies")
    asking = _blocks(queries.join(body, "id"), "q").drop("of")
    asked = _blocks(members.join(body, "id"), "m").join(members.select("grp", "open").distinct(), "grp")
    lists = asking.join(asked.select("grp", "m").distinct(), "grp").join(asked.drop("of"), ["grp", "m"])
    return persist(lists.select("qs", "ms", "open").mapInArrow(_compare(percent), "a long, b long").distinct(), "links")


def _grouped(reps: DataFrame, links: DataFrame, near: DataFrame) -> DataFrame:
    """(id, size, comp, grp, open) of every representative.

    ``comp`` is its component so far. Sets that no link holds but that look like one
    pivot (``near``: id, pivot) stand in groups of about ``LIST`` of the same pivot;
    such a group is ``open``, its members may link with each other.
    """
    found = components(links)
    all_ = reps.join(found, "id", "left").select("id", "size", F.coalesce("component", "id").alias("comp"))
    sizes = found.select(F.col("component").alias("comp")).distinct().withColumn("linked", F.lit(True))
    all_ = persist(all_.join(sizes, "comp", "left").select("id", "size", "comp", F.coalesce("linked", F.lit(False)).alias("linked")), "components")
    loose = persist(all_.where("not linked").join(near, "id").select("id", "pivot"), "loose")
    of = loose.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("of"))
    loose = loose.join(of, "pivot").select("id", F.concat_ws(":", F.lit("near"), "pivot", F.pmod(F.xxhash64("id"), "of")).alias("near"))
    out = all_.join(loose, "id", "left").select("id", "size", "comp", F.coalesce("near", F.col("comp").cast("string")).alias("grp"), F.col("near").isNotNull().alias("open"))
    return persist(out, "groups")


def similar_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id (``doc_id``), ``n_shingles`` and ``component_id``.

    Two rows link when intersection * 100 >= union * percent over their sets of distinct
    word n-grams (A-Z lowered); a component is the smallest id reachable by links.
    """
    spark = docs.sparkSession
    shards = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile = persist(docs.mapInArrow(_profile(n), PROFILE_SQL), "profile")
    rows = profile.where("part is null")
    counts = profile.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(_add_counts, "part int, counts binary")
    # 2 ** SKETCH_BITS counters whatever the input
    pieces = {r.part: spans.unpack(bytes(r.counts))[0] for r in counts.collect()}
    total = np.concatenate([pieces[p] for p in range(SKETCH_PARTS)]) if pieces else np.zeros(1 << SKETCH_BITS, U)
    sketch = spark.sparkContext.broadcast(np.minimum(2 * np.log2(total + 1.0), 63).astype(np.uint8).tobytes())

    sized = rows.where("n > 0 and id is not null")
    classes = persist(sized.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.first("minima").alias("minima")), "classes")
    owner = persist(sized.join(classes.drop("minima"), ["n", "s1", "s2"]).select("id", "rep").distinct(), "owner")
    # an id on rows of several texts ties their sets together
    ties = owner.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b <> most")
    ties = owner.join(ties, "id").select(F.col("rep").alias("a"), "b").where("a <> b")
    reps = classes.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("size"))

    # groups: sets that share a minimum hash, compared with the one that shares most of its minima with others
    minima = classes.select(F.col("rep").alias("id"), "n", "minima", F.posexplode("minima").alias("j", "m"))
    common = persist(minima.groupBy("j", "m").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "minima")
    shared = minima.join(common, ["j", "m"])
    score = shared.groupBy("id").agg(F.sum("c").alias("score"))
    held = persist(shared.join(score, "id"), "held")
    pivots = held.groupBy("j", "m").agg(F.max_by(F.struct("id", "n", "minima"), F.struct("score", (-F.col("id")).alias("first"))).alias("p"))
    agree = F.size(F.filter(F.zip_with("minima", "p.minima", lambda x, y: x == y), lambda x: x))
    near = (F.least("n", "p.n") * 100 >= F.greatest("n", "p.n") * percent) & (F.col("agree") >= AGREE)
    met = held.join(pivots, ["j", "m"]).where(F.col("id") != F.col("p.id")).withColumn("agree", agree)
    pairs = met.where(near).select(F.col("id").alias("a"), F.col("p.id").alias("b")).distinct()
    alike = met.where(F.col("agree") >= AGREE - 1).groupBy("id").agg(F.max_by("p.id", F.struct("agree", -F.col("p.id"))).alias("pivot"))
    links = persist(_verified(docs, pairs, n, percent).unionAll(ties), "links")
    groups = _grouped(reps, links, alike)

    # the matrix: prefix tokens that two sets or more have, by representative and group
    packs = docs.where("id is not null").mapInArrow(_prefixes(n, percent, shards, sketch), "shard int, body binary")
    tokens = packs.groupBy("shard").applyInArrow(_shared, "token long, id long").join(groups, "id")
    wide = tokens.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    tokens = persist(tokens.join(wide, "token").distinct(), "tokens")
    members = groups.groupBy("grp", "open").agg(F.count(F.lit(1)).alias("count"), F.min("size").alias("least"), F.max("size").alias("most"))
    members = persist(members.join(tokens.select("grp").distinct(), "grp"), "members")
    unions = tokens.select("token", "grp").distinct().join(members, "grp")
    ask = tokens.drop("open").join(members.select("grp", "count"), "grp").select("token", F.col("id").alias("a"), "size", F.col("grp").alias("own"), F.col("count").alias("own_count"))
    need = F.least(F.lit(SHARED), F.ceil(F.col("size") * percent / 100))
    # of two groups the smaller one asks; an open group also asks itself
    turn = (F.struct("own_count", "own") < F.struct("count", "grp")) | (F.col("open") & (F.col("own") == F.col("grp")))
    fits = (F.col("most") * 100 >= F.col("size") * percent) & (F.col("size") * 100 >= F.col("least") * percent)
    bound = ask.join(unions, "token").where(turn & fits).groupBy("a", "size", "grp").agg(F.count(F.lit(1)).alias("bound"))
    least_need = F.least(need, F.ceil(F.col("least") * percent / 100))
    opened = bound.join(members.select("grp", "least"), "grp").where(F.col("bound") >= least_need).select("a", F.col("size").alias("mine"), "grp")
    more = _opened(docs, persist(opened.select(F.col("a").alias("id"), "grp").distinct(), "opened"), groups, n, percent)

    # what was opened joins whole groups
    name = lambda end: groups.select(F.col("id").alias(end), F.col("comp").alias(f"g{end}"))
    joined = components(more.join(name("a"), "a").join(name("b"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    final = groups.join(joined.select(F.col("id").alias("comp"), "component"), "comp", "left").select(F.col("id").alias("rep"), F.coalesce("component", "comp").alias("component"))
    # the smallest id of a component is a representative, so its name is the component's
    final = owner.join(final, "rep").groupBy("id").agg(F.min("component").alias("component_id"))
    result = rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles")).join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return result.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
