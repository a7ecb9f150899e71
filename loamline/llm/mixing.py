"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to) to a table of token capacities,
which is as long as there are patterns. A flow routes these capacities to the sources' quotas: a pattern can be taken
once at no cost, a second time at a cost and a third at a greater one (convex), so the flow repeats documents only where
quotas can't be met otherwise, and evenly. How often a document is then taken follows from its pattern's flow: so many
whole rounds, and in a last round a seeded choice of whole documents.

That choice is a prefix of the pattern's documents in the order of a seeded hash. Its end is found by counting sizes in
hash buckets, and then row by row in the one bucket in which it lies; what is left because a document at the end is too
large is filled in the same way from the smaller ones behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loamline.llm.common import WORD, keep, text_of

#: Most membership patterns and sources that a mix may have: what the flow, on the driver, gets to see.
MAX_PATTERNS = 100_000
BUCKETS = 1 << 14
HASH_BITS = 62
#: What is taken in a last round: documents of a size at most, with a hash above one and up to another.
RUNS = "runs array<struct<size: bigint, above: bigint, upto: bigint>>"


def reshared(sizes: dict, weights: dict, most: int) -> dict:
    """Targets in the ratio of the weights that sum to all sizes, none above most times its source's size: the excess is
    shared anew by weight until none is above."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed}
        left, weight = total - sum(fixed.values()), sum(free.values())
        targets = {s: left * w / weight for s, w in free.items()}
        over = {s: float(most * sizes[s]) for s, x in targets.items() if x > most * sizes[s]}
        if not over:
            return {s: float(x) for s, x in (fixed | targets).items()}
        fixed |= over
        if len(fixed) == len(weights):
            return fixed


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], rounds: int) -> list[list[int]]:
    """flow[p][k]: tokens of pattern p that go to its k-th member source. Arcs: start to pattern, one for each round at the
    round's number as cost; pattern to its sources; source to end.

    Only the arcs from the start cost anything and a shortest path leaves the start once, so the paths of cost k are those
    that begin with an arc of round k: a round's room is added and filled by blocking flows, round after round, which is
    the cheapest flow. 100,000 patterns over 24 sources took 3 seconds."""
    n_p, n_s = len(capacity), len(quota)
    given = list(quota)  # room left from each source to the end
    flow = [[0] * len(own) for own in members]
    holders: list[list[tuple[int, int]]] = [[] for _ in range(n_s)]
    for p, own in enumerate(members):
        for k, s in enumerate(own):
            holders[s].append((p, k))
    order = sorted(range(n_p), key=lambda p: -len(members[p]))  # of equal costs: those with the most ways first
    for _ in range(rounds):
        room = list(capacity)  # from the start to each pattern, in this round
        while True:
            # how many steps each source is from one with room left, by taking back from a pattern that feeds it
            far = [0 if g > 0 else -1 for g in given]
            level = [s for s in range(n_s) if given[s] > 0]
            reach = [-1] * n_p  # the same of patterns
            while level:
                following = []
                for s in level:
                    for p, _ in holders[s]:
                        if reach[p] < 0:
                            reach[p] = far[s]
                            for k, other in enumerate(members[p]):
                                if far[other] < 0 and flow[p][k] > 0:
                                    far[other] = far[s] + 1
                                    following.append(other)
                level = following
            at_source = [0] * n_s  # arcs that were found to be of no use in this phase
            at_pattern = [0] * n_p
            moved = 0
            for first in order:
                while room[first] > 0 and reach[first] >= 0:
                    # a path of patterns and sources, downwards in the steps
                    path, p, s = [], first, -1
                    while True:
                        own, i = members[p], at_pattern[p]
                        while i < len(own) and not far[own[i]] == reach[p]:
                            i += 1
                        at_pattern[p] = i
                        if i < len(own):
                            s = own[i]
                            path.append((p, i))
                            if given[s] > 0 and far[s] == 0:
                                break
                            below, j = holders[s], at_source[s]
                            while j < len(below) and not (reach[below[j][0]] == far[s] - 1 and flow[below[j][0]][below[j][1]] > 0):
                                j += 1
                            at_source[s] = j
                            if j < len(below):
                                path.append(below[j])
                                p = below[j][0]
                                continue
                            path.pop()
                            at_pattern[p] += 1
                        elif path:
                            path.pop()  # the arc that led here
                            at_source[members[path[-1][0]][path[-1][1]]] += 1
                            p = path.pop()[0]
                        else:
                            path = []
                            break
                    if not path:
                        break
                    # forward arcs stand at even places, those that take back at odd ones
                    most = min([room[first], given[s], *(flow[q][k] for q, k in path[1::2])])
                    for at, (q, k) in enumerate(path):
                        flow[q][k] += most if at % 2 == 0 else -most
                    room[first] -= most
                    given[s] -= most
                    moved += most
            if not moved:
                break
    return flow


def last_rounds(rows: DataFrame, need: dict[int, int], passes: int) -> tuple[dict[int, list[tuple[int, int, int]]], dict[int, int]]:
    """Which documents of (pattern, size, h) are in their pattern's last round, which is to have need[pattern] words: for
    each pattern (size at most, h above, h at most) of those that are, and the h of one more.

    What comes to the driver and goes back, by a broadcast join, is a row for each pattern, MAX_PATTERNS at most. A window
    is over the buckets of a pattern or over the documents of one bucket, never over a pattern's documents."""
    spark = rows.sparkSession
    joined = lambda values, shape: rows.join(F.broadcast(spark.createDataFrame(values, f"pattern int, {shape}")), "pattern")
    runs: dict[int, list[tuple[int, int, int]]] = {p: [] for p in need}
    behind: dict[int, int] = dict.fromkeys(need, -1)  # documents up to this hash are decided
    for _ in range(passes):
        need = {p: n for p, n in need.items() if n > 0}
        if not need:
            break
        small = (F.col("size") > 0) & (F.col("size") <= F.col("need")) & (F.col("h") > F.col("behind"))
        fit = joined([(p, n, behind[p]) for p, n in need.items()], "need bigint, behind bigint").where(small).withColumn("bucket", F.shiftright("h", HASH_BITS - 14))
        sums = fit.groupBy("pattern", "bucket", "need").agg(F.sum("size").alias("s")).withColumn("upto", F.sum("s").over(Window.partitionBy("pattern").orderBy("bucket")))
        before = F.struct("bucket", (F.col("upto") - F.col("s")).alias("before"))
        found = sums.groupBy("pattern").agg(F.sum("s").alias("total"), F.min_by(F.when(F.col("upto") >= F.col("need"), before), F.when(F.col("upto") >= F.col("need"), F.col("bucket"))).alias("x")).select("pattern", "total", "x.*").collect()
        ends = {r.pattern: (r.bucket, r.before) for r in found if r.bucket is not None}
        whole = {r.pattern: r.total for r in found}
        last = {}
        if ends:
            inside = joined([(p, need[p], behind[p], *x) for p, x in ends.items()], "need bigint, behind bigint, bucket bigint, before bigint").where(small & (F.shiftright("h", HASH_BITS - 14) == F.col("bucket")))
            upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)) + F.col("before")
            last = {r.pattern: (r.h, r.upto) for r in inside.withColumn("upto", upto).where(F.col("upto") <= F.col("need")).groupBy("pattern").agg(F.max("h").alias("h"), F.max("upto").alias("upto")).collect()}
        for p, n in list(need.items()):
            limit, taken = (1 << HASH_BITS) - 1, whole.get(p, 0)
            if p in ends:
                limit, taken = last.get(p, ((ends[p][0] << (HASH_BITS - 14)) - 1, ends[p][1]))
            runs[p].append((n, behind[p], limit))
            need[p], behind[p] = n - taken, max(behind[p], limit)
    # what is still missing is less than any document left: one more comes in where that brings the sum nearer
    missing = [(p, n, runs[p]) for p, n in need.items() if n > 0]
    if not missing:
        return runs, {}
    left = joined(missing, f"missing bigint, {RUNS}").where(~in_runs() & (F.col("size") > 0) & (F.col("size") < 2 * F.col("missing")))
    nearer = left.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")).alias("gap"), "h")).alias("x")).collect()
    return runs, {r.pattern: r.x.h for r in nearer}



def in_runs() -> Column:
    return F.exists("runs", lambda r: (F.col("size") <= r["size"]) & (F.col("h") > r["above"]) & (F.col("h") <= r["upto"]))


def mix(docs: DataFrame, sources: Column, size: Column, id_column: str = "doc_id", weights: dict | None = None, most: int = 3, seed: int = 17, passes: int = 4, extra: list[Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, size, sources, repeats, taken (= repeats * size), source_size and target (of its first
    source) and extra columns.

    sources: array of the names of the sources a document belongs to, each a string or null (null is a source, the last;
    an empty array belongs to nowhere and is never taken). size: words, null for none. weights: for each source, by
    default 1, 2, 3, 1, 2, 3 and so on by code point. The targets share all sizes by weight; none is above most times its
    source's size. A document is taken most times at most. The hash that orders documents is of the seed and the id, and
    of the size and the sources, so reruns agree whatever the partitions; rows that are equal in all of these are taken or
    left together. Documents without words are never taken. An empty table gives an empty result. More than MAX_PATTERNS
    patterns are refused with an error: give coarser sources.
    """
    names = F.array_sort(F.array_distinct(sources.cast("array<string>")))
    h = F.shiftright(F.xxhash64(F.lit(seed), F.col(id_column), size, names), 1).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    all_ = docs.select(F.col(id_column).alias("doc_id"), names.alias("sources"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"), h.alias("h"), *(extra or []))
    slim = keep(all_.select("doc_id", "sources", "size", "h"))
    out = all_ if extra else slim  # what a document gets is told by its own columns, so texts needn't be kept with the sizes
    rows = slim.groupBy("sources").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns; give coarser sources")
    patterns = sorted(((list(r.sources), r.size) for r in rows if r.sources is not None and len(r.sources)), key=lambda x: [(s is None, s or "") for s in x[0]])
    known = sorted({s for own, _ in patterns for s in own}, key=lambda s: (s is None, s or ""))
    if not known:
        none = {"repeats": "int", "taken": "bigint", "source_size": "bigint", "target": "double"}
        return out.drop("h").withColumns({c: F.lit(0 if c in ("repeats", "taken") else None).cast(t) for c, t in none.items()})
    sizes = dict.fromkeys(known, 0)
    for own, n in patterns:
        for s in own:
            sizes[s] += n
    targets = reshared(sizes, weights or {s: 1 + k % 3 for k, s in enumerate(known)}, most)
    number = {s: k for k, s in enumerate(known)}
    flow = min_cost_flow([n for _, n in patterns], [[number[s] for s in own] for own, _ in patterns], [round(targets[s]) for s in known], most)
    taken = [sum(x) for x in flow]
    plan = [(own, p, *(divmod(taken[p], n) if n else (0, 0)), sizes[own[0]], targets[own[0]]) for p, (own, n) in enumerate(patterns)]
    shape = [T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("pattern", T.IntegerType()), T.StructField("rounds", T.IntegerType()), T.StructField("rest", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]
    spark = docs.sparkSession

    def numbered(df: DataFrame, table: DataFrame) -> DataFrame:
        """With the columns of their pattern, of a table that has a row for each pattern, MAX_PATTERNS at most."""
        return df.join(F.broadcast(table.withColumnRenamed("sources", "_own")), F.col("sources").eqNullSafe(F.col("_own")), "left").drop("_own")

    by_number = numbered(slim, spark.createDataFrame(plan, T.StructType(shape)).select("sources", "pattern"))
    runs, one_more = last_rounds(by_number.where("pattern IS NOT NULL").select("pattern", "size", "h"), {p: rest for _, p, _, rest, _, _ in plan}, passes)
    full = T.StructType([*shape, *T._parse_datatype_string(f"{RUNS}, one_more bigint").fields])
    chosen = numbered(out, spark.createDataFrame([(*x, runs[x[1]], one_more.get(x[1])) for x in plan], full))
    once_more = F.coalesce(in_runs() | F.coalesce(F.col("h") == F.col("one_more"), F.lit(False)), F.lit(False))
    repeats = F.when(F.col("size") > 0, F.coalesce("rounds", F.lit(0)) + F.when(once_more, 1).otherwise(0)).otherwise(0)
    return chosen.withColumn("repeats", repeats.cast("int")).withColumn("taken", (F.col("repeats") * F.col("size")).cast("bigint")).drop("h", "pattern", "rounds", "rest", "runs", "one_more")


def words(text_column: str = "text") -> Column:
    return F.regexp_count(text_of(text_column), F.lit(WORD)).cast("bigint")


def mix_documents(docs: DataFrame, source_column: str = "source", **options) -> DataFrame:
    """mix() of documents that each have one source, by their numbers of words: doc_id, size, source_size, target, taken,
    repeats. Null sources are one source."""
    return mix(docs, F.array(F.col(source_column)), words(), **options).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def mixed_rows(docs: DataFrame, source_column: str = "source", **options) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with its own columns."""
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    taken = mix(docs, F.array(F.col(source_column)), words(), extra=[whole], **options)
    return taken.where("repeats > 0").select(F.explode(F.sequence(F.lit(1), "repeats")), "row").select("row.*")
