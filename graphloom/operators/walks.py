"""Random walks with restart, and neighbours selected from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import cosine, node_type, portable_hash
from graphloom.operators.encode import dense_numbers
from graphloom.operators.rank import numbered_cosines
from graphloom.plans.scratch import bucketed, made, release, scratch

CORE, TOP = ("publication", "dataset"), ("author", "organization", "venue")
#: Steps of walks that are on disk at once, at most, where walks are made for some seeds after others.
STEPS = 30_000_000
TOP_ORDER, KEY_ORDER = ("author", "venue", "organization"), ("keyword", "entity", "topic_keyword", "topic")


def _draw(m: Column, start: int, digits: int) -> Column:
    """A whole number from some hexadecimal digits of a hash; any SQL engine can repeat it."""
    return F.conv(F.substring(m, start, digits), 16, 10).cast("long")


def numbered_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All directed edges of the undirected graph in one numbering by (node, neighbour): (node, first, size), and
    (at, next). A neighbour is looked up by one number, so a hub is no group and no array."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("next")).union(edges.select("target", "source"))
    places = dense_numbers(both, ["node", "next"], "at", once=True)  # written there
    return scratch(places.groupBy("node").agg(F.min("at").alias("first"), F.count("*").alias("size"))), places


def random_walks(seeds: DataFrame, edges: DataFrame, walks: int = 20, length: int = 15, restart: float = 0.1, p: float = 1.0, q: float = 0.3, salt: int = 0, tries: int = 8) -> DataFrame:
    """walks walks of length nodes from each seed: seed, walk, path. A seed that is there twice walks once.

    A step goes back to the seed with chance restart, else to a neighbour: weights 1/p for the node before,
    1 for its neighbours, 1/q for all others, by rejection: neighbours are proposed evenly and accepted with a chance
    in proportion to their weight, some tries at a time until one is. Draws come from md5 of seed, walk, step, try and
    salt. A walk at a node without neighbours stays. Each step is written, so a lost executor repeats one step.
    """
    nodes, places = numbered_edges(edges)
    known = scratch(edges.select(F.col("source").alias("prev"), F.col("target").alias("next")).union(edges.select("target", "source")).distinct().withColumn("near", F.lit(True)))
    start = seeds.select("seed").distinct().withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))))
    # The numbers of step and round are data, so that every step runs the same compiled plan.
    front = scratch(start.withColumns({"step": F.lit(1), "round": F.lit(0), "prev": F.lit(None).cast("string"), "cur": F.col("seed")}))
    trace = front.select("seed", "walk", F.lit(0).alias("step"), F.col("cur").alias("node"))
    for _ in range(1, length):
        pending, moved, left = front, None, True
        while left:
            rows = scratch(_proposals(pending, nodes, places, known, tries, restart, p, q, salt))
            done = rows.where("got IS NOT NULL").select("seed", "walk", (F.col("step") + 1).alias("step"), (F.col("round") * 0).alias("round"), F.col("cur").alias("prev"), F.col("got.next").alias("cur"))
            moved = done if moved is None else moved.unionByName(done)
            # The first try of the first round is a phase of its own, as it is mostly accepted; of one try there are no others.
            again = F.col("round") + (F.when(F.col("round") == 0, 2).otherwise(1) if tries == 1 else 1)
            pending = rows.where("got IS NULL").select("seed", "walk", "step", again.alias("round"), "prev", "cur")
            left = not pending.isEmpty()
        front = moved
        trace = trace.unionByName(front.select("seed", "walk", (F.col("step") - 1).alias("step"), F.col("cur").alias("node")))
    paths = trace.groupBy("seed", "walk").agg(F.sort_array(F.collect_list(F.struct("step", "node"))).alias("steps"))  # length rows each
    return paths.select("seed", "walk", F.col("steps.node").alias("path"))


def _proposals(front: DataFrame, nodes: DataFrame, places: DataFrame, known: DataFrame, tries: int, restart: float, p: float, q: float, salt: int) -> DataFrame:
    """The walks (seed, walk, step, round, prev, cur) with got.next, the first accepted of some proposals, or null.
    Round r has tries * 4**r proposals (r up to 4), numbered from 1000 r. Here round 0 is the first proposal of it, 1 its others, and
    the next ones are a number later."""
    most = max(1 / p, 1.0, 1 / q)
    at = front.join(nodes.withColumnRenamed("node", "cur"), "cur", "left")
    home = _draw(F.md5(F.concat_ws(":", "seed", "walk", "step", F.lit(salt)).cast("binary")), 1, 12) < int(restart * (1 << 48))
    at = at.withColumn("fixed", F.when(home, F.col("seed")).when(F.col("size").isNull(), F.col("cur")))
    later = tries * F.pow(F.lit(4), F.least(F.col("round") - 1, F.lit(4))).cast("int")
    many = F.when(F.col("fixed").isNotNull() | (F.col("round") == 0), 1).when(F.col("round") == 1, tries - 1).otherwise(later)
    first = F.when(F.col("round") <= 1, F.col("round")).otherwise((F.col("round") - 1) * 1000)
    drawn = at.withColumn("try", F.explode(F.sequence(first, first + many - 1)))
    drawn = drawn.withColumn("m", F.md5(F.concat_ws(":", "seed", "walk", "step", F.lit(salt), "try").cast("binary")))
    drawn = drawn.withColumn("at", F.when(F.col("fixed").isNull(), F.col("first") + _draw(F.col("m"), 1, 12) % F.col("size")))
    found = drawn.join(places.select("at", "next"), "at", "left").join(known, ["prev", "next"], "left")
    weight = F.when(F.col("prev").isNull() | (F.col("size") == 1), most).when(F.col("next") == F.col("prev"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
    accepted = F.col("fixed").isNotNull() | (_draw(F.col("m"), 13, 12) < weight / most * (1 << 48))
    option = F.when(accepted, F.struct("try", F.coalesce("fixed", "next").alias("next")))
    return found.groupBy("seed", "walk", "step", "round", "prev", "cur").agg(F.min(option).alias("got"))


def numbered_links(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, first, size) of the numbered edges, and (at, next, first, size): each link with the numbers of the
    node that it leads to, in buckets by at. A step looks a link up by its number alone, so a hub is many keys."""
    before = made()
    nodes, places = numbered_edges(edges)
    links = bucketed(places.join(nodes.withColumnRenamed("node", "next"), "next").select("at", "next", "first", "size"), "at")
    release(edges.sparkSession, but_last=2, since=before)
    return nodes, links


def uniform_walks(seeds: DataFrame, edges: DataFrame | None, walks: int, length: int, salt: int = 0, every: int = 4, graph: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """First-order walks without restart; neighbour i of n, in their order, is picked by hash % n. seed, walk, path. A walk
    at a node without neighbours ends there. A step is a join on the link's number, for which only the walks are
    shuffled; they are written every few steps, and what was written before goes. graph: the edges' numbered_links, if made."""
    nodes, links = graph or numbered_links(edges)
    links = links.select(F.col("at"), F.col("next"), F.col("first").alias("next_first"), F.col("size").alias("next_size"))
    before = made()
    front = seeds.select("seed", "number").join(nodes.withColumnRenamed("node", "seed"), "seed", "left")
    front = front.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))).withColumn("path", F.array("seed")).drop("seed")
    for step in range(1, length):
        h = portable_hash(F.col("number") * 1000 + F.col("walk") * 50 + step, salt)
        at = front.withColumn("at", F.col("first") + h % F.col("size")).drop("first", "size").hint("shuffle_hash").join(links, "at", "left")
        path = F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next")))
        front = at.select("number", "walk", path.alias("path"), F.col("next_first").alias("first"), F.col("next_size").alias("size"))
        if step % every == 0:
            front = scratch(front)
            release(front.sparkSession, but_last=1, since=before)
    return front.select(F.get("path", F.lit(0)).alias("seed"), "walk", "path")


def by_groups(seeds: DataFrame, steps: int, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What run returns for the seeds (seed, ...), of which each takes so many steps. Seeds are dealt to groups of STEPS steps at most on
    average; a group's result is written, and all that was written on its way goes before the next one."""
    groups, out = max(1, -(-seeds.count() * steps // STEPS)), None
    for i in range(groups):
        before = made()
        rows = scratch(run(seeds.where(F.pmod(F.xxhash64("seed"), F.lit(groups)) == i)))
        release(seeds.sparkSession, but_last=1, since=before)
        out = rows if out is None else out.unionByName(rows)
    return out


def walk_steps(walks: DataFrame) -> DataFrame:
    """Nodes of each walk after its seed, repeats left out: seed, walk, node, distance (from 1), grp (core, top
    or key), penalty (1 / distance)."""
    steps = walks.select("seed", "walk", F.posexplode(F.array_distinct("path")).alias("distance", "node")).where("distance > 0")
    kind = node_type(F.col("node"))
    grp = F.when(kind.isin(*CORE), "core").when(kind.isin(*TOP), "top").otherwise("key")
    return steps.select("seed", "walk", "node", "distance", grp.alias("grp"), (1.0 / F.col("distance")).alias("penalty"))


def walk_scores(steps: DataFrame, vectors: DataFrame | Callable[[Column], Column], table: DataFrame | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The steps with a score: for core nodes the cosine of seed and node (id, x), for others the penalty. With a
    table (vec, x) the nodes have numbers of vectors, (id, vec) or a function of the id, and no step is shuffled with a vector.
    keep: the columns of steps (with grp and penalty) that are returned, by default all."""
    kept = list(keep or steps.columns)
    if table is None:
        v = vectors.select("id", "x")
        core = steps.where("grp = 'core'").join(v.select(F.col("id").alias("seed"), F.col("x").alias("sx")), "seed").join(v.select(F.col("id").alias("node"), F.col("x").alias("nx")), "node")
        core = core.select(*kept, cosine(F.col("sx"), F.col("nx")).alias("score"))
    elif callable(vectors):
        core = steps.where("grp = 'core'").select(*kept, vectors(F.col("seed")).alias("va"), vectors(F.col("node")).alias("vb")).dropna(subset=["va", "vb"])
        core = numbered_cosines(scratch(core), table).select(*kept, "score")
    else:
        v = vectors.select("id", "vec")
        core = steps.where("grp = 'core'").join(v.select(F.col("id").alias("seed"), F.col("vec").alias("va")), "seed").join(v.select(F.col("id").alias("node"), F.col("vec").alias("vb")), "node")
        core = numbered_cosines(scratch(core.select(*kept, "va", "vb")), table).select(*kept, "score")
    return core.unionByName(steps.where("grp <> 'core'").select(*kept, F.col("penalty").alias("score")))


def walk_importance(scored: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """Mean over the core nodes of a walk of score times penalty; 0 without one. seed, walk, importance. walks: (seed,
    walk), of which those without any scored step have importance 0 too."""
    mean = F.avg(F.when(F.col("grp") == "core", F.col("score") * F.col("penalty")))
    found = scored.groupBy("seed", "walk").agg(F.coalesce(mean, F.lit(0.0)).alias("importance"))
    if walks is None:
        return found
    return walks.select("seed", "walk").join(found, ["seed", "walk"], "left").fillna(0.0, ["importance"])


def selected_steps(scored: DataFrame, n_core: int, n_key: int, n_top: int, least: int = 5, most: int = 19) -> DataFrame:
    """The steps of selected_walks with place and m. Rows are shuffled once, by seed; all else is windows of a seed's steps."""
    seed = lambda *c: Window.partitionBy("seed", *c)
    rows = scored.repartition("seed")
    mean = F.avg(F.when(F.col("grp") == "core", F.col("score") * F.col("penalty"))).over(seed("walk"))
    rows = rows.withColumn("__importance", F.round(F.coalesce(mean, F.lit(0.0)), 9))
    rows = rows.withColumn("place", F.dense_rank().over(seed().orderBy(F.desc("__importance"), "walk")))
    # The group's quota is met at the place where its n-th distinct node first shows up.
    rows = rows.withColumn("__first", F.row_number().over(seed("grp", "node").orderBy("place")) == 1)
    rows = rows.withColumn("__n", F.sum(F.col("__first").cast("int")).over(seed("grp").orderBy("place", "node").rowsBetween(Window.unboundedPreceding, 0)))
    met = [F.max(F.when((F.col("grp") == g) & F.col("__first") & (F.col("__n") == n), F.col("place"))).over(seed()) for g, n in (("core", n_core), ("key", n_key), ("top", n_top)) if n]
    # A quota that is not met is null, and greatest would leave it out.
    last = F.greatest(F.lit(least), F.lit(least), *[F.coalesce(m, F.lit(most)) for m in met])
    rows = rows.withColumn("m", F.least(F.lit(most), last))
    return rows.where(F.col("place") <= F.col("m")).drop("__importance", "__first", "__n")


def selected_walks(scored: DataFrame, n_core: int, n_key: int, n_top: int, least: int = 5, most: int = 19) -> DataFrame:
    """The best walks of each seed: the smallest m from least to most such that the m best walks (ties: smaller
    number) hold enough distinct nodes of each group, else most. seed, walk, place, m."""
    return chosen_walks(selected_steps(scored, n_core, n_key, n_top, least, most))


def chosen_walks(steps: DataFrame) -> DataFrame:
    """The walks of selected_steps: seed, walk, place, m."""
    return steps.groupBy("seed", "walk").agg(F.first("place").alias("place"), F.first("m").alias("m"))


def neighborhoods(seeds: DataFrame, edges: DataFrame, walks: int, length: int, vectors: tuple[Callable[[Column], Column], DataFrame], result: Callable[[DataFrame], DataFrame], salt: int = 0, keep: tuple[str, ...] = ("seed", "walk", "node", "grp", "penalty")) -> DataFrame:
    """result of the scored steps (keep, score) of uniform walks from the seeds (seed, number), some seeds after others.
    vectors: the function and the table of walk_scores."""
    graph = numbered_links(edges)

    def run(part: DataFrame) -> DataFrame:
        found = scratch(uniform_walks(part, None, walks, length, salt, graph=graph))
        return result(walk_scores(walk_steps(found), *vectors, keep))

    return by_groups(seeds, walks * length, run)


def best_neighbors(scored: DataFrame, chosen: DataFrame | None, grp: str, n: int | None) -> DataFrame:
    """Nodes of a group in the chosen walks with their best score, by score and id downward: seed, node, score, rank.
    Without chosen the steps are those of chosen walks already (selected_steps)."""
    rows = scored.where(F.col("grp") == grp)
    rows = rows if chosen is None else rows.join(chosen.select("seed", "walk"), ["seed", "walk"])
    best = rows.groupBy("seed", "node").agg(F.max(F.round("score", 9)).alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), F.desc("node"))))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def cross_type_first(core: DataFrame, n: int) -> DataFrame:
    """Core neighbours, those of the other type than the seed first, cut to n."""
    other = node_type(F.col("node")) != node_type(F.col("seed"))
    order = Window.partitionBy("seed").orderBy(F.desc(other), F.desc("score"), F.desc("node"))
    return core.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def in_type_order(best: DataFrame, kinds: tuple[str, ...], n: int) -> DataFrame:
    """The n best neighbours (seed, node, score, rank) of each seed, by type in the given order and in a type by score and
    id downward: seed, node, score, rank. Nodes of other types are left out."""
    kind = node_type(F.col("node"))
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.coalesce(kind, F.lit("")))
    chosen = best.where(F.col("rank") <= n).withColumn("__kind", place).where("__kind > 0")
    order = Window.partitionBy("seed").orderBy("__kind", F.desc("score"), F.desc("node"))
    return chosen.select("seed", "node", "score", F.row_number().over(order).alias("rank"))


def padded(neighbors: DataFrame, seeds: DataFrame, n: int, width: int, vectors: DataFrame | None = None) -> DataFrame:
    """n rows for each seed: missing ranks are ('pad', -1, zeros)."""
    spine = seeds.select("seed").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(n))))
    rows = spine.join(neighbors.select("seed", "rank", "node", "score"), ["seed", "rank"], "left")
    if vectors is not None:
        rows = rows.join(vectors.select(F.col("id").alias("node"), "x"), "node", "left").withColumn("x", F.coalesce("x", F.array_repeat(F.lit(0.0), width)))
    return rows.withColumns({"node": F.coalesce("node", F.lit("pad")), "score": F.coalesce("score", F.lit(-1.0))})
