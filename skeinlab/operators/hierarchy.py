"""Parent-child links to full hierarchies by tree contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlab.runtime import HOT_ROWS, Scratch, clean_id, ref_id, ref_type, salted_join

ACTIVE, RAKED, SPLICED = 0, 1, 2


def comment_nodes(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """One row per comment: comment_id, parent (a comment, null at the top), post (null if none is reached), stored.

    parent_id is taken from the earliest row that has one, and so is the stored depth. `t1_x` names comment x, `t3_x`
    post x, a bare x the comment x if there is one, else the post. A parent that no row has ends the walk.
    """
    rows = comments.select(clean_id("comment_id").alias("comment_id"), clean_id("parent_id").alias("ref"), "depth", "retrieved_at").where("comment_id is not null")
    one = rows.groupBy("comment_id").agg(
        F.min_by("ref", F.when(F.col("ref").isNotNull(), F.struct("retrieved_at", "ref"))).alias("ref"),
        F.min_by("depth", F.when(F.col("depth").isNotNull(), F.struct("retrieved_at", "depth"))).alias("stored"),
    )
    one = one.select("comment_id", "stored", ref_type(F.col("ref")).alias("type"), ref_id(F.col("ref")).alias("id"))
    known = (
        one.select(F.col("comment_id").alias("id"), F.lit(1).alias("c"), F.lit(0).alias("p"))
        .unionByName(posts.select(clean_id("post_id").alias("id"), F.lit(0).alias("c"), F.lit(1).alias("p")))
        .where("id is not null").groupBy("id").agg(F.max("c").alias("c"), F.max("p").alias("p"))
    )
    at = salted_join(one, known, "id")
    comment = (F.col("c") == 1) & F.coalesce(F.col("type") == "t1", F.lit(True))
    post = (F.col("p") == 1) & F.coalesce(F.col("type") == "t3", F.lit(True))
    return at.select("comment_id", F.when(comment, F.col("id")).alias("parent"), F.when(~F.coalesce(comment, F.lit(False)) & post, F.col("id")).alias("post"), "stored")


def _priority(c, turn: int):
    return F.xxhash64(F.col(c), F.lit(turn))


def contract(nodes: DataFrame, with_paths: bool = False, scratch: Scratch | None = None, with_sizes: bool = False) -> DataFrame:
    """node, parent, root -> comment_id, depth, root, state, and path and size if asked for.

    nodes: comment_id, parent, post; parent is null at the top. Each round rakes the leaves off and splices nodes with a
    single child out of chains (an independent set, chosen by hash priority), so a chain of n nodes needs O(log n)
    rounds; each removal is recorded with the node it then hangs on and the distance. When nothing more can be removed
    only self-loops are left: the contracted cycles. Running the records backwards gives every node its distance from
    the top (0 for a node without parent), its root (the post of its top node) and its state: `tree`, `cycle` (on a
    loop) or `below_cycle`; depth and root are null for the latter two. path lists the comments above the node, top
    first. size counts the node and all below it (null on loops): a raked node gives its count to the node it hangs on,
    a spliced one to its child's way up, and gets its own from the child when records run backwards, so no path is
    needed. Every join is on a key unique on at least one side; hot parents are salted.
    """
    spark = nodes.sparkSession
    scratch = scratch or Scratch(spark, "hierarchy")
    via_type = "array<string>"
    via = F.array().cast(via_type)
    lit_long = lambda x: F.lit(x).cast("long")
    top = nodes.where("parent is null").select(
        "comment_id", F.lit(0).alias("depth"), F.col("post").alias("root"), F.lit("tree").alias("state"), *([via.alias("path")] if with_paths else [])
    )
    kept = [*(["via"] if with_paths else []), *(["acc", "extra"] if with_sizes else [])]
    active = nodes.where("parent is not null").select(
        F.col("comment_id").alias("v"), F.col("parent").alias("p"), F.lit(1).alias("w"), *([via.alias("via")] if with_paths else []), *([lit_long(0).alias("acc"), lit_long(0).alias("extra")] if with_sizes else [])
    )
    raked = None
    record_paths: list[tuple[str, int]] = []
    turn = 0
    schema = None
    while True:
        turn += 1
        if with_sizes:
            below = active.select("p", "v", "extra", lit_long(0).alias("give"))
            if raked is not None:
                below = below.unionByName(raked.select("p", F.lit(None).cast("string").alias("v"), lit_long(0).alias("extra"), "give"))
            children = below.groupBy("p").agg(F.count("v").alias("n"), F.min(F.when(F.col("v").isNotNull(), F.struct("v", "extra"))).alias("c"), F.sum("give").alias("give"))
            children = children.select(F.col("p").alias("v"), F.when(F.col("n") > 0, F.col("n")).alias("n"), F.col("c.v").alias("only"), F.col("c.extra").alias("child_extra"), F.col("give").alias("got"))
        else:
            children = active.groupBy("p").agg(F.count("*").alias("n"), F.min("v").alias("only")).withColumnRenamed("p", "v")
        at = active.join(children, "v", "left")
        if with_sizes:
            at = at.withColumn("acc", F.col("acc") + F.coalesce("got", lit_long(0)))
        free = (F.col("n") == 1) & (F.col("only") != F.col("v")) & (_priority("v", turn) > _priority("only", turn)) & (_priority("v", turn) > _priority("p", turn)) & (F.col("p") != F.col("v"))
        at = at.withColumn("spliced", F.coalesce(free, F.lit(False)))
        lifts = at.where("spliced").select(
            F.col("only").alias("v"), F.col("v").alias("mid"), F.col("p").alias("q"), F.col("w").alias("more"), *([F.col("via").alias("via_q")] if with_paths else []), *([(1 + F.col("acc") + F.col("extra")).alias("between")] if with_sizes else [])
        )
        at = at.join(lifts, "v", "left")
        state = F.when(F.col("spliced"), SPLICED).when(F.col("n").isNull(), RAKED).otherwise(ACTIVE)
        longer = [F.when(F.col("mid").isNotNull(), F.concat("via_q", F.array("mid"), "via")).otherwise(F.col("via")).alias("via")] if with_paths else []
        counts = []
        if with_sizes:
            extra = F.col("extra") + F.coalesce("between", lit_long(0))
            known = 1 + F.col("acc") + F.when(F.col("spliced"), F.col("child_extra")).otherwise(0)
            counts = ["acc", extra.alias("extra"), known.alias("known"), (1 + F.col("acc") + extra).alias("give")]
        out = at.select("v", F.coalesce("q", "p").alias("p"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), state.alias("removed"), F.when(F.col("spliced"), F.col("only")).alias("child"), *longer, *counts)
        schema = out.schema
        path = scratch.write(out)
        written = scratch.read(path, schema)
        sizes = {r[0]: r[1] for r in written.groupBy("removed").count().collect()}
        record_paths.append((path, sizes.get(RAKED, 0) + sizes.get(SPLICED, 0)))
        active = written.where(F.col("removed") == ACTIVE).select("v", "p", "w", *kept)
        raked = written.where(F.col("removed") == RAKED) if with_sizes else None
        if not sizes.get(ACTIVE) or not (sizes.get(RAKED) or sizes.get(SPLICED)):
            break
    loops = sizes.get(ACTIVE, 0)
    core = active.select(F.col("v").alias("comment_id"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("root"), F.lit("cycle").alias("state"), *([F.lit(None).cast(via_type).alias("path")] if with_paths else []))
    if with_sizes:
        given = scratch.read([p for p, _ in record_paths], schema).where(F.col("removed") == RAKED).groupBy(F.col("p").alias("comment_id")).agg(F.sum("give").alias("given"))
        top = salted_join(top, given, "comment_id").withColumn("size", 1 + F.coalesce("given", lit_long(0))).drop("given")
        core = core.withColumn("size", F.lit(None).cast("long"))
    parts = [scratch.write(top), *([scratch.write(core)] if loops else [])]
    out_schema = top.schema
    for path, removed in reversed(record_paths):
        gone = scratch.read(path, schema).where(F.col("removed") != ACTIVE)
        solved = scratch.read(parts, out_schema)
        at = salted_join(gone, solved.select(F.col("comment_id").alias("p"), *[c for c in solved.columns if c not in ("comment_id", "size")]), "p", "inner", [] if removed < HOT_ROWS else None)
        state = F.when(F.col("state") == "tree", "tree").otherwise("below_cycle")
        if loops:  # a spliced node is on the loop if the child it stood above is
            on_loop = solved.where("state = 'cycle'").select(F.col("comment_id").alias("child"), F.lit(True).alias("on_loop"))
            at = at.withColumn("child", F.coalesce("child", "v")).join(on_loop, "child", "left")  # no nulls that would meet in one task
            state = F.when(F.col("on_loop") & (F.col("removed") == SPLICED), "cycle").otherwise(state)
        if with_sizes:  # the child went later, or is a leaf of this round
            now = gone.where(F.col("removed") == RAKED).select(F.col("v").alias("child"), F.col("known").alias("child_size"))
            of_child = solved.select(F.col("comment_id").alias("child"), F.col("size").alias("child_size")).unionByName(now)
            at = at.withColumn("child", F.coalesce("child", "v")).join(of_child, "child", "left")
            at = at.withColumn("size", F.when(F.col("removed") == SPLICED, F.col("known") + F.col("child_size")).otherwise(F.col("known")))
        full = [F.concat("path", F.array("p"), "via").alias("path")] if with_paths else []
        parts.append(scratch.write(at.select(F.col("v").alias("comment_id"), (F.col("depth") + F.col("w")).alias("depth"), "root", state.alias("state"), *full, *(["size"] if with_sizes else []))))
        scratch.drop(path)  # this round's records are solved
    return scratch.read(parts, out_schema)


def hierarchy(comments: DataFrame, posts: DataFrame, with_paths: bool = True) -> DataFrame:
    """Each comment's path from its post, true depth, root post and state: comment_id, root, depth, stored, state, path.

    depth is the number of comments above (0 for a direct reply); state is `tree`, `orphan` (the walk up ends at no
    post in posts; root is null), `cycle` or `below_cycle`. Comments without an id are left out; repeated rows are one
    comment; empty tables give an empty result.
    """
    scratch = Scratch(comments.sparkSession, "hierarchy")
    nodes = scratch.cut(comment_nodes(comments, posts))
    solved = contract(nodes, with_paths, scratch)
    state = F.when((F.col("state") == "tree") & F.col("root").isNull(), "orphan").otherwise(F.col("state"))
    return solved.withColumn("state", state).join(nodes.select("comment_id", "stored"), "comment_id")


def hierarchy_problems(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments on a loop, below one, or whose stored depth is wrong: comment_id, kind."""
    h = hierarchy(comments, posts, with_paths=False)
    kind = F.when(F.col("state").isin("cycle", "below_cycle"), F.col("state")).when((F.col("state") == "tree") & (F.col("stored") != F.col("depth")), "depth")
    return h.select("comment_id", kind.alias("kind")).where("kind is not null")


def descendants(solved: DataFrame) -> DataFrame:
    """All descendants of every comment, from hierarchy's paths: comment_id, descendant, distance."""
    up = solved.where("path is not null").select(F.col("comment_id").alias("descendant"), "depth", F.posexplode("path").alias("at", "comment_id"))
    return up.select("comment_id", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
