"""Merkle manifest of a dataset, with proofs collected by pointer jumping.

Every row is a leaf: the digest of its fields. Per source the leaves, in order, are hashed in runs of
FAN_OUT until one node remains, the subroot; the subroots, in order of their sources, are hashed
likewise until the root. Digests are lower-case hex SHA-256 and enter the next one as hex text.

A leaf's proof is what else its runs hold, from its own run up to the root. It is found by pointer
jumping: each node points to the node above it and holds one segment, its run and its place in it.
Joining the table of nodes to itself makes every pointer reach twice as far and appends the segments
of the node pointed to, so a tree of height h takes log2(h) joins. The leaves of a run share
everything above it, so they travel with their run as one row, a sixteenth of the rows.

Memory and skew: a group is one run, FAN_OUT short digests, whatever the source; leaves are placed by
range partitioning, without a window over a source. Texts are read once and leave the scan as digests.

Defined results: a null field is hashed as ``-``; null sources form one source, the first; leaves of
equal doc_id are ordered by their digest, null ids come first; equal rows are leaves of their own. A
source of one row has its leaf as subroot, a table of one source its subroot as root, without being
hashed again. An empty table gives no rows. Other columns are neither hashed nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedgate.llm.common import ascii_lower
from feedgate.operators.numbering import number_rows
from feedgate.sources.scratch import save

FAN_OUT = 16
#: The fields of a leaf, in the order they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels up to which heights are counted: 16 ** 15 leaves.
MAX_LEVELS = 15

_TOP = -1  # number of the tree over all sources
_DIGEST = 64


def framed(column: Column) -> Column:
    """``-`` for null, else the bytes of the value in decimal, a colon, and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row's fields, some of them given by another expression."""
    return F.sha2(F.concat(*(framed(changed.get(name, F.col(name))) for name in FIELDS)), 256)


def lowered_copy() -> Column:
    """The leaf after A-Z of its text were lower-cased, for the rows whose id has a checksum that 5 divides."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return F.when(chosen, leaf_digest(text=ascii_lower(F.col("text"))))


def _height(size: Column) -> Column:
    """Times that nodes are hashed in runs until one remains: the least h with FAN_OUT ** h >= size."""
    return sum(((size > FAN_OUT**level).cast("int") for level in range(MAX_LEVELS)), F.lit(0))


def _unhexed(text: Column) -> Column:
    return F.unhex(text)


def _hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _run_up(nodes: DataFrame) -> DataFrame:
    """Nodes of one level (tree, at, digest) as the runs above them, each with its nodes in order."""
    members = F.array_sort(F.collect_list(F.struct("at", "digest")))
    runs = nodes.groupBy("tree", "height", F.floor(F.col("at") / FAN_OUT).alias("above")).agg(members.alias("members"))
    joined = F.array_join(F.transform("members", lambda m: _hexed(m["digest"])), "")
    return runs.withColumn("run", _unhexed(joined)).withColumn("digest", _unhexed(F.sha2(joined, 256)))


def _levels(leaves: DataFrame, first: int, highest: int, label: str) -> tuple[DataFrame, DataFrame]:
    """The nodes above ``leaves`` as (tree, height, level, at, digest), and the runs below each of them.

    ``leaves`` are the nodes of level ``first``; ``highest`` is the greatest height of a tree. One short
    job for each level, of which the next has a sixteenth of the rows.
    """
    spark, below = leaves.sparkSession, leaves
    nodes, links = [leaves.withColumn("level", F.lit(first))], []
    for level in range(first + 1, highest + 1):
        runs = save(_run_up(below.filter(F.col("height") >= level)), f"{label}-{level}")
        links.append(
            runs.select(
                "tree", F.lit(level - 1).alias("level"), F.explode("members.at").alias("at"), "above", "run"
            )
        )
        below = runs.select("tree", "height", F.col("above").alias("at"), "digest")
        nodes.append(below.withColumn("level", F.lit(level)))
    every = nodes[0]
    for frame in nodes[1:]:
        every = every.unionByName(frame)
    none = "tree long, level int, at long, above long, run binary"
    joined = links[0] if links else spark.createDataFrame([], none)
    for frame in links[1:]:
        joined = joined.unionByName(frame)
    return every, joined


def _segment(run: Column, at: Column) -> Column:
    return F.array(F.struct(run.alias("run"), (at % FAN_OUT).cast("int").alias("place")))


def _node(tree, level, at) -> Column:
    return F.struct(
        F.lit(tree).cast("long").alias("tree") if isinstance(tree, int) else tree.cast("long").alias("tree"),
        (F.lit(level) if isinstance(level, int) else level).cast("int").alias("level"),
        at.cast("long").alias("at"),
    )


def _jump(pointers: DataFrame, height: int) -> DataFrame:
    """Pointers (node, up, segments) doubled until all of them reach the root, which points nowhere.

    After k rounds a pointer spans 2 ** k levels. Nodes pointed to then lie at least that high, so the
    table joined with shrinks by the square of its size: it is soon broadcast, before many nodes share one.
    """
    span = 1
    while span < height:
        above = pointers.filter((F.col("node.tree") == _TOP) | (F.col("node.level") > span))
        above = above.select(F.col("node").alias("up"), F.col("up").alias("farther"), F.col("segments").alias("further"))
        joined = pointers.join(above, "up", "left")
        pointers = save(
            joined.select(
                "node",
                F.col("farther").alias("up"),
                F.concat("segments", F.coalesce("further", F.slice("segments", 1, 0))).alias("segments"),
            ),
            "pointers",
        )
        span *= 2
    return pointers


def _beside(run: Column, at: Column) -> Column:
    """The hex digests of a run before and after one of its places."""
    text, place = _hexed(run), (at % FAN_OUT).cast("int")
    return F.struct(
        F.substring(text, F.lit(1), place * _DIGEST).alias("before"),
        F.substring(text, (place + 1) * _DIGEST + 1, F.length(text)).alias("after"),
    )


def fold(leaf: Column, segments: Column) -> Column:
    """The root that a leaf has by its segments."""
    return F.aggregate(segments, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def siblings(segments: Column) -> Column:
    """What the runs of a path hold beside it, from the leaf up, left to right, as one text."""
    return F.array_join(F.transform(segments, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, tampered: Callable[[], Column] = lowered_copy) -> DataFrame:
    """Per row its leaf, subroot, root, segments of its proof, and the leaf of a changed copy, if there is one.

    ``segments`` are the digests before and after the path in each run, from the leaf to the root;
    :func:`siblings` and :func:`fold` read them.
    """
    # Texts are read once; what follows works on digests of 32 bytes.
    digested = save(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"),
            _unhexed(leaf_digest()).alias("leaf"), _unhexed(tampered()).alias("changed"),
        ),
        "leaves",
    )
    order = [F.col(name).asc_nulls_first() for name in ("source", "doc_id", "leaf")]
    numbered = number_rows(digested, order, "n", "ordered-leaves")

    sizes = numbered.groupBy("source").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("first"))
    # Sources in order of their first leaf are sources in order.
    trees = save(
        number_rows(sizes, [F.col("first").asc()], "tree", "sources").select(
            "source", (F.col("tree") - 1).alias("tree"), "size", "first", _height(F.col("size")).alias("height")
        ),
        "trees",
    )
    n_trees, highest = trees.agg(F.count(F.lit(1)), F.max("height")).first()
    top_height = next(h for h in range(MAX_LEVELS + 1) if FAN_OUT**h >= max(n_trees, 1))

    placed = numbered.join(trees.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    at = F.col("n") - F.col("first")
    leaves = placed.select("doc_id", "leaf", "changed", "tree", "height", at.alias("at"))
    member = F.struct("at", F.col("leaf").alias("digest"), "doc_id", "changed")
    grouped = leaves.groupBy("tree", "height", F.floor(F.col("at") / FAN_OUT).alias("above")).agg(
        F.array_sort(F.collect_list(member)).alias("members")
    )
    joined = F.array_join(F.transform("members", lambda m: _hexed(m["digest"])), "")
    single = F.col("height") == 0
    runs = save(
        grouped.select(
            "tree", "height", "above", "members",
            F.when(~single, _unhexed(joined)).alias("run"),
            F.when(single, F.col("members")[0]["digest"]).otherwise(_unhexed(F.sha2(joined, 256))).alias("digest"),
        ),
        "runs",
    )

    first = runs.select("tree", "height", F.col("above").alias("at"), "digest")
    nodes, links = _levels(first, 1, highest or 0, "level")
    subroots = save(
        nodes.filter(F.col("level") == F.greatest(F.col("height"), F.lit(1))).select("tree", "digest"), "subroots"
    )
    tops = subroots.select(
        F.lit(_TOP).cast("long").alias("tree"), F.lit(top_height).alias("height"), F.col("tree").alias("at"), "digest"
    )
    top_nodes, top_links = _levels(tops, 0, top_height, "top")

    every = links.select(
        _node(F.col("tree"), F.col("level"), F.col("at")).alias("node"),
        _node(F.col("tree"), F.col("level") + 1, F.col("above")).alias("up"),
        _segment(F.col("run"), F.col("at")).alias("segments"),
    )
    # A subroot is a leaf of the top tree, whose own nodes keep their places.
    below_top = top_links.filter(F.col("level") == 0).join(
        trees.select(F.col("tree").alias("at"), F.greatest(F.col("height"), F.lit(1)).alias("subroot_level")), "at"
    )
    for frame, node in (
        (below_top, _node(F.col("at"), F.col("subroot_level"), F.lit(0))),
        (top_links.filter(F.col("level") > 0), _node(_TOP, F.col("level"), F.col("at"))),
    ):
        every = every.unionByName(
            frame.select(
                node.alias("node"),
                _node(_TOP, F.col("level") + 1, F.col("above")).alias("up"),
                _segment(F.col("run"), F.col("at")).alias("segments"),
            )
        )
    paths = _jump(save(every, "pointers"), max(highest or 0, 1) - 1 + top_height)
    paths = paths.filter((F.col("node.level") == 1) & (F.col("node.tree") != _TOP)).select(
        F.col("node.tree").alias("tree"), F.col("node.at").alias("above"), "segments"
    )

    # One row: the highest node of the top tree.
    [root] = [row[0] for row in top_nodes.filter(F.col("level") == top_height).select(_hexed(F.col("digest"))).collect()] or [None]
    none = F.array().cast("array<struct<before:string,after:string>>")
    # Segments become text once for a run, not for each of its leaves.
    upper = F.coalesce(F.transform("segments", lambda s: _beside(s["run"], s["place"])), none)
    reached = (
        runs.drop("digest").join(paths, ["tree", "above"], "left")
        .join(subroots.withColumnRenamed("digest", "subroot"), "tree")
        .withColumn("segments", upper)
    )
    rows = reached.select(F.explode("members").alias("m"), "run", "segments", "subroot")
    own = F.when(F.col("run").isNull(), none).otherwise(F.array(_beside(F.col("run"), F.col("m.at"))))
    return rows.select(
        "m.doc_id",
        _hexed(F.col("m.digest")).alias("leaf"),
        _hexed(F.col("subroot")).alias("subroot"),
        F.lit(root).cast("string").alias("root"),
        F.concat(own, "segments").alias("segments"),
        _hexed(F.col("m.changed")).alias("changed"),
    )


def verified(proved: DataFrame) -> DataFrame:
    """Proof digests, and whether the changed copies, or else the leaves, still lead to the root."""
    folded = fold(F.coalesce("changed", "leaf"), F.col("segments"))
    return proved.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(siblings(F.col("segments")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
