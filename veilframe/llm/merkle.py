"""Merkle manifest of a dataset with nested-interval labels.

Leaves are digests of rows. Within a group they ascend by id, and every ``FAN_OUT`` consecutive nodes become
one parent until a single node, the group's subroot, remains; subroots, ordered by group, are built up to the
root in the same way. Every node carries the interval [lo, hi) of leaf ranks that it covers, ranks being
counted through all groups, so a node's ancestors are the nodes whose intervals contain its own.

The tree is built bottom-up: one aggregation per level over runs of at most ``FAN_OUT`` members, each level a
sixteenth of the one below. Proofs come top-down: the nodes of a level meet the level above in a join on the
level's bucket and containment of intervals. Within the parent's interval, the members before ``lo`` and from
``hi`` on are the siblings left and right, one step of the path. Paths are attached to runs; leaves are unfolded
from their run at the very end, so that text never moves and the widest rows are a sixteenth of all.

Ranks come from range-dealt sorting (``common.ranked``), no window sees a whole group, and every grouping key
is a run of bounded size: a group that holds most rows is only a higher tree. Levels are written tables.

Defined results: a null column counts as ``-`` in the leaf; rows of a null group form a group of their own,
which comes first; of null ids (first) and repeated ids the order is by digest, equal rows being exchangeable; a
lone leaf is its subroot, a lone subroot the root, and neither adds a step; an empty table has no rows; columns not
named for the leaf are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import ranked, sized_join, written

FAN_OUT = 16
#: The tree of the subroots; group trees are named by their first leaf rank.
UPPER = -1
_STEPS = "array<struct<left:binary,right:binary>>"


def field(column: Column) -> Column:
    """A value as its UTF-8 length, a colon and itself; null as a dash."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Binary SHA-256 of the fields one after another."""
    return _digest(F.concat(*[field(c) for c in columns]))


def _joined(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda m: hex_text(m["digest"])), "")


@dataclass
class Manifest:
    """Leaf runs, the levels of all group trees above them, the subroots, and the levels over the subroots."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    upper: list[DataFrame]


def _parents(nodes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive nodes (tree, number, lo, hi, of, digest) as their parents, with members in order."""
    member = F.struct("lo", "hi", "digest", *extra)
    runs = nodes.groupBy("tree", F.expr(f"number div {FAN_OUT}").alias("number")).agg(F.array_sort(F.collect_list(member)).alias("members"), F.first("of").alias("of"))
    lone = F.col("of") == 1
    return runs.select(
        "tree", "number", F.col("members")[0]["lo"].alias("lo"), F.element_at("members", -1)["hi"].alias("hi"),
        F.expr(f"(of + {FAN_OUT - 1}) div {FAN_OUT}").alias("of"), lone.alias("lone"), "members",
        F.when(lone, F.col("members")[0]["digest"]).otherwise(_digest(_joined(F.col("members")))).alias("digest"),
    )


def _levels_above(level: DataFrame, label: str) -> list[DataFrame]:
    """All levels from this one up; a tree ends where it has one node."""
    out = [level]
    while True:
        more = out[-1].where("of > 1")
        if more.isEmpty():
            return out
        out.append(written(_parents(more), label))


def build(docs: DataFrame, id_col: str, group_col: str, columns: Sequence[str], claims: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of some rows, each a leaf of the named columns.

    ``claims`` maps columns to what somebody claims they contain; the claimed leaf travels along and is checked by
    ``verified``. Only digests, ids and groups are stored.
    """
    own = [F.col(f"`{c}`") for c in columns]
    leaf = leaf_digest(own)
    claimed = leaf_digest([(claims or {}).get(c, F.col(f"`{c}`")) for c in columns]) if claims else leaf
    rows = written(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("grp"), leaf.alias("digest"), claimed.alias("claim")), "leaves")
    rows = rows.select("id", "grp", "digest", F.when(F.col("claim") != F.col("digest"), F.col("claim")).alias("claim"), F.monotonically_increasing_id().alias("row"))
    order = written(ranked(rows, ["grp", "id", "digest", "row"], "lo").drop("row"), "ranked-leaves")
    groups = order.groupBy("grp").agg(F.min("lo").alias("tree"), F.count("*").alias("of"))
    groups = written(groups, "groups")
    placed = sized_join(order.withColumnRenamed("grp", "g"), groups, F.col("g").eqNullSafe(F.col("grp")), "inner").select(
        "id", "claim", "digest", "tree", "of", "lo", (F.col("lo") + 1).alias("hi"), (F.col("lo") - F.col("tree")).alias("number"))
    leaves = written(_parents(placed, ("id", "claim")), "leaf-runs")
    levels = _levels_above(leaves.drop("members").withColumn("members", F.lit(None)), "level")
    levels[0] = leaves
    tops = None
    for level in levels:
        done = level.where("of = 1").select("tree", "lo", "hi", "digest")
        tops = done if tops is None else tops.unionByName(done)
    tops = written(tops, "subroots")
    numbered = ranked(tops, ["lo"], "number", "numbered")
    subroots = written(numbered.select("lo", "hi", "digest", "number", F.col("tree").alias("group"), F.lit(UPPER).cast("long").alias("tree"), F.lit(tops.count()).alias("of")), "subroots")
    upper = _levels_above(written(_parents(subroots), "upper"), "upper")
    return Manifest(leaves, levels, subroots, upper)


def _step(members: Column, lo: Column, hi: Column) -> Column:
    """The siblings of a member: what its interval leaves of its parent's, on the left and on the right."""
    part = lambda keep: F.unhex(_joined(F.filter(members, keep)))
    return F.struct(part(lambda m: m["hi"] <= lo).alias("left"), part(lambda m: m["lo"] >= hi).alias("right"))


def _below(level: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes of a level with the path of their parent and the step to it: bucket join with containment of intervals."""
    up = above.select(
        F.col("tree").alias("up_tree"), F.col("number").alias("bucket"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"),
        F.col("members").alias("kin"), F.col("lone").alias("up_lone"), "path", "subroot", "root")
    inside = (F.col("tree") == F.col("up_tree")) & (F.expr(f"number div {FAN_OUT}") == F.col("bucket")) & (F.col("lo") >= F.col("up_lo")) & (F.col("hi") <= F.col("up_hi"))
    met = level.join(up, inside)
    step = F.array(_step(F.col("kin"), F.col("lo"), F.col("hi"))).cast(_STEPS)
    return met.withColumn("path", F.when(F.col("up_lone"), F.col("path")).otherwise(F.concat(step, F.col("path")))).drop("up_tree", "bucket", "up_lo", "up_hi", "up_lone", "kin")


def paths(manifest: Manifest) -> DataFrame:
    """Leaf runs with the path from the run's node to the root (steps of left and right siblings), subroot and root."""
    top = manifest.upper[-1]
    state = top.select("tree", "number", "lo", "hi", "lone", "members", F.array().cast(_STEPS).alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    for level in reversed(manifest.upper[:-1]):
        state = written(_below(level.drop("of", "digest"), state), "upper-paths")
    roots = written(_below(manifest.subroots, state).select(F.col("group").alias("root_tree"), "path", F.col("digest").alias("subroot"), "root"), "root-paths")
    state = None
    for level in reversed(manifest.levels):
        ended = level.where("of = 1").join(roots, F.col("tree") == F.col("root_tree")).drop("root_tree", "of", "digest")
        if state is not None:
            ended = ended.unionByName(_below(level.where("of > 1"), state).drop("of", "digest").select(*ended.columns))
        state = written(ended, "paths")
    return state


def verified(manifest: Manifest) -> DataFrame:
    """Per leaf: id, leaf, subroot, root, proof (its siblings' hex text up to the root), and the root folded from the claimed leaf."""
    runs = paths(manifest).select("members", "lone", "path", "subroot", "root", F.explode("members").alias("own"))
    step = F.array(_step(F.col("members"), F.col("own.lo"), F.col("own.hi"))).cast(_STEPS)
    full = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(step, F.col("path")))
    leaves = runs.select("own", "subroot", "root", full.alias("path"))
    proof = F.array_join(F.transform("path", lambda p: F.concat(hex_text(p["left"]), hex_text(p["right"]))), "")
    claim = hex_text(F.coalesce("own.claim", "own.digest"))
    fold = F.aggregate("path", claim, lambda acc, p: F.sha2(F.concat(hex_text(p["left"]), acc, hex_text(p["right"])), 256))
    return leaves.select(
        F.col("own.id").alias("id"), hex_text(F.col("own.digest")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"),
        hex_text(F.col("root")).alias("root"), proof.alias("proof"), fold.alias("folded_root"),
    )
