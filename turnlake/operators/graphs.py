"""Checks of whole graphs of evidence, by joins until nothing changes: who is reached, who owns what, and where a chain of owners runs in a circle.

Nodes are events, subjects and targets of one case; an edge leads from a node to the one that it belongs to. An event must
reach a target along edges, have one owner at each step, and meet no node twice. All steps are joins of edges, doubled in
length in each round, so a chain of n edges takes log2(n) rounds, and no case is gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.session import checkpointed

#: What an edge may say, and the relation that follows from the last one.
CURRENT, OTHER = ("same_entity", "part_of", "located_at", "coreference"), ("distinct",)
#: Routes by occurrence and relation; what cannot be told asks for confirmation.
ACT, CONFIRM, COLLECT = "safety_action_required", "confirming_safety_status", "collecting_service_request"


def owner_faults(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(case, node, fault) for each node that breaks a rule: several_owners, edge_to_itself, owner_missing (no such node), repeated_edge, edge_of_nobody.

    edges: case, node, owner, kind; nodes: case, node. Edges with a null case, node or owner are owner_missing of what they
    name. Several faults of one node are several rows.
    """
    known = nodes.select("case", "node").distinct().withColumn("_known", F.lit(True))
    # one exchange of the edges: what lies by (case, node) also has the edges of one owner and kind together
    alike = edges.repartition("case", "node").groupBy("case", "node", "owner", "kind").agg(F.count("*").alias("n"))
    whole = F.col("owner").isNotNull() & F.col("kind").isNotNull()
    ends = alike.groupBy("case", "node").agg((F.min("owner") != F.max("owner")).alias("several"), F.max((F.col("n") > 1) | ~whole).alias("again"), F.max(F.col("node") == F.col("owner")).alias("self"))
    ends = ends.join(known, ["case", "node"], "left")
    tests = (("several", "several_owners"), ("self", "edge_to_itself"), ("again", "repeated_edge"), (F.col("_known").isNull(), "edge_of_nobody"))
    own = ends.select("case", "node", F.explode(F.array_compact(F.array(*[F.when(F.col(test) if isinstance(test, str) else test, code) for test, code in tests]))).alias("fault"))
    lost = edges.join(known.withColumnRenamed("node", "owner"), ["case", "owner"], "left").where("_known is null").select("case", "node", F.lit("owner_missing").alias("fault")).distinct()
    return own.unionByName(lost)


def chains(edges: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """(case, node, root, length, circle, kind, fault) for each node with an edge: where its chain of owners ends, after how many edges, and what the last of them says.

    edges: case, node, owner, kind, one owner for each node (of several the least is followed); faults: case, node, fault,
    of which a chain has the first by name of all nodes that it passes. circle: the chain never ends; it then has no root.
    A chain that ran for more edges than any case has nodes with edges has met one twice. Only chains whose end is not yet
    known go into the next round and are written again.
    """
    known = edges.where("case is not null and node is not null and owner is not null")
    step = known.groupBy("case", "node").agg(F.min(F.struct("owner", "kind")).alias("edge")).select("case", "node", F.col("edge.owner").alias("to"), F.col("edge.kind").alias("kind"))
    if faults is None:
        step = step.withColumn("fault", F.lit(None).cast("string"))
    else:
        step = step.join(faults.groupBy("case", "node").agg(F.min("fault").alias("fault")), ["case", "node"], "left")
    going, ended = checkpointed(step.withColumns({"length": F.lit(1).cast("long"), "done": F.lit(False)})), []
    most = going.groupBy("case").count().agg(F.max("count")).first()[0] or 0
    while going.limit(1).count():
        at = reduce(DataFrame.unionByName, [*ended, going])
        ahead = at.select("case", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("kind").alias("_kind"), F.col("fault").alias("_fault"), F.col("length").alias("_length"), F.col("done").alias("_done"))
        length = F.col("length") + F.coalesce("_length", F.lit(0))
        further = lambda new, old: F.when(F.col("_to").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
        moved = checkpointed(
            going.join(ahead, ["case", "to"], "left").select(
                "case", "node", further("_to", "to"), further("_kind", "kind"), F.least("fault", "_fault").alias("fault"),
                length.alias("length"), (F.coalesce("_done", F.lit(True)) | (length > most)).alias("done"),
            )
        )
        ended.append(moved.where("done"))
        going = moved.where("not done")
    circle = F.col("length") > most
    unless = lambda x: F.when(~circle, F.col(x)).alias("root" if x == "to" else x)
    at = reduce(DataFrame.unionByName, [*ended, going])
    return at.select("case", "node", unless("to"), unless("length"), circle.alias("circle"), unless("kind"), "fault")


def event_relations(events: DataFrame, edges: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(case, node, occurrence, relation, fault, route) for each event: what its chain of owners says of the case's target.

    events: case, node, occurrence; nodes, targets: case, node. relation: other if the chain's last edge is of OTHER,
    current if it is of CURRENT and the chain ends at a target, else unknown. A circle, an event without an owner, or a
    fault of owner_faults() on the way makes it unknown: an event that cannot be told asks for confirmation, so that no
    malformed graph hides a hazard.
    """
    own = events.join(chains(edges, owner_faults(edges, nodes)), ["case", "node"], "left")
    own = own.join(targets.select("case", F.col("node").alias("root"), F.lit(True).alias("_met")).distinct(), ["case", "root"], "left")
    fault = F.when(F.col("circle"), "circle").when(F.col("circle").isNull(), "no_owner").otherwise(F.col("fault"))
    relation = F.when(fault.isNotNull(), "unknown").when(F.col("kind").isin(*OTHER), "other").when(F.col("kind").isin(*CURRENT) & F.col("_met"), "current").otherwise("unknown")
    route = F.when(relation == "other", COLLECT).when((relation == "current") & (F.col("occurrence") == "observed"), ACT).otherwise(CONFIRM)
    return own.select("case", "node", "occurrence", relation.alias("relation"), fault.alias("fault"), route.alias("route"))
