"""Graph operators beyond single joins: instruction graphs, walks, data flow, merging, adjacency."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranks import ranked

#: Steps of a walk, and walks of a graph.
WALK_LENGTH, MOST_WALKS = 40, 5000
ENTRY = -1


def instruction_edges(nodes: DataFrame, block_edges: DataFrame) -> DataFrame:
    """func, src, dst: nodes are func, block, addr; each instruction leads to the next of its block, and the last of a block
    to the first of each block that follows it (block_edges: func, src_block, dst_block)."""
    here = Window.partitionBy("func", "block").orderBy("addr")
    inside = nodes.select("func", F.col("addr").alias("src"), F.lead("addr").over(here).alias("dst")).where("dst IS NOT NULL")
    ends = nodes.groupBy("func", "block").agg(F.min("addr").alias("first"), F.max("addr").alias("last"))
    out = block_edges.join(ends.select("func", F.col("block").alias("src_block"), F.col("last").alias("src")), ["func", "src_block"])
    out = out.join(ends.select("func", F.col("block").alias("dst_block"), F.col("first").alias("dst")), ["func", "dst_block"])
    return inside.unionByName(out.select("func", "src", "dst")).distinct()


def choice(seed: str, start: object, step: int, nodes: list) -> object:
    """The successor whose md5 with the walk and step sorts first."""
    return min(nodes, key=lambda n: (hashlib.md5(f"{seed}-{start}-{step}-{n}".encode()).hexdigest(), n))


def random_walks(edges: DataFrame, graph: str, kind: str, seed: str, length: int = WALK_LENGTH, most: int = MOST_WALKS) -> DataFrame:
    """graph, start, step (from 0), node: a walk from each node, over uniformly chosen successors, up to `length` steps or
    a node without any. edges: graph, src, dst of the type `kind`. The first `most` walks of a graph, by start, stay.

    A graph is worked off in one task, as it is bounded; the choices are hashes, so that they repeat anywhere.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        after = defaultdict(list)
        for s, d in sorted(set(zip(rows["src"], rows["dst"], strict=True))):
            after[s].append(d)
        out = []
        for start in sorted({*rows["src"], *rows["dst"]})[:most]:
            node = start
            out.append((start, 0, node))
            for step in range(1, length + 1):
                if node not in after:
                    break
                node = choice(seed, start, step, after[node])
                out.append((start, step, node))
        found = pd.DataFrame(out, columns=["start", "step", "node"])
        found.insert(0, graph, rows[graph].iloc[0])
        return found

    schema = f"{graph} {dict(edges.dtypes)[graph]}, start {kind}, step long, node {kind}"
    return edges.groupBy(graph).applyInPandas(walk, schema)


def ego_edges(ego: DataFrame, edges: DataFrame) -> DataFrame:
    """root, hop_src, hop_dst, src, dst: edges between nodes of a root's neighbourhood (root, node, hop) that lead one hop
    out or stay at a hop."""
    a = ego.select("root", F.col("node").alias("src"), F.col("hop").alias("hop_src"))
    b = ego.select("root", F.col("node").alias("dst"), F.col("hop").alias("hop_dst"))
    return a.join(edges, "src").join(b, ["root", "dst"]).where("hop_dst >= hop_src").select("root", "hop_src", "hop_dst", "src", "dst")


def hop_index(ego: DataFrame, width: int = 1024) -> DataFrame:
    """root, node, hop, i: the place of each (root, node) among those of its hop, from 0."""
    order = [F.col("root"), F.col("node")]
    return ranked(ego, order, [(F.floor(F.col("root") / width), False)], ("hop",), "i").withColumn("i", F.col("i") - 1)


def hop_matrices(ego: DataFrame, edges: DataFrame) -> DataFrame:
    """hop_src, hop_dst, i, j: ones of the matrices that lead from one hop's places to another's."""
    at = hop_index(ego)
    a = at.select("root", F.col("node").alias("src"), F.col("hop").alias("hop_src"), "i")
    b = at.select("root", F.col("node").alias("dst"), F.col("hop").alias("hop_dst"), F.col("i").alias("j"))
    found = ego_edges(ego, edges)
    return found.join(a, ["root", "src", "hop_src"]).join(b, ["root", "dst", "hop_dst"]).select("hop_src", "hop_dst", "i", "j")


def relabelled(nodes: DataFrame, edges: DataFrame, graph: str, most: int) -> DataFrame:
    """graph, i, j: edges (graph, src, dst) between the first `most` nodes (graph, node) of each graph, by their places."""
    at = nodes.select(graph, "node", (F.row_number().over(Window.partitionBy(graph).orderBy("node")) - 1).alias("at")).where(F.col("at") < most)
    a, b = at.select(graph, F.col("node").alias("src"), F.col("at").alias("i")), at.select(graph, F.col("node").alias("dst"), F.col("at").alias("j"))
    return edges.join(a, [graph, "src"]).join(b, [graph, "dst"]).select(graph, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


def merged_blocks(parents: DataFrame, held: DataFrame, rounds: int = 6) -> DataFrame:
    """block, owner: each block (parents: block, parent; a root's is null) and the nearest of it and its ancestors that is
    in held (block), null if there is none. Pointers double each round, so that rounds reach 2**rounds ancestors; a round's
    table is persisted, as the next one reads it twice."""
    at = parents.join(held.select("block", F.lit(True).alias("own")), "block", "left")
    at = at.select("block", F.when(F.col("own"), F.col("block")).otherwise(F.col("parent")).alias("owner"), F.coalesce("own", F.lit(False)).alias("done"))
    for _ in range(rounds):
        at = at.persist()
        up = at.select(F.col("block").alias("owner"), F.col("owner").alias("next"), F.col("done").alias("next_done"))
        at = at.join(up, "owner", "left").select("block", F.when(F.col("done"), F.col("owner")).otherwise(F.col("next")).alias("owner"), (F.col("done") | F.coalesce("next_done", F.lit(False))).alias("done"))
    return at.select("block", F.when(F.col("done"), F.col("owner")).alias("owner"))


# data flow ----------------------------------------------------------------------------------------------------------


def assignment(text: str) -> tuple[str, list[str]] | None:
    """The variable that an assignment defines and those it uses; None for calls, jumps and what is no assignment.

    A memory cell is defined by what its address is written with. Of a compound right side, what stands in innermost
    brackets is used; of operands that are parted by blanks, the ones that are no operators, numbers or labels.
    """
    left, sign, right = text.partition("=")
    if not sign or "call" in text or "IRDst" in text:
        return None
    left, right = left.strip(), right.strip()
    cell = re.search(r"\[([^\]]*)\]", left)
    left = cell[1] if cell else left
    inner = re.findall(r"\(([^()]*)\)", right) + re.findall(r"\[([^\[\]]*)\]", right)
    used: list[str] = []
    for operand in inner if "(" in right or "[" in right else [right]:
        words = operand.split(" ")
        for w in [operand] if len(words) == 1 else ["".join(re.findall(r"\w", x)) for x in words]:
            if len(words) > 1:
                w = re.sub("^(8|16|32|64)", "", w)
            number = w.startswith("0x") or w.lower() == "zero" or w.startswith("loc") or re.fullmatch("[a-z]?", w)
            if w and not number and w not in used:
                used.append(w)
    return left, used


def reaching_edges(rows: list[tuple[object, int, str]], block_edges: list[tuple[object, object]]) -> list[tuple[int, int]]:
    """Definition to use, by address: every definition that reaches a use over some path of blocks, as the least fixed point
    of what each block makes and leaves of the definitions that enter it. rows: block, addr, assignment.

    Addresses to which no edge leads hang on ENTRY.
    """
    blocks: dict[object, list[tuple[int, tuple[str, list[str]] | None]]] = defaultdict(list)
    for block, addr, text in sorted(rows, key=lambda r: r[1]):
        blocks[block].append((addr, assignment(text)))
    before = defaultdict(set)
    for a, b in block_edges:
        if a != b and a in blocks and b in blocks:
            before[b].add(a)
    leaves: dict[object, dict[str, set[int]]] = {b: {} for b in blocks}
    edges: set[tuple[int, int]] = set()
    changed = True
    while changed:
        changed = False
        for b, instructions in blocks.items():
            now: dict[str, set[int]] = defaultdict(set)
            for p in before[b]:
                for v, at in leaves[p].items():
                    now[v] |= at
            for addr, found in instructions:
                if found:
                    for v in found[1]:
                        edges.update((d, addr) for d in now.get(v, ()))
                    now[found[0]] = {addr}
            new = {v: s for v, s in now.items() if s}
            if new != leaves[b]:
                leaves[b], changed = new, True
    reached = {d for _, d in edges}
    edges.update((ENTRY, addr) for i in blocks.values() for addr, _ in i if addr not in reached)
    return sorted(edges)


def def_use(rows: DataFrame, block_edges: DataFrame) -> DataFrame:
    """func, src, dst: definitions to uses of each function. rows: func, block, addr, assign; block_edges: func, src_block,
    dst_block. A function is worked off in one task, as it is bounded."""
    schema = f"func {dict(rows.dtypes)['func']}, src long, dst long"

    def flow(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"func": [], "src": [], "dst": []})
        found = reaching_edges(list(a[["block", "addr", "assign"]].itertuples(index=False, name=None)), list(b[["src_block", "dst_block"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(a["func"].iloc[0], s, d) for s, d in found], columns=["func", "src", "dst"])

    return rows.groupBy("func").cogroup(block_edges.groupBy("func")).applyInPandas(flow, schema)
