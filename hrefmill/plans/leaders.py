"""Greedy leader clustering over a banded similarity graph, in parallel and exact.

Rows sit at positions 0..n-1 and edges (i, j), i < j, reach less than one band ahead. Going through
the positions in order, a row that no earlier leader has claimed becomes a leader and claims its
later neighbours. Only the claims that cross from one chunk of positions into the next link two
chunks, so every chunk is first run as if nothing came in, then re-run only while what its left
neighbour hands over keeps changing. After round r the first r chunks of any chain are final, which
bounds the rounds; runs of unrelated URLs cut the chains, so few rounds do in practice.
"""

from __future__ import annotations

import sys
from array import array

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hrefmill.storage import cut_lineage

# Executors need not have this package installed: its task code travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 16_384
_SCHEMA = "chunk long, member long, leader long"


def claim_in_order(edges: pd.DataFrame, incoming: dict[int, int]) -> dict[int, int]:
    """One pass over the edges of a chunk; returns member -> leader, incoming claims included."""
    order = np.argsort(edges["i"].to_numpy(), kind="stable")
    i, j = edges["i"].to_numpy()[order], edges["j"].to_numpy()[order]
    taken = np.fromiter(incoming.keys(), dtype="int64", count=len(incoming))
    everything = np.concatenate([i, j, taken])
    if not len(everything):
        return {}
    base = everything.min()
    leader = np.full(everything.max() - base + 1, -1, dtype="int64")
    leader[taken - base] = np.fromiter(incoming.values(), dtype="int64", count=len(incoming))
    starts = np.flatnonzero(np.diff(i, prepend=i[:1] - 1))
    for a, b in zip(starts, np.append(starts[1:], len(i))):
        if leader[i[a] - base] < 0:
            reached = j[a:b] - base
            leader[reached[leader[reached] < 0]] = i[a]
    members = np.flatnonzero(leader >= 0)
    return dict(zip((members + base).tolist(), leader[members].tolist()))


def _run_chunk(key: tuple, edges: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
    incoming = dict(zip(carry["member"].tolist(), carry["leader"].tolist()))
    claimed = claim_in_order(edges, incoming)
    rows = [(key[0], member, leader) for member, leader in claimed.items() if member not in incoming]
    return pd.DataFrame(rows, columns=["chunk", "member", "leader"]).astype("int64")


def greedy_leaders(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(member, leader)`` for every claimed row, from edges ``(i, j)`` with ``0 < j - i <= chunk``."""
    keyed = cut_lineage(edges.select(F.floor(F.col("i") / chunk).alias("chunk"), "i", "j"))

    def crossing(claims: DataFrame) -> DataFrame:
        """Claims of a chunk on rows of the next one, keyed by the chunk that receives them."""
        target = F.floor(F.col("member") / chunk)
        return claims.filter(target > F.col("chunk")).select(target.alias("chunk"), "member", "leader")

    def run(work: DataFrame, carry: DataFrame) -> DataFrame:
        return work.groupBy("chunk").cogroup(carry.groupBy("chunk")).applyInPandas(_run_chunk, _SCHEMA)

    claims = cut_lineage(run(keyed, crossing(keyed.limit(0).selectExpr("chunk", "i AS leader", "j AS member"))))
    used = crossing(claims).limit(0)
    while True:
        carry = crossing(claims)
        # Chunks whose incoming claims differ from those they were last run with.
        changed = cut_lineage(
            carry.exceptAll(used).unionByName(used.exceptAll(carry)).select("chunk").distinct()
        )
        if changed.isEmpty():
            return claims.select("member", "leader")
        redone = run(keyed.join(changed, "chunk", "left_semi"), carry.join(changed, "chunk", "left_semi"))
        claims = cut_lineage(claims.join(changed, "chunk", "left_anti").unionByName(redone))
        used = carry


# --- runs of equal rows -------------------------------------------------------------------------------

_CLAIMS = "chunk long, node long, leader long, upto long"
#: A run takes two bits a neighbour and not a row, so its chunks are larger and chains of them shorter.
RUN_CHUNK = 131_072


def words_of(reach: int) -> int:
    """64-bit words that hold one bit for each distance below ``reach``."""
    return (reach + 63) // 64


def _spans(first: np.ndarray, covered: np.ndarray) -> list[tuple[int, int]]:
    """First and last distance of each neighbour, from the bits of a run."""
    begins = np.unpackbits(first.view("u1"), bitorder="little")
    over = np.unpackbits(covered.view("u1"), bitorder="little")
    at = np.flatnonzero(begins)
    stops = np.append(np.flatnonzero((over == 0) | (begins == 1)), len(over))
    return list(zip(at.tolist(), (stops[np.searchsorted(stops, at, "right")] - 1).tolist()))


def claim_runs(bands: pd.DataFrame, reached: dict[int, int], reach: int) -> np.ndarray:
    """Claims ``(node, leader, upto)`` of the runs of a chunk, in order, one row each.

    A run is named by its first position. What has been claimed of a run is always its front, since every
    claimer lies before it; ``reached`` holds how far, claims from other chunks included. The first row that nobody
    has claimed leads: it claims the rows of its own run and of similar runs that are less than ``reach`` ahead.
    """
    out = array("q")
    order = np.argsort(bands["a"].to_numpy(), kind="stable")
    a, a_end = bands["a"].to_numpy()[order], bands["a_end"].to_numpy()[order]
    heads = np.flatnonzero(np.diff(a, prepend=a[:1] - 1))
    n = words_of(reach)
    bits = [bands[[f"{kind}{w}" for w in range(n)]].to_numpy(dtype="<i8")[order] for kind in ("first", "covered")]
    first, covered = (np.bitwise_or.reduceat(x, heads, axis=0) if len(heads) else x for x in bits)
    for k, (node, end) in enumerate(zip(a[heads].tolist(), a_end[heads].tolist())):
        leader = reached.get(node, node - 1) + 1
        near = _spans(first[k], covered[k]) if leader <= end else []
        while leader <= end:
            last = leader + reach - 1
            own = min(end, last)
            if own > leader:
                out.extend((node, leader, own))
            for begin, stop in near:
                other = end + begin
                if other > last:
                    break
                upto = min(end + stop, last)
                if reached.get(other, other - 1) < upto:
                    out.extend((other, leader, upto))
                    reached[other] = upto
            leader = own + 1
    return np.array(out, "i8").reshape(-1, 3)


def greedy_run_leaders(bands: DataFrame, reach: int, chunk: int = RUN_CHUNK) -> DataFrame:
    """Claims ``(node, first, upto, leader)`` over runs of equal rows; ``first`` to ``upto`` are positions.

    ``bands (a, a_end, first0.., covered0..)`` hold the runs and, as bits by distance from ``a_end``, where similar later
    runs less than ``reach`` ahead begin and which positions they cover; rows of one run add up. Runs of several rows
    are there even if they have no neighbour. Chunks of positions run as if nothing came in, then again where what comes in
    from earlier chunks differs. A round writes the claims of the chunks it runs, not those of all.
    """
    keyed = cut_lineage(bands.withColumn("chunk", F.floor(F.col("a") / chunk)))

    def run_chunk(key: tuple, rows: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        reached = dict(zip(carry["node"].tolist(), carry["upto"].tolist()))
        claims = pd.DataFrame(claim_runs(rows, reached, reach), columns=["node", "leader", "upto"])
        claims.insert(0, "chunk", np.int64(key[0]))
        return claims

    def run(work: DataFrame, carry: DataFrame) -> DataFrame:
        return work.groupBy("chunk").cogroup(carry.groupBy("chunk")).applyInPandas(run_chunk, _CLAIMS)

    def crossing(claims: DataFrame) -> DataFrame:
        """How far each chunk has come in runs of later chunks: ``(source, chunk, node, upto)``, a few rows a chunk."""
        target = F.floor(F.col("node") / chunk)
        far = claims.filter(target > F.col("chunk")).groupBy(F.col("chunk").alias("source"), target.alias("chunk"), "node")
        return far.agg(F.max("upto").alias("upto"))

    rounds = [cut_lineage(run(keyed, keyed.limit(0).selectExpr("chunk", "a AS node", "a AS upto")))]
    carried = cut_lineage(crossing(rounds[0]))
    before = carried.limit(0)
    latest = cut_lineage(keyed.select("chunk").distinct().withColumn("round", F.lit(0)))
    while True:
        incoming = carried.groupBy("chunk", "node").agg(F.max("upto").alias("upto"))
        known = before.groupBy("chunk", "node").agg(F.max("upto").alias("upto"))
        moved = incoming.exceptAll(known).unionByName(known.exceptAll(incoming)).select("chunk").distinct()
        changed = cut_lineage(moved.join(latest, "chunk", "left_semi"))
        if changed.isEmpty():
            break
        redone = run(keyed.join(changed, "chunk", "left_semi"), incoming.join(changed, "chunk", "left_semi"))
        rounds.append(cut_lineage(redone))
        before = carried
        sources = changed.withColumnRenamed("chunk", "source")
        carried = cut_lineage(carried.join(sources, "source", "left_anti").unionByName(crossing(rounds[-1])))
        now = changed.withColumn("round", F.lit(len(rounds) - 1))
        latest = cut_lineage(latest.join(changed, "chunk", "left_anti").unionByName(now))
    claims = None
    for number, part in enumerate(rounds):
        tagged = part.withColumn("round", F.lit(number))
        claims = tagged if claims is None else claims.unionByName(tagged)
    claims = claims.join(latest, ["chunk", "round"], "left_semi")
    # Claimers of a run come in order, and each goes on where the one before it stopped.
    past = F.max("upto").over(W.partitionBy("node").orderBy("leader").rowsBetween(W.unboundedPreceding, -1))
    first = F.greatest(F.coalesce(past + 1, F.col("node")), F.col("leader") + 1)
    return claims.select("node", first.alias("first"), "upto", "leader").filter("first <= upto")
