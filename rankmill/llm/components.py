"""Connected components by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.session import cut_lineage, release

MOST_ROUNDS = 60


def _hooked(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with the least node among u and its partners.

    The minimum is summed before the shuffle and joined back, so that a node with very
    many partners is never gathered; Spark splits its pairs over several tasks.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _pairs(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """Different (u, v) with u <> v, made of the named columns of each row."""
    each = F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends]))
    return rows.select(each.alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Each linked node with the least node it reaches: ``node``, ``root``.

    ``links`` holds integers. Links of a node to itself and repeated links are allowed;
    nodes without a link to another are not returned. Rounds end when the set of links
    is a star around each root; each round is written to the shared folder, and the one
    before it deleted.
    """
    big, small = F.greatest(left, right), F.least(left, right)
    links = links.select(big.alias("u"), small.alias("v")).where("u <> v").distinct()
    links = cut_lineage(links)
    before = None
    for _ in range(MOST_ROUNDS):
        both = _pairs(links, ("u", "v"), ("v", "u"))
        large = _pairs(_hooked(both).where("v > u"), ("v", "m"))
        done, links = links, cut_lineage(_pairs(_hooked(large), ("u", "m"), ("v", "m")))
        release(done)
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components not found in {MOST_ROUNDS} rounds")
