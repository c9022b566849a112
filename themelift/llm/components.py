"""Connected components of a link table, by rounds of joins.

Each round points the larger neighbours of every node at its smallest neighbour (large star) and
then the smaller ones (small star). Rounds end when the links no longer change; every node then has
one link, to the smallest node of its component. Nothing is collected: the driver sees a count and
a checksum a round. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelift.sizing import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v"), F.col("u"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    other = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return other.union(least.where("u <> m").select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of a link.

    ``links`` has two columns of one ordered type. Links of a node to itself, repeated links and
    links with a null are allowed and change nothing; an empty table has no components.
    """
    names = links.columns
    links = links.select(F.col(names[0]).alias("u"), F.col(names[1]).alias("v")).where("u <> v")
    links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.crc32(F.concat_ws(" ", "u", "v")))).first()
        if now == seen or not now[0]:
            break
        seen = now
        links = stage(_star(_star(links, large=True).distinct(), large=False).distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v"), F.col("v")).distinct()
    )
