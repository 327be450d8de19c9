"""Large groups without a large task: members of a group meet in parts of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_parts(members: DataFrame, part: int, group: str = "token", member: str = "node", weight: str = "1") -> DataFrame:
    """``members`` (a written table) with ``part``: 0, but in groups of more than ``part`` rows (or of more than that
    ``weight`` in sum) a number for each two parts, one of them the member's own. Any two members of a
    group meet under some number, and about ``part`` has the same one. No pair is left out, and none
    is written down.
    """
    large = members.groupBy(group).agg(F.expr(f"sum({weight})").alias("k")).filter(f"k > {part}").selectExpr(group, f"cast(ceil(2 * k / {part}) AS long) AS parts")
    own = members.join(large, group, "left").withColumn("own", F.expr(f"pmod(xxhash64({member}), parts)"))
    meets = "transform(filter(sequence(0L, parts - 1), o -> o <> own), o -> least(o, own) * parts + greatest(o, own))"
    return own.withColumn("part", F.explode(F.expr(f"if(parts IS NULL, array(0L), {meets})"))).drop("parts", "own")
