"""Request schedule of a one-token limiter per host, for all hosts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.operators.keyed import BLOCK, before_blocks, equal_depth, null_safe_join

DEFAULT_DELAY_US = 500_000


def fetch_pacing(
    arrivals: DataFrame,
    *,
    host: str,
    arrive_us: str,
    tie: str,
    delay_us: int,
    block: int = BLOCK,
) -> DataFrame:
    """Adds ``start_us``: when the limiter lets each request of its host go.

    Request k (from 0, by arrival then ``tie``) starts at max over j <= k of
    (arrive_j + (k - j) * delay). That is a scan: a run of requests is a pair (count, peak), peak
    being the latest arrive_j - j * delay in it, and two runs make (c1 + c2, max(p1, p2 - c1 *
    delay)). Requests are dealt into blocks of equal depth by host and arrival, windowed per host
    and block, and blocks are composed in two levels. So a host with most of the requests lies in
    as many blocks as its share, whether its arrivals are dense or years apart.
    """
    delay = F.lit(delay_us if delay_us > 0 else DEFAULT_DELAY_US).cast("bigint")
    cut = equal_depth(arrivals, [host, arrive_us, tie], block=block)
    in_block = Window.partitionBy(host, "_block").orderBy(arrive_us, tie)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cut.withColumn("_rank", (F.row_number().over(in_block) - 1).cast("bigint"))
    ahead = F.col(arrive_us) - F.col("_rank") * delay
    local = ranked.withColumn("_ahead", F.max(ahead).over(so_far))

    blocks = ranked.groupBy(host, "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.max(ahead).alias("_peak")
    )
    offset = F.coalesce("_before", F.lit(0).cast("bigint"))
    counted = before_blocks(blocks, [host], "_rows", F.sum).select(
        host, "_block", offset.alias("_offset"), (F.col("_peak") - offset * delay).alias("_peak")
    )
    carried = before_blocks(counted, [host], "_peak", F.max).select(
        host, "_block", "_offset", F.col("_before").alias("_carry")
    )
    # greatest() skips the missing carry of a host's first block.
    peak = F.greatest(F.col("_carry"), F.col("_ahead") - F.col("_offset") * delay)
    start = peak + (F.col("_offset") + F.col("_rank")) * delay
    return null_safe_join(local, carried, [host, "_block"]).select(
        *arrivals.columns, start.alias("start_us")
    )
