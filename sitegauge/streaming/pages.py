"""Page audits on a stream of captures.

Parsing and every per-page rule are stateless, so they run unchanged on micro-batches. Site totals
are kept as partial counts per batch, which a reader sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls as U
from ..operators.parse import parse_pages


def stream_features(pages: DataFrame, base: str = "url") -> DataFrame:
    """Parsed pages of a batch or streaming frame with ``url`` and ``html``."""
    return parse_pages(pages.withColumn("site_id", U.host(F.col("url"))), base=base, keep_html=False)


def refresh_site_counts(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Per batch, append each site's partial page counts; replays of a batch overwrite their own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        titled = F.count_if(F.trim("title") != "")
        counts = stream_features(batch).groupBy("site_id").agg(F.count(F.lit(1)).alias("n_pages"), titled.alias("n_titled"))
        counts.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
