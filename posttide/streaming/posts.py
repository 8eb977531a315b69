"""The stateless half of preprocessing on a stream of raw posts.

The jobs are batch jobs; only steps that look at one row run on a stream.
Places need all distinct locations and ids need all rows of a month, so both
stay in the batch plan. The month is that of the row itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from posttide import schemas
from posttide.functions import dates
from posttide.operators import posts


def clean_posts(stream: DataFrame, lang: str = "en") -> DataFrame:
    """Language and hashtag filters, light cleaning and scores; rows without timestamp drop out."""
    kept = posts.filter_valid_hashtags(posts.filter_language(stream, lang))
    dated = kept.withColumn("year_month", dates.post_month(F.col("tweetcreatedts")))
    unplaced = dated.withColumn("place", F.lit(None).cast(schemas.PLACE_TYPE))
    return posts.build_preprocessed(unplaced.where(F.col("year_month").isNotNull()))


def append_clean_posts(stream: DataFrame, path: str, checkpoint: str, lang: str = "en") -> StreamingQuery:
    """Clean what has arrived since the last run into month folders, each post once."""
    return (clean_posts(stream, lang).writeStream.format("parquet").partitionBy("year_month")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
