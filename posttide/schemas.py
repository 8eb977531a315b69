"""Column lists and types of the tables that move between the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the input and output columns.
RAW_POST_COLUMNS = [
    "location", "tweetcreatedts", "text", "hashtags", "following", "followers",
    "totaltweets", "retweetcount", "favorite_count", "language",
]
POST_COLUMNS = [
    "location", "tweetcreatedts", "text", "hashtags", "following", "followers",
    "totaltweets", "retweetcount", "favorite_count",
]
GAZETTEER_COLUMNS = [
    "city_name", "city_latitude", "city_longitude",
    "state_code", "state_name", "state_latitude", "state_longitude",
    "country_code", "country_name", "country_latitude", "country_longitude",
]
PREPROCESSED_COLUMNS = [
    "id", "city", "state", "country", "lat", "lon", "date", "text", "hashtags",
    "following", "followers", "total_tweets", "retweet_count", "favorite_count",
    "reach_score", "popularity_score",
]
TRAINING_COLUMNS = ["textID", "text", "selected_text", "sentiment"]
NEGATIVE, POSITIVE = "NEGATIVE", "POSITIVE"

PLACE_TYPE = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

GAZETTEER_TYPES = {
    name: "double" if name.endswith(("latitude", "longitude")) else "string"
    for name in GAZETTEER_COLUMNS
}

PREPROCESSED_TYPES = {
    "id": "bigint", "city": "string", "state": "string", "country": "string",
    "lat": "double", "lon": "double", "date": "string", "text": "string",
    "hashtags": "array<string>", "following": "bigint", "followers": "bigint",
    "total_tweets": "bigint", "retweet_count": "bigint", "favorite_count": "bigint",
    "reach_score": "bigint", "popularity_score": "bigint",
}
LABELLED_TYPES = {**PREPROCESSED_TYPES, "sentiment": "string", "sentiment_score": "double"}
