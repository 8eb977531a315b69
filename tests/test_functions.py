import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from posttide.functions import dates, hashtags, scores, text
from posttide.operators import posts


def one(spark, column_of, values, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r["o"] for r in df.select("i", column_of(F.col("v")).alias("o")).orderBy("i").collect()]


def test_hashtags(spark):
    given = ["[{'text': 'a', 'indices': [1, 2]}]", "[]", """[{'text': "it's"}]""", None, "",
             "[{'text':'a'}] tail", "5", "null", "{'text':'a'}", "[{'x':1}]", "['a']", "{}",
             " [{'text':'b'}, {'text':'c'}] "]
    assert one(spark, hashtags.hashtag_texts, given) == [["a"], []] + [None] * 9 + [[], ["b", "c"]]


def test_hashtags_are_one_whole_list(spark):
    given = ["[{'text':'a'}] [1]", "[{'text':'a'}]]", "[] , []", "[] }", "[], 'x': []", "[{'text':'a'}] ] , [ [1]",
             "[{'text':'a'}, {}]", "[{'text':null}]", "[{'text':'a'},]", "[[{'text':'a'}]]", "[1]",
             " { } ", "''", " [ ]\n", "[{'text':'a','text':'b'}]", "[{'text':5}]"]
    assert one(spark, hashtags.hashtag_texts, given) == [None] * 11 + [[], [], [], ["b"], ["5"]]


def test_scores(spark):
    rows = spark.createDataFrame(
        [("10", "25", "2", "3"), ("25", "10", "2", None), ("x", "5", "2", "5.0"), (None, "5", " 12 ", "1")],
        "following string, followers string, retweets string, favorites string")
    out = rows.select(scores.reach_score(F.col("following"), F.col("followers")).alias("r"),
                      scores.popularity_score(F.col("retweets"), F.col("favorites")).alias("p")).collect()
    assert [r["r"] for r in out] == [15, 0, 0, 0]
    assert [r["p"] for r in out] == [5, 0, 0, 13]


def test_score_overflow_is_zero(spark):
    big = str(2**63 - 1)
    rows = spark.createDataFrame([(big, "1")], "a string, b string")
    assert rows.select(scores.popularity_score(F.col("a"), F.col("b"))).first()[0] == 0


def test_post_month(spark):
    given = ["2022-03-01 10:11:12.123", "2022-03-01", "junk", None, "2022-3-1 1:2:3", "2022-02-30 00:00:00"]
    assert one(spark, dates.post_month, given) == ["2022_03", None, None, None, "2022_03", None]


def test_post_date(spark):
    given = ["2022-02-30", None, "junk", "2022-03-01 10:11:12", "2022-3-1"]
    assert one(spark, dates.post_date, given) == [None] * 3 + [dt.date(2022, 3, 1)] * 2


def test_date_range_is_inclusive(spark):
    given = ["2022-02-28", "2022-03-01", "2023-04-30 23:59", "2023-05-01", None, "junk"]
    df = spark.createDataFrame([(v,) for v in given], "date string")
    kept = {str(r["date"]) for r in posts.filter_dates(df).collect()}
    assert kept == {"2022-03-01", "2023-04-30"}


def test_round_half_even(spark):
    assert one(spark, lambda c: F.bround(c, 2), [0.125, 0.375], "double") == [0.12, 0.38]


def test_recode(spark):
    given = ["positive", "negative", "neutral", None]
    assert one(spark, lambda c: scores.recode(c, {"positive": 1, "negative": 0}), given) == [1, 0, None, None]


def test_not_neutral_keeps_null(spark):
    df = spark.createDataFrame([("1", "a", "a", s) for s in ("neutral", "positive", None)],
                               "textID string, text string, selected_text string, sentiment string")
    assert posts.filter_not_neutral(df).count() == 2
    assert [tuple(r) for r in posts.training_rows(df).collect()] == [("a", 1)]


HARD_TEXTS = [
    "see HTTP://x.y/z?q=😀#a @bob_1 and www.a.b", "a@http://x y", "@abchttp://x y", "#@bob#tag @#tag",
    "x😀:) 😀:) :) :) ;-D =P xd xD XDD xdrive a:b :-o :-oops :D", ":)x :(((", "😀 :)", "x:) 🇩🇪 👩‍👩‍👧 ❶@❶a",
    "1 2,5 -3.4 5pm a1 10:30 1.5pm 7, -x 8- 12345", "-12 --12 1.2.3 1..2", "1", "-1", ":)", "xd",
    "tab\tand\nnewline \r\n end  two   three ", " ", "", "&amp; &ampx\n&amp", "über straße ❤️ ☂ ⛅ ﷽ #日本 #tag_1!",
    "don’t “quote” cannot Cannot gonna gonnax wanna lemme gotta gimme xcannot", "www. https:// http://",
    "#a#b#c @a@b", " :)   5", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "wwW.x HttpS://Y",
]


@pytest.mark.parametrize("fast,plain,by", [
    (text.FAST_URL, text.URL, ""), (text.FAST_EMOJI, text.EMOJI, ""),
    (text.FAST_SMILEY, text.SMILEY, "$1"), (text.FAST_NUMBER, text.NUMBER, "$1")])
def test_fast_patterns_equal_plain_ones(spark, fast, plain, by):
    assert (one(spark, lambda c: F.regexp_replace(c, fast, ""), HARD_TEXTS)
            == one(spark, lambda c: F.regexp_replace(c, plain, by), HARD_TEXTS))


def test_joint_passes_equal_single_ones(spark):
    assert (one(spark, lambda c: F.regexp_replace(c, text.LINK_OR_EMOJI, ""), HARD_TEXTS)
            == one(spark, lambda c: text.strip_emoji(text.strip_urls(c)), HARD_TEXTS))
    assert (one(spark, lambda c: F.regexp_replace(c, text.MENTION_OR_HASHTAG, ""), HARD_TEXTS)
            == one(spark, lambda c: text.strip_hashtags(text.strip_mentions(c)), HARD_TEXTS))


def test_heavy_words_are_words_of_the_heavy_text(spark):
    words = text.STOPWORDS
    assert (one(spark, lambda c: text.heavy_words(c, words), HARD_TEXTS)
            == one(spark, lambda c: text.tokenize(text.clean_heavy_text(c), words), HARD_TEXTS))


def test_punctuation_is_the_32_ascii_characters(spark):
    assert len(set(text.PUNCTUATION)) == 32
    assert one(spark, text.strip_punctuation, ["a" + text.PUNCTUATION + "b", "«ü»"]) == ["ab", "«ü»"]


def test_clean_light(spark):
    given = ["Look #Kyiv https://t.co/x 😀 :) now &amp; then\nend", None]
    assert one(spark, text.clean_light, given) == ["Look Kyiv now ; then end", ""]


def test_tokens_keep_order_and_repeats(spark):
    given = ["The WAR the war @you #tag 12 isn't over, over! cannot"]
    assert one(spark, lambda c: text.heavy_words(c, ["the", "over"]), given) == [["war", "war", "isnt", "can", "not"]]


def test_patterns_have_no_doubtful_escapes():
    for pattern in (text.URL, text.MENTION, text.HASHTAG, text.SMILEY, text.NUMBER):
        assert not re.search(r"\(\?[=!<]", pattern)


def test_stop_words_are_those_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert text.STOPWORDS == StopWordsRemover.loadDefaultStopWords("english")
