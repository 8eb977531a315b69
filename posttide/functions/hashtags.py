"""Hashtag texts out of a JSON-like list column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = "array<struct<text:string>>"
#: Lists without any element: the empty object and the empty text.
EMPTY = r'^[ \t\n\r]*(\{[ \t\n\r]*\}|"")[ \t\n\r]*$'


def readable(c: Column) -> Column:
    """An array with the texts of a list such as ``[{'text': 'a'}]``, empty where it is not such a list.

    Single quotes stand for double quotes, so an apostrophe inside a tag makes
    the list unreadable. An empty list, object or text has an empty array of
    texts. Spark reads the first value of a text and ignores what follows, so
    the value is read inside an object, where nothing else may follow, and must
    be the only element inside a list: no text closes both early. Inside an
    object a single tag is not taken for a list of one either.
    """
    quoted = F.replace(c, F.lit("'"), F.lit('"'))
    texts = F.from_json(F.concat(F.lit('{"v":'), quoted, F.lit("}")), f"struct<v:{TAGS}>")["v"]["text"]
    alone = F.size(F.from_json(F.concat(F.lit("["), quoted, F.lit("]")), f"array<{TAGS}>")) == 1
    found = F.when(quoted.rlike(EMPTY), F.array().cast("array<string>")).when(alone, texts)
    return F.filter(F.array(found), lambda t: t.isNotNull() & ~F.exists(t, lambda x: x.isNull()))


def hashtag_texts(c: Column) -> Column:
    """Texts of a list such as ``[{'text': 'a'}]``; NULL where it is not such a list."""
    return F.get(readable(c), 0)
