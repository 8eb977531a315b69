"""Text cleaning and tokenising as SQL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a link, mention, hashtag, emoji, smiley or number.
# These forms use no look-around and mean the same in Java regex and in RE2.
URL = r"(?i)(https?://|www\.)[^\s]+"
MENTION = r"@[\p{L}\p{N}_]+"
HASHTAG = r"#[\p{L}\p{N}_]+"
EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"
SMILEY = r"(?i)(^|\s)([:;=]-?[)(]+|[:;=]-?[dpo]+\b|xd+\b)"
NUMBER = r"(^|\s)-?\d+([.,]\d+)*\b"

# The same sets for Java's matcher, which tries a pattern at every character:
# each starts with one cheap character test and looks back only after it.
FAST_URL = r"(?:[hH][tT][tT][pP][sS]?://|[wW][wW][wW]\.)\S+"
FAST_EMOJI = rf"[\x{{200D}}-\x{{1FAFF}}&&{EMOJI}]"
FAST_SMILEY = r"[:;=xX](?<!\S.)(?:(?<=[xX])[dD]+\b|(?<![xX])-?(?:[)(]+|[dpoDPO]+\b))"
FAST_NUMBER = r"[-0-9](?<!\S.)(?:(?<=-)[0-9]+|(?<!-)[0-9]*)(?:[.,][0-9]+)*\b"

# Two removals in one pass, where neither can make or break a match of the other:
# a link runs to the next blank and an emoji is one character; a mention and a
# hashtag each end before a character that no tag goes on with.
LINK_OR_EMOJI = rf"{FAST_URL}|{FAST_EMOJI}"
MENTION_OR_HASHTAG = r"[@#][\p{L}\p{N}_]+"

# The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Word tokens of two and more characters, and the narrower topic-model tokens.
WORD = r"[\p{L}\p{N}_]{2,}"
TOPIC_WORD = r"[a-zA-Z0-9]{3,}"

# Spark's English stop words; a parameter wherever words are dropped.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if
or because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very
s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

# Joined words a word tokenizer takes apart, and quotes it sets free.
JOINED_PAIRS = ("cannot", "gimme", "gonna", "gotta", "lemme", "wanna")
LOOSE_QUOTES = r"([«»“”‘’„])"
SET_FREE = (r"(?i)(\b(?:" + "|".join(rf"{w[:3]}(?={w[3:]}\b)" for w in JOINED_PAIRS)
            + ")|" + LOOSE_QUOTES[1:-1] + ")")


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, FAST_URL, "")


def strip_mentions(c: Column) -> Column:
    return F.regexp_replace(c, MENTION, "")


def strip_hashtags(c: Column) -> Column:
    return F.regexp_replace(c, HASHTAG, "")


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, FAST_EMOJI, "")


def strip_smileys(c: Column) -> Column:
    return F.regexp_replace(c, FAST_SMILEY, "")


def strip_numbers(c: Column) -> Column:
    return F.regexp_replace(c, FAST_NUMBER, "")


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_leftovers(c: Column, drop_hash: bool = False) -> Column:
    """Remove what HTML escaping and line breaks leave behind; optionally bare `#` signs."""
    if drop_hash:
        c = F.replace(c, F.lit("#"), F.lit(""))
    c = F.replace(c, F.lit("&amp"), F.lit(""))
    return F.replace(c, F.lit("\n"), F.lit(""))


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[!-/:-@\[-`{-~]+", "")


def clean_light(c: Column) -> Column:
    """Links, emoji and smileys out; case and words kept. NULL becomes the empty text."""
    c = strip_smileys(F.regexp_replace(F.coalesce(c, F.lit("")), LINK_OR_EMOJI, ""))
    return strip_leftovers(collapse_blanks(c), drop_hash=True)


def _without_markup(c: Column) -> Column:
    c = strip_urls(F.lower(F.coalesce(c, F.lit(""))))
    return strip_numbers(strip_smileys(strip_emoji(F.regexp_replace(c, MENTION_OR_HASHTAG, ""))))


def clean_heavy_text(c: Column) -> Column:
    """Lower-cased text without links, mentions, hashtags, emoji, smileys, numbers, punctuation."""
    return strip_punctuation(strip_leftovers(collapse_blanks(_without_markup(c))))


def heavy_words(c: Column, stopwords: Sequence[str] = ()) -> Column:
    """Tokens of `clean_heavy_text` without stop words.

    Blanks are not collapsed first: the split takes care of any run of them.
    """
    c = F.replace(_without_markup(c), F.lit("&amp"), F.lit(""))
    return tokenize(strip_punctuation(c), stopwords)


def tokenize(c: Column, stopwords: Sequence[str] = (), split_joined: bool = True) -> Column:
    """Words between blanks, less stop words; order and repeats kept.

    `cannot` and its like fall apart, typographic quotes stand alone.
    """
    if split_joined:
        c = F.regexp_replace(c, SET_FREE, " $1 ")
    return drop_stopwords(F.split(c, r"\s+"), ["", *stopwords])


def drop_stopwords(tokens: Column, words: Sequence[str]) -> Column:
    """Tokens not in `words`; order and repeats kept."""
    words = sorted(set(words))
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def words(c: Column, pattern: str = WORD) -> Column:
    """Lower-cased matches of `pattern`, in text order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))
