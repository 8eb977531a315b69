"""The registered queries once more, as SQL for DuckDB.

Written from the rules, not from the Spark plans: places by trying every entry,
ids by one window, lemmas by stripping suffixes, t tails by numeric integration.
"""

from __future__ import annotations

from posttide.functions import text
from posttide.operators import tagging, topics
from posttide.operators.lemmas import SUFFIX_RULES
from posttide.plans import adapters
from posttide.plans.queries import PERIOD, SAMPLE


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _drop(expr: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({expr}, {_quote(pattern)}, {_quote(by)}, 'g')"


def _ctes(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS (\n{sql.strip()}\n)" for name, sql in parts.items())


POSTS = adapters.duck(adapters.POSTS)
GAZETTEER = adapters.duck(adapters.GAZETTEER)
LABELLED = adapters.duck(adapters.LABELLED)
TRAINING = adapters.duck(adapters.TRAINING)
PLACES, STATES = adapters.duck(adapters.PLACES), adapters.duck(adapters.STATES)
ENGLISH = "SELECT * FROM posts WHERE language = 'en'"

# Scalars

def _int(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN CAST(trim({c}) AS BIGINT) END"


POPULARITY = f"coalesce(({_int('retweetcount')}) + ({_int('favorite_count')}), 0)"
REACH = (f"CASE WHEN ({_int('following')}) IS NULL OR ({_int('followers')}) IS NULL THEN 0 "
         f"ELSE greatest(({_int('followers')}) - ({_int('following')}), 0) END")
POST_MONTH = "strftime(try_strptime(split_part(tweetcreatedts, '.', 1), '%Y-%m-%d %H:%M:%S'), '%Y_%m')"
QUOTED = "replace(hashtags, chr(39), chr(34))"
TAGS = (f"CASE WHEN json_valid({QUOTED}) AND json_type({QUOTED}) = 'ARRAY' "
        f"AND len(json_extract({QUOTED}, '$[*]')) = len(json_extract_string({QUOTED}, '$[*].text')) "
        f"THEN array_to_string(json_extract_string({QUOTED}, '$[*].text'), '|') "
        f"WHEN json_valid({QUOTED}) AND json_type({QUOTED}) = 'OBJECT' AND len(json_keys({QUOTED})) = 0 THEN '' END")


def _light(c: str) -> str:
    c = _drop(_drop(_drop(f"coalesce({c}, '')", text.URL), text.EMOJI), text.SMILEY, r"\1")
    c = f"trim({_drop(c, r'\s+', ' ')})"
    return f"replace(replace(replace({c}, '#', ''), '&amp', ''), chr(10), '')"


def _heavy(c: str) -> str:
    c = _drop(_drop(_drop(f"lower(coalesce({c}, ''))", text.URL), text.MENTION), text.HASHTAG)
    c = _drop(_drop(_drop(c, text.EMOJI), text.SMILEY, r"\1"), text.NUMBER, r"\1")
    c = f"replace(replace(trim({_drop(c, r'\s+', ' ')}), '&amp', ''), chr(10), '')"
    return f"translate({c}, {_quote(text.PUNCTUATION)}, '')"


def _tokens(c: str, stopwords=text.STOPWORDS) -> str:
    c = _drop(c, text.LOOSE_QUOTES, r" \1 ")
    for joined in text.JOINED_PAIRS:
        c = _drop(c, rf"(?i)\b({joined[:3]})({joined[3:]})\b", r"\1 \2")
    words = ", ".join(_quote(w) for w in ["", *stopwords])
    return (f"list_filter(string_split_regex({c}, '\\s+'), "
            f"lambda t: t <> '' AND NOT list_contains([{words}], t))")


def _words(c: str, pattern: str = text.WORD) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), {_quote(pattern)})"


# Relations

FILE_MONTH = f"""
SELECT file, arg_min({POST_MONTH}, pos) AS year_month FROM posts
WHERE ({POST_MONTH}) IS NOT NULL GROUP BY file
"""
DATED = "SELECT posts.*, year_month FROM posts JOIN file_month USING (file)"

ENTRIES = """
SELECT lower(state_code) AS key, row_id, 0 AS pos, '' AS city, state_name AS state, country_name AS country,
  state_latitude AS lat, state_longitude AS lon FROM gaz WHERE state_code IS NOT NULL
UNION ALL SELECT lower(country_code), row_id, 1, '', '', country_name, country_latitude, country_longitude
  FROM gaz WHERE country_code IS NOT NULL
UNION ALL SELECT lower(city_name), row_id, 2, city_name, state_name, country_name, city_latitude, city_longitude
  FROM gaz
UNION ALL SELECT lower(state_name), row_id, 3, '', state_name, country_name, state_latitude, state_longitude
  FROM gaz
UNION ALL SELECT lower(country_name), row_id, 4, '', '', country_name, country_latitude, country_longitude
  FROM gaz
"""
EMPTY = "(CASE WHEN city = '' THEN 1 ELSE 0 END + CASE WHEN state = '' THEN 1 ELSE 0 END)"
ENTRIES_ONCE = """
SELECT key, row_id, pos, city, state, country, lat, lon FROM every_entry
QUALIFY row_number() OVER (PARTITION BY key, city, state, country, lat, lon ORDER BY row_id, pos) = 1
"""
KEYED = f"SELECT *, {EMPTY} AS n_empty, count(*) OVER (PARTITION BY key) AS n FROM entries"


def _resolved(fold: str) -> dict[str, str]:
    """Every candidate of every location, then the best one; `fold` is applied to compared names."""
    element = "unnest(list_distinct([city, state, country]))"
    return {
        "keyed": KEYED,
        "parts": f"""
          SELECT location, i, trim(replace(parts[i], '.', '')) AS raw FROM (
            SELECT location, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
              SELECT DISTINCT location, string_split(location, ',') AS parts FROM posts
              WHERE location IS NOT NULL))""",
        "tokens": f"SELECT location, i, {fold.format('raw')} AS token FROM parts",
        "candidates": f"""
          SELECT location, n_empty, i, -1 AS j, row_id, pos, city, state, country, lat, lon
          FROM tokens JOIN keyed ON token = key WHERE n = 1
          UNION ALL
          SELECT a.location, n_empty, a.i, b.i, row_id, pos, city, state, country, lat, lon
          FROM tokens a JOIN (SELECT *, {element} AS element FROM keyed WHERE n > 1) k ON a.token = k.key
          JOIN tokens b ON a.location = b.location AND b.i > a.i AND b.token = {fold.format('element')}""",
        "resolved": """
          SELECT location, city, state, country, lat, lon FROM candidates
          QUALIFY row_number() OVER (PARTITION BY location ORDER BY n_empty, i, j, row_id, pos) = 1""",
    }


LEXICON = """
SELECT w AS surface, ['n', 'v', 'a'][length(w) % 3 + 1] AS pos,
  CASE WHEN length(w) = 5 AND w LIKE '%n' THEN left(w, 4) ELSE w END AS lemma, count(*) AS freq
FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}')) AS w FROM documents)
WHERE length(w) <= 5 GROUP BY ALL
"""
CLASSES = """
SELECT surface AS token, pos, lemma FROM lexicon
QUALIFY row_number() OVER (PARTITION BY surface ORDER BY freq DESC, pos, lemma) = 1
"""
RULES = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_quote(p)}, {_quote(e)}, {_quote(b)})" for i, (p, e, b) in enumerate(SUFFIX_RULES)
) + ") AS r(rule, rule_pos, ending, base)"


def _stripped(source: str) -> str:
    """Lemma per word of `source`: a listed form first, else the first rule that leads to a lemma."""
    return f"""
    SELECT token, coalesce(listed.lemma, stem) AS lemma FROM (
      SELECT w.token, arg_min(l.lemma, rule) AS stem
      FROM (SELECT DISTINCT token FROM {source}) w
      LEFT JOIN rules r ON w.token LIKE '%' || r.ending
      LEFT JOIN (SELECT DISTINCT lemma, pos FROM lexicon) l
        ON l.pos = r.rule_pos AND l.lemma = left(w.token, length(w.token) - length(r.ending)) || r.base
      GROUP BY w.token
    ) LEFT JOIN classes listed USING (token)"""


def _in_context(rows: str) -> dict[str, str]:
    """The best sequence of classes of each row's tokens, by a fold over their scores."""
    known = ", ".join(_quote(c) for c in tagging.CLASSES)
    k = range(1, len(tagging.CLASSES) + 1)

    def score(n: str, of: str) -> str:
        return f"CAST(floor(ln(CAST({n} AS DOUBLE) / CAST({of} AS DOUBLE)) * {tagging.SCALE}) AS BIGINT)"

    def first(of: list[str], best: str) -> str:
        return "CASE " + " ".join(f"WHEN {x} = {best} THEN acc.p[{p}]" for p, x in zip(k, of)) + " END"

    reach = [[f"acc.s[{p}] + after[{p}][{c}]" for p in k] for c in k]
    best = [f"greatest({', '.join(of)})" for of in reach]
    ends = [f"acc.s[{p}]" for p in k]
    return {
        "tagged": """SELECT row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,}') AS ts
                     FROM conversations""",
        "tagged_words": f"""SELECT r, i, ts[i] AS w,
            [{known}][(length(ts[i]) + coalesce(length(ts[i - 1]), 0)) % {len(k)} + 1] AS c
            FROM tagged, unnest(range(1, len(ts) + 1)) AS t(i)""",
        "classes": f"SELECT unnest([{known}]) AS c",
        "steps": "SELECT coalesce(lag(c) OVER (PARTITION BY r ORDER BY i), '') AS b, c FROM tagged_words",
        "counted_steps": """SELECT b.b, k.c, count(s.c) AS n FROM (SELECT '' AS b UNION ALL SELECT c FROM classes) b
            CROSS JOIN classes k LEFT JOIN steps s ON s.b = b.b AND s.c = k.c GROUP BY b.b, k.c""",
        "follow": f"""SELECT b, list(s ORDER BY c) AS s FROM (
            SELECT b, c, {score('n + 1', f'sum(n) OVER (PARTITION BY b) + {len(k)}')} AS s FROM counted_steps) GROUP BY b""",
        "word_counts": "SELECT w, c, count(*) AS n FROM tagged_words GROUP BY w, c",
        "vocabulary_size": "SELECT count(DISTINCT w) AS v FROM word_counts",
        "class_totals": """SELECT k.c, coalesce(sum(n), 0) + any_value(v) + 1 AS t
            FROM classes k LEFT JOIN word_counts USING (c), vocabulary_size GROUP BY k.c""",
        "word_scores": f"""SELECT w, list(s ORDER BY c) AS e FROM (
            SELECT d.w, t.c, {score('coalesce(n, 0) + 1', 't')} AS s FROM (SELECT DISTINCT w FROM word_counts) d
            CROSS JOIN class_totals t LEFT JOIN word_counts USING (w, c)) GROUP BY w""",
        "unknown_word": f"SELECT list({score('1', 't')} ORDER BY c) AS u FROM class_totals",
        "all_heavy": f"SELECT row_key, {_tokens(_heavy('raw'), ())} AS h FROM ({rows})",
        "each_token": "SELECT row_key, unnest(h) AS w, unnest(range(len(h))) AS i FROM all_heavy",
        "scored_tokens": f"""SELECT row_key, list({{'s': [{', '.join(
            f'x[{c}] + CASE WHEN i = 0 THEN start[{c}] ELSE 0 END' for c in k)}], 'p': [{known}]}} ORDER BY i) AS l
            FROM (SELECT row_key, i, coalesce(e, u) AS x FROM each_token LEFT JOIN word_scores USING (w), unknown_word),
                 (SELECT s AS start FROM follow WHERE b = '') GROUP BY row_key""",
        "folded_tokens": f"""SELECT row_key, list_reduce(l, lambda acc, x: {{'s': [{', '.join(
            f'{best[c - 1]} + x.s[{c}]' for c in k)}], 'p': [{', '.join(
            f'{first(reach[c - 1], best[c - 1])} || x.p[{c}]' for c in k)}]}}) AS acc
            FROM scored_tokens, (SELECT list(s ORDER BY b) AS after FROM follow WHERE b <> '')""",
        "best_paths": f"SELECT row_key, {first(ends, f'greatest({chr(44).join(ends)})')} AS path FROM folded_tokens",
    }


CLASS_LEXICON = """
SELECT w AS surface, pos, left(w, length(w) - CASE WHEN pos = 'v' THEN 1 ELSE 2 END) AS lemma, freq
FROM (SELECT w, count(*) AS freq FROM (
        SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) AS w FROM documents)
      WHERE length(w) <= 6 GROUP BY w)
JOIN (VALUES ('n', 'e'), ('v', 'n'), ('a', 'o'), ('v', 'e')) AS e(pos, ending) ON w LIKE '%' || ending
"""
LEMMAS_IN_CONTEXT = {
    "class_lexicon": CLASS_LEXICON, "rules": RULES,
    "placed_words": "SELECT row_key, i, w, path[i + 1] AS c FROM each_token JOIN best_paths USING (row_key)",
    "asked_words": "SELECT DISTINCT w, c FROM placed_words",
    "listed_lemmas": """SELECT surface AS w, pos AS c, lemma FROM class_lexicon
        QUALIFY row_number() OVER (PARTITION BY surface, pos ORDER BY freq DESC, lemma) = 1""",
    "ruled_lemmas": """SELECT a.w, a.c, arg_min(l.lemma, rule) AS lemma FROM asked_words a
        JOIN rules r ON r.rule_pos = a.c AND a.w LIKE '%' || r.ending
        JOIN (SELECT DISTINCT lemma, pos FROM class_lexicon) l
          ON l.pos = a.c AND l.lemma = left(a.w, length(a.w) - length(r.ending)) || r.base GROUP BY a.w, a.c""",
}


def _monthly(measures: str) -> str:
    return f"""
    SELECT country, strftime(date_trunc('month', CAST(date AS DATE)), '%Y-%m-%d') AS month, {measures}
    FROM labelled WHERE CAST(date AS DATE) BETWEEN DATE '{PERIOD['start']}' AND DATE '{PERIOD['end']}'
    GROUP BY ALL"""


NEG, POS = "count(*) FILTER (sentiment = 'NEGATIVE')", "count(*) FILTER (sentiment = 'POSITIVE')"
SIGN = "CASE sentiment WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 END"
SIGNED = f"SELECT *, CAST({SIGN} AS DOUBLE) AS v FROM labelled"
ROW_COUNT = "SELECT country, count(*) AS n_posts FROM labelled {} GROUP BY country"
KNOWN = "WHERE sentiment IN ('NEGATIVE', 'POSITIVE')"
NO_NUMBER = "CAST('nan' AS DOUBLE)"


def _t(popmean: float, propagate: bool) -> str:
    hole = "count(v) < count(*) OR" if propagate else ""
    return (f"CASE WHEN {hole} count(v) < 2 THEN {NO_NUMBER} "
            f"ELSE (avg(v) - {popmean}e0) / (stddev_samp(v) / sqrt(count(v))) END")


TESTED = f"""
SELECT country, count(*) AS n_posts, count(v) AS n, {_t(0.5, True)} AS t,
  round_even(count(*) FILTER (v = -1) / count(*), 2) AS ratio
FROM signed GROUP BY country ORDER BY n_posts DESC, country LIMIT 20
"""
# Two-sided tail as a ratio of integrals of cos^(dof-1) from atan(|t|/sqrt(dof)), by midpoints.
TAILS = """
SELECT country, n_posts, n, t, ratio, CASE WHEN isnan(t) THEN t ELSE
  sum(exp((n - 2) * ln(cos(least(start + (i + 0.5) * step, pi() / 2 - 1e-12))))) * any_value(step)
  / (sum(exp((n - 2) * ln(cos((i + 0.5) * whole)))) * any_value(whole)) END AS p
FROM (SELECT *, CASE WHEN isnan(t) THEN 0 ELSE atan(abs(t) / sqrt(n - 1)) END AS start,
        (pi() / 2 - start) / 40000 AS step, pi() / 2 / 40000 AS whole FROM tested),
     (SELECT unnest(range(40000)) AS i)
GROUP BY country, n_posts, n, t, ratio
"""

NUMBERED_KEY = "md5(concat('{}:', {}))"


def _terms(source: str) -> str:
    words = _words("text", text.TOPIC_WORD)
    return f"""
    SELECT term, CAST(count(*) AS BIGINT) AS term_freq, CAST(count(DISTINCT row_key) AS BIGINT) AS doc_freq
    FROM (SELECT row_key, unnest({words}) AS term FROM {source}) GROUP BY term"""


def _ngrams(n: int) -> str:
    run = f"array_to_string(list_slice(w, i, i + {n - 1}), ' ')"
    return f"""
    SELECT {run} AS ngram, count(*) AS n FROM (
      SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM (
        SELECT {_words('text')} AS w FROM posts))
    GROUP BY 1"""


VOCABULARY = "SELECT * FROM stats WHERE doc_freq >= 3 ORDER BY term_freq DESC, term LIMIT 5000"
FOLDS = """
SELECT *, ntile(5) OVER (ORDER BY md5(concat('42:', {key})), {key}) AS fold FROM {source}
"""
TRAINING_ROWS = """
SELECT textID, text, CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END AS label
FROM training WHERE sentiment IN ('positive', 'negative')
"""
BUILT = f"""
SELECT row_key, file, pos, year_month, nullif(city, '') AS city, nullif(state, '') AS state,
  nullif(country, '') AS country, lat, lon, tweetcreatedts AS date, text AS raw_text, {_light('text')} AS text,
  {TAGS} AS hashtags, {_int('following')} AS following, {_int('followers')} AS followers,
  {_int('totaltweets')} AS total_tweets, {_int('retweetcount')} AS retweet_count,
  {_int('favorite_count')} AS favorite_count, CAST({REACH} AS BIGINT) AS reach_score,
  {POPULARITY} AS popularity_score
FROM dated LEFT JOIN resolved USING (location)
WHERE language = 'en' AND ({TAGS}) IS NOT NULL
"""


def _preprocessing(**more: str) -> str:
    return _ctes(posts=POSTS, file_month=FILE_MONTH, dated=DATED, gaz=GAZETTEER, entries=ENTRIES,
                 **_resolved("{}"), built=BUILT, **more)


NUMBERED = "SELECT *, row_number() OVER (PARTITION BY year_month ORDER BY {}) AS id FROM {}"
LOCATED = "SELECT * FROM built WHERE lon IS NOT NULL AND (date IS NULL OR date <> '')"
WORDS_OF_ENGLISH = f"SELECT row_key, unnest(h) AS token, unnest(range(len(h))) AS i FROM heavy"


def _lemmatised(rows: str) -> dict[str, str]:
    return {
        "heavy": f"SELECT row_key, {_tokens(_heavy('raw'))} AS h FROM ({rows})",
        "word": WORDS_OF_ENGLISH, "lexicon": LEXICON, "classes": CLASSES, "rules": RULES,
        "lemmas": _stripped("word"),
        "joined": """SELECT row_key, string_agg(coalesce(lemma, token), ' ' ORDER BY i) AS tokens
                     FROM word LEFT JOIN lemmas USING (token) GROUP BY row_key""",
    }


def _bayes(learnt: str, asked: str) -> dict[str, str]:
    """Naive Bayes over word counts: `asked` (k, text, fold) scored by all rows of `learnt` in other folds."""
    words = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
    return {
        "learnt": learnt, "asked": asked,
        "known": f"""SELECT term FROM (SELECT textID, unnest({words}) AS term FROM rows) GROUP BY term
                     HAVING count(DISTINCT textID) >= 3 ORDER BY count(*) DESC, term LIMIT 5000""",
        "each": f"SELECT fold, label, term FROM (SELECT fold, label, unnest({words}) AS term FROM learnt) SEMI JOIN known USING (term)",
        "tried": "SELECT DISTINCT fold FROM asked",
        "docs": """SELECT t.fold, count(*) FILTER (label = 0) AS d0, count(*) FILTER (label = 1) AS d1
                   FROM tried t JOIN learnt l ON l.fold <> t.fold GROUP BY t.fold""",
        "terms": """SELECT t.fold, term, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1
                    FROM tried t JOIN each e ON e.fold <> t.fold GROUP BY t.fold, term""",
        "sums": "SELECT fold, sum(c0) + (SELECT count(*) FROM known) AS t0, sum(c1) + (SELECT count(*) FROM known) AS t1 FROM terms GROUP BY fold",
        "used": f"""SELECT k, fold, term FROM (SELECT k, fold, unnest({words}) AS term FROM asked) SEMI JOIN known USING (term)""",
        "logs": """SELECT k, sum(ln(coalesce(c0, 0) + 1) - ln(t0)) AS l0, sum(ln(coalesce(c1, 0) + 1) - ln(t1)) AS l1
                   FROM used JOIN sums USING (fold) LEFT JOIN terms USING (fold, term) GROUP BY k""",
        "scored": """SELECT k, coalesce(l0, 0) + ln(d0 + 1) - ln(d0 + d1 + 2) AS s0,
                     coalesce(l1, 0) + ln(d1 + 1) - ln(d0 + d1 + 2) AS s1
                     FROM asked JOIN docs USING (fold) LEFT JOIN logs USING (k)""",
    }


def build() -> dict[str, str]:
    posts = _ctes(posts=POSTS)
    english = _ctes(posts=POSTS, english=ENGLISH)
    labelled = _ctes(labelled=LABELLED)
    signed = _ctes(labelled=LABELLED, signed=SIGNED)
    gaz = _ctes(gaz=GAZETTEER, entries=ENTRIES)
    training = _ctes(training=TRAINING, rows=TRAINING_ROWS)
    top = "ORDER BY n_posts DESC, country LIMIT"
    merged = """SELECT p.country_name, p.state_name, city_name, city_latitude, city_longitude, row_id, state_code,
      state_latitude, state_longitude, country_code, country_latitude, country_longitude
      FROM places p JOIN states s ON """
    merge = _ctes(places=PLACES, states=STATES)
    tag_count = f"({TAGS}) IS NOT NULL"
    place = "row_key, location, city, state, country, lat, lon"
    key = NUMBERED_KEY.format(0, "id")
    numbered = f"SELECT *, row_number() OVER (PARTITION BY year_month ORDER BY {key}, id) AS place FROM labelled"
    t_alpha = "2.1318467863266499"
    accuracy_row = f"""SELECT round(avg(a), 6) AS mean_accuracy, round(stddev_pop(a), 6) AS sd, count(a) AS n,
            round((avg(a) - 0.333e0) / (stddev_pop(a) / sqrt(count(a))), 6) AS t,
            round({t_alpha}e0, 6) AS critical,
            (avg(a) - 0.333e0) / (stddev_pop(a) / sqrt(count(a))) > {t_alpha}e0 AS reject FROM accuracies"""
    vocabulary = _ctes(
        posts=POSTS, stats=_terms("posts"), vocab=VOCABULARY,
        counted=f"""SELECT row_key, term FROM (SELECT row_key, unnest({_words('text', text.TOPIC_WORD)}) AS term
                    FROM posts) SEMI JOIN vocab USING (term)""",
        topic_numbers=f"SELECT unnest(range({topics.TOPICS})) AS topic",
        raw_weights="""SELECT topic, term, term_freq * ((length(term) * 7 + topic * 3) % 11 + 1) AS raw
                       FROM vocab CROSS JOIN topic_numbers""",
        weights="SELECT topic, term, raw / sum(raw) OVER (PARTITION BY topic) AS weight FROM raw_weights",
        sizes="SELECT row_key, count(term) AS n_terms FROM posts LEFT JOIN counted USING (row_key) GROUP BY row_key",
        raw_shares="""SELECT row_key, n_terms, topic, (row_key * 31 + topic * 17) % 97 + 1 AS raw
                      FROM sizes CROSS JOIN topic_numbers""",
        shares="SELECT row_key, n_terms, topic, raw / sum(raw) OVER (PARTITION BY row_key) AS share FROM raw_shares")
    folded = _ctes(training=TRAINING, rows=TRAINING_ROWS, folds=FOLDS.format(key="textID", source="rows"),
                   **_bayes("SELECT * FROM folds", "SELECT textID AS k, text, fold FROM folds"),
                   predicted="SELECT folds.*, s0, s1 FROM folds JOIN scored ON k = textID")
    sql = {
        "language_filter": f"{english} SELECT location, tweetcreatedts, text, hashtags FROM english",
        "post_projection": f"""{posts} SELECT row_key, tweetcreatedts AS date, {_light('text')} AS text,
            {TAGS} AS hashtags, {_int('following')} AS following, {_int('followers')} AS followers,
            {_int('totaltweets')} AS total_tweets, {_int('retweetcount')} AS retweet_count,
            {_int('favorite_count')} AS favorite_count, CAST({REACH} AS BIGINT) AS reach_score,
            {POPULARITY} AS popularity_score
            FROM posts WHERE language = 'en' AND {tag_count}""",
        "hashtag_extract": f"{posts} SELECT row_key, {TAGS} AS hashtags FROM posts WHERE {tag_count}",
        "popularity_reach": f"""{posts} SELECT row_key, {POPULARITY} AS popularity_score,
            CAST({REACH} AS BIGINT) AS reach_score FROM posts""",
        "post_month": f"{posts} SELECT row_key, {POST_MONTH} AS year_month FROM posts",
        "file_month": f"""{_ctes(posts=POSTS, file_month=FILE_MONTH, dated=DATED)}
            SELECT row_key, file, year_month FROM dated""",
        "date_range": f"""{labelled} SELECT id, date,
            strftime(date_trunc('month', CAST(date AS DATE)), '%Y-%m-%d') AS month FROM labelled
            WHERE CAST(date AS DATE) BETWEEN DATE '{PERIOD['start']}' AND DATE '{PERIOD['end']}'""",
        "label_signs": f"{labelled} SELECT id, {SIGN} AS sign FROM labelled",
        "training_rows": f"{training} SELECT textID, text, label FROM rows",
        "clean_light": f"{posts} SELECT row_key, {_light('text')} AS text FROM posts",
        "clean_each_pattern": f"""{posts} SELECT row_key, {_drop('text', text.URL)} AS urls,
            {_drop('text', text.MENTION)} AS mentions, {_drop('text', text.HASHTAG)} AS hashtags,
            {_drop('text', text.EMOJI)} AS emoji, {_drop('text', text.SMILEY, chr(92) + '1')} AS smileys,
            {_drop('text', text.NUMBER, chr(92) + '1')} AS numbers,
            replace(replace(text, '&amp', ''), chr(10), '') AS leftovers,
            translate(text, {_quote(text.PUNCTUATION)}, '') AS punctuation FROM posts""",
        "tokens_no_stopwords": f"""{posts}
            SELECT row_key, array_to_string({_tokens(_heavy('text'))}, ' ') AS tokens FROM posts""",
        "token_classes": f"{_ctes(lexicon=LEXICON, classes=CLASSES)} SELECT token, pos, lemma FROM classes",
        "lemma_table": f"""{_ctes(lexicon=LEXICON, classes=CLASSES, rules=RULES, forms='''
              SELECT surface AS token FROM lexicon UNION
              SELECT left(lemma, length(lemma) - length(base)) || ending FROM lexicon JOIN rules
              ON pos = rule_pos AND lemma LIKE '%' || base''', lemmas=_stripped('forms'))}
            SELECT token, lemma FROM lemmas""",
        "clean_heavy": f"""{_ctes(posts=POSTS, english=ENGLISH,
                                  **_lemmatised('SELECT row_key, text AS raw FROM english'))}
            SELECT row_key, coalesce(tokens, '') AS tokens FROM english LEFT JOIN joined USING (row_key)""",
        "token_classes_in_context": f"""{_ctes(posts=POSTS, english=ENGLISH,
                                             **_in_context('SELECT row_key, text AS raw FROM english'))}
            SELECT row_key, coalesce(path, '') AS classes FROM english LEFT JOIN best_paths USING (row_key)""",
        "clean_heavy_in_context": f"""{_ctes(posts=POSTS, english=ENGLISH,
              **_in_context('SELECT row_key, text AS raw FROM english'), **LEMMAS_IN_CONTEXT, joined=f'''
              SELECT row_key, string_agg(coalesce(li.lemma, ru.lemma, w) , ' ' ORDER BY i) AS tokens
              FROM placed_words LEFT JOIN listed_lemmas li USING (w, c) LEFT JOIN ruled_lemmas ru USING (w, c)
              WHERE w NOT IN ({", ".join(_quote(w) for w in text.STOPWORDS)}) GROUP BY row_key''')}
            SELECT row_key, coalesce(tokens, '') AS tokens FROM english LEFT JOIN joined USING (row_key)""",
        "gazetteer_merge": f"""{merge} {merged} p.country_name IS NOT DISTINCT FROM s.country_name
            AND p.state_name IS NOT DISTINCT FROM s.state_name""",
        "gazetteer_merge_strict": f"""{merge} {merged} p.country_name = s.country_name
            AND p.state_name = s.state_name""",
        "gazetteer_projection": f"{gaz} SELECT * EXCLUDE (row_id) FROM gaz",
        "gazetteer_csv": f"{gaz} SELECT * EXCLUDE (row_id), row_number() OVER (ORDER BY row_id) AS row_id FROM gaz",
        "training_csv": f"{training} SELECT textID, md5(text) AS text_md5, sentiment FROM training",
        "labelled_csv": f"{labelled} SELECT id, country, date, year_month, sentiment, sentiment_score FROM labelled",
        "place_entries": f"{gaz} SELECT key, row_id, pos, city, state, country, lat, lon FROM entries",
        "place_index": f"""{_ctes(gaz=GAZETTEER, entries=ENTRIES, keyed=KEYED)}
            SELECT key, NULL AS element, n_empty, row_id, pos, city, state, country, lat, lon
            FROM keyed WHERE n = 1
            UNION ALL SELECT key, element, n_empty, row_id, pos, city, state, country, lat, lon FROM (
              SELECT *, row_number() OVER (PARTITION BY key, element ORDER BY n_empty, row_id, pos) AS r FROM (
                SELECT *, unnest(list_distinct([city, state, country])) AS element FROM keyed WHERE n > 1))
            WHERE r = 1""",
        "resolve_location": f"""{_ctes(posts=POSTS, gaz=GAZETTEER, entries=ENTRIES, **_resolved('{}'))}
            SELECT {place} FROM posts LEFT JOIN resolved USING (location)""",
        "resolve_location_any_case": f"""
            {_ctes(posts=POSTS, gaz=GAZETTEER, every_entry=ENTRIES, entries=ENTRIES_ONCE,
                   **_resolved('lower({})'))}
            SELECT {place} FROM posts LEFT JOIN resolved USING (location)""",
        "located_posts": f"""{_preprocessing(located=LOCATED)}
            SELECT row_key, city, state, country, lat, lon, date FROM located""",
        "month_ids": f"""{_ctes(posts=POSTS, file_month=FILE_MONTH, dated=DATED,
                                numbered=NUMBERED.format('file, pos', 'dated'))}
            SELECT row_key, year_month, file, id FROM numbered""",
        "fold_assignment": f"""{_ctes(posts=POSTS, folds=FOLDS.format(key='row_key', source='posts'))}
            SELECT row_key, CAST(fold AS INTEGER) AS fold FROM folds""",
        "sample_exact": f"""{_ctes(labelled=LABELLED, numbered=numbered)}
            SELECT id, year_month FROM numbered WHERE place <= {SAMPLE}""",
        "preprocessed_light": f"""{_preprocessing(numbered=NUMBERED.format('file, pos', 'built'))}
            SELECT * EXCLUDE (row_key, file, pos, raw_text) FROM numbered""",
        "preprocessed_heavy": f"""
            {_preprocessing(**_lemmatised('SELECT row_key, raw_text AS raw FROM built'))}
            SELECT row_key, year_month, country, coalesce(tokens, '') AS text, reach_score
            FROM built LEFT JOIN joined USING (row_key)""",
        "union_labelled": f"""{labelled} SELECT id, country, date, sentiment,
            CASE WHEN year_month >= '1998_01' THEN sentiment_score END AS sentiment_score FROM labelled""",
        "csv_by_header": f"""{posts} SELECT row_key, location, language, md5(text) AS text_md5,
            CASE WHEN row_key % 3 < 2 THEN followers END AS followers FROM posts""",
        "row_file_counts": f"""{posts} SELECT count(*) AS n_rows, count(DISTINCT file) AS n_files FROM posts""",
        "write_read_partitioned": f"""{_preprocessing(numbered=NUMBERED.format("file >= 'src15', file, pos", 'built'))}
            SELECT year_month, id, text, country, date FROM numbered""",
        "append_retried": f"""{_preprocessing(numbered=NUMBERED.format("file >= 'src15', file, pos", 'built'))}
            SELECT year_month, id, text, country, date FROM numbered""",
        "write_read_located": f"""{_preprocessing(located=LOCATED, numbered=NUMBERED.format('file, pos', 'located'))}
            SELECT year_month, id, country, lat, lon, date FROM numbered""",
        "read_one_month": f"""{labelled} SELECT id, country, sentiment, sentiment_score FROM labelled
            WHERE year_month = '1996_03'""",
        "write_by_country": f"""{labelled} SELECT country, left(year_month, 5) || '01' AS year_month,
            count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM labelled GROUP BY ALL""",
        "sentiment_counts": f"""{_ctes(labelled=LABELLED, monthly=_monthly(f'{NEG} AS Negative, {POS} AS Positive'),
              totals='SELECT country, sum(Negative + Positive) AS n_posts FROM monthly GROUP BY country')}
            SELECT * FROM monthly WHERE Negative + Positive > 0
            AND country IN (SELECT country FROM totals {top} 20)""",
        "sentiment_means": f"""{_ctes(labelled=LABELLED, monthly=_monthly(f'''count(*) AS n, {NEG} + {POS} AS known,
              round(coalesce(avg(sentiment_score) FILTER (sentiment = 'NEGATIVE'), 0), 6) AS Negative,
              round(coalesce(avg(sentiment_score) FILTER (sentiment = 'POSITIVE'), 0), 6) AS Positive'''),
              totals='SELECT country, sum(n) AS n_posts FROM monthly GROUP BY country')}
            SELECT country, month, Negative, Positive FROM monthly WHERE known > 0
            AND country IN (SELECT country FROM totals {top} 20)""",
        "country_totals": f"""{_ctes(labelled=LABELLED, monthly=_monthly(f'{NEG} + {POS} AS n'))}
            SELECT country, CAST(sum(n) AS BIGINT) AS n_posts FROM monthly GROUP BY country""",
        "top_countries": f"{labelled} {ROW_COUNT.format('')} {top} 20",
        "top_countries_labelled": f"{labelled} {ROW_COUNT.format(KNOWN)} {top} 20",
        "top_country_posts": f"""{_ctes(labelled=LABELLED, counted=ROW_COUNT.format(''))}
            SELECT id, country FROM labelled WHERE country IN (SELECT country FROM counted {top} 5)""",
        "negative_ratio": f"""{signed} SELECT country,
            round_even(count(*) FILTER (v = -1) / count(*), 2) AS negative_ratio FROM signed GROUP BY country""",
        "sentiment_ttest": f"""{signed} SELECT country, count(*) AS n_posts, count(v) AS n,
            round({_t(0.5, True)}, 6) AS t FROM signed GROUP BY country""",
        "sentiment_ttest_omit": f"""{signed} SELECT country, count(*) AS n_posts, count(v) AS n,
            round(avg(v), 6) AS mean, round({_t(0.4, False)}, 6) AS t FROM signed GROUP BY country""",
        "sentiment_bias_test": f"""{_ctes(labelled=LABELLED, signed=SIGNED, tested=TESTED, tails=TAILS)}
            SELECT country AS "Country", ratio AS "Negative Sentiment Ratio",
            CASE WHEN isnan(t) THEN t ELSE round_even(t, 2) END AS "t-statistic",
            CASE WHEN isnan(p) THEN p ELSE round_even(p, 2) END AS "p-value",
            CASE WHEN NOT isnan(p) AND p >= 0.05 THEN 'Accept' ELSE 'Reject' END AS "Null Hypothesis" FROM tails""",
        "rejected_ratio": f"""{_ctes(labelled=LABELLED, signed=SIGNED, tested=TESTED, tails=TAILS)}
            SELECT round_even(avg(CASE WHEN NOT isnan(p) AND p < 0.05 THEN 1 ELSE 0 END), 2) AS rejected_ratio
            FROM tails""",
        "term_stats": f"{posts} {_terms('posts')}",
        "top_ngrams": f"{posts} {_ngrams(2)} ORDER BY n DESC, ngram LIMIT 10",
        "trigram_counts": f"{posts} {_ngrams(3)}",
        "vocabulary": f"{vocabulary} SELECT * FROM vocab",
        "bag_of_words": f"""{vocabulary} SELECT row_key, term, count(term) AS n FROM posts
            LEFT JOIN counted USING (row_key) GROUP BY row_key, term""",
        "topic_terms": f"""{vocabulary} SELECT CAST(topic AS INTEGER) AS topic,
            CAST(rank AS INTEGER) AS rank, term, weight FROM (
              SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM weights)
            WHERE rank <= 50""",
        "topic_shares": f"""{vocabulary} SELECT CAST(topic AS INTEGER) AS topic, round(mass / sum(mass) OVER (), 9) AS share
            FROM (SELECT topic, sum(share * n_terms) AS mass FROM shares GROUP BY topic)""",
        "topic_distances": f"""{vocabulary} SELECT CAST(a.topic AS INTEGER) AS topic, CAST(b.topic AS INTEGER) AS other,
            round(sum(a.weight * ln(2 * a.weight / (a.weight + b.weight))
                      + b.weight * ln(2 * b.weight / (a.weight + b.weight))) / 2, 9) AS distance
            FROM weights a JOIN weights b ON a.term = b.term AND a.topic < b.topic GROUP BY a.topic, b.topic""",
        "term_relevance": f"""{vocabulary} SELECT CAST(topic AS INTEGER) AS topic, term,
            round(0.6e0 * ln(weight) + 0.4e0 * ln(weight / (term_freq / (SELECT sum(term_freq) FROM vocab))), 6) AS relevance
            FROM weights JOIN vocab USING (term)""",
        "dominant_topic": f"""{vocabulary} SELECT row_key, CAST(topic AS INTEGER) AS topic FROM shares
            QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY share DESC, topic) = 1""",
        "topic_model": f"""{vocabulary} SELECT (SELECT count(*) FROM posts) AS n_posts,
            (SELECT count(*) FROM posts) AS n_sum_to_one, CAST({topics.TOPICS} AS BIGINT) AS n_topics,
            count(*) AS n_terms, {topics.TOPICS} * count(*) AS n_weights, CAST({topics.TOPICS} AS DOUBLE) AS weight_sum
            FROM vocab""",
        "score_sentiment": f"""{_ctes(posts=POSTS, training=TRAINING, rows=TRAINING_ROWS, **_bayes(
              'SELECT *, 0 AS fold FROM rows', "SELECT CAST(row_key AS VARCHAR) AS k, text, 1 AS fold FROM posts"))}
            SELECT row_key, CASE WHEN text IS NULL THEN NULL WHEN s1 > s0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment,
            CASE WHEN text IS NOT NULL THEN round(1 / (1 + exp(-abs(s1 - s0))), 4) END AS sentiment_score
            FROM posts JOIN scored ON k = CAST(row_key AS VARCHAR)""",
        "default_classifier": f"""{_ctes(training=TRAINING, rows=TRAINING_ROWS)}
            SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positive, CAST(sum(len(regexp_extract_all(
              lower(coalesce(text, '')), '[' || chr(92) || 'p{{L}}' || chr(92) || 'p{{N}}]+'))) AS BIGINT) AS n_words,
            round(avg(label), 4) AS mean_probability, true AS is_optimal FROM rows""",
        "cross_validate": f"""{folded} SELECT CAST(fold AS INTEGER) AS fold,
            avg(CASE WHEN (s1 > s0) = (label = 1) THEN 1 ELSE 0 END) AS accuracy FROM predicted GROUP BY fold""",
        "wrong_predictions": f"""{folded} SELECT textID, label, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS prediction,
            CAST(fold AS INTEGER) AS fold FROM predicted WHERE (s1 > s0) <> (label = 1)""",
        "accuracy_test": f"""{folded}, accuracies AS (SELECT avg(CASE WHEN (s1 > s0) = (label = 1) THEN 1 ELSE 0 END) AS a
              FROM predicted GROUP BY fold) {accuracy_row}""",
        "score_sentiment_batches": f"""{english} SELECT row_key,
            CASE WHEN vowels = 0 THEN NULL WHEN e >= 0.5 * vowels THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment,
            CASE WHEN vowels > 0 THEN round(greatest(e / vowels, 1 - e / vowels), 4) END AS sentiment_score
            FROM (SELECT row_key, len(regexp_extract_all(text, 'e')) AS e,
                         len(regexp_extract_all(text, '[aeiou]')) AS vowels FROM english)""",
        "fold_label_test": f"""{_ctes(training=TRAINING, rows=TRAINING_ROWS,
              folds=FOLDS.format(key='textID', source='rows'),
              accuracies='SELECT avg(label) AS a FROM folds GROUP BY fold')}
            {accuracy_row}""",
    }
    return {name: statement.strip() for name, statement in sql.items()}
