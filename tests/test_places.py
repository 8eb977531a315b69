import random

import pytest
from explained import plan_of

from posttide import schemas
from posttide.operators import places

GAZ = [
    ("Paris", "IDF", "Ile", "FR", "France"), ("Lyon", "ARA", "Rhone", "FR", "France"),
    ("Paris", "TX", "Texas", "US", "United States"), ("Oslo", "03", "OsloState", "NO", "Norway"),
]


def gazetteer(spark, rows):
    data = [(c, float(i), -float(i), sc, s, i + .25, i + .5, cc, n, i + .75, i + .9, i)
            for i, (c, sc, s, cc, n) in enumerate(rows)]
    types = ", ".join(f"{c} {schemas.GAZETTEER_TYPES[c]}" for c in schemas.GAZETTEER_COLUMNS)
    return spark.createDataFrame(data, types + ", row_id bigint")


def resolve(spark, rows, locations, **options):
    index = places.build_place_index(gazetteer(spark, rows), **options)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(locations)], "i int, location string")
    found = places.resolve_location(df, index, options.get("case_insensitive", False))
    by_row = {r["i"]: r["place"] for r in found.collect()}
    assert len(by_row) == len(locations)
    return [None if by_row[i] is None else tuple(by_row[i]) for i in range(len(locations))]


@pytest.mark.parametrize("location,expected", [
    ("oslo", ("Oslo", "OsloState", "Norway")), ("Oslo", None), ("paris", None),
    ("paris, Texas", ("Paris", "Texas", "United States")), ("paris, texas", ("", "Texas", "United States")),
    ("france", None), ("france,", ("", "", "France")), ("n.o., oslo", ("Oslo", "OsloState", "Norway")),
    (None, None), ("", None),
])
def test_listed_locations(spark, location, expected):
    found = resolve(spark, GAZ, [location])[0]
    assert (found and found[:3]) == expected


def test_dedupe_and_any_case(spark):
    same = [("Nice", "A", "Azur", "FR", "France"), ("Nice", "A", "Azur", "FR", "France")]
    index = places.build_place_index(gazetteer(spark, same[:1] * 1))
    assert index.where("element is null").count() == 5
    found = resolve(spark, GAZ, ["PARIS, tExas", "Oslo"], case_insensitive=True)
    assert [f[:3] for f in found] == [("Paris", "Texas", "United States"), ("Oslo", "OsloState", "Norway")]


def entries_of(rows):
    """key -> places, in gazetteer order, five per row."""
    index = {}
    for i, (c, sc, s, cc, n) in enumerate(rows):
        state, country = ("", s, n, i + .25, i + .5), ("", "", n, i + .75, i + .9)
        city = (c, s, n, float(i), -float(i))
        for key, place in ((sc, state), (cc, country), (c, city), (s, state), (n, country)):
            if key is not None:
                index.setdefault(key.lower(), []).append(place)
    return index


def best_by_rule(index, location):
    """The rule as a ranking of all candidates: fewest empty fields, then parts, then entry order."""
    if location is None:
        return None
    parts = [p.replace(".", "").strip() for p in location.split(",")]
    ranked = []
    for i, part in enumerate(parts):
        known = index.get(part, [])
        if len(known) == 1:
            ranked.append((known[0][:3].count(""), i, -1, 0, known[0]))
        elif known:
            ranked += [(e[:3].count(""), i, j, n, e) for j in range(i + 1, len(parts))
                       for n, e in enumerate(known) if parts[j] in e[:3]]
    return min(ranked, key=lambda r: r[:4])[-1] if ranked else None


def test_against_brute_force(spark):
    rng = random.Random(7)
    names = ["a", "B", "c d", "e", "F", "g"]
    rows = [(rng.choice(names), rng.choice(names + [None]), rng.choice(names), rng.choice(["x", "y", "e"]),
             rng.choice(["X land", "Y", "a"])) for _ in range(25)]
    words = names + ["A", "b", "f", "x", "y", "X land", "x land", "Y", "", " ", "zz", "c. d"]
    locations = [", ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    locations += [None, "", ",,,", ".", " a ,B"]
    index = entries_of(rows)
    assert resolve(spark, rows, locations) == [best_by_rule(index, v) for v in locations]


def test_large_index_is_shuffled_with_salt(spark, monkeypatch):
    from posttide.operators import joins

    index = places.build_place_index(gazetteer(spark, GAZ))
    df = spark.createDataFrame([("oslo",)] * 50 + [(None,)] * 50 + [("paris, Texas",)], "location string")
    small = places.resolve_location(df, index)
    assert "BroadcastHashJoin" in plan_of(small)
    plain = joins.lookup_join
    monkeypatch.setattr(places, "lookup_join",
                        lambda *a, **k: plain(*a, **{**k, "max_bytes": -1, "salts": 4}))
    large = places.resolve_location(df, index)
    assert "_salt" in plan_of(large)
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


def test_merge_matches_missing_names(spark):
    cities = spark.createDataFrame([("A", None, "X", 1), ("B", "s", "X", 2), ("C", "t", "X", 3)],
                                   "city_name string, state_name string, country_name string, id int")
    states = spark.createDataFrame([(None, "X", 7), ("s", "X", 8)],
                                   "state_name string, country_name string, id int")
    merged = places.merge_gazetteer(cities, states)
    assert sorted((r["city_name"], r["id_x"], r["id_y"]) for r in merged.collect()) == [("A", 1, 7), ("B", 2, 8)]
    assert places.merge_gazetteer(cities, states, null_safe=False).count() == 1


def test_projection_needs_all_columns(spark):
    with pytest.raises(Exception):
        places.project_gazetteer(gazetteer(spark, GAZ).drop("state_code"))
