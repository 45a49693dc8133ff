import random

from tastegrid.operators.numbering import numbered
from tests.helpers import plan, tuples


def brute(values):
    out, groups = [], {}
    for g, o, x in values:
        groups.setdefault(g, []).append((o, x))
    for g, members in groups.items():
        members.sort(key=lambda m: (m[0] is not None, m[0]))
        out += [(g, o, i, len(members)) for i, (o, _) in enumerate(members)]
    return sorted(out, key=lambda row: [(v is None, str(v)) for v in row])


def test_places_equal_a_sort_with_a_hot_group_nulls_and_equal_rows(rows):
    rng = random.Random(1)
    values = [(rng.choice(["hot", "hot", "hot", None, "a", "b"]), rng.choice([None, *range(40)]), k) for k in range(3000)]
    values += [("same", 1, 7)] * 1500
    df = rows("g string, o int, x int", *values)
    got = numbered(df, ["g"], ["o"], "place_in_group", "held", part_rows=200)
    assert got.columns == ["g", "o", "x", "place_in_group", "held"]
    assert tuples(got, "g", "o", "place_in_group", "held") == brute(values)


def test_one_group_for_all_and_none_at_all(rows):
    df = rows("g string, o int", *[("a", k % 10) for k in range(500)])
    assert sorted(r.position for r in numbered(df, [], ["o"], part_rows=50).collect()) == list(range(500))
    assert numbered(df.limit(0), ["g"], ["o"]).collect() == []


def test_no_window_over_the_rows(rows):
    df = rows("g string, o int", *[("a", k) for k in range(400)])
    text = plan(numbered(df, ["g"], ["o"], part_rows=50), run=True)
    assert "row_number" not in text and "_part" in text
