from lodestar.operators.aliases import alternatives, folded, problems
from lodestar.operators.settings import Settings, page_of


def test_layers():
    s, wrong = Settings().layered({"limit": "20", "weight_title": "3.5", "require_all_terms": "off", "x": 1}, {"limit": " ", "min_cosine": "7", "title_weight": "a"})
    assert (s.limit, s.title_weight, s.require_all_terms, s.min_cosine) == (20, 3.5, False, 0.4)
    assert [w.split(":")[0] for w in wrong] == ["x", "min_cosine", "title_weight"]


def test_pages():
    assert page_of(0, 3, 20) == (1, 0, 0, 0) and page_of(41, 9, 20) == (3, 40, 41, 41) and page_of(41, 0, 20) == (1, 0, 1, 20)


def test_alias_problems(spark):
    groups = spark.createDataFrame([(1, ["ps5", "PS5", "play station"]), (2, ["ab", ""]), (3, ["play station", "x" * 70])], "group_id int, terms array<string>")
    counts = spark.createDataFrame([("play station", 900)], "term string, products long")
    got = {(r.group_id, r.term[:12], r.problem) for r in problems(groups, counts, ("ps5",)).collect()}
    assert got == {
        (1, "ps5", "duplicate"), (1, "ps5", "blocked"), (1, "play station", "in another group"), (1, "play station", "broad"), (2, "ab", "short"), (2, "ab", "fewer than two terms"), (2, "", "empty"),
        (2, "", "fewer than two terms"), (3, "play station", "in another group"), (3, "play station", "broad"), (3, "x" * 12, "too long"),
    }


def test_folding_goes_by_order():
    assert folded([["b", "c"], ["d"], ["e", "f"], ["a", "f"]], [["a", "b"]]) == [["a", "b", "c", "f"], ["e", "f"]]


def test_alternatives(spark):
    rows = spark.createDataFrame([("Sony", ["sony", "SONY ", "soni", "سونی", "soسo", "soni", "s"])], "name string, terms array<string>")
    assert [r.term for r in alternatives(rows).collect()] == ["soni", "سونی"]
