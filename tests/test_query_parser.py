import pytest

from capturelake.plans.query_parser import DAY, Filter, complete, month_number, parse, parse_iso_date

NOW = 1788350400  # 2026-09-02 12:00 UTC


def day(text):
    return parse_iso_date(text) * DAY


@pytest.mark.parametrize(("text", "match", "filters"), [
    ("docker error", '"docker" "error"', []),
    ('"morphogenetic computation" python', '"python" "morphogenetic computation"', []),
    ("github in august", '"github"', [Filter("after", day("2026-08-01")), Filter("before", day("2026-09-01"))]),
    ("in january", None, [Filter("after", day("2026-01-01")), Filter("before", day("2026-02-01"))]),
    ("from december", None, [Filter("after", day("2025-12-01")), Filter("before", day("2026-01-01"))]),
    ("error yesterday", '"error"', [Filter("after", day("2026-09-01")), Filter("before", day("2026-09-02"))]),
    ("today", None, [Filter("after", day("2026-09-02"))]),
    ("last week", None, [Filter("after", day("2026-08-20")), Filter("before", day("2026-08-27"))]),
    ("this week", None, [Filter("after", day("2026-08-27")), Filter("before", day("2026-09-03"))]),
    ("last month", None, [Filter("after", day("2026-08-01")), Filter("before", day("2026-09-01"))]),
    ("last year", None, [Filter("after", day("2025-01-01")), Filter("before", day("2026-01-01"))]),
    ("foo:bar", '"foobar"', []),
    ("e-mail", '"email"', []),
    ("is:unstarred has:no-text", None, [Filter("starred", False), Filter("has_text", False)]),
    ('dir:"/a b/../c" x', '"x"', [Filter("dir", "/c")]),
])
def test_parse(text, match, filters):
    q = parse(text, NOW)
    assert (q.match_expr, q.filters) == (match, filters)


def test_all_filters():
    q = parse("pricing after:2026-07-01 before:2026-08-01 app:chrome site:github.com tag:research type:png has:text is:duplicate", NOW)
    assert [f.kind for f in q.filters] == ["after", "before", "app", "site", "tag", "format", "has_text", "duplicate"] and q.match_expr == '"pricing"'


@pytest.mark.parametrize("text", ["", "  ", "app:", '"', "''", 'a"b', "::::", '"  :  "', "don't x"])
def test_any_input_ends(text):
    parse(text, NOW)


def test_adjacency_is_reset():
    assert parse("a b tag:x c d", NOW).adjacency == ["a b", "c d"]
    assert parse('a "b" c', NOW).adjacency == [] and parse('a "b c"', NOW).boost_phrase == "b c"


def test_dates():
    assert parse_iso_date("2026-02-31") == parse_iso_date("2026-03-03") and parse_iso_date("2026-13-01") is None and parse_iso_date("x") is None
    assert [month_number(w) for w in ("sept", "Dec.", "may", "foo")] == [9, 12, 5, None]


def test_completion():
    assert complete("x tag:re", ["research", "red tape", "blue"], [], []) == ["tag:research", 'tag:"red tape"']
    assert complete("co", [], [], ["cold"]) == ["collection:"] and complete("old", [], [], ["old query"]) == ["old query"]
