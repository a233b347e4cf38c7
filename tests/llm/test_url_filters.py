import re

from stratagrid.llm import url_filters as op

URLS = [
    (1, "https://A.Example.net/en/1?x=/de/"), (2, "http://example.com/de/"), (3, "http://xexample.com/de/1"), (4, "http://b.org/fr/a#/q"), (5, "no scheme"), (6, None),
    (7, "http://"), (8, "http://h.net"), (9, "http://net/a"), (10, "http://x.net?y=/"), (11, "a://b://c/d"), (12, "http://ÉX.com/É"), (1, "https://A.Example.net/en/1?x=/de/"), (None, "http://q.com/1"),
]


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not m else ("".join(x.lower() if "A" <= x <= "Z" else x for x in m[1]), m[2])


def rule(host, path):
    found = None
    for r, _ in op.RULES:
        at, slash, start = r.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith(slash + start) and (found is None or len(r) > len(found)):
            found = r
    return found


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, good boolean")


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame(URLS, "page_id bigint, url string").selectExpr("*", "'x' AS html", "1 AS host", "2 AS purity", "3 AS template")
    got = op.judge(pages, labels(spark, [])).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(((i, *parts(u), rule(*parts(u))) for i, u in URLS), key=str)
    assert all(r.verdict == (dict(op.RULES)[r.rule] if r.rule else "allow") for r in got)


def test_templates_and_purity(spark):
    rows = [(i, f"http://h.com/post/{i}") for i in range(20)] + [(100 + i, f"http://h.com/user/name{chr(97 + i)}x/home") for i in range(12)] + [(200 + i, f"http://h.com/buy/{i}") for i in range(30)]
    marks = [(i, True) for i in range(20)] + [(200 + i, False) for i in range(30)]
    got = {r.page_id: r for r in op.judge(spark.createDataFrame(rows, "page_id bigint, url string"), labels(spark, marks)).collect()}
    assert got[3].template == "post/{n}" and got[3].verdict == "allow"
    assert got[105].template == "user/{*}/home" and got[105].verdict == "allow"
    assert got[215].template == "buy/{n}" and got[215].verdict == "block" and len(got) == 62


def test_variables_below_variables(spark):
    """Generalisation goes on below a wildcard, whatever the pages of each branch."""
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    for each in (2, 5):
        urls = [f"http://h.com/user/x{word(k)}/photo/y{word(k * each + j)}" for k in range(40) for j in range(each)]
        got = op.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), labels(spark, [(k, False) for k in range(0, 40 * each, 5)])).collect()
        assert {(r.template, r.verdict) for r in got} == {("user/{*}/photo/{*}", "block")} and len(got) == len(urls)


def test_a_branch_that_differs_stays_by_name(spark):
    urls = [f"http://h.com/u/name{chr(97 + k)}/page{j}" for k in range(20) for j in range(10)]
    marks = [(k, k // 10 != 7) for k in range(200)]
    got = {r.page_id: r for r in op.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), labels(spark, marks)).collect()}
    assert {got[i].template for i in range(70, 80)} == {"u/nameh/page{n}"} and {got[i].verdict for i in range(70, 80)} == {"block"}
    assert {(got[i].template, got[i].verdict) for i in range(200) if i // 10 != 7} == {("u/{*}/page{n}", "allow")}


def test_common_children_stay_and_long_paths_have_a_place(spark):
    urls = [f"http://h.com/post/{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(100)] + [f"http://h.com/rare{chr(97 + k)}" for k in range(9)] + ["http://h.com/" + "/".join("ab" for _ in range(5000))]
    got = [r.template for r in op.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), labels(spark, [])).collect()]
    assert set(got[:0] + [t for t in got if t.startswith("post")]) == {"post/{*}"} and got.count("{*}") == 9
    assert [t for t in got if t.count("/") > 2] == ["{*}/" + "/".join("ab" for _ in range(4999))]


def test_purity_at_the_limit_is_allowed(spark):
    rows = [(k, "http://h.com/a/b") for k in range(4)]
    got = op.judge(spark.createDataFrame(rows, "page_id bigint, url string"), labels(spark, [(0, True), (1, True), (2, False), (3, False)])).collect()
    assert {(r.purity, r.verdict) for r in got} == {(0.5, "allow")}


def test_repeated_labels_and_empty_tables(spark):
    assert op.judge(spark.createDataFrame([], "page_id bigint, url string"), labels(spark, [(1, True)])).collect() == []
    got = op.judge(spark.createDataFrame([(1, "http://a.com/x")] * 2, "page_id bigint, url string"), labels(spark, [(1, True), (1, False), (None, None)])).collect()
    assert len(got) == 2 and len(set(got)) == 1
