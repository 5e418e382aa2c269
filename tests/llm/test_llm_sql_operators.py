import time

import pytest

from conftest import SF_CHECK
from llm_data import frame, rows
from oracle_check import compare, duck
from vitrine.llm import line_dedup, queries, url_filter


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    got = compare(spark, duck(SF_CHECK), name, queries.QUERIES[name], queries.ORACLE[name], SF_CHECK)
    assert got["status"] == "ok", got


def native(df):
    return not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


# -- lines --------------------------------------------------------------------------------------------

def plain_lines(data, ratio, least):
    pages, holds = {}, {}
    for _, text, _, host, *_ in data:
        pages[host] = pages.get(host, 0) + 1
        for line in set((text or "").split("\n")) if text is not None else ():
            holds[host, line] = holds.get((host, line), 0) + 1
    drop = {k for k, n in holds.items() if k[1].strip(" \t\n\x0b\f\r") and n >= least and n > ratio * pages[k[0]]}
    return [(d[0], None if d[1] is None else "\n".join(x for x in d[1].split("\n") if (d[3], x) not in drop)) for d in data]


def test_lines_equal_brute_force(spark):
    data = rows() + [(100 + i, f"menu\nown {i}\n\nmenu\nrare {i // 2}", "en", h, None) for i in range(30)
                     for h in ("h1", None)[i % 2:i % 2 + 1]]
    got = line_dedup.drop_lines(frame(spark, data), ratio=0.2, min_pages=3).collect()
    assert sorted(((r.doc_id, r.kept_text) for r in got), key=str) == sorted(plain_lines(data, 0.2, 3), key=str)
    assert any(r.n_dropped == 2 for r in got)
    assert line_dedup.drop_lines(frame(spark, [])).count() == 0


def test_native_plans(spark):
    assert native(line_dedup.query(spark, SF_CHECK)) and native(url_filter.query(spark, SF_CHECK))


# -- urls ---------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://Sub.Example.ORG/es/x?q#f", "https://example.org/en/123", "http://example.org/en/2",
        "http://org/", "http://org", "http://xorg/", "x://a.com/fr/y", "x://a.com/de/", "x://a.com/it/", "://a.com/de/#x",
        "http://a.com?x=://b.org/", "http://example.org./es/", "http://../", "http://user@example.org/es/", "http://É.com/fr/é",
        "http://" + "a." * 200 + "com/de/" + "x" * 5000]


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, action = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, action


def test_urls_equal_brute_force(spark):
    data = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(3, URLS[3], "x", "y"), (None, URLS[4], "x", "y")]
    pages = spark.createDataFrame(data, "page_id long, url string, rule string, host string")
    got = sorted((tuple(r) for r in url_filter.judge(pages, url_filter.contract_rules(spark)).collect()), key=str)
    assert got == sorted(((i, *plain_verdict(u, url_filter.RULES)) for i, u, *_ in data), key=str)
    rules = url_filter.contract_rules(spark)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0), "block").collect()} == {"block"}


def test_very_long_hosts_and_paths(spark):
    """64,000 labels and as many path parts: as many expressions as the rules have lengths."""
    host, path = "a." * 64_000, "/en/1" + "/x" * 64_000
    data = [(1, f"http://{host}example.org{path}"), (2, f"http://{host}org{path}"), (3, f"http://{host}net{path}"),
            (4, "http://org"), (5, "http://.org/"), (6, "http://org./"), (7, "http://example.org/en/")]
    pages = spark.createDataFrame(data, "page_id long, url string")
    began = time.monotonic()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.contract_rules(spark)).collect()}
    assert got == {1: ("example.org/en/1", "block"), 2: ("org/", "allow"), 3: (None, "allow"), 4: (None, "allow"),
                   5: ("org/", "allow"), 6: (None, "allow"), 7: ("org/", "allow")}
    assert time.monotonic() - began < 30
