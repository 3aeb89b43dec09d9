from datetime import date

from graphloom.llm import url_filters as u

CAPTURES = "page_id bigint, url string, fetched_at date"
ENTRIES = "key string, listed_at date, action string, category string"


def brute(captures, entries):
    out = []
    for page, url, day in captures:
        host = url.split("://")[1].split("/")[0].split("@")[-1].split(":")[0].lower() if url and "://" in url else ""
        parts = host.split(".")
        keys = [".".join(parts[i:]) for i in range(max(len(parts) - 1, 1))] if host else []
        verdict = "none"
        for key in keys if day else []:
            known = sorted((e for e in entries if e[0] == key and e[1] and e[1] <= day), key=lambda e: (e[1], e[2], e[3]))
            if known and known[-1][2] != "remove":
                verdict = known[-1][2]
                break
        out.append((page, verdict))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    days = [date(2024, 1, k) for k in range(1, 29)]
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "localhost", "user:pw@x.a.com:8080"]
    captures = [(k, f"https://{hosts[k % 6]}/p?q=https://b.org", days[(k * 7) % 28]) for k in range(120)]
    captures += [(200, None, days[3]), (201, "not a url", days[3]), (202, "http://a.com", None), (203, "http:///path", days[5]), (None, "http://A.COM/", days[9]), (1, captures[1][1], captures[1][2])]
    entries = [("a.com", days[2], "block", "x"), ("a.com", days[10], "remove", "x"), ("a.com", days[20], "block", "z"), ("x.a.com", days[5], "allow", "y"), ("x.a.com", days[15], "remove", "y"),
               ("b.org", days[4], "block", "x"), ("b.org", days[4], "remove", "x"), ("b.org", days[4], "block", "x"), ("localhost", days[0], "block", "l"), (None, days[0], "block", "n"), ("com", days[0], "block", "t"), ("a.com", None, "block", "n")]
    c, e = spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)
    got = u.evaluate(c.selectExpr("*", "1 AS key", "2 AS host", "3 AS day"), e.selectExpr("*", "1 AS host", "2 AS valid_to"))
    assert sorted(((r.page_id, r.verdict) for r in got.collect()), key=str) == brute(captures, entries)
    assert u.evaluate(c, e.limit(0)).filter("verdict <> 'none'").count() == 0
    assert u.evaluate(c.limit(0), e).count() == 0


def test_intervals(spark):
    e = spark.createDataFrame([("k", date(2024, 1, 1), "block", "a"), ("k", date(2024, 2, 1), "remove", "a"), ("k", date(2024, 3, 1), "block", "b")], ENTRIES)
    got = [(r.valid_from, r.valid_to, r.category) for r in u.validity(e).orderBy("valid_from").collect()]
    assert got == [(date(2024, 1, 1), date(2024, 2, 1), "a"), (date(2024, 3, 1), None, "b")]


def test_a_very_long_url(spark):
    c = spark.createDataFrame([(1, "http://" + "a." * 500 + "com/" + "x" * 100_000, date(2024, 5, 5))], CAPTURES)
    e = spark.createDataFrame([("a.com", date(2024, 1, 1), "block", "x")], ENTRIES)
    assert u.evaluate(c, e).first().verdict == "block"
