import random
from datetime import datetime, timedelta
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from apexframe.llm import url_lists as U

T0 = datetime(2024, 1, 1)
ENTRY = "key string, action string, listed_at timestamp_ntz, expires_at timestamp_ntz"
CAPTURE = "page_id long, url string, fetched_at timestamp_ntz"


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def us(t):
    return None if t is None else round((t - datetime(1970, 1, 1)).total_seconds() * 1e6)


def keys(url):
    parts = urlsplit(url or "")
    host = (parts.hostname or "").lower()
    if not host:
        return []
    labels = host.split(".")
    return ["address:" + host + parts.path.rstrip("/")] + ["domain:" + ".".join(labels[-k:]) for k in range(len(labels), min(2, len(labels)) - 1, -1)]


def brute(captures, entries):
    out = []
    for page, url, t in captures:
        best = None
        for key in keys(url) if t is not None else []:
            times = {}
            for k, action, listed, expires in entries:
                if k == key and listed is not None and action in U.ACTIONS:
                    times.setdefault(listed, []).append((U.ACTIONS.index(action), expires is None, expires or T0, action))
            past = [x for x in times if x <= t]
            if past:
                _, open_, expires, action = max(times[max(past)])
                if action != "remove" and (open_ or t < expires):
                    best = (action, key, us(max(past)))
                    break
        out.append((page, us(t), *(best or ("none", None, None))))
    return sorted(out, key=str)


def run(spark, captures, entries):
    c = spark.createDataFrame(captures, CAPTURE).withColumns({x: F.lit("x") for x in ("key", "at", "row", "point", "entry", "rank")})
    return sorted(map(tuple, U.judged(c, spark.createDataFrame(entries, ENTRY)).collect()), key=str)


ENTRIES = [
    ("domain:example.com", "block", at(10), None), ("domain:a.example.com", "allow", at(20), at(30)), ("domain:a.example.com", "block", at(25), at(26)), ("domain:example.com", "remove", at(40), None),
    ("address:a.example.com/x", "block", at(5), at(50)), ("address:a.example.com/x", "allow", at(5), None), ("domain:tie.org", "allow", at(1), None), ("domain:tie.org", "remove", at(1), None),
    (None, "block", at(1), None), ("domain:no.date", "block", None, None), ("domain:odd.org", "other", at(1), None), ("domain:odd.org", None, at(1), None), ("domain:example.com", "block", at(10), None),
]
URLS = ["http://a.example.com/x/", "https://A.Example.com:80/y?q#f", "http://example.com", "http://b.c.example.com/x", "http://notexample.com", "http://tie.org/", "http://odd.org", "http://no.date", "no host", "", None, "http://com/"]


def test_edge_rows(spark):
    captures = [(i, url, at(h)) for i, url in enumerate(URLS) for h in (None, 0, 1, 5, 10, 20, 24.999, 25, 26, 30, 39.99, 40, 50)] + [(None, URLS[0], at(12)), (1, URLS[0], at(12)), (1, URLS[0], at(12))]
    assert run(spark, captures, ENTRIES) == brute(captures, ENTRIES)


def test_empty_tables(spark):
    assert run(spark, [], ENTRIES) == []
    assert run(spark, [(1, URLS[0], at(1))], []) == [(1, us(at(1)), "none", None, None)]


def test_one_hot_host(spark):
    rng = random.Random(2)
    entries = [(rng.choice(["domain:hot.net", "domain:x.hot.net"]), rng.choice(U.ACTIONS), at(rng.randint(0, 500)), at(rng.randint(0, 600))) for _ in range(400)]
    captures = [(i, rng.choice(["http://hot.net/a", "http://x.hot.net/b"]), at(rng.randint(0, 500))) for i in range(3000)]
    assert run(spark, captures, entries) == brute(captures, entries)


def test_no_python_in_the_plan(spark):
    c = spark.createDataFrame([(1, URLS[0], at(12))], CAPTURE)
    plan = U.judged(c, spark.createDataFrame(ENTRIES, ENTRY))._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan and "ArrowEval" not in plan and "BatchEval" not in plan


def brute_resumed(captures, entries):
    out = []
    for page, url, t in captures:
        best = None
        for key in keys(url) if t is not None else []:
            active = [(listed, U.ACTIONS.index(action)) for k, action, listed, expires in entries
                      if k == key and action in U.ACTIONS and listed is not None and listed <= t and (expires is None or t < expires)]
            if active and max(active)[1]:
                best = (U.ACTIONS[max(active)[1]], key, us(max(active)[0]))
                break
        out.append((page, us(t), *(best or ("none", None, None))))
    return sorted(out, key=str)


def test_earlier_entries_resume(spark):
    rng = random.Random(3)
    entries = ENTRIES + [("domain:long.org", "block", at(0), at(1000)), ("domain:long.org", "allow", at(100), at(110)), ("domain:long.org", "remove", at(200), at(201))]
    entries += [(rng.choice(["domain:hot.net", "domain:x.hot.net"]), rng.choice(U.ACTIONS), at(a := rng.randint(0, 500)), at(rng.choice([a + rng.randint(-1, 60), None if a > 400 else a + 1]))) for _ in range(200)]
    captures = [(i, rng.choice(["http://hot.net/a", "http://x.hot.net/b", *URLS]), at(rng.randint(0, 500))) for i in range(2000)]
    captures += [(10_000 + h, "http://long.org", at(h)) for h in (50, 105, 110, 200, 300, 1000)]
    c = spark.createDataFrame(captures, CAPTURE)
    got = sorted(map(tuple, U.judged(c, spark.createDataFrame(entries, ENTRY), resume=True).collect()), key=str)
    assert got == brute_resumed(captures, entries)
    assert [r[2] for r in sorted(got) if r[0] >= 10_000] == ["block", "allow", "block", "none", "block", "none"]


def test_long_addresses(spark):
    long = "/" + "p" * 500_000
    entries = spark.createDataFrame([(f"address:h.example.org{long}", "block", at(1), at(9)), (f"address:h.example.org{long}x", "allow", at(1), at(9))], ENTRY)
    captures = spark.createDataFrame([(1, f"http://h.example.org{long}", at(2)), (2, f"http://h.example.org{long}x?q", at(2)), (3, f"http://h.example.org{long}y", at(2)), (4, "http://" + "a." * 200 + "org/", at(2))], CAPTURE)
    assert {r.page_id: r.verdict for r in U.judged(captures, entries).collect()} == {1: "block", 2: "allow", 3: "none", 4: "none"}
