import re
from collections import Counter

from pyspark.sql import functions as F

from apexframe.llm import host_rules as H

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(lines), len(covered))


TEXTS = [
    None, "", " \n\t", "one", WORDS, WORDS + " " + WORDS, "a b c d e a b c d e", "x\nx\n x\n\nx", "# * $ a|b <c> é é", "a " * 50_000, "é" * 100_000, "a b a b a b a b",
    " ".join(f"w{i}" for i in range(9000)) + " " + " ".join(f"w{i}" for i in range(8000, 9000)),
]


def test_counts(make):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, WORDS), (3, "again"), (3, "again")]
    got = sorted(tuple(r) for r in H.judged(make(rows)).select(F.coalesce("doc_id", F.lit(-1)), *H._COUNTS).collect())
    assert got == sorted((-1 if i is None else i, *brute(t)) for i, t in rows)


def test_bad_hosts_fall_and_small_or_unknown_hosts_do_not(make):
    rows, n = [], 0

    def add(host, good, bad):
        nonlocal n
        for k in range(good + bad):
            rows.append((n, " ".join(f"{w}{n}" for w in WORDS.split()) if k < good else "spam", host))
            n += 1

    for h in range(12):
        add(f"good{h}", 50, 2)
    add("awful", 10, 200)
    add("tiny", 1, 1)
    add(None, 3, 40)
    df = H.judged(make(rows)).collect()
    source = {r[0]: r[2] for r in rows}
    assert {source[r.doc_id] for r in df if r.host_failed} == {"awful"}
    for r in df:
        assert r.base_failed == (r.n_words < 10) and r.kept == (not r.base_failed and source[r.doc_id] != "awful")
    kept = H.passing(make(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in df if r.kept)
    assert kept.columns == make([]).columns and {r["_key"] for r in kept.collect()} == {"x"}
    clashing = make(rows).withColumns({c: F.lit("x") for c in ("row", "n_words", "n_lines", "bad")})
    assert sorted(map(tuple, H.passing(clashing).collect())) == sorted((*r, "x", "x", "x", "x") for r in kept.collect())
    again = H.passing(make(rows).union(make(rows)).withColumn("many", F.array(F.lit(None), F.col("source"))))
    assert again.count() == 2 * kept.count() and again.schema["many"].dataType.simpleString() == "array<string>"


def test_empty_table_and_no_hosts(make):
    assert H.judged(make([])).count() == 0 and H.passing(make([])).count() == 0
    assert [r.kept for r in H.judged(make([(1, WORDS, None), (2, "", None)])).orderBy("doc_id").collect()] == [True, False]


def test_rates_of_hosts(make):
    """Shrunken by hand: moments of the hosts' rates, then each host between its own rate and the mean."""
    rows = [(100 * h + k, "a b" if k < 5 * h else " ".join(f"{w}{h}{k}" for w in WORDS.split()), f"h{h}") for h in range(5) for k in range(20 + h)]
    rows += [(9000, "a b", None), (9001, None, None), (1, "again", "h0"), (1, "again", "h0")]
    hosts = {}
    for _, t, h in rows:
        if h is not None:
            hosts.setdefault(h, []).append(len((t or "").split()) < 10)
    n, f = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
    mean = f / n
    chance = mean * (1 - mean)
    between = sum(sum(x) ** 2 / len(x) for x in hosts.values()) / n - mean**2 - chance * len(hosts) / n
    strength = chance / between - 1
    assert between > 0 and strength > 2
    wanted = {h: round((mean * strength + sum(x)) / (strength + len(x)), 6) for h, x in hosts.items()}
    source = {r[0]: r[2] for r in rows}
    got = H.judged(make(rows), rates=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.rate_few_words is None) == (source[r.doc_id] is None)
        if source[r.doc_id] is not None:
            assert abs(r.rate_few_words - wanted[source[r.doc_id]]) < 2e-6
            assert r.host_failed == (wanted[source[r.doc_id]] > 0.5)
    assert {r.host_failed for r in got} == {True, False}
    assert H.judged(make([(1, "x", None)]), rates=True).collect()[0].rate_symbols is None and H.judged(make([]), rates=True).count() == 0
