import hashlib
import re
import textwrap

from pyspark.sql import functions as F

from apexframe.llm import licenses as L

TEXT = dict(L.TEXTS[::-1])


def canonical(text):
    out = re.sub(L.COPYRIGHT_LINE, "", (text or "").lower())
    words = [w for w in re.split(r"[\W_]+", out) if w]
    return "  ".join(L.SPELLINGS.get(w, w) for w in words)


MIT, ISC = TEXT["MIT"], TEXT["ISC"]
FULL = L.TEXTS[4][1]
ROWS = [
    (1, None), (2, ""), (3, " \n\n"), (4, FULL), (5, "Copyright (c) 2020 Somebody\n\n" + FULL.upper().replace("SUBLICENSE", "sublicence")), (6, FULL.replace("\n", "  ")), (7, FULL[:-5]),
    (8, FULL + " more"), (9, "text\nLICENSED under the apache licence - version 2.0\nmore\nReleased under the MIT License\nreleased, under the MIT licence!"), (None, "Licensed under CC BY-NC 4.0."),
    (10, "Licensed under CC BY-NC 4.0."), (10, "Licensed under CC BY-NC 4.0."), (11, "x " * 200_000), (12, "© me\nReleased under the MIT License."), (13, "licence licence licence v v"),
]


def test_edge_rows(make):
    known = {canonical(t): n for n, t in L.TEXTS}
    got = L.licenses(make(ROWS)).collect()
    wanted = []
    for i, t in ROWS:
        lines = [known[c] for c in map(canonical, (t or "").split("\n")) if c in known]
        wanted.append((i, hashlib.sha256(canonical(t).encode()).hexdigest(), known.get(canonical(t)), len(lines), ",".join(sorted(set(lines)))))
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].license for i in (4, 5, 6, 7, 8, 12)] == ["MIT", "MIT", "MIT", None, None, "MIT"]
    assert (by_id[9].n_notices, by_id[9].notices) == (3, "Apache-2.0,MIT")


def test_own_texts_and_empty_table(make):
    assert [r.license for r in L.licenses(make([(1, "My OWN terms!")]), texts=[("own", "my own terms")]).collect()] == ["own"]
    assert L.licenses(make([])).count() == 0


def test_no_python_in_the_plan(make):
    plan = L.licenses(make(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_digest_is_one_expression(spark):
    a, b = spark.range(1).select(L.digest(F.lit("A Licence, v 2")), L.digest(F.lit("a license version-2"))).first()
    assert a == b


def wrapped(text, width):
    """Paragraphs filled to a width; 0 keeps the text, None puts a paragraph on one line."""
    if width == 0:
        return text
    return "\n\n".join(textwrap.fill(p, width or 10**9, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n[ \t]*\n", text))


def test_full_licences_in_several_layouts(make):
    rows, wanted = [], []
    assert all(re.search("licen|liab", text.lower()) for _, text in L.full_texts())
    for name, text in L.full_texts():
        titled = f"{name} License\n\nCopyright (c) 2019, Some Body <a@b.c>\n\nAll rights reserved.\n\n{text}" if name in L.TITLES and not any(text.startswith(t + "\n") for t in [*L.TITLES[name], name, f"{name} License"]) else text
        for layout in {wrapped(t, w) for t in (text, titled) for w in (0, None, 55, 72, 79)} | {"\n".join(" * " + x for x in text.split("\n")), text.upper()}:
            rows.append((len(rows), layout))
            wanted.append(name)
    got = {r.doc_id: r.license for r in L.licenses(make(rows)).collect()}
    assert [(w, got[i], rows[i][1][:200]) for i, w in enumerate(wanted) if got[i] != w] == []


def test_filled_in_and_changed_licences(make):
    texts = dict(reversed(L.full_texts()))
    apache, isc, bsd = texts["Apache-2.0"], texts["ISC"], texts["BSD-3-Clause"]
    rows = [(1, apache.replace("[yyyy] [name of copyright owner]", "2019 Some Body")), (2, "ISC License\n\nCopyright 2020 Me\n\n" + isc), (3, apache[:-200]), (4, "MIT License\n\n" + isc),
            (5, bsd + "\nNo use on Sundays."), (6, bsd.replace("Neither", "Either")), (7, "see\n" + " ".join(isc.split("\n")[2:]) + "\nend")]
    got = {r.doc_id: r for r in L.licenses(make(rows)).collect()}
    assert [got[i].license for i in range(1, 8)] == ["Apache-2.0", "ISC", None, None, None, None, None] and (got[7].n_notices, got[7].notices) == (1, "ISC")


def test_shipped_texts_get_the_second_look():
    """Only texts that speak of licences or of who is liable are looked up in the form that the shipped texts are known by."""
    texts = L.full_texts()
    assert len(texts) > 15 and all(re.search("licen|liab", text.lower()) for _, text in texts)
