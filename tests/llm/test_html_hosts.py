"""Boilerplate of a host with many pages without an article."""

import random
from collections import Counter

from seqloom.llm import _spark, html_text


def test_repeats_are_counted_over_the_whole_host(spark, monkeypatch):
    """600 pages: notices on 3 or 4 of them go wherever these are; those on 2 stay. Against the ranks of one suffix array."""
    rng = random.Random(7)
    notices = [" ".join(f"notice{n}w{k}" for k in range(9)) for n in range(40)]
    own = {i: [f"p{i} " + " ".join(f"u{i}x{k}" for k in range(12))] for i in range(600)}
    for n, notice in enumerate(notices):
        for i in rng.sample(range(600), 2 + n % 3):
            own[i].append(notice)
    rows = [(i, f"http://{'H' if i % 2 else 'h'}.example/{i}", "".join(f"<p>{b}" for b in bs)) for i, bs in own.items()]
    marks = html_text.repeated([" ".join(bs).split() for bs in own.values()])
    want = {i: [t for t, gone in zip(" ".join(bs).split(), m, strict=True) if not gone] for (i, bs), m in zip(own.items(), marks, strict=True)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for heavy in (10_000, 2_700, 1):  # all runs are heavy; those on 4 pages; none
        monkeypatch.setattr(_spark, "HEAVY", heavy)
        got = {r.page_id: r.text.split() for r in html_text.main_text(df).collect()}
        assert got == want
    left = Counter(t.split("w")[0] for ts in got.values() for t in ts if t.startswith("notice"))
    assert left == {f"notice{n}": 18 for n in range(0, 40, 3)}


def test_copies_of_a_page_are_one_page(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(i % 2, "http://h.example/", f"<p>{text}") for i in range(5)] + [(9, "http://other.example/", f"<p>{text} more"), (9, "http://other.example/", f"<p>{text} most")]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == sorted([text] * 5 + [text + " more", text + " most"])
