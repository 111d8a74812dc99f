"""Near duplicates in the pipeline are decided by row, not by id."""

import corpus_pipeline


def words(name):
    return " ".join(f"{name}{i}" for i in range(40))


def test_ids_repeated_with_other_texts_and_rows_without_an_id(spark):
    rows = [
        (5, words("a")), (5, words("b")),  # one id, unrelated texts: both stay
        (3, words("c")), (6, words("c") + " tail"), (6, words("d")),  # id 6 is a near copy once, and unique once
        (None, words("c") + " end"), (None, words("e")), (None, words("e")), (None, words("f")),  # copies go with or without an id
        (7, words("g")), (7, words("g") + " tail"), (7, words("g")),  # one id, near copies: one stays
    ]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = [(r.doc_id, r.text) for r in stage(spark, df.repartition(3), "").collect()]
    assert sorted((i or 0, t[:2]) for i, t in kept) == [(0, "e0"), (0, "f0"), (3, "c0"), (5, "a0"), (5, "b0"), (6, "d0"), (7, "g0")]
    assert sorted(map(str, kept)) == sorted(str((r.doc_id, r.text)) for r in stage(spark, df.repartition(1), "").collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, copy long, n long"


def test_stages_with_hard_rows(spark, monkeypatch):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names; by broadcasts and by shuffles."""
    from collections import Counter

    from test_documents import SF, brute_decon, brute_quality

    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, words("a"), "s"), (1, words("a"), "s"), (None, words("b"), None), (None, None, None), (2, "", "s"), (3, long, None), (4, "x" * 2_000_000, "t"), (None, words("b"), None)] + [(7, words("g"), "s")] * 9
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows.append((5, words("h") + " " + items[3][1], "t"))
    df = spark.createDataFrame([(i, t, None, s, None, "u", 5, 3) for i, t, s in rows], SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rs: Counter((r.doc_id, r.text, r.source) for r in rs)
    for bound in (1_000_000, 1):
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", bound)
        assert key(stages["quality_rules"](spark, df, SF).collect()) == Counter(r for r in rows if brute_quality(r[1])[-1])
        near = key(stages["near_duplicates"](spark, df, SF).collect())
        assert near == Counter(set(rows))
        assert key(stages["benchmark_decontamination"](spark, df, SF).collect()) == Counter(r for r, b in zip(rows, brute_decon(rows, items), strict=True) if not b[-1])
        mixed = stages["source_mixture"](spark, df, SF)
        assert mixed.columns == list(corpus_pipeline.COLUMNS)
        taken = key(mixed.collect())
        assert set(taken) <= set(rows) and all(n <= 3 * Counter(rows)[r] for r, n in taken.items())
        plan = Counter()
        from seqloom.llm import mixing

        for r in mixing.mix(df).collect():
            plan[r.doc_id, r.size] += r.times
        got = Counter()
        for (i, t, _), n in taken.items():
            got[i, len((t or "").split())] += n
        assert got == +plan
        assert stages["shards"](spark, df, SF).count() == len(rows)
