"""Sharding, mixing, decontamination, token counts, n-gram join and quality rules against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, mixing, ngram_join, quality, sharding, token_counts
from seqloom.llm import words as W

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, copy long, uid string, cls string, k int"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def rows(spark):
    """Documents of the small table, and hard cases: nulls, empty and long texts, repeated rows, ties."""
    got = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = got[3][1]
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    hard = [
        (9001, None, "src0"), (9002, "", None), (9003, " \n\t ", "src1"), (9004, long, "src2"), (9005, long + " end", "src2"), (None, "no id here at all", None), (None, None, None),
        (9006, base, "src3"), (9006, base, "src3"), (9007, base.upper(), "src3"), (9008, "one", "é"), (9009, "one", "\U0001f600"), (9010, "a b c d", "src0"), (9011, "A-b, c; d!", "src0"),
        (9012, "x" * 3_000_000 + " y", "src1"), (9013, "İstanbul Äpfel NAÏVE", "src1"),
    ]
    return got + hard


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns have the names that the operators use inside.
    return spark.createDataFrame([(i, t, "en", s, 0, -1, -1, -1, "u", "c", -1) for i, t, s in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_are_those_of_the_words(rows):
    texts = [(t or "").encode() for _, t, _ in rows]
    h, counts = W.words(texts)
    assert counts.tolist() == [len(plain(t)) for _, t, _ in rows]
    names, at = {}, 0
    for _, t, _ in rows:
        for w in plain(t):
            assert names.setdefault(w, int(h[at])) == int(h[at])
            at += 1
    assert len(set(names.values())) == len(names)


def test_sharding(docs, rows, none):
    got = sharding.shard_documents(docs, shards=24).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.virtual_slot < sharding.SLOTS
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert sharding.shard_documents(none).count() == 0


def test_sharding_is_even_and_reruns_agree(spark, rows):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 97).cast("int")).alias("text"))
    a = sharding.shard_documents(many)
    sizes = [r.b for r in a.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) / min(sizes) < 1.01
    assert sorted(a.collect()) == sorted(sharding.shard_documents(many.repartition(7)).collect())


def test_map_versions(spark, tmp_path):
    records = sharding.slot_records(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")))
    sizes = sharding.slot_sizes(records).cache()
    first = sharding.new_map(sizes, 8)
    sharding.save_map(first, str(tmp_path / "map"))
    second = sharding.rebalance(sharding.load_map(spark, str(tmp_path / "map")), sizes, 9)
    sharding.save_map(second, str(tmp_path / "map"))
    before = {r.virtual_slot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map"), 1).collect()}
    after = {r.virtual_slot: (r.shard, r.bytes) for r in sharding.load_map(spark, str(tmp_path / "map")).collect()}
    assert before.keys() == after.keys() and {s for s, _ in after.values()} == set(range(9))
    moved = [k for k in before if before[k] != after[k][0]]
    assert len(moved) < 0.2 * len(before)
    load = Counter()
    for s, b in after.values():
        load[s] += b
    assert max(load.values()) / min(load.values()) < 1.1
    with pytest.raises(ValueError):
        sharding.save_map(second, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map"), 2).count() == len(after)


def test_documents_go_by_the_stored_map(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    maps = str(tmp_path / "maps")
    sharding.save_map(sharding.new_map(sharding.slot_sizes(sharding.slot_records(docs)), 8), maps)
    got = sharding.shard_documents(docs.unionByName(docs.limit(1).selectExpr("doc_id", "text").withColumn("doc_id", F.lit(1).cast("long"))), 9, maps=maps)
    stored = {r.virtual_slot: r.shard for r in sharding.load_map(spark, maps, 2).collect()}
    rows = got.collect()
    assert len(rows) == 3001 and all(r.map_version == 2 and stored[r.virtual_slot] == r.shard for r in rows) and {r.shard for r in rows} == set(range(9))
    hot = sharding.shard_documents(spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"))).groupBy("shard").count().collect()
    assert len(hot) == 24 and sum(r["count"] for r in hot) == 20_000 and max(r["count"] for r in hot) < 1.05 * min(r["count"] for r in hot)


def brute_mix(rows):
    size = lambda t: len(SPACED.findall(t or ""))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(total.values())
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * total[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            target[s] = 3 * total[s]
        left -= sum(3 * total[s] for s in over)
        free -= over
    return total, target


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    total, target = brute_mix(rows)
    assert len(got) == len(rows)
    assert sum(target.values()) == pytest.approx(sum(total.values()))
    by_id = {i: s for i, _, s in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.times * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in total)
    assert mixing.mix(none).count() == 0


def test_mixing_by_either_plan(docs, monkeypatch):
    """By a broadcast of the sources; by a shuffle, with heavy sources apart; with none heavy."""
    want = Counter(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    for heavy in (10_000, 4, 1):
        monkeypatch.setattr(mixing, "HEAVY", heavy)
        assert Counter(map(tuple, mixing.mix(docs).collect())) == want


def test_mixing_rows_that_share_an_id(spark):
    """2,000 rows whose ids are null or 7, some of them repeated: the words taken come near the target all the same."""
    rows = [(None if i % 2 else 7, " ".join(f"w{i % 900}x{k}" for k in range(10)), "a") for i in range(2000)]
    rows += [(1, "b c", "b")] * 6000 + [(None, None, None)] * 3
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).collect()
    _, target = brute_mix(rows)
    assert len(got) == len(rows)
    by_size = Counter()
    for r in got:
        by_size[r.size] += r.taken
        assert r.target == pytest.approx(target[{10: "a", 2: "b", 0: None}[r.size]])
    assert abs(by_size[10] - target["a"]) <= 10 and abs(by_size[2] - target["b"]) <= 2


def brute_decon(rows, items):
    wins = defaultdict(set)
    for item, t in items:
        w = plain(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i : i + n])].add(str(item) if item is not None else "")
    sizes = {len(k) for k in wins}
    out = []
    for i, t, _ in rows:
        w, hit, ids = plain(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, docs, rows, none):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(500, None), (501, ""), (502, "a B c"), (503, "one"), (None, rows[5][1][:300]), (504, rows[5][1][:300]), (504, rows[6][1][:200]), (505, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, uid int")
    got = [tuple(r) for r in decontaminate.decontaminate(docs, table).collect()]
    assert Counter(got) == Counter(brute_decon(rows, items))
    clean = decontaminate.decontaminate(docs, table.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r.contaminated for r in clean)
    assert decontaminate.decontaminate(none, table).count() == 0


def test_decontamination_in_blocks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 400)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    table = spark.createDataFrame(items, "item_id long, text string")
    passes = []
    whole = decontaminate._block
    monkeypatch.setattr(decontaminate, "_block", lambda d, w, each: passes.append(each.count()) or whole(d, w, each))
    got = [tuple(r) for r in decontaminate.decontaminate(docs, table).collect()]
    assert Counter(got) == Counter(brute_decon(rows, items))
    assert len(passes) > 1 and max(passes) <= decontaminate.BLOCK


def shingles(text):
    w = plain(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None


def brute_join(rows):
    sets = defaultdict(list)
    for i, t, _ in rows:
        sets[shingles(t) if shingles(t) else ("text", t)].append(i)
    keys = list(sets)
    parent, links = list(range(len(keys))), [0] * len(keys)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if isinstance(x, frozenset) and isinstance(y, frozenset) and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(keys)):
        members[find(k)] += [i for i in sets[keys[k]] if i is not None]
    return Counter((i, min(members[find(k)], default=None), links[k], len(sets[keys[k]])) for k in range(len(keys)) for i in sets[keys[k]])


def test_ngram_join(docs, rows, none):
    got = ngram_join.jaccard_classes(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == brute_join(rows)
    assert ngram_join.jaccard_classes(none).count() == 0


def test_ngram_join_over_many_blocks(spark, monkeypatch):
    """A group of near copies, more than a block holds: every link is counted, over all pairs of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 8 * 64)
    words = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = list(words)
        own[(i * 7) % 60] = f"z{i}"
        rows.append((i, " ".join(own[: 60 - i % 4]), ""))
    rows += [(100 + i, " ".join(f"q{i}x{k}" for k in range(30)), "") for i in range(20)]
    got = ngram_join.jaccard_classes(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == brute_join(rows)


def test_prefix_length_reaches_the_recall():
    d = ngram_join.prefix_length(0.8)
    assert 1 - (1 - 0.8**d) ** ngram_join.TREES >= ngram_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** ngram_join.TREES


def brute_quality(text):
    w = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    chars = sum(map(len, w))
    base = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    kept = not base and 100 * symbols <= 5 * chars and 2 * (len(lines) - len(set(lines))) <= len(lines) and 3 * len(w) <= 2 * chars <= 60 * len(w)
    return len(w), chars, symbols, len(lines) - len(set(lines)), len(inside), base, kept


def test_quality(docs, rows, none):
    got = quality.judge(docs).collect()
    assert Counter(tuple(r)[:8] for r in got) == Counter((i, *brute_quality(t)) for i, t, _ in rows)
    assert quality.judge(none).count() == 0


def test_ablations(docs, rows):
    policy = quality.POLICIES[2]
    led = quality.ledger(docs).cache()
    bits = [r.failed_bits for r in led.collect()]
    got = {r.rule: (r.failed, r.only) for r in quality.ablations(led, policy).collect()}
    for rule in policy.rules:
        b = 1 << quality.RULES[rule]
        assert got[rule] == (sum(bool(x & b) for x in bits), sum((x & policy.mask) == b for x in bits))


def test_token_counts(docs, rows, none):
    tokenizers = pytest.importorskip("tokenizers")
    exact = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    exact.encode_special_tokens = True
    out = token_counts.count_tokens(docs, "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()
    got = {r.doc_id: r for r in out}
    nulls = [exact.encode(t or "", add_special_tokens=False) for i, t, _ in rows if i is None]
    assert sorted(r.n_tokens for r in out if r.doc_id is None) == sorted(map(len, nulls)) and len(out) == len(rows)
    for i, t, _ in rows:
        if i is None:
            continue
        r, t = got[i], t or ""
        spans = exact.encode(t, add_special_tokens=False).offsets
        assert (r.n_tokens, r.outside_tokens) == (len(spans), 0)
        ends, at = [], 0
        for line in t.splitlines(keepends=True) if "\r" not in t else re.findall(r"[^\n]*\n|[^\n]+", t):
            at += len(line)
            ends.append(at)
        if not re.search("[\x0b\x0c\x1c-\x1e\x85  ]", t):
            own = Counter(next(k for k, e in enumerate(ends) if s < e) for s, _ in spans)
            assert [int(x) for x in r.section_tokens] == [own[k] for k in range(len(ends))]
    assert token_counts.count_tokens(none, "/opt/tokenizers/byte_bpe_50k.tiktoken").count() == 0


def test_long_runs(spark, monkeypatch):
    """Runs of 5 MB of one kind pass; texts cut into parts have the tokens of the whole."""
    import random

    vocabulary = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    n = 5_000_000
    rows = [(1, " " * n), (2, "\n" * n), (3, "a" * n), (4, "#" * n), (5, "x" + " " * n + "y"), (None, "\t" * n + "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in token_counts.count_tokens(df, vocabulary).select("doc_id", "n_tokens", "n_sections", "outside_tokens").collect()}
    assert got[2].n_sections == n and got[1].n_sections == 1 and all(r.outside_tokens == 0 and r.n_tokens > 0 for r in got.values())
    encoding, _ = token_counts._encoding(open(vocabulary, "rb").read())
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "\u3000", "\x85", "\x1c", "a", "the", "'s", "'", "12", "é", "#!", "\t ", " \n", "\xa0", "\U0001f600"]
    for split in (1, 2, 3, 8):
        monkeypatch.setattr(token_counts, "SPLIT", split)
        for _ in range(1500):
            text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
            assert token_counts.encode(encoding, text) == encoding.encode_ordinary(text), text


def test_tokens_of_given_sections(spark):
    text = "Größe äöü and the rest\nof it"
    df = spark.createDataFrame([(1, text, [(0, 5), (6, 9), (9, 30)]), (2, text, None), (3, None, [(0, 1)])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    for rule in token_counts.RULES:
        got = {r.doc_id: r for r in token_counts.count_tokens(df, "/opt/tokenizers/byte_bpe_50k.tiktoken", rule, "parts").collect()}
        assert sum(got[1].section_tokens) + got[1].outside_tokens == pytest.approx(got[1].n_tokens)
        assert got[2].n_sections == 0 and got[2].outside_tokens == got[2].n_tokens and got[3].n_tokens == 0
