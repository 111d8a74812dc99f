"""What keeps large tables and documents within memory: what is broadcast, what the kernel holds, how often tokens are shuffled."""

import pyarrow as pa
import pyarrow.compute

from pyspark.sql import functions as F

import __spark_entry__
from seqloom.sources import xml

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_not_broadcast(spark):
    text = plan(__spark_entry__.queries()["template_document"](spark, SF))
    assert "MapInArrow" in text and "BroadcastExchange" not in text


def test_tokens_of_a_large_document_leave_the_kernel_while_it_is_read():
    doc = "<d>" + '<e a="1">x&amp;y</e>' * 50_000 + "</d>"
    heads = pa.RecordBatch.from_pydict({"iter": [0], "pos": [0], "base_uri": [None]}, schema=pa.schema([(k, xml._TYPES[k]) for k in ("iter", "pos", "base_uri")]))
    tokens, batches, most = xml._Tokens(xml._TYPES, None), [], 0
    for _ in tokens.read(0, doc, True):
        most = max(most, len(tokens.rows))
        if len(tokens.rows) > xml.ROWS:
            batches.append(tokens.take(heads))
    batches.append(tokens.take(heads))
    made = pa.Table.from_batches(batches)
    assert most < 2 * xml.ROWS and len(batches) > 5
    assert made["ord"].to_pylist() == [float(k) for k in range(150_002)]
    assert set(made.filter(pa.compute.equal(made["kind"], "text"))["value"].to_pylist()) == {"x&y"}


def test_kinds_that_are_left_out_do_not_change_the_others(spark):
    from seqloom.sources.files import inline

    seq = inline(spark, "<d>a<!-- c --><e x='1'>b</e></d>", "<d/>")
    rows = lambda t: sorted(map(str, t.collect()))
    assert rows(xml.parse(seq, kinds=("open", "text"))) == rows(xml.parse(seq).filter("kind in ('open', 'text')"))


def test_queries_read_their_documents_once(spark):
    known = __spark_entry__.queries()
    for name in ("structure_check", "label_elements", "delete_lines", "replace_lines", "json_nested", "json_to_xml"):
        text = plan(known[name](spark, SF))
        # The argument of replace is one document of its own.
        assert text.count("MapInArrow") == 1 + (name == "replace_lines"), name


def test_windows_of_a_step_share_one_shuffle(spark):
    from seqloom.operators import match as M
    from seqloom.operators import rewrite as R
    from seqloom.sources.files import inline

    tokens = xml.parse(inline(spark, "<d><p/><p/></d>"))
    for made in (R.pretty_print(tokens), R.wrap_adjacent(tokens, M.element("p"), "b", M.attr("a")), R.select(tokens, M.element("p"))):
        assert plan(xml.serialize(made)).count("Exchange hashpartitioning") == 1


def test_archives_are_written_without_a_call_a_path(spark):
    text = plan(__spark_entry__.queries()["zip_update"](spark, SF))
    assert text.count("MapInArrow") == 2 and "FlatMapGroups" not in text


def test_archives_go_on_over_batches(spark):
    from seqloom.sources import files

    rows = [(p, n, c) for p in ("a", "b", None) for n in ("x", "y", "z") for c in (b"2", b"1", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        archives = files.zip_entries(spark.createDataFrame(rows, "path string, name string, content binary")).collect()
        assert sorted(str(r.path) for r in archives) == ["None", "a", "b"]
        back = files.unzip(spark.createDataFrame(archives, "path string, content binary")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = [(r.path, r.name, bytes(r.content)) for r in back]
    assert sorted(found, key=str) == sorted([(p, n, c or b"") for p, n, c in rows], key=str)
    assert [c for p, n, c in found if p == "a" and n == "x"] == [b"", b"1", b"2"]


def test_batches_of_entries_are_bounded(monkeypatch):
    from seqloom.sources import files

    monkeypatch.setattr(files, "ROWS", 4)
    monkeypatch.setattr(files, "BYTES", 10)
    rows = [("p", b"x" * n) for n in (1, 1, 1, 1, 1, 30, 9, 0, 1)]
    made = list(files._batches(iter(rows), "path", "content"))
    assert [b.num_rows for b in made] == [4, 2, 3]
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == rows


def test_a_change_of_base_is_resolved_once(spark, monkeypatch):
    from seqloom.operators import rewrite as R
    from seqloom.sources.files import inline

    calls = []
    monkeypatch.setattr(R, "resolve_uri", lambda r, b: calls.append(1) or F.concat(b, F.lit("+"), r))
    tokens = xml.parse(inline(spark, '<a><b xml:base="1"><c xml:base="2"/>x</b><d xml:base="3"><e/></d></a>', "<a/>", base_uri="0"))
    found = {(r.pos, r.local): (r._base, r._above) for r in R.base_uris(tokens).filter("kind = 'open'").collect()}
    assert found == {(0, "a"): ("0", None), (0, "b"): ("0+1", "0"), (0, "c"): ("0+1+2", "0+1"), (0, "d"): ("0+3", "0"), (0, "e"): ("0+3", "0+3"), (1, "a"): ("0", None)}
    assert len(calls) == 1


def test_base_uris_of_many_changes(spark):
    from urllib.parse import urljoin
    from xml.etree import ElementTree

    from seqloom.operators import rewrite as R
    from seqloom.sources.files import inline

    inner = lambda k: "".join(f'<e n="{k}.{i}" xml:base="{x}"><f n="{k}.{i}f"/></e>' for i, x in enumerate(("a/b.xml", "../c.xml", "/d/./e.xml", "//o/p", "x:y", "?q=1", "g/")))
    doc = '<d n="r">' + "".join(f'<s n="{k}" xml:base="s{k}/t/u.xml">{inner(k)}</s>' for k in range(60)) + "</d>"
    want = {}

    def walk(e, base):
        own = e.get(f"{{{xml.XML_NS}}}base")
        base = base if own is None else urljoin(base, own)
        want[e.get("n")] = base
        for x in e:
            walk(x, base)

    walk(ElementTree.fromstring(doc), "http://h/z/y.xml")
    made = R.base_uris(xml.parse(inline(spark, doc, base_uri="http://h/z/y.xml"))).filter("kind = 'open'").select(F.filter("attrs", lambda a: a["local"] == "n")[0]["value"].alias("n"), "_base").collect()
    assert len(made) == len(want) and {r.n: r._base for r in made} == want


def test_parts_of_uris_are_computed_once(spark):
    from seqloom.functions.uris import resolve_uri

    text = plan(spark.createDataFrame([("a", "b")], "r string, b string").select(resolve_uri(F.col("r"), F.col("b"))))
    # Eight parts, each of which the plan names twice at most.
    assert text.count("regexp_extract(") <= 16


RICH = [
    "<d><p>1</p><q/><p a='&lt;&quot;&#10;&#9;&#13;&amp;%s'>2 &lt;&gt;&amp;&#13;<![CDATA[<x>]]></p></d>",
    "<d/>",
    "<?pi before?><!-- b --><d><r><p>3<!-- c --><p>4<?t d?><?e?></p>x<p/></p></r>tail</d><!-- a --><?pi after?>",
    "<p>5</p>",
    '<d xmlns="u:1" xmlns:b="u:2%d"><b:p b:x="1" y="2" xml:lang="en">t<p xmlns="" z="&gt;"><s/>v<b:s/></p><s/></b:p><p/></d>',
    '<b:d xmlns:b="u:1"><p><c xmlns="u:3&amp;"><p xmlns="">6<s/></p></c><s a="1"/><b:s xmlns:b="u:4" b:a="1"/></p><b:p/></b:d>',
    '<!DOCTYPE d [<!ENTITY e "<p>in</p>"><!ATTLIST p k CDATA "0">]><d>&e;<p>7</p></d>',
    "<d>" + "".join(f"<s n='{k}'><p>{'é€😀' * (k % 50)}</p>{'y' * (k % 700)}</s>" for k in range(3_000)) + "</d>",
    "<p>" + "<p>" * 60 + "deep" + "</p>" * 60 + "z" * 200_000 + "</p>",
]


def by_windows(seq, match):
    """iter, pos, k and doc of matched elements by the select step, which shuffles tokens."""
    from pyspark.sql import Window

    from seqloom.operators import rewrite as R

    made = xml.serialize(R.select(xml.parse(seq), match), keys=("iter", "pos", "ord_in"))
    rows = made.select("iter", "pos", (F.row_number().over(Window.partitionBy("iter", "pos").orderBy("ord_in")) - 1).alias("k"), "base_uri", "doc")
    return sorted(tuple(r) for r in rows.collect())


def test_a_select_of_a_port_neither_shuffles_nor_sorts_tokens(spark):
    from seqloom.operators import match as M
    from seqloom.sources.files import inline

    text = plan(xml.cut(inline(spark, *RICH), M.element("p")))
    assert text.count("MapInArrow") == 2 and not any(x in text for x in ("Exchange", "Sort", "Window", "Aggregate"))


def test_cut_documents_are_those_of_select_and_serialize(spark):
    from pyspark.sql import Window

    from seqloom.operators import match as M
    from seqloom.sources.files import inline

    seq = inline(spark, *RICH, base_uri="u:b").withColumn("iter", F.col("pos") % 2)
    second = F.row_number().over(Window.partitionBy("iter", "pos", "local", "kind").orderBy(F.desc("ord"))) == 2
    matches = [(M.element("p"), ("path",)), (M.element("p"), None), (M.element("d//p") & M.attr("n").isNull(), ("path", "attrs")), (M.element(), ()), (F.lit(None).cast("boolean"), None), ((F.col("sibling") == 2) | (F.size("ancestors") == 3) | (F.col("ns") == "u:4"), None), (second, None)]
    for size in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            for match, only in matches:
                made = xml.cut(seq, match, only)
                rows = made.select("iter", "pos", "base_uri", "n", F.inline("found")).collect()
                assert sorted((r.iter, r.pos, r.k, r.base_uri, r.doc) for r in rows) == by_windows(seq, match), (match, size)
                assert made.filter(F.col("n") != F.size("found")).count() == 0
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_are_those_of_text_of(spark):
    from seqloom.operators import match as M
    from seqloom.operators import rewrite as R
    from seqloom.sources.files import inline

    seq = inline(spark, *RICH)
    for match, only in ((M.element("p"), ("path",)), (M.element(), ()), (M.element("p") & M.has_attr("a"), ("path", "attrs"))):
        made = xml.texts(seq, match, only)
        assert "Exchange" not in plan(made)
        found = sorted((r.pos, r.k, r.text) for r in made.collect())
        ids = sorted((r.pos, r.id, r.text) for r in R.text_of(xml.parse(seq), match).collect())
        assert len(found) == len(ids) > 0 and [(p, t) for p, _, t in found] == [(p, t) for p, _, t in ids]


def test_batches_of_cut_documents_are_bounded(monkeypatch):
    monkeypatch.setattr(xml, "CHARS", 100)
    types = xml._wanted(("path",)) | xml._CUT
    heads = pa.RecordBatch.from_pydict({"iter": [0, 0], "pos": [4, 5], "base_uri": [None, None]}, schema=pa.schema([(k, xml._TYPES[k]) for k in ("iter", "pos", "base_uri")]))
    tags = xml._Elements(types)
    for i, doc in enumerate(("<d>" + "<p>x</p>" * 100 + "</d>", "<p/>")):
        assert not list(tags.read(i, doc, False))
    rows = tags.take(heads)
    rows = rows.append_column("_hit", pa.array([p.endswith("/p") for p in rows["path"].to_pylist()]))
    made = list(xml._cut(iter([rows])))
    assert [b["n"].to_pylist() for b in made] == [[13]] * 7 + [[9, 1]]
    found = [(pos, x["k"], x["doc"]) for b in made for pos, f in zip(b["pos"].to_pylist(), b["found"].to_pylist(), strict=True) for x in f]
    assert found == [(4, k, "<p>x</p>") for k in range(100)] + [(5, 0, "<p></p>")]


def test_input_select_numbers_documents_of_many_matches(spark, monkeypatch):
    from seqloom.operators import match as M
    from seqloom.operators import sequence as S
    from seqloom.sources.files import inline

    monkeypatch.setattr(S, "BUCKET", 2)
    docs = ["<d>" + "".join(f"<p>{i}.{k}</p>" for k in range((i * 7) % 5)) + "</d>" for i in range(20)]
    seq = inline(spark, *docs)
    want = [f"<p>{i}.{k}</p>" for i in range(20) for k in range((i * 7) % 5)]
    got = S.input_select(seq, M.element("p"), only=("path",)).orderBy("pos").collect()
    assert [(r.pos, r.doc) for r in got] == list(enumerate(want))
