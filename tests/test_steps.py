import re

import pytest
from pyspark.sql import functions as F

from seqloom.functions import pipeline as P
from seqloom.functions import uris
from seqloom.functions.errors import PipelineError, code_of
from seqloom.operators import content as C
from seqloom.operators import match as M
from seqloom.operators import rewrite as R
from seqloom.operators import sequence as S
from seqloom.plans.pipeline import Pipeline, call, option
from seqloom.sources import files
from seqloom.sources.files import empty, inline
from seqloom.sources.xml import parse, serialize
from seqloom.streaming import watch


def docs(seq):
    return [r.doc for r in seq.orderBy("iter", "pos").collect()]


def test_count(spark):
    seq = inline(spark, "<a/>", "<b/>", "<c/>")
    assert [S.count(seq).first()[0], S.count(seq, 2).first()[0], S.count(empty(spark)).first()[0]] == [3, 2, 0]


def test_positions_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 4)
    rows = spark.range(30).select((F.col("id") % 2).alias("iter"), (F.col("id") * 3).alias("pos"), F.floor(F.col("id") / 7).alias("k"))
    got = S.with_position(rows, last=True).orderBy("iter", "pos").collect()
    assert [r.position for r in got] == [*range(1, 16), *range(1, 16)] and {r.last for r in got} == {15}
    runs = [r.run for r in S.adjacent_runs(rows.filter("iter = 0"), F.col("k")).orderBy("pos").collect()]
    keys = [i // 7 for i in range(0, 30, 2)]
    want, n = [], -1
    for i, k in enumerate(keys):
        n += i == 0 or k != keys[i - 1]
        want.append(n)
    assert runs == want


def test_split_sequence(spark):
    rows = spark.range(6).select(F.lit(0).cast("bigint").alias("iter"), F.col("id").alias("pos"))
    pos = lambda d: sorted(r.pos for r in d.collect())
    yes, no = S.split_sequence(rows, F.col("pos") % 2 == 0)
    assert (pos(yes), pos(no)) == ([0, 2, 4], [1, 3, 5])
    yes, no = S.split_sequence(rows, F.col("pos") != 3, initial_only=True)
    assert (pos(yes), pos(no)) == ([0, 1, 2], [3, 4, 5])
    yes, _ = S.split_sequence(rows, F.col("position") == F.col("last"), positions=True, last=True)
    assert pos(yes) == [5] and yes.columns == rows.columns
    yes, no = S.split_sequence(rows, F.lit(None).cast("boolean"))
    assert (pos(yes), len(pos(no))) == ([], 6)


def test_wrap_sequence(spark):
    seq = inline(spark, '<d k="1"/>', '<d k="1"/>', '<d k="2"/>', '<d k="1"/>')
    key = F.regexp_extract("doc", 'k="(.)"', 1)
    assert docs(S.wrap_sequence(seq, "w", key)) == ['<w><d k="1"/><d k="1"/></w>', '<w><d k="2"/></w>', '<w><d k="1"/></w>']
    assert docs(S.wrap_sequence(seq, ("urn:x", "x", "w"))) == ['<x:w xmlns:x="urn:x">' + '<d k="1"/><d k="1"/><d k="2"/><d k="1"/>' + "</x:w>"]
    assert docs(S.wrap_sequence(empty(spark), "w")) == ["<w></w>"] and docs(S.wrap_sequence(empty(spark), "w", key)) == []


def test_pack_concat_and_flatten(spark):
    a, b = inline(spark, "<a/>", "<b/>"), inline(spark, "<x/>", "<y/>", "<z/>")
    assert docs(S.pack(a, b, "p")) == ["<p><a/><x/></p>", "<p><b/><y/></p>", "<p><z/></p>"]
    assert docs(S.concat(a, b)) == ["<a/>", "<b/>", "<x/>", "<y/>", "<z/>"]
    each = S.iterate(b).drop("iter_position", "iter_size")
    assert docs(S.flatten(each.unionByName(each.withColumn("pos", F.col("pos") + 10)))) == ["<x/>", "<x/>", "<y/>", "<y/>", "<z/>", "<z/>"]


def test_compare_and_choose(spark):
    a, b = inline(spark, '<a x="1" y="2"/>', "<b/>"), inline(spark, '<a y="2" x="1"></a>', "<c/>")
    assert [r.equal for r in S.compare(a, b).orderBy("pos").collect()] == [True, False]
    with pytest.raises(Exception) as x:
        S.compare(a, b, fail_if_not_equal=True).collect()
    assert code_of(x.value) == "XC0019"
    with pytest.raises(Exception) as x:
        S.choose(a, [(F.contains("doc", F.lit("<a")), lambda d: d)]).collect()
    assert code_of(x.value) == "XD0004"


def test_until_unchanged(spark):
    seq = inline(spark, "<d>xxx</d>", "<d>y</d>")
    assert sorted(docs(S.until_unchanged(seq, lambda d: d.withColumn("doc", F.regexp_replace("doc", "x(?=<)", ""))))) == ["<d></d>", "<d>y</d>"]


@pytest.mark.parametrize(
    ("relative", "expected"),
    [("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"), ("", "http://a/b/c/d;p?q"), ("..", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../../g", "http://a/g"), ("g:h", "g:h"), ("./g/.", "http://a/b/c/g/")],
)
def test_resolve_uri(spark, relative, expected):
    """The examples of RFC 3986, section 5.4."""
    got = spark.range(1).select(uris.resolve_uri(F.lit(relative), F.lit("http://a/b/c/d;p?q"))).first()[0]
    assert got.rstrip("/") == expected.rstrip("/") if relative == "//g" else got == expected


def test_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(uris.form_encode(F.lit("a b&c/é"))) == "a+b%26c/%C3%A9"
    assert [tuple(p) for p in one(uris.form_decode(F.lit("a=1&b=x+y%26&a=")))] == [("a", "1"), ("b", "x y&"), ("a", "")]
    for bad, code in (("a", "XC0037"), ("=1", "XC0037"), ("1a=2", "XC0061")):
        with pytest.raises(Exception) as x:
            one(uris.form_decode(F.lit(bad)))
        assert code_of(x.value) == code


def test_hashes(spark):
    import base64
    import hashlib
    import hmac
    import zlib

    one = lambda c: spark.range(1).select(c).first()[0]
    v = F.lit("value")
    assert one(R.hash_value(v, "crc", "32")) == f"{zlib.crc32(b'value'):x}"
    assert one(R.hash_value(v, "sha", "512")) == hashlib.sha512(b"value").hexdigest()
    for key in ("k", "k" * 100):
        assert one(R.hash_value(v, "hmac", key=key)) == base64.b64encode(hmac.digest(key.encode(), b"value", "sha1")).decode()


def test_template_and_json(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(C.template("{{a}} {x}!", {"x": F.lit(7)})) == "{a} 7!"
    for bad in ("{x", "x}", "{y}"):
        with pytest.raises(PipelineError) as x:
            C.template(bad, {"x": F.lit(1)})
        assert x.value.code == "XC0067"
    assert one(C.json_to_xml(F.lit('{"k": 1, "s": "<"}'), "k bigint, s string, n int")) == '<json type="object"><k type="number">1</k><s type="string">&lt;</s><n type="null"></n></json>'


def test_html(spark):
    tokens = C.parse_html(inline(spark, "<ul><li>a<li>b<br>c</ul><p>x<p>y<script>'</p>'</script>"))
    assert docs(serialize(tokens)) == ["<ul><li>a</li><li>b<br></br>c</li></ul><p>x</p><p>y<script>'&lt;/p&gt;'</script></p>"]


def test_xinclude(spark):
    seq = inline(spark, '<d><xi:include href="a.xml"/>-<xi:include href="none"><xi:fallback>f</xi:fallback></xi:include></d>', base_uri="http://h/d/e.xml")
    resources = spark.createDataFrame([("http://h/d/a.xml", '<a><xi:include href="b.xml"/></a>'), ("http://h/d/b.xml", "<b/>"), ("http://h/d/loop", '<xi:include href="loop"/>')], "uri string, doc string")
    assert docs(C.xinclude(seq, resources)) == ["<d><a><b/></a>-f</d>"]
    for bad in ("missing", "loop"):
        with pytest.raises(Exception) as x:
            C.xinclude(inline(spark, f'<d><xi:include href="{bad}"/></d>', base_uri="http://h/d/e.xml"), resources).collect()
        assert code_of(x.value) == "XC0029"


def test_xinclude_reads_markup(spark):
    """Any prefix and quotes; comments and CDATA are no includes; relative to the resource; 25 levels; declarations go; fix-up."""
    xi = 'xmlns:i="http://www.w3.org/2001/XInclude"'
    seq = inline(spark, f"<?xml version='1.0'?><!DOCTYPE d [<!ENTITY e 'x'>]><d {xi} xml:lang='fr'><!-- <i:include href='none'/> --><i:include href='s/a.xml' >z</i:include><![CDATA[<i:include/>]]></d>", f"<d {xi}/>", f"<i:include {xi} href='l0'/>", base_uri="http://h/d/e.xml")
    rows = [("http://h/d/s/a.xml", f"<?xml version='1.0'?>\n<a {xi}><i:include href='b.xml'/></a>"), ("http://h/d/s/b.xml", "<b/>")]
    rows += [(f"http://h/d/l{k}", f"<l {xi}><i:include href='l{k + 1}'/></l>") for k in range(25)] + [("http://h/d/l25", "<end/>")]
    resources = spark.createDataFrame(rows, "uri string, doc string")
    got = docs(C.xinclude(seq, resources))
    assert got[0].endswith(f"xml:lang='fr'><!-- <i:include href='none'/> -->\n<a {xi}><b/></a><![CDATA[<i:include/>]]></d>") and got[1] == f"<d {xi}/>" and got[2].count("<l ") == 25 and "<end/>" in got[2]
    fixed = docs(C.xinclude(seq, resources, fixup_xml_base=True, fixup_xml_lang=True))[0]
    assert f'<a xml:base="http://h/d/s/a.xml" xml:lang="fr" {xi}><b xml:base="http://h/d/s/b.xml"/></a>' in fixed


def test_try_catches_documents_that_cannot_be_read(spark):
    seq = inline(spark, "<a/>", "<a", "<b>x</b>").unionByName(inline(spark, "x").selectExpr("iter", "pos + 9 AS pos", "base_uri", "CAST(null AS string) AS doc"))
    catch = lambda d: d.select("iter", "pos", "base_uri", F.col("code").alias("doc"))
    assert docs(S.try_parsed(seq, lambda t: serialize(R.rename(t, M.element("a"), "c")), catch)) == ["<c></c>", "XD0011", "<b>x</b>", "XD0011"]
    assert docs(S.try_parsed(seq, lambda t: serialize(R.rename(t, M.element("a"), "x:y")), catch)) == ["XD0034"] * 4
    assert [r.error[:8] for r in S.try_catch(seq, lambda d: S.count(d, "x"), lambda d: d).collect()] == ["[XD0019]"] * 4


def test_wrap_sequence_by_iteration(spark):
    seq = inline(spark, "<a/>", "<b/>").withColumn("iter", F.col("pos"))
    assert docs(S.wrap_sequence(seq, "w")) == ["<w><a/></w>", "<w><b/></w>"]
    assert docs(S.wrap_sequence(seq, "w", iterations=spark.range(3).select(F.col("id").alias("iter")))) == ["<w><a/></w>", "<w><b/></w>", "<w></w>"]


def test_add_xml_base_where_it_changes(spark):
    doc = '<d><p xml:base="sub/q.xml"><r xml:base="r.xml"/><s/></p><t xml:base="http://o/x"/><u xml:base="e.xml"/></d>'
    seq = inline(spark, doc, base_uri="http://h/d/e.xml")
    out = lambda **o: re.sub(r"></\w>", "/>", docs(serialize(R.add_xml_base(parse(seq), **o)))[0])
    assert out() == '<d xml:base="http://h/d/e.xml"><p xml:base="sub/q.xml"><r xml:base="r.xml"/><s/></p><t xml:base="http://o/x"/><u/></d>'
    assert out(relative=False) == '<d xml:base="http://h/d/e.xml"><p xml:base="http://h/d/sub/q.xml"><r xml:base="http://h/d/sub/r.xml"/><s/></p><t xml:base="http://o/x"/><u/></d>'
    assert out(all=True, relative=False).count("xml:base=") == 6


def test_output_parameters(spark):
    tokens = parse(inline(spark, "<d><p>a &lt; b</p><q>c</q></d>"))
    from seqloom.sources.xml import output

    assert docs(output(tokens, omit_xml_declaration=False, standalone=True, cdata_section_elements=["p"], doctype_system="d.dtd")) == ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<!DOCTYPE d SYSTEM "d.dtd">\n<d><p><![CDATA[a < b]]></p><q>c</q></d>']
    assert docs(output(tokens, method="text")) == ["a < bc"] and docs(output(tokens, indent=True))[0].count("\n") == 3
    for bad in ({"method": "pdf"}, {"colour": 1}):
        with pytest.raises(PipelineError):
            output(tokens, **bad)


def test_step_names_are_a_registry(spark):
    assert not any(P.step_available(f"p:{n}") for n in ("check", "Rule", "materialize", "attr", "fail"))
    P.register_step("my:twice", lambda seq: S.concat(seq, seq))
    assert P.step_available("my:twice") and docs(P.step("my:twice")(inline(spark, "<a/>"))) == ["<a/>", "<a/>"]
    P.add_properties({"color": "red"}, "my")
    assert P.system_property("my:color") == "red" and P.system_property("p:color") == ""
    for bad in (lambda: P.register_step("my:twice", len), lambda: P.step("my:none")):
        with pytest.raises(PipelineError):
            bad()


def test_schematron(spark):
    seq = inline(spark, '<d><p a="1"/><p/></d>', "<d/>")
    report = C.schematron(parse(seq), [C.Rule("r", M.element("p"), M.attr("a").isNotNull(), "no a"), C.Rule("s", M.element("d"), F.lit(False), "never", phase="other")], phase="one")
    assert [(r.pos, r.path, r.message) for r in report.collect()] == [(0, "/d/p", "no a")]
    with pytest.raises(Exception) as x:
        C.assert_valid(seq, report).collect()
    assert code_of(x.value) == "XC0054"


def test_unescape_options(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(C.unescape_markup(F.lit("PGEvPg=="), encoding="base64", charset="UTF-8")) == "<a/>"
    for kw, code in (({"content_type": "image/png"}, "XC0051"), ({"encoding": "base64"}, "XC0010"), ({"encoding": "x"}, "XC0052")):
        with pytest.raises(PipelineError) as x:
            C.unescape_markup(F.lit(""), **kw)
        assert x.value.code == code


def test_files(spark, tmp_path):
    for n, t in (("a.xml", "<a\n/>"), ("b.xml", "<b/>"), ("c.txt", "c\n1=2\n# x\nk : v\n")):
        (tmp_path / n).write_text(t)
    assert docs(files.load(spark, str(tmp_path), r".*\.xml")) == ["<a\n/>", "<b/>"]
    assert sorted(r.name for r in files.directory_list(spark, str(tmp_path), include=r".*\.xml", exclude="b.*").collect()) == ["a.xml"]
    assert sorted(r.size for r in files.file_info(spark, str(tmp_path)).collect()) == [4, 5, 16]
    lines = files.lines(spark, str(tmp_path / "c.txt"))
    got = lambda d: [r.text for r in d.orderBy("line").collect()]
    assert got(files.head(lines, 2)) == ["c", "1=2"] and got(files.head(lines, -3)) == ["k : v"] and got(files.tail(lines, 1)) == ["k : v"] and got(files.tail(lines, -1)) == ["c", "1=2", "# x"]
    assert [tuple(r) for r in files.java_properties(spark, str(tmp_path / "c.txt")).collect()] == [("c", ""), ("1", "2"), ("k", "v")]
    with pytest.raises(PipelineError) as x:
        files.directory_list(spark, str(tmp_path / "none"))
    assert x.value.code == "XC0017"
    with pytest.raises(PipelineError) as x:
        files.store(inline(spark, "<a/>"), str(tmp_path / "out"))
    assert x.value.code == "XD0021"
    files.store(inline(spark, "<a/>", "<b/>"), str(tmp_path / "out"), "gzip", allow_effects=True)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["<a/>", "<b/>"]
    assert docs(files.data(spark, str(tmp_path / "a.xml"), "text/plain"))[0].endswith('content-type="text/plain">&lt;a\n/&gt;</c:data>')


def test_zip(spark):
    entries = spark.createDataFrame([("z", "b", b"2"), ("z", "a", b"1"), ("y", "c", None)], "path string, name string, content binary")
    back = files.unzip(files.zip_entries(entries)).orderBy("path", "name").collect()
    assert [(r.path, r.name, bytes(r.content)) for r in back] == [("y", "c", b""), ("z", "a", b"1"), ("z", "b", b"2")]


def test_pipeline(spark):
    seen = []
    p = Pipeline("source", required=("flag",))
    p.step("tokens", lambda source: parse(source))
    p.step("split", lambda t, want: dict(zip(("matched", "rest"), S.split_sequence(t, F.col("local") == want), strict=True)), {"want": option("flag")})
    p.step("n", lambda rows: S.count(rows), rows="split.matched")
    p.step("m", lambda rows: S.count(rows), rows="split.rest")
    p.effect("log", lambda d: seen.append(d.first()[0]), "n")
    ports = p.run({"flag": "p"}, source=inline(spark, "<d><p/><p/></d>"))
    assert ports["n"].first()[0] == 4 and ports["m"].first()[0] == 2 and seen == [4]
    for bad, code in (
        (lambda: p.run({}, source=empty(spark)), "XS0018"),
        (lambda: p.run({"flag": "p"}), "XS0032"),
        (lambda: p.step("n", lambda s: s), "XS0002"),
        (lambda: p.step("o", lambda s: s, t="n"), "XS0010"),
        (lambda: p.step("o", lambda s, k: s), "XS0018"),
        (lambda: Pipeline(("a", "a")), "XS0011"),
        (lambda: Pipeline("s").step("a", lambda s: s, s="b").step("b", lambda s: s, s="a").order(), "XS0001"),
        (lambda: Pipeline("s").step("a", lambda s: s, s="none").order(), "XS0022"),
    ):
        with pytest.raises(PipelineError) as x:
            bad()
        assert x.value.code == code


def test_functions(spark):
    assert P.step_available("p:count") and P.step_available("cx:pretty-print") and not P.step_available("p:none")
    assert P.system_property("p:version") == "1.0" and P.system_property("p:none") == ""
    assert P.version_available(1.0) and not P.version_available(2) and P.xpath_version_available(2.0)
    assert P.value_available("a", {"a": 1}) and not P.value_available("b", {}, False)
    assert P.typed("1", "boolean") is True and P.typed("b", "a|b") == "b" and P.environment(spark).count() and P.os_info(spark).count() == 7
    for bad in (lambda: P.typed("yes", "boolean"), lambda: P.typed("c", "a|b"), lambda: P.typed("x", "integer")):
        with pytest.raises(PipelineError) as x:
            bad()
        assert x.value.code == "XD0045"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: watch.run(watch.watch(spark, str(tmp_path / "in")), [lambda d: serialize(R.rename(parse(d), M.element("a"), "b"))], str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    for n in (1, 2):
        (tmp_path / "in" / f"{n}.xml").write_text(f"<a>{n}</a>")
        run()
    assert sorted(r.doc for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["<b>1</b>", "<b>2</b>"]
    with pytest.raises(PipelineError):
        watch.run(watch.watch(spark, str(tmp_path / "in")), [S.count], "x", "y")


def test_entry_without_llm(monkeypatch):
    """The other queries work where the llm subpackage is gone."""
    import __spark_entry__ as e

    monkeypatch.setattr(e, "_llm", lambda: None)
    assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries()) and not any(k.startswith("op") for k in e.queries())


def test_file_utilities(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    on = {"allow_effects": True}
    assert files.mkdir(spark, at("d"), **on) and files.touch(spark, at("d/a"), **on) and not files.touch(spark, at("d/a"), **on)
    files.copy(spark, at("d/a"), at("d/b"), **on)
    files.move(spark, at("d/b"), at("c"), **on)
    made = files.tempfile(spark, at("d"), "x", ".t", **on)
    assert (tmp_path / "c").exists() and not (tmp_path / "d" / "b").exists() and made.endswith(".t")
    for bad, code in ((lambda: files.delete(spark, at("d"), **on), "FU02"), (lambda: files.delete(spark, at("none"), **on), "FU01"), (lambda: files.copy(spark, at("none"), at("e"), **on), "FU01"), (lambda: files.delete(spark, at("d"), True), "XD0021")):
        with pytest.raises(PipelineError) as x:
            bad()
        assert x.value.code == code
    assert files.delete(spark, at("d"), True, **on) and not (tmp_path / "d").exists()


def test_collections(spark):
    files.register_collection(inline(spark, "<a/>"), "http://h/c")
    assert docs(files.collection(spark, "http://h/c")) == ["<a/>"] and docs(files.collection(spark, "http://h/none")) == []


@pytest.mark.parametrize(
    ("text", "pointer", "expected"),
    [
        ("a\nb\nc", "line=1,2", "b\n"),
        ("a\r\nb\rc\n", "line=1", "b\nc\n"),
        ("a\nb", "line=,1", "a\n"),
        ("a\nb", "line=5,7", ""),
        ("a\nb", "line=1,0", ""),
        ("abc\nd", "char=1,5", "bc\nd"),
        ("abc", "char=2", "c\n"),
        ("", "line=0,1", ""),
        ("", "char=0,3", ""),
        ("abc", "char=0,1;length=3", "a"),
    ],
)
def test_text_range(spark, text, pointer, expected):
    row = spark.range(1).select(C.text_range(F.lit(text), F.lit(pointer)).alias("x"))
    assert row.first().x == expected


@pytest.mark.parametrize("pointer", ["word=1,2", "line=", "char=0,1;length=4", "line=a"])
def test_text_range_errors(spark, pointer):
    with pytest.raises(Exception) as x:
        spark.range(1).select(C.text_range(F.lit("abc"), F.lit(pointer)).alias("x")).collect()
    assert code_of(x.value) == "XC0029"


def test_xinclude_of_text(spark):
    resources = spark.createDataFrame([("http://h/t.txt", "1 < 2\n& 3")], "uri string, doc string")
    seq = inline(spark, '<a><xi:include parse="text" href="t.txt"/></a>', '<a><xi:include href="t.txt" parse="text" xpointer="text(line=1,)"/></a>', base_uri="http://h/a.xml")
    assert docs(C.xinclude(seq, resources)) == ["<a>1 &lt; 2\n&amp; 3</a>", "<a>&amp; 3\n</a>"]


def test_json_of(spark):
    rows = spark.createDataFrame([('{"n": 1, "s": "a\\"<b", "t": true}',), ('{"n": null}',)], "j string")
    seq = rows.select(F.lit(0).cast("bigint").alias("iter"), F.length("j").cast("bigint").alias("pos"), F.lit(None).cast("string").alias("base_uri"), C.json_to_xml(F.col("j"), "n bigint, s string, t boolean").alias("doc"))
    got = [r.json for r in C.json_of(parse(seq)).orderBy("pos").collect()]
    assert got == ['{"n":null,"s":null,"t":null}', '{"n":1,"s":"a\\"<b","t":true}']
    assert [r.json for r in C.json_of(parse(inline(spark, "<json/>"))).collect()] == ["{}"]


def test_report_errors(spark):
    said = []
    seq = inline(spark, "<a/>")
    assert docs(C.report_errors(seq, inline(spark, "<r>1</r>", "<r>2</r>"), log=said.append, most=1)) == ["<a/>"]
    assert said == ["2 reports", "<r>1</r>"]
    assert docs(C.report_errors(seq, empty(spark), "my:code")) == ["<a/>"]
    with pytest.raises(Exception, match="my:code"):
        docs(C.report_errors(seq, inline(spark, "<r/>"), "my:code", log=said.append))


def test_schema_valid(spark, tmp_path):
    xsd = tmp_path / "p.xsd"
    xsd.write_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="p"><xs:complexType><xs:attribute name="size" type="xs:positiveInteger" use="required"/></xs:complexType></xs:element></xs:schema>')
    seq = inline(spark, '<p size="1"></p>', '<p size="0"></p>', "<p></p>", "<q></q>")
    report = C.schema_valid(seq, str(xsd))
    assert [r.valid for r in report.orderBy("pos").collect()] == [True, False, False, False]
    with pytest.raises(Exception) as x:
        docs(C.assert_valid(seq, report.filter("not valid").withColumn("message", F.lit("schema")), "XC0053"))
    assert code_of(x.value) == "XC0053"


@pytest.mark.parametrize(("command", "expected"), [("create", {"b": "2", "c": "3"}), ("update", {"a": "1", "b": "2", "c": "3"}), ("freshen", {"a": "1", "b": "2"}), ("delete", {"a": "1"})])
def test_zip_commands(spark, command, expected):
    old = spark.createDataFrame([("z", "a", b"1"), ("z", "b", b"1")], "path string, name string, content binary")
    new = spark.createDataFrame([("z", "b", b"2"), ("z", "c", b"3")], "path string, name string, content binary")
    assert {r.name: bytes(r.content).decode() for r in files.zip_update(old, new, command).collect()} == expected


def test_unknown_zip_command(spark):
    with pytest.raises(PipelineError, match="XC0999"):
        files.zip_update(empty(spark), empty(spark), "shred")


def test_pipelines_call_pipelines(spark):
    """A pipeline that calls itself, as often as its option says."""

    def wrapped(depth):
        p = Pipeline()
        p.step("wrap", lambda source: source.withColumn("doc", F.concat(F.lit("<w>"), F.col("doc"), F.lit("</w>"))))
        return p.step("again", call(wrapped(depth - 1))) if depth > 1 else p

    assert docs(wrapped(3).run(source=inline(spark, "<a/>"))["again"]) == ["<w><w><w><a/></w></w></w>"]
    inner = Pipeline(required=("name",))
    with pytest.raises(PipelineError, match="XS0018"):
        Pipeline().step("a", lambda source: source).step("b", call(inner))
