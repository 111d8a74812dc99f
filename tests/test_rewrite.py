import pytest
from pyspark.sql import functions as F

from seqloom.functions.errors import PipelineError, code_of
from seqloom.operators import match as M
from seqloom.operators import rewrite as R
from seqloom.sources.files import inline
from seqloom.sources.xml import canonical, parse, serialize


def docs(tokens):
    return [r.doc for r in serialize(tokens).orderBy("iter", "pos").collect()]


def one(spark, step, *source):
    return docs(step(parse(inline(spark, *source, base_uri="http://h/a/b.xml"))))


DOC = '<doc><div><p a="1">x</p><p>y</p></div><q>z</q></doc>'


def test_round_trip(spark):
    text = '<d xmlns:e="urn:e" e:a="1 &lt; &amp; &quot;" b="2"><e:x>t &lt; u</e:x><!--c--><?t d?></d>'
    once = one(spark, lambda t: t, text)
    assert once == one(spark, lambda t: t, once[0])
    assert 't &lt; u</e:x><!--c--><?t d?></d>' in once[0] and 'e:a="1 &lt; &amp; &quot;" b="2"' in once[0]


def test_not_well_formed(spark):
    with pytest.raises(Exception) as x:
        parse(inline(spark, "<a>")).collect()
    assert code_of(x.value) == "XD0011"


@pytest.mark.parametrize(
    ("step", "expected"),
    [
        (lambda t: R.delete(t, M.element("p")), "<doc><div></div><q>z</q></doc>"),
        (lambda t: R.delete(t, M.element("div") | M.element("p")), "<doc><q>z</q></doc>"),
        (lambda t: R.delete(t, M.text()), '<doc><div><p a="1"></p><p></p></div><q></q></doc>'),
        (lambda t: R.rename(t, M.element("div/p"), "para"), '<doc><div><para a="1">x</para><para>y</para></div><q>z</q></doc>'),
        (lambda t: R.rename_attributes(t, M.element("p"), lambda a: a["local"] == "a", "b"), '<doc><div><p b="1">x</p><p>y</p></div><q>z</q></doc>'),
        (lambda t: R.add_attribute(t, M.element("p"), "a", "9"), '<doc><div><p a="9">x</p><p a="9">y</p></div><q>z</q></doc>'),
        (lambda t: R.set_attributes(t, M.element("q"), {"u": "1", "v": "2"}), '<doc><div><p a="1">x</p><p>y</p></div><q u="1" v="2">z</q></doc>'),
        (lambda t: R.label_elements(t, M.element("p"), "n"), '<doc><div><p a="1" n="_1">x</p><p n="_2">y</p></div><q>z</q></doc>'),
        (lambda t: R.string_replace(t, M.element("div"), "s"), "<doc>s<q>z</q></doc>"),
        (lambda t: R.unwrap(t, M.element("div")), '<doc><p a="1">x</p><p>y</p><q>z</q></doc>'),
        (lambda t: R.wrap(t, M.element("p"), "w"), '<doc><div><w><p a="1">x</p></w><w><p>y</p></w></div><q>z</q></doc>'),
        (lambda t: R.wrap(t, M.element("doc"), "w"), '<w><doc><div><p a="1">x</p><p>y</p></div><q>z</q></doc></w>'),
        (lambda t: R.wrap_adjacent(t, M.element("p"), "w", F.col("local")), '<doc><div><w><p a="1">x</p><p>y</p></w></div><q>z</q></doc>'),
        (lambda t: R.put_value(t, M.element("p") | M.element("q"), F.lit("h")), "<doc><div>hh</div>h</doc>"),
        (lambda t: R.hash_step(t, M.element("q"), "XML Processing Model Working Group", "md"), '<doc><div><p a="1">x</p><p>y</p></div>e75c25ded7f006c768653b27b29d39fa</doc>'),
        (lambda t: R.viewport(t, M.element("p"), lambda b: R.rename(b, M.element("p"), "v")), '<doc><div><v a="1">x</v><v>y</v></div><q>z</q></doc>'),
        (lambda t: R.viewport(t, M.element("p"), lambda b: b.filter(F.lit(False))), "<doc><div></div><q>z</q></doc>"),
        (lambda t: R.add_xml_base(t), '<doc xml:base="http://h/a/b.xml"><div><p a="1">x</p><p>y</p></div><q>z</q></doc>'),
        (lambda t: R.make_absolute_uris(t, M.element("q")), '<doc><div><p a="1">x</p><p>y</p></div><q>http://h/a/z</q></doc>'),
        (lambda t: R.make_absolute_attributes(t, M.element("p"), "a", "http://k/"), '<doc><div><p a="http://k/1">x</p><p>y</p></div><q>z</q></doc>'),
        (lambda t: R.pretty_print(t), '<doc>\n  <div>\n    <p a="1">x</p>\n    <p>y</p>\n  </div>\n  <q>z</q>\n</doc>'),
    ],
)
def test_step(spark, step, expected):
    assert one(spark, step, DOC) == [expected]


def test_insert_and_replace(spark):
    new = parse(inline(spark, "<i>k</i>"))
    base = "<d><p>x</p></d>"
    at = {"first-child": "<d><p><i>k</i>x</p></d>", "last-child": "<d><p>x<i>k</i></p></d>", "before": "<d><i>k</i><p>x</p></d>", "after": "<d><p>x</p><i>k</i></d>"}
    for place, expected in at.items():
        assert one(spark, lambda t, place=place: R.insert(t, M.element("p"), new, place), base) == [expected]
    assert one(spark, lambda t: R.replace(t, M.element("p"), new), base) == ["<d><i>k</i></d>"]


def test_select(spark):
    got = R.select(parse(inline(spark, DOC)), M.element("p"))
    texts = [r.doc for r in serialize(got.withColumn("iter", F.col("ord_in").cast("bigint"))).orderBy("iter").collect()]
    assert texts == ['<p a="1">x</p>', "<p>y</p>"]


def test_namespaces(spark):
    d = '<d xmlns="urn:a"><e b="1"></e></d>'
    assert one(spark, lambda t: R.namespace_rename(t, "urn:a", "urn:b"), d) == ['<d xmlns="urn:b"><e xmlns="urn:b" b="1"></e></d>']
    assert one(spark, lambda t: R.namespace_rename(t, "urn:a", ""), d) == ['<d><e b="1"></e></d>']
    assert one(spark, lambda t: R.namespace_delete(t, ["urn:a"]), d) == ['<d><e b="1"></e></d>']
    assert one(spark, lambda t: R.add_attribute(t, M.element("e"), ("urn:c", "c", "x"), "1"), d) == ['<d xmlns="urn:a"><e xmlns="urn:a" xmlns:c="urn:c" b="1" c:x="1"></e></d>']
    assert one(spark, lambda t: R.rename(t, M.element("e", ns="urn:a"), "f"), d) == ['<d xmlns="urn:a"><f xmlns="" b="1"></f></d>']


def test_uuid_is_one_a_document(spark):
    out = one(spark, lambda t: R.uuid(t, M.element("p")), DOC, DOC)
    found = [d.split("<div>")[1].split("</div>")[0] for d in out]
    assert all(len(f) == 72 and f[:36] == f[36:] for f in found) and found[0] != found[1]


@pytest.mark.parametrize(
    ("step", "code"),
    [
        (lambda t: R.rename(t, M.text(), "x"), "XC0023"),
        (lambda t: R.unwrap(t, M.text()), "XC0023"),
        (lambda t: R.add_attribute(t, M.comment() | M.text(), "x", "1"), "XC0023"),
        (lambda t: R.viewport(t, M.text(), lambda b: b), "XD0010"),
        (lambda t: R.delete(t, M.element("/doc")), "XC0012"),
    ],
)
def test_errors_by_kind(spark, step, code):
    with pytest.raises(Exception) as x:
        step(parse(inline(spark, DOC))).collect()
    assert code_of(x.value) == code


@pytest.mark.parametrize(
    ("make", "code"),
    [
        (lambda t: R.add_attribute(t, M.element("p"), ("", "p", "x"), "1"), "XD0034"),
        (lambda t: R.add_attribute(t, M.element("p"), "xmlns", "1"), "XC0059"),
        (lambda t: R.namespace_rename(t, R.XML_NS, "urn:x"), "XC0014"),
        (lambda t: R.uuid(t, M.element("p"), 3), "XC0060"),
        (lambda t: R.hash_step(t, M.element("p"), "v", "none"), "XC0036"),
        (lambda t: R.add_xml_base(t, all=True, relative=True), "XC0058"),
    ],
)
def test_errors_of_options(spark, make, code):
    with pytest.raises(PipelineError) as x:
        make(parse(inline(spark, DOC)))
    assert x.value.code == code


def test_deep_equal(spark):
    a = '<d a="1" b="2">x<e></e></d>'
    b = "<d b='2' a='1'>x<!-- c --><e/></d>"
    c = '<d a="1" b="2"> x<e></e></d>'
    got = [r.digest for r in canonical(parse(inline(spark, a, b, c))).orderBy("pos").collect()]
    assert got[0] == got[1] != got[2]


def test_wrap_then_unwrap_is_identity(spark):
    out = one(spark, lambda t: R.unwrap(R.wrap(t, M.element("p"), "w"), M.element("w")), DOC)
    assert out == [DOC]
