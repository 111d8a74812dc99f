"""Port selects, cardinality, JSON of any form, properties, arguments and rounds without caps."""

import pytest
from pyspark.sql import functions as F
from test_steps import docs

from seqloom.functions.errors import code_of
from seqloom.operators import content as C
from seqloom.operators import match as M
from seqloom.operators import rewrite as R
from seqloom.operators import sequence as S
from seqloom.sources import files
from seqloom.sources.files import inline
from seqloom.sources.xml import parse, serialize


def test_input_select(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 2)
    seq = inline(spark, "<d><p>1</p><q/><p>2</p></d>", "<d/>", "<d><r><p>3<p>4</p></p></r></d>", "<p>5</p>")
    assert docs(S.input_select(seq, M.element("p"))) == ["<p>1</p>", "<p>2</p>", "<p>3<p>4</p></p>", "<p>4</p>", "<p>5</p>"]
    assert [r.pos for r in S.input_select(seq, M.element("p")).orderBy("pos").collect()] == [0, 1, 2, 3, 4]
    assert docs(S.input_select(seq, M.element("none"))) == []


def test_rows_without_a_place(spark):
    rows = spark.createDataFrame([(0, None, "n"), (0, 5, "a"), (0, 70_000, "b"), (0, -3, "c")], "iter long, pos long, k string")
    assert {r.k: (r.position, r["last"]) for r in S.with_position(rows, last=True).collect()} == {"n": (1, 4), "c": (2, 4), "a": (3, 4), "b": (4, 4)}


def test_load_orders_by_path(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"f{k:02d}.xml").write_text(f"<d{k}/>")
    (tmp_path / "other.txt").write_text("x")
    got = files.load(spark, str(tmp_path), mask=r"f\d+\.xml").orderBy("pos").collect()
    assert [(r.pos, r.doc) for r in got] == [(k, f"<d{k}/>") for k in range(30)]


def test_port_cardinality(spark):
    seq = inline(spark, "<a/>", "<b/>")
    each = seq.withColumn("iter", F.col("pos"))
    assert docs(S.check_cardinality(each)) == ["<a/>", "<b/>"]
    for bad, iterations, code in ((seq, None, "XD0007"), (each, spark.range(3).select(F.col("id").alias("iter")), "XD0006")):
        with pytest.raises(Exception) as x:
            S.check_cardinality(bad, iterations, code).collect()
        assert code_of(x.value) == code


def test_json_documents(spark):
    rows = spark.createDataFrame([('{"a": [1, 2.50, {"b": null}], "2 x": "<&", "t": true}',), ("[]",), ('"s"',), ("{",), (None,)], "j string")
    assert [r[0] for r in rows.select(C.json_document(F.col("j"))).collect()] == [
        '<json type="object"><a type="array"><item type="number">1</item><item type="number">2.50</item><item type="object"><b type="null"></b></item></a><pair name="2 x" type="string">&lt;&amp;</pair><t type="boolean">true</t></json>',
        '<json type="array"></json>', '<json type="string">s</json>', None, None,
    ]


def test_properties(spark, tmp_path):
    (tmp_path / "a.properties").write_text('# c\n! d\n\n a = b\nkey\\ with\\=signs:v\\u0041\\\n   more\nempty\npath=c:\\\\x\\ty "q"\n')
    got = {r.name: r.value for r in files.java_properties(spark, str(tmp_path / "a.properties")).collect()}
    assert got == {"a": "b", "key with=signs": "vAmore", "empty": "", "path": 'c:\\x\ty "q"'}


def test_archives_without_content(spark):
    rows = spark.createDataFrame([("a", None)], "path string, content binary")
    assert files.unzip(rows).count() == 0


def test_large_arguments_and_many_rounds(spark):
    """An argument of more than 100,000 tokens, and more than 100 rounds."""
    large = parse(inline(spark, "<x>" + "<y/>" * 50_001 + "</x>"))
    out = docs(serialize(R.insert(parse(inline(spark, "<d><p/></d>")), M.element("p"), large, "after")))
    assert out[0].count("<y>") == 50_001 and out[0].startswith("<d><p></p><x>")
    assert docs(serialize(R.replace(parse(inline(spark, "<d><p/></d>")), M.element("p"), parse(inline(spark, "<x a='1'/>"))))) == ['<d><x a="1"></x></d>']


def test_viewports_of_several_documents(spark):
    seq = inline(spark, "<d><p>1</p><p>2</p></d>", "<d><p>3</p></d>").unionByName(inline(spark, "<d><p>4</p></d>").withColumn("iter", F.lit(1).cast("bigint")))
    out = R.viewport(parse(seq), M.element("p"), lambda t: R.rename(t, M.element("p"), "q"))
    assert docs(serialize(out)) == ["<d><q>1</q><q>2</q></d>", "<d><q>3</q></d>", "<d><q>4</q></d>"]


def test_template_documents(spark):
    one = lambda doc: docs(serialize(C.template_document(parse(inline(spark, doc)), {"a": F.lit("x<&"), "b": F.lit(None)})))
    assert one('<d q="{a}{{" ><!--{ a }--><?t {b}.?>{a}}}{b}</d>') == ['<d q="x&lt;&amp;{"><!--x<&--><?t .?>x&lt;&amp;}</d>']
    for bad, code in (("<d>{</d>", "XC0067"), ("<d>}</d>", "XC0067"), ("<d>{c}</d>", "XC0067"), ("<d q='{'/>", "XC0068"), ("<d><!--{c}--></d>", "XC0068"), ("<d><?t }?></d>", "XC0068")):
        with pytest.raises(Exception) as x:
            one(bad)
        assert code_of(x.value) == code
