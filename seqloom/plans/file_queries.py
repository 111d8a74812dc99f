"""Registered queries of sources, sinks, file utilities, functions and further constructs.

Queries that read files first write them, by Spark, in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import pipeline as P
from seqloom.functions.errors import PipelineError, code_of
from seqloom.operators import content as C
from seqloom.operators import match as M
from seqloom.operators import rewrite as R
from seqloom.operators import sequence as S
from seqloom.plans.pipeline import Pipeline
from seqloom.plans.queries import NARROW, _table, events, opens, orders, parts, query
from seqloom.plans.scratch import scratch_dir
from seqloom.sources import files
from seqloom.sources.bridge import around, element, to_seq
from seqloom.sources.xml import WRITTEN, XML_NS, output, parse, serialize, texts
from seqloom.streaming import watch

XI = ' xmlns:i="http://www.w3.org/2001/XInclude"'


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _nations(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a document for each nation: <nation id=>name</nation>, one file each."""
    path = _folder(spark, "nations")
    t = _table(spark, sf_dir, "nation")
    t.select(F.col("n_nationkey").alias("k"), element("nation", F.col("n_name"), id=F.col("n_nationkey")).alias("doc")).repartition("k").write.partitionBy("k").text(path)
    return path


def _regions(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a folder k=... for each region, with a text file of its name."""
    path = _folder(spark, "regions")
    _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name").write.partitionBy("k").text(path)
    return path


def _listing(spark: SparkSession, path: str) -> DataFrame:
    return files.directory_list(spark, path, include="k=.*").select("name")


REGION_FOLDERS = "SELECT 'k=' || r_regionkey AS name FROM region"


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def load_documents(spark, sf_dir):
    tokens = parse(files.load(spark, _nations(spark, sf_dir), mask=r"part-.*\.txt"))
    return opens(tokens, "nation", key="id").join(R.text_of(tokens, M.element("nation")), ["iter", "pos", "id"]).select(F.col("key").alias("id"), F.col("text").alias("name"))


@query("SELECT r_name || chr(10) AS text, 'text/plain' AS type FROM region")
def data_documents(spark, sf_dir):
    """data: files as text in c:data."""
    tokens = parse(files.data(spark, f"{_regions(spark, sf_dir)}/*", "text/plain"))
    kinds = tokens.filter((F.col("local") == "data") & (F.col("kind") == "open")).select("iter", "pos", M.attr("content-type").alias("type"))
    return R.text_of(tokens, F.col("local") == "data").join(kinds, ["iter", "pos"]).select("text", "type")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer")
def store_documents(spark, sf_dir):
    path = _folder(spark, "store")
    seq = to_seq(_table(spark, sf_dir, "customer"), "c_custkey", element("c", F.col("c_name"), id=F.col("c_custkey")))
    files.store(seq, path, compression="gzip", allow_effects=True)
    back = spark.read.text(path).select(F.regexp_extract("value", 'id="([^"]*)"', 1).cast("bigint").alias("n"), "value")
    tokens = parse(to_seq(back, "n", F.col("value")))
    return opens(tokens, "c", key="id").join(R.text_of(tokens, M.element("c")), ["iter", "pos", "id"]).select(F.col("key").alias("id"), F.col("text").alias("name"))


@query("SELECT r_regionkey::VARCHAR AS id, strlen(r_name)::BIGINT + 1 AS size FROM region")
def uri_info(spark, sf_dir):
    return files.file_info(spark, f"{_regions(spark, sf_dir)}/*").select(F.regexp_extract("path", "k=([0-9]+)", 1).alias("id"), "size")


@query(REGION_FOLDERS)
def directory_names(spark, sf_dir):
    return _listing(spark, _regions(spark, sf_dir))


@query(REGION_FOLDERS)
def file_copy(spark, sf_dir):
    to = _folder(spark, "copied")
    files.copy(spark, _regions(spark, sf_dir), to, allow_effects=True)
    return _listing(spark, to)


@query(f"{REGION_FOLDERS} UNION ALL SELECT 'the source is gone'")
def file_move(spark, sf_dir):
    source, to = _regions(spark, sf_dir), _folder(spark, "moved")
    files.move(spark, source, to, allow_effects=True)
    try:
        left = _listing(spark, source)
    except PipelineError as x:
        left = spark.createDataFrame([("the source is gone" if x.code == "XC0017" else x.code,)], "name string")
    return _listing(spark, to).unionByName(left)


@query(f"{REGION_FOLDERS} WHERE r_regionkey <> 0")
def file_delete(spark, sf_dir):
    path = _regions(spark, sf_dir)
    files.delete(spark, f"{path}/k=0", recursive=True, allow_effects=True)
    return _listing(spark, path)


@query(f"{REGION_FOLDERS} UNION ALL SELECT 'k=new'")
def file_mkdir(spark, sf_dir):
    path = _regions(spark, sf_dir)
    files.mkdir(spark, f"{path}/k=new", allow_effects=True)
    return _listing(spark, path)


@query(f"{REGION_FOLDERS} UNION ALL SELECT 'k=touched'")
def file_touch(spark, sf_dir):
    path = _regions(spark, sf_dir)
    files.touch(spark, f"{path}/k=touched", allow_effects=True)
    return _listing(spark, path)


@query("SELECT 1::BIGINT AS made, 0::BIGINT AS size")
def file_tempfile(spark, sf_dir):
    path = _folder(spark, "temp")
    files.mkdir(spark, path, allow_effects=True)
    files.tempfile(spark, path, allow_effects=True)
    return files.directory_list(spark, path, include=r"temp.*\.xml").agg(F.count(F.lit(1)).alias("made"), F.sum("size").alias("size"))


@query("SELECT 'FU01' AS missing, 'FU02' AS not_empty, 'XD0021' AS not_allowed")
def file_errors(spark, sf_dir):
    path = _regions(spark, sf_dir)
    found = []
    for act in (lambda: files.copy(spark, f"{path}/none", path, True), lambda: files.delete(spark, path, False, True), lambda: files.mkdir(spark, path)):
        try:
            act()
        except PipelineError as x:
            found.append(x.code)
    return spark.createDataFrame([tuple(found)], "missing string, not_empty string, not_allowed string")


@query("SELECT 'region.' || r_regionkey AS name, r_name || ' = ' || r_name || ' é' AS value FROM region")
def java_properties(spark, sf_dir):
    """java-properties: comments, a line that goes on, and escapes."""
    path = _folder(spark, "properties")
    t = _table(spark, sf_dir, "region")
    line = F.concat(F.lit("# a comment\n\nregion."), F.col("r_regionkey").cast("string"), F.lit(": "), F.col("r_name"), F.lit(" \\= \\\n    "), F.col("r_name"), F.lit(" \\u00e9"))
    t.select(line).write.text(path)
    return files.java_properties(spark, path)


@query("SELECT event_id AS id FROM events")
def message_passes(spark, sf_dir):
    return C.message(S.identity(events(spark, sf_dir)), "events pass", log=lambda _: None).select(F.col("pos").alias("id"))


@query("SELECT 'my:failed' AS code, count(*) AS sunk FROM part")
def error_and_sink(spark, sf_dir):
    """error: its code reaches the caller; sink reads all and gives nothing."""
    S.sink(parts(spark, sf_dir))
    try:
        S.sink(C.error(parts(spark, sf_dir), "my:failed"))
        code = None
    except Exception as x:  # noqa: BLE001 - Spark wraps the error
        code = code_of(x)
    return S.count(parts(spark, sf_dir)).select(F.lit(code).alias("code"), F.col("result").alias("sunk"))


@query("SELECT (SELECT count(*) FROM part) AS passed, '25 reports' AS first_line FROM region LIMIT 1")
def report_errors(spark, sf_dir):
    told = []
    nations = to_seq(_table(spark, sf_dir, "nation"), "n_nationkey", element("n", F.col("n_name")))
    passed = C.report_errors(parts(spark, sf_dir), nations, log=told.append)
    return S.count(passed).select(F.col("result").alias("passed"), F.lit(told[0]).alias("first_line"))


@query("SELECT 0::BIGINT AS result")
def empty_sequence(spark, sf_dir):
    return S.count(files.empty(spark))


@query("SELECT p_partkey AS id, true AS well_formed FROM part")
def uuid_shape(spark, sf_dir):
    tokens = R.uuid(parse(parts(spark, sf_dir)), M.text())
    return R.text_of(tokens, M.element("part")).select(F.col("pos").alias("id"), F.col("text").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("well_formed"))


@query("SELECT p_partkey AS id, p_size <= 25 AS valid FROM part")
def schema_valid(spark, sf_dir):
    """validate-with-xml-schema: a schema that lets sizes up to 25 pass; Spark sends its file to the executors."""
    import tempfile

    text = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="part"><xs:complexType><xs:simpleContent><xs:extension base="xs:string"><xs:attribute name="size" use="required"><xs:simpleType><xs:restriction base="xs:integer"><xs:maxInclusive value="25"/></xs:restriction></xs:simpleType></xs:attribute><xs:anyAttribute processContents="skip"/></xs:extension></xs:simpleContent></xs:complexType></xs:element></xs:schema>'
    name = f"part-{uuid.uuid4().hex}.xsd"
    with open(f"{tempfile.mkdtemp()}/{name}", "w") as f:
        f.write(text)
    spark.sparkContext.addFile(f.name)
    seq = to_seq(_table(spark, sf_dir, "part"), "p_partkey", element("part", F.col("p_name"), size=F.col("p_size")))
    return C.schema_valid(seq, name).select(F.col("pos").alias("id"), "valid")


@query("SELECT * FROM (VALUES ('cwd is a file URI', true), ('environment has PATH', true), ('os names itself', true), ('p:count is a step', true), ('p:check is a step', false), ('version 1.0', true), ('version 2.0', false), ('xpath 2.0', true), ('xpath 3.1', false), ('a has a value', true), ('b has a value', false), ('p:version is 1.0', true)) AS t(name, value)")
def processor_functions(spark, sf_dir):
    """The functions that tell of the processor and of options."""
    env = P.environment(spark).filter("name = 'PATH'").count() == 1
    os_name = P.os_info(spark).filter("name = 'os-name' and value <> ''").count() == 1
    told = [("cwd is a file URI", P.cwd().startswith("file:///")), ("environment has PATH", env), ("os names itself", os_name), ("p:count is a step", P.step_available("p:count")), ("p:check is a step", P.step_available("p:check")), ("version 1.0", P.version_available(1.0)), ("version 2.0", P.version_available(2.0)), ("xpath 2.0", P.xpath_version_available(2.0)), ("xpath 3.1", P.xpath_version_available(3.1)), ("a has a value", P.value_available("a", {"a": 1, "b": None})), ("b has a value", P.value_available("b", {"a": 1, "b": None})), ("p:version is 1.0", P.system_property("p:version") == "1.0")]
    return spark.createDataFrame(told, "name string, value boolean")


@query("SELECT n_nationkey::VARCHAR AS id FROM nation")
def wait_for_update(spark, sf_dir):
    """wait-for-update: files of a folder as a stream, each document once."""
    out = _folder(spark, "watched")
    stream = watch.watch(spark, f"{_nations(spark, sf_dir)}/*", pattern="*.txt", max_files=10)
    watch.run(stream, [S.identity], out, _folder(spark, "watch-state"), once=True).awaitTermination()
    return opens(parse(spark.read.parquet(out).drop("batch")), "nation", key="id").select(F.col("key").alias("id"))


@query("SELECT p_partkey AS id, p_size > 10 AS large FROM part")
def pipeline_after(spark, sf_dir):
    """depends-on and group: a step that reads nothing of another but runs after it."""
    ran = []
    p = Pipeline()
    p.step("first", lambda source: ran.append("first") or source)
    p.step("second", lambda source: source.withColumn("large", F.regexp_extract("doc", 'size="([0-9]+)"', 1).cast("int") > (10 if ran == ["first"] else -1)), after=("first",), source="source")
    return p.run(source=parts(spark, sf_dir))["second"].select(F.col("pos").alias("id"), "large")


@query("SELECT 'in-scope' AS name, count(*)::VARCHAR AS value FROM region")
def in_scope_names(spark, sf_dir):
    scope = {"in-scope": _table(spark, sf_dir, "region").count()}
    tokens = parse(files.inline(spark, C.param_set(scope)))
    return tokens.filter((F.col("local") == "param") & (F.col("kind") == "open")).select(M.attr("name").alias("name"), M.attr("value").alias("value"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS place, l_suppkey AS supplier FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def input_select(spark, sf_dir):
    """A port's select: the lines of all orders as one sequence of documents."""
    lines = S.input_select(orders(spark, sf_dir), M.element("line"), only=("path",))
    return texts(lines, M.element("line"), only=("path",)).select(F.col("pos").alias("place"), F.col("text").cast("bigint").alias("supplier"))


@query("SELECT 'XD0007' AS several, count(*) AS singles FROM region")
def port_cardinality(spark, sf_dir):
    """A port that takes one document an iteration: one each passes, several are an error."""
    seq = to_seq(_table(spark, sf_dir, "region"), "r_regionkey", element("r", F.col("r_name")))
    try:
        S.sink(S.check_cardinality(seq))
        code = None
    except Exception as x:  # noqa: BLE001
        code = code_of(x)
    return S.count(S.check_cardinality(seq.withColumn("iter", F.col("pos")))).select(F.lit(code).alias("several"), F.col("result").alias("singles"))


@query("SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'XD0011' ELSE event_type END AS outcome FROM events")
def try_malformed(spark, sf_dir):
    """try/catch over documents of which every tenth is not well-formed."""
    seq = events(spark, sf_dir).withColumn("doc", F.when(F.col("pos") % 10 == 0, F.substring("doc", 1, 9)).otherwise(F.col("doc")))
    group = lambda t: opens(t, "event", outcome="type").select("iter", "pos", "outcome")
    return S.try_parsed(seq, group, lambda d: d.select("iter", "pos", F.col("code").alias("outcome"))).select(F.col("pos").alias("id"), "outcome")


@query("SELECT n_nationkey::BIGINT AS id, r_name AS region, 'http://example.org/r/' || n_regionkey AS base FROM nation JOIN region ON n_regionkey = r_regionkey")
def xinclude_nested(spark, sf_dir):
    """xinclude by another prefix and quote, over two levels of relative references, with fix-up of xml:base; a comment is no include."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    doc = F.concat(F.lit(f"<n{XI}><!-- <i:include href='none'/> --><i:include href='r/"), F.col("n_regionkey").cast("string"), F.lit("'/></n>"))
    uri = lambda place: F.concat(F.lit("http://example.org/"), F.lit(place), F.col("r_regionkey").cast("string"))
    outer = r.select(uri("r/").alias("uri"), F.concat(F.lit(f'<r{XI}><i:include href="names/'), F.col("r_regionkey").cast("string"), F.lit('" ></i:include></r>')).alias("doc"))
    inner = r.select(uri("r/names/").alias("uri"), element("name", F.col("r_name")).alias("doc"))
    tokens = parse(C.xinclude(to_seq(n, "n_nationkey", doc, F.lit("http://example.org/nations")), outer.unionByName(inner), fixup_xml_base=True))
    bases = tokens.filter(M.element("n/r") & (F.col("kind") == "open")).select("iter", "pos", M.attr("base", XML_NS).alias("base"))
    return R.text_of(tokens, M.element("r/name")).join(bases, ["iter", "pos"]).select(F.col("pos").alias("id"), F.col("text").alias("region"), "base")


@query("SELECT user_id % 10 AS iteration, count(*) AS n FROM events GROUP BY 1")
def wrap_sequence_by_iteration(spark, sf_dir):
    """wrap-sequence without a key in a loop: a document for each iteration."""
    t = _table(spark, sf_dir, "events")
    seq = t.select((F.col("user_id") % 10).alias("iter"), F.col("event_id").alias("pos"), F.lit(None).cast("string").alias("base_uri"), element("e", F.col("event_type")).alias("doc"))
    wrapped = parse(S.wrap_sequence(seq, "all"), only=("ord", "kind", "id", "path", "attrs"), kinds=("open",))
    return opens(wrapped, "all/e").groupBy("iter").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("iter", "iteration")


@query("SELECT p_partkey AS id, 'http://example.org/parts/list.xml' AS outer, p_size || '/x.xml' AS inner, 'y.xml' AS innermost FROM part")
def add_xml_base_nested(spark, sf_dir):
    """add-xml-base where the base changes, relative to the parent's."""
    t = _table(spark, sf_dir, "part")
    inner = F.concat(F.lit('<b xml:base="http://example.org/parts/'), F.col("p_size").cast("string"), F.lit('/x.xml"><c xml:base="y.xml"></c><d></d></b>'))
    seq = to_seq(t, "p_partkey", around("a", inner), F.lit("http://example.org/parts/list.xml"))
    tokens = R.add_xml_base(parse(seq, only=(*WRITTEN, "id", "ancestors")))
    back = parse(serialize(tokens), only=("kind", "local", "attrs"), kinds=("open",))
    base = lambda n: F.max(F.when(F.col("local") == n, M.attr("base", XML_NS)))
    return back.groupBy("pos").agg(base("a").alias("outer"), base("b").alias("inner"), base("c").alias("innermost")).withColumnRenamed("pos", "id")


@query("""SELECT p_partkey AS id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE part SYSTEM "part.dtd">' || chr(10) || '<part id="' || p_partkey || '"><![CDATA[' || p_name || ' & more]]></part>' AS doc FROM part""")
def serialization(spark, sf_dir):
    """serialization parameters: declaration, document type and CDATA sections."""
    seq = to_seq(_table(spark, sf_dir, "part"), "p_partkey", element("part", F.concat("p_name", F.lit(" & more")), id=F.col("p_partkey")))
    return output(parse(seq), omit_xml_declaration=False, doctype_system="part.dtd", cdata_section_elements=["part"]).select(F.col("pos").alias("id"), "doc")


@query("SELECT event_id AS id FROM events")
def log_port(spark, sf_dir):
    path = _folder(spark, "log")
    files.log_port(events(spark, sf_dir), path)
    return spark.read.parquet(path).select(F.col("pos").alias("id"))


@query("SELECT event_id AS id, event_type AS type, 2::BIGINT AS items, user_id AS inner FROM events")
def json_nested(spark, sf_dir):
    """JSON with arrays and nesting as a document: <json><type/><list><item/><item><user/></item></list></json>."""
    t = _table(spark, sf_dir, "events")
    value = F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", "list": [null, {"user": '), F.col("user_id").cast("string"), F.lit('}]}'))
    tokens = parse(to_seq(t, "event_id", C.json_document(value)), only=("kind", "path", "value"), kinds=("open", "text"))
    text = lambda name: F.max(F.when((F.col("kind") == "text") & F.col("path").endswith(name), F.col("value")))
    items = F.count(F.when((F.col("kind") == "open") & M.element("list/item"), 1))
    return tokens.groupBy("iter", "pos").agg(text("/type").alias("type"), items.alias("items"), text("/user").cast("bigint").alias("inner")).select(F.col("pos").alias("id"), "type", "items", "inner")


@query("SELECT r_name AS name FROM region")
def json_fallback(spark, sf_dir):
    """Files of JSON where documents are expected."""
    path = _folder(spark, "json")
    _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.to_json(F.struct(F.col("r_name").alias("name"))).alias("j")).write.partitionBy("k").text(path)
    return R.text_of(parse(files.read_json(spark, path)), M.element("name")).select(F.col("text").alias("name"))


@query("SELECT count(*) * 2 AS result FROM nation")
def registered_step(spark, sf_dir):
    """A step of the user's own, by name."""
    name = f"my:twice-{uuid.uuid4().hex}"
    P.register_step(name, lambda seq: S.concat(seq, seq))
    return S.count(P.step(name)(to_seq(_table(spark, sf_dir, "nation"), "n_nationkey", element("n"))))


@query("SELECT p_partkey AS id, p_size % 2 = 0 AS equal FROM part")
def compare_documents(spark, sf_dir):
    """compare: documents of odd sizes differ in a text; attributes in another order are equal."""
    t = _table(spark, sf_dir, "part")
    a = element("part", F.col("p_name"), a=F.col("p_size"), b=F.col("p_brand"))
    b = element("part", F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "").otherwise("!")), b=F.col("p_brand"), a=F.col("p_size"))
    return S.compare(to_seq(t, "p_partkey", a), to_seq(t, "p_partkey", b)).select(F.col("pos").alias("id"), "equal")


@query("""SELECT p_partkey AS id, '<p size="' || p_size || ' mm"><!-- ' || p_brand || ' --><?do ' || p_size || '?>' || p_name || ' {x}</p>' AS doc FROM part""")
def template_document(spark, sf_dir):
    """template: values in the attributes, comments, PIs and texts of a document."""
    t = _table(spark, sf_dir, "part")
    seq = to_seq(t, "p_partkey", F.lit('<p size="{s} mm"><!-- {b} --><?do {s}?>{n} {{x}}</p>'))
    # Spark knows the size of the keys that the documents are made of, not of their tokens, and would broadcast these.
    values = t.select(F.col("p_partkey").alias("pos"), "p_size", "p_brand", "p_name").hint("merge")
    tokens = parse(seq, only=WRITTEN).join(values, "pos")
    made = C.template_document(tokens, {"s": F.col("p_size"), "b": F.col("p_brand"), "n": F.col("p_name")})
    return serialize(made.drop("p_size", "p_brand", "p_name")).select(F.col("pos").alias("id"), "doc")
