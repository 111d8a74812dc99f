"""More registered queries: steps on values, archives, pointers, parameters, and pipelines that call pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import uris
from seqloom.operators import content as C
from seqloom.operators import match as M
from seqloom.operators import rewrite as R
from seqloom.operators import sequence as S
from seqloom.plans.pipeline import Pipeline, call, option
from seqloom.plans.queries import NARROW, _table, events, opens, orders, parts, query
from seqloom.sources import files
from seqloom.sources.bridge import attributes_of, element, to_seq
from seqloom.sources.xml import WRITTEN, XML_NS, parse, serialize


@query("SELECT p_partkey AS id, 'http://example.org/parts/list.xml' AS base FROM part")
def add_xml_base(spark, sf_dir):
    tokens = R.add_xml_base(parse(parts(spark, sf_dir), only=(*WRITTEN, "id", "ancestors")))
    return parse(serialize(tokens), only=("kind", "path", "attrs"), kinds=("open",)).filter(M.element("part") & (F.col("kind") == "open")).select(F.col("pos").alias("id"), M.attr("base", XML_NS).alias("base"))


@query("SELECT p_partkey AS id, 'http://example.org/' || p_size AS base FROM part")
def set_base_uri(spark, sf_dir):
    seq = parts(spark, sf_dir)
    size = F.regexp_extract("doc", 'size="([^"]*)"', 1)
    return R.set_base_uri(seq, F.concat(F.lit("http://example.org/"), size)).select(F.col("pos").alias("id"), F.col("base_uri").alias("base"))


@query("SELECT p_partkey AS id, p_brand AS brand FROM part")
def namespace_delete(spark, sf_dir):
    doc = parts(spark, sf_dir).withColumn("doc", F.regexp_replace("doc", "^<part ", '<part xmlns="urn:a" '))
    tokens = parse(serialize(R.namespace_delete(parse(doc), ["urn:a"])))
    return attributes_of(tokens, M.element("part", ns=""), b="brand").select(F.col("pos").alias("id"), F.col("b").alias("brand"))


@query("SELECT o_orderkey AS id, CASE WHEN count(l_orderkey) > 0 THEN count(l_orderkey) + 1 ELSE 0 END AS breaks FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def pretty_print(spark, sf_dir):
    """pretty-print: each line of an order, and its end, on a line of its own."""
    seq = serialize(R.pretty_print(parse(orders(spark, sf_dir), only=(*WRITTEN, "parent", "ancestors"))))
    return seq.select(F.col("pos").alias("id"), (F.length("doc") - F.length(F.replace("doc", F.lit("\n"), F.lit("")))).cast("bigint").alias("breaks"))


@query("SELECT p_partkey AS id, p_size::VARCHAR AS extent, 3::BIGINT AS attributes FROM part")
def rename_and_delete_attributes(spark, sf_dir):
    tokens = R.rename_attributes(parse(parts(spark, sf_dir)), M.element("part"), lambda a: a["local"] == "size", "extent")
    tokens = R.delete_attributes(tokens, M.element("part"), lambda a: a["local"] == "brand")
    found = tokens.filter(M.element("part") & (F.col("kind") == "open"))
    return found.select(F.col("pos").alias("id"), M.attr("extent").alias("extent"), F.size("attrs").cast("bigint").alias("attributes"))


@query("SELECT event_id AS id, replace(props, ' ', '') AS json FROM events")
def json_round_trip(spark, sf_dir):
    """JSON to XML and back."""
    seq = to_seq(_table(spark, sf_dir, "events"), "event_id", C.json_to_xml(F.col("props"), "k bigint"))
    return C.json_of(parse(seq)).select(F.col("pos").alias("id"), "json")


@query(r"""SELECT doc_id AS id, coalesce(array_to_string(list_transform(string_split(t, chr(10))[2:3], lambda x: x || chr(10)), ''), '') AS second_and_third, substr(t || chr(10), 6, 15) AS some_chars
FROM (SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\z', '') AS t FROM documents)""")
def text_pointers(spark, sf_dir):
    """Pointers into plain text: lines 1 to 3 and characters 5 to 20, counted from 0."""
    t = _table(spark, sf_dir, "documents")
    return t.select(F.col("doc_id").alias("id"), C.text_range(F.col("text"), F.lit("line=1,3")).alias("second_and_third"), C.text_range(F.col("text"), F.lit("char=5,20")).alias("some_chars"))


@query("SELECT n_nationkey::BIGINT AS id, r_name || chr(10) AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def xinclude_text(spark, sf_dir):
    """xinclude with parse="text": the second line of a text that belongs to the nation's region, taken as text."""
    href = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".txt"))
    doc = F.concat(F.lit('<n><xi:include parse="text" href="'), href, F.lit('" xpointer="text(line=1,2)"/></n>'))
    uri = F.concat(F.lit("http://example.org/r"), F.col("r_regionkey").cast("string"), F.lit(".txt"))
    resources = _table(spark, sf_dir, "region").select(uri.alias("uri"), F.concat(F.lit("<first> & only\n"), F.col("r_name"), F.lit("\nlast")).alias("doc"))
    seq = C.xinclude(to_seq(_table(spark, sf_dir, "nation"), "n_nationkey", doc, F.lit("http://example.org/nations")), resources)
    return R.text_of(parse(seq), M.element("n")).select(F.col("pos").alias("id"), "text")


@query("SELECT doc_id AS id, 'text' AS name, strlen(text)::BIGINT AS size FROM documents")
def zip_round_trip(spark, sf_dir):
    """zip, then unzip: an archive for each document."""
    t = _table(spark, sf_dir, "documents")
    archives = files.zip_entries(t.select(F.col("doc_id").cast("string").alias("path"), F.lit("text").alias("name"), F.col("text").cast("binary").alias("content")))
    return files.unzip(archives).select(F.col("path").cast("bigint").alias("id"), "name", "size")


@query("SELECT p_partkey AS id, 'brand' AS name, 'new' AS content FROM part UNION ALL SELECT p_partkey, 'name', p_name FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part")
def zip_update(spark, sf_dir):
    """Archives of two entries, one replaced and one added by update."""
    t = _table(spark, sf_dir, "part").withColumn("path", F.col("p_partkey").cast("string"))
    entry = lambda name, c: t.select("path", F.lit(name).alias("name"), c.cast("binary").alias("content"))
    old = files.unzip(files.zip_entries(entry("brand", F.col("p_brand")).unionByName(entry("name", F.col("p_name")))))
    new = entry("brand", F.lit("new")).unionByName(entry("type", F.col("p_type")))
    return files.zip_update(old, new).select(F.col("path").cast("bigint").alias("id"), "name", F.decode("content", "UTF-8").alias("content"))


@query("SELECT count(*) AS result FROM part")
def named_collection(spark, sf_dir):
    uri = f"http://example.org/parts?{sf_dir}"
    files.register_collection(parts(spark, sf_dir), uri)
    return S.count(files.collection(spark, uri))


@query("SELECT * FROM (VALUES ('limit', '10'), ('name', 'a<b')) AS t(name, value)")
def parameters(spark, sf_dir):
    """parameters: a c:param-set document, read back."""
    seq = files.inline(spark, C.param_set({"name": "a<b", "limit": "10"}))
    return attributes_of(parse(seq), F.col("local") == "param", name="name", value="value").select("name", "value")


@query("SELECT p_partkey AS id, 'type=' || replace(p_type, ' ', '+') AS form FROM part")
def form_encode_step(spark, sf_dir):
    """www-form-urlencode: pairs in place of the matched text."""
    pairs = F.array(F.struct(F.lit("type").alias("name"), F.col("_type").alias("value")))
    tokens = parse(parts(spark, sf_dir))
    kinds = opens(tokens, "part", _type="type").select("iter", "pos", "_type")
    done = R.put_value(tokens.join(kinds, ["iter", "pos"]), M.text(), uris.form_encode_pairs(pairs)).drop("_type")
    return R.text_of(done, M.element("part")).select(F.col("pos").alias("id"), F.col("text").alias("form"))


@query("SELECT count(*) AS n FROM region")
def wrap_sequence_whole(spark, sf_dir):
    """wrap-sequence without a key: one document of the sequence."""
    t = _table(spark, sf_dir, "region")
    wrapped = parse(S.wrap_sequence(to_seq(t, "r_regionkey", element("region", F.col("r_name"))), "regions"))
    return opens(wrapped, "regions/region").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS result FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def pipeline_call(spark, sf_dir):
    """A pipeline that calls another one with an option."""
    inner = Pipeline(required=("flag",))
    inner.step("tokens", lambda source: parse(source, only=(*NARROW, "attrs"), kinds=("open",)))
    inner.step("lines", lambda source, flag: R.select(source, M.element("line") & (M.attr("flag") == flag)), {"flag": option("flag")})
    outer = Pipeline()
    outer.step("lines", call(inner), {"flag": "R"})
    outer.step("roots", lambda source: source.filter((F.col("kind") == "open") & (F.size("ancestors") == 0)))
    outer.step("n", lambda source: S.count(source))
    return outer.run(source=orders(spark, sf_dir))["n"]


@query("SELECT event_id AS id, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS outcome FROM events")
def pipeline_two_ports(spark, sf_dir):
    """A step with two outputs, each read by a step of its own, and both as one sequence again."""
    p = Pipeline()
    p.step("valued", lambda source: source.withColumn("v", F.regexp_extract("doc", 'value="([^"]*)"', 1).cast("double")))
    p.step("split", lambda source: dict(zip(("matched", "rest"), S.split_sequence(source, F.col("v") < 50), strict=True)))
    p.step("low", lambda source: source.withColumn("outcome", F.lit("low")), source="split.matched")
    p.step("high", lambda source: source.withColumn("outcome", F.lit("high")), source="split.rest")
    p.step("both", lambda a, b: a.unionByName(b), a="low", b="high")
    return p.run(source=events(spark, sf_dir))["both"].select(F.col("pos").alias("id"), "outcome")


@query()
def directory_list(spark, sf_dir):
    """directory-list: names and sizes of the tables' files (a folder's listing, not in SQL)."""
    return files.directory_list(spark, sf_dir, include=r".*\.parquet").select("name", "size")
