"""Steps on values and content: templates, JSON, includes, validation, markup in text, parameters."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.errors import PipelineError, check, fail
from seqloom.functions.uris import resolve_uri
from seqloom.operators.match import attr
from seqloom.plans.scratch import materialize
from seqloom.sources.xml import TOKENS, _batch, escape_attribute, escape_text

#: HTML elements without content, and those that an opening tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def template(text: str, values: dict[str, Column]) -> Column:
    """A text with {name} replaced by columns; {{ and }} are braces. Unbalanced braces, or a name without a value: XC0067."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{|\}\}|\{([^{}]*)\}|[{}]", text):
        parts.append(F.lit(text[at : m.start()]))
        at = m.end()
        if m[0] in ("{{", "}}"):
            parts.append(F.lit(m[0][0]))
        elif m[1] is None or m[1].strip() not in values:
            raise PipelineError("XC0067", f"template: {m[0]!r} at {m.start()}")
        else:
            parts.append(F.coalesce(values[m[1].strip()].cast("string"), F.lit("")))
    return F.concat(*parts, F.lit(text[at:]))


def template_document(tokens: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The template step: {name} in the texts, attributes, comments and PIs of a template document, one for each row's values.

    values are columns of tokens (join them by iter and pos). In a text, a
    value stands as text; {{ and }} are braces. XC0067: a brace without its
    other, or an unknown name; XC0068: the same within an attribute, comment
    or PI. Which names there are is checked when a row is computed.
    """

    def filled(text: Column, code: str) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(r"(\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}])"), F.lit(1))

        def put(piece: Column) -> Column:
            name = F.trim(F.regexp_extract(piece, r"^\{([^{}]*)\}$", 1))
            out = F.when(piece.isin("{{", "}}"), F.substring(piece, 1, 1)).when(~piece.rlike(r"[{}]"), piece)
            for known, value in values.items():
                out = out.when(name == known, F.coalesce(value.cast("string"), F.lit("")))
            return out.otherwise(fail(code, "a brace without its other, or an unknown name"))

        return F.array_join(F.transform(pieces, put), "")

    attrs = F.transform("attrs", lambda a: a.withField("value", filled(a["value"], "XC0068")))
    value = F.when(F.col("kind") == "text", filled(F.col("value"), "XC0067")).when(F.col("kind").isin("comment", "pi"), filled(F.col("value"), "XC0068")).otherwise(F.col("value"))
    return tokens.withColumns({"value": value, "attrs": attrs})


class _Html(HTMLParser):
    """Tokens of an HTML document, with the end tags that HTML leaves out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.open: list[tuple[dict, dict[str, int]]] = []
        self.top: dict[str, int] = {}

    def put(self, kind: str, **fields) -> dict:
        above = self.open[-1][0] if self.open else None
        token = {"ord": float(len(self.out)), "kind": kind, "id": len(self.out), "parent": above["id"] if above else -1, "ancestors": [*above["ancestors"], above["id"]] if above else [], "path": above["path"] if above else "", "sibling": 0, "ns": "", "prefix": "", "local": "", "value": "", "attrs": [], "nsdecl": {}} | fields
        self.out.append(token)
        return token

    def leave(self, k: int) -> None:
        while len(self.open) > k:
            self.out.append(self.open.pop()[0] | {"kind": "close", "ord": float(len(self.out))})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = ENDED_BY.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]["local"]
            if name in ends:
                self.leave(k)
                break
            if name in ("ul", "ol", "dl", "table", "body", "article", "div", "section", "nav"):
                break
        counts = self.open[-1][1] if self.open else self.top
        counts[tag] = counts.get(tag, 0) + 1
        above = self.open[-1][0]["path"] if self.open else ""
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        token = self.put("open", local=tag, path=f"{above}/{tag}", sibling=counts[tag], attrs=[{"ns": "", "prefix": "", "local": k, "value": v} for k, v in seen.items()])
        self.open.append((token, {}))
        if tag in VOID:
            self.leave(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0]["local"] == tag:
                self.leave(k)
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.put("text", value=data)

    def handle_comment(self, data: str) -> None:
        self.put("comment", value=data)


def parse_html(seq: DataFrame) -> DataFrame:
    """The token table of HTML texts (the unescape step for text/html): each document is read by one task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                doc = r.pop("doc")
                parser = _Html()
                parser.feed(doc or "")
                parser.close()
                parser.leave(0)
                yield _batch([r | t for t in parser.out])

    return seq.select("iter", "pos", "base_uri", "doc").mapInArrow(kernel, TOKENS)


def unescape_markup(text: Column, content_type: str = "application/xml", encoding: str | None = None, charset: str | None = None) -> Column:
    """The text of a document whose content is escaped markup; base64 needs a charset (XC0010); other types: XC0051."""
    check(content_type in ("application/xml", "text/xml", "text/html", "application/json"), "XC0051", content_type)
    if encoding == "base64":
        check(bool(charset), "XC0010", "base64 without a charset")
        return F.decode(F.unbase64(text), charset)
    check(encoding is None, "XC0052", str(encoding))
    return text


def json_to_xml(value: Column, schema: str, name: str = "json") -> Column:
    """A JSON object of a known schema as elements: name, then one element a field with its type. Invalid JSON is null."""
    from pyspark.sql.types import _parse_datatype_string

    parsed = F.from_json(value, schema)
    kinds = {"bigint": "number", "int": "number", "double": "number", "boolean": "boolean"}
    parts = []
    for f in _parse_datatype_string(schema).fields:
        own = parsed[f.name]
        kind = kinds.get(f.dataType.simpleString(), "string")
        parts.append(F.when(own.isNull(), F.lit(f'<{f.name} type="null"></{f.name}>')).otherwise(F.concat(F.lit(f'<{f.name} type="{kind}">'), escape_text(own.cast("string")), F.lit(f"</{f.name}>"))))
    return F.when(parsed.isNotNull(), F.concat(F.lit(f'<{name} type="object">'), *parts, F.lit(f"</{name}>")))


def json_document(value: Column, name: str = "json") -> Column:
    """JSON of any form as a document: objects, arrays and values nest as elements with a type; a name that XML does not allow stands in attribute name of a pair element. Null for what is not JSON."""

    def work(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _json_markup(v, name) if v is not None else None)

    return F.pandas_udf(work, "string")(value)


def _json_markup(text: str, name: str) -> str | None:
    from xml.sax.saxutils import escape, quoteattr

    def put(tag: str, value, more: str = "") -> str:
        if isinstance(value, dict):
            kind, inner = "object", "".join(put(k, v) if re.fullmatch(r"[A-Za-z_][\w.-]*", k) and not k.lower().startswith("xml") else put("pair", v, f" name={quoteattr(k)}") for k, v in value.items())
        elif isinstance(value, list):
            kind, inner = "array", "".join(put("item", v) for v in value)
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, Number) else "string"
            inner = "" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, Number) else escape(value)
        return f'<{tag}{more} type="{kind}">{inner}</{tag}>'

    class Number(str):
        """A number as it is written."""

    try:
        return put(name, json.loads(text, parse_int=Number, parse_float=Number))
    except (ValueError, RecursionError):
        return None


def text_range(text: Column, pointer: Column) -> Column:
    """The part of a plain text that a pointer names: line=a,b or char=a,b, places between lines or characters from 0.

    An end left out is the text's. Every line counts with one line end, the
    last one too. length=n after a semicolon must be the text's number of
    bytes; otherwise, or with another unit, the result is error XC0029.
    """
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.when((t == "") | t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n")))
    scheme = F.trim(F.substring_index(pointer, ";", 1))
    low = F.coalesce(F.regexp_extract(scheme, r"=(\d*)", 1).try_cast("int"), F.lit(0))
    high = F.regexp_extract(scheme, r"=\d*,(\d+)$", 1).try_cast("int")
    lines = F.split(F.regexp_replace(t, r"\n\z", ""), "\n")
    n = F.when(t == "", F.lit(0)).otherwise(F.size(lines))
    count = lambda end: F.greatest(F.least(F.coalesce(high, end), end) - low, F.lit(0))
    some = F.slice(lines, low + 1, count(n))
    chosen = (
        F.when(scheme.rlike(r"^line=(\d+(,\d*)?|,\d+)$"), F.when(F.size(some) > 0, F.concat(F.array_join(some, "\n"), F.lit("\n"))).otherwise(F.lit("")))
        .when(scheme.rlike(r"^char=(\d+(,\d*)?|,\d+)$"), t.substr(low + 1, count(F.length(t))))
        .otherwise(fail("XC0029", "not a pointer into text"))
    )
    length = F.regexp_extract(pointer, r";\s*length=(\d+)", 1).try_cast("bigint")
    return F.when(length.isNotNull() & (length != F.octet_length(text)), fail("XC0029", "the text has another length")).otherwise(chosen)


def json_of(tokens: DataFrame) -> DataFrame:
    """iter, pos, json: documents of json_to_xml's form as JSON, one field for each child of the root, in order.

    The child's type attribute decides: number and boolean stand bare, null is
    null, all else is a string. A root without children is an empty object.
    """
    child = (F.col("kind") == "open") & (F.size("ancestors") == 1)
    texts = tokens.filter((F.col("kind") == "text") & (F.size("ancestors") == 2)).groupBy("iter", "pos", "parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "").alias("_text"))
    rows = tokens.filter(child).select("iter", "pos", "ord", "local", F.col("id").alias("parent"), attr("type").alias("_type")).join(texts, ["iter", "pos", "parent"], "left")
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    text = F.coalesce("_text", F.lit(""))
    value = F.when(F.col("_type") == "null", F.lit("null")).when(F.col("_type").isin("number", "boolean"), text).otherwise(quoted(text))
    fields = rows.groupBy("iter", "pos").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(quoted(F.col("local")), F.lit(":"), value).alias("f")))).alias("_f"))
    roots = tokens.filter((F.col("kind") == "open") & (F.size("ancestors") == 0)).select("iter", "pos")
    joined = F.array_join(F.transform("_f", lambda x: x["f"]), ",")
    return roots.join(fields, ["iter", "pos"], "left").select("iter", "pos", F.concat(F.lit("{"), F.coalesce(joined, F.lit("")), F.lit("}")).alias("json"))


XI_NS = "http://www.w3.org/2001/XInclude"
#: A document cut at its includes. text: markup before a reference (or what stands in its place); head: markup up to the end of the root's name.
ITEMS = "array<struct<kind:string,text:string,href:string,parse:string,xpointer:string,fallback:string,lang:string,base:string,chain:array<string>>>"


def _cut(doc: str) -> tuple[list[dict], bool, bool]:
    """(a document's items, whether its root has xml:base, xml:lang): its markup between the outermost include elements, and these.

    The prefix xi is known without a declaration, for fragments.
    """
    data = doc.encode()
    parser = expat.ParserCreate()
    scopes: list[dict[str, str]] = [{"xi": XI_NS}]
    items: list[dict] = []
    state = {"at": 0, "depth": 0, "include": 0, "fallback": None, "ref": None, "head": False, "base": False, "lang": False}
    langs: list[str | None] = [None]

    def put(kind: str, to: int, **more) -> None:
        items.append({"kind": kind, "text": data[state["at"] : to].decode(), **more})

    def tag_end(at: int) -> int:
        return re.compile(rb"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>").match(data, at).end()

    def full(name: str) -> str:
        prefix, _, local = name.rpartition(":")
        return f"{scopes[-1].get(prefix, '')} {local}"

    def start(name: str, attributes: dict) -> None:
        here, state["depth"] = parser.CurrentByteIndex, state["depth"] + 1
        langs.append(attributes.get("xml:lang", langs[-1]))
        declared = {k[6:]: v for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}
        scopes.append(scopes[-1] | declared if declared else scopes[-1])
        name = full(name)
        if state["depth"] == 1:
            state["base"], state["lang"] = "xml:base" in attributes, "xml:lang" in attributes
        if state["include"]:
            if state["depth"] == state["include"] + 1 and name == f"{XI_NS} fallback" and state["fallback"] is None:
                state["fallback"] = tag_end(here)
            elif name == f"{XI_NS} include":
                raise PipelineError("XC0029", "an include within an include's fallback")
            return
        if name == f"{XI_NS} include":
            put("text", here)
            state["tag"] = tag_end(here)
            state["include"], state["fallback"], state["ref"] = state["depth"], None, {k: attributes.get(k) for k in ("href", "parse", "xpointer")} | {"fallback": None, "lang": langs[-2]}
        elif state["depth"] == 1:
            end = here + len(re.match(rb"<[^\s/>]+", data[here : here + 65536])[0])
            put("head", end)
            state["at"] = end

    def end(name: str) -> None:
        here, name = parser.CurrentByteIndex, full(name)
        if state["include"] == state["depth"]:
            state["at"] = state["tag"] if data[state["tag"] - 2 : state["tag"]] == b"/>" else data.index(b">", here) + 1
            items.append({"kind": "ref", "text": None, **state["ref"]})
            state["include"] = 0
        elif state["include"] and state["depth"] == state["include"] + 1 and name == f"{XI_NS} fallback":
            at = state["fallback"]
            state["ref"]["fallback"] = "" if data[at - 2 : at] == b"/>" else data[at:here].decode()
        state["depth"] -= 1
        langs.pop()
        scopes.pop()

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.XmlDeclHandler = lambda *_: state.__setitem__("at", data.index(b"?>") + 2)
    parser.EndDoctypeDeclHandler = lambda: state.__setitem__("at", data.index(b">", parser.CurrentByteIndex) + 1 if data[parser.CurrentByteIndex : parser.CurrentByteIndex + 1] != b">" else parser.CurrentByteIndex + 1)
    try:
        parser.Parse(data, True)
    except expat.ExpatError as x:
        raise PipelineError("XD0011", f"not a well-formed document: {x}") from None
    put("text", len(data))
    return items, state["base"], state["lang"]


def _cut_all(docs: DataFrame, keys: list[str], raw: bool = False) -> DataFrame:
    """keys, items, has_base, has_lang of docs(keys, doc); raw: a text that is no document has no items (it may be wanted as text)."""
    names = ("kind", "text", "href", "parse", "xpointer", "fallback", "lang")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc in batch.column("doc").to_pylist():
                try:
                    rows.append(_cut(doc or ""))
                except PipelineError:
                    if not raw:
                        raise
                    rows.append((None, False, False))
            kind = pa.list_(pa.struct([(n, pa.string()) for n in (*names, "base")] + [("chain", pa.list_(pa.string()))]))
            items = [None if r[0] is None else [{n: i.get(n) for n in names} | {"base": None, "chain": None} for i in r[0]] for r in rows]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(items, kind), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=[*keys, "items", "has_base", "has_lang"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*keys, "doc").mapInArrow(kernel, ", ".join(f"{k} {types[k]}" for k in keys) + f", items {ITEMS}, has_base boolean, has_lang boolean")


def xinclude(docs: DataFrame, resources: DataFrame, fixup_xml_base: bool = False, fixup_xml_lang: bool = False) -> DataFrame:
    """Replace include elements in documents by resources(uri, doc), and theirs, level by level.

    Documents and resources are cut at their includes once, by the namespace,
    so prefixes, quotes and comments do not matter. Each level is one join of
    references with resources on the URI resolved against the document that the
    reference stands in, so resources of any number are not broadcast.
    parse="text" includes the resource as text, or the part that
    xpointer="text(...)" names. An include without a resource takes its
    fallback (which holds no includes), or is XC0029; so is a loop, found by
    the chain of URIs. fixup_xml_base, fixup_xml_lang: the included root gets
    the attribute, unless it has one.
    """
    keys = ["iter", "pos", "base_uri"]
    chained = lambda base, chain: F.transform("items", lambda x: x.withField("base", base).withField("chain", chain))
    now = _cut_all(docs, keys)
    now = materialize(now.select(*keys, chained(F.col("base_uri"), F.array(F.coalesce("base_uri", F.lit("")))).cast(ITEMS).alias("items")), "xinclude")
    known = materialize(_cut_all(resources.select("uri", "doc"), ["uri"], raw=True).join(resources.select("uri", F.col("doc").alias("raw")), "uri").withColumnRenamed("items", "_items"), "xinclude-resources")
    while True:
        waiting = F.exists("items", lambda x: x["kind"] == "ref")
        if not now.filter(waiting).limit(1).count():
            return now.select(*keys, F.array_join(F.transform("items", lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("doc"))
        each = now.filter(waiting).select("iter", "pos", F.posexplode("items").alias("_k", "_x")).filter("_x.kind = 'ref'")
        each = each.withColumn("uri", resolve_uri(F.col("_x.href"), F.col("_x.base")))
        got = each.join(known, "uri", "left")
        pointer = F.regexp_extract(F.coalesce("_x.xpointer", F.lit("")), r"^text\((.*)\)$", 1)
        as_text = escape_text(F.when(pointer != "", text_range(F.col("raw"), pointer)).otherwise(F.col("raw")))
        one = lambda text: F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast("string").alias(n) for n in ("href", "parse", "xpointer", "fallback", "lang", "base")], F.lit(None).cast("array<string>").alias("chain")))
        chain = F.concat(F.col("_x.chain"), F.array("uri"))
        loop = F.array_contains("_x.chain", F.col("uri"))
        more = F.concat(
            F.when(F.lit(fixup_xml_base) & ~F.col("has_base"), F.concat(F.lit(' xml:base="'), escape_attribute(F.col("uri")), F.lit('"'))).otherwise(F.lit("")),
            F.when(F.lit(fixup_xml_lang) & ~F.col("has_lang") & F.col("_x.lang").isNotNull(), F.concat(F.lit(' xml:lang="'), escape_attribute(F.col("_x.lang")), F.lit('"'))).otherwise(F.lit("")),
        )
        inner = F.transform("_items", lambda x: x.withField("base", F.col("uri")).withField("chain", chain).withField("text", F.when(x["kind"] == "head", F.concat(x["text"], more)).otherwise(x["text"])))
        new = (
            F.when(F.col("raw").isNull(), F.when(F.col("_x.fallback").isNotNull(), one(F.col("_x.fallback"))).otherwise(one(fail("XC0029", "no such resource"))).cast(ITEMS))
            .when(F.col("_x.parse") == "text", one(as_text).cast(ITEMS))
            .when(loop, one(fail("XC0029", "a document includes itself")).cast(ITEMS))
            .when(F.col("_items").isNull(), one(fail("XD0011", "the resource is not a well-formed document")).cast(ITEMS))
            .otherwise(inner.cast(ITEMS))
        )
        lists = got.groupBy("iter", "pos").agg(F.map_from_entries(F.collect_list(F.struct("_k", new.alias("v")))).alias("_got"))
        # Merged, not broadcast: documents stay spread over the tasks for the steps that read them.
        joined = now.join(lists.hint("merge"), ["iter", "pos"], "left")
        spliced = F.flatten(F.transform("items", lambda x, k: F.coalesce(F.try_element_at("_got", k), F.array(x))))
        now = materialize(joined.select(*keys, F.when(F.col("_got").isNull(), F.col("items")).otherwise(spliced).alias("items")), "xinclude")


@dataclass(frozen=True)
class Rule:
    """A Schematron rule: where it applies (a match condition) and what must hold there."""

    name: str
    context: Column
    test: Column
    message: str
    phase: str = "all"


def schematron(tokens: DataFrame, rules: list[Rule], phase: str | None = None) -> DataFrame:
    """iter, pos, rule, path, message of each failed assertion: the report port. Rules are conditions on tokens, in one pass."""
    active = [r for r in rules if phase is None or r.phase in ("all", phase)]
    fails = F.array(*[F.when(r.context & (F.col("kind") != "close") & ~F.coalesce(r.test, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.message).alias("message"))) for r in active])
    return tokens.select("iter", "pos", "path", "ord", F.explode(F.filter(fails, lambda x: x.isNotNull())).alias("f")).select("iter", "pos", "f.rule", "path", "ord", "f.message")


def assert_valid(seq: DataFrame, report: DataFrame, code: str = "XC0054") -> DataFrame:
    """The sequence, with error XC0054 where the report has a failure of the document."""
    bad = report.groupBy("iter", "pos").agg(F.first("message").alias("_bad"))
    joined = seq.join(bad, ["iter", "pos"], "left")
    return joined.withColumn("doc", F.when(F.col("_bad").isNotNull(), fail(code, "not valid")).otherwise(F.col("doc"))).drop("_bad")


def structure_allowed(model: dict[str, set[str]], attributes: dict[str, set[str]] | None = None) -> Column:
    """Whether an element may stand where it does and has the attributes it must have, by a simple schema.

    The subset of schema validation that is a condition on tokens: parents come
    from the path. model: name -> allowed children ("" for the root's name).
    """
    parent = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    allowed = F.lit(False)
    for name, children in model.items():
        allowed = allowed | ((parent == name) & F.col("local").isin(*children)) if children else allowed
    ok = allowed
    for name, needed in (attributes or {}).items():
        ok = ok & ((F.col("local") != name) | F.lit(True if not needed else False) | (F.size(F.array_intersect(F.transform("attrs", lambda a: a["local"]), F.array(*map(F.lit, sorted(needed))))) == len(needed)))
    return ok


def structure_report(tokens: DataFrame, model: dict[str, set[str]], attributes: dict[str, set[str]] | None = None) -> DataFrame:
    """Failures of a simple schema: the elements that structure_allowed does not allow."""
    ok = structure_allowed(model, attributes)
    return tokens.filter((F.col("kind") == "open") & ~ok).select("iter", "pos", F.lit("structure").alias("rule"), "path", "ord", F.lit("not allowed here, or an attribute is missing").alias("message"))


def schema_valid(seq: DataFrame, xsd: str) -> DataFrame:
    """iter, pos, valid: whether each document is valid against an XML Schema, by the check of Spark's XML reader.

    xsd: a path that every executor can read, or the name of a file added with
    SparkContext.addFile. A null document is not valid. Use assert_valid with
    code XC0053 on the documents that are not.
    """
    options = {"rowValidationXSDPath": xsd, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = F.from_xml("doc", "_bad string", options)
    return seq.select("iter", "pos", (F.col("doc").isNotNull() & parsed["_bad"].isNull()).alias("valid"))


def param_set(values: dict[str, str]) -> str:
    """A c:param-set document of parameters (the parameters and in-scope-names steps)."""
    import html

    rows = "".join(f'<c:param name="{html.escape(k)}" value="{html.escape(str(v))}"></c:param>' for k, v in sorted(values.items()))
    return f'<c:param-set xmlns:c="http://www.w3.org/ns/xproc-step">{rows}</c:param-set>'


def message(seq: DataFrame, text: str, log: Callable[[str], None] = print) -> DataFrame:
    """Log a message when the plan is built; the sequence passes."""
    log(text)
    return seq


def error(seq: DataFrame, code: str) -> DataFrame:
    """Fail with a user's code when any document is read; its content is the message."""
    return seq.withColumn("doc", F.raise_error(F.concat(F.lit(f"[{code}] "), F.coalesce("doc", F.lit("")))).cast("string"))


def report_errors(seq: DataFrame, report: DataFrame, code: str | None = None, log: Callable[[str], None] = print, most: int = 20) -> DataFrame:
    """Log the number of reports and the first `most` of them; with a code, reports make the documents fail with it when read."""
    n = report.count()
    if n:
        log(f"{n} reports")
        for r in report.orderBy("iter", "pos").select("doc").limit(most).collect():
            log(r.doc)
    return error(seq, code) if n and code else seq
