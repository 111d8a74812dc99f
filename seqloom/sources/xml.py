"""Documents as token tables: parsing, serialising, equality.

A sequence of documents is a DataFrame with one row a document:

    iter BIGINT, pos BIGINT, base_uri STRING, doc STRING

Its tokens are a DataFrame with one row for each start tag, end tag, text,
comment and processing instruction, so that steps on documents are filters,
projections, joins and windows of Spark:

    iter, pos, base_uri   of the document
    ord DOUBLE            document order
    kind STRING           open, close, text, comment, pi
    id, parent BIGINT     of the element (a close token has its open token's)
    ancestors ARRAY       ids from the root to the parent
    path STRING           names from the root, as /doc/div/p
    sibling INT           1-based place among the parent's elements of that name
    ns, prefix, local     name (a PI's target is local)
    value STRING          text, comment or PI content
    attrs ARRAY<STRUCT<ns, prefix, local, value>>
    nsdecl MAP            namespaces declared on the element

Only parsing runs in Python, one document at a time; serialising is an
aggregation. Elements that are cut out of documents just parsed are joined in
Python as well (cut), without a shuffle.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, takewhile
from xml.parsers import expat

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.errors import PipelineError

ATTRS = "array<struct<ns:string,prefix:string,local:string,value:string>>"
SEQ = "iter bigint, pos bigint, base_uri string, doc string"
TOKENS = f"iter bigint, pos bigint, base_uri string, ord double, kind string, id bigint, parent bigint, ancestors array<bigint>, path string, sibling int, ns string, prefix string, local string, value string, attrs {ATTRS}, nsdecl map<string,string>"
KEYS = ("iter", "pos")
XML_NS = "http://www.w3.org/XML/1998/namespace"
#: Columns that serialize reads.
WRITTEN = ("ord", "kind", "ns", "prefix", "local", "value", "attrs", "nsdecl")
#: Characters that the parser reads at a time, and tokens after which a batch goes to Spark.
PIECE = 1 << 16
ROWS = 20_000
#: Characters of cut documents after which a batch goes to Spark.
CHARS = 1 << 22
#: The documents that cut finds in one.
FOUND = "array<struct<k:bigint,doc:string>>"

_ATTR_TYPE = pa.list_(pa.struct([(k, pa.string()) for k in ("ns", "prefix", "local", "value")]))
_TYPES = {"iter": pa.int64(), "pos": pa.int64(), "base_uri": pa.string(), "ord": pa.float64(), "kind": pa.string(), "id": pa.int64(), "parent": pa.int64(), "ancestors": pa.list_(pa.int64()), "path": pa.string(), "sibling": pa.int32(), "ns": pa.string(), "prefix": pa.string(), "local": pa.string(), "value": pa.string(), "attrs": _ATTR_TYPE, "nsdecl": pa.map_(pa.string(), pa.string())}

_DDL = dict(x.split(" ", 1) for x in TOKENS.replace(ATTRS, "ATTRS").replace("map<string,string>", "MAP").split(", "))
_DDL |= {"attrs": ATTRS, "nsdecl": "map<string,string>", "_m": "string", "_closes": "array<int>", "_space": "tinyint"}

#: What _Elements adds to a start tag.
_CUT = {"_m": pa.string(), "_closes": pa.list_(pa.int32()), "_space": pa.int8()}
#: The values of a token in the kernels.
_FIELDS = (*list(_TYPES)[3:], *_CUT)

_IN_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", "\r": "&#xD;"})
_IN_ATTRIBUTE = _IN_TEXT | str.maketrans({'"': "&quot;", "\n": "&#xA;", "\t": "&#x9;"})
_NOT_IN_TEXT = re.compile("[&<>\r]").search
_NOT_IN_ATTRIBUTE = re.compile('[&<>\r"\n\t]').search
_NAME = re.compile("^<[^ >]+").sub


def _name(qualified: str) -> tuple[str, str, str]:
    """expat's 'uri local prefix' as (ns, prefix, local)."""
    parts = qualified.split(" ")
    return (parts[0], parts[2] if len(parts) > 2 else "", parts[1]) if len(parts) > 1 else ("", "", parts[0])


def _parser() -> expat.XMLParserType:
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.namespace_prefixes = True
    parser.ordered_attributes = True
    parser.buffer_text = True
    return parser


def _feed(parser: expat.XMLParserType, doc: str) -> Iterator[None]:
    """Read a document piece by piece; one that is not well-formed is error XD0011."""
    try:
        for at in range(0, len(doc) - PIECE, PIECE):
            parser.Parse(doc[at : at + PIECE], False)
            yield
        parser.Parse(doc[(len(doc) - 1) // PIECE * PIECE :] if doc else "", True)
    except expat.ExpatError as x:
        raise PipelineError("XD0011", f"not a well-formed document: {x}") from None


class _Names(dict):
    """The parts of names that were met, each taken apart once."""

    def __missing__(self, qualified: str) -> tuple[str, str, str]:
        found = self[qualified] = _name(qualified)
        return found


class _Tokens:
    """The tokens of documents as lists of columns, taken off as batches of bounded size, also within a document."""

    def __init__(self, types: dict[str, pa.DataType], kinds: tuple[str, ...] | None) -> None:
        self.types = types
        self.kinds = frozenset(kinds or ("open", "close", "text", "comment", "pi", "error"))
        self.names = _Names()
        self.rows: list[tuple] = []
        self.docs: list[int] = []
        self.counts: list[int] = []
        # Made once, as making them takes as long as reading a small document.
        self.begin, self.finish, self.handlers = self._reader()

    def put_error(self, number: int, x: PipelineError) -> None:
        if "error" in self.kinds:
            self.rows.append((0.0, "error", 0, -1, (), "", 0, "", "", x.code, x.message, (), ()))
            self.docs.append(number)
            self.counts.append(1)

    def _reader(self) -> tuple[Callable[[], None], Callable[[], None], dict[str, Callable]]:
        """What is called before and after a document, and the parser's handlers."""
        kinds, names, put = self.kinds, self.names, self.rows.append
        opens, closes, texts = "open" in kinds, "close" in kinds, "text" in kinds
        with_attrs, with_path, with_ancestors, with_sibling = (k in self.types for k in ("attrs", "path", "ancestors", "sibling"))
        pending: list[str] = []
        declared: dict[str, str] = {}
        # Open elements: id, ancestors of what is inside, path, numbers of children by name, token.
        inside: list[tuple] = []
        top: tuple = ()
        n = 0

        def begin() -> None:
            nonlocal n, top
            n, top = 0, (-1, (), "", {}, None)
            inside[:] = (top,)
            pending.clear()
            declared.clear()

        def text() -> None:
            nonlocal n
            if texts:
                put((float(n), "text", n, top[0], top[1], top[2], 0, "", "", "", "".join(pending) if len(pending) > 1 else pending[0], (), ()))
            n += 1
            pending.clear()

        def start(name: str, attributes: list[str]) -> None:
            nonlocal n, top
            if pending:
                text()
            parent, ancestors, path, counts, _ = top
            k = 0
            if with_sibling:
                k = counts[name] = counts.get(name, 0) + 1
            ns, prefix, local = names[name]
            attrs: list | tuple = ()
            if attributes and with_attrs:
                attrs = [(*names[a], v) for a, v in zip(attributes[::2], attributes[1::2], strict=True)]
            path = f"{path}/{local}" if with_path else ""
            token = (float(n), "open", n, parent, ancestors, path, k, ns, prefix, local, "", attrs, tuple(declared.items()) if declared else ())
            if declared:
                declared.clear()
            if opens:
                put(token)
            top = (n, (*ancestors, n) if with_ancestors else (), path, {}, token)
            inside.append(top)
            n += 1

        def end(_: str) -> None:
            nonlocal n, top
            if pending:
                text()
            if closes:
                put((float(n), "close", *top[4][2:12], ()))
            n += 1
            inside.pop()
            top = inside[-1]

        def other(kind: str, local: str, value: str) -> None:
            nonlocal n
            if pending:
                text()
            if kind in kinds:
                put((float(n), kind, n, top[0], top[1], top[2], 0, "", "", local, value, (), ()))
            n += 1

        return begin, lambda: None, _handlers(start, end, pending.append, other, declared)

    def read(self, number: int, doc: str, errors: bool) -> Iterator[None]:
        """Read a document; yields between its pieces, where what is there can be taken off."""
        if errors:  # Nothing of a document that is not well-formed may have gone before.
            for _ in _feed(_parser(), doc):
                pass
        parser = _parser()
        for event, handler in self.handlers.items():
            setattr(parser, event, handler)
        self.begin()
        before = len(self.rows)
        for _ in _feed(parser, doc):
            self.docs.append(number)
            self.counts.append(len(self.rows) - before)
            yield
            before = len(self.rows)
        self.finish()
        self.docs.append(number)
        self.counts.append(len(self.rows) - before)

    def take(self, heads: pa.RecordBatch) -> pa.RecordBatch:
        """What was read since the last batch."""
        places = [p for p, n in zip(self.docs, self.counts, strict=True) for _ in range(n)]
        own = heads.take(pa.array(places, pa.int64()))
        columns = list(zip(*self.rows, strict=False)) or [()] * len(_FIELDS)
        made = [_column(n, columns[k], self.types[n]) for k, n in enumerate(_FIELDS) if n in self.types]
        # The handlers hold the list of rows, so it is emptied and not replaced.
        for x in (self.rows, self.docs, self.counts):
            x.clear()
        return pa.RecordBatch.from_arrays([*own.columns, *made], names=list(self.types))


class _Elements(_Tokens):
    """The start tags of documents, each with the markup from it up to the next one, as serialize writes it.

    _closes are the places in that markup at which elements end; _space is 1
    for an element of no namespace that declares no default one, 2 for one that
    is in a default namespace. as_text: the text alone in place of the markup.
    """

    def __init__(self, types: dict[str, pa.DataType], as_text: bool = False) -> None:
        self.as_text = as_text
        super().__init__(types, ("open",))

    def _reader(self) -> tuple[Callable[[], None], Callable[[], None], dict[str, Callable]]:
        names, put, as_text = self.names, self.rows.append, self.as_text
        with_attrs, with_path, with_ancestors, with_sibling = (k in self.types for k in ("attrs", "path", "ancestors", "sibling"))
        pending: list[str] = []
        declared: dict[str, str] = {}
        # What start tags without declarations have in common, by their names.
        shapes: dict[tuple[str, ...], tuple] = {}
        # Open elements: id, ancestors of what is inside, path, numbers of children by name, end tag.
        inside: list[tuple] = []
        top: tuple = ()
        n = length = 0
        # The last start tag's token and _space, what was written since, and where elements ended in it.
        last: tuple = ()
        written: list[str] = []
        closes: list[int] = []

        def begin() -> None:
            nonlocal n, top, last
            n, top, last = 0, (-1, (), "", {}, ""), ()
            inside[:] = (top,)
            for x in (pending, declared, written, closes):
                x.clear()

        def finish() -> None:
            nonlocal last
            if last:
                put((*last[:-1], "".join(written), tuple(closes), last[-1]))
                written.clear()
                closes.clear()
                last = ()

        def text() -> None:
            nonlocal n, length
            piece = "".join(pending) if len(pending) > 1 else pending[0]
            if not as_text:
                piece = _escaped(piece)
            written.append(piece)
            length += len(piece)
            n += 1
            pending.clear()

        def shape(name: str, attributes: tuple[str, ...]) -> tuple:
            """The name's parts, a form for the values of attributes, _space, and the end tag."""
            ns, prefix, local = names[name]
            if as_text:
                return ns, prefix, local, "", 0, ""
            full = f"{prefix}:{local}" if prefix else local
            needed = {prefix: ns} if ns and prefix != "xml" else {}
            for of, p, _ in (names[a] for a in attributes):
                if of and of != XML_NS:
                    needed.setdefault(p, of)
            spaces = declared | needed
            uris = "".join(f' xmlns{":" if p else ""}{p}="{_escaped(uri, True)}"' for p, uri in sorted(spaces.items()))
            own = "".join(f' {p}:{word}="%s"' if p else f' {word}="%s"' for _, p, word in (names[a] for a in attributes))
            space = (0 if prefix else 2) if ns else 0 if prefix or "" in spaces else 1
            return ns, prefix, local, f"<{full}{uris.replace('%', '%%')}{own}>", space, f"</{full}>"

        def start(name: str, attributes: list[str]) -> None:
            nonlocal n, top, last, length
            if pending:
                text()
            if last:
                finish()
            parent, ancestors, path, counts, _ = top
            k = 0
            if with_sibling:
                k = counts[name] = counts.get(name, 0) + 1
            key = (name, *attributes[::2])
            found = None if declared else shapes.get(key)
            if found is None:
                found = shape(name, key[1:])
                if not declared and len(shapes) < ROWS:
                    shapes[key] = found
            ns, prefix, local, form, space, close = found
            values = attributes[1::2]
            attrs: list | tuple = ()
            if attributes:
                if with_attrs:
                    attrs = [(*names[a], v) for a, v in zip(key[1:], values, strict=True)]
            if not as_text:
                form %= tuple(_escaped(v, True) for v in values) if _NOT_IN_ATTRIBUTE("".join(values)) else tuple(values)
            if with_path:
                path = f"{path}/{local}"
            last = float(n), "open", n, parent, ancestors, path, k, ns, prefix, local, "", attrs, tuple(declared.items()) if declared else (), space
            if declared:
                declared.clear()
            written.append(form)
            length = len(form)
            top = n, (*ancestors, n) if with_ancestors else (), path, {} if with_sibling else counts, close
            inside.append(top)
            n += 1

        def end(_: str) -> None:
            nonlocal n, top, length
            if pending:
                text()
            close = top[4]
            written.append(close)
            length += len(close)
            closes.append(length)
            n += 1
            inside.pop()
            top = inside[-1]

        def other(kind: str, local: str, value: str) -> None:
            nonlocal n, length
            if pending:
                text()
            if len(inside) > 1 and not as_text:
                piece = f"<!--{value}-->" if kind == "comment" else f"<?{local} {value}?>" if value else f"<?{local}?>"
                written.append(piece)
                length += len(piece)
            n += 1

        return begin, finish, _handlers(start, end, pending.append, other, declared)


def _handlers(start: Callable, end: Callable, text: Callable, other: Callable, declared: dict[str, str]) -> dict[str, Callable]:
    return {
        "StartElementHandler": start,
        "EndElementHandler": end,
        "CharacterDataHandler": text,
        "StartNamespaceDeclHandler": lambda prefix, uri: declared.__setitem__(prefix or "", uri or ""),
        "CommentHandler": lambda data: other("comment", "", data),
        "ProcessingInstructionHandler": lambda target, data: other("pi", target, data),
    }


def _escaped(value: str, attribute: bool = False) -> str:
    """escape_text and escape_attribute of a string."""
    if attribute:
        return value.translate(_IN_ATTRIBUTE) if _NOT_IN_ATTRIBUTE(value) else value
    return value.translate(_IN_TEXT) if _NOT_IN_TEXT(value) else value


def _values(column: pa.Array) -> list:
    """to_pylist in a tenth of its time."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _column(name: str, values: Sequence, kind: pa.DataType) -> pa.Array:
    """A column of tokens; lists are made of their flat parts, which is much faster than value by value."""
    if name not in ("ancestors", "attrs", "nsdecl", "_closes"):
        return pa.array(values, kind)
    offsets = pa.array([0, *accumulate(map(len, values))], pa.int32())
    flat = [x for v in values for x in v]
    if name in ("ancestors", "_closes"):
        return pa.ListArray.from_arrays(offsets, pa.array(flat, kind.value_type))
    if name == "nsdecl":
        return pa.MapArray.from_arrays(offsets, pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string()))
    fields = list(kind.value_type)
    parts = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.string()) for k in range(len(fields))], fields=fields)
    return pa.ListArray.from_arrays(offsets, parts)


def parse(seq: DataFrame, errors: bool = False, only: tuple[str, ...] | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The token table of a sequence. Each document is read by one task; no shuffle.

    only: the columns to make, besides iter, pos and base_uri; kinds: the kinds
    of tokens. Spark cannot see into the kernel, so what no later step reads is
    left out here. The tokens of a large document go to Spark while it is read,
    so Python holds a document's text but not its tokens.

    A document that is not well-formed, or null, ends the job with XD0011;
    with errors, it gives one row of kind error instead, with the code in local
    and the message in value.
    """

    types = _wanted(only)
    wanted = kinds and (*kinds, "error")
    return seq.select("iter", "pos", "base_uri", "doc").mapInArrow(_kernel(lambda: _Tokens(types, wanted), errors), _schema(types))


def _wanted(only: tuple[str, ...] | None) -> dict[str, pa.DataType]:
    return dict(list(_TYPES.items())[:3]) | {k: t for k, t in list(_TYPES.items())[3:] if only is None or k in only}


def _schema(types: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {_DDL[k]}" for k in types)


def _kernel(reader: Callable[[], _Tokens], errors: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows make no cycles; to look for them among many small tuples would take a fifth of the time.
        gc.set_threshold(10 * ROWS)
        tokens = reader()
        for batch in batches:
            heads = batch.select(["iter", "pos", "base_uri"])
            for i, doc in enumerate(x for at in range(0, batch.num_rows, 64) for x in _values(batch.column("doc").slice(at, 64))):
                try:
                    for _ in tokens.read(i, doc or "", errors):
                        if len(tokens.rows) > ROWS:
                            yield tokens.take(heads)
                except PipelineError as x:
                    if not errors:
                        raise
                    tokens.put_error(i, x)
                if len(tokens.rows) > ROWS:
                    yield tokens.take(heads)
            yield tokens.take(heads)

    return kernel


def cut(seq: DataFrame, match: Column, only: tuple[str, ...] | None = None, as_text: bool = False) -> DataFrame:
    """iter, pos, base_uri, n, found: the matched elements of each document as serialized documents, n structs (k, doc).

    k is the element's place among those of its document, from 0, also where
    they are nested; a document may have several rows, and has none without a
    match. only: the columns that match reads, besides kind; as_text: doc is the
    element's string value.

    The same as to select and serialize, but nothing is shuffled or sorted: a
    kernel gives a row for each start tag with its markup, Spark computes match
    on these rows, and a second kernel joins what lies between an element's
    tags, as rows stay in their order from one kernel to the next. Only a match
    that moves rows (a window) makes it sort them again.
    """

    def tags(*more: str) -> DataFrame:
        types = _wanted(None if only is None else (*only, "kind", *more)) | _CUT
        rows = seq.select("iter", "pos", "base_uri", "doc").mapInArrow(_kernel(lambda: _Elements(types, as_text), False), _schema(types))
        return rows.select("iter", "pos", "base_uri", F.coalesce(match, F.lit(False)).alias("_hit"), *_CUT, *more)

    found = tags()
    if _moves(found):
        found = tags("ord").repartition(*KEYS).sortWithinPartitions(*KEYS, "ord").drop("ord")
    return found.mapInArrow(_cut, f"iter bigint, pos bigint, base_uri string, n bigint, found {FOUND}")


def texts(seq: DataFrame, match: Column, only: tuple[str, ...] | None = None) -> DataFrame:
    """iter, pos, k, text: the string value of each matched element, read from the documents without a shuffle (rewrite.text_of: from tokens)."""
    return cut(seq, match, only, as_text=True).select("iter", "pos", F.inline("found")).withColumnRenamed("doc", "text")


def _moves(rows: DataFrame) -> bool:
    """Whether anything but projections comes after the kernel that rows are from."""
    plan = rows._jdf.queryExecution().analyzed().toString().splitlines()
    return any(not x.lstrip("+-: ").startswith("Project ") for x in takewhile(lambda x: "MapInArrow" not in x, plan))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the markup between the tags of matched elements."""
    # Open elements: of matched ones their place and where their markup begins in parts.
    inside: list[tuple[int, int] | None] = []
    parts: list[str] = []
    spaces: list[int] = []
    k = matched = size = 0
    places: list[int] = []
    docs: list[str] = []
    rows: list[int] = []
    counts: list[int] = []

    def taken(heads: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal size
        size = 0
        pairs = pa.StructArray.from_arrays([pa.array(places, pa.int64()), pa.array(docs, pa.string())], names=["k", "doc"])
        lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), pairs)
        own, n = heads.take(pa.array(rows, pa.int64())), pa.array(counts, pa.int64())
        for x in (places, docs, rows, counts):
            x.clear()
        return pa.RecordBatch.from_arrays([*own.columns, n, lists], names=["iter", "pos", "base_uri", "n", "found"])

    for batch in batches:
        heads = batch.select(["iter", "pos", "base_uri"])
        closes = batch.column("_closes")
        ends, at = _values(closes.flatten()), 0
        fresh = True
        for i, (hit, markup, space, n) in enumerate(zip(*(_values(batch.column(c)) for c in ("_hit", "_m", "_space")), _values(pa.compute.list_value_length(closes)), strict=True)):
            if not inside:
                k, fresh = 0, True
            if hit:
                inside.append((k, len(parts)))
                k += 1
                matched += 1
            else:
                inside.append(None)
            if not matched:
                if n:
                    del inside[-n:]
                    at += n
                continue
            parts.append(markup)
            spaces.append(space)
            for end in ends[at : at + n]:
                element = inside.pop()
                if element is None:
                    continue
                doc = markup[:end]
                if element[1] < len(parts) - 1:
                    pieces = [*parts[element[1] : -1], doc]
                    of = spaces[element[1] :]
                    if 2 in of:
                        # An element of no namespace undoes the default namespace of one around it.
                        pieces = [_NAME(r'\g<0> xmlns=""', p, 1) if s == 1 else p for p, s in zip(pieces, of, strict=True)]
                    doc = "".join(pieces)
                if fresh:
                    rows.append(i)
                    counts.append(0)
                    fresh = False
                places.append(element[0])
                docs.append(doc)
                counts[-1] += 1
                size += len(doc)
                if size > CHARS:
                    yield taken(heads)
                    fresh = True
                matched -= 1
                if not matched:
                    parts.clear()
                    spaces.clear()
            at += n
        if rows:
            yield taken(heads)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([list(r[k].items()) if k == "nsdecl" else r[k] for r in rows], t) for k, t in _TYPES.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(_TYPES))


def qname(t: Column | None = None) -> Column:
    """prefix:local of a token or attribute."""
    prefix, local = (t["prefix"], t["local"]) if t is not None else (F.col("prefix"), F.col("local"))
    return F.when(F.coalesce(prefix, F.lit("")) == "", local).otherwise(F.concat(prefix, F.lit(":"), local))


def escape_text(value: Column) -> Column:
    out = F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(F.replace(out, F.lit(">"), F.lit("&gt;")), F.lit("\r"), F.lit("&#xD;"))


def escape_attribute(value: Column) -> Column:
    out = F.replace(escape_text(value), F.lit('"'), F.lit("&quot;"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("&#xA;")), F.lit("\t"), F.lit("&#x9;"))


def markup() -> Column:
    """What a token contributes to its document's text. Empty elements keep both tags."""
    declared = F.array_join(
        F.transform(F.array_sort(F.map_entries("nsdecl")), lambda e: F.concat(F.when(e["key"] == "", F.lit(" xmlns")).otherwise(F.concat(F.lit(" xmlns:"), e["key"])), F.lit('="'), escape_attribute(e["value"]), F.lit('"'))),
        "",
    )
    attributes = F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), qname(a), F.lit('="'), escape_attribute(F.coalesce(a["value"], F.lit(""))), F.lit('"'))), "")
    return (
        F.when(F.col("kind") == "open", F.concat(F.lit("<"), qname(), declared, attributes, F.lit(">")))
        .when(F.col("kind") == "close", F.concat(F.lit("</"), qname(), F.lit(">")))
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), F.col("value"), F.lit("-->")))
        .when(F.col("kind") == "pi", F.concat(F.lit("<?"), F.col("local"), F.when(F.col("value") == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.col("value"))), F.lit("?>")))
        .otherwise(escape_text(F.coalesce("value", F.lit(""))))
    )


#: Serialization parameters and their defaults.
OUTPUT = {"method": "xml", "omit_xml_declaration": True, "standalone": "omit", "indent": False, "cdata_section_elements": (), "doctype_public": None, "doctype_system": None, "encoding": "UTF-8"}


def output(tokens: DataFrame, **options) -> DataFrame:
    """serialize() with the parameters of an output port (OUTPUT; another name or method: XD0020).

    text: the string value; xml: with a declaration, a document type, indented,
    and with the text of some elements (local names) in CDATA sections.
    """
    from seqloom.functions.errors import check
    from seqloom.operators.rewrite import pretty_print

    check(set(options) <= set(OUTPUT), "XD0020", str(options))
    o = OUTPUT | options
    check(o["method"] in ("xml", "text") and o["encoding"].upper() in ("UTF-8", "UTF8"), "XD0020", str(options))
    if o["method"] == "text":
        return serialize(tokens.filter("kind = 'text'"), as_text=True)
    rows = pretty_print(tokens) if o["indent"] else tokens
    out = serialize(rows, cdata=tuple(o["cdata_section_elements"]))
    alone = {"omit": "", True: ' standalone="yes"', False: ' standalone="no"'}[o["standalone"]]
    head = "" if o["omit_xml_declaration"] else f'<?xml version="1.0" encoding="UTF-8"{alone}?>\n'
    kind = f'PUBLIC "{o["doctype_public"]}" "{o["doctype_system"] or ""}"' if o["doctype_public"] else f'SYSTEM "{o["doctype_system"]}"'
    if o["doctype_public"] or o["doctype_system"]:
        root = rows.filter((F.col("kind") == "open") & (F.size("ancestors") == 0)).select("iter", "pos", qname().alias("_root"))
        out = out.join(root, ["iter", "pos"], "left").withColumn("doc", F.concat(F.lit("<!DOCTYPE "), F.coalesce("_root", F.lit("")), F.lit(f" {kind}>\n"), F.col("doc"))).drop("_root")
    return out.withColumn("doc", F.concat(F.lit(head), F.col("doc")))


def serialize(tokens: DataFrame, cdata: tuple[str, ...] = (), as_text: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The sequence of a token table: one group a document (keys tell them apart), as large as the document.

    A namespace that a step has brought in without declaring it (a new name's)
    is declared where it is used. Markup is built before the shuffle.
    """
    t = tokens.withColumn("nsdecl", _needed())
    piece = F.col("value") if as_text else markup()
    if cdata:
        section = F.concat(F.lit("<![CDATA["), F.replace("value", F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))
        piece = F.when((F.col("kind") == "text") & F.regexp_extract("path", r"([^/]*)$", 1).isin(*cdata), section).otherwise(piece)
    element = F.col("kind") == "open"
    # An element of no namespace undoes the default namespace of one around it.
    default = F.max(element & (F.col("ns") != "") & (F.col("prefix") == ""))
    bare = element & (F.col("ns") == "") & (F.col("prefix") == "") & ~F.map_contains_key("nsdecl", F.lit("")) & F.lit(not as_text)
    pieces = F.sort_array(F.collect_list(F.struct("ord", piece.alias("m"), bare.alias("bare"))))
    grouped = t.groupBy(*keys).agg(F.first("base_uri").alias("base_uri"), default.alias("_default"), pieces.alias("pieces"))
    undone = F.transform("pieces", lambda p: F.when(p["bare"], F.regexp_replace(p["m"], "^<[^ >]+", '$0 xmlns=""')).otherwise(p["m"]))
    doc = F.array_join(F.when(F.col("_default"), undone).otherwise(F.transform("pieces", lambda p: p["m"])), "")
    return grouped.select(*keys, "base_uri", doc.alias("doc"))


def _needed() -> Column:
    """nsdecl with what the element's own namespaces need; a declaration that repeats an outer one is harmless."""
    own = F.create_map(F.col("prefix"), F.col("ns"))
    prefixed = F.filter("attrs", lambda a: (a["ns"] != "") & (a["ns"] != XML_NS))
    of_attrs = F.map_from_entries(F.array_distinct(F.transform(prefixed, lambda a: F.struct(a["prefix"], a["ns"]))))
    mine = F.when(F.col("ns") != "", own).otherwise(F.create_map().cast("map<string,string>"))
    add = F.map_filter(F.map_concat(mine, F.map_filter(of_attrs, lambda k, v: ~F.map_contains_key(mine, k))), lambda k, v: k != "xml")
    kept = F.map_filter("nsdecl", lambda k, v: ~F.map_contains_key(add, k))
    return F.when(F.col("kind") == "open", F.map_concat(kept, add)).otherwise(F.col("nsdecl"))


def canonical(tokens: DataFrame) -> DataFrame:
    """iter, pos, digest: equal for documents that are deep-equal.

    The order of attributes, prefixes, comments and processing instructions do
    not count; white space does. Adjacent text is one text.
    """
    attrs = F.array_join(F.transform(F.array_sort(F.transform("attrs", lambda a: F.struct(a["ns"], a["local"], a["value"]))), lambda a: F.concat(F.lit("{"), a["ns"], F.lit("}"), a["local"], F.lit("="), escape_attribute(a["value"]), F.lit(";"))), "")
    piece = F.when(F.col("kind") == "open", F.concat(F.lit("<{"), F.col("ns"), F.lit("}"), F.col("local"), F.lit(" "), attrs, F.lit(">"))).when(F.col("kind") == "close", F.lit("</>")).otherwise(escape_text(F.col("value")))
    kept = tokens.filter(F.col("kind").isin("open", "close", "text")).select("iter", "pos", "ord", piece.alias("m"))
    pieces = F.sort_array(F.collect_list(F.struct("ord", "m")))
    grouped = kept.groupBy("iter", "pos").agg(pieces.alias("p"))
    return grouped.select("iter", "pos", F.sha2(F.array_join(F.transform("p", lambda x: x["m"]), ""), 256).alias("digest"))
