"""The steps' cases in fixtures/*.json, a file a step: happy path, no match, namespaces, empty sequence, sequence of three, errors.

The cases of a step that give documents run together: each is an iteration of
one sequence, so they also show that steps keep iterations apart. Documents are
compared in canonical form, where a namespace declared again is not another
document.
"""

import json
from collections import defaultdict
from pathlib import Path
from xml.etree.ElementTree import canonicalize

import pytest
from pyspark.sql import functions as F

from seqloom.functions.errors import code_of
from seqloom.operators import match as M
from seqloom.operators import rewrite as R
from seqloom.operators import sequence as S
from seqloom.sources.files import inline
from seqloom.sources.xml import parse, serialize

FILES = sorted((Path(__file__).parent / "fixtures").glob("*.json"))


def condition(o):
    named = {"text()": M.text(), "comment() or pi()": M.comment() | M.pi()}
    return named[o["match"]] if o["match"] in named else M.element(o["match"], o.get("ns"))


def sequence(spark, docs_by_iter):
    return spark.createDataFrame([(i, k, None, d) for i, docs in docs_by_iter.items() for k, d in enumerate(docs)], "iter bigint, pos bigint, base_uri string, doc string")


def canonical(docs):
    return [canonicalize(d, with_comments=True) if d.startswith("<") else d for d in docs]


def on_tokens(f):
    return lambda spark, seq, o: serialize(f(spark, parse(seq), o))


def selected(spark, seq, o):
    return S.input_select(seq, condition(o))


def counted(spark, seq, o):
    if not isinstance(o.get("limit", 0), int):
        return S.count(seq, o["limit"])
    asked = spark.createDataFrame([(i,) for i in o["_iters"]], "iter bigint")
    return S.count_each(seq, asked, o.get("limit", 0)).select("iter", F.lit(0).alias("pos"), F.col("result").cast("string").alias("doc"))


def wrapped(spark, seq, o):
    key = F.regexp_extract("doc", ">(.*)<", 1) if o.get("adjacent") else None
    return S.wrap_sequence(seq, o["new"], key, iterations=None if key is not None else spark.createDataFrame([(i,) for i in o["_iters"]], "iter bigint"))


STEPS = {
    "delete": on_tokens(lambda s, t, o: R.delete(t, condition(o))),
    "rename": on_tokens(lambda s, t, o: R.rename(t, condition(o), o["new"])),
    "add-attribute": on_tokens(lambda s, t, o: R.add_attribute(t, condition(o), o["new"], o["value"])),
    "unwrap": on_tokens(lambda s, t, o: R.unwrap(t, condition(o))),
    "wrap": on_tokens(lambda s, t, o: R.wrap(t, condition(o), o["new"])),
    "insert": on_tokens(lambda s, t, o: R.insert(t, condition(o), parse(inline(s, o["argument"])), o["position"])),
    "replace": on_tokens(lambda s, t, o: R.replace(t, condition(o), parse(inline(s, o["argument"])))),
    "string-replace": on_tokens(lambda s, t, o: R.string_replace(t, condition(o), o["value"])),
    "label-elements": on_tokens(lambda s, t, o: R.label_elements(t, condition(o), o["new"])),
    "filter": selected,
    "count": counted,
    "wrap-sequence": wrapped,
    "pack": lambda s, seq, o: S.pack(seq, sequence(s, {i: o["other"] for i in o["_iters"]}), o["new"]),
}


@pytest.mark.parametrize("path", FILES, ids=[p.stem for p in FILES])
def test_step(spark, path):
    step, cases = STEPS[path.stem], json.loads(path.read_text())
    by_options = defaultdict(list)
    for c in cases:
        if "error" in c:
            with pytest.raises(Exception) as x:
                step(spark, sequence(spark, {0: c["inputs"]}), c["options"] | {"_iters": [0]}).collect()
            assert code_of(x.value) == c["error"], c["name"]
        else:
            by_options[json.dumps(c["options"])].append(c)
    for options, group in by_options.items():
        seq = sequence(spark, dict(enumerate(c["inputs"] for c in group)))
        got = defaultdict(list)
        for r in step(spark, seq, json.loads(options) | {"_iters": list(range(len(group)))}).orderBy("iter", "pos").collect():
            got[r.iter].append(r.doc)
        assert {c["name"]: canonical(got[i]) for i, c in enumerate(group)} == {c["name"]: canonical(c["outputs"]) for c in group}
