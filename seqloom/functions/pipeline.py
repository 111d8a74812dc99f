"""Functions that a pipeline's expressions may call, as columns or constants."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.errors import PipelineError, check
from seqloom.functions.uris import resolve_uri

#: What the processor says of itself.
PROPERTIES = {"episode": "", "language": "en", "product-name": "seqloom", "product-version": "0.1", "vendor": "", "vendor-uri": "", "version": "1.0", "xpath-version": "2.0", "psvi-supported": "false"}


def base_uri() -> Column:
    return F.col("base_uri")


def resolve(relative: Column, base: Column | None = None) -> Column:
    """A reference against a base, by default the document's."""
    return resolve_uri(relative, F.col("base_uri") if base is None else base)


def iteration_position() -> Column:
    return F.col("iter_position")


def iteration_size() -> Column:
    return F.col("iter_size")


#: The names of the steps that the library has.
STEPS = frozenset(
    "add-attribute add-xml-base compare count delete directory-list error escape-markup filter hash identity in-scope-names insert label-elements load make-absolute-uris namespace-rename pack parameters rename replace set-attributes sink split-sequence store string-replace template unescape-markup unwrap uuid validate-with-schematron validate-with-xml-schema wrap wrap-sequence www-form-urldecode www-form-urlencode xinclude "
    "for-each viewport choose group try collection-manager compress eval gunzip gzip java-properties message namespace-delete pretty-print report-errors set-base-uri uncompress unzip until-unchanged uri-info wait-for-update zip copy head info mkdir move tail tempfile touch cwd env".split()
)
_REGISTERED: dict[str, Callable] = {}


def register_step(name: str, step: Callable) -> Callable:
    """Make a function of DataFrames known as a step, by a name with a prefix; a name of the library is XS0036."""
    check(":" in name and name.rpartition(":")[2] not in STEPS and name not in _REGISTERED, "XS0036", name)
    _REGISTERED[name] = step
    return step


def step(name: str) -> Callable:
    """A registered step; an unknown name is XS0044."""
    check(name in _REGISTERED, "XS0044", name)
    return _REGISTERED[name]


def step_available(name: str) -> bool:
    """Whether the library has a step of this name, or one was registered by it."""
    return name in _REGISTERED or name.rpartition(":")[2] in STEPS


def add_properties(values: dict[str, str], prefix: str) -> None:
    """Make a set of properties known under a prefix of their own."""
    check(bool(prefix) and ":" not in prefix, "XD0034", prefix)
    PROPERTIES.update({f"{prefix}:{k}": v for k, v in values.items()})


def system_property(name: str) -> str:
    """A property of the processor, or of an added set; the empty string if it is unknown."""
    return PROPERTIES.get(name, PROPERTIES.get(name.rpartition(":")[2], "") if name.startswith(("p:", "cx:")) or ":" not in name else "")


def value_available(name: str, scope: dict, fail_if_unknown: bool = True) -> bool:
    """Whether an option of the scope has a value; an unknown name is XD0033 unless that is turned off."""
    if name not in scope and fail_if_unknown:
        raise PipelineError("XD0033", name)
    return scope.get(name) is not None


def version_available(version: float) -> bool:
    return float(version) == 1.0


def xpath_version_available(version: float) -> bool:
    return float(version) in (1.0, 2.0)


def cwd() -> str:
    """The driver's working directory as a URI."""
    return f"file://{os.getcwd()}/"


def environment(spark) -> "DataFrame":  # noqa: F821
    """The driver's environment variables as rows."""
    return spark.createDataFrame(sorted(os.environ.items()), "name string, value string")


def os_info(spark) -> "DataFrame":  # noqa: F821
    """Facts about the driver's machine as rows."""
    import getpass
    import platform

    facts = {"os-name": platform.system(), "os-version": platform.release(), "os-architecture": platform.machine(), "file-separator": os.sep, "path-separator": os.pathsep, "user-name": getpass.getuser(), "user-dir": os.getcwd()}
    return spark.createDataFrame(sorted(facts.items()), "name string, value string")


def typed(value: str, kind: str):
    """A value checked as a type: boolean, integer, double, string, or a|b|c; another value is XD0045."""
    try:
        if "|" in kind:
            if value not in kind.split("|"):
                raise ValueError(value)
            return value
        if kind == "boolean":
            return {"true": True, "1": True, "false": False, "0": False}[value]
        return {"integer": int, "double": float, "string": str}[kind](value)
    except (KeyError, ValueError):
        raise PipelineError("XD0045", f"{value!r} is not {kind}") from None
