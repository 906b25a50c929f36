"""Configuration files: keys, nested paths, environment variables, URLs, hosts and database strings."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Schemes of database strings, in the order of the result.
SCHEMES = ("postgresql", "postgres", "mysql", "mongodb", "redis", "sqlite", "mssql")
_ENV = re.compile(r"\$\{([^}]+)\}")
_ENV_BARE = re.compile(r"\$(?:\{([^}]+)\}|([A-Za-z_]\w*))")
_NAMES = ("toplevel_keys", "parameter_names", "nested_paths", "env_vars")
FIELDS = StructType([StructField("format", StringType()), *[StructField(n, ArrayType(StringType())) for n in _NAMES]])


def _distinct(items: list[str]) -> list[str]:
    return list(dict.fromkeys(items))


def json_fields(text: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """Top-level keys, distinct keys, nested paths and ${variables} of string members; nothing for text that isn't JSON."""
    try:
        root = json.loads(text)
    except ValueError:
        return [], [], [], []
    keys: list[str] = []
    paths: list[str] = []
    env: list[str] = []
    stack = [("", None, root)]
    while stack:  # depth first, in the order of the text
        at, key, value = stack.pop()
        if key is not None:
            keys.append(key)
            paths.append(at)
            if isinstance(value, str):
                env += _ENV.findall(value)
        if isinstance(value, dict):
            stack += [(f"{at}.{k}" if at else k, k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(f"{at}[{i}]", None, v) for i, v in reversed(list(enumerate(value)))]
    return list(root) if isinstance(root, dict) else [], _distinct(keys), paths, _distinct(env)


def jsonl_fields(text: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """The fields of the first line that is JSON."""
    for line in text.split("\n"):
        if line.strip():
            try:
                json.loads(line)
            except ValueError:
                continue
            return json_fields(line)
    return [], [], [], []


def yaml_fields(text: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """By lines: the key before the first colon, unless the line starts with a dash; without indent it is a top-level key."""
    top, keys, env = [], [], []
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        env += [a or b for a, b in _ENV_BARE.findall(bare)]
        if ":" in bare and not bare.startswith("-"):
            key = bare.split(":", 1)[0].strip()
            keys.append(key)
            if line[:1] not in (" ", "\t"):
                top.append(key)
    return _distinct(top), _distinct(keys), [], _distinct(env)


def toml_fields(text: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """By lines: [a.b] gives the top-level key a, ``k = v`` the parameter k."""
    top, keys, env = [], [], []
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        env += [a or b for a, b in _ENV_BARE.findall(bare)]
        if bare.startswith("[") and bare.endswith("]"):
            top.append(bare[1:-1].split(".")[0].strip("[]").strip())
        elif "=" in bare:
            keys.append(bare.split("=", 1)[0].strip())
    return _distinct(top), _distinct(keys), [], _distinct(env)


def xml_fields(text: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """Paths a.b and a[@x] of elements and attributes; nothing for text that isn't well-formed."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return [], [], [], []
    keys, paths = [], []
    stack = [(root.tag, root)]
    while stack:
        at, e = stack.pop()
        keys.append(e.tag)
        paths += [at, *(f"{at}[@{a}]" for a in e.attrib)]
        stack += [(f"{at}.{c.tag}", c) for c in reversed(list(e))]
    return [c.tag for c in root], _distinct(keys), _distinct(paths), _distinct(_ENV.findall(text))


def xml_class(text: str) -> str:
    """doc, data or config: by the elements' names, and by whether records of one name follow each other; text when not well-formed."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return "text"
    words = {"article", "book", "chapter", "section", "document", "html", "para", "p"}
    if root.tag.lower() in words or any(c.tag.lower() in words for c in root):
        return "doc"
    tags = [c.tag for c in root]
    return "data" if len(tags) >= 2 and len(set(tags)) < len(tags) else "config"


_READ = {"json": json_fields, "jsonl": jsonl_fields, "yaml": yaml_fields, "toml": toml_fields, "xml": xml_fields}


@F.pandas_udf(FIELDS)
def config_fields(text: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """Struct of the fields of each text, read in its format; other formats and nulls have empty ones."""
    rows = []
    for t, k in zip(text, kind, strict=True):
        top, keys, paths, env = _READ[k](t) if t is not None and k in _READ else ([], [], [], [])
        rows.append((k, top, keys, paths, env))
    return pd.DataFrame(rows, columns=["format", *_NAMES])


def urls(text: Column) -> Column:
    """Everything from http:// or https:/ to a quote, line end or space; URLs within URLs too."""
    return F.regexp_extract_all(text, F.lit(r"""(?=((?:http://|https:/)[^"'\n ]*))"""), F.lit(1))


def hosts(found: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_extract(u, "//([^/?#]*)", 1)), lambda h: h != ""))


def database_strings(text: Column) -> Column:
    """Connection strings by scheme in a fixed order; a password is shown as three stars."""
    each = [F.regexp_extract_all(text, F.lit(rf"""(?<![A-Za-z])({s}://[^\s"']+)"""), F.lit(1)) for s in SCHEMES]
    return F.transform(F.array_distinct(F.concat(*each)), lambda s: F.regexp_replace(s, r"(://[^:/@]*):[^@]*@", "$1:***@"))
