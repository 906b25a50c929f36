"""Fields of source code: Python by its syntax tree, other languages by patterns."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

_LIST = "modules from_files external internal functions classes constants types names signatures async decorators inheritance methods properties interfaces method_signatures docstring depends_on bodies calls instantiates constant_values".split()
FIELDS = StructType([StructField("language", StringType()), StructField("loc", LongType()), StructField("package", StringType()), *[StructField(f, ArrayType(StringType())) for f in _LIST]])
# Modules that count as external though not dotted, and names of languages by extension.
_STANDARD = ("os", "sys", "json", "typing")
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "java": "java", "go": "go", "rs": "rust", "cpp": "cpp", "c": "c", "cs": "c_sharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala"}


def _empty(language: str, text: str) -> dict:
    return {"language": language, "loc": len(text.splitlines()), "package": ""} | {f: [] for f in _LIST}


def python_fields(text: str) -> dict:
    """Imports, functions, classes and constants of a Python module; empty lists where it doesn't parse."""
    out = _empty("python", text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out
    classes = {c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef)}
    methods = {id(f) for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                out["modules"].append(a.name)
                out["external" if "." in a.name or a.name in _STANDARD else "internal"].append(a.name)
        elif isinstance(node, ast.ImportFrom):
            name = "." * node.level + (node.module or "")
            out["modules"].append(name)
            out["from_files"] += [f"{name}.{a.name}" for a in node.names]
            out["internal" if node.level else "external"].append(name)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            arguments = ", ".join(a.arg for a in node.args.args)
            marks = [ast.unparse(d) for d in node.decorator_list]
            if id(node) in methods:
                out["methods"].append(node.name)
                out["method_signatures"].append(f"{node.name}({arguments})")
            else:
                out["names"].append(node.name)
                out["signatures"].append(f"{node.name}({arguments})")
                out["decorators"] += marks
            if isinstance(node, ast.AsyncFunctionDef):
                out["async"].append(node.name)
            if node.name == "__init__":
                for x in ast.walk(node):
                    if isinstance(x, ast.Attribute) and isinstance(x.ctx, ast.Store) and isinstance(x.value, ast.Name) and x.value.id == "self":
                        out["properties"].append(x.attr)
            out["bodies"].append(ast.get_source_segment(text, node) or "")
        elif isinstance(node, ast.Call):
            name = ast.unparse(node.func) if isinstance(node.func, ast.Name | ast.Attribute) else ""
            if re.fullmatch(r"[\w.]+", name):
                last = name.rsplit(".", 1)[-1]
                out["instantiates" if last in classes or re.match(r"[A-Z][a-z\d]*[a-z]", last) else "calls"].append(name)
        elif isinstance(node, ast.ClassDef):
            out["classes"].append(node.name)
            out["inheritance"] += [ast.unparse(b) for b in node.bases]
            if doc := ast.get_docstring(node):
                out["docstring"].append(doc.split("\n")[0][:200])
    for node in tree.body:
        if isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, ast.Name) and t.id.isupper():
                    out["constants"].append(t.id)
                    out["constant_values"].append(f"{t.id} = {ast.unparse(node.value)}")
    out["functions"] = [n for n in out["names"] if not n.startswith("_")]
    return _done(out)


def _done(out: dict) -> dict:
    for f in _LIST:
        out[f] = list(dict.fromkeys(out[f]))
    out["depends_on"] = out["modules"]
    return out


_SCRIPT = dict(
    modules=r"""(?m)^\s*import\b[^'"\n]*['"]([^'"]+)|require\(\s*['"]([^'"]+)""", names=r"(?m)\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)", classes=r"\bclass\s+([A-Za-z_$][\w$]*)",
    inheritance=r"\bclass\s+[\w$]+(?:<[^>]*>)?\s+extends\s+([\w$.]+)", async_=r"\basync\s+function\s+([A-Za-z_$][\w$]*)", methods=r"(?m)^\s+(?:async\s+|static\s+)*([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{",
)
_CLASSIC = dict(classes=r"\b(?:class|interface|enum)\s+([A-Za-z_]\w*)", inheritance=r"\bextends\s+([\w.]+)", interfaces=r"\bimplements\s+([\w.]+)")
#: What stands for what in each language; the first group that took part is the value.
PATTERNS: dict[str, dict[str, str]] = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT | dict(interfaces=r"\binterface\s+(\w+)", types=r"(?m)^\s*(?:export\s+)?(?:type|interface)\s+(\w+)"),
    "tsx": _SCRIPT,
    "go": dict(package=r"(?m)^package\s+(\w+)", modules=r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$""", names=r"(?m)^func\s+(\w+)", methods=r"(?m)^func\s+\([^)]*\)\s*(\w+)", classes=r"(?m)^type\s+(\w+)\s+struct"),
    "java": _CLASSIC | dict(package=r"(?m)^\s*package\s+([\w.]+)", modules=r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)", methods=r"(?m)^\s+(?:[\w<>\[\],]+\s+)+(\w+)\s*\([^)]*\)[^;{]*\{"),
    "rust": dict(modules=r"(?m)^\s*use\s+([^;]+)", names=r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", classes=r"\b(?:struct|enum|trait)\s+(\w+)", async_=r"\basync\s+fn\s+(\w+)"),
    "c": dict(modules=r"""(?m)^\s*#\s*include\s*[<"]([^>"]+)""", names=r"(?m)^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*\)\s*\{", classes=r"\bstruct\s+(\w+)\s*\{"),
    "cpp": dict(modules=r"""(?m)^\s*#\s*include\s*[<"]([^>"]+)""", names=r"(?m)^[A-Za-z_][\w\s*:&<>]*?\b(\w+)\s*\([^;]*\)\s*(?:const\s*)?\{", classes=r"\b(?:class|struct)\s+(\w+)\s*[:{]", inheritance=r"\bclass\s+\w+\s*:\s*(?:public|private|protected)?\s*(\w+)"),
    "c_sharp": _CLASSIC | dict(package=r"\bnamespace\s+([\w.]+)", modules=r"(?m)^\s*using\s+([\w.]+)\s*;", inheritance=r"\bclass\s+\w+\s*:\s*(\w+)", methods=r"(?m)^\s+(?:[\w<>\[\],]+\s+)+(\w+)\s*\([^)]*\)\s*\{"),
    "ruby": dict(modules=r"""(?m)^\s*require(?:_relative)?\s+['"]([^'"]+)""", names=r"(?m)^\s*def\s+(?:self\.)?([\w?!]+)", classes=r"(?m)^\s*(?:class|module)\s+([\w:]+)", inheritance=r"(?m)^\s*class\s+\w+\s*<\s*([\w:]+)"),
    "php": _CLASSIC | dict(package=r"(?m)^\s*namespace\s+([\w\\]+)", modules=r"(?m)^\s*use\s+([\w\\]+)", names=r"\bfunction\s+(\w+)"),
    "swift": dict(modules=r"(?m)^\s*import\s+(\w+)", names=r"\bfunc\s+(\w+)", classes=r"\b(?:class|struct|enum|protocol)\s+(\w+)", inheritance=r"\bclass\s+\w+\s*:\s*(\w+)"),
    "kotlin": dict(package=r"(?m)^\s*package\s+([\w.]+)", modules=r"(?m)^\s*import\s+([\w.*]+)", names=r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)", classes=r"\b(?:class|interface|object)\s+(\w+)", async_=r"\bsuspend\s+fun\s+(\w+)"),
    "scala": _CLASSIC | dict(package=r"(?m)^\s*package\s+([\w.]+)", modules=r"(?m)^\s*import\s+([\w.{}, ]+)", names=r"\bdef\s+(\w+)", classes=r"\b(?:class|trait|object)\s+(\w+)", inheritance=r"\bextends\s+(\w+)"),
}
_KEYWORDS = frozenset("if for while switch catch return else do function new sizeof match".split())
_COMMENTS = re.compile(r"/\*.*?\*/|(?m:^\s*//.*$)", re.S)


def generic_fields(text: str, language: str) -> dict:
    """The same fields by patterns: approximate, since nothing is parsed. Comments of C's kind are left out."""
    out = _empty(language, text)
    code = text if language == "ruby" else _COMMENTS.sub(" ", text)
    for field, pattern in PATTERNS.get(language, {}).items():
        found = [next((g for g in m.groups() if g), "").strip() for m in re.finditer(pattern, code)]
        found = [x for x in found if x and x not in _KEYWORDS]
        if field == "package":
            out["package"] = found[0] if found else ""
        else:
            out[field.rstrip("_")] += found
    out["external"] = [m for m in out["modules"] if not m.startswith(".")]
    out["internal"] = [m for m in out["modules"] if m.startswith(".")]
    out["functions"] = out["names"]
    return _done(out)


def fields_of(text: str | None, extension: str | None) -> dict:
    language = LANGUAGES.get((extension or "").lower(), (extension or "").lower())
    return python_fields(text or "") if language == "python" else generic_fields(text or "", language)


@F.pandas_udf(FIELDS)
def code_fields(text: pd.Series, extension: pd.Series) -> pd.DataFrame:
    """Struct of the fields of each source file, by its extension. Unknown languages have line counts only."""
    return pd.DataFrame([fields_of(t, e) for t, e in zip(text, extension, strict=True)], columns=["language", "loc", "package", *_LIST])


def depended_by(dependencies, file_col: str = "source_file", module_col: str = "module"):
    """(file, depended_by): for each file the files that name it as a module, by its path without extension with dots for slashes."""
    own = dependencies.select(F.col(file_col).alias("target"), F.regexp_replace(F.regexp_replace(F.col(file_col), r"\.[^./]*$", ""), "/", ".").alias("as_module")).distinct()
    found = own.join(dependencies, own["as_module"] == dependencies[module_col])
    return found.groupBy("target").agg(F.array_sort(F.collect_set(file_col)).alias("depended_by"))
