"""Rules for paths, names, hosts and URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone import registry as R

# Extensions by route.
CODE = "py ts tsx js jsx java go rs cpp c cs rb php swift kt scala nim".split()
DOC = "pdf txt md docx html htm rtf".split()
CSV = "csv tsv jsonl".split()
CONFIG = "json yaml yml xml toml".split()
# Globs of what is never read.
IGNORED = (
    ".git .svn .hg .bzr node_modules __pycache__ .venv venv env .env-* vendor target build dist .gradle Pods .expo .next .nuxt .svelte-kit "
    ".pytest_cache .tox coverage .cache __snapshots__ .env .env.* *.env *.pem *.key *.pfx *.p12 *.p8 *.ppk *.jks *.keystore *.crt *.cer *.der "
    ".ssh .gnupg id_rsa id_ecdsa id_ed25519 id_dsa *_rsa *_ecdsa *_ed25519 .aws .azure .gcloud serviceAccountKey.json *service_account*.json "
    "*credentials*.json .npmrc .pypirc .netrc .htpasswd *.token *.password credentials credentials.* secrets secrets.* .vscode .idea .vs "
    "*.swp *.swo *~ .project .settings .DS_Store Thumbs.db desktop.ini *.pyc *.pyo *.class *.o *.obj *.so *.dll *.dylib *.min.js *.min.css *.log logs *.db *.sqlite *.sqlite3 *.bak *.backup *.tmp"
).split()
# Names that no file may have.
RESERVED = "con prn aux nul com1 com2 com3 com4 com5 com6 com7 com8 com9 lpt1 lpt2 lpt3 lpt4 lpt5 lpt6 lpt7 lpt8 lpt9".split()
FORBIDDEN = ("..", "\0", "~", ":", "*", "?", '"', "<", ">", "|")


def glob_regex(globs: list[str]) -> str:
    """One pattern for all globs, for a whole string."""
    one = lambda g: "".join({"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or re.escape(c) for c in g)
    return "^(?:" + "|".join(one(g) for g in globs) + ")$"


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty for names without one or with only a leading one."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+\.([^.]+)$", 1))


def ignored(path: Column, globs: list[str] | None = None) -> Column:
    pattern = glob_regex(IGNORED if globs is None else globs)
    return F.exists(F.split(path, "/"), lambda p: p.rlike(pattern)) | path.rlike(pattern)


def field_type(path: Column) -> Column:
    """code, doc, csv or config; null where nothing reads the file."""
    e = extension(path)
    return F.when(e.isin(CODE), "code").when(e.isin(DOC), "doc").when(e.isin(CSV), "csv").when(e.isin(CONFIG), "config")


def parsers(path: Column) -> Column:
    kind = field_type(path)
    both, own = F.array(F.lit("tree_sitter"), F.lit("semgrep")), F.array(F.lit("nim_parser"))
    return F.when(kind == "code", both).when(kind.isNotNull(), own).otherwise(F.array().cast("array<string>"))


# Formats by extension; whatever else is plain text.
FORMATS = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "docx": "docx", "pdf": "pdf", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "xml": "xml", "yaml": "yaml", "yml": "yaml", "toml": "toml"}


def file_format(path: Column) -> Column:
    return F.coalesce(F.create_map([F.lit(x) for kv in FORMATS.items() for x in kv])[extension(path)], F.lit("text"))


def size_problem(path: Column, size: Column) -> Column:
    """too_large, or null. PDF and text formats have limits of their own, but no file may pass the limit for code."""
    e = extension(path)
    own = F.when(e == "pdf", R.PDF_BYTES).when(e.isin("txt", "json", "yaml", "csv"), R.TEXT_BYTES).otherwise(R.CODE_BYTES)
    return F.when((size > own) | (size > R.CODE_BYTES), "too_large")


def project_id_ok(name: Column) -> Column:
    return name.rlike(r"^[a-zA-Z0-9_-]{3,64}$") & ~name.startswith("-") & ~F.lower(name).isin(RESERVED)


def vendor_id_ok(name: Column) -> Column:
    return name.rlike(r"^[a-zA-Z0-9_@.\-]{1,64}$")


def file_name_problem(name: Column) -> Column:
    """Why a name is refused, or null: empty, forbidden, format, empty_part, reserved, hidden, ignored; the first that holds."""
    n = F.regexp_replace(F.regexp_replace(F.trim(name), r"\\", "/"), "^/+|/+$", "")
    parts = F.split(n, "/")
    bad = F.lit(False)
    for token in FORBIDDEN:
        bad = bad | n.contains(token)
    hidden = F.exists(parts, lambda p: p.startswith(".") & ~p.isin(".gitignore", ".gitattributes") & ~F.substring(p, 2, 1 << 30).contains("."))
    return (
        F.when(n.isNull() | (n == ""), "empty").when(bad, "forbidden").when(~n.rlike(r"^[a-zA-Z0-9._-][a-zA-Z0-9._/-]{0,254}$"), "format")
        .when(F.exists(parts, lambda p: p == ""), "empty_part").when(F.exists(parts, lambda p: F.lower(p).isin(RESERVED)), "reserved")
        .when(hidden, "hidden").when(ignored(n), "ignored")
    )


def host(url: Column) -> Column:
    return F.lower(F.rtrim(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(".")))


def private_address(h: Column) -> Column:
    """Literal IPv4 addresses of private, loopback and link-local networks; names aren't resolved."""
    return h.rlike(r"^(127|10)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$")


def host_allowed(h: Column, allowed: list[str]) -> Column:
    """The host, or a domain it belongs to, is on the list."""
    out = F.lit(False)
    for a in allowed:
        a = a.strip().lower().rstrip(".")
        if a:
            out = out | (h == a) | h.endswith("." + a)
    return (h != "") & ~private_address(h) & out


def url_ok(url: Column, allowed: list[str]) -> Column:
    return url.rlike("^https?://") & host_allowed(host(url), allowed)


def git_remote_ok(remote: Column, allowed: list[str]) -> Column:
    ssh = F.lower(F.regexp_extract(remote, r"^git@([^:/]+):.+", 1))
    return F.when(ssh != "", host_allowed(ssh, allowed)).otherwise(url_ok(remote, allowed))


def repo_url_ok(url: Column) -> Column:
    rest = F.regexp_replace(url, "^https://github.com/", "")
    return url.startswith("https://github.com/") & (F.size(F.filter(F.split(rest, "/"), lambda p: p != "")) >= 2)


def content_type_ok(header: Column, allowed: list[str]) -> Column:
    return F.lower(F.trim(F.substring_index(header, ";", 1))).isin([a.lower() for a in allowed])


def project_of_url(url: Column) -> Column:
    """The last part of the path without .git, filled up with underscores to three characters."""
    name = F.regexp_replace(F.regexp_extract(url, r"([^/]*)/*$", 1), r"\.git$", "")
    return F.when(F.length(name) < 3, F.rpad(name, 3, "_")).otherwise(name)


def contained(path: Column, root: Column | str) -> Column:
    """Whether a path stays below ``root`` once its ``.`` and ``..`` parts are followed; null bytes and going above the root are refused."""
    p = F.regexp_replace(path, r"\\", "/")
    r = F.split(F.rtrim(F.lit(root) if isinstance(root, str) else root, F.lit("/")), "/")
    full = F.when(p.startswith("/"), F.split(p, "/")).otherwise(F.concat(r, F.split(p, "/")))
    # a path that climbs above the file system's root collapses to null
    up = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))).otherwise(F.concat(done, F.array(part)))
    flat = F.aggregate(full, F.array().cast("array<string>"), up)
    top = F.filter(r, lambda x: x != "")
    return F.coalesce(~path.contains("\0") & (F.size(flat) >= F.size(top)) & (F.slice(flat, 1, F.greatest(F.size(top), F.lit(1))) == top), F.lit(False))


def relative_path(path: Column, root: Column | str) -> Column:
    """The path below ``root`` with forward slashes; the bare name where it isn't below."""
    p, r = F.regexp_replace(path, r"\\", "/"), F.concat(F.rtrim(F.lit(root) if isinstance(root, str) else root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(p, r), F.substring(p, F.length(r) + 1, F.length(p))).otherwise(name_of(p))
