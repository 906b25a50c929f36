"""Secrets, injected instructions and encoded content in text: found, blocked, flagged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone import registry as R
from siltstone.functions.text import char_entropy

# Patterns of secrets, in the order in which they are replaced.
SECRETS = (
    ("api_key", r"""(?i)(api[_-]?key|apikey)["\s:=]+["']?([a-zA-Z0-9_\-]{20,})["']?"""),
    ("aws_access_key", r"AKIA[0-9A-Z]{16}"),
    ("aws_secret", r"""(?i)(aws[_-]?secret|secret[_-]?key)["\s:=]+["']?([a-zA-Z0-9/+=]{40})["']?"""),
    ("github_token", r"gh[pousr]_[A-Za-z0-9_]{36,}"),
    ("generic_secret", r"""(?i)(token|secret|password|passwd|pwd)["\s:=]+["']?([^\s"']{8,})["']?"""),
    ("bearer_token", r"(?i)bearer\s+[a-zA-Z0-9_\-\.]+"),
    ("jwt_token", r"eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*"),
    ("private_key", r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----"),
    ("connection_string", r"(?i)(mongodb|postgres|mysql|redis)://[^:]+:[^@]+@"),
)
# What a text with a secret of that kind holds, as it stands (True) or in small letters. A search for it costs far less than
# the pattern. Of the letters that case folding also makes of others (k, s, i) only k is in these, which the Kelvin sign becomes in small letters.
_SIGNS = {
    "api_key": (False, "key"), "aws_access_key": (True, "AKIA"), "aws_secret": (False, "ecret"), "github_token": (True, "gh"), "generic_secret": (False, "token", "ecret", "word", "wd"),
    "bearer_token": (False, "bearer"), "jwt_token": (True, "eyJ"), "private_key": (True, "-----BEGIN"), "connection_string": (False, "://"),
}
# Patterns of injected instructions.
INJECTIONS = (
    ("override_instructions", r"(?i)\bignore\s+(all\s+)?(previous|prior|above|earlier|your|my)\s+instructions?\b"),
    ("disregard_instructions", r"(?i)\bdisregard\s+(all\s+)?(previous|prior|above|earlier|your)\s+instructions?\b"),
    ("forget_instructions", r"(?i)\bforget\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|context|rules?)\b"),
    ("override_rules", r"(?i)\boverride\s+(your\s+)?(instructions?|rules?|guidelines?|constraints?|safety|alignment)\b"),
    ("replace_instructions", r"(?i)\byour\s+(new|real|true|actual|updated)\s+instructions?\s*(are\s*:|:|\bfollow\b)"),
    ("new_instructions", r"(?i)\bnew\s+instructions?\s*(:|are|follow)\b"),
    ("system_bracket_tag", r"(?i)\[\s*(SYSTEM|INST|SYS|INSTRUCTION|PROMPT|OPERATOR)\s*\]"),
    ("system_angle_tag", r"(?i)<\s*(SYSTEM|INST|SYS|INSTRUCTION|PROMPT)\s*>"),
    ("system_prompt_label", r"(?i)\bSYSTEM\s+(PROMPT|MESSAGE|INSTRUCTION|CONTEXT)\s*:"),
    ("markdown_system_header", r"(?im)^#+\s*(SYSTEM|INSTRUCTION|PROMPT)\s*$"),
    ("identity_hijack", r"(?i)\byou\s+are\s+now\s+(a\s+|an\s+)?(different|unrestricted|unfiltered|jailbroken|evil|rogue|uncensored)\b"),
    ("act_as_malicious", r"(?i)\bact\s+as\s+(a\s+|an\s+)?(jailbroken|unfiltered|unrestricted|evil|malicious|rogue|uncensored)\b"),
    ("pretend_jailbreak", r"(?i)\bpretend\s+(you\s+are|to\s+be)\s+(a\s+|an\s+)?(different|jailbroken|unfiltered|evil|uncensored)\b"),
    ("from_now_on_override", r"(?i)\bfrom\s+now\s+on[,\s]+(you\s+)?(will|must|shall|should|are\s+to)\s+(ignore|forget|disregard|follow\s+new)\b"),
    ("dan_jailbreak", r"(?i)\bDAN\b(?=\s*(mode|prompt|jailbreak|enabled|activated|is|:))"),
    ("developer_mode_unlock", r"(?i)\bdeveloper\s+mode\s+(enabled|activated|on|unlock)\b"),
    ("jailbreak_trigger", r"(?i)\bjailbreak(ed)?\s+(mode|claude|gpt|llm|ai|prompt)\b"),
    ("do_anything_now", r"(?i)\bdo\s+anything\s+now\b"),
    ("stan_jailbreak", r"(?i)\bSTAN\s+mode\b"),
    ("exfiltrate_prompt", r"(?i)\b(reveal|output|print|repeat|show|leak|expose|dump)\s+(your\s+)?(system\s+)?(prompt|instructions?|rules?|guidelines?|training)\b"),
    ("repeat_context", r"(?i)\brepeat\s+(everything|all(\s+the\s+text)?)\s+(above|before|prior|earlier)\b"),
    ("probe_system_prompt", r"(?i)\bwhat\s+(are\s+your|is\s+your)\s+(instructions?|system\s+prompt|rules?|directives?)\b"),
    ("ignore_context_above", r"(?i)\bignore\s+(everything|all(\s+the\s+text)?)\s+(above|before|prior|earlier)\b"),
    ("encoded_instruction", r"(?i)\bdecode\s+(this|the\s+following|base64)\s+and\s+(execute|follow|run|perform|obey)\b"),
    ("role_delimiter_injection", r"(?im)^(human|user|assistant|ai|claude|gpt)\s*:\s*ignore\b"),
    ("code_block_system_injection", r"(?i)```\s*(system|instruction|prompt)\b"),
)
# Words that make a literal an instruction; the first of the list that occurs decides.
IMPERATIVES = (
    "AI:", "ASSISTANT:", "SYSTEM:", "USER:", "IMPORTANT:", "INSTRUCTION:", "IGNORE PREVIOUS", "IGNORE ALL", "DISREGARD", "NEW INSTRUCTION",
    "OVERRIDE", "YOU MUST", "YOU SHOULD", "YOU ARE", "ACT AS", "PRETEND", "ROLEPLAY", "FROM NOW ON", "DO NOT", "ALWAYS ", "NEVER ",
    "<|", "|>", "```system", "```assistant",
)
# Marks of encoded content.
SUSPICIOUS = (
    ("base64-like-block", r"[a-zA-Z0-9+/=]{100,}"),
    ("hex-encoded-data", r"(?:\\x[0-9a-fA-F]{2}){20,}"),
    ("url-encoded-data", r"(?:%[0-9a-fA-F]{2}){20,}"),
    ("long-unbroken-string", r"[^\s]{500,}"),
)
LITERAL_CHARS, LITERAL_KEPT = 5_000, 500


def _unicode(pattern: str) -> str:
    """The pattern for an engine whose classes are ASCII unless told otherwise: white space and word borders are Unicode's."""
    return f"(?U){pattern}"


def found(text: Column, patterns: tuple[tuple[str, str], ...], least: int = 0) -> Column:
    """Names of the patterns that occur in texts of at least so many characters, in order."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(_unicode(p)), F.lit(n)) for n, p in patterns]))
    return F.when(F.length(text) >= least, hits).otherwise(F.array().cast("array<string>"))


def has_secret(text: Column) -> Column:
    """Whether a text of at least eight characters holds any secret. Where no pattern matches the text as it is, none matches later in the chain."""
    low = F.lower(text)

    def hit(name: str, pattern: str) -> Column:
        exact, *signs = _SIGNS[name]
        return reduce(lambda a, b: a | b, [(text if exact else low).contains(x) for x in signs]) & text.rlike(_unicode(pattern))

    return (F.length(text) >= 8) & reduce(lambda a, b: a | b, [hit(*p) for p in SECRETS])


def redact_secrets(text: Column) -> Column:
    """Every secret as [REDACTED:kind]; a later pattern sees what earlier ones left."""
    out = reduce(lambda t, p: F.regexp_replace(t, _unicode(p[1]), f"[REDACTED:{p[0]}]"), SECRETS, text)
    return F.when(has_secret(text), out).otherwise(text)


def secret_kinds(text: Column) -> Column:
    """Kinds of secrets in the order in which redaction meets them."""
    kinds, t = [], text
    for name, pattern in SECRETS:
        kinds.append(F.when(t.rlike(_unicode(pattern)), F.lit(name)))
        t = F.regexp_replace(t, _unicode(pattern), f"[REDACTED:{name}]")
    return F.when(has_secret(text), F.array_compact(F.array(*kinds))).otherwise(F.array().cast("array<string>"))


def injection_kinds(text: Column) -> Column:
    return found(text, INJECTIONS, 10)


def block_injections(text: Column) -> Column:
    """Every occurrence of what a pattern matched first as [INJECTION_BLOCKED:name]; all matches are taken before any replacement."""
    out = text
    for name, pattern in INJECTIONS:
        # where nothing matches the search string is empty, and replacing it changes nothing
        out = F.replace(out, F.regexp_extract(text, _unicode(pattern), 0), F.lit(f"[INJECTION_BLOCKED:{name}]"))
    return F.when(F.length(text) >= 10, out).otherwise(text)


def clean(text: Column) -> Column:
    return block_injections(redact_secrets(text))


def clean_items(items: Column) -> Column:
    return F.transform(items, clean)


def mask(value: Column) -> Column:
    """A value that must not be seen at all: its length only."""
    return F.concat(F.lit("[REDACTED:"), F.length(value), F.lit("chars]"))


def filter_literal(text: Column) -> Column:
    """Literals of code: cut before the first imperative of the list that occurs, or shortened when very long."""
    up = F.upper(text)
    long = F.concat(F.substring(text, 1, LITERAL_KEPT), F.lit("[TRUNCATED:"), F.length(text), F.lit(" chars]"))
    out = F.when(F.length(text) > LITERAL_CHARS, long).otherwise(text)
    for p in reversed(IMPERATIVES):
        at = F.instr(up, F.lit(p.upper()))
        out = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit("[FILTERED:IMPERATIVE]"))).otherwise(out)
    return out


def suspicious(text: Column) -> Column:
    return found(text, SUSPICIOUS)


def content_safety(text: Column) -> Column:
    """Struct of status and text: cut when too long, else marked when of high entropy, else when it looks encoded."""
    n, entropy, marks = F.length(text), char_entropy(text), suspicious(text)
    cut = F.concat(F.substring(text, 1, R.FIELD_CHARS), F.lit("[TRUNCATED:"), n, F.lit("]"))
    high = F.concat(F.lit("[HIGH_ENTROPY:"), F.format_string("%.2f", entropy), F.lit("] "), F.substring(text, 1, 1_000), F.lit("[..."), n, F.lit(" chars]"))
    flagged = F.concat(F.lit("[SUSPICIOUS:"), F.array_join(marks, ","), F.lit("] "), text)
    too_long, too_dense, odd = n > R.FIELD_CHARS, (n > R.ENTROPY_CHARS) & (entropy > R.ENTROPY_HIGH), F.size(marks) > 0
    return F.struct(
        F.when(too_long, "truncated").when(too_dense, "high_entropy").when(odd, "suspicious").otherwise("ok").alias("status"),
        F.when(too_long, cut).when(too_dense, high).when(odd, flagged).otherwise(text).alias("text"),
    )


def hide_credentials(url: Column) -> Column:
    return F.regexp_replace(url, "//[^/@]*:[^/@]*@", "//")
