"""Rule scans over lines of code, and findings by category with their context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    message: str
    pattern: str


#: Rules as patterns over single lines.
RULES = (
    Rule("hardcoded-secret", "WARNING", "Potential hardcoded secret", r"""(?i)\b(password|api_key|secret|token)\s*=\s*["'][^"']+["']"""),
    Rule("sql-concat", "ERROR", "Potential SQL injection via string concatenation", r"""(?i)=\s*["'][^"']*\b(select|insert|update|delete)\b[^"']*["']\s*\+\s*\w"""),
    Rule("eval-exec", "ERROR", "Dangerous code execution", r"\b(eval|exec)\s*\("),
    Rule("command-injection", "ERROR", "Potential command injection", r"os\.system\s*\(|subprocess\.call\s*\(.*shell\s*=\s*True"),
    Rule("weak-crypto", "WARNING", "Weak cryptographic hash function", r"hashlib\.(md5|sha1)\s*\("),
    Rule("todo-comment", "INFO", "TODO or FIXME left in code", r"(?i)\b(todo|fixme)\b"),
)


def scan(files: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES, around: int = 3) -> DataFrame:
    """(id, rule_id, severity, message, line, before, match, after): a row for each line that a rule matches.

    Rules are literals of one expression over the array of lines, so there is no join of rules and
    lines, and each file stays in its task. ``before`` and ``after`` hold up to ``around`` lines.
    """
    lines = F.split(text_col, "\n")
    def of_rule(r: Rule) -> Column:
        def one(x: Column, i: Column) -> Column:
            fields = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"), (i + 1).alias("line"))
            return F.when(x.rlike(r.pattern), fields)

        return F.array_compact(F.transform("lines", one))

    hits = F.flatten(F.array(*map(of_rule, rules)))
    found = files.select(id_col, lines.alias("lines")).select(id_col, "lines", F.explode(hits).alias("f"))
    line = F.col("f.line")
    return found.select(
        id_col, "f.rule_id", "f.severity", "f.message", line.cast("bigint").alias("line"),
        F.slice("lines", F.greatest(line - around, F.lit(1)), F.least(line - 1, F.lit(around))).alias("before"),
        F.get("lines", line - 1).alias("match"), F.slice("lines", line + 1, F.lit(around)).alias("after"),
    )


def category(severity: Column, rule_id: Column, message: Column) -> Column:
    """The field that a finding belongs to, by its severity and what its rule or message speaks of."""
    rule, said = F.lower(rule_id), F.lower(message)

    def names(x: Column, *words: str) -> Column:
        out = x.contains(words[0])
        for w in words[1:]:
            out = out | x.contains(w)
        return out

    serious = (
        F.when(names(rule, "secret", "password", "token"), "hardcoded_secrets").when(names(rule, "sql", "injection"), "sql_injection_risks")
        .when(names(rule, "xss", "cross-site"), "xss_risks").otherwise("vulnerabilities")
    )
    minor = F.when(names(said, "todo", "fixme"), "todos").when(said.contains("deprecated"), "deprecated_usage").when(names(said, "anti", "pattern"), "antipatterns").otherwise("code_smells")
    return F.when(severity.isin("ERROR", "WARNING"), serious).otherwise(minor)


def by_file(files: DataFrame, findings: DataFrame, id_col: str) -> DataFrame:
    """Every file with its findings as an array, in order of line and rule; empty where there are none."""
    each = findings.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("line", "rule_id", "severity"))).alias("findings"))
    none = F.array().cast("array<struct<line:bigint,rule_id:string,severity:string>>")
    return files.join(each, id_col, "left").withColumn("findings", F.coalesce("findings", none))
