"""Words, lines, entropy and other measures of text; the compact text form."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from siltstone.functions.batches import by_value

#: A word: letters, digits and underscores of any script.
WORD = r"([\p{L}\p{N}_]+)"

# Words that the compact form replaces by a number, counted from 1.
FILLERS = (
    "a an the thee and or but nor so yet of in to for on at by from with as into onto upon about above below between through during "
    "before after over under within without along across it its this that these those they them their we our us he she his her him i "
    "me my you your is are was were be been being have has had do does did will would shall should may might must can could what when "
    "where which who whom whose why how not no if then than also just each all any both few more most some such too very same other "
    "only own up out off down again further once here there am get got let"
).split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def shingles(words: Column, n: int = 3) -> Column:
    """The set of runs of n words; of fewer words the set of words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.when(F.size(words) >= n, runs).otherwise(words))


def lines_of_code(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S")))


def size_tag(field_type: Column, text: Column) -> Column:
    """rejected, potential_god, large or normal: code by its lines, other files by their bytes."""
    from siltstone import registry as R

    loc, size = lines_of_code(text), F.octet_length(text)

    def tag(x: Column, soft: int, god: int, hard: int) -> Column:
        return F.when(x >= hard, "rejected").when(x >= god, "potential_god").when(x >= soft, "large").otherwise("normal")

    return F.when(field_type == "code", tag(loc, R.LOC_SOFT, R.LOC_GOD, R.LOC_HARD)).otherwise(tag(size, R.BYTES_SOFT, R.BYTES_GOD, R.BYTES_HARD))


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum() if counts.sum() else np.ones(1)
    return float(-(p * np.log2(p)).sum()) + 0.0


def entropy(data: bytes) -> float:
    """Shannon entropy of the bytes, 0 to 8; 0 for none."""
    return _entropy(np.bincount(np.frombuffer(data, np.uint8), minlength=256))


@by_value(DoubleType(), pa.float64())
def byte_entropy(text: str) -> float:
    """Shannon entropy of the UTF-8 bytes, 0 to 8; 0 for empty, null for null."""
    return entropy(text.encode())


@by_value(DoubleType(), pa.float64())
def char_entropy(text: str) -> float:
    """Entropy of the characters by the most their number allows (256 kinds at most), 0 to 1; 0 of a single kind."""
    counts = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1]
    return float(_entropy(counts) / np.log2(min(len(counts), 256))) if len(counts) > 1 else 0.0


@by_value(DoubleType(), pa.float64())
def zlib_ratio(text: str) -> float:
    """Compressed size by size, at zlib's level 1; 0 for empty."""
    return len(zlib.compress(text.encode(), 1)) / len(text.encode()) if text else 0.0


def share(text: Column, but: str) -> Column:
    """Share of the bytes that are ASCII characters of a class, the class given by what isn't in it."""
    n = F.octet_length(text)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, but, "")) / n)


def content_weights(text: Column) -> dict[str, Column]:
    alpha, digit, space = share(text, "[^A-Za-z]"), share(text, "[^0-9]"), share(text, "[^ \n\t]")
    return {"alpha": alpha, "digit": digit, "symbol": F.when(F.octet_length(text) == 0, 0.0).otherwise(1 - alpha - digit - space), "space": space}


def content_type(text: Column) -> Column:
    """visual, table, text or unknown, by entropy, character classes, and what looks like rows."""
    w = content_weights(text)
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1

    def per_line(c: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / n_lines

    rows = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x).rlike("[0-9]$") & (F.octet_length(F.trim(x)) < 60))
    return (
        F.when(byte_entropy(text) > 7, "visual")
        .when((w["alpha"] < 0.2) & (w["symbol"] > 0.3), "visual")
        .when((w["digit"] > 0.25) & (w["symbol"] > 0.15), "table")
        .when((n_lines > 2) & ((per_line("|") > 1.5) | (per_line("\t") > 1.5)), "table")
        .when(F.size(rows) / n_lines > 0.5, "table")
        .when(w["alpha"] > 0.5, "text")
        .otherwise("unknown")
    )


def complexity(text: Column) -> dict[str, Column]:
    """entropy, compression_ratio, avg_line_length, whitespace_ratio, score, is_complex and route of a file's text."""
    n = F.octet_length(text)
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    entropy, ratio, line, blank = byte_entropy(text), zlib_ratio(text), n / F.greatest(breaks, F.lit(1)), share(text, "[^ \n\t]")
    hard = (entropy > 6) | (ratio > 0.7) | (line > 150) | (blank < 0.2)
    some = n > 0
    return {
        "entropy": F.when(some, F.round(entropy, 2)), "compression_ratio": F.when(some, F.round(ratio, 3)), "avg_line_length": F.when(some, F.round(line, 1)),
        "whitespace_ratio": F.when(some, F.round(blank, 3)), "score": F.when(some, entropy * 10 + ratio * 50 + line / 10 + (1 - blank) * 30).otherwise(0.0),
        "is_complex": some & hard, "route": F.when(some & hard, "single").otherwise("batch"),
    }


_PARTS = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"


def dehydrate(text: Column, names: list[str] | None = None) -> Column:
    """The compact form: filler words as NUL and their number, other words without vowels but a leading one, white space in single spaces.

    Words of ``names`` (in any case) stay whole. It can't be undone but for the fillers.
    """
    numbers = F.create_map([F.lit(x) for i, w in enumerate(FILLERS, 1) for x in (w, "\0" + chr(i))])
    keep = F.array(*[F.lit(n.lower()) for n in names or []]).cast("array<string>")

    def part(p: Column) -> Column:
        low = F.lower(p)
        bare = F.translate(p, "aeiouAEIOU", "")
        short = F.when(F.lower(F.substring(p, 1, 1)).isin(*"aeiou"), F.concat(F.substring(p, 1, 1), F.translate(F.substring(p, 2, 1 << 30), "aeiouAEIOU", ""))).otherwise(bare)
        return F.coalesce(numbers[low], F.when(p.rlike(r"^[\p{L}\p{N}_]"), F.when(F.array_contains(keep, low), p).otherwise(short)).otherwise(F.regexp_replace(p, r"\s+", " ")))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PARTS), F.lit(1)), part), "")


def rehydrate(text: Column) -> Column:
    """Filler numbers as words again, with a space on either side."""
    out = text
    for i, w in enumerate(FILLERS, 1):
        if chr(i) != "\n":
            out = F.replace(out, F.lit("\0" + chr(i)), F.lit(f" {w} "))
    return out


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    data = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data), F.lit(2))).otherwise(F.array().cast("array<int>"))
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substring(data, i, F.lit(2)), 16, 10).cast("bigint")) * 16777619).bitwiseAND(4294967295)
    return F.aggregate(at, F.lit(2166136261).cast("bigint"), step)


def type_id(name: Column) -> Column:
    return (fnv1a(name) % 255 + 1).cast("int")


def field_id(name: Column) -> Column:
    return (fnv1a(name) % 65535 + 1).cast("int")
