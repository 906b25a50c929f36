"""Toxicity of text through a noisy channel: disguised words are restored first, then scored.

A character language model (4-grams, backed off) is counted over all texts. Words that look disguised
(digits or symbols for letters, letters spaced out, letters repeated) become a lattice of what each
character may stand for, each reading with a cost; the Viterbi path under the language model is the
restored word. The restored text is scored by weights of words and word beginnings learned from
labelled rows; a beginning covers the inflected and compound forms that no labelled row holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import slices

_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêçñóíáú"
#: Characters of the model: 0 is the border of a word, the last any other letter.
A = len(_LETTERS) + 2
ORDER = 4
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
_CODES = np.zeros(0x250, np.uint8)
for _i in range(0x250):
    _CODES[_i] = _CODE.get(chr(_i), A - 1 if chr(_i).isalpha() else 0)
#: What a character may stand for besides itself.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
    "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "ø": "o", "а": "a", "е": "e", "о": "o", "і": "i",
    "р": "p", "с": "c", "х": "x", "у": "y",
}
_SWAP, _DROP, _SPLIT = 1.5, 0.7, 4.0
_MARKS = re.escape("".join(READINGS))
_LEET = re.compile(rf"[a-zа-я][{_MARKS}]+[a-zа-я]|(?<![^\s\"'(\[])[{_MARKS}]{{1,2}}[a-z]+|[a-z]{{2}}[{_MARKS}](?![^\s.,;:!?\"')\]])|([^\W\d_])\1\1")
_LONE = rf"(?:[^\W\d_]|[{_MARKS}])"
_SPACED = re.compile(rf"(?<![^\s\"'(\[]){_LONE}(?:[ .\-_~]{{1,3}}{_LONE}){{2,}}(?![^\s.,;:!?\"')\]])")
_RUN = re.compile(r"(.)\1+")
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of longer words that are features too, written with a star.
BEGINNINGS = (4, 5, 6, 7)
_BLOCK = 500_000


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return np.where(points < 0x250, _CODES[np.minimum(points, 0x24F)], 0).astype(np.int32)


def count_grams(texts: Iterator[str | None]) -> np.ndarray:
    """Counts of all runs of four characters; a border is put around each text."""
    total = np.zeros(A**ORDER, np.int64)
    for text in texts:
        for at in range(0, len(text or ""), _BLOCK):
            c = np.concatenate([np.zeros(3, np.int32), codes(text[at : at + _BLOCK]), np.zeros(1, np.int32)])
            g = ((c[:-3] * A + c[1:-2]) * A + c[2:-1]) * A + c[3:]
            if len(g) > 50_000:
                total += np.bincount(g, minlength=len(total))
            else:
                np.add.at(total, g, 1)
    return total


@dataclass
class Model:
    logp: np.ndarray  # cost of the fourth character after three, A^4
    weights: dict[str, float]
    bias: float
    memory: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        #: Features without doubled letters; restoring can't tell how many letters a run stood for.
        self.thin = {_RUN.sub(r"\1", w): w for w in self.weights}
        self.thin_ends = sorted({len(w) - 1 for w in self.thin if w[-1] == "*"})

    def decode(self, token: str, spaced: bool = False) -> str:
        """The most probable word (or words, where spaced letters fall into several) behind a disguised one.

        States are the last three characters; each reading adds its cost of the channel and of the model.
        A repeated letter may be dropped, and so may a mark at an end or between letters.
        """
        if (known := self.memory.get(token)) is not None:
            return known
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, -1): (0.0, None)}
        cost, size = self.logp, A
        chars = [c for c in token if not (spaced and c in " .-_~")]
        for place, c in enumerate(chars):
            readings = [(c, 0.0)] if c in _CODE else []
            readings += [(r, _SWAP) for r in READINGS.get(c, "")]
            edge = place < 1 or place >= len(chars) - 3
            drop = None if c in _CODE else (_DROP if edge else 3.0)
            nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}

            def put(key: tuple[int, int], value: float, path: tuple | None) -> None:
                if (old := nxt.get(key)) is None or value < old[0]:
                    nxt[key] = (value, path)

            for (context, last), (so_far, path) in states.items():
                if drop is not None or not readings:
                    put((context, last), so_far + (drop or _DROP), path)
                for r, swap in readings:
                    x = _CODE[r]
                    if x == last:  # one letter of a run stands for all
                        put((context, last), so_far + swap + _DROP * 0.3, path)
                    put(((context * size + x) % size**3, x), so_far + swap + cost[context * size + x], (r, path))
                    if spaced and path is not None:
                        brk = (context * size) % size**3
                        put(((brk * size + x) % size**3, x), so_far + swap + _SPLIT + cost[context * size] + cost[brk * size + x], (r, (" ", path)))
            states = nxt  # all of them: no more than the readings of three characters allow
        _, path = min(((v + cost[context * size], p) for (context, _), (v, p) in states.items()), key=lambda x: x[0])
        out: list[str] = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        word = "".join(reversed(out))
        if len(self.memory) > 200_000:
            self.memory.clear()
        if len(token) < 60:
            self.memory[token] = word
        return word

    def restored(self, text: str) -> tuple[str, list[str]]:
        """The lower-cased text, and what its disguised parts restore to."""
        low = text.lower()
        found, end = [], 0
        for hit in _LEET.finditer(low):
            if hit.start() < end:
                continue
            start, end = hit.span()
            while start > 0 and not low[start - 1].isspace():
                start -= 1
            while end < len(low) and not low[end].isspace():
                end += 1
            token = low[start:end].strip(".,;:?\"')]")
            found.append(self.decode(token))
        for hit in _SPACED.finditer(low):
            found.append(self.decode(hit[0], spaced=True))
        return low, found

    def score(self, text: str | None) -> tuple[float, list[str]]:
        """Probability of the label, and the words that count for it."""
        if not text:
            return 1 / (1 + np.exp(-self.bias)), []
        low, found = self.restored(text)
        weights = self.weights
        words = set(_WORD.findall(low))
        hits = words & weights.keys()
        for n in BEGINNINGS:
            hits |= {f"{w[:n]}*" for w in words if len(w) > n} & weights.keys()
        for part in found:
            for t in _RUN.sub(r"\1", part).split():
                starts = [t, *(f"{t[:n]}*" for n in self.thin_ends if len(t) > n)]
                hits.update(self.thin[x] for x in starts if x in self.thin)
        total = self.bias + sum(weights[w] for w in sorted(hits))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, total))))), sorted(hits)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Cost (negative log probability) of each character after the three before it, backed off to shorter contexts."""
    c4 = counts.reshape(-1, A).astype(np.float64)
    shape = counts.reshape(A, A, A, A)
    p = np.full(A, 1 / A)
    for c in (shape.sum((0, 1, 2)), shape.sum((0, 1)).reshape(-1, A), shape.sum(0).reshape(-1, A), c4):
        c = c.reshape(-1, A)
        lower = p if p.ndim == 1 else np.tile(p, (len(c) // len(p), 1))
        p = (c + 4.0 * lower) / (c.sum(1, keepdims=True) + 4.0)
    return -np.log(p).astype(np.float32).reshape(-1)


def gather(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of 4-grams over every text, added up on the executors; A^4 sums at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count_grams(text for batch in batches for text in (x.as_py() for x in batch.column(0)))
        (at,) = total.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"])

    sums = docs.select(docs[text_col].alias("text")).mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(A**ORDER, np.int64)
    counts[sums["gram"].to_numpy(int)] = sums["n"].to_numpy(np.int64)
    return counts


def _features(words: Column) -> Column:
    def starts(n: int) -> Column:  # a function of its own, since a lambda with two parameters would be given the index
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    return F.array_distinct(F.concat(words, *map(starts, BEGINNINGS)))


def train(docs: DataFrame, labelled: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", max_docs: int = 20_000, max_words: int = 1_000) -> Model:
    """Counts the language model over ``docs`` and learns word weights from ``labelled``.

    Of the labelled rows at most about ``max_docs`` are used, chosen by a hash of the id; their whole
    texts count. Words and beginnings of words are features if at least 4 rows of label 1 hold them, and
    far more of those than chance would have it; the ``max_words`` of largest evidence stay, and a logistic
    regression weighs them. Null labels are left out, null texts count as empty; without labelled rows
    every score is 0.5.
    """
    rows = labelled.where(F.col(label_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("t"), (F.col(label_col) > 0).cast("int").alias("y"))
    size = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("toxicity sample"), F.col("id")), F.lit(1_000_000)) / 1e6
    sample = rows.where(draw < min(1.0, max_docs / max(1, size)))
    n = sample.agg(F.sum("y").alias("one"), F.count(F.lit(1)).alias("all")).first()
    one, every = n["one"] or 0, n["all"] or 0
    counts = gather(docs, text_col)
    if not one or one == every:
        return Model(language_model(counts), {}, 0.0)
    found = F.array_distinct(F.regexp_extract_all("t", F.lit(r"(\p{L}+)"), F.lit(1)))
    held = sample.select("y", found.alias("words"))
    # only what rows of label 1 hold can get a weight, so the others are counted for these features alone
    toxic = held.where("y = 1").select(F.explode(_features(F.col("words"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("a")).where("a >= 4")
    words = held.select("y", F.explode(_features(F.col("words"))).alias("w")).join(toxic.select("w"), "w", "left_semi")
    stats = words.groupBy("w").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("m")).where("a >= 4")
    base = one / every
    stats = stats.withColumn("z", (F.col("a") - F.col("m") * base) / F.sqrt(F.col("m") * base * (1 - base)))
    stats = stats.where((F.col("z") > 6) & (F.col("a") / F.col("m") > 0.5))
    ranked = stats.orderBy(F.desc("z"), "w").limit(max_words).select("w", (F.col("a") / F.col("m")).alias("share")).collect()
    lexicon = general({r["w"]: r["share"] for r in ranked})
    hits = F.array_sort(F.array_intersect(_features(F.col("words")), F.array(*[F.lit(w) for w in lexicon]).cast("array<string>")))
    kinds = held.select("y", hits.alias("hits")).groupBy("y", "hits").agg(F.count(F.lit(1)).alias("n")).toPandas()
    weights, bias = fit(lexicon, kinds["hits"].tolist(), kinds["y"].to_numpy(float), kinds["n"].to_numpy(float), base)
    return Model(language_model(counts), weights, bias)


def general(share: dict[str, float]) -> list[str]:
    """The features without those that a shorter beginning covers: one of at least nearly the same share of label 1.

    The beginning holds wherever the longer feature does; side by side the two would share one weight, and a form that
    no labelled row holds would get half of it.
    """
    out = []
    for w, own in share.items():
        stem = w.rstrip("*")
        covers = (f"{stem[:n]}*" for n in BEGINNINGS if n < len(stem))
        if not any(c in share and share[c] >= 0.98 * own for c in covers):
            out.append(w)
    return out


def fit(lexicon: list[str], hits: list, y: np.ndarray, n_rows: np.ndarray, base: float, ridge: float = 0.03, steps: int = 1_500) -> tuple[dict[str, float], float]:
    """Logistic regression with a ridge over sets of features, by accelerated gradient steps.

    Rows that hold the same features count by the logarithm of their number, so that copies don't
    outvote the rest. The bias is what rows without any feature say, as those outnumber all others.
    """
    at = {w: i for i, w in enumerate(lexicon)}
    flat = np.array([at[w] for h in hits for w in h], int)
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    none = np.array([len(h) == 0 for h in hits], bool)
    ones, rest = float(n_rows[none & (y > 0)].sum()), float(n_rows[none].sum())
    share = min(0.4, max(0.01, (ones + base) / (rest + 1.0))) if lexicon else base
    bias = float(np.log(share / (1 - share)))
    n, k, weight = len(hits), len(lexicon), 1 + np.log(n_rows)
    w, look, t = np.zeros(k), np.zeros(k), 1.0
    most = np.bincount(row, minlength=n).max(initial=1)
    step = 1 / (ridge + 0.25 * max(1.0, float(np.bincount(flat, weight[row] * most, minlength=k).max(initial=1.0))))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, look[flat], minlength=n), -40, 40)))
        gradient = np.bincount(flat, (weight * (p - y))[row], minlength=k) + ridge * look
        new, ahead = look - step * gradient, (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / ahead * (new - w), new, ahead
    return dict(zip(lexicon, w.tolist(), strict=True)), bias


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, hits): for each row of ``docs`` the probability of label 1 and the words that count for it.

    Null and empty texts get the score of a text without such words; equal texts get equal scores.
    Rows never leave their partition; the model (about 10 MB) is sent to the workers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            found = [model.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([h for _, h in found], pa.list_(pa.string()))],
                names=["id", "score", "hits"],
            )

    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "id bigint, score double, hits array<string>").withColumnRenamed("id", id_col)
