"""Language ID by error-correcting output codes.

Every language gets a codeword of bits. One binary classifier for each bit predicts it from byte
n-grams (1 to 3 bytes of the lower-cased text): naive Bayes weights, the log odds of an n-gram among
the languages whose bit is 1 against those whose bit is 0. Decoding weighs the logistic loss of each
classifier's margin by how well that classifier did on the training rows, and takes the codeword of
least loss. A text whose two nearest codewords are about as near is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import held, slices

UNDETERMINED = "und"
#: Table of n-gram features: 2^8 for single bytes, 2^16 each for pairs and (hashed) triples.
N_FEATURES = 256 + 65_536 + 65_536
#: Bytes of text that are scored at once.
BLOCK = 1 << 16


def codewords(n: int, seed: int = 17) -> np.ndarray:
    """Codewords of +-1 for n languages: all distinct splits for up to 6, else random ones far apart."""
    if n == 1:
        return np.ones((1, 1), np.float32)
    if n <= 6:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, np.float32).T.copy()
    rng, best, most = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.float32), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        gap = code.shape[1] - np.abs(code @ code.T - np.diag([np.inf] * n)).max()
        if np.isfinite(gap) and gap > most:
            best, most = code, gap
    return best if best is not None else code


def features(data: bytes) -> np.ndarray:
    """Indices of all n-grams of the bytes."""
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    two = (b[:-1] << 8) | b[1:]
    three = ((two[:-1] * 31_415 + b[2:] * 40_503) >> 3) & 0xFFFF
    return np.concatenate([b, two + 256, three + 65_792])


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # features x bits, mean log odds
    offset: np.ndarray  # bits
    trust: np.ndarray  # bits, weight of each classifier's loss

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Mean margin of each classifier on each text; texts are scored in blocks of bounded size."""
        out = np.zeros((len(texts), self.code.shape[1]), np.float32)
        for i, text in enumerate(texts):
            total, n = np.zeros(self.code.shape[1]), 0
            for at in range(0, len(text), BLOCK):
                part = text[max(0, at - 2) : at + BLOCK]
                f = features(part)
                total += self.weight[f].sum(0, dtype=np.float64)
                n += len(f)
            out[i] = total / max(n, 1) + self.offset
        return out

    def decode(self, margins: np.ndarray, sharp: float = 4.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability, and that of the runner-up."""
        loss = np.stack([(np.logaddexp(0, -sharp * margins * c) * self.trust).sum(1) for c in self.code], 1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, 1, kind="stable")
        rows = np.arange(len(p))
        second = p[rows, order[:, 1]] if p.shape[1] > 1 else np.zeros(len(p))
        return order[:, 0], p[rows, order[:, 0]], second


_COUNTS = "lang string, feature int, n bigint"


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs_per_language: int = 4_000) -> Model | None:
    """Fits the bit classifiers on rows with text and a non-null label; None if there is no such row.

    At most about ``max_docs_per_language`` rows of each language are used, chosen by a hash of
    the id, so that the choice is the same however the rows are dealt; their whole texts count. The
    n-grams are counted on the executors; only sums (languages x features, bounded) reach the driver.
    Null, empty and repeated texts need no care: they add nothing or count again.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.create_map([F.lit(x) for k in languages for x in (k, min(1.0, max_docs_per_language / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), F.col("id")), F.lit(1_000_000)) / 1e6
    sample = rows.where(draw < share[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("langid")
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(N_FEATURES, np.int64))
                data = text.lower().encode()
                for at in range(0, len(data), BLOCK):
                    np.add.at(own, features(data[max(0, at - 2) : at + BLOCK]), 1)
        for lang, own in sums.items():
            (at,) = own.nonzero()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())],
                names=["lang", "feature", "n"],
            )

    counted = sample.mapInArrow(count, _COUNTS).groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), N_FEATURES))
    at = {lang: i for i, lang in enumerate(languages)}
    counts[counted["lang"].map(at).to_numpy(int), counted["feature"].to_numpy(int)] = counted["n"].to_numpy(float)
    return fit(languages, counts)


def fit(languages: list[str], counts: np.ndarray) -> Model:
    """Weights from the counts of each n-gram in each language. Languages count alike, whatever their size."""
    code = codewords(len(languages))
    rate = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
    weight = np.zeros((counts.shape[1], code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        one, zero = code[:, bit] > 0, code[:, bit] < 0
        if one.any() and zero.any():
            weight[:, bit] = np.log(rate[one].mean(0)) - np.log(rate[zero].mean(0))
    # a classifier's mean margin on each language's own n-grams says where to cut and how far to trust it
    own = (rate @ weight).astype(np.float32)
    offset, trust = np.zeros(code.shape[1], np.float32), np.ones(code.shape[1], np.float32)
    for bit in range(code.shape[1]):
        one, zero = code[:, bit] > 0, code[:, bit] < 0
        if one.any() and zero.any():
            low, high = own[one, bit].min(), own[zero, bit].max()
            offset[bit] = -(low + high) / 2 if low > high else 0
            trust[bit] = max(0.05, min(1.0, (low - high) / 2))
    return Model(languages, code, weight, offset, trust)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.2, keep: list[str] | None = None) -> DataFrame:
    """A row for each row of ``docs``: lang_pred, score (0 to 1), runner_up (0 to 1), ambiguous.

    ``und`` with score 0 and not ambiguous if the text is null or has no letter, or if there is no
    model. ``ambiguous`` is true where the best two codewords' probabilities differ by less than
    ``ambiguous_below``. ``keep`` names other columns to carry. Equal texts get equal results.
    Rows never leave their partition; the model (a few MB) is sent to the workers.
    """
    keep = keep or []
    frame = docs.select(docs[id_col].cast("bigint").alias("_id"), docs[text_col].alias("_text"), has_letter(docs[text_col]).alias("_letter"), *[docs[c] for c in keep])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[3:])
    schema = f"_id bigint, lang_pred string, score double, runner_up double, ambiguous boolean{kept}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("langid")
        model = shared.value
        for batch in slices(batches):
            n = batch.num_rows
            lang, score, second = [UNDETERMINED] * n, np.zeros(n), np.zeros(n)
            at = [i for i, ok in enumerate(batch.column(2).to_pylist()) if ok and model is not None]
            if at:
                texts = [s.lower().encode() for s in batch.column(1).take(pa.array(at)).to_pylist()]
                best, p, q = model.decode(model.margins(texts))
                score[at], second[at] = p, q
                for i, k in zip(at, best, strict=True):
                    lang[i] = model.languages[k]
            near = (score > 0) & (score - second < ambiguous_below)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(second), pa.array(near), *batch.columns[3:]],
                names=["_id", "lang_pred", "score", "runner_up", "ambiguous", *keep],
            )

    return frame.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the row is left out of training: by CRC-32 of the id's decimal text; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
