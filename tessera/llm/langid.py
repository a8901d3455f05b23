"""Language identification by a string kernel.

Texts are compared by the blended spectrum presence kernel: the share of byte n-grams of 1 to
``N_MAX`` bytes (ASCII letters lower-cased; digits and ASCII punctuation as blanks, runs of blanks
as one) that two texts have in common, normalised by the geometric mean of how many each has.  A
text of more than ``PIECE`` bytes is the mean of its pieces, so long texts are told by all they
have and on the same scale as short ones.  ``fit`` draws a bounded sample of labelled rows (of each
label at most ``PER_LABEL``, of all together at most ``ROWS`` or one a label), takes some of them as
Nyström landmarks and solves a one-versus-rest kernel ridge regression; ``predict`` scores every
whole text with two matrix products a batch.

The sample of a label are the texts with the least hashes among its distinct texts that have a
letter, so copies don't drive out others; every label that has such a text is learned.  A sampled
text is used whole, or if it is longer than SPANS pieces by SPANS pieces from all over it.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a label that is null
is never learned; with no labelled row at all every text is ``und``; ties go to the label that
sorts first; repeated rows and further columns change nothing.

``clean`` rejects by what the model was fitted on.  A text is not language where fewer of its
4-grams are found in any training row than ``MARGIN`` of the least that pieces of about its length
have, each held against the other training rows only, or where letters are fewer of its bytes than
``LETTERS`` of the least that a whole training row has.  So a text like those that have a label always stays, a
short one is rejected only if its like never occurs, and few or odd training rows reject little.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The bound of the sample: rows a label, rows in all (one a label at least), and the pieces that a longer text is sampled by.
PER_LABEL, ROWS, SPANS = 200, 6_400, 16
PIECE = 4_000
LANDMARKS, RIDGE, N_MAX, BUCKETS = 160, 0.05, 4, 1 << 13
#: What ``clean`` allows for below the training rows, slots for their 4-grams, and the lengths (in 4-grams) that limits are set for.
MARGIN, LETTERS, SLOTS, LENGTHS = 0.8, 0.5, 1 << 24, tuple(1 << k for k in range(2, 12))
FOLDS = 5
LOT = 128  # pieces whose rows are made at a time

# What bytes become before n-grams are taken: A-Z lower case, other ASCII but letters a blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    landmarks: np.ndarray  # BUCKETS x landmarks: presence over the root of their number
    weights: np.ndarray  # landmarks x labels
    bias: np.ndarray
    spread: float


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def pieces(texts: list[bytes], size: int = PIECE) -> tuple[list[bytes], np.ndarray]:
    """Texts cut into pieces of about the same length, and which text each is of."""
    out, of = [], []
    for i, t in enumerate(texts):
        n = max(1, -(-len(t) // size))
        cuts = [len(t) * k // n for k in range(n + 1)]
        out += [t[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        of += [i] * n
    return out, np.array(of, np.int64)


def presence(texts: list[bytes]) -> np.ndarray:
    """One row a text: which hashed n-grams it has, divided by the root of how many; of a long one the mean over its pieces."""
    parts, of = pieces(texts)
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for at in range(0, len(parts), LOT):
        np.add.at(out, of[at : at + LOT], _presence(parts[at : at + LOT]))
    return out / np.bincount(of, minlength=len(texts)).astype(np.float32)[:, None]


def _presence(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.float32)
    flat = out.reshape(-1)
    # Texts stand one after another with a blank between; an n-gram belongs to the text that it starts in.
    raw = _FOLD[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    keep = np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]
    raw, base = raw[keep].astype(np.uint32), row[keep] * BUCKETS
    code = np.zeros(len(raw), np.uint32)
    for n in range(1, N_MAX + 1):
        m = len(raw) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + raw[n - 1 :] + np.uint32(1)
        h = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        same = base[:m] == base[n - 1 :] if n > 1 else slice(None)
        flat[(base[:m] + h)[same]] = 1
    return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))


def fit_rows(texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS) -> Model:
    names = tuple(sorted(set(labels)))
    x = presence(texts)
    y = np.where(np.array(labels)[:, None] == np.array(names)[None], 1.0, -1.0)
    rng = np.random.default_rng(7)
    marks = np.concatenate([rng.permutation(np.flatnonzero(y[:, j] > 0))[: max(1, landmarks // len(names))] for j in range(len(names))])
    z = x[marks]
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-6))  # K_zz^(-1/2)
    features = (x @ z.T) @ root
    mean, center = y.mean(0), features.mean(0)
    f = features - center
    w = np.linalg.solve(f.T @ f + RIDGE * len(x) / 100 * np.eye(f.shape[1]), f.T @ (y - mean))
    out = f @ w + mean
    return Model(names, np.ascontiguousarray(z.T), (root @ w).astype(np.float32), (mean - center @ w).astype(np.float32), float(max(out.std(), 1e-3)))


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    return (presence(texts) @ model.landmarks) @ model.weights + model.bias


def slots_of(text: bytes) -> np.ndarray:
    """The hashed 4-grams of a text, folded as for the kernel, at each place that has a byte other than a blank."""
    raw = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    raw = raw[np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]].astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(0, np.int64)
    code = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(33 - SLOTS.bit_length())).astype(np.int64)


def letter_share(text: bytes) -> float:
    """Letters (all bytes beyond ASCII among them) of the bytes that are not white space."""
    raw = np.frombuffer(b"".join(text.split()), np.uint8)
    return float((_FOLD[raw] != 32).mean()) if len(raw) else 0.0


@dataclass(frozen=True)
class Limits:
    known: np.ndarray  # a bit for each slot
    shares: np.ndarray  # the least share of known 4-grams for each of LENGTHS
    letters: float

    def told(self, text: bytes) -> bool:
        if letter_share(text) < self.letters:
            return False
        at = slots_of(text)
        if len(at) < LENGTHS[0]:
            return True
        share = (self.known[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).mean()
        return bool(share >= self.shares[np.searchsorted(LENGTHS, len(at), "right") - 1])


def limits(texts: list[bytes]) -> Limits:
    """Set from the training rows: of each length, the least over all their pieces."""
    rows = [slots_of(t) for t in texts]
    slot, many = np.unique(np.concatenate([np.unique(r) for r in rows]), return_counts=True)
    bits = np.zeros(SLOTS, bool)
    bits[slot] = True
    least = np.ones(len(LENGTHS))
    for at in rows:
        other = np.r_[0, np.cumsum(many[np.searchsorted(slot, at)] > 1)]
        for k, n in enumerate(LENGTHS):
            if len(at) >= n:
                starts = np.arange(0, len(at) - n + 1, max(1, n // 4))
                least[k] = min(least[k], ((other[starts + n] - other[starts]) / n).min())
        if len(at) >= LENGTHS[0]:  # the row as a whole
            k = int(np.searchsorted(LENGTHS, len(at), "right")) - 1
            least[k] = min(least[k], other[-1] / len(at))
    return Limits(np.packbits(bits), MARGIN * np.minimum.accumulate(least[::-1])[::-1], LETTERS * min(map(letter_share, texts)))


def training_rows(docs: DataFrame, per_label: int = PER_LABEL, rows: int = ROWS) -> DataFrame:
    """The bounded sample: of each label, the distinct texts with a letter whose hashes are least."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    distinct = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not distinct:
        return known.select("lang", "text").limit(0)
    each = max(1, min(per_label, rows // len(distinct)))
    # Of each label so many of the least hashes that enough are left, and only those are ordered.
    share = F.create_map(*[F.lit(x) for k, n in distinct.items() for x in (k, min(1.0, (4 * each + 200) / n))])
    part = F.abs(F.col("h") % 1_000_003) / 1_000_003
    least = known.select("lang", "h").filter(part <= F.element_at(share, F.col("lang"))).distinct()
    chosen = least.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(part, "h"))).filter(F.col("k") <= each).select("lang", "h")
    if len(distinct) <= rows:  # then these are at most ``rows`` rows, which go to the texts; beyond, Spark decides
        chosen = F.broadcast(chosen)
    size, many = PIECE, SPANS
    spans = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: F.substr(F.col("text"), (1 + F.floor(i * (F.length("text") - size) / (many - 1))).cast("int"), F.lit(size))))
    text = F.when(F.length("text") > size * many, spans).otherwise(F.col("text"))
    return known.join(chosen, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min(text).alias("text")).select("lang", "text")


def drawn(docs: DataFrame) -> list[tuple[str, str]]:
    common.prepare(docs.sparkSession)
    return sorted((r["lang"], r["text"]) for r in training_rows(docs).collect())


def fit(docs: DataFrame) -> Model | None:
    rows = drawn(docs)
    return fit_rows([t.encode() for _, t in rows], [x for x, _ in rows]) if rows else None


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), rule: Limits | None = None) -> DataFrame:
    """The columns ``keep``, lang_pred and score (the logistic of the best label's lead over the second); what ``rule`` rejects is und."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast((model, rule))  # landmarks x buckets: its size is fixed by the parameters

    def run(batches):
        m, limit = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = common.column_bytes(part.column("__text"))
                letters = np.fromiter((has_letter(t) and (limit is None or limit.told(t)) for t in texts), bool, len(texts))
                label, score = ["und"] * len(texts), np.zeros(len(texts))
                if m is not None and letters.any():
                    s = scores(m, texts).astype(np.float64)
                    best = s.argmax(1)
                    order = np.sort(s, axis=1)
                    lead = order[:, -1] - (order[:, -2] if s.shape[1] > 1 else -1.0)
                    score = np.where(letters, 1 / (1 + np.exp(-2 * lead / m.spread)), 0.0)
                    label = [m.labels[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(label, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    texts = docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("__text"))
    return texts.mapInArrow(run, common.ddl(docs.select(*keep)) + ", lang_pred string, score double")


def clean(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told and that are like the training rows, as they are; where no row has a label to learn from, those with a letter."""
    rows = drawn(docs)
    if not rows:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    texts = [t.encode() for _, t in rows]
    model = fit_rows(texts, [x for x, _ in rows])
    told = predict(docs.select(F.struct("*").alias("__row"), "text"), model, ("__row",), limits(texts))
    return told.filter(F.col("lang_pred") != "und").select("__row.*")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_langid": query}
