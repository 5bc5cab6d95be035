"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

*Kernel.*  Two words are compared by the letter subsequences of length four they
share.  A subsequence that spans s letters counts ``DECAY**s`` and may have gaps, up
to a span of ``SPAN`` (the gap-weighted subsequence kernel, normalised).  An
inserted, dropped or swapped letter leaves most subsequences intact.  Before
that, letters lose case and accents, look-alike digits and signs become letters,
punctuation inside words goes, and runs of single letters ("i d i o t") are joined.

*Learning.*  Labels belong to texts, so a text is a bag of sentences and their
words (multiple-instance learning): a toxic text has a witness, the word that speaks most for
toxicity.  Candidates are words of no clean text and words whose share in toxic texts
is surely a multiple of that in clean ones (a smoothed rate ratio and its error), so that a few wrong
labels or quotations do not hide a word; candidates are no examples of clean words.  First
witnesses come from log-odds of subsequences; then a linear SVM on Nyström features (kernel values to landmark
words times the inverse root of the landmarks' own kernel) and a new choice of
witnesses alternate, each round with the clean words that come nearest and with
witnesses into which a letter was put (virtual examples).  Platt
scaling turns a text's largest word score into its probability.  The classifier is
fitted on at most about ``TRAIN_ROWS`` labelled texts of each class, drawn by a hash of the
id before any text is read: that is a documented bound, and fits the driver.

*Scoring.*  The SVM's weights over landmarks fold into one weight for each
subsequence, exactly, as kernel values are inner products.  A word then costs a few
lookups, and each worker remembers its words.  Texts are read where they lie,
whole, with no shuffle.

Defined results: null, empty and letterless texts score as a text without any
witness.  With no labelled text of either class every score is the share of
toxic ones (0 without labels).  Null labels are ignored, repeated rows are scored one by
one, extra columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, table
from .registry import query

ORDER = 4
SPAN = 6
DECAY = 0.8
TRAIN_ROWS = 3000
LANDMARKS = 160
ROUNDS = 3
#: A word of clean texts may be a witness from this ratio of rates and so many standard errors of its logarithm.
WITNESS_RATIO = 5.0
WITNESS_ERRORS = 3.0
#: Longer words are scored in overlapping parts of this many letters.
PART = 24
#: Remembered words of a worker; the memory is emptied when full.
CACHE = 250_000
#: Words whose features are computed at once.
BLOCK_WORDS = 2048
_LETTER_BITS = 5

#: Signs written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_GAPS = [(0, *c) for c in combinations(range(1, SPAN), ORDER - 1)]
_SPACED = re.compile(r"\s\S\s+\S\s+\S\s")
_SPACED_RUN = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")


class _Letters(dict):
    """Code point -> plain letter, look-alike's letter, another sign for other letters, or nothing."""

    def __missing__(self, point: int) -> str | None:
        c = chr(point)
        c = LOOKALIKES.get(c, unicodedata.normalize("NFKD", c)[:1].lower())
        self[point] = c if "a" <= c <= "z" else "{|}~"[point % 4] if c.isalpha() else None
        return self[point]


_LETTERS = _Letters()


def words_of(text: str | None) -> set[str]:
    """Distinct words as written, in lower case, and joined runs of single signs."""
    if not text:
        return set()
    text = text.lower()
    found = set(text.split())
    if _SPACED.search(f" {text} "):
        found.update("".join(m.group().split()) for m in _SPACED_RUN.finditer(text))
    return found


def plain_parts(word: str) -> list[str]:
    """Letters of a word, in parts if it is long; none if fewer than three letters."""
    letters = word.translate(_LETTERS)
    # an exclamation mark at the end is one
    letters = letters if not word.endswith("!") else word.rstrip("!").translate(_LETTERS)
    if len(letters) < 3:
        return []
    if len(letters) <= PART:
        return [letters]
    return [letters[i:i + PART] for i in range(0, len(letters) - PART // 2, PART // 2)]


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (rows, codes, weights) of normalised kernel features of plain words.

    A row's codes are distinct (a repeated one has weight zero after the first), its
    weights have length one, so an inner product of two rows is the kernel.  A block
    holds words of one length and at most ``BLOCK_WORDS`` of them."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, all_rows in by_length.items():
        for at in range(0, len(all_rows), BLOCK_WORDS):
            rows = all_rows[at:at + BLOCK_WORDS]
            signs = np.frombuffer("".join(words[i] for i in rows).encode(), np.uint8).reshape(len(rows), n) - 96
            s = np.zeros((len(rows), n + 2), np.int32)  # word edges are signs too
            s[:, 1:-1] = signs
            codes, weights = [], []
            for gaps in _GAPS:
                m = n + 2 - gaps[-1]
                if m > 0:
                    code = np.zeros((len(rows), m), np.int32)
                    for g in gaps:
                        code = (code << _LETTER_BITS) | s[:, g:g + m]
                    codes.append(code)
                    weights.append(np.full(m, DECAY ** (gaps[-1] + 1), np.float32))
            code, weight = np.concatenate(codes, axis=1), np.concatenate(weights)
            order = np.argsort(code, axis=1, kind="stable")
            code = np.take_along_axis(code, order, axis=1)
            value = weight[order]
            same = code[:, 1:] == code[:, :-1]
            if same.any():  # move the weights of equal codes to the first of them
                first = np.concatenate((np.ones((len(rows), 1), bool), ~same), axis=1)
                group = np.cumsum(first.ravel()) - 1
                total = np.bincount(group, value.ravel())
                value = np.where(first, total[group].reshape(first.shape), 0).astype(np.float32)
            yield np.array(rows), code, value / np.sqrt((value * value).sum(axis=1, keepdims=True))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words (rows) and landmarks."""
    blocks = list(features(landmarks))
    used = np.unique(np.concatenate([c.ravel() for _, c, _ in blocks]))
    basis = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for rows, code, value in blocks:
        np.add.at(basis, (np.searchsorted(used, code), rows[:, None]), value)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for rows, code, value in features(words):
        at = np.searchsorted(used, code)
        at[(at < len(used)) & (used[np.minimum(at, len(used) - 1)] != code)] = len(used)
        for k in range(0, len(rows), 256):
            out[rows[k:k + 256]] = np.einsum("rc,rcm->rm", value[k:k + 256], basis[at[k:k + 256]])
    return out


class ToxicityModel(NamedTuple):
    weights: np.ndarray   # by subsequence code
    bias: float
    slope: float          # of the Platt scaling
    offset: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.float32)
        for rows, code, value in features(words):
            out[rows] = (self.weights[code] * value).sum(axis=1)
        return out + np.float32(self.bias)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * margin + self.offset)))


def constant_model(share: float) -> ToxicityModel:
    share = min(max(share, 0.0), 1.0)
    return ToxicityModel(np.zeros(1 << (_LETTER_BITS * ORDER), np.float32), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))


class Scorer:
    """Largest word score of texts, with a memory of the words seen."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.memory: dict[str, float] = {}

    def margins(self, bags: list[set[str]]) -> tuple[list[float], list[str | None]]:
        """Margin of each bag and the word that gives it; a bag without words gets the lowest margin, -1."""
        memory = self.memory
        new = set().union(*bags).difference(memory)
        if len(new) + len(memory) > CACHE:
            memory.clear()
            new = set().union(*bags)
        new = list(new)
        parts = [plain_parts(w) for w in new]
        flat = self.model.word_scores([p for x in parts for p in x]).tolist()
        at = 0
        for w, x in zip(new, parts, strict=True):
            memory[w] = max(flat[at:at + len(x)], default=-1.0)
            at += len(x)
        best = [max(b, key=lambda w: (memory[w], w), default=None) for b in bags]
        return [max(-1.0, memory[w]) if w is not None else -1.0 for w in best], best


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, steps: int = 400) -> np.ndarray:
    """Squared-hinge linear SVM with a bias column, by accelerated gradient steps."""
    x = np.hstack((x, np.ones((len(x), 1))))
    weight = weight / weight.sum()
    pace = 1 / (1 / cost + 2 * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1])
    w = v = np.zeros(x.shape[1])
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = v / cost * 0.01 - 2 * x.T @ (weight * y * slack)
        w, old = v - pace * grad, w
        v = w + k / (k + 3) * (w - old)
    return w


def _disturbed(word: str) -> list[str]:
    """The word with one letter put in after a third and after two thirds of it."""
    cuts = {len(word) // 3, 2 * len(word) // 3} - {0}
    return [word[:k] + chr(97 + (7 * k + ord(word[k - 1])) % 26) + word[k:] for k in sorted(cuts)]


def _fit_nystroem(landmarks: list[str], positives: list[str], negatives: list[str], support: np.ndarray) -> tuple[np.ndarray, float]:
    """Folded weight of every subsequence, and the bias."""
    value, vector = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])  # inverse root of the landmarks' kernel
    words = positives + negatives
    y = np.concatenate((np.ones(len(positives)), -np.ones(len(negatives))))
    weight = np.concatenate((support / support.sum(), np.full(len(negatives), 1 / max(len(negatives), 1))))
    w = _svm(kernel(words, landmarks) @ root, y, weight)
    fold = root @ w[:-1]
    out = np.zeros(1 << (_LETTER_BITS * ORDER), np.float64)
    for rows, code, v in features(landmarks):
        np.add.at(out, code, v * fold[rows][:, None])
    return out.astype(np.float32), float(w[-1])


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with Platt's smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack((margin, np.ones_like(margin)), axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - t) + 1e-6 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), grad)
        w = w - step * min(1, 5 / max(np.abs(step).max(), 1e-12))
    return float(max(w[0], 0)), float(w[1])


def train(bags: list[set[str]], labels: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> ToxicityModel:
    """Model from bags of written words and their labels (0 or 1)."""
    plain = [{p for w in b for p in plain_parts(w)} for b in bags]
    vocabulary = sorted(set().union(*plain))
    number = {w: i for i, w in enumerate(vocabulary)}
    return train_numbered(vocabulary, [np.array(sorted(number[w] for w in b), np.int32) for b in plain], np.array(labels), landmarks, rounds)


def candidates(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Which words may be witnesses, from the number of clean and of toxic texts that hold them."""
    rate = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return (toxic > 0) & ((clean == 0) | ((rate >= np.log(WITNESS_RATIO)) & (rate >= WITNESS_ERRORS * error)))


def train_numbered(vocabulary: list[str], bags: list[np.ndarray], y: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> ToxicityModel:
    """Model from bags of numbers into a sorted vocabulary of plain words."""
    if not len(y) or y.min() == y.max():
        return constant_model(float(y.mean()) if len(y) else 0.0)
    count = [np.bincount(np.concatenate([b for b, l in zip(bags, y, strict=True) if l == k]), minlength=len(vocabulary)) for k in (0, 1)]
    # log-odds of subsequences without gaps, damped where seldom seen
    size = 1 << (_LETTER_BITS * ORDER)
    seen = np.zeros((2, size))
    for rows, code, value in features(vocabulary):
        for k in (0, 1):
            own = count[k][rows] > 0
            np.add.at(seen[k], code[own], (value[own] > 0) * count[k][rows][own][:, None])
    total = seen.sum(axis=1)
    odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    odds *= seen[1] / (seen[1] + 3)
    model = ToxicityModel(odds.astype(np.float32), 0.0, 1.0, 0.0)
    speaks = candidates(count[0], count[1], int((y == 0).sum()), int((y == 1).sum()))
    clean = np.flatnonzero((count[0] > 0) & ~speaks)
    frequent = [vocabulary[i] for i in clean[np.argsort(-count[0][clean], kind="stable")[:landmarks // 2]]]
    some_clean = [vocabulary[i] for i in np.random.default_rng(7).permutation(clean)[:3000]]
    for _ in range(rounds):
        score = model.word_scores(vocabulary)
        # the witness of each toxic text
        witness: Counter = Counter()
        for bag in (b for b, l in zip(bags, y, strict=True) if l and len(b)):
            own = bag[speaks[bag]] if speaks[bag].any() else bag
            witness[vocabulary[own[score[own] == score[own].max()][-1]]] += 1
        if not witness:
            return constant_model(float(y.mean()))
        # witnesses that others resemble; those that stand alone are noise of the labels
        names = sorted(witness, key=lambda w: (-witness[w], w))[:4 * landmarks]
        times = np.array([witness[w] for w in names], float)
        alike = (kernel(names, names) > 0.4) @ times
        held = alike >= 2 if (alike >= 2).any() else alike > 0
        names, times = [w for w, h in zip(names, held, strict=True) if h], times[held]
        # virtual examples: disturbed witnesses are witnesses too
        known = {vocabulary[i] for i in clean}
        virtual = [(v, t / 4) for w, t in zip(names, times, strict=True) for v in _disturbed(w) if v not in known]
        hard = [vocabulary[i] for i in clean[np.argsort(-score[clean], kind="stable")[:2000]]]
        negatives = sorted(set(some_clean + hard + frequent))
        marks = names[:landmarks // 2] + hard[:landmarks // 4] + frequent[:landmarks // 4]
        weights, bias = _fit_nystroem(list(dict.fromkeys(marks)), names + [v for v, _ in virtual], negatives,
                                      np.sqrt(np.concatenate((times, [t for _, t in virtual]))))
        model = ToxicityModel(weights, bias, 1.0, 0.0)
    score = model.word_scores(vocabulary)
    margin = np.array([max(-1.0, float(score[b].max())) if len(b) else -1.0 for b in bags])
    slope, offset = _platt(margin, y)
    return model._replace(slope=slope, offset=offset)


def sample_labels(labels: DataFrame, label_column: str, id_column: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(__id, __label): one row for each of about ``train_rows`` ids of each class, drawn by a hash."""
    known = (labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull())
             .groupBy(F.col(id_column).alias("__id")).agg(F.max(label_column).cast("int").alias("__label")))
    counts = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    share = F.when(F.col("__label") == 1, F.lit(train_rows / max(counts.get(1, 0), 1))).otherwise(F.lit(train_rows / max(counts.get(0, 0), 1)))
    draw = F.xxhash64("__id", F.lit(5)).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    return known.where(draw < share)


def training_bags(df: DataFrame, label_column: str, text_column: str = "text") -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """Vocabulary, bags and labels of the rows; the driver gets the distinct plain words of these texts only."""
    known = df.select(F.col(label_column).cast("int").alias("label"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted({p for w in words_of(t.as_py()) for p in plain_parts(w)}) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    rows = known.mapInArrow(run, "label int, words array<string>").toArrow().combine_chunks()
    if not rows.num_rows:
        return [], [], np.empty(0, np.int64)
    lists = rows.column("words").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    place = np.empty(len(words), np.int32)
    place[order] = np.arange(len(words), dtype=np.int32)
    flat, ends = place[coded.indices.to_numpy()], np.cumsum(pc.list_value_length(lists).to_numpy())
    bags = [np.sort(b) for b in np.split(flat, ends[:-1])]
    # in a fixed order, so that the model does not depend on how rows are dealt
    labels = rows.column("label").to_numpy()
    line = sorted(range(len(bags)), key=lambda i: (labels[i], bags[i].tobytes()))
    return [words[i] for i in order], [bags[i] for i in line], labels[line]


def _scored(model: ToxicityModel, spark: SparkSession):
    shared = spark.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch, texts: pa.Array, scorer: list) -> tuple[np.ndarray, list[str | None]]:
        if not scorer:
            scorer.append(Scorer(shared.value))
        margin, word = [], []
        for at in range(0, batch.num_rows, 512):
            m, w = scorer[0].margins([words_of(t) for t in texts.slice(at, 512).to_pylist()])
            margin += m
            word += w
        return shared.value.probability(np.array(margin, float)), word

    return score


def score_texts(df: DataFrame, model: ToxicityModel, carry: dict[str, Column], text_column: str = "text") -> DataFrame:
    """The carried columns with ``score``, ``predicted`` and the word that decided."""
    score = _scored(model, df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: list = []
        for b in batches:
            p, word = score(b, b.column(b.num_columns - 1), scorer)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(word, pa.string())],
                                             [*b.schema.names[:-1], "score", "predicted", "evidence"])

    rows = df.select(*[c.alias(n) for n, c in carry.items()], F.col(text_column).cast("string").alias("text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int, evidence string")


def without_toxic(df: DataFrame, model: ToxicityModel, text_column: str = "text") -> DataFrame:
    """``df`` without the texts predicted toxic; all columns stay."""
    score = _scored(model, df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: list = []
        for b in batches:
            p, _ = score(b, b.column(b.schema.get_field_index(text_column)), scorer)
            yield b.filter(pa.array(p < 0.5))

    return df.mapInArrow(run, df.schema)


def fit(docs: DataFrame, labels: DataFrame, label_column: str = "toxic", id_column: str = "doc_id") -> ToxicityModel:
    """Model from documents and the labels that name them by id.

    The labels are sampled before they meet the texts: the sample is bounded by
    ``TRAIN_ROWS`` of each class, so it is broadcast and no text is shuffled."""
    sample = F.broadcast(sample_labels(labels, label_column, id_column))
    joined = docs.select(F.col(id_column).alias("__id"), "text").join(sample, "__id")
    return train_numbered(*training_bags(joined, "__label"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(id_bucket(5) != 0))
    return score_texts(docs, model, {"doc_id": F.col("doc_id"), "held_out": id_bucket(5) == 0})
