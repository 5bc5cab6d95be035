"""Personal data by fixed patterns and a skip-chain conditional random field.

*Base.*  E-mail addresses, IP addresses, payment cards (Luhn) and phone numbers are
found by pattern, leftmost and without overlap for each kind; these spans always stay.

*Field.*  Tokens in question carry a label (a kind, or none): those that hold a digit, an @,
"(at)" or "[at]" (blanks around it part the address and are not bridged), and those that repeat the local part of an address of the same
document, if that part has a sign that plain words lack.  All other tokens are fixed to
none, so the chain falls into runs.
Node potentials come from the token's form and its neighbours, chain potentials
from adjacent labels.  Skip edges join distant tokens that repeat each other (the
same last seven digits, the same local part of an address) or resemble each other
(the same form); a learned reward for equal labels makes labels consistent across
the document.  Each token is joined to the next one of its class only, so edges
grow with tokens, not with pairs.  Loopy sum-product messages run over the whole
document, and over all documents of a batch at once.  Runs of tokens labelled
alike that touch no base span become further spans.

*Learning.*  No labels are given, so the base spans label the tokens of at most about
``TRAIN_ROWS`` distinct texts (a documented bound; chosen by a hash of the text, copies count once)
and the weights maximise the pseudo-likelihood (a skip neighbour's label is a feature) times a normal
prior, whose mean rewards equal labels of skip neighbours.  Texts come in the order of their
hashes until ``TRAIN_TOKENS`` tokens in question are reached; of a text with more than
``TRAIN_TOKENS_OF_TEXT`` an even share is drawn by hash.  Tokens that the base patterns cannot
judge ("(at)" and repeats of a local part) are no examples.

Texts are read whole, where they lie, with no shuffle.  Defined results: a null or
empty text has no spans; repeated rows are judged one by one; extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table
from .registry import query

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LABELS = NONE + 1
TRAIN_ROWS = 3000
#: Tokens in question to learn from, of one text and in all.
TRAIN_TOKENS_OF_TEXT = 1000
TRAIN_TOKENS = 100_000
MESSAGE_ROUNDS = 12
#: Prior mean of the rewards for equal labels of repeated and of similar tokens: what
#: few documents show is pulled towards these.
SKIP_PRIOR = (2.0, 0.5)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a match can begin only where a run of digits begins, so long runs cost one try
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_CANDIDATE = re.compile(r"[0-9@]")
_WRITTEN_AT = re.compile(r"[(\[][aA][tT][)\]]")
_AT = re.compile(r"@|[(\[][aA][tT][)\]]")
#: A local part with none of these is a plain word, whose repeats say nothing.
_OWN_SIGN = re.compile(r"[0-9._%+-]")
_EDGES = ".,;:!?\"'<>[]{}"

Span = tuple[int, int, int]  # kind, start, end (code points, end exclusive)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and then by start."""
    out = [(0, *x) for x in _emails(text)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m.group())) <= 15]
    return out


#: What a node's features are; the names are the order of the weights.
FEATURES = ("bias", "at", "at_dot", "plus", "bracket", "hyphen", "dots3", "dot", "letters", "only_digits", "digits_1_2", "digits_3_6",
            "digits_7_12", "digits_13_19", "digits_more", "luhn", "octets", "equals", "percent", "before_digits", "after_digits",
            "before_plus", "before_colon", "first", "last", "mixed_case")


def _in_question(token: str) -> bool:
    return _CANDIDATE.search(token) is not None or _WRITTEN_AT.search(token) is not None


def _local_part(core: str) -> str | None:
    """What stands before the at sign of a token, in lower case; none without one."""
    parts = _AT.split(core.lower(), maxsplit=1)
    return parts[0] if len(parts) > 1 and parts[0] else None


def _core(word: str) -> str:
    """The token without signs around it; brackets that write an at sign stay."""
    return word.strip(_EDGES)


def _node(word: str, before: str, after: str, first: bool, last: bool) -> list[int]:
    core = _AT.sub("@", _core(word))
    digits = _DIGITS.sub("", core)
    n = len(digits)
    alpha = any(c.isalpha() for c in core)
    numeric = not alpha and n > 0
    octets = core.split(".")
    on = ("@" in core and not core.startswith("@"), "@" in core and "." in core.rpartition("@")[2], core.startswith("+"), "(" in core or ")" in core, "-" in core and numeric,
          core.count(".") == 3 and numeric, "." in core, alpha, n > 0 and n == len(core), 1 <= n <= 2, 3 <= n <= 6, 7 <= n <= 12, 13 <= n <= 19, n > 19,
          13 <= n <= 19 and numeric and luhn(digits), len(octets) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in octets),
          "=" in core, "%" in core, _CANDIDATE.search(before) is not None, _CANDIDATE.search(after) is not None, before.startswith("+"),
          before.endswith(":"), first, last, alpha and core != core.lower())
    return [0, *(i + 1 for i, x in enumerate(on) if x)]


class Graph(NamedTuple):
    """Unfixed tokens of one or more documents."""
    spans: list[tuple[int, int, int]]   # text, start, end
    nodes: list[list[int]]              # features that are on
    chain: list[tuple[int, int]]        # adjacent tokens
    repeats: list[tuple[int, int]]
    similar: list[tuple[int, int]]
    judged: Sequence[bool] = ()         # whether base patterns can label the token


def _classes(core: str, locals_: set[str]) -> tuple[str | None, str]:
    """What a token must share to repeat another, and to resemble it."""
    digits = _DIGITS.sub("", core)
    local = _local_part(core) or (core.lower() if core.lower() in locals_ else None)
    same = "a" + local if local else "d" + digits[-7:] if len(digits) >= 7 else None
    return same, re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "0", core)))


def build_graph(texts: list[str | None]) -> Graph:
    g = Graph([], [], [], [], [], [])
    for t, text in enumerate(texts):
        if not text or not _in_question(text):
            continue
        tokens = list(_TOKEN.finditer(text))
        words = [m.group() for m in tokens]
        asked = [_in_question(w) for w in words]
        found = {_local_part(_core(w)) for w, x in zip(words, asked, strict=True) if x and _AT.search(w)}
        locals_ = {x for x in found if x and _OWN_SIGN.search(x)}
        seen: dict[str, int] = {}
        previous = -2
        for i, (m, word) in enumerate(zip(tokens, words, strict=True)):
            core = _core(word) if asked[i] or locals_ else ""
            bare = bool(locals_) and core.lower() in locals_
            if not asked[i] and not bare:
                continue
            node = len(g.nodes)
            g.spans.append((t, m.start(), m.end()))
            g.nodes.append(_node(word, words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "", i == 0, i + 1 == len(words)))
            g.judged.append(not bare and not _WRITTEN_AT.search(word))
            if previous == i - 1:
                g.chain.append((node - 1, node))
            previous = i
            same, form = _classes(core, locals_)
            for key, edges in ((same, g.repeats), ("f" + form, g.similar)):
                if key is not None:
                    if key in seen:
                        edges.append((seen[key], node))
                    seen[key] = node
    return g


class Weights(NamedTuple):
    node: np.ndarray     # feature, label
    chain: np.ndarray    # label, next label
    repeat: float        # reward of equal labels
    similar: float


def marginals(g: Graph, w: Weights, rounds: int = MESSAGE_ROUNDS) -> np.ndarray:
    """Label probabilities of each node after loopy sum-product message passing."""
    score = np.stack([w.node[on].sum(axis=0) for on in g.nodes]) if g.nodes else np.empty((0, LABELS))
    edges = [np.array(e, np.int64).reshape(-1, 2) for e in (g.chain, g.repeats, g.similar)]
    left, right = (np.concatenate([e[:, i] for e in edges]) for i in (0, 1))
    if not len(left):
        return _softmax(score)
    pair = np.concatenate([np.broadcast_to(m, (len(e), LABELS, LABELS)) for e, m in zip(edges, (w.chain, w.repeat * np.eye(LABELS), w.similar * np.eye(LABELS)), strict=True)])
    source, target = np.concatenate((left, right)), np.concatenate((right, left))
    potential = np.exp(np.concatenate((pair, pair.transpose(0, 2, 1))))
    back = np.roll(np.arange(len(source)), len(left))  # the message the other way
    message = np.zeros((len(source), LABELS))
    for _ in range(rounds):
        belief = score.copy()
        np.add.at(belief, target, message)
        out = belief[source] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("el,elk->ek", out, potential))
        new -= new.max(axis=1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    np.add.at(score, target, message)
    return _softmax(score)


def _softmax(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], steps: int = 400, pace: float = 0.1, decay: float = 1e-3) -> Weights:
    """Pseudo-likelihood weights, with base spans as labels."""
    g = build_graph(texts)
    n, f = len(g.nodes), len(FEATURES)
    if not n:
        return Weights(np.zeros((f, LABELS)), np.zeros((LABELS, LABELS)), *SKIP_PRIOR)
    spans = [base_spans(t) for t in texts]
    y = np.array([next((k for k, a, b in spans[t] if a < end and start < b), NONE) for t, start, end in g.spans])
    x = np.zeros((n, f + 4 * LABELS))
    for i, on in enumerate(g.nodes):
        x[i, on] = 1
    # the neighbours' labels: left, right, repeated, similar
    for at, edges in ((0, g.chain), (2, g.repeats), (3, g.similar)):
        for a, b in edges:
            if g.judged[a]:
                x[b, f + at * LABELS + y[a]] += 1
            if g.judged[b]:
                x[a, f + (1 if at == 0 else at) * LABELS + y[b]] += 1
    judged = np.array(g.judged)
    x, goal, n = x[judged], np.eye(LABELS)[y[judged]], max(int(judged.sum()), 1)
    prior = np.zeros((x.shape[1], LABELS))
    for at, reward in zip((2, 3), SKIP_PRIOR, strict=True):
        prior[f + at * LABELS:f + (at + 1) * LABELS] = np.eye(LABELS) * reward
    w = prior.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)

    def tied(a: np.ndarray) -> np.ndarray:
        """One chain table for both directions, one reward for each kind of skip edge."""
        a = a.copy()
        chain = a[f:f + LABELS] + a[f + LABELS:f + 2 * LABELS].T
        a[f:f + LABELS], a[f + LABELS:f + 2 * LABELS] = chain / 2, chain.T / 2
        for at in (2, 3):
            block = slice(f + at * LABELS, f + (at + 1) * LABELS)
            a[block] = np.eye(LABELS) * (np.trace(a[block]) / LABELS)
        return a

    for k in range(1, steps + 1):
        grad = tied(x.T @ (_softmax(x @ w) - goal) / n) + decay * (w - prior)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w = tied(w - pace * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8))
    at = f + 2 * LABELS
    return Weights(w[:f], w[f:f + LABELS], float(max(0, w[at, 0])), float(max(0, w[at + LABELS, 0])))


def find_spans(texts: list[str | None], w: Weights) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans, of each text; both by kind and then by start."""
    base = [base_spans(t) if t and (_CANDIDATE.search(t) or "+" in t) else [] for t in texts]
    g = build_graph(texts)
    label = marginals(g, w).argmax(axis=1) if g.nodes else np.empty(0, int)
    linked = {b for _, b in g.chain}
    runs: list[list[int]] = []
    for i in np.flatnonzero(label != NONE).tolist():
        if i in linked and runs and runs[-1][1] == i - 1 and runs[-1][2] == label[i]:
            runs[-1][1] = i
        else:
            runs.append([i, i, int(label[i])])
    more: dict[int, list[Span]] = {}
    for a, b, kind in runs:
        t, start, end = g.spans[a][0], g.spans[a][1], g.spans[b][2]
        word = texts[t][start:end]
        start += len(word) - len(word.lstrip(_EDGES))
        end -= len(word) - len(word.rstrip(_EDGES))
        if start < end and not any(s < end and start < e for _, s, e in base[t]):
            more.setdefault(t, []).append((kind, start, end))
    return [(b, sorted(b + more[t]) if t in more else b) for t, b in enumerate(base)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans go as one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def fit(df: DataFrame, text_column: str = "text", train_rows: int = TRAIN_ROWS) -> Weights:
    """Weights from at most about ``train_rows`` distinct texts that hold a token in question."""
    texts = df.select(F.col(text_column).cast("string").alias("text")).where(F.col("text").rlike(r"[0-9@]|[(\[][aA][tT][)\]]"))
    texts = texts.withColumn("h", F.xxhash64("text", F.lit(3)))
    share = train_rows / max(texts.agg(F.approx_count_distinct("h")).first()[0], 1)
    rows = texts.where(F.col("h").bitwiseAND((1 << 53) - 1) / float(1 << 53) < share)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens that matter and two on either side stand for the text, which bounds what the driver gets."""
        seen: set[int] = set()  # distinct texts drawn, so bounded by ``train_rows``
        for b in batches:
            kept, out = [], []
            for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h in seen:
                    continue
                seen.add(h)
                kept.append(h)
                out.append(_excerpt(t, h))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(kept, pa.int64())], ["text", "h"])

    found = rows.mapInArrow(near, "text string, h long").groupBy("h").agg(F.min("text").alias("text"))
    held, tokens = [], 0
    for r in found.orderBy("h").toLocalIterator():
        if tokens >= TRAIN_TOKENS:
            break
        held.append(r["text"])
        tokens += sum(_in_question(x) for x in r["text"].split())
    return train(held)


def _excerpt(text: str, seed: int) -> str:
    """Tokens in question and two on either side; of a crowded text the tokens with the least hashes."""
    tokens = text.split()
    asked = [i for i, x in enumerate(tokens) if _in_question(x)]
    if len(asked) > TRAIN_TOKENS_OF_TEXT:
        order = mix64(np.array(asked, np.uint64) ^ np.uint64(seed % (1 << 64)))
        asked = [asked[j] for j in np.sort(np.argsort(order, kind="stable")[:TRAIN_TOKENS_OF_TEXT])]
    keep = sorted({j for i in asked for j in range(max(0, i - 2), min(i + 3, len(tokens)))})
    return " ".join(tokens[j] for j in keep)


def _spread(batch: pa.RecordBatch, texts: pa.Array, w: Weights) -> Iterator[tuple[int, int, list]]:
    for at in range(0, batch.num_rows, 256):
        part = texts.slice(at, 256).to_pylist()
        yield at, part, find_spans(part, w)


def personal_data(df: DataFrame, w: Weights, carry: dict[str, Column], text_column: str = "text") -> DataFrame:
    """The carried columns with the number of base spans by kind, ``base`` and ``spans``."""
    shared = df.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [f for _, _, x in _spread(b, b.column(b.num_columns - 1), shared.value) for f in x]
            counts = np.array([np.bincount([s[0] for s in base], minlength=NONE) for base, _ in found], np.int64).reshape(-1, NONE)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *(pa.array(counts[:, k]) for k in range(NONE)),
                 pa.array([written(x) for x, _ in found], pa.string()), pa.array([written(x) for _, x in found], pa.string())],
                [*b.schema.names[:-1], *(f"n_{k}" for k in KINDS), "base", "spans"])

    rows = df.select(*[c.alias(n) for n, c in carry.items()], F.col(text_column).cast("string").alias("text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")


def redacted(df: DataFrame, w: Weights, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """``df`` with every span in the text replaced; a length column is brought up to date."""
    shared = df.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_column)
            out = [redact(t, spans) if spans else t for _, part, x in _spread(b, b.column(k), shared.value) for t, (_, spans) in zip(part, x, strict=True)]
            columns = list(b.columns)
            columns[k] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    out = df.mapInArrow(run, df.schema)
    if length_column and length_column in df.columns:
        out = out.withColumn(length_column, F.when(F.col(text_column).isNull(), F.col(length_column)).otherwise(F.length(text_column)).cast(df.schema[length_column].dataType))
    return out


@query("op8_personal_data")
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_data(docs, fit(docs), {"doc_id": F.col("doc_id")})
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
