"""PII (operator 2): base patterns and a skip-chain conditional random field.

Base spans come from four patterns, leftmost and non-overlapping for each kind, with the checks of ``base_spans``.
The field adds spans the patterns miss.  Its nodes are the candidate tokens of a document: tokens that hold a digit or
an ``@``; tokens of letters only are clamped to "other", which cuts the chain between candidates and leaves their
neighbours' words as features.  Node potentials come from a multinomial logistic model over shape and context,
chain potentials join candidates that stand side by side, and skip potentials join every later mention of a repeated or
similar token (same letters and digits, or same shape and length) to the one before it, so that a document labels such
tokens alike.  Loopy sum-product message passing runs for a fixed number of rounds; a candidate run whose marginal
for a kind is at least ``sure`` and that touches no base span becomes a span of that kind.  Base spans are observed and
always stay.

Weights of nodes and edges are learned together in numpy, by pseudo-likelihood, from at most ``fit_rows`` documents of at
most ``fit_chars`` characters whose base spans serve as labels; a candidate outside them that resembles one inside is
left out rather than taught as "other".  ``recovered`` measures added spans on base spans hidden from the field.

Cases: a null text is empty and has no spans; ids may be null or repeat; an empty table gives no rows; without base
spans in the sample the field adds nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import textops

KINDS = ("email", "ip", "card", "phone")
#: The base patterns (fixed values).  Only the ip pattern says more than the contract: a match never starts inside a run
#: of digits, as one that fails at the run's start fails at every later digit too; this keeps long numbers linear.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def _matches(pattern: re.Pattern, sign: str, text: str) -> Iterator[tuple[int, int]]:
    """What ``finditer`` finds, but the scan starts at the run of local characters before each ``sign``."""
    at = 0
    while (i := text.find(sign, at)) >= 0:
        begin = i
        if pattern is EMAIL:
            while begin > at and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
                begin -= 1
        m = pattern.match(text, begin) if begin < i or pattern is not EMAIL else None
        if m:
            yield m.span()
            at = m.end()
        else:
            at = i + 1


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by kind and start; matches that fail their check are dropped, not retried."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, s, e) for s, e in _matches(EMAIL, "@", text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and _card(m[0])]
    if "+" in text:
        out += [(3, s, e) for s, e in _matches(PHONE, "+", text) if 8 <= sum(c.isdigit() for c in text[s:e]) <= 15]
    return out


_CANDIDATE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_RUNS = re.compile(r"a+|A+|9+|(.)\1+")
_NODE = 1 << 12
_FEATURES = 9


class _Shapes(dict):
    """Code point to its class: a and A for letters, 9 for digits, others themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        return self[code]


_SHAPES = _Shapes()


def shape(token: str) -> str:
    """Letters to a or A, digits to 9, runs folded, others kept."""
    return _RUNS.sub(lambda m: m[0][0] + "+", token.translate(_SHAPES))


def touched(spans: list[Span], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Kind + 1 of the first kind with a span that overlaps each range, or 0.  Spans of a kind ascend and do not overlap."""
    out = np.zeros(len(start), np.int64)
    for kind in reversed(range(len(KINDS))):
        a, b = (np.array([x[i] for x in spans if x[0] == kind], np.int64) for i in (1, 2))
        if len(a):
            first = np.searchsorted(b, start, "right")
            there = first < len(a)
            there[there] = a[first[there]] < end[there]
            out[there] = kind + 1
    return out


class Tokens:
    """Candidate tokens of one text with features, chain neighbours and skip edges; linear in the text."""

    def __init__(self, text: str):
        self.span = [m.span() for m in _TOKEN.finditer(text) if _CANDIDATE.search(m[0])]
        n = len(self.span)
        self.features = np.zeros((n, _FEATURES), np.int64)
        forms, shapes = [], []
        for i, (s, e) in enumerate(self.span):
            token = text[s:e]
            before = _TOKEN.findall(text[max(0, s - 24) : s])[-1:] or [""]
            after = _TOKEN.findall(text[e : e + 24])[:1] or [""]
            sh = shape(token)
            digits = sum(map(token.count, "0123456789"))
            names = (f"s{sh}", f"n{min(digits, 20)}", f"l{min(len(token), 30)}", f"b{shape(before[0])[-4:]}", f"a{shape(after[0])[:4]}", f"x{sh[:3]}", f"y{sh[-3:]}", f"d{token.count('.')}{'@' in token}{'+' in token}", f"k{_card(token) if digits == len(token) else None}{token[0]}")
            self.features[i] = [zlib.crc32(f.encode()) % _NODE for f in names]
            forms.append("".join(filter(str.isalnum, token.lower())))
            shapes.append((sh, len(token)) if "@" in token or digits >= 6 else None)
        self.side = np.array([not text[self.span[i][1] : self.span[i + 1][0]].strip(" \t\n\v\f\r") for i in range(n - 1)], bool)
        left = np.flatnonzero(self.side)
        self.chain = np.stack([left, left + 1], 1)
        skip: set[tuple[int, int]] = set()
        for keys in (forms, shapes):
            last: dict = {}
            for i, k in enumerate(keys):
                if k:
                    j = last.get(k)
                    if j is not None and not (j == i - 1 and self.side[j]):
                        skip.add((j, i))
                    last[k] = i
        self.skip = np.array(sorted(skip), np.int64).reshape(-1, 2)

    def labels(self, spans: list[Span]) -> np.ndarray:
        """Kind + 1 of the base span each candidate overlaps, or 0."""
        at = np.array(self.span, np.int64).reshape(-1, 2)
        return touched(spans, at[:, 0], at[:, 1])


class Field:
    """Node weights (features x labels), chain and skip potentials (labels x labels, log scale)."""

    def __init__(self) -> None:
        n = len(KINDS) + 1
        self.node, self.chain, self.skip, self.ready = np.zeros((_NODE, n)), np.zeros((n, n)), np.zeros((n, n)), False

    def fit(self, documents: list[tuple[Tokens, np.ndarray]], passes: int = 60, rate: float = 0.5, decay: float = 1e-4) -> Field:
        """Pseudo-likelihood: node weights and both potentials are learned together from each candidate's label given its
        neighbours' labels.  A candidate outside the base spans that a skip edge joins to one inside is not counted as
        "other": the patterns may have missed it."""
        first = np.cumsum([0, *(len(y) for _, y in documents)])
        y = np.concatenate([np.zeros(0, np.int64), *(y for _, y in documents)])
        if not y.any():
            return self
        rows = np.concatenate([t.features for t, _ in documents])
        chain, skip = (np.concatenate([getattr(t, name) + at for (t, _), at in zip(documents, first[:-1], strict=True)]) for name in ("chain", "skip"))
        counts = np.ones(len(y))
        for a, b in (skip.T, skip.T[::-1]):
            counts[a[(y[a] == 0) & (y[b] > 0)]] = 0
        n = self.node.shape[1]
        squares = {k: np.full_like(getattr(self, k), 1e-6) for k in ("node", "chain", "skip")}
        onehot = np.eye(n)[y]
        total = counts.sum()
        for _ in range(passes):
            z = self.node[rows].sum(1)
            for (a, b), pot in ((chain.T, self.chain), (skip.T, self.skip)):
                for k in range(n):
                    z[:, k] += np.bincount(b, pot[y[a], k], len(y)) + np.bincount(a, pot[k, y[b]], len(y))
            z = np.exp(z - z.max(1, keepdims=True))
            error = (z / z.sum(1, keepdims=True) - onehot) * counts[:, None]
            node = np.stack([np.bincount(rows.ravel(), np.repeat(error[:, k], _FEATURES), _NODE) for k in range(n)], 1)
            pairs = [onehot[a].T @ error[b] + error[a].T @ onehot[b] for a, b in (chain.T, skip.T)]
            for k, g in (("node", node), ("chain", pairs[0]), ("skip", (pairs[1] + pairs[1].T) / 2)):
                g = g / total + decay * getattr(self, k)
                squares[k] += g**2
                setattr(self, k, np.clip(getattr(self, k) - rate * g / np.sqrt(squares[k]), -6, 6))
        self.ready = True
        return self

    def marginals(self, tokens: Tokens, observed: np.ndarray, rounds: int = 6) -> np.ndarray:
        """Beliefs after loopy message passing; observed labels (> 0) are clamped."""
        unary = self.node[tokens.features].sum(1)
        unary = unary - unary.max(1, keepdims=True)
        unary[observed > 0] = -30.0
        unary[observed > 0, observed[observed > 0]] = 0.0
        a = np.concatenate([tokens.chain, tokens.skip])
        if len(a):
            pot = np.repeat(np.stack([self.chain, self.skip]), [len(tokens.chain), len(tokens.skip)], 0)
            source, target = np.concatenate([a[:, 0], a[:, 1]]), np.concatenate([a[:, 1], a[:, 0]])
            pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
            message = np.zeros((len(source), unary.shape[1]))
            back = np.concatenate([np.arange(len(a), 2 * len(a)), np.arange(len(a))])
            arriving = lambda: np.stack([np.bincount(target, message[:, k], len(unary)) for k in range(unary.shape[1])], 1)
            for _ in range(rounds):
                out = ((unary + arriving())[source] - message[back])[:, :, None] + pot
                top = out.max(1, keepdims=True)
                new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                new -= new.max(1, keepdims=True)
                message = 0.5 * message + 0.5 * new
            unary = unary + arriving()
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[Span], field: Field, sure: float) -> list[Span]:
    """Spans the field finds beside the base spans: runs of side-by-side candidates of one kind, outer punctuation cut."""
    if not field.ready:
        return []
    tokens = Tokens(text)
    if not tokens.span:
        return []
    observed = tokens.labels(base)
    if observed.all():
        return []
    belief = field.marginals(tokens, observed)
    label = np.where((belief.max(1) >= sure) & (observed == 0), belief.argmax(1), 0).tolist()
    out: list[Span] = []
    for i, (s, e) in enumerate(tokens.span):
        if not label[i]:
            continue
        if out and tokens.side[i - 1] and label[i - 1] == label[i] and out[-1][2] == tokens.span[i - 1][1]:
            out[-1] = (out[-1][0], out[-1][1], e)
        else:
            out.append((label[i] - 1, s, e))
    trim = []
    for k, s, e in out:
        while e > s and text[e - 1] in ".,;:!?)]}\"'":
            e -= 1
        while s < e and text[s] in "([{\"'":
            s += 1
        if e > s:
            trim.append((k, s, e))
    free = touched(base, *(np.array([x[i] for x in trim], np.int64) for i in (1, 2))) == 0
    return [x for x, f in zip(trim, free, strict=True) if f]


def recovered(texts: list[str], field: Field, sure: float = 0.95, every: int = 3) -> dict[str, tuple[int, int, int]]:
    """How well added spans stand for missed ones: every ``every``-th base span of the texts is hidden from the field.

    By kind: hidden spans, hidden spans an added span of the kind overlaps (recall), added spans that overlap none of
    any kind (what a precision counts against the field, though the patterns may have missed some of these)."""
    out = {k: [0, 0, 0] for k in KINDS}
    turn = 0
    for text in texts:
        spans, hidden = [], []
        for x in base_spans(text):
            turn += 1
            (spans if turn % every else hidden).append(x)
        added = added_spans(text, spans, field, sure)
        for kind, name in enumerate(KINDS):
            mine = [x for x in hidden if x[0] == kind]
            own = [x for x in added if x[0] == kind]
            of = lambda some: tuple(np.array([x[i] for x in some], np.int64) for i in (1, 2))
            out[name][0] += len(mine)
            out[name][1] += int((touched(own, *of(mine)) > 0).sum())
            out[name][2] += int((touched(hidden, *of(own)) == 0).sum())
    return {k: tuple(v) for k, v in out.items()}


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


_HOLDS = np.zeros(256, bool)
_HOLDS[[64, *range(48, 58)]] = True


def fit_texts(texts: list[str]) -> Field:
    found = [(Tokens(x), x) for x in texts]
    return Field().fit([(t, t.labels(base_spans(x))) for t, x in found])


def fit_field(docs: DataFrame, fit_rows: int = 2000, fit_chars: int = 20_000, text_col: str = "text") -> Field:
    """Learn from documents that hold a digit, in a fixed order by hash."""
    text = F.col(text_col)
    held = docs.where(text.rlike("[0-9@]") & (F.length(text) <= fit_chars)).select(F.xxhash64(text).alias("h"), text.alias("text"))
    chosen = held.select("h").distinct().orderBy("h").limit(fit_rows)
    sample = held.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h")
    return fit_texts([r["text"] for r in sample.collect()])


def find_pii(docs: DataFrame, field: Field, sure: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and added spans (arrays of kind, start, end)."""
    kind = "array<struct<kind:string,start:int,end:int>>"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def structs(spans: list[list[Span]]) -> pa.Array:
        item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(x)] for x in spans], pa.list_(item))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, more = _spans(b.column("text"), sent.value, sure)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), structs(base), structs(more)], names=["doc_id", "base", "added"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, base {kind}, added {kind}")


def _spans(column: pa.Array, field: Field, sure: float) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base and added spans of every text; a text without digit and ``@`` holds none and is not decoded."""
    base: list[list[Span]] = [[] for _ in range(len(column))]
    more: list[list[Span]] = [[] for _ in range(len(column))]
    for begin, _, buf, offsets in textops.slices(column):
        held = np.concatenate([[0], np.cumsum(_HOLDS[buf], dtype=np.int32)])
        for i in np.flatnonzero(held[offsets[1:]] > held[offsets[:-1]]).tolist():
            text = textops.text_of(buf, offsets, i).decode("utf-8", "replace")
            base[begin + i] = base_spans(text)
            more[begin + i] = added_spans(text, base[begin + i], field, sure)
    return base, more


def redact(docs: DataFrame, field: Field, sure: float = 0.95, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, every span of the text replaced by its kind in angle brackets; overlaps go together."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, more = _spans(b.column(text_col), sent.value, sure)
            texts = b.column(text_col).to_pylist()
            for i, spans in enumerate(zip(base, more, strict=True)):
                end = None
                for k, s, e in sorted((x for y in spans for x in y), key=lambda x: (-x[2], x[1])):
                    if end is None or e <= end:
                        texts[i] = f"{texts[i][:s]}<{KINDS[k]}>{texts[i][e:]}"
                        end = s
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digest_pii(docs: DataFrame, sure: float = 0.95) -> DataFrame:
    """Counts and digest of base spans, and all spans, of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_field(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, more = _spans(b.column("text"), sent.value, sure)
            counts = [pa.array([sum(k == j for k, _, _ in x) for x in base], pa.int64()) for j in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in base]), pa.array([written(x + y) for x, y in zip(base, more, strict=True)], pa.string()), pa.array([len(y) for y in more], pa.int64()), pa.array([len(x) + len(y) for x, y in zip(base, more, strict=True)], pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"],
            )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
