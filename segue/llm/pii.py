"""Personal data: base patterns, and candidates selected by gradient boosting.

Base spans are found by four fixed patterns and always stay.  Generators of high recall
propose further spans, which may overlap each other; boosted trees score them by features of
their format and of the text around them, and those above a calibrated threshold are added
where they overlap nothing better.

The generators run over all texts, and a bounded number of proposals of each kind and label
(``train_docs``, the least by hash) train the trees, however rare they are.  Labels come from evidence that does not ask the base patterns: check digits,
formats, and cue words before the span.  Base spans are also shown with the marks that define
them written otherwise ("at" and "dot", no country code, dots in a card), as positives.  A
fixed part of all proposals is held out; a histogram of its scores over the whole table
calibrates them, and the threshold is the lowest that keeps the wanted precision there.

Defined results: a null text is empty and has no span; repeated rows get the same spans each;
where a table without both kinds of labels gives no model, the evidence decides; an empty table
gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship_package

TRAIN_DOCS = 4000
PRECISION = 0.97
#: Bins of the score histogram to one unit of the raw score.
BINS = 100
# fixed values: kinds in their order and the base patterns
KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
_LOCAL_BACK = re.compile(f"[{LOCAL}]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# no match begins inside a run of digits or gives one up, so long runs are read once
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

GENERATORS = [
    ("email", re.compile(r"[\w.%+-]{1,64} ?(?:@|[(\[]at[)\]]| at ) ?[\w-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]| dot ) ?[\w-]{2,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[.,:][0-9]{1,3}){3}(?![0-9.])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./-]?[0-9]{3,6}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9]{1,4}\)?(?:[\x20()./-]{1,2}[0-9]{2,4}){2,5}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9.])[(]?[0-9]{3}[)]?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")),
]
_CUES = [re.compile(p, re.I) for p in (r"mail|contact|@", r"\bip\b|host|server", r"card|visa|pay|account", r"phone|tel|call|mobil|fax")]


_AT = re.compile(r"[(\[]at[)\]]")
_DOT = re.compile(r"[(\[]dot[)\]]| dot ")
_TAIL = re.compile(r"(?:\.| dot |[(\[]dot[)\]]) ?[A-Za-z]{2,6}$")
_GROUPED = re.compile(r"[(]?[0-9]{3}[)]?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}")
_DATE = re.compile(r"[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}")
_NUMBERED = re.compile(r"\b(?:order|invoice|serial|version|ref|isbn|issn|no|nr|id)\b\W*(?:\w*\W+)?$", re.I)
_MAIL = re.compile(r"mail|contact|\bwrite\b|\breach\b", re.I)
_HOST = re.compile(r"\bip\b|\bhost|\bserver|\baddress", re.I)
_CALL = re.compile(r"phone|\btel\b|\bcall\b|\bmobile?\b|\bcell\b|\bfax\b", re.I)


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches, looked for around each @ so that long runs cost linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at - _LOCAL_BACK.match(text[free:at][::-1]).end()
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield Span("email", start, domain.end())
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, kind by kind."""
    found = list(_emails(text))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split(".")):
            found.append(Span("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGIT.findall(m[0])) if m.end() - m.start() < 64 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(Span("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(Span("phone", *m.span()))
    return found


def candidates(text: str) -> list[Span]:
    """Proposals of all generators; they may overlap."""
    if "@" not in text and " at" not in text and "at)" not in text and "at]" not in text and not _DIGIT.search(text):
        return []
    found = []
    for kind, pattern in GENERATORS:
        if kind == "email" or _DIGIT.search(text):
            found += [Span(kind, *m.span()) for m in pattern.finditer(text)]
    return list(dict.fromkeys(found))


def evidence(text: str, span: Span) -> bool:
    """Whether check digits, format and cue words speak for a proposal; the base patterns are not asked."""
    kind, start, end = span
    body, before = text[start:end], text[max(0, start - 30) : start]
    digits = "".join(_DIGIT.findall(body))
    if kind == "card":
        return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)
    if kind == "ip":
        dotted = body.count(".") == 3 or bool(_HOST.search(before))
        return dotted and all(int(p) <= 255 for p in re.split("[.,:]", body))
    if kind == "email":
        if not _TAIL.search(body):
            return False
        return "@" in body or bool(_AT.search(body) or _DOT.search(body)) or (". " not in body and bool(_MAIL.search(before)))
    if not 7 <= len(digits) <= 15 or _DATE.search(body) or _NUMBERED.search(before) or (len(digits) > 12 and luhn(digits)):
        return False
    return bool(_CALL.search(before) or _GROUPED.fullmatch(body)) or (body[0] == "+" and len(digits) > 8)


def rewritten(text: str, span: Span) -> list[tuple[str, Span]]:
    """A base span with the marks that define it written otherwise."""
    kind, start, end = span
    body = text[start:end]
    if kind == "email":
        local, domain = body.rsplit("@", 1)
        new = [f"{local} at {domain.replace('.', ' dot ')}", f"{local}[at]{domain.replace('.', '[dot]')}", f"{local} (at) {domain}"]
    elif kind == "card":
        digits = "".join(_DIGIT.findall(body))
        new = [mark.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for mark in ("./" if len(digits) % 4 == 0 else "")]
    elif kind == "phone":
        national = "".join(_DIGIT.findall(body))[-10:]
        a, b, c = national[:3], national[3:6], national[6:]
        new = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"] if len(national) == 10 else []
    else:
        new = []
    left, right = text[max(0, start - 40) : start], text[end : end + 40]
    return [(left + n + right, Span(kind, len(left), len(left) + len(n))) for n in new]


def features(text: str, span: Span) -> list[float]:
    """Format of the span and the text around it."""
    kind, start, end = span
    body = text[start:end]
    digits = [c for c in body if "0" <= c <= "9"]
    groups = re.split(r"[^0-9]+", body)
    around = text[max(0, start - 30) : start] + " " + text[end : end + 15]
    before, after = text[start - 1 : start], text[end : end + 1]
    tail = body.rsplit(".", 1)[-1]
    return [
        *[float(kind == k) for k in KINDS],
        end - start,
        len(digits),
        sum(c.isalpha() for c in body),
        sum(c in " -./()" for c in body),
        body.count("."),
        body.count("@"),
        body.count(" "),
        float(body[:1] == "+"),
        float("(" in body),
        len(groups),
        max(map(len, groups)),
        max((int(g) for g in groups if 0 < len(g) < 10), default=0),
        float(luhn("".join(digits))) if digits else 0.0,
        float(tail.isalpha()) * len(tail),
        len(set(digits)),
        float(before.isalnum()),
        float(after.isalnum()),
        *[float(bool(c.search(around))) for c in _CUES],
        len(_DOT.findall(body)),
        float(bool(_AT.search(body))),
        float(bool(_TAIL.search(body))),
        body.count(". "),
        float(bool(_GROUPED.fullmatch(body))),
        float(bool(_DATE.search(body))),
        *[float(bool(c.search(text[max(0, start - 30) : start]))) for c in (_NUMBERED, _MAIL, _HOST, _CALL)],
    ]


# ------------------------------------------------------------------------------ trees
class Boosted:
    """Gradient-boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 24, weight: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.weight = rounds, depth, rate, bins, weight
        self.trees: list[list[tuple]] = []
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            nodes: list[tuple] = []
            self._grow(nodes, x, cuts, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(nodes)
            raw += self._tree(nodes, x)
        return self

    def _grow(self, nodes, x, cuts, g, h, rows, depth) -> int:
        """Add a node for ``rows``: (feature, cut, left, right) or (-1, value, 0, 0); returns its place."""
        at = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        nodes.append((-1, -self.rate * total_g / (total_h + self.weight), 0, 0))
        best, found = 1e-6, None
        for f, cut in enumerate(cuts if depth else []):
            if not len(cut):
                continue
            place = np.searchsorted(cut, x[rows, f], side="left")
            left_g = np.bincount(place, g[rows], len(cut) + 1).cumsum()[:-1]
            left_h = np.bincount(place, h[rows], len(cut) + 1).cumsum()[:-1]
            gain = (
                left_g**2 / (left_h + self.weight)
                + (total_g - left_g) ** 2 / (total_h - left_h + self.weight)
                - total_g**2 / (total_h + self.weight)
            )
            if gain.max() > best:
                best, found = gain.max(), (f, float(cut[gain.argmax()]))
        if found:
            f, cut = found
            goes = x[rows, f] <= cut
            left = self._grow(nodes, x, cuts, g, h, rows[goes], depth - 1)
            right = self._grow(nodes, x, cuts, g, h, rows[~goes], depth - 1)
            nodes[at] = (f, cut, left, right)
        return at

    @staticmethod
    def _tree(nodes, x) -> np.ndarray:
        at = np.zeros(len(x), int)
        f, value, left, right = (np.array(c) for c in zip(*nodes, strict=True))
        while (inner := f[at] >= 0).any():
            rows, here = np.flatnonzero(inner), at[inner]
            at[rows] = np.where(x[rows, f[here]] <= value[here], left[here], right[here])
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._tree(nodes, x) for nodes in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -40, 40)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> Boosted:
        """Fit scale and shift to held-out labels, then the lowest threshold of the wanted precision."""
        return self.calibrate_counts(self.raw(x), (y > 0).astype(float), (y <= 0).astype(float), precision)

    def calibrate_counts(self, raw: np.ndarray, yes: np.ndarray, no: np.ndarray, precision: float) -> Boosted:
        """The same from raw scores with how many of either label have them."""
        # targets away from 0 and 1, so that separable labels have a finite fit
        high, low, n = (yes.sum() + 1) / (yes.sum() + 2), 1 / (no.sum() + 2), yes + no
        w, design = np.array([1.0, 0.0]), np.stack([raw, np.ones(len(raw))], 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
            hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            step = np.linalg.solve(hessian, design.T @ (n * p - yes * high - no * low) + 1e-3 * (w - [1.0, 0.0]))
            # short steps where the labels are separable and the curve is flat
            w = w - step * min(1.0, 0.5 / (np.abs(step).max() + 1e-12))
        self.scale, self.shift = float(w[0]), float(w[1])
        p = 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -40, 40)))
        order = np.argsort(-p, kind="stable")
        exact = np.cumsum(yes[order]) / np.cumsum(n[order])
        good = np.flatnonzero(exact >= precision)
        self.threshold = max(0.5, float(p[order][good[-1]])) if len(good) else 2.0
        return self


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, precision: float = PRECISION) -> Boosted | None:
    """Model for the added spans, or None without both kinds of labels in both parts.

    At most ``train_docs`` different proposals of each kind and label are fitted.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    shape = pa.schema(
        [("kind", pa.string()), ("label", pa.int32()), ("made", pa.bool_()), ("text", pa.int64()), ("place", pa.int64()), ("x", pa.list_(pa.float64()))]
    )

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [
                    {"kind": c.kind, "label": int(evidence(text, c)), "made": False, "text": where, "place": c.start, "x": features(text, c)}
                    for c in candidates(text)
                ]
                for base in base_spans(text):
                    for i, (other, span) in enumerate(rewritten(text, base)):
                        rows.append({"kind": base.kind, "label": 1, "made": True, "text": where, "place": -1 - i - 8 * base.start, "x": features(other, span)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, shape)

    # proposals are a small part of the text; held out are those of a third of the texts
    told = "kind string, label int, made boolean, text bigint, place bigint, x array<double>"
    every = materialise(
        docs.select(F.xxhash64(text).alias("_where"), text.alias("text"))
        .mapInArrow(labelled, told)
        .withColumn("h", F.xxhash64("text", "place", "kind", "x"))
        .withColumn("held", F.pmod("text", F.lit(3)) == 0)
    )
    sizes = every.filter("not held").groupBy("kind", "label").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not sizes:
        return None
    # about half as many again as wanted pass
    share = {(r.kind, r.label): min(1.0, 1.5 * train_docs / max(1, r.n)) for r in sizes}
    passes = F.lit(False)
    for (kind, label), part in sorted(share.items()):
        bound = F.lit(int((part - 0.5) * 2**64) if part < 1 else 2**63 - 1)
        passes = passes | ((F.col("kind") == kind) & (F.col("label") == label) & (F.col("h") <= bound))
    rows = every.filter(~F.col("held") & passes).dropDuplicates(["h", "kind", "label"]).select("kind", "label", "h", "x").collect()
    rows.sort(key=lambda r: (r["kind"], r["label"], r["h"]))
    taken: dict[tuple[str, int], list] = {}
    for r in rows:
        of = taken.setdefault((r["kind"], r["label"]), [])
        if len(of) < train_docs:
            of.append(r["x"])
    x = np.array([v for of in taken.values() for v in of])
    y = np.array([label for (_, label), of in taken.items() for _ in of], float)
    if len(set(y)) < 2:
        return None
    model = Boosted().fit(x, y)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = model.raw(np.array(batch.column(1).to_pylist()))
            # the lower edge of a bin stands for its scores
            bins = np.floor(np.clip(raw, -30, 30) * BINS).astype(int)
            for key in zip(bins.tolist(), batch.column(0).to_pylist(), strict=True):
                total[key] = total.get(key, 0) + 1
        columns = [[b for b, _ in total], [label for _, label in total], list(total.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bin", "label", "n"])

    # what was made is no measure of precision
    histogram = every.filter("held and not made").select("label", "x").mapInArrow(scored, "bin bigint, label bigint, n bigint")
    counts: dict[int, list[int]] = {}
    for r in histogram.groupBy("bin", "label").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["bin"], [0, 0])[int(r["label"])] += r["n"]
    no, yes = (np.array([counts[b][label] for b in sorted(counts)], float) for label in (0, 1))
    if not yes.sum() or not no.sum():
        return None
    return model.calibrate_counts(np.array(sorted(counts)) / BINS - 1e-9, yes, no, precision)


class Covered:
    """Stretches of a text that are taken: disjoint, in order, searched by halving."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for span in sorted(spans, key=lambda s: s.start):
            if self.ends and span.start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], span.end)
            else:
                self.starts.append(span.start)
                self.ends.append(span.end)

    def meets(self, span: Span) -> bool:
        at = bisect_left(self.starts, span.end)
        return at > 0 and self.ends[at - 1] > span.start

    def add(self, span: Span) -> None:
        """Take a stretch that meets none."""
        at = bisect_left(self.starts, span.start)
        self.starts.insert(at, span.start)
        self.ends.insert(at, span.end)


def select_spans(texts: list[str], model: Boosted | None) -> list[list[Span]]:
    """Base spans of each text, and the candidates the model (without one, the evidence) adds beside them."""
    base = [base_spans(t) for t in texts]
    taken = [Covered(b) for b in base]
    open_spans = [(i, c) for i, t in enumerate(texts) for c in candidates(t) if not taken[i].meets(c)]
    if open_spans:
        if model is None:
            scores, threshold = np.array([float(evidence(texts[i], c)) for i, c in open_spans]), 0.5
        else:
            scores, threshold = model.probability(np.array([features(texts[i], c) for i, c in open_spans])), model.threshold
        for j in sorted(np.flatnonzero(scores >= threshold), key=lambda j: (-scores[j], open_spans[j][1])):
            i, c = open_spans[j]
            if not taken[i].meets(c):
                base[i].append(c)
                taken[i].add(c)
    return base


def find_personal_data(docs: DataFrame, model: Boosted | None) -> DataFrame:
    """(doc_id, base, spans): base spans by kind as listed, then start; all spans likewise."""
    ship_package(docs.sparkSession)
    read = docs.select("doc_id", "text")
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def order(s: Span) -> tuple:
        return KINDS.index(s.kind), s.start

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            every = select_spans(texts, model)
            base = [sorted(base_spans(t), key=order) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[s._asdict() for s in b] for b in base], shape),
                    pa.array([[s._asdict() for s in sorted(e, key=order)] for e in every], shape),
                ],
                names=["doc_id", "base", "spans"],
            )

    return read.mapInArrow(batches, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, base {span}, spans {span}")


def redact(docs: DataFrame, model: Boosted | None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; null texts stay null."""
    ship_package(docs.sparkSession)
    columns = docs.columns

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        for batch in rows:
            texts = batch.column(at).to_pylist()
            every = select_spans([t or "" for t in texts], model)
            clean = []
            for text, spans in zip(texts, every, strict=True):
                pieces, free = [], 0
                for s in sorted(spans, key=lambda s: (s.start, -s.end)):
                    if s.end > free:
                        pieces += [text[free : max(free, s.start)], f"[{s.kind}]" if s.start >= free else ""]
                        free = s.end
                clean.append("".join(pieces) + text[free:] if spans else text)
            arrays = list(batch.columns)
            arrays[at] = pa.array(clean, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(batches, docs.schema)


def joined(spans: str):
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
