"""Personal data: generated candidates, scored by boosted trees, selected by calibrated thresholds.

1. Generators. Base patterns (email, ip, card, phone) give the base spans, checked by format. High-recall generators add
   overlapping candidates of the same kinds: written-out or broken emails, addresses with odd separators, digit groups
   without a plus or with other separators.
2. Examples. Base spans are true. All of them, rewritten in their context as a generator would meet them (the at sign written
   out, the plus dropped, other separators), teaches the trees the looser formats. False are the same places with something
   that only looks alike (a part above 255, a failed checksum, too few digits, ordinary words), and the corpus's own candidates
   without a cue nearby or with a count of digits out of range.
   A text teaches once, however often it stands there. About MAX_EXAMPLES per kind and class are fitted, those with the smallest
   hash of document, place and form.
3. Boosted trees over format and context features score candidates. All examples of other documents (a third, by hash) are scored
   and counted by kind, class and bin of the score, in the corpus's own mix. The lowest bin from which on the exact binomial bound
   on false selections stays under MAX_FALSE becomes the threshold of the kind; a kind without such a bin adds nothing.
4. Spans are the base spans and every candidate at or above its threshold that overlaps none of them; of overlapping
   candidates the best score stays, then the longer, then the leftmost.

Defined cases: a null or empty text has no spans. Repeated rows and null ids are handled row by row. Without examples of both
classes there are no added spans. Offsets count code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.tables import store

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # Looking behind changes no match (a match ends where its digits end) and keeps long runs of digits linear.
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A sign between name and host, plain or written out, and a host with plain or written dots.
_AT = re.compile(r"\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|\x20?@\x20?", re.IGNORECASE)
_WIDE_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]+)+", re.IGNORECASE)
#: Every match of a pattern of digits lies in one of these areas.
AREA = re.compile(r"[+0-9(][\x20()+.,/_\[\]0-9-]*")
#: Looser patterns; each match is a candidate only.
WIDE = {
    "ip": re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20|,|\.)[0-9]{1,3}){3}(?![0-9A-Za-z.])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[\x20._/-]{1,2}[0-9]{2,7}){2,4}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])(?:00|\()?[0-9]{2,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,4}(?![0-9A-Za-z])"),
}
CUES = {
    "email": re.compile(r"e-?mail|mail|contact|write|reach|kontakt|correo|courriel|@", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|server|host|address|addr|login|adresse", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|pay|karte|tarjeta|carte", re.IGNORECASE),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|\bph\b|telefon|llam|appel", re.IGNORECASE),
}
FEATURES = (
    "kind", "length", "n_digits", "n_letters", "n_groups", "n_separators", "longest_group", "largest_group_value",
    "checksum", "in_range", "cue_before", "cue_after", "space_before", "space_after", "digits_near", "capitals_near",
)
CONTEXT = 40
MAX_EXAMPLES = 4000
TREES = 12
DEPTH = 4
MAX_FALSE = 0.02
CONFIDENCE = 0.95
#: Every FOLDS-th text is held out. Scores are counted in BINS, a power of two, so that the edges are exact.
FOLDS = 3
BINS = 1 << 16
SEED = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, found: str) -> bool:
    """The check of a base match; ``found`` matches BASE[kind]."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in found.split(".")))
    digits = _digits(found)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def _names_before(text: str, stop: int, floor: int) -> int:
    """Where the run of name characters that ends at ``stop`` begins, not before ``floor``."""
    at = stop
    while at > floor and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of BASE["email"], found from the at signs, so in linear time."""
    last, sign = 0, text.find("@")
    while sign >= 0:
        start = _names_before(text, sign, last)
        host = _HOST.match(text, sign + 1) if start < sign else None
        if host:
            yield start, host.end()
            last = host.end()
        last = max(last, sign + 1)  # an at sign is no part of a name
        sign = text.find("@", last)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Valid base matches by kind; a kind's matches are leftmost and do not overlap."""
    found = [("email", start, end) for start, end in _emails(text)]
    areas = [(m.start(), m.end()) for m in AREA.finditer(text)]
    for kind in KINDS[1:]:
        for a, b in areas:
            found += [(kind, m.start(), m.end()) for m in BASE[kind].finditer(text, a, b) if valid(kind, m[0])]
    return found


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    for sign in _AT.finditer(text):
        # Names and hosts go whole, however long: those of different signs share no character, so the walk is linear.
        start = _names_before(text, sign.start(), 0)
        host = _WIDE_HOST.match(text, sign.end()) if start < sign.start() else None
        if host:
            yield "email", start, host.end()
    for area in AREA.finditer(text):
        for kind, pattern in WIDE.items():
            # One character more, so that what follows the area is seen.
            for m in pattern.finditer(text, area.start(), min(len(text), area.end() + 1)):
                yield kind, m.start(), m.end()


def outside(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """A test whether a range overlaps none of ``spans``: of those that start before its end, the furthest end counts."""
    ordered = sorted((start, end) for _, start, end in spans)
    starts = [start for start, _ in ordered]
    reach = list(accumulate((end for _, end in ordered), max))

    def is_free(start: int, end: int) -> bool:
        at = bisect_left(starts, end)
        return at == 0 or reach[at - 1] <= start

    return is_free


def describe(kind: str, text: str, start: int, end: int) -> list[float]:
    """FEATURES of the span in its context."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits, groups = _digits(span), re.findall("[0-9]+", span)
    n_letters = sum(c.isalpha() for c in span)
    value = max((int(g[:18]) for g in groups), default=0)
    in_range = {
        "email": bool(re.search("[A-Za-z]{2,}$", span)),
        "ip": len(groups) == 4 and value <= 255,
        "card": 12 <= len(digits) <= 19,
        "phone": 9 <= len(digits) <= 15,
    }[kind]
    return [
        float(KINDS.index(kind)), float(end - start), float(len(digits)), float(n_letters), float(len(groups)),
        float(end - start - len(digits) - n_letters), float(max(map(len, groups), default=0)), float(min(value, 10**9)),
        float(bool(digits) and luhn(digits)), float(in_range),
        float(bool(CUES[kind].search(before))), float(bool(CUES[kind].search(after))),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after),
        float(len(_digits(before[-8:] + after[:8]))), float(sum(c.isupper() for c in before[-20:])),
    ]


def rewritten(kind: str, span: str, form: int) -> str:
    """A true span in a looser form."""
    if kind == "email":
        name, _, host = span.partition("@")
        return [f"{name} at {host}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name}(at){host}", f"{name} at {host.replace('.', ' dot ')}"][form % 4]
    if kind == "ip":
        return span.replace(".", ["[.]", ",", "(.)", " . "][form % 4])
    digits = _digits(span)
    if kind == "card":
        mark = [".", "_", "/", ". "][form % 4]
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    cut = digits if form % 2 else "00" + digits
    mark = [" ", "-", "/", "."][form // 2 % 4]
    return mark.join([cut[: len(cut) - 7], cut[-7:-4], cut[-4:]])


def spoiled(kind: str, span: str, form: int, words: list[str]) -> str:
    """Something of the same look that is no personal data: ``words`` are ordinary words of the text."""
    if kind == "email":
        a, b, c = (words * 3)[:3]
        return [f"{a} at {b}.{c}", f"{a} (at) {b}.{c}", f"{a} @ {b}.{c}", f"{a} at {b} dot {c}"][form % 4]
    if kind == "ip":
        parts = span.split(".")
        parts[form % 4] = str(256 + form % 700)
        return ["[.]", ",", ".", " . "][form // 4 % 4].join(parts)
    digits = _digits(span)
    if kind == "card":
        digits = digits[:-1] + str((int(digits[-1]) + 1 + form % 9) % 10)
        return [".", "_", "/", " "][form // 9 % 4].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    cut = digits[: 4 + form % 5]
    return [" ", "-", "/", "."][form // 5 % 4].join([cut[:2], cut[2:]])


def examples(text: str, seed: str) -> Iterator[tuple[str, int, list[float], int]]:
    """(kind, label, features, order): what a text teaches; a pseudo-random ``order`` from ``seed`` and place."""
    base = base_spans(text)
    is_free = outside(base)
    for kind, start, end in base:
        order = xxhash.xxh32_intdigest(f"{seed}:{start}:{kind}")
        yield kind, 1, describe(kind, text, start, end), order
        words = re.findall("[A-Za-z]+", text[max(0, start - 400) : start + 400])
        words = words[order % len(words) :] + words if words else ["on"]
        for label, new in ((1, rewritten(kind, text[start:end], order)), (0, spoiled(kind, text[start:end], order, words))):
            near = text[max(0, start - CONTEXT) : start] + new + text[end : end + CONTEXT]
            at = min(start, CONTEXT)
            for other, a, b in candidates(near):
                if other == kind and a < at + len(new) and at < b:
                    whole = a <= at and b >= at + len(new)
                    if whole or not label:
                        yield kind, label, describe(kind, near, a, b), order ^ (2 - label)
    for kind, start, end in candidates(text):
        if not is_free(start, end):
            continue
        features = describe(kind, text, start, end)
        cue = features[FEATURES.index("cue_before")] or features[FEATURES.index("cue_after")]
        if not cue or not features[FEATURES.index("in_range")]:
            yield kind, 0, features, xxhash.xxh32_intdigest(f"{seed}:{start}:{kind}")


@dataclass
class Trees:
    """Boosted regression trees as arrays: a leaf has feature -1."""

    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    right: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for f, t, lo, hi, v, w in zip(self.feature, self.threshold, self.left, self.right, self.value, self.weights):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                inner = f[at] >= 0
                go_left = rows[np.arange(len(rows)), np.maximum(f[at], 0)] <= t[at]
                at = np.where(inner, np.where(go_left, lo[at], hi[at]), at)
            total += w * v[at]
        return 1 / (1 + np.exp(-2 * total))


def _arrays(model) -> Trees:
    out = Trees(weights=[float(w) for w in model.treeWeights])
    for tree in model.trees:
        rows: list[list[float]] = []

        def walk(node) -> int:
            at = len(rows)
            rows.append([-1, 0.0, at, at, node.prediction()])
            if node.subtreeDepth():
                split = node.split()
                left, right = walk(node.leftChild()), walk(node.rightChild())
                rows[at][:4] = [split.featureIndex(), split.threshold(), left, right]
            return at

        walk(tree._call_java("rootNode"))
        f, t, lo, hi, v = (np.array(c) for c in zip(*rows))
        for name, column in zip(("feature", "left", "right"), (f, lo, hi)):
            getattr(out, name).append(column.astype(np.int64))
        out.threshold.append(t.astype(float))
        out.value.append(v.astype(float))
    return out


def is_bounded(false: int, n: int, most: float, confidence: float = CONFIDENCE) -> bool:
    """Whether the exact upper bound on a rate, ``false`` in ``n`` seen, is at most ``most``."""
    if n == 0 or false > n * most:
        return False
    # Below the mean the terms fall towards 0; the sum ends where they no longer count.
    term = exp(lgamma(n + 1) - lgamma(false + 1) - lgamma(n - false + 1) + false * log(most) + (n - false) * log1p(-most))
    total, i = term, false
    while i > 0 and term > 1e-16 * total:
        term *= i * (1 - most) / ((n - i + 1) * most)
        total += term
        i -= 1
    return total <= 1 - confidence


def calibrate(scores: np.ndarray, labels: np.ndarray, max_false: float = MAX_FALSE) -> float:
    """The lowest score from which on the share of false ones is bounded by ``max_false``; infinity if there is none."""
    order = np.argsort(-scores, kind="stable")
    false = np.cumsum(labels[order] == 0)
    best = float("inf")
    for i in range(len(order)):
        last_of_ties = i + 1 == len(order) or scores[order[i]] != scores[order[i + 1]]
        if last_of_ties and false[i] <= max_false * (i + 1) and is_bounded(int(false[i]), i + 1, max_false):
            best = float(scores[order[i]])
    return best


def calibrate_counts(counts: dict[int, tuple[int, int]], max_false: float = MAX_FALSE) -> float:
    """``calibrate`` on counts: (false, true) examples by bin of the score; the lower edge of a bin, or infinity."""
    bins = sorted(counts, reverse=True)
    false = np.cumsum([counts[b][0] for b in bins])
    n = np.cumsum([sum(counts[b]) for b in bins])
    for b, f, m in reversed(list(zip(bins, false.tolist(), n.tolist()))):
        if f <= max_false * m and is_bounded(f, m, max_false):
            return b / BINS
    return float("inf")


def _fold(seed: str) -> int:
    return int(seed[:8], 16) % FOLDS


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"))


def training_table(docs: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """kind, label and features of a sample of the texts that are not held out; the same for any dealing of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("text", pa.binary()), ("kind", pa.string()), ("label", pa.int32()), ("n", pa.int64()), ("order", pa.int64()), ("place", pa.int32()), ("features", pa.list_(pa.float64()))])
        # All are counted; of each kind and class the task's smallest orders are kept, twice as many as the cut below leaves of all.
        best: dict[tuple[str, int], dict] = {}
        for batch in batches:
            counts = []
            for text in dict.fromkeys(batch["text"].to_pylist()):
                seed = xxhash.xxh3_64_hexdigest(text)
                if _fold(seed) == 0:
                    continue
                key, seen = xxhash.xxh3_128_digest(text), {}
                for place, (kind, label, features, order) in enumerate(examples(text, seed)):
                    seen[kind, label] = seen.get((kind, label), 0) + 1
                    own = best.setdefault((kind, label), {})
                    own[order, key, place] = features
                    if len(own) >= 4 * max_examples:
                        best[kind, label] = dict(sorted(own.items())[: 2 * max_examples])
                counts += [{"text": key, "kind": k, "label": y, "n": n} for (k, y), n in seen.items()]
            yield pa.RecordBatch.from_pylist(counts, schema)
        for (k, y), own in best.items():
            kept = sorted(own.items())[: 2 * max_examples]
            yield pa.RecordBatch.from_pylist([{"text": t, "kind": k, "label": y, "order": o, "place": p, "features": x} for (o, t, p), x in kept], schema)

    found = _texts(docs).mapInArrow(run, "text binary, kind string, label int, n long, order long, place int, features array<double>")
    found = store(found, "pii-examples")
    # The order is uniform below 2^32, so a cut on it leaves about max_examples of each kind and class.
    sizes = found.where("n is not null").dropDuplicates(["text", "kind", "label"]).groupBy("kind", "label").agg(F.sum("n").alias("total"))
    cut = F.floor(F.lit(1 << 32) * F.least(F.lit(1.0), F.lit(float(max_examples)) / F.col("total")))
    kept = found.where("n is null").join(F.broadcast(sizes), ["kind", "label"]).where(F.col("order") < cut)
    return kept.dropDuplicates(["text", "place"]).select("kind", "label", "features", "order", "text", "place")


def held_out_counts(docs: DataFrame, trees: Trees) -> DataFrame:
    """kind, label, bin and n: all examples of the held-out texts, each different text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for text in dict.fromkeys(batch["text"].to_pylist()):
                seed = xxhash.xxh3_64_hexdigest(text)
                if _fold(seed) == 0:
                    key = xxhash.xxh3_128_digest(text)
                    for kind, label, features, _ in examples(text, seed):
                        keys.append((key, kind, label))
                        rows.append(features)
            counts = Counter()
            if rows:
                bins = np.minimum(trees.score(np.array(rows)) * BINS, BINS - 1).astype(int)
                counts.update((*k, b) for k, b in zip(keys, bins.tolist()))
            yield pa.RecordBatch.from_pylist(
                [{"text": t, "kind": k, "label": y, "bin": b, "n": n} for (t, k, y, b), n in counts.items()],
                pa.schema([("text", pa.binary()), ("kind", pa.string()), ("label", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]),
            )

    found = _texts(docs).mapInArrow(run, "text binary, kind string, label int, bin int, n long")
    return found.dropDuplicates(["text", "kind", "label", "bin"]).groupBy("kind", "label", "bin").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, max_examples: int = MAX_EXAMPLES) -> Trees:
    rows = training_table(docs, max_examples).repartition(1).sortWithinPartitions("order", "text", "place")  # about 8 * max_examples rows
    sample = store(rows, "pii-sample").coalesce(1).cache()
    fit = sample.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("x"))
    if fit.select("label").distinct().count() < 2:
        return Trees()
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.3, seed=SEED).fit(fit)
    trees = _arrays(model)
    sample.unpersist()
    held: dict[str, dict[int, list[int]]] = {}
    for kind, label, b, n in held_out_counts(docs, trees).collect():  # at most 8 * BINS rows
        held.setdefault(kind, {}).setdefault(b, [0, 0])[label] = n
    trees.thresholds = {kind: calibrate_counts(counts) for kind, counts in held.items()}
    return trees


def select(text: str, base: list[tuple[str, int, int]], trees: Trees) -> list[tuple[str, int, int]]:
    """All spans, by start and then kind: ``base``, and the selected candidates outside of it."""
    spans = list(base)
    if trees.weights:
        is_free = outside(base)
        free = list(dict.fromkeys(c for c in candidates(text) if is_free(c[1], c[2])))
        if free:
            scores = trees.score(np.array([describe(k, text, s, e) for k, s, e in free]))
            chosen = [(-p, s - e, s, k, e) for p, (k, s, e) in zip(scores, free) if p >= trees.thresholds.get(k, float("inf"))]
            # What was taken is disjoint and in order, so only the last one that starts before an end can reach into a span.
            starts: list[int] = []
            ends: list[int] = []
            for _, _, start, kind, end in sorted(chosen):
                at = bisect_left(starts, end)
                if at == 0 or ends[at - 1] <= start:
                    starts.insert(at, start)
                    ends.insert(at, end)
                    spans.append((kind, start, end))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans of every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs) if trees is None else trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                base = base_spans(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(select(text, base, model.value))))
            types = (*[pa.int64()] * len(KINDS), pa.string(), pa.string())
            columns = zip(*out) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(list(c), t) for c, t in zip(columns, types)]],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every span replaced by its kind in brackets; overlapping spans are replaced as one, named by the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """``docs`` with all spans redacted in text; a null text stays null. The other columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs) if trees is None else trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = [None if t is None else redact_text(t, select(t, base_spans(t), model.value)) for t in batch["text"].to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
