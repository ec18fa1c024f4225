"""Personal data by exact patterns and a skip-chain conditional random field.

The patterns give the base spans (email, ip, card, phone); they always stay. The field looks at what the patterns
leave: units of digits or with an ``@``. A document's units form a chain in text order; besides, units that are
repeated or similar (same last digits, same local part) share a potential however far apart they are. Loopy message
passing over chain and skip edges makes labels of such units agree, so a phone number without its country code,
or a card number written with dots, is found where the document also holds the full form.

All potentials are counted on the whole corpus: unit features (shape, length, neighbouring words; hashed into a table
of fixed size) against labels, labels of neighbouring units, and how often labels of similar units agree. A unit that
is similar to a base span is left out of the counts, as its label is what is asked. Only units with a skip edge can get a
label, and only above ``CERTAIN``; a text without repetition keeps exactly its base spans.

Defined results: null text counts as empty and has no spans; spans of several kinds may overlap; a unit that overlaps a
base span is never added; equal rows get equal results; an empty table gives no rows. All scans are linear in the
text, so very long texts need no cut.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Slots of the feature table; longest digit run that a unit key keeps.
TABLE, SUFFIX = 1 << 13, 7
ROUNDS, DAMPING, CERTAIN, STRONGEST = 20, 0.5, 0.8, 6.0
#: Similar units counted as disagreeing and as agreeing before any are seen.
ALIKE = (1.0, 400.0)

# Patterns of the contract (fixed values), written so that no scan is repeated from inside a run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_UNIT = re.compile(r"(?P<at>[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,64}(?:\.[A-Za-z0-9-]{1,64})*)|\(?[0-9][0-9\x20().:-]{5,40}[0-9](?![0-9A-Za-z])")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            end = found.end()
        at = text.find("@", max(end, at + 1))


def _ips(text: str) -> Iterator[Span]:
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            length = sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in four)):
                yield "ip", at, at + length
            at += length + 1


def _cards(text: str) -> Iterator[Span]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub(r"[^0-9]", "", m.group())
            if 13 <= len(digits) <= 19 and _luhn(digits):
                yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind as listed and start."""
    return [*_emails(text), *_ips(text), *_cards(text), *_phones(text)]


def _key(text: str) -> str:
    """What similar units share."""
    if "@" in text:
        return text.split("@")[0].lower() + "@"
    return re.sub(r"[^0-9]", "", text)[-SUFFIX:]


def _features(text: str, start: int, end: int) -> list[int]:
    """Slots of a unit's features in the table."""
    unit = text[start:end]
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]", "9", unit)))[:24]
    before, after = text[max(0, start - 32) : start].split(), text[end : end + 32].split()
    names = (
        f"s:{shape}", f"d:{sum(c.isdigit() for c in unit)}", f"b:{before[-1].lower() if before else ''}",
        f"a:{after[0].lower() if after else ''}",
    )
    return [zlib.crc32(n.encode("utf-8", "replace")) % TABLE for n in names]


def units(text: str, base: list[Span]) -> list[tuple[int, int, int, str]]:
    """Label number (0: left by the patterns), start, end and key of every unit, in text order."""
    found = [(LABELS.index(kind), a, b, _key(text[a:b])) for kind, a, b in base]
    covered = sorted((a, b) for _, a, b in base)
    i, reach = 0, -1
    for m in _UNIT.finditer(text):
        a, b = m.span()
        while i < len(covered) and covered[i][0] < b:
            reach = max(reach, covered[i][1])
            i += 1
        key = _key(m.group())
        if reach <= a and (m["at"] or len(key) == SUFFIX):
            found.append((0, a, b, key))
    return sorted(found, key=lambda u: (u[1], u[2], u[0]))


def count_potentials(text: str, into: Counter) -> None:
    """Adds what one text says about features, neighbours and similar units."""
    base = base_spans(text)
    found = units(text, base)
    known = {u[3] for u in found if u[0]}
    last: dict[str, int] = {}
    previous = None
    for label, a, b, key in found:
        if label == 0 and key in known:  # its label is the question
            previous = None
            continue
        for slot in _features(text, a, b):
            into[0, slot, label] += 1
        into[1, 0, label] += 1
        if previous is not None:
            into[2, previous, label] += 1
        if label and key in last:
            into[3, 0, int(last[key] == label)] += 1
        if label:
            last[key] = label
        previous = label


class Potentials:
    """Log potentials of features, neighbours and similar units, from summed counts (kind, slot, label, n)."""

    def __init__(self, counts: list[tuple[int, int, int, int]]):
        n = len(LABELS)
        table, prior, follow, alike = np.zeros((TABLE, n)), np.ones(n), np.ones((n, n)), np.array(ALIKE)
        for kind, slot, label, count in counts:
            (table[slot] if kind == 0 else prior if kind == 1 else follow[slot] if kind == 2 else alike)[label] += count
        self.prior = np.log(prior / prior.sum())
        share = (table + 0.5 * prior / prior.sum()) / (table.sum(axis=1, keepdims=True) + 0.5)
        # how far a feature moves the labels away from their prior
        self.table = np.clip(np.log(share + 1e-6) - self.prior, -STRONGEST, STRONGEST).astype(np.float32)
        rows = follow / follow.sum(axis=1, keepdims=True)
        self.follow = np.clip(np.log(rows) - np.log(rows.mean(axis=0)), -1.0, 1.0)
        agree = float(np.clip(np.log(alike[1] / alike[0]), 0.0, STRONGEST))
        self.similar = np.where(np.eye(n, dtype=bool), agree, 0.0)


def marginals(node: np.ndarray, edges: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Label probabilities by loopy message passing; ``edges`` are (unit, unit, log potential)."""
    n, k = node.shape
    one = [(i, j, p) for i, j, p in edges] + [(j, i, p.T) for i, j, p in edges]
    back = [e + len(edges) if e < len(edges) else e - len(edges) for e in range(len(one))]
    source, target = np.array([e[0] for e in one]), np.array([e[1] for e in one])
    potential = np.stack([e[2] for e in one])
    messages = np.zeros((len(one), k))
    for _ in range(ROUNDS):
        belief = node.copy()
        np.add.at(belief, target, messages)
        into = (belief[source] - messages[back])[:, :, None] + potential
        top = into.max(axis=1)
        new = top + np.log(np.exp(into - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        moved = float(np.abs(new - messages).max())
        messages = DAMPING * messages + (1 - DAMPING) * new
        if moved < 1e-4:
            break
    belief = node.copy()
    np.add.at(belief, target, messages)
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], model: Potentials) -> list[Span]:
    """Spans that the field adds to the base."""
    if not base:
        return []  # no unit has a label that a similar one could take over
    found = units(text, base)
    known = {u[3] for u in found if u[0]}
    asked = [i for i, u in enumerate(found) if u[0] == 0 and u[3] in known]
    if not asked:
        return []
    node = np.empty((len(found), len(LABELS)))
    for i, (label, a, b, _) in enumerate(found):
        if label:  # base labels are given
            node[i] = -50.0
            node[i, label] = 0.0
        else:
            node[i] = model.prior + model.table[_features(text, a, b)].mean(axis=0)
    edges = [(i, i + 1, model.follow) for i in range(len(found) - 1)]
    # similar units hang together in text order, and each on the base span they are similar to
    last: dict[str, int] = {}
    given = {u[3]: i for i, u in enumerate(found) if u[0]}
    for i, u in enumerate(found):
        key = u[3]
        if key in last:
            edges.append((last[key], i, model.similar))
        if u[0] == 0 and key in given and given[key] != last.get(key):
            edges.append((given[key], i, model.similar))
        last[key] = i
    chance = marginals(node, edges)
    return [(LABELS[int(chance[i].argmax())], found[i][1], found[i][2]) for i in asked if chance[i, 1:].max() >= CERTAIN]


def fit(docs: DataFrame, text: str = "text") -> Potentials:
    """Potentials counted on all of ``docs``; what reaches the driver has a fixed size (TABLE * labels)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                count_potentials(value.as_py() or "", seen)
        rows = [(*k, n) for k, n in seen.items()]
        columns = [pa.array([r[i] for r in rows], type=pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "slot", "label", "n"])

    counts = docs.select(F.col(text)).mapInArrow(count, "kind long, slot long, label long, n long")
    summed = counts.groupBy("kind", "slot", "label").agg(F.sum("n").alias("n")).collect()
    return Potentials([tuple(r) for r in summed])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


RESULT = "struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, base_sha256: string, spans: string, redacted: string>"


def finder(model: Potentials, text: Column, with_text: bool = True) -> Column:
    """Struct of the base counts, the digest of the base, all spans and (``with_text``) the redacted text."""

    @F.arrow_udf(RESULT)
    def find(texts: pa.Array) -> pa.Array:
        counts = np.zeros((len(texts), len(KINDS)), dtype=np.int64)
        digests, joined, redacted = [], [], []
        for i, value in enumerate(texts):
            whole = value.as_py()
            base = base_spans(whole or "")
            spans = base + added_spans(whole or "", base, model)
            for kind, _, _ in base:
                counts[i, KINDS.index(kind)] += 1
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            joined.append(_joined(spans))
            redacted.append((redact(whole, spans) if spans else whole) if with_text else None)
        columns = [pa.array(counts[:, k]) for k in range(len(KINDS))]
        columns += [pa.array(x, type=pa.string()) for x in (digests, joined, redacted)]
        return pa.StructArray.from_arrays(columns, names=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"])

    return find(text)
