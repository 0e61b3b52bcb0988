"""Personal data by weak supervision.

Four base kinds are found by their patterns and checks. Further candidates (secrets, national phone
numbers, social security numbers, IBANs, names after a title) come from broad patterns, and labelers
vote on each: a strict regex or checksum, a gazetteer of cue words before the span, the characters
around it, the span's own make-up, and how crowded the document is. Nobody labels a span by hand:
expectation-maximisation over all candidates' votes estimates each labeler's reliability for each
kind and with it every candidate's probability; those probabilities train a logistic classifier over
votes and span features, which decides. It is held near the majority of votes where the corpus says
little, so it judges combinations of votes and features that the fit never saw, and kinds too.

Texts are searched once: base spans and candidates are few beside the text, and fit and decision go
over them alone. Both fits need only how often each combination of kind, votes and features occurs.
These counts are taken over every document, and there are finitely many combinations whatever the
corpus (kinds times 3 ** labelers times features), so the driver's share is bounded. No text is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "name", "national_phone", "secret", "ssn")
ROUNDS = 60
THRESHOLD = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Digits before a dot only match as a whole run, so runs are possessive and matches start at their heads.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping: found from each @ outwards, as no other character can start a search in vain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            out.append((start, domain.end()))
            free = domain.end()
        else:
            # What precedes this @ can't match with a later one.
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(x.isdigit() for x in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


#: Broad patterns of candidates. Each starts at a boundary and holds one bounded or possessive run.
_CANDIDATES = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
    "name": re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?"),
    "national_phone": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}(?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
#: Cue words looked for in the forty characters before a span.
GAZETTEER = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "name": ("name", "contact", "dear", "patient", "customer", "signed"),
    "national_phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "secret": ("token", "key", "secret", "password", "passwd", "bearer", "credential", "api"),
    "ssn": ("ssn", "social", "security"),
}
LABELERS = ("strict", "cue", "around", "makeup", "crowd")
_BEFORE = 40


def _strict(kind: str, s: str) -> int:
    if kind == "iban":
        return 1 if int("".join(str(int(x, 36)) for x in s[4:] + s[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    if kind == "secret":
        return 1 if re.fullmatch(r"[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|pk|gh[pousr]|xox[bp])[-_][A-Za-z0-9_-]{16,}", s) else 0
    if kind == "national_phone":
        return 1 if re.fullmatch(r"\([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}|[2-9][0-9]{2}-[2-9][0-9]{2}-[0-9]{4}", s) else 0
    return 1 if s.count(" ") == 2 else 0


def _around(before: str, after: str) -> int:
    if before[-1:] in ("/", "\\", "#", "%", "&") or after[:1] in ("/", "\\"):
        return -1
    return 1 if re.search(r"[=:]\s*[\"'(<]?$", before) else 0


def _makeup(kind: str, s: str) -> int:
    body = [x for x in s if x.isalnum()]
    if len(set(body)) <= 2:
        return -1
    if kind != "secret":
        return 0
    digits, letters = sum(x.isdigit() for x in body), sum(x.isalpha() for x in body)
    return 1 if min(digits, letters) >= 5 and len(set(body)) >= 10 else -1


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    pattern: str  # kind|votes|features, what the fits see of it


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[Span]:
    """Candidates that touch no base span nor one another, the leftmost first, of equal starts the longest."""
    raw = sorted(
        ((m.start(), -m.end(), kind) for kind, p in _CANDIDATES.items() for m in p.finditer(text)),
        key=lambda x: x,
    )
    if not raw:
        return []
    crowd = -1 if len(raw) > 50 else 0
    busy = sorted((a, b) for _, a, b in taken)
    out, free, k = [], 0, 0
    for start, minus_end, kind in raw:
        end = -minus_end
        while k < len(busy) and busy[k][1] <= start:
            k += 1
        if start < free or any(a < end for a, _ in busy[k : k + 1]):
            continue
        free = end
        s, before, after = text[start:end], text[max(0, start - _BEFORE) : start], text[end : end + 8]
        low = before.lower()
        votes = (
            _strict(kind, s),
            1 if any(x in low for x in GAZETTEER[kind]) else 0,
            _around(before, after),
            _makeup(kind, s),
            crowd,
        )
        length, digits = min(len(s) // 12, 3), min(4 * sum(x.isdigit() for x in s) // len(s), 3)
        quoted = int(before[-1:] in ("'", '"'))
        out.append(Span(kind, start, end, f"{kind}|{''.join('-0+'[v + 1] for v in votes)}|{length}{digits}{quoted}"))
    return out


@dataclass
class Model:
    reliability: dict[str, np.ndarray]  # by kind: (class, labeler, vote) probabilities
    prior: dict[str, float]
    weights: dict[str, float]  # of the classifier, by feature

    def probability(self, pattern: str) -> float:
        """The classifier's, of any combination of votes and features."""
        score = sum(self.weights.get(f, _majority(f)) for f in _features(pattern))
        return float(1 / (1 + np.exp(-np.clip(score, -30, 30))))


def votes_of(pattern: str) -> np.ndarray:
    return np.array(["-0+".index(v) for v in pattern.split("|")[1]])


def label_model(counts: dict[str, int], rounds: int = ROUNDS) -> tuple[dict[str, np.ndarray], dict[str, float], dict[str, float]]:
    """EM for two classes and labelers independent given the class: reliabilities, priors, each pattern's posterior."""
    reliability, prior, posterior = {}, {}, {}
    for kind in ADDED:
        patterns = sorted(p for p in counts if p.startswith(f"{kind}|"))
        if not patterns:
            continue
        n = np.array([counts[p] for p in patterns], float)
        votes = np.stack([votes_of(p) for p in patterns])
        # From the majority: a sum of votes over 0 speaks for personal data.
        q = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1) + 0.75))
        onehot = (votes[:, :, None] == np.arange(3)).astype(float)
        # Smoothing keeps the classes' meaning: a vote for is likelier under 1, one against under 0.
        pseudo = np.array([[[3.0, 4.0, 1.0]], [[1.0, 4.0, 3.0]]])
        for _ in range(rounds):
            mass = np.stack([n * (1 - q), n * q])
            table = np.einsum("cp,plv->clv", mass, onehot) + pseudo
            table /= table.sum(axis=2, keepdims=True)
            share = (mass.sum(axis=1) + 1) / (n.sum() + 2)
            score = np.log(share)[:, None] + np.einsum("plv,clv->cp", onehot, np.log(table))
            q = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        reliability[kind], prior[kind] = table, float(share[1])
        posterior |= dict(zip(patterns, q.tolist(), strict=True))
    return reliability, prior, posterior


def _features(pattern: str) -> list[str]:
    kind, votes, rest = pattern.split("|")
    return ["", kind] + [f"{kind}:{i}{v}" for i, v in enumerate(votes) if v != "0"] + [f"length{rest[0]}", f"digits{rest[1]}", f"quoted{rest[2]}"]


def _majority(feature: str) -> float:
    """The weight that a feature has where nothing is known: a sum of votes over 0 speaks for personal data."""
    if ":" in feature:
        return 1.5 if feature.endswith("+") else -1.5
    return 0.0 if feature else -0.75


def classifier(counts: dict[str, int], posterior: dict[str, float], steps: int = 300) -> dict[str, float]:
    """Logistic regression over votes and features with the posteriors as labels; the weight of each feature.

    The ridge penalty draws each weight to that of the majority vote, not to 0.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    names = sorted({f for p in patterns for f in _features(p)})
    x = np.zeros((len(patterns), len(names)))
    for i, p in enumerate(patterns):
        x[i, [names.index(f) for f in _features(p)]] = 1
    n, q = np.array([counts[p] for p in patterns], float), np.array([posterior[p] for p in patterns])
    n /= n.sum()
    start = np.array([_majority(f) for f in names])
    w = start.copy()
    for _ in range(steps):  # Newton steps, damped
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - q)) + 1e-4 * (w - start)
        hessian = (x.T * (n * p * (1 - p))) @ x + 1e-4 * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w -= move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-8:
            break
    return dict(zip(names, w.tolist(), strict=True))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_CANDIDATE = pa.struct([*_SPAN, ("pattern", pa.string())])
_SPANS = "array<struct<kind: string, start: long, end: long>>"


def search(docs: DataFrame) -> DataFrame:
    """doc_id, base and candidates (spans with their pattern) of every row, from one pass over the texts."""
    c.short_batches(docs.sparkSession)
    rows = c.pick(docs, "doc_id", "text")

    def run(batches):
        for batch in batches:
            own, more = [], []
            for text in batch.column("text").to_pylist():
                fixed = base(text or "")
                more.append([vars(s) for s in candidates(text or "", fixed)])
                own.append([{"kind": k, "start": a, "end": b} for k, a, b in fixed])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(own, pa.list_(_SPAN)), pa.array(more, pa.list_(_CANDIDATE))], names=["doc_id", "base", "candidates"]
            )

    more = "array<struct<kind: string, start: long, end: long, pattern: string>>"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {_SPANS}, candidates {more}")


def fit_found(found: DataFrame) -> Model:
    """From what `search` found in all documents: counts of patterns, the label model, the classifier."""
    patterns = found.select(F.explode("candidates.pattern").alias("pattern"))
    counts = {r.pattern: r.n for r in patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    reliability, prior, posterior = label_model(counts)
    return Model(reliability, prior, classifier(counts, posterior))


def decide(found: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and added of every row that `search` gave: see `find`."""
    place = {k: i for i, k in enumerate(KINDS + ADDED)}

    def run(batches):
        known: dict[str, bool] = {}

        def accepted(pattern: str) -> bool:
            if pattern not in known:
                known[pattern] = model.probability(pattern) >= threshold
            return known[pattern]

        def placed(spans: list[dict]) -> list[dict]:
            return sorted(spans, key=lambda s: (place[s["kind"]], s["start"]))

        for batch in batches:
            own = [placed(spans) for spans in batch.column("base").to_pylist()]
            more = [
                placed([{k: s[k] for k in ("kind", "start", "end")} for s in spans if accepted(s["pattern"])]) for spans in batch.column("candidates").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.list_(_SPAN)), pa.array(more, pa.list_(_SPAN))], names=["doc_id", "base", "added"])

    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, base {_SPANS}, added {_SPANS}")


def fit(docs: DataFrame) -> Model:
    """The model of all documents of a table."""
    return fit_found(search(docs))


def find(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and added: spans (kind, start, end in code points, end exclusive) by kind, then start.

    base holds the four fixed kinds, added what the classifier accepts besides; the model may come from
    another table. Null and empty texts have none. Rows that repeat have equal spans; an empty table gives
    an empty result; texts are searched whole, and other columns ignored.
    """
    return decide(search(docs), model, threshold)


def find_own(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`find` with the model of the same table, its texts searched once; what is found is kept in the shared folder."""
    found = c.written(search(docs), "pii")
    return decide(found, fit_found(found), threshold)
