"""Personal data: candidates of high recall, judged by gradient-boosted trees.

The base spans follow fixed rules.  Beyond them, generators propose overlapping candidates (long tokens, dotted ones,
key blocks, values after a key word, long numbers and digit groups, dates, street addresses, titled names); a candidate's format and context become features, boosted trees score
them, isotonic calibration turns scores into probabilities, and those over the threshold become spans.  The trees
are fitted on generated examples, so no document's content is learned.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chars import decoded
from .frames import by_batch, keys_and_text, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account", "birth", "address", "name")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters before an @, from the last match's end on, then a dotted domain."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return found


def _ips(text: str) -> list[tuple[int, int]]:
    """A chain of dotted numbers is cut into fours from its start; a four with a part over 255 is dropped."""
    found = []
    for m in _CHAIN.finditer(text):
        if (chain := m.group()).count(".") >= 3:
            parts, at = chain.split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    found.append((at, at + size))
                at += size + 1
    return found


def _cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            found.append(m.span())
    return found


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed."""
    out = []
    if "@" in text:
        out += [(a, b, "email") for a, b in _emails(text)]
    out += [(a, b, "ip") for a, b in _ips(text)] + [(a, b, "card") for a, b in _cards(text)]
    if "+" in text:
        out += [(a, b, "phone") for a, b in _phones(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- candidates beyond the base -------------------------------------------------------------------------------

_VALUE = re.compile(r"\s{0,2}[=:]\s{0,2}[\"']?([^\s\"',;]{6,200})")
_REST = re.compile(r"[^\s\"',;]*+")
_OPENING = 200
_NAME = re.compile(r"(?i:password|passwd|secret|token|api[_-]?key|access[_-]?key|credential)s?[\"']?\Z")
_DIGITS = re.compile(r"[0-9]++")
_TOKEN_CHAR = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_/+=-")
_GROUPS = re.compile(r"[0-9]{2,}+(?:[ -]?[0-9]{2,}+)++|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,8}")
_SECRET_WORDS = ("pass", "secret", "token", "key", "credential", "auth")
_ACCOUNT_WORDS = ("ssn", "social", "iban", "account", "passport", "tel", "phone", "fax", "call", "card")
_BIRTH_WORDS = ("born", "birth", "dob")
_NAME_WORDS = ("name", "contact", "patient", "customer", "signed")
_DOTTED = re.compile(r"[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+){2,}+")
_LETTERS = re.compile(r"[A-Za-z_/+=-]{20,}+")
_LONG = re.compile(r"(?<![0-9.])[0-9]{12,19}+(?![0-9.])")
_DATE = re.compile(r"(?<![0-9])[0-9]{1,4}+([-/.])[0-9]{1,2}+\1[0-9]{2,4}+(?![0-9])")
_STREET = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}+(?: [A-Z][a-z]++){1,3} (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Way|Place|Square)(?![a-z])")
_PERSON = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]++(?: [A-Z][a-z]++){0,2}|(?<=[Nn]ame: )[A-Z][a-z]++(?: [A-Z][a-z]++){1,2}")
_BEGIN, _END = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"), re.compile(r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----")
_BLOCK = re.compile(r"[A-Za-z0-9+/=:,\s-]*+")


def values(text: str) -> list[tuple[int, int]]:
    """Whole values after a key word, up to a blank, quote, comma or semicolon; the end of a run is looked for once."""
    out = []
    for sign in "=:":
        at, run_end = text.find(sign), 0
        while at >= 0:
            name = text[max(0, at - 20) : at].rstrip()
            if _NAME.search(name) and (m := _VALUE.match(text, at)):
                start, end = m.span(1)
                if end - start == _OPENING:
                    end = run_end = run_end if start < run_end else _REST.match(text, end).end()
                out.append((start, end))
            at = text.find(sign, at + 1)
    return out


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Private keys from their first line to their last, or as far as key characters go where the last is missing."""
    out, at, ends = [], 0, None
    if "-----BEGIN " not in text:
        return out
    ends = [m.end() for m in _END.finditer(text)]
    for m in _BEGIN.finditer(text):
        if m.start() >= at:
            next_end = bisect_right(ends, m.end())
            at = ends[next_end] if next_end < len(ends) else _BLOCK.match(text, m.end()).end()
            out.append((m.start(), at))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Overlapping proposals of high recall, as this module's head lists them."""
    out = [(*v, "secret") for v in [*values(text), *key_blocks(text)]]
    out += [(*m.span(), "secret") for m in _DOTTED.finditer(text)]
    out += [(*m.span(), "secret") for m in _LETTERS.finditer(text) if not (t := m.group()).islower() and not t.isupper() and sum(map(str.isupper, t)) >= 4]
    out += [(*m.span(), "name") for m in _PERSON.finditer(text)]
    end = 0
    for m in _DIGITS.finditer(text):
        if m.start() >= end:
            start, end = m.span()
            while start and text[start - 1] in _TOKEN_CHAR:
                start -= 1
            while end < len(text) and text[end] in _TOKEN_CHAR:
                end += 1
            if end - start >= 16 and any(map(str.isalpha, text[start:end])):
                out.append((start, end, "secret"))
    if not end:
        return sorted(set(out))
    for m in _GROUPS.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 34 or m.group()[0].isalpha():
            out.append((*m.span(), "account"))
    out += [(*m.span(), "account") for m in _LONG.finditer(text)]
    out += [(*m.span(), "birth") for m in _DATE.finditer(text)] + [(*m.span(), "address") for m in _STREET.finditer(text)]
    return sorted(set(out))


FEATURES = 21


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the candidate and its context; no feature names a document."""
    t = text[start:end]
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 1]
    n = len(t)
    digits, upper, lower = sum(map(str.isdigit, t)), sum(map(str.isupper, t)), sum(map(str.islower, t))
    counts: dict[str, int] = {}
    for c in t:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in t]
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    return [
        float(kind == "account"), n, digits / n, upper / n, lower / n, entropy, changes / n, len(counts) / n,
        float(all(c in "0123456789abcdef" for c in t)), float(any(w in before for w in _SECRET_WORDS)), float(any(w in before for w in _ACCOUNT_WORDS)),
        float(before[-1:] in "=:\"'" and before != ""), float(after in "\"'"), float(n in (20, 32, 40, 64)), float(luhn(_NOT_DIGIT.sub("", t))) if digits else 0.0,
        (n - digits - upper - lower) / n, float(KINDS.index(kind)), float(any(w in before for w in _BIRTH_WORDS)), float(any(w in before for w in _NAME_WORDS)), float(t.count(".") >= 2),
        float(t.startswith("-----BEGIN")),
    ]


def generated_examples(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of invented secrets and account numbers, and of look-alikes that are neither."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, up, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: pick("etaoinshrdlu", rng.randint(2, 9))
    letters, title = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", lambda: pick("ABCDEFGHJKLMNPRSTW", 1) + word()
    street = lambda: f"{rng.randint(1, 9999)} {' '.join(title() for _ in range(rng.randint(1, 2)))} {rng.choice(('Street', 'St', 'Avenue', 'Road', 'Lane', 'Drive', 'Court'))}"
    date = lambda lo, hi: rng.choice(("{d}/{m}/{y}", "{d}.{m}.{y}", "{y}-{m:02}-{d:02}")).format(d=rng.randint(1, 28), m=rng.randint(1, 12), y=rng.randint(lo, hi))
    good = [
        lambda: ("secret", "password=", pick(hexa, rng.randint(8, 32)), ""), lambda: ("secret", rng.choice(("token: ", "api_key=", "secret: \"", "key = ")), pick(alnum, rng.randint(12, 64)), ""),
        lambda: ("secret", " \"", pick(hexa, rng.choice((32, 40, 64))), "\""), lambda: ("secret", " ", rng.choice(("AKIA", "ASIA", "ghp", "xoxb")) + pick(up, 16), " "),
        lambda: ("secret", "= ", pick(alnum, 40), "\n"), lambda: ("account", "ssn ", f"{pick('123456789', 3)}-{pick('0123456789', 2)}-{pick('0123456789', 4)}", " "),
        lambda: ("account", "iban ", f"{pick('ABDEFGNS', 2)}{pick('0123456789', 2)} " + " ".join(pick("0123456789", 4) for _ in range(4)), " "),
        lambda: ("account", "account ", pick("0123456789", rng.randint(4, 6)) + "-" + pick("0123456789", rng.randint(4, 8)), "."),
        lambda: ("account", " ", pick("0123456789", rng.choice((14, 15, 16, 16, 16, 18, 19))), rng.choice((" ", ".", "!", "\n"))),
        lambda: ("secret", rng.choice((" ", "Bearer ", "token=")), ".".join("ey" * (i < 2) + pick(alnum, rng.randint(12, 60)) for i in range(3)), " "),
        lambda: ("secret", rng.choice((" ", "\"", "= ")), pick(letters, rng.choice((20, 24, 32, 40, 64))), rng.choice((" ", "\""))),
        lambda: ("secret", rng.choice(("password=", "secret: ", "api_key = \"")), pick(letters + rng.choice(("", "%.!~", "0123456789", "%.!~0123456789")), rng.randint(8, 200)), rng.choice((" ", "\""))),
        lambda: ("secret", "\n", "-----BEGIN " + rng.choice(("", "RSA ", "EC ")) + "PRIVATE KEY-----\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(rng.randint(2, 6))) + "\n-----END PRIVATE KEY-----", "\n"),
        lambda: ("secret", rng.choice(("password=", "passwd: ", "secret = ")), rng.choice("-._").join(word() for _ in range(rng.randint(2, 5))) + rng.choice(("", ".x", "!")), " "),
        lambda: ("birth", rng.choice(("born ", "born on ", "date of birth: ", "DOB ", "birthday ")), date(1925, 2012), rng.choice((" ", ".", ","))),
        lambda: ("address", rng.choice((" at ", " to ", "address: ", " ")), street(), rng.choice((",", " ", "."))),
        lambda: ("name", rng.choice((" ", "from ", "by ")), rng.choice(("Mr ", "Mrs. ", "Dr. ", "Ms ")) + title() + " " + title(), rng.choice((" ", ",", "."))), lambda: ("name", rng.choice(("Name: ", "customer name: ")), title() + " " + title(), rng.choice((" ", ",", "\n"))),
    ]
    bad = [
        lambda: ("secret", " ", word() + "-" + word() + "-" + word() + str(rng.randint(1, 99)), " "), lambda: ("secret", "/", "/".join(word() for _ in range(4)) + str(rng.randint(1, 2030)), " "),
        lambda: ("secret", " ", word() + "_" + word() + "_" + word() + pick("0123456789", 2), "("), lambda: ("account", " ", f"{rng.randint(1900, 2030)}-{rng.randint(1990, 2030)}", " "),
        lambda: ("account", " ", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", " "), lambda: ("account", " ", " ".join(pick("0123456789", rng.randint(2, 3)) for _ in range(rng.randint(3, 9))), " "),
        lambda: ("secret", "key ", word() + word() + word() + str(rng.randint(0, 9)), " "), lambda: ("account", "isbn ", "978-" + pick("0123456789", 10), " "),
        lambda: ("account", rng.choice((" ", "at ", "ts=", "time ")), str(rng.randint(1_300_000_000_000, 1_900_000_000_000)), " "), lambda: ("account", "isbn ", "978" + pick("0123456789", 10), " "), lambda: ("account", " ", pick("0123456789", 12), " "),
        lambda: ("secret", " ", ".".join(word() + word() + word() for _ in range(rng.randint(3, 5))), " "), lambda: ("secret", " ", "-".join(title() + word() for _ in range(4)), " "),
        lambda: ("secret", rng.choice((" ", "(")), "".join(title() for _ in range(rng.randint(4, 6))), rng.choice(("(", " ", "."))), lambda: ("secret", "/", "/".join(title() for _ in range(5)), "/"),
        lambda: ("birth", rng.choice((" ", "on ", "since ", "until ", "version ", "released ")), date(1990, 2030), rng.choice((" ", ".", ","))), lambda: ("birth", "version ", f"{rng.randint(1, 20)}.{rng.randint(0, 40)}.{rng.randint(10, 40)}", " "),
        lambda: ("name", rng.choice(("file ", "see ", "the ")), title() + " " + title(), " "),
    ]
    xs, ys = [], []
    for i in range(n):
        kind, before, t, after = rng.choice(good if i % 2 else bad)()
        lead = " ".join(word() for _ in range(4)) + rng.choice((" ", "\n")) + before
        text = lead + t + after + word()
        xs.append(features(text, len(lead), len(lead) + min(len(t), _OPENING), kind))
        ys.append(i % 2)
    return np.array(xs), np.array(ys, dtype=float)


class BoostedTrees:
    """Gradient boosting of depth-limited trees on the logistic loss, with isotonic calibration."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 24):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rest = np.arange(len(y)) // 2 % 4 == 3  # examples of both labels alternate
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        score = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x[~rest], (y - p)[~rest], (p * (1 - p))[~rest], cuts, self.depth)
            self.trees.append(tree)
            score += self.rate * self._leaf(tree, x)
        order = np.argsort(score[rest], kind="stable")
        blocks: list[list[float]] = []
        for s, t in zip(score[rest][order], y[rest][order], strict=True):
            blocks.append([t, 1, s])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], last[2]]
        self.at = np.array([b[2] for b in blocks])
        self.prob = np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks])
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int):
        total = g.sum() ** 2 / (h.sum() + 1)
        best = (1e-6, None, None)
        if depth and len(g) >= 20:
            for j, cut in enumerate(cuts):
                for c in cut:
                    left = x[:, j] <= c
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - total
                    if gain > best[0] and 5 <= left.sum() <= len(g) - 5:
                        best = (gain, j, c)
        if best[1] is None:
            return g.sum() / (h.sum() + 1)
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[left], g[left], h[left], cuts, depth - 1), self._grow(x[~left], g[~left], h[~left], cuts, depth - 1))

    def _leaf(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        return np.where(left, self._leaf(tree[2], x), self._leaf(tree[3], x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = sum(self.rate * self._leaf(t, x) for t in self.trees)
        return np.interp(score, self.at, self.prob)


def fit_pii(examples: int = 4000, seed: int = 7) -> BoostedTrees:
    """The judge of candidates, fitted on generated examples; the same for every table."""
    return BoostedTrees().fit(*generated_examples(examples, seed))


class _Taken:
    """Spans that don't overlap, in order of place: a span's neighbours are found by bisection."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, str]] = []

    def met(self, start: int, end: int) -> slice:
        lo = bisect_right(self.starts, start)
        lo -= bool(lo and self.spans[lo - 1][1] > start)
        return slice(lo, bisect_left(self.starts, end, lo))

    def put(self, at: slice, span: tuple[int, int, str]) -> None:
        self.starts[at], self.spans[at] = [span[0]], [span]


def added_spans(text: str, base: list[tuple[int, int, str]], model: BoostedTrees, threshold: float) -> list[tuple[int, int, str]]:
    """Candidates over the threshold that overlap no base span; of overlapping ones the likeliest, then the first.

    A value after a key word and a key block are taken whole: spans taken before that cover a part of it become one with it.  They are judged
    by their first ``_OPENING`` characters, in bounded time where many values share an end.
    """
    whole = {(*v, "secret") for v in [*values(text), *key_blocks(text)]}
    judged = {c: (c[0], min(c[1], c[0] + _OPENING), c[2]) if c in whole else c for c in candidates(text)}
    starts, reach = [b[0] for b in base], list(accumulate((b[1] for b in base), max))  # base spans come by start

    def on_base(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and reach[before - 1] > start

    some = [c for c, j in judged.items() if not on_base(j[0], j[1])]
    if not some:
        return []
    p = model.probability(np.array([features(text, *judged[c]) for c in some]))
    taken = _Taken()
    for i in sorted(np.flatnonzero(p >= threshold).tolist(), key=lambda i: (-p[i], some[i])):
        c = some[i]
        at = taken.met(c[0], c[1])
        met = taken.spans[at]
        if not met:
            taken.put(at, c)
        elif c in whole and not any(t[0] <= c[0] and c[1] <= t[1] for t in met):
            taken.put(at, (min(c[0], met[0][0]), max(c[1], met[-1][1]), "secret"))
    return taken.spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def find_pii(docs: DataFrame, model: BoostedTrees, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the base spans; spans holds those and the model's (kinds secret, account, birth, address
    and name).  Null and empty texts have no spans; bytes that are no UTF-8 count as replacement characters; rows with the
    same id stay apart, equal texts have equal spans; a null id is kept; an empty table gives no rows; other columns are
    not read.  A text is read whole, in time that grows with its length; of equally likely candidates the first is taken.
    """

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for raw in batch.column("text").to_pylist():
            t = decoded(raw)
            base = base_spans(t)
            for kind in BASE_KINDS:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + added_spans(t, base, model, threshold)))
        return {"doc_id": batch.column("doc_id"), **out}

    kind = docs.schema[key].dataType.simpleString()
    return by_batch(keys_and_text(docs, key, text), work, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first wins."""
    out, at = [], 0
    for a, b, k in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
            at = b
    return "".join([*out, text[at:]])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"), fit_pii())
