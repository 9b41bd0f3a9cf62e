"""Personal data by candidates and boosted trees.

Fixed patterns give spans that always stay. High-recall generators propose further, overlapping spans; gradient-boosted
trees score them by their format and context; a calibrated threshold for each kind selects, and the higher score wins
where selected spans overlap.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import by_value, chunks, per_process, shared, small_batches

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The order in which kinds are listed; the first four are the fixed patterns'.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping within each kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:  # a match's local part is the run before the sign, and no earlier start can match
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


#: Written-out addresses: what stands for the sign, and a host with its dots, which a bare sign may not leave plain.
SIGN = re.compile(r"(?i) ?[(\[{]at[)\]}] ?| at ")
HOST = {
    True: re.compile(r"(?i)[a-z0-9-]++(?:(?: ?[(\[{]dot[)\]}] ?| dot |\.)[a-z0-9-]++)+"),
    False: re.compile(r"(?i)[a-z0-9-]++(?:(?: ?[(\[{]dot[)\]}] ?| dot )[a-z0-9-]++)+"),
}


def written_addresses(text: str):
    """Starts and ends of addresses whose sign is written out: the run of characters before it, and a host after it."""
    done = 0
    for m in SIGN.finditer(text):
        a = m.start()
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        while a < m.start() and not text[a].isalnum():
            a += 1
        done = m.end()
        if a < m.start() and (host := HOST[m[0] != " at "].match(text, m.end())):
            yield a, host.end()


#: Further generators: kind and a pattern whose group 1 is the span. Every match of the numeric ones has a digit.
NUMERIC = (
    # no phone number begins as a date
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])(?!(?:19|20)[0-9]{2}[-./ ](?:0[1-9]|1[0-2])[-./ ](?:0[1-9]|[12][0-9]|3[01])(?![0-9]))(\(?[0-9]{2,4}\)?[ ./-]{0,2}(?:[0-9]{3,4}[ .-]?[0-9]{3,4}(?:[ .-]?[0-9]{2,4})?|[0-9]{3}(?:[ .-][0-9]{2}){2,5}|[0-9]{2}(?:[ .-][0-9]{2}){2,5}))(?![0-9A-Za-z-])")),
    ("card", re.compile(r"(?<![0-9])([0-9]{4}[. ]{1,2}[0-9]{4,6}[. ]{1,2}[0-9]{4,5}(?:[. ]{1,2}[0-9]{3,4})?)(?![0-9])")),
    ("iban", re.compile(r"\b([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    ("ssn", re.compile(r"(?<![0-9-])([0-9]{3}[- ][0-9]{2}[- ][0-9]{4})(?![0-9-])")),
)
WORDED = (
    ("secret", re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|bearer)\b[\"']?\s{0,3}[=:]?\s{0,3}[\"']?([a-z0-9+/_.-]{12,}+)")),
    ("secret", re.compile(r"(?i)\b(?:passw(?:or)?d|passphrase|pwd|secret|api[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"'<>,;]{6,}+)")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])((?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)")),
    # a key block with its headers
    ("secret", re.compile(r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,.]|-(?!----))++-----END [A-Z ]{0,20}PRIVATE KEY-----)")),
)
DIGIT = re.compile(r"[0-9]")
#: How secrets of public formats begin.
KNOWN = re.compile(r"(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}\Z|(?:gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16}|eyJ[A-Za-z0-9_-]{8,}\.|-----BEGIN ")
CUES = re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|e-?mail|mail|contact|write|reach|ssn|social|security|card|visa|pay|iban|account|bank|token|secret|passw(?:or)?d|key|bearer|credential)")
AWAY = re.compile(r"(?i)\b(?:order|version|isbn|issn|ref|invoice|page|pages|score|line|lot|sku|part|model|serial|dates?|year|sha1?|md5|commit|look|was|is|were|it)\W*$")


def candidates(text: str) -> list[Span]:
    """Spans that may be personal, whatever the trees say; they overlap."""
    out = [("email", a, b) for a, b in written_addresses(text)]
    generators = NUMERIC + WORDED if DIGIT.search(text) else WORDED
    return out + [(kind, m.start(1), m.end(1)) for kind, pattern in generators for m in pattern.finditer(text)]


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 12]
    digits = [c for c in s if c.isdigit()]
    seps = [c for c in s if not c.isalnum()]
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts)
    area, group, serial = (s[:3], s[4:6], s[7:11]) if kind == "ssn" else ("", "", "")
    return [
        float(KINDS.index(kind)),
        float(len(s)),
        float(len(digits)),
        float(len(set(digits))),
        float(len(seps)),
        float(len(set(seps))),
        entropy,
        float(bool(CUES.search(before))),
        float(bool(AWAY.search(before))),
        float(kind == "card" and luhn("".join(digits))),
        float(kind == "iban" and iban_ok(s)),
        float(kind == "ssn" and area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"),
        float(bool(before[-1:].isalnum()) or bool(after[:1].isalnum())),
        float(any(x in s.lower() for x in ("(at)", "[at]", "{at}", "(dot)", "[dot]"))),
        float(any(c.isdigit() for c in s) and any(c.isalpha() for c in s)),
        float(s[:1] == "("),
        float(bool(KNOWN.match(s))),
        float(any(c.isupper() for c in s) and any(c.islower() for c in s)),
        float("-" in s),
    ]


class Trees:
    """Gradient boosting of shallow regression trees on the logistic loss."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = y.mean()
        self.bias = math.log(p / (1 - p))
        f = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree = self.grow(x, y - q, q * (1 - q), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self.rate * self.run(tree, x)
        return self

    def grow(self, x, g, h, rows, depth):
        leaf = float(g[rows].sum() / (h[rows].sum() + 1.0))
        best = None
        if depth:
            total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for j in range(x.shape[1]):
                order = rows[np.argsort(x[rows, j], kind="stable")]
                v = x[order, j]
                gs, hs = np.cumsum(g[order]), np.cumsum(h[order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                cut = cut[(cut + 1 >= self.least) & (len(rows) - cut - 1 >= self.least)]
                if len(cut):
                    gain = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1) - total
                    i = int(np.argmax(gain))
                    if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                        best = (gain[i], j, (v[cut[i]] + v[cut[i] + 1]) / 2)
        if best is None:
            return leaf
        _, j, t = best
        low = x[rows, j] <= t
        return j, t, self.grow(x, g, h, rows[low], depth - 1), self.grow(x, g, h, rows[~low], depth - 1)

    def run(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, t, low, high = tree
        return np.where(x[:, j] <= t, self.run(low, x), self.run(high, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for tree in self.trees:
            f += self.rate * self.run(tree, x)
        return 1 / (1 + np.exp(-f))


def examples(n: int = 4000, seed: int = 11) -> list[tuple[str, Span, bool]]:
    """Made-up sentences with one candidate each and whether it is personal: the training set, the same each time."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda a=3, b=9: "".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randint(a, b)))

    def card(valid: bool) -> str:
        while True:
            d = digits(16)
            if luhn(d) == valid:
                return d[:4] + "." + d[4:8] + "." + d[8:12] + "." + d[12:] if r.random() < 0.5 else "  ".join(d[i : i + 4] for i in (0, 4, 8, 12))

    def iban(valid: bool) -> str:
        body, land = digits(18), r.choice(["DE", "FR", "ES", "GB", "NL", "IT"])
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        s = f"{land}{(check if valid else (check + r.randint(1, 90)) % 97):02d}{body}"
        return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    cue = {"email": ["mail me at", "contact", "write to", "e-mail:"], "phone": ["call", "tel.", "phone:", "fax", "reach me at"], "card": ["card", "visa", "pay with"], "iban": ["IBAN", "account", "bank"], "ssn": ["SSN", "social security number"]}
    away = ["order", "version", "ISBN", "ref", "invoice", "pages", "score", "lot", "SKU", "part", "serial", "date", "sha1", "commit"]
    out = []

    def add(kind: str, text: str, good: bool) -> None:
        spans = [s for s in candidates(text) if s[0] == kind]
        if spans:
            out.append((text, max(spans, key=lambda s: s[2] - s[1]), good))

    while len(out) < n:
        kind, good = r.choice([k for k in KINDS if k != "ip"]), r.random() < 0.5
        lead = r.choice(cue.get(kind, ["the"])) if r.random() < (0.75 if good else 0.1) else r.choice(away) if not good and r.random() < 0.7 else word()
        if kind == "email":
            body = f"{word()}{r.choice(['.', '_', ''])}{word()}{r.choice(['(at)', ' (at) ', '[at]', ' [at] ', ' at ' if lead in cue['email'] else '(at)'])}{word()}{r.choice([' dot ', '(dot)', ' [dot] ', '.'])}{r.choice(['com', 'org', 'net', 'de', 'fr'])}" if good else f"{word()} at {word()} dot {word()}"
        elif kind == "phone":
            body = f"({digits(3)}) {digits(3)}-{digits(4)}" if r.random() < 0.4 else f"{digits(3)}{r.choice('-. ')}{digits(3)}{r.choice('-. ')}{digits(4)}"
            if not good:
                body = r.choice([f"{digits(4)}-{digits(4)}-{digits(4)}", f"{digits(2)} {digits(3)} {digits(3)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
        elif kind == "card":
            body = card(good)
        elif kind == "iban":
            body = iban(good)
        elif kind == "ssn":
            body = f"{r.choice('12345')}{digits(2)}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}" if good else f"{r.choice(['000', '9' + digits(2), '666'])} {digits(2)} {digits(4)}" if r.random() < 0.5 else f"{digits(3)} {digits(2)} {digits(4)}"
        else:
            lead = r.choice(["token =", "secret:", "password=", "api_key =", "token", "secret"]) if good else r.choice(["token", "secret", "bearer", "password:"])
            body = "".join(r.choice("0123456789abcdef") for _ in range(40)) if good and r.random() < 0.5 else "".join(r.choice("ABCDEFGHJKMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(r.randint(20, 48))) if good else word(12, 20) if r.random() < 0.7 else f"{word(5, 8)}-{word(5, 8)}"
        add(kind, f"{word()} {word()} {lead} {body} {word()}, {word()}", good)
    # short secrets, whose digits tell them from words, and public formats, which need no word before them
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    lower, upper, mixed = "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for i in range(n // 3):
        good, lead = r.random() < 0.5, r.choice(["password=", "password: ", "passwd=", "token = ", "secret=", "api_key=", "pwd="])
        if i % 2:
            if good:
                k = r.randint(6, 24)
                body = r.choice([some("0123456789abcdef", max(k, 12)), some(lower, k), some(mixed, k), word(4, 8) + digits(2) + r.choice("!?#*") + word(1, 3)])
                body += "" if any(c.isdigit() for c in body) and any(c.isalpha() for c in body) else "a7"
            else:
                body = r.choice([word(6, 14), word(6, 10).capitalize(), f"{word(5, 8)}-{word(5, 8)}", f"{word(4, 8)}_{word(4, 8)}", f"{word(3, 6)}.{word(3, 6)}", "********"])
            add("secret", f"{word()} {word()} {lead}{body} {word()}, {word()}", good)
        else:
            body = r.choice([r.choice(["AKIA", "ASIA"]) + some(upper, 16), r.choice(["ghp_", "gho_", "glpat-", "sk-", "sk_live_", "AIza"]) + some(mixed, r.randint(20, 48)), f"xoxb-{digits(11)}-{some(mixed, 24)}", f"eyJ{some(mixed, 30)}.eyJ{some(mixed, 60)}.{some(mixed, 43)}"]) if good else r.choice(["AKIA" + word(16, 16).upper(), "sk-" + "-".join(word(5, 8) for _ in range(3))])
            add("secret", f"{word()} {word(3, 9)} {'1 ' if r.random() < 0.5 else ''}{body} {word()}, {word()} {digits(1)}", good)
    # what no word leads to: well-formed social security numbers, and tokens without a digit, which mixed case tells from words
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for i in range(n // 4):
        good = r.random() < 0.5
        if i % 2:
            area = r.choice([f"{r.choice('12345')}{digits(2)}", f"00{r.choice('123456789')}", f"8{digits(2)}"]) if good else r.choice(["000", "666", "9" + digits(2)])
            body = f"{area}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
            lead = r.choice(["number is", "is", "was", word(), "my number:", "look,"])
            add("ssn", f"{word()} {word()} {lead} {body} {word()}, {word()}", good)
        else:
            body = some(letters, r.randint(16, 64)) if good else r.choice([word(12, 20), word(12, 20).capitalize(), f"{word(6, 9)}_{word(6, 9)}", f"{word(6, 9).capitalize()}-{word(6, 9)}", word(12, 18).upper()])
            add("secret", f"{word()} {word()} {r.choice(['token =', 'secret:', 'token', 'bearer', 'Bearer', 'Authorization: Bearer', 'api_key='])} {body} {word()}, {word()}", good)
    # rarer shapes: phones without separators, which only a cue tells from other numbers, or in pairs; long and dotted tokens
    code = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_") for _ in range(k))
    for i in range(n // 4):
        good = r.random() < 0.5
        if i % 2:
            pairs = r.choice(" .").join([f"0{r.choice('123456789')}", *[digits(2) for _ in range(4)]])
            body = r.choice([f"({digits(3)}){digits(3)}-{digits(4)}", f"{r.choice('23456789')}{digits(9)}", f"0{digits(r.randint(8, 10))}", pairs])
            lead = r.choice(cue["phone"])
            if not good:
                body = r.choice([digits(r.randint(8, 16)), f"{digits(4)}-{digits(2)}-{digits(2)} {digits(2)}", " ".join(digits(2) for _ in range(r.randint(4, 6)))])
                lead = r.choice([*away, word()])
            add("phone", f"{word()} {word()} {lead} {body} {word()}, {word()}", good)
        else:
            lead = r.choice(["token =", "secret:", "api_key =", "token", "bearer", "Bearer", "Authorization: Bearer"]) if good else r.choice(["token", "secret", "bearer", "password:"])
            body = r.choice([f"eyJ{code(r.randint(17, 40))}.eyJ{code(r.randint(40, 900))}.{code(r.randint(43, 342))}", code(r.randint(100, 1200))]) if good else "-".join(word(4, 9) for _ in range(r.randint(3, 40)))
            add("secret", f"{word()} {word()} {lead} {body} {word()}, {word()}", good)
    return out


#: Selected spans are personal at least this often among the examples kept back for calibration.
PRECISION = 0.98


def fitted() -> tuple[Trees, dict[str, float]]:
    """Trees from two thirds of the examples and, from the rest, the lowest threshold of each kind with enough precision."""
    made = examples()
    x, y = np.array([features(t, s) for t, s, _ in made]), np.array([float(g) for _, _, g in made])
    back = np.arange(len(made)) % 3 == 0
    trees = Trees().fit(x[~back], y[~back])
    p, limits = trees.predict(x[back]), {}
    for k, kind in enumerate(KINDS):
        own = x[back][:, 0] == k
        order = np.argsort(-p[own])
        right, scores = np.cumsum(y[back][own][order]) / np.arange(1, own.sum() + 1), p[own][order]
        good = np.flatnonzero(right >= PRECISION)
        limits[kind] = float(max(0.5, scores[good[-1]])) if len(good) else 2.0
    return trees, limits


def find_spans(text: str, model: tuple[Trees, dict[str, float]]) -> tuple[list[Span], list[Span]]:
    """The fixed patterns' spans, and those with the selected candidates; both by kind, then start."""
    order = lambda s: (KINDS.index(s[0]), s[1])
    base = sorted(base_spans(text), key=order)
    proposed = candidates(text)
    if not proposed:
        return base, base
    trees, limits = model
    scores = trees.predict(np.array([features(text, s) for s in proposed]))
    fixed = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in fixed], list(itertools.accumulate((b for _, b in fixed), max))
    own: list[tuple[int, int]] = []  # selected spans, which never overlap
    chosen = []

    def taken(a: int, b: int) -> bool:
        """Whether a span that begins before b ends after a: the farthest end of the fixed ones, and the last selected one."""
        i, j = bisect_left(starts, b), bisect_left(own, (b, 0))
        return i > 0 and reach[i - 1] > a or j > 0 and own[j - 1][1] > a

    for score, span in sorted(zip(scores, proposed), key=lambda x: (-x[0], x[1])):
        if score >= limits[span[0]] and not taken(span[1], span[2]):
            chosen.append(span)
            insort(own, (span[1], span[2]))
    return base, sorted(base + chosen, key=order)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shared_model(spark: SparkSession):
    """The fitted model, made once by the driver, as a function for executors."""
    return shared(spark, "pii", per_process("pii", fitted))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, has_personal_data boolean"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and checksum of the fixed patterns' spans, all spans, their number and whether there is any, for each document.

    Null and empty texts have no spans; repeated rows are searched each; further columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    model = shared_model(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = [find_spans(t or "", model()) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS[:4]]
                digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows])
                every = [pa.array([listed(s) for _, s in rows]), pa.array([len(s) for _, s in rows], pa.int64()), pa.array([bool(s) for _, s in rows])]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, *every], names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def redact(text: Column) -> Column:
    """The text with each span replaced by its kind in brackets; null stays null."""
    model = shared_model(SparkSession.active())

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redacted(t, find_spans(t, model())[1]) for t in texts.to_pylist()], pa.string())

    return run(text)


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


by_value(__name__)
