"""Personal data: patterns for the fixed kinds, and a linear-chain CRF over word shapes for the rest.

The CRF reads windows of tokens around digits, @, bracketed "at" and "dot"; it is trained on a small
labelled table by gradient ascent on the exact log-likelihood, and decoded by Viterbi on padded
numpy batches of windows. Tokens outside any window are plain words: they are never part of a span.
"""

from __future__ import annotations

import re
from functools import lru_cache
from random import Random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.batches import map_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

# Patterns of the base kinds (fixed values). E-mails and IPs, EMAIL and IP, are found without trying each start.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SIGN = re.compile(r"[0-9@+]|[(\[][aA][tT][)\]]|\b[dD][oO][tT]\b")
_DIGITS = re.compile(r"[0-9](?:[0-9.\x20-]*[0-9])?")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
CELLS = 1 << 15  # tokens of the windows decoded at once, padding included; a longer window goes alone
REACH = 40  # characters of context on each side of a sign; signs nearer than that share a window

# Words that announce personal data (fixed values).
CUES = frozenset("at dot call phone tel telephone mobile cell fax contact reach email mail e-mail address ip host server card visa mastercard amex credit debit number no".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def ip_valid(s: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in s.split(".")))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches for each kind, failing ones dropped, in order of kind and start.

    An e-mail's name ends at an @, so it begins where the characters of names before that @ do, or where the match before ends. An IP is
    four numbers of a chain joined by dots, and the next one begins at the fifth. A card lies in one run of digits, blanks and signs; a phone number begins at
    a plus sign. Time grows with the length of the text.
    """
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        free = m.end() if m else at + 1
        if m:
            found.append(("email", a, free))
        at = text.find("@", free)
    cards = []
    for run in _DIGITS.finditer(text):
        a, b = run.span()
        if b - a >= 7 and "." in run[0]:
            for chain in _CHAIN.finditer(text, a, b):
                parts, start = chain[0].split("."), chain.start()
                for i in range(0, len(parts) - 3, 4):
                    ip = ".".join(parts[i : i + 4])
                    if ip_valid(ip):
                        found.append(("ip", start, start + len(ip)))
                    start += len(ip) + 1
        if b - a >= 13:
            for m in CARD.finditer(text, a, b):
                d = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(d) <= 19 and luhn(d):
                    cards.append(("card", *m.span()))
    found += cards
    at = text.find("+")
    while at >= 0:
        if m := PHONE.match(text, at):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
            at = m.end() - 1
        at = text.find("+", at + 1)
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Token offsets of each window. Windows reach to the ends of their tokens; those that would share a token are one."""
    n = len(text)
    spans: list[list[int]] = []
    for m in _SIGN.finditer(text):
        a, b = m.span()
        if spans and a - spans[-1][1] <= 2 * REACH:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    whole: list[list[int]] = []
    for a, b in spans:
        a, b = max(0, a - REACH), min(n, b + REACH)
        if whole and a <= whole[-1][1]:
            before = whole.pop()
            a, b = before[0], max(b, before[1])
        else:
            while a and not text[a - 1].isspace():
                a -= 1
        while b < n and not text[b].isspace():
            b += 1
        whole.append([a, b])
    return [[m.span() for m in _TOKEN.finditer(text, a, b)] for a, b in whole]


_LEAD, _TRAIL = "\"'([{<", "\"')]}>.,;:!?"


def token_features(token: str) -> tuple[str, ...]:
    """Features of one token; those of short ones are kept."""
    return _short_features(token) if len(token) <= 64 else _token_features(token)


def _token_features(token: str) -> tuple[str, ...]:
    """Shape, digits and validity of one token."""
    core = token.lstrip(_LEAD).rstrip(_TRAIL)
    shape = re.sub(r"a+", "a", re.sub(r"A+", "A", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", core)))
    digits = sum(c.isdigit() for c in core)
    shape = re.sub(r"[0-9]", "d", shape)
    short = re.sub(r"d+", lambda m: f"d{min(len(m[0]), 5)}", shape)
    out = ["bias", "shape=" + short[:24], f"digits={min(digits, 20)}"]
    low = core.lower()
    if low in CUES:
        out.append("cue=" + low)
        if token[0] in "([":
            out.append("bracketed")
    if not digits and "@" not in core:
        out.append("plain")
    if token.startswith("+") or core.startswith("+"):
        out.append("plus")
    if "@" in core:
        out.append("at")
    if digits > 1 and core[0] == "0":
        out.append("zero")
    plain = core.replace("-", "")
    if plain.isdigit() and plain.isascii() and 13 <= len(plain) <= 19:
        out.append("luhn" if luhn(plain) else "notluhn")
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", core):
        out.append("ip" if ip_valid(core) else "notip")
    return tuple(out)


_short_features = lru_cache(65536)(_token_features)


def features(tokens: list[str]) -> list[list[str]]:
    own = [token_features(t) for t in tokens]
    rows = []
    for i, f in enumerate(own):
        row = list(f)
        for d in (-2, -1, 1, 2):
            j = i + d
            if 0 <= j < len(own):
                row += [f"{d}:{x}" for x in own[j][1:] if x[:3] in ("sha", "cue", "plu", "zer")]
            elif abs(d) == 1:
                row.append(f"{d}:edge")
        for d in (-3, 3):  # as far as the dot of "name at host dot com"
            if 0 <= i + d < len(own):
                row += [f"{d}:{x}" for x in own[i + d][1:] if x[:3] == "cue"]
        rows.append(row)
    return rows


def default_table(rows: int = 700, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: (tokens, labels) by rule from a seed. Decoys are labelled O."""
    r = Random(seed)
    word = lambda: "".join(r.choice(("th", "er", "an", "on", "re", "ou", "la", "ti", "en")) for _ in range(r.randint(1, 4)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def with_luhn(n: int, good: bool) -> str:
        body = digits(n - 1)
        right = next(c for c in "0123456789" if luhn(body + c))
        return body + (right if good else r.choice([c for c in "0123456789" if c != right]))

    def piece() -> tuple[list[str], str]:
        k = r.randrange(26)
        name = f"{word()}.{r.randint(1, 99)}" if r.random() < 0.5 else word()
        host = f"{word()}.{r.choice(('com', 'org', 'net', 'de'))}"
        if k == 0:
            return [f"{name}@{host}"], "email"
        if k == 1:
            a = r.choice(("(at)", "[at]", "(AT)"))
            return [name, a, host], "email"
        if k == 2:
            a, d = r.choice((("(at)", "(dot)"), ("[at]", "[dot]")))
            return [name, a, host.split(".")[0], d, host.split(".")[1]], "email"
        if k == 3:
            return [".".join(str(r.randint(0, 255)) for _ in range(4))], "ip"
        if k == 4:
            return [".".join(str(r.randint(256, 999)) for _ in range(4))], "O"
        if k == 5:
            return [with_luhn(16, True)], "card"
        if k in (6, 7):
            return [with_luhn(16, False)], "O"
        if k == 8:
            return [f"+{r.randint(1, 99)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], "phone"
        if k == 9:
            return [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], "phone"
        if k == 10:
            return [f"{digits(3)}-{digits(3)}-{digits(4)}"], "phone"
        if k == 11:
            return [digits(r.choice((1, 2, 3, 4, 5, 6, 8)))], "O"
        if k == 12:
            return [r.choice(("4.0.", "2.0.", "3.", "1.2.3", "v2", "10%", "2024-01-05", "12:30"))], "O"
        if k == 13:
            return [f"{word()}={digits(6)}{word()}"], "O"
        if k == 14:
            return [f"{digits(2)}-{digits(2)}-{digits(4)}", word()], "O"
        if k in (16, 17):
            return [name, "at", *host.replace(".", " dot ").split()], "email"
        if k == 18:
            return [name, "at", word(), "dot", *host.replace(".", " dot ").split()], "email"
        if k == 19:
            return r.choice((["dot"], [word(), "dot", word()], ["at", word()], ["at", "the", "dot"], [word(), "at", word(), word()])), "O"
        if k in (20, 21):
            return r.choice(([f"0{digits(3)}", digits(3), digits(4)], [f"0{digits(2)}", digits(4), digits(4)], [f"0{digits(4)}", digits(6)])), "phone"
        if k == 22:
            return [f"{digits(3)}.{digits(3)}.{digits(4)}"], "phone"
        if k == 23:
            return r.choice(([f"0{digits(r.randint(1, 3))}"], [digits(2), digits(2)], [digits(3), digits(3)], [digits(1), digits(2), digits(1)], [digits(4), digits(4)], [f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}"])), "O"
        if k == 24:
            return r.choice(([f"{digits(1)}.{digits(2)}.{digits(1)}"], [f"{digits(3)}.{digits(2)}"], [f"{digits(1)}.{digits(3)}.{digits(3)}"], [f"{digits(2)}.{digits(2)}.{digits(4)}"], [f"{digits(3)}.{digits(3)}.{digits(3)}"])), "O"
        if k == 25:
            return [r.choice(("call", "mail", "phone", "contact")), word(), r.choice(("at", "dot", "no"))], "O"
        return ['"' + "".join(r.choice("0123456789abcdef") for _ in range(r.choice((24, 32, 40)))) + '"'], "O"

    cue = {"email": ("email", "contact", "mail"), "ip": ("host", "server", "ip"), "card": ("card", "visa"), "phone": ("call", "phone", "tel"), "O": ("no", "number", "at")}
    table = []
    for _ in range(rows):
        tokens, labels = [], []
        for _ in range(r.randint(1, 2)):
            for _ in range(r.randint(0, 4)):
                tokens.append(r.choice((word(), word().capitalize(), word() + r.choice(",.;"), "at", "no")))
                labels.append("O")
            p, label = piece()
            if r.random() < 0.3:
                tokens.append(r.choice(cue[label]) + r.choice(("", ":")))
                labels.append("O")
            tokens += p
            labels += [label] * len(p)
            if r.random() < 0.3:
                tokens[-1] += r.choice(",.")
        for _ in range(r.randint(0, 4)):
            tokens.append(word())
            labels.append("O")
        table.append((tokens, labels))
    return table


class CRF:
    """Linear chain: emission weights by feature and label, transition weights, start weights."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.index, self.emit, self.trans, self.start = index, emit, trans, start

    def emissions(self, sequences: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(windows, longest, labels) scores and the lengths."""
        longest = max(map(len, sequences))
        out = np.zeros((len(sequences), longest, len(LABELS)))
        get, nothing = self.index.get, len(self.index)
        for i, seq in enumerate(sequences):
            for t, row in enumerate(seq):
                out[i, t] = self.emit[[get(x, nothing) for x in row]].sum(0)
        return out, np.array([len(s) for s in sequences])

    def decode(self, sequences: list[list[list[str]]]) -> list[np.ndarray]:
        """Viterbi over a padded batch."""
        e, lengths = self.emissions(sequences)
        n, longest, k = e.shape
        back = np.zeros((n, longest, k), np.int8)
        score = self.start + e[:, 0]
        for t in range(1, longest):
            step = score[:, :, None] + self.trans
            back[:, t] = step.argmax(1)
            score = np.where((t < lengths)[:, None], step.max(1) + e[:, t], score)
        state = score.argmax(1)
        path = np.zeros((n, longest), np.int8)
        every = np.arange(n)
        for t in range(longest - 1, -1, -1):
            path[:, t] = state
            state = np.where((t < lengths) & (t > 0), back[every, t, state], state)
        return [path[i, : lengths[i]] for i in range(n)]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))


def fit(table: list[tuple[list[str], list[str]]], steps: int = 120, rate: float = 0.2, l2: float = 0.002) -> CRF:
    """Adam on the exact gradient from forward and backward passes over the padded table."""
    rows = [features(t) for t, _ in table]
    index = {x: i for i, x in enumerate(sorted({x for seq in rows for row in seq for x in row}))}
    k, n, longest, nf = len(LABELS), len(rows), max(map(len, rows)), len(index)
    lengths = np.array([len(s) for s in rows])
    gold = np.zeros((n, longest), int)
    seq_of, at_of, feat_of = [], [], []
    for i, (seq, (_, labels)) in enumerate(zip(rows, table, strict=True)):
        gold[i, : len(labels)] = [LABELS.index(x) for x in labels]
        for t, row in enumerate(seq):
            seq_of += [i] * len(row)
            at_of += [t] * len(row)
            feat_of += [index[x] for x in row]
    cell, feat = np.array(seq_of) * longest + np.array(at_of), np.array(feat_of)
    inside = np.arange(longest)[None, :] < lengths[:, None]
    shapes = [(nf + 1, k), (k, k), (k,)]
    w = [np.zeros(s) for s in shapes]
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    one = np.eye(k)[gold] * inside[:, :, None]
    for step in range(1, steps + 1):
        e = np.zeros((n * longest, k))
        np.add.at(e, cell, w[0][feat])
        e = e.reshape(n, longest, k)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = w[2] + e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(inside[:, t, None], _lse(alpha[:, t - 1, :, None] + w[1], 1) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(inside[:, t + 1, None], _lse(w[1] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = _lse(alpha[np.arange(n), lengths - 1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * inside[:, :, None]
        d = (one - p).reshape(-1, k)
        g_emit = np.zeros(shapes[0])
        np.add.at(g_emit, feat, d[cell])
        g_trans = np.zeros((k, k))
        for t in range(1, longest):
            on = inside[:, t]
            pair = np.exp(alpha[on, t - 1, :, None] + w[1] + (e[on, t] + beta[on, t])[:, None, :] - z[on, None, None])
            g_trans += one[on, t - 1].T @ one[on, t] - pair.sum(0)
        grads = [g_emit / n - l2 * w[0], g_trans / n - l2 * w[1], (one[:, 0] - p[:, 0]).sum(0) / n - l2 * w[2]]
        for j, g in enumerate(grads):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            w[j] = w[j] + rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
        w[0][nf] = 0  # unseen features weigh nothing
    return CRF(index, *w)


@lru_cache(1)
def default_model() -> CRF:
    return fit(default_table())


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], model: CRF) -> list[list[tuple[str, int, int]]]:
    """Runs of tokens with one decoded kind that touch no base span, without punctuation around them."""
    where, tokens_of = [], []
    for i, text in enumerate(texts):
        for w in windows(text):
            if w:
                where.append(i)
                tokens_of.append(w)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    order = sorted(range(len(tokens_of)), key=lambda j: len(tokens_of[j]))
    while order:  # alike lengths together, so padding stays small
        part = [order.pop()]
        while order and len(part) < min(256, CELLS // len(tokens_of[part[0]])):
            part.append(order.pop())
        sequences = [features([texts[where[j]][a:b] for a, b in tokens_of[j]]) for j in part]
        for j, path in zip(part, model.decode(sequences), strict=True):
            i, spans, t = where[j], tokens_of[j], 0
            while t < len(path):
                u = t + 1
                if path[t]:
                    while u < len(path) and path[u] == path[t]:
                        u += 1
                    a, b = spans[t][0], spans[u - 1][1]
                    while a < b and texts[i][a] in "\"'[{<":
                        a += 1
                    while a < b and texts[i][b - 1] in "\"'}>.,;:!?":
                        b -= 1
                    kind = LABELS[path[t]]
                    if a < b and plausible(kind, texts[i][a:b]) and not any(a < y and x < b for _, x, y in bases[i]):
                        out[i].append((kind, a, b))
                t = u
    return out


def plausible(kind: str, s: str) -> bool:
    """The exact check that follows the decoding: enough digits of the right kind, or an at sign."""
    digits = "".join(c for c in s if c in "0123456789")
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in s)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s)) and ip_valid(s)
    return bool(re.search(r"@|[(\[][aA][tT][)\]]|(?i:\sat\s.*\sdot\s+[a-z]{2,}$)", s)) and any(c.isalpha() for c in s)


DDL = "id bigint, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """One row for each row of docs: id, base and spans (base and what the CRF adds), in code points.

    Spans are sorted by kind as listed and start; equal places of two kinds are both there, but no added span touches a base one. Null
    text counts as empty and has none; ids may be null or repeated; an empty table gives an empty result; other columns are ignored.
    Very long texts are read whole, in time that grows with their length; a window is decoded whole, with memory for its tokens.
    """
    model = fit(labelled) if labelled else default_model()

    def start():
        def work(batch):
            texts = [t or "" for t in batch["text"]]
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, model)
            key = lambda s: (KINDS.index(s[0]), s[1])
            pack = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            return {"id": batch["id"], "base": [pack(b) for b in bases], "spans": [pack(sorted(b + m, key=key)) for b, m in zip(bases, more, strict=True)]}

        return work

    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), start, DDL)
