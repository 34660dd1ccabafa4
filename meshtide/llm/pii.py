"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IP numbers, card numbers and telephone
numbers by their form and their check (octets, Luhn, digit counts). The field
tags the words of a text as beginning, inside or outside of such data from their
shapes and those of their neighbours; it is trained on a small labelled table, made by rule from
sentence frames, by maximum likelihood and decoded by Viterbi in numpy batches. It adds spans that
the patterns cannot see, such as telephone numbers without a plus sign; where
one overlaps a span of the patterns, the pattern's stays alone.

Whole texts are tagged. The field holds words without digits, an at-sign (``@``, ``[at]``, or beside a lone one) or a lone
telephone sign to be outside (:func:`plain`, in training and decoding alike), so a
chain falls apart at each of them: decoding the stretches between them, with the
outside words around as context, is decoding the whole text.

Defined results: null text counts as empty; texts without findings have zero
counts and empty spans; repeated rows get equal results; null ids are kept; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Sentences of the labelled table: ``{kind}`` stands for a value of that kind, ``{other}`` for a number that is no personal data.
FRAMES = (
    "call {phone} after noon", "my number is {phone}, thanks", "Tel. {phone} in Berlin", "phone={phone} or write", "fax: {phone}; the desk is open", "numéro {phone} le soir", "teléfono {phone} de la oficina", "und {phone} nur abends",
    "write to {email} soon", "contact {email}.", "mail {email}, inside", "<{email}> wrote", "an address: {email}!! works", "de la {email} en que", "the {email} with {phone} too",
    "from {ip} to {ip}", "host {ip} was down", "server at {ip}, answered", "ist {ip}### von", "{ip} and {card} here", "les {ip} de un",
    "card {card} expired", "paid with {card}, yesterday", "visa: {card}; valid", "der {card}!! mit", "el {card} para {email}", "{card}",
    "the year {other} was warm", "about {other} people and {other} dogs", "chapter {other} of {other}", "token = {other} here", "order {other} shipped", "sum {other} {other} done", "id {other}, of row", "und {other} nicht", "en {other}.", "License, Version {other} applies", "see {other}!! for more",
    "the and of to in is with for that", "Der die das und ist mit von.", "le la les de un en que", "el la los de que y en", "@ home or @work today", "it was on the other side (at) night",
)
AT_SIGNS, DOT_SIGNS = ("@", " @ ", "[at]", "(at)", " (at) ", " [at] "), (".", "[.]", "(.)")


def luhn_digit(digits: str) -> str:
    """The digit that makes ``digits`` plus it a valid card number."""
    return next(d for d in "0123456789" if luhn(digits + d))


def value_of(kind: str, rng) -> str:
    """A made-up value in one of the forms that people write."""
    some = lambda n, first="0123456789": str(rng.choice(list(first))) + "".join(map(str, rng.integers(0, 10, n - 1)))
    pick = lambda xs: xs[rng.integers(len(xs))]
    name = lambda: "".join(rng.choice(list("aeioubdgklmnrst"), rng.integers(2, 8)))
    if kind == "email":
        local = pick((name(), f"{name()}.{name()}", f"{name()}_{some(2)}", f"{name()}.{some(2)}", f"{name()}+{name()}"))
        domain = pick((f"{name()}.org", f"{name()}{some(1)}.{name()}.com", f"{name()}-{name()}.net", name()))
        sign = pick(AT_SIGNS) if rng.random() < 0.5 else "@"
        return f"{local}{sign}{domain + '.org' if ' ' in sign and '.' not in domain else domain}"
    if kind == "ip":
        return (pick(DOT_SIGNS) if rng.random() < 0.4 else ".").join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == "card":
        body = some(15, "3456")
        body = body + luhn_digit(body)
        return pick((" ", "-", "", "", ".", "/")).join(body[k : k + 4] for k in range(0, 16, 4))
    if kind == "phone":
        a, b, c = some(3), some(3), some(4)
        return pick((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{some(2)} {b} {some(2)} {some(2)}", f"+{some(1, '123456789')} ({a}) {b}-{c}", f"+{some(2, '123456789')} {some(2)} {b}{c}", f"(0{some(2)}) {c} {some(4)}", f"0{a} {b}{c}", f"+{some(1, '123456789')} {a} {b} {c}"))
    wrong = some(15)
    wrong += str((int(luhn_digit(wrong)) + 1 + rng.integers(9)) % 10)
    return pick((some(1), some(2), some(3), some(4), some(5), some(6), some(8), f"{some(1)}.{some(1)}", f"{some(2)}.{some(3)}", f"{some(1)}.{some(1)}.{some(1)}", "2.0.", f"{some(2)}-{some(2)}", f"19{some(2)}-0{some(1)}-1{some(1)}", f"1{some(1)}:{some(2)}", wrong, f"{wrong[:4]} {wrong[4:8]} {wrong[8:12]} {wrong[12:]}", wrong[:12], f'"{some(1)}f{some(4)}a{some(3)}c{some(8)}e{some(5)}"', f"300.{some(3)}.{some(2)}.999", f"{some(3)} {some(3)} {some(3)} {some(3)} {some(3)} {some(3)}", f"v{some(1)}.{some(1)}", f"{some(1)}x", f"{some(3)},{some(3)}"))


@lru_cache(maxsize=8)
def labelled_table(rows: int = 480, seed: int = 17) -> tuple[str, ...]:
    """The labelled table, by rule: ``{kind:span}`` marks personal data, all else is outside."""
    rng = np.random.default_rng(seed)
    kind = lambda m: value_of("other", rng) if m[1] == "other" else f"{{{m[1]}:{value_of(m[1], rng)}}}"
    return tuple(re.sub(r"\{(\w+)\}", kind, FRAMES[k % len(FRAMES)]) for k in range(rows))


WORD = re.compile(r"\S+")
ANCHOR = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
#: Rounds and strength of the training; words on either side of a word whose shapes it sees.
ROUNDS, RATE, DECAY, SIDE = 150, 0.2, 1e-3, 2
#: Punctuation around a word.
EDGE = ".,;:!?\"'<>#$%&*|"

#: Signs that may stand alone inside a telephone number, and in place of the sign of an address.
SIGNS = frozenset("+()-")
LONE_AT = frozenset(("@", "(at)", "[at]"))
OUTSIDE_ONLY = -1e4


def plain(words: list[str]) -> list[bool]:
    """Words that can only be outside: without digits or signs, and not beside a lone at-sign."""
    out = [not ANCHOR.search(w) and w not in SIGNS for w in words]
    for k, w in enumerate(words):
        if w in LONE_AT:
            for j in (k - 1, k + 1):
                if 0 <= j < len(words):
                    out[j] = False
    return out


@lru_cache(maxsize=1 << 16)
def shape(word: str) -> str:
    """Letters as A/a, digits as 9, runs up to four long, other characters as they are."""
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", word)
    s = re.sub(r"\d", "9", s)
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", s)[:40]


@lru_cache(maxsize=1 << 16)
def traits(word: str) -> tuple[str, ...]:
    """Features of one word: its shape and coarse views of it; the first few are seen from its neighbours too."""
    if not ANCHOR.search(word) and word not in SIGNS:
        return ("plain",)
    figures = re.sub(r"[^0-9]", "", word)
    digits = len(figures)
    body = word.strip(EDGE)
    form = "lone" if word in LONE_AT else "mail" if kind_form("email", body) else "quad" if kind_form("ip", body) else "only" if re.fullmatch(r"[0-9().+/-]+", body) else "mixed"
    return ("anchored", f"form={form}", f"digits={min(digits, 17)}", f"core={shape(body)}", f"shape={shape(word)}", f"dots={min(body.count('.'), 4)}", f"wrap={word[:1] == '('}{body[-1:] == ')'}", f"plus={word[:1] == '+'}", f"card={digits >= 12 and luhn(figures)}", f"form={form}&digits={min(digits, 17)}&card={digits >= 12 and luhn(figures)}")


def tags() -> list[str]:
    return ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]


def features(words: list[str], k: int) -> list[str]:
    out = []
    for d in range(-SIDE, SIDE + 1):
        at = words[k + d] if 0 <= k + d < len(words) else ""
        out += [f"{d}:{t}" for t in (traits(at) if d == 0 else traits(at)[:3])]
    return out


def labelled_rows(table=None) -> list[tuple[list[str], list[str]]]:
    """Words and tags of the labelled table."""
    rows = []
    for line in labelled_table() if table is None else table:
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w+):([^}]*)\}", line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        text += line[at:]
        words, tagged = [], []
        for m in WORD.finditer(text):
            words.append(m[0])
            kind = next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None)
            tagged.append("O" if kind is None else ("B-" if m.start() <= kind[0] else "I-") + kind[2])
        rows.append((words, tagged))
    return rows


class Field:
    """Weights of a linear chain: ``emit`` (features, tags) and ``move`` (tags, tags)."""

    def __init__(self, rows, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY):
        self.tags = tags()
        number = {t: k for k, t in enumerate(self.tags)}
        names = sorted({f for words, _ in rows for k in range(len(words)) for f in features(words, k)})
        self.names = {f: k for k, f in enumerate(names)}
        n = len(self.tags)
        self.emit, self.move = np.zeros((len(names), n)), np.zeros((n, n))
        # an inside tag follows the beginning or inside of its own kind only
        self.ban = np.zeros((n, n))
        for j, t in enumerate(self.tags):
            if t[0] == "I":
                self.ban[[i for i, s in enumerate(self.tags) if s[2:] != t[2:]], j] = OUTSIDE_ONLY
        rows = [r for r in rows if r[0]]
        if not rows:
            return
        # all rows at once, padded to the longest
        size = np.array([len(words) for words, _ in rows])
        live = np.arange(size.max())[None] < size[:, None]
        at = [(r * size.max() + k, f) for r, (words, _) in enumerate(rows) for k in range(len(words)) for f in self.known(words, k)]
        word, feature = (np.array(x) for x in zip(*at, strict=True))
        free = np.zeros(live.shape, bool)
        gold = np.zeros((*live.shape, n))
        for r, (words, tagged) in enumerate(rows):
            free[r, : len(words)] = ~np.array(plain(words))
            gold[r, np.arange(len(words)), [number[t] for t in tagged]] = 1
        moved = np.einsum("rti,rtj->ij", gold[:, :-1], gold[:, 1:])
        ge, gm = np.zeros_like(self.emit), np.zeros_like(self.move)
        for _ in range(rounds):  # full-batch ascent with per-weight steps
            score = np.stack([np.bincount(word, self.emit[feature, k], live.size) for k in range(n)], 1).reshape(*live.shape, n)
            p, pairs = self.expected(score, free, live)
            slope = ((gold - p) * free[..., None]).reshape(-1, n)[word]
            de = np.stack([np.bincount(feature, slope[:, k], len(names)) for k in range(n)], 1) - decay * self.emit
            dm = moved - pairs - decay * self.move
            ge += de * de
            gm += dm * dm
            self.emit += rate * de / (np.sqrt(ge) + 1e-8)
            self.move += rate * dm / (np.sqrt(gm) + 1e-8)

    def known(self, words: list[str], k: int) -> list[int]:
        return [self.names[f] for f in features(words, k) if f in self.names]

    def expected(self, score: np.ndarray, free: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag probabilities (rows, words, tags) and the expected number of moves, by forward and backward sums."""
        score = np.where(free[..., None], score, [0.0] + [OUTSIDE_ONLY] * (len(self.tags) - 1))
        score[:, 0] += [OUTSIDE_ONLY if t[0] == "I" else 0.0 for t in self.tags]
        move, steps = self.move + self.ban, score.shape[1]
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        a, b = np.zeros_like(score), np.zeros_like(score)
        a[:, 0] = score[:, 0]
        for k in range(1, steps):
            a[:, k] = np.where(live[:, k, None], score[:, k] + lse(a[:, k - 1, :, None] + move, 1), a[:, k - 1])
        for k in range(steps - 2, -1, -1):
            b[:, k] = np.where(live[:, k + 1, None], lse(move + (score[:, k + 1] + b[:, k + 1])[:, None], 2), 0.0)
        total = lse(a[:, -1], 1)
        p = np.exp(a + b - total[:, None, None]) * live[..., None]
        pairs = np.zeros_like(move)
        for k in range(1, steps):
            step = np.exp(a[:, k - 1, :, None] + move + (score[:, k] + b[:, k])[:, None] - total[:, None, None])
            pairs += step[live[:, k]].sum(0)
        return p, pairs

    def scores(self, words: list[str], outside: list[bool], begin: int = 0, end: int | None = None) -> np.ndarray:
        """Emission scores (words, tags) of ``words[begin:end]``, with the words around them as context."""
        at = range(begin, len(words) if end is None else end)
        out = np.array([self.emit[self.known(words, k)].sum(0) for k in at])
        for row, k in zip(out, at, strict=True):
            if outside[k]:
                row[:] = OUTSIDE_ONLY
                row[0] = 0.0
        return out

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best tag paths of several chains at once."""
        if not scores:
            return []
        n, longest = len(self.tags), max(len(s) for s in scores)
        order = np.argsort([-len(s) for s in scores], kind="stable")
        x = np.full((len(scores), longest, n), 0.0)
        size = np.array([len(scores[k]) for k in order])
        for r, k in enumerate(order):
            x[r, : len(scores[k])] = scores[k]
        x[:, 0, [t[0] == "I" for t in self.tags]] += OUTSIDE_ONLY
        move, back = self.move + self.ban, np.zeros((len(scores), longest, n), np.int8)
        best = x[:, 0].copy()
        for t in range(1, longest):
            live = np.count_nonzero(size > t)
            step = best[:live, :, None] + move[None]
            back[:live, t] = step.argmax(1)
            best[:live] = step.max(1) + x[:live, t]
        out: list = [None] * len(scores)
        for r, k in enumerate(order):
            path = np.empty(size[r], np.int8)
            path[-1] = best[r].argmax()
            for t in range(size[r] - 1, 0, -1):
                path[t - 1] = back[r, t, path[t]]
            out[k] = path
        return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return Field(labelled_rows())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the patterns, leftmost and non-overlapping within each kind; by start, then kind."""
    found, at = [], text.find("@")
    after = 0
    while at >= 0:  # the leftmost match begins at the first of the characters before an @ that may stand there
        begin = at
        while begin > after and text[begin - 1] in LOCAL:
            begin -= 1
        m = EMAIL.match(text, begin) if begin < at else None
        if m:
            found.append((m.start(), m.end(), "email"))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def stretches(outside: list[bool]) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) of words that are not plain."""
    out, begin = [], None
    for k, o in enumerate([*outside, True]):
        if not o:
            begin = k if begin is None else begin
        elif begin is not None:
            out.append((begin, k))
            begin = None
    return out


#: What a span of a kind looks like, with its obfuscations.
FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+(?:\s?@\s?|\s?[\[(]at[\])]\s?)[A-Za-z0-9-]+(?:(?:\.|[\[(]\.[\])])[A-Za-z0-9-]+)*"),
    "ip": re.compile(r"[0-9]{1,3}(?:(?:\.|[\[(]\.[\])])[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\x20./-]?[0-9])+"),
    "phone": re.compile(r"[+(]?[0-9][\x20().0-9-]*[0-9]"),
}


def kind_form(kind: str, text: str) -> bool:
    """Whether a whole text has the form, and passes the check, of a kind."""
    if not FORMS[kind].fullmatch(text):
        return False
    figures = re.sub(r"[^0-9]", "", text)
    if kind == "phone":  # no dates, quads, decimals or bare numbers
        return 9 <= len(figures) <= 15 and not text.isdigit() and not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*|[0-9]+\.[0-9]+|[0-9]{1,3}(\.[0-9]{1,3}){3}", text)
    if kind == "card":
        return 12 <= len(figures) <= 19 and luhn(figures)
    if kind == "email":  # around a lone sign only a dotted domain tells an address from other words
        return " " not in text or "." in re.split(r"@|[\[(]at[\])]", text)[-1]
    return all(int(p) <= 255 for p in re.findall("[0-9]+", text))


def fitted(kind: str, text: str) -> tuple[int, int] | None:
    """The longest part of a proposed text that has the kind's form; None if there is none."""
    parts = [m.span() for m in FORMS[kind].finditer(text) if kind_form(kind, m[0])]
    return max(parts, key=lambda s: (s[1] - s[0], -s[0]), default=None)


def added_spans(texts: list[str], field: Field | None = None) -> list[list[tuple[int, int, str]]]:
    """Spans of the field for each text, each cut to the part that has its kind's form."""
    field = field or default_field()
    owner, words, scores = [], [], []
    for k, text in enumerate(texts):
        if not ANCHOR.search(text):
            continue  # signs alone are no data
        all_words = list(WORD.finditer(text))
        raw = [m[0] for m in all_words]
        outside = plain(raw)
        for begin, end in stretches(outside):
            piece = field.scores(raw, outside, begin, end)
            piece[0] += (field.move[0] + field.ban[0]) if begin else 0
            piece[-1] += field.move[:, 0] if end < len(raw) else 0
            owner.append(k)
            words.append(all_words[begin:end])
            scores.append(piece)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for k, chain, path in zip(owner, words, field.decode(scores), strict=True):
        at = 0
        while at < len(path):
            name = field.tags[path[at]]
            if name == "O":
                at += 1
                continue
            end = at + 1
            while end < len(path) and field.tags[path[end]] == f"I-{name[2:]}":
                end += 1
            a, b = chain[at].start(), chain[end - 1].end()
            if part := fitted(name[2:], texts[k][a:b]):
                out[k].append((a + part[0], a + part[1], name[2:]))
            at = end
    return out


def merged(base: list, added: list) -> list[tuple[int, int, str]]:
    """All base spans, and those of the field that overlap none of them."""
    spans = base + [s for s in added if not any(s[0] < b[1] and b[0] < s[1] for b in base)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table=None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row.

    The counts are those of the base spans; ``spans`` has all of them.
    """
    held = docs.sparkSession.sparkContext.broadcast(default_field() if table is None else Field(labelled_rows(table)))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                base, added = [base_spans(t) for t in texts], added_spans(texts, held.value)
                every = [merged(x, y) for x, y in zip(base, added, strict=True)]
                counts = [pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(x) for x in every]), pa.array([len(e) - len(x) for e, x in zip(every, base, strict=True)], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in brackets, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(default_field())

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts, out = part.column(1).to_pylist(), []
                for text, added in zip(texts, added_spans(texts, held.value), strict=True):
                    end, parts = 0, []
                    for a, z, kind in merged(base_spans(text), added):
                        if a >= end:
                            parts += [text[end:a], f"[{kind}]"]
                        else:  # spans of two kinds may overlap: nothing of either stays
                            parts += [] if z <= end else [f"[{kind}]"]
                        end = max(end, z)
                    out.append("".join(parts) + text[end:])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
