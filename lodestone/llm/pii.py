"""Personal data by fixed patterns and a semi-Markov conditional random field.

The four base kinds are patterns with a check; their spans always stay. Beyond them a semi-Markov CRF
looks at islands: chains of tokens that hold a digit or '@' (with what belongs to a key between: '/', '+' and '='), up to four capitalised words behind a short number,
as in street addresses, and what follows a cue: the value behind a word for a secret and ':' or '=', capitalised words behind a title or a word
that announces a name. In an island every span of up to
``MOST`` tokens is a candidate of each type, scored as a whole (does the span look like an address,
do its digits pass Luhn, do its letters and digits pass the check of an account number, how are they grouped, what stands before it), a token outside spans is a
segment of its own, and dynamic programming over entity spans of bounded length picks boundaries and
types together. Other tokens can't be part of an entity, so islands are independent and
the result is that of the whole text. Names without a cue, and street addresses without a number in front, aren't looked for.

The CRF is trained here, on the driver, by stochastic gradient steps on the exact log-likelihood over
sentences drawn from a seeded generator; its weights are a few dozen numbers.

Defined results: null and empty texts have no spans; texts are read whole; equal rows get equal
results; a span of the CRF that overlaps a base span is dropped; other columns pass through, and one named like a new
column, in any case, is kept under its name with underscores.
"""

from __future__ import annotations

import functools
import math
import random
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import set_aside

KINDS = ["email", "ip", "card", "phone", "secret", "iban", "name", "address"]
#: Tokens of an entity at most.
MOST = 9
# The base patterns. Lookbehind and possessive forms only save time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

_CORE = _LOCAL | {"@"}
_MARK = re.compile("[0-9@]")
_RUN = re.compile(r"[A-Za-z0-9_%@+.-]*")
_GAP = re.compile(r"[ ()/-]{1,3}(?=[A-Za-z_%+.-]{0,40}[0-9@])")
_HINT = re.compile(r"(token|key|secret|passw|api|auth|credential)[a-z_]*[\"' ]*[=: ]*[\"' ]*$", re.IGNORECASE)
#: What may hold a key together: runs of base64 with a sign of it, of at least this length.
_KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+_-]*[/+])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
_VALUE = re.compile(r"(?:token|key|secret|passw(?:or)?d|passphrase|credentials?)[\"' ]{0,3}[:=][\"' ]{0,3}([^\s\"'<>,;]{8,64})", re.IGNORECASE)
#: A capitalised word, and what announces a name or belongs to a street.
_CAPITAL = r"[A-Z\u00C0-\u00DE][a-z\u00DF-\u00FF]+(?:[-'][A-Z\u00C0-\u00DE][a-z\u00DF-\u00FF]+)*"
_NAME = re.compile(rf"(?:\b(?:Mr|Mrs|Ms|Dr|Prof)\.?|\b(?:[Nn]ame(?: is)?|[Cc]ontact|[Aa]ttn|[Ss]igned(?: by)?|[Ss]incerely|[Rr]egards)[:,]?) ((?:{_CAPITAL}|[A-Z]\.)(?: (?:{_CAPITAL}|[A-Z]\.)){{0,3}})")
_STREET = re.compile(rf"(?<![0-9A-Za-z.,+/-])([0-9]{{1,5}}[A-Za-z]?) ({_CAPITAL}(?: {_CAPITAL}){{0,3}})")
#: Words of streets.
_ROADS = frozenset("Street St Road Rd Avenue Ave Lane Ln Drive Dr Boulevard Blvd Court Ct Place Square Way Terrace Close Crescent".split())
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? $")
_CALL = re.compile(r"(phone|tel|call|fax|mobile|dial|whatsapp)[a-z.]*[ :]*\(?$", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, ascending."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)  # the next local part starts after this '@'
        at = text.find("@", done)
    if not _MARK.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def _words(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    return [(m.start() + begin, m.end() + begin) for m in re.finditer(r"\S+", text[begin:end])]


def islands(text: str) -> list[list[tuple[int, int]]]:
    """All islands, in order; a cue's island takes the place of those that it meets."""
    cued = [[m.span()] for m in _KEY.finditer(text)] if "/" in text or "+" in text else []
    if "=" in text or ":" in text:
        for m in _VALUE.finditer(text):
            a, b = m.span(1)
            while b > a and text[b - 1] in ".:!?)":
                b -= 1
            if b - a >= 8:
                cued.append([(a, b)])
    cued += [_words(text, *m.span(1)) for m in _NAME.finditer(text)]
    cued += [[m.span(1), *_words(text, *m.span(2))] for m in _STREET.finditer(text)]
    plain = marked(text)
    if not cued:
        return plain
    kept: list[list[tuple[int, int]]] = []
    for island in sorted(cued, key=lambda x: (x[0][0], -x[-1][1])):  # of cues that meet, the first
        if not kept or island[0][0] >= kept[-1][-1][1]:
            kept.append(island)
    starts = [x[0][0] for x in kept]
    for island in plain:
        at = bisect_left(starts, island[-1][1])
        if not at or kept[at - 1][-1][1] <= island[0][0]:
            kept.insert(at, island)
            starts.insert(at, island[0][0])
        elif any(a < kept[at - 1][0][0] or b > kept[at - 1][-1][1] for a, b in island):
            # a longer chain keeps what lies outside the cue's island
            a0, b0 = kept[at - 1][0][0], kept[at - 1][-1][1]
            for rest in ([t for t in island if t[1] <= a0], [t for t in island if t[0] >= b0]):
                if rest:
                    place = bisect_left(starts, rest[0][0])
                    if (not place or kept[place - 1][-1][1] <= rest[0][0]) and (place == len(kept) or kept[place][0][0] >= rest[-1][1]):
                        kept.insert(place, rest)
                        starts.insert(place, rest[0][0])
    return kept


def marked(text: str) -> list[list[tuple[int, int]]]:
    """Chains of token spans that hold a digit or '@', with gaps of up to three joining characters."""
    out: list[list[tuple[int, int]]] = []
    at, last = 0, -1
    while m := _MARK.search(text, at):
        begin = m.start()
        while begin > at and text[begin - 1] in _CORE:
            begin -= 1
        end = at = _RUN.match(text, m.start()).end()
        while end > begin and text[end - 1] in ".-_%+":
            end -= 1
        gap = text[last:begin] if last >= 0 else ""
        if last >= 0 and 0 < len(gap) <= 3 and not gap.strip(" ()/-"):
            out[-1].append((begin, end))
        else:
            out.append([(begin, end)])
        last = end
    return out


#: Names of the whole-span features, in the order of ``features``.
FEATURES = ["one", "email", "mail_broken", "ip", "ip_bad", "luhn", "card_length", "grouped_4", "phone_length", "plus", "paren", "phone_groups", "hex_long", "mixed_long", "long_token", "hint", "call", "tokens", "has_letters", "few_digits", "date", "at", "iban", "key_signs", "value", "odd_value", "capitals", "title", "name_cue", "road", "number_first"]


def iban(s: str) -> bool:
    """Whether letters and digits pass the check of an international account number."""
    s = re.sub("[ -]", "", s)
    return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: list[tuple[int, int]]) -> np.ndarray:
    begin, end = span[0][0], span[-1][1]
    s = text[begin:end]
    d = _digits(s)
    letters = sum(c.isalpha() for c in s)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    parts = s.split(".")
    ip = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    ip_ok = ip and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    mail = bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s))
    one = len(span) == 1
    before = text[max(0, begin - 24) : begin]
    hexed = one and len(s) >= 24 and bool(re.fullmatch("[0-9a-fA-F]+", s)) and letters > 0
    kinds = (any(c.islower() for c in s), any(c.isupper() for c in s), bool(d), any(not c.isalnum() for c in s))
    value = one and bool(re.search(r"[:=][\"' ]{0,3}$", before)) and bool(_HINT.search(before))
    words = [text[a:b] for a, b in span]
    capital = not d and all(re.fullmatch(rf"{_CAPITAL}|[A-Z]\.", w) for w in words)
    titled = bool(_TITLE.search(before))
    numbered = len(words) > 1 and bool(re.fullmatch("[0-9]{1,5}[A-Za-z]?", words[0])) and all(re.fullmatch(_CAPITAL, w) for w in words[1:])
    mixed = one and len(s) >= 16 and letters >= 4 and len(d) >= 3 and "@" not in s and "." not in s
    return np.array([
        1, mail, "@" in s and not mail, ip_ok, ip and not ip_ok, not letters and 14 <= len(d) <= 19 and luhn(d), not letters and 14 <= len(d) <= 19,
        not letters and len(groups) >= 3 and set(groups[:3]) == {4}, not letters and 10 <= len(d) <= 13, s.startswith("+") and not letters, before.endswith("("),
        not letters and 2 <= len(groups) <= 5 and groups[-1] in (3, 4) and all(1 <= g <= 4 for g in groups) and not ip, hexed, mixed, one and len(s) >= 24, bool(_HINT.search(before)), bool(_CALL.search(before)),
        min(len(span), MOST) / 4, letters > 0, len(d) < 8, bool(re.fullmatch(r"\d{1,4}[-/. ]\d{1,2}[-/. ]\d{1,4}", s)), "@" in s,
        iban(s), one and bool(_KEY.fullmatch(s)) and all(kinds[:3]), value, value and sum(kinds) >= 3, capital, capital and titled, capital and not titled and bool(re.search(r"(?:[Nn]ame(?: is)?|[Cc]ontact|[Aa]ttn|[Ss]igned(?: by)?|[Ss]incerely|[Rr]egards)[:,]? $", before)), numbered and words[-1] in _ROADS, numbered,
    ], float)


def _candidates(text: str, island: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    n = len(island)
    return {(i, j): features(text, island[i:j]) for i in range(n) for j in range(i + 1, min(n, i + MOST) + 1)}


class SemiCRF:
    """Segments are entity spans of a type, scored by whole-span features, and single outside tokens, scored 0."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def viterbi(self, text: str, island: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(first token, end token, type) of the best segmentation's entities."""
        n, scores = len(island), {}
        best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for j in range(1, n + 1):
            best[j], back[j] = best[j - 1], (j - 1, -1)
            for i in range(max(0, j - MOST), j):
                s = self.weights @ features(text, island[i:j])
                k = int(np.argmax(s))
                if best[i] + s[k] > best[j]:
                    best[j], back[j] = best[i] + s[k], (i, k)
        out, j = [], n
        while j:
            i, k = back[j]
            if k >= 0:
                out.append((i, j, k))
            j = i
        return out[::-1]

    def gradient(self, cand: dict, n: int, gold: list[tuple[int, int, int]]) -> tuple[float, np.ndarray]:
        """Log-likelihood of the gold segmentation and its gradient, by the semi-Markov forward-backward sums."""
        score = {ij: self.weights @ f for ij, f in cand.items()}
        fwd, bwd = np.full(n + 1, -math.inf), np.full(n + 1, -math.inf)
        fwd[0] = bwd[n] = 0
        for j in range(1, n + 1):
            fwd[j] = np.logaddexp.reduce([fwd[j - 1], *(x for i in range(max(0, j - MOST), j) for x in fwd[i] + score[i, j])])
        for i in range(n - 1, -1, -1):
            bwd[i] = np.logaddexp.reduce([bwd[i + 1], *(x for j in range(i + 1, min(n, i + MOST) + 1) for x in bwd[j] + score[i, j])])
        grad, value = np.zeros_like(self.weights), -fwd[n]
        for i, j, k in gold:
            value += score[i, j][k]
            grad[k] += cand[i, j]
        for (i, j), f in cand.items():
            grad -= np.outer(np.exp(fwd[i] + score[i, j] + bwd[j] - fwd[n]), f)
        return value, grad


def _sentence(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up sentence and its entities (start, end, type)."""
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randrange(2, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        d = r.choice("3456") + num(r.choice((13, 14, 14, 14)))
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if r.random() < 0.5 else r.choice(" -").join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"+{r.randrange(1, 99)} {a} {b} {c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}"))

    cap = lambda: word().capitalize()
    b64 = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789/+") for _ in range(n))

    def account():
        land, own = r.choice(("DE", "FR", "GB", "NL", "XK")), "".join(r.choice("0123456789" if r.random() < 0.8 else "ABCDEFGHKLMN") for _ in range(r.randrange(12, 24)))
        check = 98 - int("".join(str(int(c, 36)) for c in own + land + "00")) % 97
        whole = f"{land}{check:02d}{own}"
        return whole if r.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def secret():
        kind = r.random()
        if kind < 0.6:
            return "".join(r.choice(r.choice(("0123456789abcdef", "0123456789abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"))) for _ in range(r.choice((24, 32, 40, 48))))
        if kind < 0.8:
            a, b = r.sample(range(4, 30), 2)
            key = list(b64(r.choice((36, 40, 44))))
            key[a], key[b] = "/", "7"
            return "x" + "".join(key) + "Q"
        return cap() + r.choice("!#-_$") + word() + r.choice("!?*%") + cap()

    make = [
        lambda: f"{word()}.{num(2)}@{word()}{num(1)}.{r.choice(('com', 'org', 'net', 'co.uk'))}" if r.random() < 0.5 else f"{word()}@{word()}.{word()}.com",
        lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        card,
        phone,
        secret,
        account,
        lambda: " ".join(cap() if r.random() < 0.8 else r.choice("ABCDEFGH") + "." for _ in range(r.randrange(1, 3))) + " " + cap(),
        lambda: f"{r.randrange(1, 900)}{r.choice(('', '', 'b'))} {' '.join(cap() for _ in range(r.randrange(1, 3)))} {r.choice(sorted(_ROADS))}",
    ]
    plain = [lambda: str(r.randrange(1, 3000)), lambda: f"{r.randrange(10)}.{r.randrange(20)}", lambda: f"{r.randrange(10)}.{r.randrange(9)}.{r.randrange(30)}", lambda: f"{r.randrange(1990, 2030)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", lambda: f"{r.randrange(1, 29)}/{r.randrange(1, 13)}/{r.randrange(1990, 2030)}", lambda: f"{num(r.choice((5, 6, 7, 8, 9)))}", lambda: f"{word()}{num(r.choice((1, 2, 3)))}", lambda: f"{r.randrange(300, 999)}.{r.randrange(999)}.{r.randrange(999)}.{r.randrange(999)}", lambda: num(r.choice((16, 18, 20, 24))), lambda: f"@{word()}", lambda: f"{num(2)} {num(2)} {num(2)}", lambda: f"{num(1)},{num(3)}", lambda: f"{r.randrange(1, 40)} {cap()}", lambda: f"{r.randrange(1, 40)} {cap()} {cap()}", lambda: f"password: {word()}{word()}xyz", lambda: f"key = {word()}{word()}abc", lambda: f"{word()}/{word()}/{word()}{num(2)}/{word()}.{word()}", lambda: f"{r.choice(('DE', 'FR'))}{num(2)} {num(4)} {num(4)} {num(4)}", lambda: f"{cap()} {cap()}"]
    text, gold = word(), []
    for _ in range(r.randrange(1, 4)):
        k = r.randrange(len(make))
        if r.random() < 0.5:
            text += f" {word()} {r.choice(plain)()}{r.choice((' ', ', ', '. '))}{word()}"
            continue
        lead = {3: ("call ", "tel: ", "", ""), 4: ('token = "', "api_key: ", "secret=", "password: "), 6: ("Mr. ", "Dr ", "Mrs. ", "Name: ", "contact ", "signed by ", "Attn: ")}.get(k, ("", word() + " "))
        text += f" {r.choice(lead)}"
        found = make[k]()
        gold.append((len(text) + (found[0] == "("), len(text) + len(found), k))
        text += f"{found} {word()}"
    return text, gold


@functools.cache
def train(sentences: int = 700, rounds: int = 6, seed: int = 11) -> SemiCRF:
    """Stochastic gradient ascent (AdaGrad) with a small L2 penalty; ``sentences`` bounds the made-up sample."""
    r = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, gold = _sentence(r)
        for island in islands(text):
            at = {a: i for i, (a, _) in enumerate(island)}
            ends = {b: i + 1 for i, (_, b) in enumerate(island)}
            data.append((_candidates(text, island), len(island), [(at[a], ends[b], k) for a, b, k in gold if a in at and b in ends]))
    crf = SemiCRF(np.zeros((len(KINDS), len(FEATURES))))
    crf.weights[:, 0] = -2
    square = np.full_like(crf.weights, 1e-2)
    for _ in range(rounds):
        r.shuffle(data)
        for cand, n, gold in data:
            _, grad = crf.gradient(cand, n, gold)
            grad -= 1e-4 * crf.weights
            square += grad * grad
            crf.weights += 0.5 * grad / np.sqrt(square)
    return crf


def all_spans(text: str | None, crf: SemiCRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, as (start, kind, end)."""
    if not text:
        return [], []
    base = base_spans(text)
    more, starts, furthest = [], [x for x, _, _ in base], list(accumulate((y for *_, y in base), max))
    for island in islands(text):
        for i, j, k in crf.viterbi(text, island):
            a, b = island[i][0], island[j - 1][1]
            before = bisect_left(starts, b)
            if not before or furthest[before - 1] <= a:
                more.append((a, k, b))
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_email, n_ip, n_card, n_phone, base_spans and spans (kind:start:end, code points, end exclusive)."""
    weights = train().weights
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"]
    df = set_aside(df, *names)
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in names), *(T.StructField(c, T.LongType() if c[0] == "n" else T.StringType()) for c in names)])

    def run(batches):
        crf = SemiCRF(weights)
        for batch in batches:
            rows = []
            for t in batch.column(text).to_pylist():
                base, spans = all_spans(t, crf)
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(4)), joined(base), joined(spans)))
            kept = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(6))], [*kept, *names])

    return df.mapInArrow(run, schema)
