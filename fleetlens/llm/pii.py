"""Personal data: exact patterns, and a character-level bidirectional LSTM with a CRF that adds what they miss."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from fleetlens.llm.common import extend, quoted

KINDS = ("email", "ip", "card", "phone")
#: Documents drawn for training, and most training windows.
TRAIN_DOCS, TRAIN_WINDOWS = 20_000, 2400
#: Characters of a window and between the starts of two.
WINDOW, STRIDE = 64, 32
EMBED, HIDDEN, EPOCHS, BATCH, RATE = 12, 16, 6, 40, 0.03
#: Least mean lead over 'outside' per character of a span that the model adds.
MARGIN = 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from anywhere within, so only starts of runs are tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: At-signs and dots that are spelled out, in brackets or between blanks, whatever their case.
AT = r"@|[\[({]\s{0,3}at\s{0,3}[\])}]|(?<=\s)at(?=\s)"
DOT = r"\.|[\[({]\s{0,3}dot\s{0,3}[\])}]|(?<=\s)dot(?=\s)"
#: The model reads the surroundings of these. A blank-spaced at needs a dot after the next word, since it is a frequent word of English.
TRIGGER = re.compile(rf"[0-9]|@|[\[({{]\s{{0,3}}at\s{{0,3}}[\])}}]|(?<=\s)at(?=\s{{1,3}}[a-z0-9-]{{1,63}}\s{{0,3}}(?:\.[a-z0-9]|[\[({{]\s{{0,3}}dot\b|(?<=\s)dot\s))", re.I)
MAIL = re.compile(rf"[\w%+-]\s*(?:{AT})\s*[\w-]+\s*(?:{DOT})\s*\w", re.I)
DIGIT = re.compile("[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, found from each @ outwards in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind, of the exact patterns; matches that fail their check are dropped."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                out.append((*m.span(), 1))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# ---- the model ----------------------------------------------------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIGNS = " .@-+()[]_%:/,;'\"\n"
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def _code(ch: str) -> int:
    """0 beyond the text, digits alike, letters by themselves whatever their case, some signs, the rest alike."""
    if "0" <= ch <= "9":
        return 1
    low = ch.lower()
    if low in LETTERS:
        return 2 + LETTERS.index(low)
    return 28 + SIGNS.index(ch) if ch in SIGNS else 28 + len(SIGNS)


CODES = np.array([_code(chr(i)) for i in range(128)] + [28 + len(SIGNS)])
SYMBOLS = 29 + len(SIGNS)


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return CODES[np.minimum(points, 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Embedding, an LSTM in each direction, tag scores, and CRF transitions; gradients written out in numpy."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        h = HIDDEN
        self.p = {"E": draw(SYMBOLS, EMBED), "V": draw(2 * h, TAGS), "c": np.zeros(TAGS, np.float32),
                  "T": np.zeros((TAGS, TAGS), np.float32), "S": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(EMBED, 4 * h), f"U{d}": draw(h, 4 * h), f"b{d}": np.zeros(4 * h, np.float32)}
            self.p[f"b{d}"][h:2 * h] = 1

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """x: time x batch x embedding, in the direction's own order."""
        p, h = self.p, HIDDEN
        pre = x @ p[f"W{d}"] + p[f"b{d}"]
        out, cell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        outs, kept = np.empty((len(x), x.shape[1], h), np.float32), []
        for t in range(len(x)):
            z = pre[t] + out @ p[f"U{d}"]
            gates, new = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
            before, past = cell, out
            cell = gates[:, h:2 * h] * cell + gates[:, :h] * new
            bent = np.tanh(cell)
            out = gates[:, 2 * h:] * bent
            outs[t] = out
            kept.append((gates, new, before, bent, past))
        return outs, kept

    def _lstm_back(self, d: str, x: np.ndarray, kept: list, grad: np.ndarray, g: dict) -> np.ndarray:
        p, h = self.p, HIDDEN
        dx = np.empty_like(x)
        dout, dcell = np.zeros_like(kept[0][4]), np.zeros_like(kept[0][4])
        for t in range(len(x) - 1, -1, -1):
            gates, new, before, bent, past = kept[t]
            dh = grad[t] + dout
            dcell = dcell + dh * gates[:, 2 * h:] * (1 - bent ** 2)
            dz = np.concatenate([dcell * new, dcell * before, dh * bent, dcell * gates[:, :h]], axis=1)
            dz[:, :3 * h] *= gates * (1 - gates)
            dz[:, 3 * h:] *= 1 - new ** 2
            g[f"W{d}"] += x[t].T @ dz
            g[f"U{d}"] += past.T @ dz
            g[f"b{d}"] += dz.sum(0)
            dx[t] = dz @ p[f"W{d}"].T
            dout, dcell = dz @ p[f"U{d}"].T, dcell * gates[:, h:2 * h]
        return dx

    def scores(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """codes: batch x time; returns time x batch x tags."""
        x = self.p["E"][codes.T]
        ahead, kept_f = self._lstm(x, "f")
        back, kept_b = self._lstm(x[::-1], "b")
        both = np.concatenate([ahead, back[::-1]], axis=2)
        return both @ self.p["V"] + self.p["c"], (x, both, kept_f, kept_b)

    def loss(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tag paths, and its gradients."""
        p, (n, length) = self.p, codes.shape
        score, (x, both, kept_f, kept_b) = self.scores(codes)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        add = lambda a: (m := a.max(1, keepdims=True)) + np.log(np.exp(a - m).sum(1, keepdims=True))
        alpha, beta = np.empty_like(score), np.zeros_like(score)
        alpha[0] = score[0] + p["S"]
        for t in range(1, length):
            alpha[t] = score[t] + add(alpha[t - 1][:, :, None] + p["T"])[:, 0]
        for t in range(length - 2, -1, -1):
            beta[t] = add((beta[t + 1] + score[t + 1])[:, :, None] + p["T"].T)[:, 0]
        total = add(alpha[-1][:, :, None])[:, 0]
        expect = np.exp(alpha + beta - total[None])
        rows = np.arange(n)
        gold = (p["S"][tags[:, 0]] + score[0, rows, tags[:, 0]]).astype(np.float64)
        for t in range(1, length):
            gold += p["T"][tags[:, t - 1], tags[:, t]] + score[t, rows, tags[:, t]]
            pair = np.exp(alpha[t - 1][:, :, None] + p["T"] + (beta[t] + score[t])[:, None, :] - total[:, :, None])
            g["T"] += pair.sum(0)
            np.add.at(g["T"], (tags[:, t - 1], tags[:, t]), -1)
        slope = expect
        slope[np.arange(length)[:, None], rows[None], tags.T] -= 1
        g["S"] = slope[0].sum(0)
        flat = slope.reshape(-1, TAGS)
        g["V"], g["c"] = both.reshape(-1, both.shape[2]).T @ flat, flat.sum(0)
        grad = slope @ p["V"].T
        dx = self._lstm_back("f", x, kept_f, grad[:, :, :HIDDEN], g)
        dx = dx + self._lstm_back("b", x[::-1], kept_b, grad[::-1, :, HIDDEN:], g)[::-1]
        np.add.at(g["E"], codes.T, dx)
        return float((total[:, 0] - gold).mean()), {k: v / n for k, v in g.items()}

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Tagger:
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), BATCH):
                rows, step = order[at:at + BATCH], step + 1
                _, grads = self.loss(codes[rows], tags[rows])
                size = np.sqrt(sum(float((x ** 2).sum()) for x in grads.values()))
                for k, x in grads.items():
                    x = x * min(1.0, 5.0 / max(size, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x ** 2
                    self.p[k] = (self.p[k] - RATE * 0.6 ** epoch * (m[k] / (1 - 0.9 ** step))
                                 / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
        return self

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tag path of each window (batch x time), and by how much each tag's score beats 'outside'."""
        score, _ = self.scores(codes)
        best, back = score[0] + self.p["S"], []
        for t in range(1, len(score)):
            step = best[:, :, None] + self.p["T"]
            back.append(step.argmax(1))
            best = step.max(1) + score[t]
        path = [best.argmax(1)]
        for came in reversed(back):
            path.append(came[np.arange(len(came)), path[-1]])
        tags = np.array(path[::-1])
        lead = np.take_along_axis(score, tags[:, :, None], 2)[:, :, 0] - score[:, :, 0]
        return tags.T, lead.T


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows that cover every trigger with room on both sides."""
    starts: list[int] = []
    reach = 0
    for m in TRIGGER.finditer(text):
        low = max(0, m.start() - STRIDE)
        first = low // STRIDE * STRIDE
        for start in range(max(first, reach), m.end(), STRIDE):
            starts.append(start)
            reach = start + STRIDE
    return starts


def cut(codes: np.ndarray, starts: list[int]) -> np.ndarray:
    """The windows as rows, 0 beyond the end of the text."""
    out = np.zeros((len(starts), WINDOW), dtype=np.int64)
    for row, start in zip(out, starts, strict=True):
        part = codes[start:start + WINDOW]
        row[:len(part)] = part
    return out


def spans_of(tags: np.ndarray, lead: np.ndarray, start: int) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, score) of the tagged runs in one window."""
    out, at, n = [], 0, len(tags)
    while at < n:
        tag = int(tags[at])
        if not tag:
            at += 1
            continue
        kind, end = (tag - 1) // 2, at + 1
        while end < n and int(tags[end]) == 2 * kind + 2:
            end += 1
        out.append((start + at, start + end, kind, float(lead[at:end].mean())))
        at = end
    return out


def plausible(kind: int, found: str) -> bool:
    """Whether a span that the model proposes can be of its kind, however it is written."""
    digits = "".join(DIGIT.findall(found))
    if kind == 0:
        return bool(MAIL.search(found))
    if kind == 1:
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(map(_small, parts))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def reconciled(found: list[tuple[int, int, int, float]], text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """One set of spans for a document from those of its overlapping windows.

    Spans of one kind that overlap are parts of the same one. Of what then overlaps,
    and stays clear of the exact spans, the set with the highest total score wins.
    """
    whole: list[list] = []
    for a, b, kind, score in sorted(found, key=lambda s: (s[2], s[0], s[1])):
        if whole and whole[-1][2] == kind and a < whole[-1][1]:
            whole[-1][1], whole[-1][3] = max(whole[-1][1], b), max(whole[-1][3], score)
        else:
            whole.append([a, b, kind, score])
    taken = sorted((a, b) for a, b, _ in base)
    pool, at = [], 0
    for a, b, kind, score in sorted(whole):
        b = min(b, len(text))
        while a < b and text[a].isspace():
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:!?"):
            b -= 1
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if score >= MARGIN and plausible(kind, text[a:b]) and not any(x < b and a < y for x, y in taken[at:at + 2]):
            pool.append((a, b, kind, score * (b - a)))
    pool.sort(key=lambda s: s[1])
    best: list[tuple[float, list]] = [(0.0, [])]
    ends = [0]
    for a, b, kind, score in pool:
        left = int(np.searchsorted(ends, a, side="right")) - 1
        take = best[left][0] + score
        best.append((take, (left, (a, b, kind))) if take > best[-1][0] else (best[-1][0], (len(best) - 1, None)))
        ends.append(b)
    out, here = [], len(best) - 1
    while here:
        here, span = best[here][1]
        if span:
            out.append(span)
    return out[::-1]


# ---- training data ------------------------------------------------------------------------------------------------

def variants(kind: int, found: str, rng: np.random.Generator) -> str:
    """Another way to write a span of a kind: what the exact patterns leave out."""
    digits = "".join(c for c in found if c.isdigit())
    if kind == 0:
        local, _, domain = found.partition("@")
        sign = (" [at] ", "(at)", " (AT) ", " [ at ] ", " at ")[int(rng.integers(5))]
        if rng.random() < 0.4:
            domain = domain.replace(".", " dot " if sign == " at " or rng.random() < 0.5 else " [dot] ")
        return f"{local}{sign}{domain}"
    if kind == 3:
        area, rest = digits[-10:-7], digits[-7:]
        return (f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}", f"00{digits[:2]} {area} {rest}")[int(rng.integers(3))]
    if kind == 2:
        return ".".join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return found.replace(".", " . ")


def training_windows(texts: list[str], limit: int = TRAIN_WINDOWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(codes, tags) of windows around the exact spans of some texts, of variants put in their place, and of other triggers."""
    rng = np.random.default_rng(seed)
    made: list[tuple[str, list[tuple[int, int, int]]]] = []
    for text in texts:
        base = base_spans(text)
        for a, b, kind in base[:8]:
            if b - a > WINDOW - 8:
                continue
            low = max(0, a - int(rng.integers(4, WINDOW - (b - a) - 2)))
            piece = text[low:low + WINDOW]
            made.append((piece, [(x - low, y - low, k) for x, y, k in base if x < low + WINDOW and y > low]))
            for _ in range(3 if kind == 0 else 1):  # mail addresses have the most spellings
                other = variants(kind, text[a:b], rng)
                room = int(rng.integers(1, 41))
                changed = text[max(0, a - room):a] + other + text[b:b + 40]
                at = min(a, room)
                made.append((changed[:WINDOW], [(at, at + len(other), kind)]))
        clear = [m.start() for m in TRIGGER.finditer(text) if not any(a - 40 < m.start() < b + 40 for a, b, _ in base)]
        for start in clear[:2]:
            low = max(0, start - int(rng.integers(4, WINDOW - 4)))
            made.append((text[low:low + WINDOW], []))
    order = rng.permutation(len(made))[:limit]
    codes, tags = np.zeros((len(order), WINDOW), np.int64), np.zeros((len(order), WINDOW), np.int64)
    for row, i in enumerate(order):
        piece, spans = made[i]
        codes[row, :len(piece)] = encode(piece)
        for a, b, kind in spans:
            tags[row, max(a, 0):b] = 2 * kind + 2
            if 0 <= a < WINDOW:
                tags[row, a] = 2 * kind + 1
    return codes, tags


def fit(docs: DataFrame, text: str = "text", rows: int = TRAIN_DOCS) -> Tagger | None:
    """A tagger trained on windows of about `rows` documents drawn by a hash; None when they hold no span to learn from.

    The labels are the spans of the exact patterns and other spellings of them put
    into the same places, so nothing has to be labelled by hand.
    """
    total = docs.count()
    drawn = docs.select(quoted(text).alias("text")).where(
        (F.pmod(F.xxhash64(F.lit(9), "text"), F.lit(2 ** 20)) < int(2 ** 20 * min(1.0, rows / max(total, 1)))) & F.col("text").rlike("[0-9@]"))

    def make():
        def around(batch: pa.RecordBatch) -> list:
            """Only the surroundings of triggers are sent: about 2,000 characters of a document, drawn from all of it."""
            out = []
            for value in batch.column("text"):
                body, parts, reach = value.as_py(), [], 0
                for m in TRIGGER.finditer(body):
                    low, high = max(reach, m.start() - WINDOW), m.end() + WINDOW
                    if high > low:
                        parts.append((low, high))
                        reach = high
                drawn, left = [], 2000
                for i in np.random.default_rng(len(body)).permutation(len(parts)):
                    if left <= 0:
                        break
                    drawn.append(parts[i])
                    left -= parts[i][1] - parts[i][0]
                out.append("".join(body[low:high] for low, high in sorted(drawn)))
            return [out]

        return around

    texts = sorted(extend(drawn, [StructField("near", StringType())], make, []).toArrow().column("near").to_pylist())
    codes, tags = training_windows(texts)
    return Tagger().fit(codes, tags) if len(codes) and tags.any() else None


SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def find_pii(docs: DataFrame, tagger: Tagger | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with base_spans (exact patterns) and spans (those and the model's), arrays of (kind, start, end).

    Positions are code points, ends exclusive, order is by start, then kind as in
    KINDS. The model reads the overlapping windows around every digit and at-sign,
    written or spelled out, of the whole text; nothing else is taken for a span. Null and empty texts have no spans;
    without a tagger both arrays are equal; repeated rows repeat their result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(None if tagger is None else tagger.p)

    def make():
        model = None
        if sent.value is not None:
            model = Tagger()
            model.p = sent.value

        def run(batch: pa.RecordBatch) -> list:
            texts = [v.as_py() or "" for v in batch.column(text)]
            base = [base_spans(t) for t in texts]
            more: list[list] = [[] for _ in texts]
            if model is not None:
                todo = [(i, starts) for i, t in enumerate(texts) if (starts := windows(t))]
                owners = [(i, s) for i, starts in todo for s in starts]
                for at in range(0, len(owners), 4096):
                    part = owners[at:at + 4096]
                    rows = np.concatenate([cut(encode(texts[i][s:s + WINDOW]), [0]) for i, s in part])
                    tags, lead = model.decode(rows)
                    for k in np.flatnonzero(tags.any(axis=1)):
                        i, s = part[k]
                        more[i] += spans_of(tags[k], lead[k], s)
            named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans]
            whole = [sorted(b + reconciled(m, t, b), key=lambda s: (s[0], s[2], s[1])) if m else b
                     for t, b, m in zip(texts, base, more, strict=True)]
            return [[named(b) for b in base], [named(w) for w in whole]]

        return run

    return extend(docs, [StructField("base_spans", ArrayType(SPAN)), StructField("spans", ArrayType(SPAN))], make, keep)
