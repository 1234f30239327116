"""Operator 1: personal data by patterns and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The network is trained in numpy on windows of a bounded sample of documents
(`SAMPLE_DOCS`, smallest hash of id and text among those with a place to look at; `SAMPLE_WINDOWS` of one document at most). Its labelled spans are the base spans as
they stand and rewritten ones: seven base spans in ten are written as people disguise or misspell it (`rewrite`: spelled-out
at and dot, brackets, other separators, broken grouping, lines cut within a number), which no pattern matches and which
keeps its label. Between the words of these texts stand ordinary numbers (`ordinary`: dates, times, versions, ranges, prices, book
numbers, measures), labelled outside like all numbers of the text that are no base span.

In a text, overlapping windows are laid over every place with a digit, an at sign or a spelled-out one (`TRIGGER`).
The tag probabilities of all windows over a place are averaged, a window counting less near its edges; the places that are
not surely outside are then decoded together into one path over the text. Base spans always stay; of the path's spans those
that are sure enough (`SURE`), touch no base span and hold what their kind demands (`plausible`) are added.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged, text_of

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 1500
#: Times that a document is rewritten for training.
TIMES = 4
#: Training windows of one document at most, drawn from its whole text.
SAMPLE_WINDOWS = 64
WINDOW, STRIDE = 96, 48
EMBED, HIDDEN = 12, 20
TAGS = 1 + 2 * len(KINDS)
#: Least mean probability of an added span's tags, and the probability from which a place is outside for certain.
SURE, OUTSIDE = 0.4, 0.999

# The base patterns of the contract. Lookbehind and possessive repeats only keep them linear.
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = r"(?i)[0-9@]|\bdot\b|[\[({<] ?at ?[\])}>]"
TRIGGERS = re.compile(TRIGGER)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, failing ones dropped, in order of kind and start."""
    out, last = [], 0
    for m in EMAIL_DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and EMAIL_LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            last = m.end()
    for m in IP.finditer(text) if text.count(".") > 2 else ():
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


_CODES = np.zeros(0x180, np.int64)
for _k, _group in enumerate(["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "@", ".", "+", "-", "_", "%", "(", ")",
                             " ", "\n\r\t", ":;", "/\\", ",", "!?\"'", "=<>[]{}|#$&*~^`"], 2):
    for _c in _group:
        _CODES[ord(_c)] = _k
_CODES[0xC0:] = 1
CODES = int(_CODES.max()) + 2  # 0: anything else; the last: padding


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], 1)


def tags_of(spans, n: int) -> np.ndarray:
    """Tag per code point: 0 outside, 1 + 2k first of kind k, 2 + 2k inside."""
    tags = np.zeros(n, np.int64)
    for kind, start, end in spans:
        if not tags[start:end].any():
            tags[start:end] = 2 + 2 * KINDS.index(kind)
            tags[start] -= 1
    return tags


def windows_of(text: str) -> list[int]:
    """Starts of the windows over the places to look at."""
    cells = {m.start() // STRIDE for m in TRIGGERS.finditer(text)}
    return sorted({max(0, c - k) * STRIDE for c in cells for k in range(WINDOW // STRIDE)})


def rewrite(kind: str, text: str, rng: random.Random) -> str:
    """A span as people disguise or misspell it; of no base pattern's form."""
    if kind == "email":
        name, _, host = text.partition("@")
        at, dot = rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), ("(at)", "."), (" @ ", "."), ("@ ", " . "), ("{at}", "{dot}")])
        return (name.replace(".", dot) if rng.random() < 0.5 else name) + at + host.replace(".", dot)
    if kind == "ip":
        return rng.choice(["[.]", " . ", "-", ",", " dot ", "(.)"]).join(text.split("."))
    digits = _digits(text)
    if kind == "card":
        return rng.choice([".", "/", "  ", " - ", "_", "\n"]).join(digits[k:k + 4] for k in range(0, len(digits), 4))
    head, tail = digits[:-10], digits[-10:]
    body = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{}/{}/{}", "{} {}\n{}"]).format(tail[:3], tail[3:6], tail[6:])
    return rng.choice(["", f"00{head} ", f"+ {head} ", f"tel. {head}."]) + body if len(digits) > 9 else " ".join(digits)


def ordinary(rng: random.Random) -> str:
    """A number as it stands in texts without being personal data."""
    n = rng.randrange
    year, part = 1900 + n(140), lambda k: "".join(str(n(10)) for _ in range(k))
    return rng.choice([
        lambda: f"{year}-{n(1, 13):02}-{n(1, 29):02}", lambda: f"{n(1, 29)}.{n(1, 13)}.{year}", lambda: f"{n(1, 13)}/{n(1, 29)}/{year} {n(24):02}:{n(60):02}:{n(60):02}",
        lambda: f"{n(30)}.{n(30)}.{n(400)}" + rng.choice(["", "-", "-rc", "_"]) + str(n(9)), lambda: rng.choice(["/", " - ", ", "]).join(str(year + k) for k in range(n(2, 6))),
        lambda: rng.choice([", ", " ", "; "]).join(f"{n(3)}.{n(100):02}" for _ in range(n(2, 7))), lambda: rng.choice([" - ", "-", ", "]).join(str(n(1, 900)) for _ in range(n(2, 5))),
        lambda: f"97{n(8, 10)}-{n(10)}-{part(2)}-{part(6)}-{n(10)}", lambda: " ".join(part(3) for _ in range(n(2, 6))), lambda: f"{n(1, 999)},{part(3)},{part(3)}.{part(2)}",
        lambda: f"{n(1, 99)} x {n(1, 99)} x {n(1, 99)} x {n(1, 99)} mm", lambda: part(n(4, 24)), lambda: f"{n(90)}.{part(5)}, -{n(180)}.{part(5)}", lambda: f"{n(1, 99)} at {n(1, 99)}.{n(99)}",
    ])()


def rewritten(text: str, seed: int) -> tuple[str, list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The text with seven base spans in ten rewritten and with an ordinary number before every span in two, the spans in their new
    places, and the rewritten ones among them."""
    rng, out, spans, new, last, size = random.Random(seed), [], [], [], 0, 0
    for kind, a, b in sorted(base_spans(text), key=lambda s: (s[1], -s[2])):
        if a < last:
            continue
        turn = rng.random() < 0.7
        part = rewrite(kind, text[a:b], rng) if turn else text[a:b]
        before = text[last:a]
        if rng.random() < 0.5 and (gap := before.rfind(" ", 0, max(0, len(before) - 8))) >= 0:
            number = ordinary(rng)
            before = before[:gap] + " " + number + before[gap:] if not base_spans(number) else before
        out += [before, part]
        size += len(before)
        spans.append((kind, size, size + len(part)))
        if turn:
            new.append(spans[-1])
        size, last = size + len(part), b
    return "".join([*out, text[last:]]), spans, new


_AT = re.compile(r"@|[\[({<]\s?at\s?[\])}>]|\sat\s", re.IGNORECASE)
_DOT_AND_NAME = re.compile(r"(?:\.|\bdot\b|[\[({<]dot[\])}>])[\s\])}>]*[A-Za-z]{2,}\W*$", re.IGNORECASE)
_DATE = re.compile(r"(?<![0-9])(?:(?:1[89]|2[01])[0-9]{2}[-/. ][01]?[0-9][-/. ][0-3]?[0-9]|[0-3]?[0-9][-/. ][0-3]?[0-9][-/. ](?:1[89]|2[01])[0-9]{2})(?![0-9])")


def plausible(kind: str, text: str) -> bool:
    """Whether a found span has what its kind demands, however it is written: an address its at and a dot before a last name; four
    numbers up to 255 with one separator; 16 to 19 digits passing Luhn in groups with one separator; 8 to 15 digits in at most six
    groups that are no date."""
    groups = re.findall(r"[0-9]+", text)
    between = {re.sub(r"\s", " ", g) for g in re.split(r"[0-9]+", text)[1:-1]}
    n = sum(map(len, groups))
    if kind == "email":
        at = _AT.search(text)
        return at is not None and at.start() > 0 and _DOT_AND_NAME.search(text, at.end()) is not None
    if kind == "ip":
        return len(groups) == 4 and len(between) == 1 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == "card":
        return 16 <= n <= 19 and len(between) <= 1 and luhn("".join(groups))
    return 8 <= n <= 15 and len(groups) <= 6 and not _DATE.search(text) and "," not in text and ":" not in text


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, one LSTM each way, linear tag scores, CRF transitions; windows are (count, WINDOW) code arrays."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        mat = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": mat(CODES, EMBED) * 3, "out": mat(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32),
                  "move": np.zeros((TAGS, TAGS), np.float32)}
        for way in "fb":
            self.p[f"x{way}"], self.p[f"h{way}"] = mat(EMBED, 4 * HIDDEN), mat(HIDDEN, 4 * HIDDEN)
            self.p[f"b{way}"] = np.zeros(4 * HIDDEN, np.float32)
        self.banned = np.zeros((TAGS, TAGS), np.float32)  # inside may only follow first or inside of its kind
        for k in range(len(KINDS)):
            self.banned[:, 2 + 2 * k] = -1e4
            self.banned[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.begin = np.array([0] + [0, -1e4] * len(KINDS), np.float32)

    @classmethod
    def constraints(cls) -> Tagger:
        """A tagger whose transitions allow or forbid and weigh nothing: it decodes averaged probabilities."""
        plain = cls()
        plain.p["move"][:] = 0
        return plain

    def _lstm(self, x: np.ndarray, way: str):
        n, steps = x.shape[:2]
        h = c = np.zeros((n, HIDDEN), np.float32)
        drive = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        kept, out = [None] * steps, np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = drive[:, t] + h @ self.p[f"h{way}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            kept[t] = (h, c, i, f, o, g)
            c = f * c + i * g
            h = o * np.tanh(c)
            out[:, t] = h
        return out, kept

    def emissions(self, codes: np.ndarray):
        x = self.p["embed"][codes]
        (hf, kf), (hb, kb) = self._lstm(x, "f"), self._lstm(x, "b")
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["out"] + self.p["out_b"], (x, h, kf, kb)

    def marginals(self, e: np.ndarray):
        """Tag probabilities per place, pair probabilities summed over places, log partition."""
        move = self.p["move"] + self.banned
        n, steps, _ = e.shape
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + self.begin
        for t in range(1, steps):
            s = alpha[:, t - 1, :, None] + move
            top = s.max(1)
            alpha[:, t] = e[:, t] + top + np.log(np.exp(s - top[:, None]).sum(1))
        for t in range(steps - 2, -1, -1):
            s = move + (e[:, t + 1] + beta[:, t + 1])[:, None]
            top = s.max(2)
            beta[:, t] = top + np.log(np.exp(s - top[:, :, None]).sum(2))
        top = alpha[:, -1].max(1)
        z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))
        one = np.exp(alpha + beta - z[:, None, None])
        return one, alpha, beta, z, move

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        move = self.p["move"] + self.banned
        n, steps, _ = e.shape
        score, back = e[:, 0] + self.begin, np.zeros((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            s = score[:, :, None] + move
            back[t] = s.argmax(1)
            score = s.max(1) + e[:, t]
        path = np.zeros((n, steps), np.int64)
        path[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(n), path[:, t]]
        return path

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        n, steps = codes.shape
        e, (x, h, kf, kb) = self.emissions(codes)
        one, alpha, beta, z, move = self.marginals(e)
        gold = np.zeros_like(one)
        np.put_along_axis(gold, tags[:, :, None], 1, 2)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps):
            pair = np.exp(alpha[:, t - 1, :, None] + move + (e[:, t] + beta[:, t])[:, None] - z[:, None, None])
            g["move"] += pair.sum(0)
            np.add.at(g["move"], (tags[:, t - 1], tags[:, t]), -1)
        de = one - gold
        g["out"], g["out_b"] = np.tensordot(h, de, ((0, 1), (0, 1))), de.sum((0, 1))
        dh_all, dx = de @ self.p["out"].T, np.zeros_like(x)
        for way, kept, part in (("f", kf, slice(0, HIDDEN)), ("b", kb, slice(HIDDEN, None))):
            dh_next = dc = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
                h0, c0, i, f, o, u = kept[t]
                tc = np.tanh(f * c0 + i * u)
                dh = dh_all[:, t, part] + dh_next
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)], axis=1)
                g[f"x{way}"] += x[:, t].T @ dz
                g[f"h{way}"] += h0.T @ dz
                g[f"b{way}"] += dz.sum(0)
                dx[:, t] += dz @ self.p[f"x{way}"].T
                dh_next, dc = dz @ self.p[f"h{way}"].T, dc * f
        np.add.at(g["embed"], codes, dx)
        return {k: v / n for k, v in g.items()}

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int = 600, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Tagger:
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1 if len(codes) else 1):
            rows = rng.integers(0, len(codes), batch)
            for k, v in self.gradients(codes[rows], tags[rows]).items():
                v = np.clip(v, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                self.p[k] -= (rate * min(1, 2 - 2 * t / (steps + 1)) * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return self


def _window(codes: np.ndarray, start: int, pad: int) -> np.ndarray:
    part = codes[start:start + WINDOW]
    return part if len(part) == WINDOW else np.concatenate([part, np.full(WINDOW - len(part), pad)])


def training_windows(text: str, spans: list[tuple[str, int, int]] | None = None, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of the windows of one text (spans: the base spans, if not given); tags of a span that a window cuts are
    inside tags from its first place on, so its first place is made a beginning."""
    codes, tags, starts = codes_of(text), tags_of(base_spans(text) if spans is None else spans, len(text)), windows_of(text)
    starts = sorted(random.Random(seed).sample(starts, SAMPLE_WINDOWS)) if len(starts) > SAMPLE_WINDOWS else starts
    x = [_window(codes, s, CODES - 1) for s in starts]
    y = [_window(tags, s, 0).copy() for s in starts]
    for row in y:
        if row[0] and row[0] % 2 == 0:
            row[0] -= 1
    return np.array(x, np.int64).reshape(-1, WINDOW), np.array(y, np.int64).reshape(-1, WINDOW)


_EDGE = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]


def mean_marginals(texts: list[str], tagger: Tagger, block: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the places that windows cover, in order, and the mean tag probabilities there."""
    codes = [codes_of(t) for t in texts]
    where = [(k, s) for k, text in enumerate(texts) for s in windows_of(text)]
    covered = [np.zeros(len(t), bool) for t in texts]
    for k, s in where:
        covered[k][s:s + WINDOW] = True
    places = [np.flatnonzero(c) for c in covered]
    sums = [np.zeros((len(p), TAGS), np.float32) for p in places]
    for at in range(0, len(where), block):
        part = where[at:at + block]
        one = tagger.marginals(tagger.emissions(np.stack([_window(codes[k], s, CODES - 1) for k, s in part]))[0])[0] * _EDGE
        for row, (k, s) in enumerate(part):
            width = min(WINDOW, len(texts[k]) - s)
            first = int(np.searchsorted(places[k], s))
            sums[k][first:first + width] += one[row, :width]
    return [(p, m / np.maximum(m.sum(1, keepdims=True), 1e-9)) for p, m in zip(places, sums)]


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """What the network adds to the base spans of each text: the spans of one path over the text."""
    found = mean_marginals(texts, tagger)
    stretches = []  # runs of neighbouring places that are not surely outside, padded by nothing: outside borders them
    for k, (places, mean) in enumerate(found):
        open_ = np.flatnonzero(mean[:, 0] < OUTSIDE)
        if len(open_):
            cuts = np.flatnonzero((np.diff(open_) > 1) | (np.diff(places[open_]) > 1)) + 1
            stretches += [(len(run), k, int(run[0])) for run in np.split(open_, cuts)]
    stretches.sort()
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    free = [np.ones(len(t), bool) for t in texts]
    for k, spans in enumerate(base):
        for _, a, b in spans:
            free[k][a:b] = False
    decoder = Tagger.constraints()
    for at in range(0, len(stretches), 256):
        part = stretches[at:at + 256]
        e = np.full((len(part), part[-1][0], TAGS), -30.0, np.float32)
        e[:, :, 0] = 0
        for row, (n, k, first) in enumerate(part):
            e[row, :n] = np.log(np.maximum(found[k][1][first:first + n], 1e-13))
        paths = decoder.viterbi(e)
        for row, (n, k, first) in enumerate(part):
            path, (places, mean) = paths[row], found[k]
            for start in np.flatnonzero(path[:n] % 2 == 1):
                stop = int(start) + 1
                while stop < n and path[stop] == path[start] + 1:
                    stop += 1
                sure = float(np.exp(e[row, np.arange(start, stop), path[start:stop]]).mean())
                a, b = int(places[first + start]), int(places[first + stop - 1]) + 1
                while a < b and texts[k][a].isspace():
                    a += 1
                while a < b and texts[k][b - 1].isspace():
                    b -= 1
                kind = KINDS[(path[start] - 1) // 2]
                if sure >= SURE and a < b and free[k][a:b].all() and plausible(kind, texts[k][a:b]):
                    out[k].append((kind, a, b))
    return [sorted(spans, key=lambda s: s[1]) for spans in out]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_DOCS) -> Tagger:
    sample = (docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
              .where(F.col("text").rlike(TRIGGER)))
    keep = staged(sample.select("id", F.xxhash64("id", "text").alias("h")).orderBy("h", "id").limit(most), "pii-sample")

    def run(batches):
        for batch in batches:
            found = [tuple(map(np.concatenate, zip(*(training_windows(*rewritten(t.as_py(), h.as_py() + k)[:2]) for k in range(TIMES)))))
                     for h, t in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.astype(np.int8).tobytes() for x, _ in found]), pa.array([y.astype(np.int8).tobytes() for _, y in found])],
                names=["h", "x", "y"])

    rows = (sample.withColumn("h", F.xxhash64("id", "text")).join(F.broadcast(keep.select("h").distinct()), "h")  # `most` rows
            .groupBy("h").agg(F.min("text").alias("text")).mapInArrow(run, "h long, x binary, y binary").orderBy("h").toPandas())
    both = [np.frombuffer(b"".join(map(bytes, rows[c])), np.int8).reshape(-1, WINDOW).astype(np.int64) for c in "xy"]
    return Tagger().fit(*both)


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_pii(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points; spans holds base and what the network adds).

    Null text counts as empty and has no spans. Rows are searched one by one, so repeated rows get equal spans and null
    ids pass through; an empty table gives an empty result; extra columns are ignored.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.when(docs[text_col].rlike(TRIGGER), docs[text_col]).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    span = "array<struct<kind:string,start:long,end:long>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                base = [base_spans(t) if t else [] for t in texts]
                new = added_spans(texts, base, tagger)
                rows = [[[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in part] for part in (base, map(list.__add__, base, new))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, arrow) for r in rows)], names=["doc_id", "base", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, base {span}, spans {span}")


def _list(column: str):
    rank = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    ordered = F.array_sort(F.transform(column, lambda s: F.struct(rank[s["kind"]].alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = find_pii(docs, train(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_list("base"), 256).alias("base_sha256"), _list("spans").alias("spans"))


def plain_digest(spans) -> str:
    """Plain form of the digest, for tests."""
    return hashlib.sha256(joined(spans).encode()).hexdigest()
