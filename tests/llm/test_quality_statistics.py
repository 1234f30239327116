"""Statistics of the quality filter that do not hang on where a passage begins."""

import math
import random
import re

import numpy as np

from orefolio.llm import quality


def test_copies_at_any_distance():
    at = quality.FEATURES.index("lead_copies")
    for length in (30, 31, 32):
        passage = [f"w{k}" for k in range(length)]
        words = passage * 2
        triples = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        found = quality.statistics(" ".join(words).encode())[at]
        assert abs(found - (1 - len(set(triples)) / len(triples))) < 1e-12 and found > 0.4
    assert quality.statistics(b"one two")[at] == 0 and quality.statistics(b"one two three")[at] == 0


CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\v\f", ".,", "!?", "|", "#$%&*", "<>{}[]=/\\_^~`@+", "-'\"();:"]


def plain_statistics(text):
    """Character by character and word by word."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(quality.FEATURES)
    shares = [0] * (len(CLASSES) + 1)
    for b in raw:
        shares[next((k for k, c in enumerate(CLASSES, 1) if b < 128 and chr(b) in c), 0)] += 1
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0d]", x)]
    triples = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    n = max(1, len(words))
    mean = sum(map(len, words)) / n
    ends = sum(w[-1:] not in (b".", b",", b";", b":") and w[-1] < 128 and not chr(w[-1]).isalnum() for w in words)
    return [s / len(raw) for s in shares] + [
        math.log1p(len(raw)), math.log1p(len(words)), mean, len(set(words)) / n, max((words.count(w) for w in set(words)), default=0) / n, math.log1p(len(lines)),
        1 - len(set(lines)) / len(lines) if lines else 0, len(raw) / max(1, len(lines)), sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        sum(len(w) > 1 and w.upper() == w and w.lower() != w for w in words) / n, ends / n, 1 - len(set(triples)) / len(triples) if triples else 0,
        math.sqrt(sum((len(w) - mean) ** 2 for w in words) / n) if words else 0]


def test_statistics_against_loops():
    rng = random.Random(2)
    texts = ["", " \n\t ", "One", "ALL CAPS! a-b; c:\n\nline\nline\n x*** y$$$ 12.5", "ü ß 中文 é.\n" * 5, "same same same same", "\v\f\x1c \x85"]
    texts += ["".join(rng.choice("abcXYZ012 \n\t.,;:!|#<é-'") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    for t in texts:
        assert np.allclose(quality.statistics(t.encode()), plain_statistics(t), atol=1e-12), t


def test_trees_against_walks():
    """Flat arrays walked for all rows at once give what a walk of each row down each tree gives; a sample of one class has no tree."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.8).astype(float)
    model = quality.fit_trees(x, y, rounds=15)
    for row, score in zip(x[:80], model.score(x[:80])):
        total = model.base
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] if row[model.feature[at]] <= model.cut[at] else model.right[at]
            total += model.value[at]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-12
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    for only in (0.0, 1.0):
        one = quality.fit_trees(x, np.full(400, only))
        assert len(one.roots) == 0 and (one.score(x) < 0.01).all() == (only == 0) and (one.score(x) > 0.99).all() == (only == 1)
    assert quality.fit_trees(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 6, (120, 3)).astype(float), rng.integers(0, 2, 120).astype(float)
    model = quality.fit_trees(x, y, rounds=1, depth=1, least=5, ridge=1.0)
    p = y.mean()
    g, h = p - y, np.full(120, p * (1 - p))
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    gains = {(f, c): part(x[:, f] <= c) + part(x[:, f] > c) for f in range(3) for c in range(5) if 5 <= (x[:, f] <= c).sum() <= 115}
    f, c = max(gains, key=gains.get)
    at = model.roots[0]
    assert (x[:, model.feature[at]] <= model.cut[at]).tolist() == (x[:, f] <= c).tolist()
