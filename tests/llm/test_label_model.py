"""The label model with correlated voters, and the linear classifier, against plain loops."""

import math

import numpy as np

from orefolio.llm import toxicity


def plain_model(fired, stated, prior, rounds, linked_from):
    """Row by row and voter by voter; correlations after the sixth, sixteenth, ... round."""
    n, m = len(fired), len(fired[0])
    fires = [sum(row[v] for row in fired) for v in range(m)]
    post = [1 - math.prod(1 - min(max(stated[v], 0), 0.999) for v in range(m) if row[v]) for row in fired]
    alike = [[0.0] * m for _ in range(m)]
    for turn in range(rounds):
        total = sum(post)
        hit = [sum(p for p, row in zip(post, fired) if row[v]) for v in range(m)]
        right = [(hit[v] + toxicity.PRIOR * stated[v]) / (fires[v] + toxicity.PRIOR) for v in range(m)]
        in_toxic = [min((right[v] * fires[v] + 0.01) / (total + 0.02), 0.99) for v in range(m)]
        in_clean = [min(((1 - right[v]) * fires[v] + 0.01) / (n - total + 0.02), 0.99) for v in range(m)]
        if turn % 10 == 5:
            p, q = [hit[v] / total for v in range(m)], [(fires[v] - hit[v]) / (n - total) for v in range(m)]
            rest = [[sum(row[a] * row[b] for row in fired) / n - total / n * p[a] * p[b] - (1 - total / n) * q[a] * q[b] for b in range(m)] for a in range(m)]
            for a in range(m):
                for b in range(m):
                    c = rest[a][b] / math.sqrt(max(rest[a][a], 1e-9) * max(rest[b][b], 1e-9)) if a != b else 0.0
                    alike[a][b] = min(abs(c), 1) if abs(c) > linked_from else 0.0
        post = []
        for row in fired:
            odds = math.log(prior / (1 - prior))
            for v in range(m):
                same = [u for u in range(m) if row[u] == row[v]]  # voters that vote the same share the weight of what links them
                share = 1 / (1 + sum(alike[u][v] for u in same))
                odds += share * (math.log(in_toxic[v] / in_clean[v]) if row[v] else math.log((1 - in_toxic[v]) / (1 - in_clean[v])))
            post.append(1 / (1 + math.exp(-min(max(odds, -30), 30))))
    return post, alike


def votes(seed=0, n=300):
    """Voters 1 and 2 copy voter 0 most of the time; the others are independent."""
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.3
    fired = np.array([[rng.random() < (0.6 if t else 0.05) for _ in range(6)] for t in truth]).astype(int)
    for copy in (1, 2):
        fired[:, copy] = np.where(rng.random(n) < 0.93, fired[:, 0], fired[:, copy])
    return truth, fired


def test_correlated_odds(monkeypatch):
    monkeypatch.setattr(toxicity, "LINKED", 0.4)
    truth, fired = votes()
    stated = np.array([0.8, 0.7, 0.7, 0.8, 0.6, 0.7])
    found = toxicity.label_model(fired, stated, 0.3, 17)
    post, alike = plain_model(fired.tolist(), stated.tolist(), 0.3, 17, 0.4)
    assert np.allclose(found.posterior, post, atol=2e-3)
    assert alike[0][1] > 0.4 and alike[0][2] > 0.4 and alike[0][3] == 0 and found.weight[0] < 0.6 and found.weight[3] == 1
    assert ((found.posterior > 0.5) == truth).mean() > 0.8


def test_votes_overrule_a_lonely_correlated_group(monkeypatch):
    """Three copies of one voter count little more than one when links act, and thrice when they do not."""
    truth, fired = votes(3)
    stated = np.array([0.7] * 6)
    row = np.array([[1, 1, 1, 0, 0, 0]])
    seen = []
    for least in (0.4, 2.0):
        monkeypatch.setattr(toxicity, "LINKED", least)
        seen.append(float(toxicity.label_model(np.vstack([fired, row]), stated, 0.3).posterior[-1]))
    assert seen[0] < seen[1]


def test_linear_fit_is_the_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    target = 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.0, 0.5] - 0.3)))
    ridge = np.array([0.1, 0.2, 0.3, 1.0])
    w, b = toxicity.fit_linear(x, target, ridge)

    def loss(w, b):
        z = x @ w + b
        return float((np.logaddexp(0, z) - target * z).sum() + (ridge * w**2).sum() / 2 + 1e-3 * b * b / 2)

    for k in range(5):
        for step in (1e-3, -1e-3):
            moved = np.append(w, b)
            moved[k] += step
            assert loss(moved[:4], moved[4]) >= loss(w, b) - 1e-9
