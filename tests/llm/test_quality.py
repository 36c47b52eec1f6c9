"""Document statistics and boosted trees against plain forms."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from rankloom.llm import quality
from rankloom.llm.textcodes import slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_statistics(text):
    text = text or ""
    raw = text.encode()
    size, kinds = len(raw), {"upper": range(65, 91), "digit": range(48, 58), "space": b" \t", "newline": b"\n\r", "stop": b".,;:?", "bar": b"|", "symbol": b"#$%&*@^~<>{}[]\\_=+", "mark": b"!", "beyond": range(128, 256)}
    share = {k: sum(b in set(v) for b in raw) / max(size, 1) for k, v in kinds.items()}
    found = [(m.group().translate(LOWER), m.group()) for m in WORD.finditer(text.translate(LOWER))]
    starts = [m.start() for m in WORD.finditer(text.translate(LOWER))]
    w = [a for a, _ in found]
    n = max(len(w), 1)
    lines = re.split(r"(?=\n)", text)
    lines = [x for x in lines if x] if size else []
    sets = {tuple(sorted(WORD.findall(x.translate(LOWER)))) for x in lines}
    length = [len(x.encode()) for x in w]
    return [
        math.log1p(size), math.log1p(len(w)), size / n, share["upper"], share["digit"], share["space"], share["newline"], share["stop"], share["bar"], share["symbol"], share["mark"], share["beyond"],
        len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:])) / n, len(set(zip(w, w[1:]))) / n, max(Counter(w).values(), default=0) / n, max(length, default=0), sum(x <= 2 for x in length) / n,
        sum(text[i] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for i in starts) / n, len(w) / max(len(lines), 1), len(sets) / max(len(lines), 1), math.log1p(max((len(x.encode()) for x in lines), default=0)),
    ]


def test_statistics():
    rng = random.Random(7)
    parts = ["Word", "word", "A", "b2", "\n", "\n\n", ".", ", ", "| |", "#x", "!", " ", "\t", "é", "ÀB", "中文", "12", "\r\n", "long" * 9]
    texts = [None, "", "\n", "one", "\none\n", *("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 80))) for _ in range(300))]
    got = np.concatenate([quality.statistics(p) for p in slices(pa.array(texts, pa.string()), 700)])
    want = np.array([plain_statistics(t) for t in texts])
    for j, name in enumerate(quality.NAMES):
        assert np.allclose(got[:, j], want[:, j], atol=1e-12), (name, [(texts[i], got[i, j], want[i, j]) for i in np.flatnonzero(~np.isclose(got[:, j], want[:, j]))[:2]])


def plain_fit(x, y, trees, depth, rate, bins, ridge, least):
    """Boosting one node at a time, each edge of each column tried; returns the scores of the rows."""
    n, k = x.shape
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(k)]
    raw = np.full(n, math.log(y.mean() / (1 - y.mean())))

    def grow(rows, g, h, level):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j in range(k):
                for e in edges[j]:
                    low = rows[x[rows, j] <= e]
                    if least <= len(low) <= len(rows) - least:
                        gl, hl = g[low].sum(), h[low].sum()
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        if gain > best[0] + 1e-12:
                            best = (gain, (j, e))
        if best[1] is None:
            step[rows] = -rate * gs / (hs + ridge)
        else:
            j, e = best[1]
            grow(rows[x[rows, j] <= e], g, h, level + 1)
            grow(rows[x[rows, j] > e], g, h, level + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        step = np.zeros(n)
        grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), 0)
        raw = raw + step
    return 1 / (1 + np.exp(-raw))


def test_trees():
    rng = np.random.default_rng(5)
    for n, bins in ((60, 8), (150, 16)):
        x = np.round(rng.normal(size=(n, 4)), 1)
        y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=n)) > 0.2).astype(float)
        model = quality.fit(x, y, trees=8, depth=3, rate=0.3, bins=bins, least=4.0)
        assert np.allclose(model.score(x), plain_fit(x, y, 8, 3, 0.3, bins, 1.0, 4), atol=1e-9)
        assert len(model.roots) == 8 and ((model.score(x) > 0.5) == (y > 0)).mean() > 0.8
