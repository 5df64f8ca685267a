import itertools
import math
import random

import numpy as np
import pytest

from tesserae.llm import neighbours, quality, urls

TEXTS = [b"", b" \n", b"one", b"The cat sat. The cat sat! A dog? No, 12 dogs & 3 birds...", b"UP Down uP\n\nUP Down uP\nother line", "Über café — 日本 x".encode(), b"# $ ### ab$ $ab a,b;c:d (e) 'f'", b"w " * 100 + b"1 2 3 " * 20 + b"verylongwordthatgoesonandonandon " * 40, b"\x0b a\x0cb\rc"]


def plain(text):
    """The features one by one, as their names say."""
    words = text.split()
    if not words:
        return [0.0] * len(quality.NAMES)
    n, m = len(text), len(words)
    share = lambda allowed: sum(b in allowed for b in text) / n
    digit, upper, lower = (set(range(a, b)) for a, b in ((48, 58), (65, 91), (97, 123)))
    prose, symbol = set(b".,;:?'\"-()"), set(b"!#$%&*+/<=>@[\\]^_`{|}~")
    again = [False] + [a == b for a, b in itertools.pairwise(words)]
    ends = [w[-1] in symbol for w in words]
    alone = [w[-1] in symbol and w[0] in symbol and len(w) <= 3 for w in words]
    second = [len(w) > 1 and w[1] in upper for w in words]
    long_, number = [len(w) > 20 for w in words], [w[0] in digit for w in words]
    counts = [text.count(bytes([b])) / n for b in set(text)]
    lines = text.split(b"\n")

    def worst(flags):
        k = min(len(flags), quality.STRETCH)
        return max(sum(flags[i : i + k]) for i in range(len(flags) - k + 1)) / k

    return [
        math.log1p(n), math.log1p(m), n / m, share(digit), share(upper), share(lower), share(prose), share(symbol), share(set(range(128, 256))), text.count(b"\n") / m,
        len(set(words)) / m**0.9, sum(again) / m, sum(ends) / m, sum(alone) / m, sum(w[-1:] in (b".", b"?", b"!") for w in words) / m, -sum(c * math.log2(c) for c in counts),
        worst(again), worst(ends), worst(alone), worst(second), worst(long_), math.log1p(max(map(len, words))), len(set(lines)) / len(lines), worst(number),
    ]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_features_one_by_one(i):
    assert quality.features(TEXTS[i]) == pytest.approx(plain(TEXTS[i]), abs=1e-12)


def test_a_tree_by_exhaustive_search():
    rng = np.random.default_rng(4)
    for _ in range(30):
        bins = int(rng.integers(1, 9))
        n = rng.integers(0, 30, bins)
        g, h = rng.normal(size=bins) * n, rng.random(bins) * n * 0.25

        def value(a, b):
            return float(np.clip(g[a:b].sum() / (h[a:b].sum() + 1), -4, 4))

        def best(a, b):
            """The cut with the largest gain that leaves both sides enough rows; the first of equal ones."""
            fine = [c for c in range(a + 1, b) if min(n[a:c].sum(), n[c:b].sum()) >= quality.LEAST_ROWS]
            gain = lambda c: g[a:c].sum() ** 2 / (h[a:c].sum() + 1) + g[c:b].sum() ** 2 / (h[c:b].sum() + 1)
            return max(fine, key=lambda c: (round(gain(c), 9), -c)) if fine else None

        cuts = [0, bins]
        if (root := best(0, bins)) is not None:
            cuts = sorted({0, bins, root} | ({best(0, root), best(root, bins)} - {None}))
        wanted = [value(a, b) for a, b in itertools.pairwise(cuts) for _ in range(b - a)]
        assert quality._tree(g, h, n) == pytest.approx(wanted, abs=1e-9)


def test_a_pair_by_exhaustive_search():
    rng = np.random.default_rng(5)
    for _ in range(10):
        g, h = rng.normal(size=(8, 8)), rng.random((8, 8))
        found = {}
        for i, j in itertools.product(range(1, 8), range(1, 8)):
            blocks = [(np.s_[a], np.s_[b]) for a in (slice(0, i), slice(i, 8)) for b in (slice(0, j), slice(j, 8))]
            found[i, j] = sum(g[b].sum() ** 2 / (h[b].sum() + 1) for b in blocks), blocks
        gain, blocks = max(found.values(), key=lambda x: x[0])
        wanted = np.empty((8, 8))
        for b in blocks:
            wanted[b] = np.clip(g[b].sum() / (h[b].sum() + 1), -4, 4)
        values, got = quality._quadrants(g, h)
        assert values == pytest.approx(wanted) and got == pytest.approx(gain - g.sum() ** 2 / (h.sum() + 1))


def test_scores_and_a_round_as_plain_loops(monkeypatch):
    rng = np.random.default_rng(6)
    x, noise = rng.normal(size=(400, 3)), rng.normal(size=400)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * noise > 0).astype(float)
    model = quality.Additive().fit(x, y)
    assert len(model.pairs) == 3
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.base
        place = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        for b, t in zip(place, model.tables, strict=True):
            total += t[b]
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[place[i] * quality.PAIR_BINS // (len(model.edges[i]) + 1)][place[j] * quality.PAIR_BINS // (len(model.edges[j]) + 1)]
        assert got == pytest.approx(1 / (1 + math.exp(-total)))
    monkeypatch.setattr(quality, "ROUNDS", 1)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 0)
    one = quality.Additive().fit(x, y)
    raw = np.full(400, math.log((y.sum() + 1) / (402 - y.sum() - 1)))
    for j in range(3):
        place = [sum(v >= e for e in one.edges[j]) for v in x[:, j]]
        sums = np.zeros((3, len(one.edges[j]) + 1))
        for b, target, score in zip(place, y, raw, strict=True):
            p = 1 / (1 + math.exp(-score))
            sums[:, b] += target - p, p * (1 - p), 1
        step = quality.RATE * quality._tree(*sums)
        assert one.tables[j] == pytest.approx(step)
        raw += step[place]


def test_many_rules_as_a_table(spark, monkeypatch):
    rng = random.Random(7)
    hosts = ["com", "a.com", "b.a.com", "x.b.a.com", "net", "a.net", "", "a..com", "com.", "1.2.3.4"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab/c", "/é/日", "/a/b/c/d/e"]
    rules = [(rng.choice(["allow", "block"]), h + p) for h in hosts for p in paths if p and rng.random() < 0.6]
    rules += [("block", rules[0][1]), ("allow", "b.a.com/a/b"), ("block", "plain.org")]
    rows = [(h, p) for h in [*hosts, "xcom", "y.a.net", "plain.org", "www.plain.org"] for p in [*paths, "/zzz", "//"]] * 2 + [(None, "/a"), ("com", None)]
    df = spark.createDataFrame([(i, h, p, "r") for i, (h, p) in enumerate(rows)], "page_id long, host string, path string, verdict string")
    one = sorted(map(str, urls.ruled(df, rules[:-1]).collect()))
    monkeypatch.setattr(urls, "MOST_RULES", 0)
    assert sorted(map(str, urls.ruled(df, rules[:-1]).collect())) == one
    assert urls.ruled(df, rules).where("rule = 'plain.org'").count() == 2 * 2 * sum(p.startswith("/") for p in [*paths, "/zzz", "//"])
    many = [("block", f"h{i}.org/p{i}/") for i in range(3000)]
    monkeypatch.setattr(urls, "MOST_RULES", 1000)
    got = urls.ruled(df.withColumnRenamed("host", "_h").withColumnRenamed("path", "_p").selectExpr("page_id", "concat('w.h', page_id, '.org') as host", "concat('/p', page_id, '/x') as path"), many)
    assert got.where("rule_verdict = 'block' and rule = concat('h', page_id, '.org/p', page_id, '/')").count() == got.count() == len(rows)


def test_rounds_of_descent_raise_the_recall_of_the_graph(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    nodes = neighbours.coded(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<float>"), "node", "x", 24)
    for name, value in (("K", 12), ("TREES", 2)):
        monkeypatch.setattr(neighbours, name, value)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    truth = {q: set(np.argsort(d[q], kind="stable")[1:13].tolist()) for q in range(1500)}
    recall = {}
    for rounds in (0, 1, 4):
        edges = neighbours.build(nodes, 24, rounds).select("u", "v").collect()
        recall[rounds] = sum(e.v in truth[e.u] for e in edges) / (12 * len(truth))
    print("recall by rounds", recall)
    assert recall[0] < 0.7 and recall[1] > recall[0] + 0.1 and recall[4] > 0.85
