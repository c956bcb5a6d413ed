"""Leximin, packing, mixing and stuffing on small cases and against brute force."""

import collections
import random

import numpy as np
import pytest

from kelpline.llm import leximin, mixing, packing, stuffing, tokens

SCORES = ["a", "b"]


def brute_leximin(rows):
    best = {}
    for q, i, a, b, _ in rows:
        if q is not None and i is not None:
            old = best.get((q, i), (None, None))
            best[(q, i)] = tuple(max([x for x in (o, n) if x is not None and x == x], default=None) for o, n in zip(old, (a, b)))
    out = {}
    for q in {q for q, _ in best}:
        items = [i for p, i in best if p == q]
        ps = {i: [] for i in items}
        for k in range(2):
            vs = [best[(q, i)][k] for i in items if best[(q, i)][k] is not None]
            for i in items:
                v = best[(q, i)][k]
                if v is None:
                    ps[i].append(None)
                elif len(vs) == 1:
                    ps[i].append(0.5)
                else:
                    ps[i].append((sum(x < v for x in vs) + (sum(x == v for x in vs) - 1) / 2) / (len(vs) - 1))
        for i in items:
            known = [p for p in ps[i] if p is not None]
            mean = sum(known) / len(known) if known else 0.5
            out[(q, i)] = sorted(round(mean if p is None else p, 9) for p in ps[i])
    return out


@pytest.mark.parametrize("blocks,hot_rows", [(2, 0), (64, 60), (64, 500_000)])
def test_leximin_matches_brute_force(spark, blocks, hot_rows):
    r = random.Random(5)
    rows = [(r.choice([1, 2, None]), f"i{r.randrange(40)}", r.choice([None, float("nan"), r.random(), 3.0]), r.choice([None, r.random() * 1e9, -7.0]), "x") for _ in range(150)]
    rows += rows[:20] + [(9, "alone", None, 1.0, None)]
    df = spark.createDataFrame(rows, "query_id bigint, item string, a double, b double, key string")
    ranked = leximin.leximin(df, "query_id", "item", SCORES, blocks, hot_rows)
    got = {(x.q, x.item): list(x.key) for x in ranked.collect()}
    want = brute_leximin(rows)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    top = leximin.top_k(ranked, 3).collect()
    for q in {k[0] for k in want}:
        order = sorted((k for k in want if k[0] == q), key=lambda k: ([-x for x in want[k]], k[1]))[:3]
        assert [k[1] for k in order] == [x.item for x in sorted((t for t in top if t.q == q), key=lambda t: t.rank)]
    ranks = {(x.q, x.item): x.rank for x in leximin.ranked(ranked).collect()}
    for q in {k[0] for k in want}:
        order = sorted((k for k in want if k[0] == q), key=lambda k: ([-x for x in want[k]], k[1]))
        assert [ranks[k] for k in order] == list(range(1, len(order) + 1))
    assert leximin.ranked(leximin.leximin(df.limit(0), "query_id", "item", SCORES)).count() == 0


def test_nnls_and_fit():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    x = packing.nnls(a, a @ np.array([2.0, 0, 3]))
    assert np.allclose(a @ x, [5, 3]) and (x >= 0).all()
    tops = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100]
    hist = {j: 50 + 7 * j for j in range(10)}
    used = np.zeros(10)
    for counts, n in packing.fit(hist, tops, 100):
        used += counts * n
        assert sum(c * t for c, t in zip(counts, tops)) <= 100
    assert (used <= [hist[j] for j in range(10)]).all() and used.sum() > 100


@pytest.mark.parametrize("capacity", [100, 512])
def test_pack_keeps_everything(spark, capacity):
    r = random.Random(1)
    rows = [(i, int(r.lognormvariate(4.5, 1))) for i in range(3000)] + [(5000, 0), (5001, capacity), (5002, 3 * capacity + 7), (5003, 1)]
    out = packing.pack(spark.createDataFrame(rows + rows[:3], "item_id bigint, n_tokens bigint"), capacity).collect()
    per_item, per_container = collections.defaultdict(list), collections.Counter()
    for x in out:
        per_item[x.item_id].append(x)
        if x.container is not None:
            per_container[x.container] += x["size"]
    assert max(per_container.values()) <= capacity
    for i, n in rows:
        pieces = sorted(per_item[i], key=lambda x: x.piece)
        assert sum(x["size"] for x in pieces) == n and (len(pieces) == 1 or n > capacity)
        assert all(a.start + a["size"] == b.start for a, b in zip(pieces, pieces[1:]))
    assert sum(n for _, n in rows) / (len(per_container) * capacity) > 0.95
    patterned = sum(x["size"] for x in out if (x.container or "").startswith("p"))
    assert patterned > 0.5 * sum(n % capacity for _, n in rows)
    assert packing.pack(spark.createDataFrame([], "item_id bigint, n_tokens bigint"), capacity).count() == 0


def test_temperature():
    s = [0.7, 0.2, 0.1]
    e = mixing.exponent_for_entropy(s, 1.0)
    assert mixing.entropy(mixing.temper(s, e)) == pytest.approx(1.0, abs=1e-6)
    assert mixing.temper(s, 0) == pytest.approx([1 / 3] * 3)
    q, total, e = mixing.plan_weights([1000, 100, 0], [0.5, 0.4, 0.1], [1, 2, 4])
    assert q == pytest.approx([5 / 9, 4 / 9, 0]) and total == pytest.approx(450) and e == 1
    q, total, e = mixing.plan_weights([1000, 100], [0.5, 0.5], [1, 2], budget=800)
    assert q[1] * total == pytest.approx(200, rel=1e-6) and sum(q) == pytest.approx(1)
    q, total, _ = mixing.plan_weights([1000, 100], [0.5, 0.5], [1, 2], budget=10**6)
    assert total == 1200 and [x * total for x in q] == pytest.approx([1000, 200])


def test_limited_sources_stay_at_their_limit_and_the_others_reach_their_targets():
    tokens, wanted, repeats = [800, 100, 100], [0.2, 0.5, 0.3], [1, 1, 4]
    q, total, e = mixing.plan_weights(tokens, wanted, repeats, budget=1000)
    assert e == 1 and q == pytest.approx([0.5, 0.1, 0.4])
    r = random.Random(6)
    for _ in range(50):
        n = r.randrange(1, 7)
        tokens, wanted, repeats = [r.choice([0, r.randrange(1, 1000)]) for _ in range(n)], [r.choice([0, r.random()]) for _ in range(n)], [r.randrange(0, 4) for _ in range(n)]
        budget = r.randrange(1, 3000)
        q, total, e = mixing.plan_weights(tokens, wanted, repeats, budget=budget)
        live = [t * k if w > 0 else 0 for t, k, w in zip(tokens, repeats, wanted)]
        assert all(x * total <= c * (1 + 1e-6) + 1e-6 for x, c in zip(q, live))
        assert total <= budget + 1e-9 and (not any(live) or sum(q) == pytest.approx(1) and total == pytest.approx(min(budget, sum(live))))


def test_entropy_weights():
    q, e = mixing.entropy_weights([700, 200, 100, 0], 0.95)
    assert mixing.entropy(q) == pytest.approx(0.95 * np.log(3), abs=1e-6) and 0 < e < 1 and q[3] == 0


def test_mix(spark):
    r = random.Random(4)
    rec = [(i, r.choice(["big", "Big ", "small", None, "other"]), r.randrange(1, 50)) for i in range(2000)] + [(9999, "small", 0)]
    weights = [("big", 0.4, 1), ("small", 0.6, 3), ("absent", 0.1, 2)]
    mixture, report = mixing.mix(spark.createDataFrame(rec, "item_id bigint, source string, n_tokens bigint"), spark.createDataFrame(weights, "source string, target_share double, max_repeats int"))
    rows, shares = mixture.collect(), {x.source: x for x in report.collect()}
    times = collections.Counter((x.source, x.item_id) for x in rows)
    assert max(n for (s, _), n in times.items() if s == "big") == 1 and max(n for (s, _), n in times.items() if s == "small") <= 3
    assert shares["big"].actual_share == pytest.approx(0.4, abs=0.002) and shares["absent"].actual_share == 0
    assert sum(x.n_tokens for x in rows) == sum(x.tokens for x in shares.values())
    assert len({(x.item_id, x.pass_no) for x in rows}) == len(rows)
    empty = mixing.mix(spark.createDataFrame([], "item_id bigint, source string, n_tokens bigint"), spark.createDataFrame(weights, "source string, target_share double, max_repeats int"))
    assert empty[0].count() == 0 and empty[1].count() == 3


def test_token_counts(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (None, "x")]
    got = {x.item_id: x.n_tokens for x in tokens.token_counts(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and len(got) == 4


def brute_cover(xs, least):
    n, out = len(xs), [False] * len(xs)
    for i in range(n):
        for j in range(i + least, n + 1):
            if any(xs[k : k + j - i] == xs[i:j] for k in range(n - (j - i) + 1) if k != i):
                out[i:j] = [True] * (j - i)
    return out


def cover_by_automaton(xs, least):
    out = [False] * len(xs)
    for end, size in enumerate(stuffing.repeated_lengths(xs), 1):
        if size >= least:
            out[end - size : end] = [True] * size
    return out


def test_cover_by_array_and_automaton():
    r = random.Random(2)
    for n in (0, 1, 2, 5, 24, 40):
        for k in (1, 2, 6):
            xs = [r.randrange(k) for _ in range(n)]
            levels = stuffing.suffix_levels(np.asarray(xs, np.int64))
            assert [sorted(range(n), key=lambda i: xs[i:]).index(i) for i in range(n)] == levels[-1].tolist()
            for least in (2, 3):
                want = brute_cover(xs, least)
                assert cover_by_automaton(xs, least) == want
                assert stuffing.covered(stuffing.longest_repeats(levels), least).tolist() == want


def test_pages_of_a_batch_are_judged_apart():
    pages = ["buy cheap script online script cheap free script " * 3, None, "", "Der Lauf endet, wenn der Index fehlt. Danach wird er neu gebaut.", "buy cheap script online script cheap free script " * 3]
    assert stuffing.judge_all(pages) == [stuffing.judge(p) for p in pages]


@pytest.mark.parametrize(
    "text",
    [
        "Le chat dort sur le tapis pendant la nuit. La maison est grande et le jardin est petit. Nous avons vu le chat dans le jardin ce matin.",
        "Kot śpi na dywanie przez całą noc. Dom jest duży, a ogród jest mały. Widzieliśmy kota w ogrodzie dziś rano.",
        "猫は 夜 の 間 に 眠る。 家 は とても 大きい です。 庭 は 少し 小さい です。",
    ],
)
def test_prose_of_any_language_is_not_marked(text):
    assert stuffing.judge(text)[2] < 0.2


def test_long_pages_by_the_same_steps():
    words = "cheap script free tool best buy online app".split()
    r = random.Random(8)
    spam = " ".join(r.choice(words) for _ in range(300_000))
    prose = " ".join(f"The w{k}x reads item v{k}y before part u{k}z starts." for k in range(30_000))
    assert stuffing.judge(spam)[2] > 0.9 and stuffing.judge(prose)[2] < 0.1


def test_pages(spark):
    plain = "The cache is read before the index starts. It was moved after we saw the error, and nothing changed.\n"
    pages = {
        1: "buy cheap script online script cheap free script buy script free online script " * 5,
        2: "\n".join(f"- [free script {k}](https://a.example/x/{k})" for k in range(20)),
        3: plain * 4,
        4: "\n".join(f"2026-03-0{k}T22:50:43 INFO window: slow scan (prune={k})" for k in range(1, 9)),
        5: "```python\nfor x in y:\n    z(x)\n```\n" * 4,
        6: "\n".join(f"- [tool {k}](https://a.example/{k}): This is a tool that reads the index when you ask for it." for k in range(9)),
        7: None, 8: "", 9: "buy",
        10: "#BuyCheapScript #CheapScript #FreeScriptOnline #BuyScript #CheapScript #BuyFreeScript #OnlineScript " * 2,
        11: "Looking for free parser? Our parser is the best parser. If you need a parser, parser free is the parser for you. " * 4,
        12: plain * 3 + "keywords: buy script, free script\n" + plain * 3,
    }
    got = {x.item_id: x.marked for x in stuffing.judge_pages(spark.createDataFrame(list(pages.items()), "id bigint, text string"), "id", "text").collect()}
    assert {i for i, m in got.items() if m} == {1, 2, 10, 11} and len(got) == len(pages)
