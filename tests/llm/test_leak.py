import random
from zlib import crc32

from proofmark.llm import leak

WORDS = [f"w{i}x" for i in range(2000)]


def planted(rnd, item, share, noise):
    n = int(len(item) * share)
    k = rnd.randint(0, len(item) - n)
    out = []
    for w in item[k : k + n]:
        r = rnd.random()
        if r < noise / 3:
            continue
        out.append(w if r < 1 - noise / 3 else w + "q" if r < 1 - noise / 6 else w)
        if r > 1 - noise / 6:
            out.append("added")
    return out


def test_planted_passages(spark):
    rnd = random.Random(3)
    items = [(i, [rnd.choice(WORDS) for _ in range(60)]) for i in range(20)]
    docs, want = [], set()
    for d in range(120):
        body = [rnd.choice(WORDS) for _ in range(80)]
        i, words = rnd.choice(items)
        kind = d % 4
        if kind == 0:
            body[20:20] = planted(rnd, words, 0.7, 0.08)
            want.add((d, i))
        elif kind == 1:
            body[20:20] = planted(rnd, words, 0.3, 0.0)
        elif kind == 2:
            body = planted(rnd, words, 1.0, 0.05)
            want.add((d, i))
        docs.append((d, "\n".join(" ".join(body[k : k + 9]).upper() + "," for k in range(0, len(body), 9))))
    got = leak.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, "s", " ".join(w)) for i, w in items], "item_id long, suite string, text string"))
    assert {tuple(r) for r in got.collect()} == want


def test_reordered_is_coverage_but_no_stretch(spark):
    words = [f"v{i}" for i in range(40)]
    text = " ".join(words[30:] + ["gap"] * 20 + words[20:30] + ["gap"] * 20 + words[10:20] + ["gap"] * 20 + words[:10])
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "v1"), (1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "s", " ".join(words)), (8, "s", None), (9, "s", "a b")], "item_id long, suite string, text string")
    got = leak.shared_passages(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in got] == [(1, 7, 1.0)]  # the row given twice counts once
    assert leak.leaked(docs, items).count() == 0
    rep = {r["item_id"]: (r["n_leaks"], r["n_reordered"]) for r in leak.leak_report(docs, items).collect()}
    assert rep == {7: (0, 1), 8: (0, 0), 9: (0, 0)}
    assert leak.leaked(docs.limit(0), items).count() == 0 and leak.leaked(docs, items.limit(0)).count() == 0


def test_any_bitmap_and_any_join_give_the_same(spark, monkeypatch):
    rnd = random.Random(5)
    items = [(i, "s", " ".join(rnd.choice(WORDS) for _ in range(50))) for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(items)], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, suite string, text string")
    whole = sorted(map(tuple, leak.leaked(docs, it).collect()))
    monkeypatch.setattr(leak, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(leak, "BITS_A_SEED", 1000)
    monkeypatch.setattr(leak, "SEEDS_BROADCAST", 1)
    assert sorted(map(tuple, leak.leaked(docs, it).collect())) == whole == [(i, i) for i in range(12)]


def test_texts_are_not_shuffled(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "eval_item"))
    plan = leak.leaked(docs.coalesce(64), items)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "hashpartitioning" in x and "text#" in x]


def test_tiles_against_plain_tiling():
    rnd = random.Random(8)
    for _ in range(200):
        item = [rnd.choice("abcdef") for _ in range(15)]
        doc = [rnd.choice("abcdef") for _ in range(25)]
        hits = [(q, p) for q in range(23) for p in range(13) if doc[q : q + 3] == item[p : p + 3]]
        got = leak.tiles(hits, len(item))
        d, i = set(), set()
        for q, p, n in got:
            assert doc[q : q + n] == item[p : p + n] and not d & set(range(q, q + n)) and not i & set(range(p, p + n))
            d |= set(range(q, q + n))
            i |= set(range(p, p + n))
        free = [(q, p) for q, p in hits if not d & set(range(q, q + 3)) and not i & set(range(p, p + 3))]
        assert not free or len(i) > len(item) - leak.SEED


def test_running_hash_is_the_hash():
    words = "ab c ab c ab d é".split()
    got = leak.running_hashes(words).tolist()
    for i, h in enumerate(got):
        want = 0
        for w in words[i : i + 3]:
            want = (want * leak.BASE + crc32(w.encode())) % (1 << 64)
        want ^= want >> 29
        assert h == want - (1 << 64 if want >> 63 else 0)
    assert got[0] == got[2] and len(set(got)) == 4 and leak.running_hashes(["a", "b"]).size == 0
