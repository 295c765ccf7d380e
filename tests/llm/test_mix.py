import random

from proofmark.llm import mix


def tables(spark, docs, targets):
    return spark.createDataFrame(docs, "doc_id long, text string, source string, h int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_caps_and_copies(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["ab", "cd", "the", "of"]) for _ in range(rnd.randint(1, 30))) + f" {i}", "big" if i % 4 else "small", 0) for i in range(400)]
    docs += [(1000 + i, docs[i][1], "small", 0) for i in range(10)] + [(2000, None, "big", 0), (2001, "", "big", 0), (2002, "x", None, 0), (2003, "y", "other", 0)]
    d, t = tables(spark, docs, [("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)])
    got = {r["source"]: r for r in mix.mix_report(d, t).collect()}
    assert got["absent"]["tokens_used"] == 0 and got["small"]["most_uses"] <= 3 and got["big"]["most_uses"] == 1
    assert abs(got["big"]["actual_share"] - 5 / 9) < 0.01 and abs(got["small"]["actual_share"] - 4 / 9) < 0.01
    rows = mix.mix(d, t).collect()
    assert len({r["text_id"] for r in rows}) == len(rows) and not {r["text_id"] for r in rows} & set(range(1000, 2004))


def test_thresholds_against_sorting(spark):
    rnd = random.Random(4)
    rows = [("a" if rnd.random() < 0.8 else "b", i, rnd.getrandbits(60), rnd.randint(0, 50)) for i in range(3000)] + [("a", 9000 + i, 77, 3) for i in range(20)]
    tokens = spark.createDataFrame(rows, "source string, text_id long, h long, n_tokens long")
    for budgets in ({"a": 10_000, "b": 500}, {"a": 1, "b": 10**9}, {"a": 0}):
        got = mix.thresholds(tokens, budgets)
        for s, budget in budgets.items():
            total, best, at = 0, None, {}
            for x in sorted(r for r in rows if r[0] == s and True):
                at.setdefault(x[2], 0)
                at[x[2]] += x[3]
            for h in sorted(at):
                if total + at[h] > budget:
                    break
                total, best = total + at[h], h
            used = sum(r[3] for r in rows if r[0] == s and got[s] is not None and r[2] <= got[s])
            assert used == total, (s, budget)


def test_given_total_and_empty(spark):
    d, t = tables(spark, [(i, f"text {i}", "a", 0) for i in range(50)], [("a", 1.0, 2)])
    tokens = mix.token_table(d, t)
    n = tokens.agg({"n_tokens": "sum"}).first()[0]
    for total in (0, n // 2, n, n * 3 // 2, n * 5):
        plan, _ = mix.mix_plan(tokens, t, total)
        used = sum(r["n_tokens"] * r["uses"] for r in mix.mixed(tokens, plan).collect())
        assert min(total, 2 * n) - 20 <= used <= min(total, 2 * n)
    assert mix.mix(d.limit(0), t).count() == 0 and mix.mix(d, t.limit(0)).count() == 0 and mix.mix_report(d.limit(0), t).first()["actual_share"] == 0.0


def test_all_copies_of_one_text(spark):
    d, t = tables(spark, [(i, "same text", "ab"[i % 2], 0) for i in range(60)], [("a", 0.5, 2), ("b", 0.5, 2)])
    assert [tuple(r)[1:] for r in mix.mix(d, t).select("text_id", "source", "uses").collect()] == [("a", 2)]
