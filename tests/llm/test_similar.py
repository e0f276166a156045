import math
import random

import numpy as np

from panelworks.llm import similar, simhash


def jaccard(a, b):
    own = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    return len(own(a) & own(b)) / len(own(a) | own(b))


def near(words, rng, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def test_stage_drops_near_copies_and_keeps_others(docs, monkeypatch):
    rng, texts, want = random.Random(5), [], set()
    for k in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for j, changes in enumerate((0, 1, 2, 3, 12)):
            texts.append((k * 10 + j, " ".join(near(base, rng, changes))))
    for k in range(30):  # the least id of each connected group
        root = {i: i for i, _ in texts[k * 5 : k * 5 + 5]}
        for i, a in texts[k * 5 : k * 5 + 5]:
            for j, b in texts[k * 5 : k * 5 + 5]:
                if i < j and jaccard(a, b) >= 0.8:
                    old, new = sorted((root[i], root[j]))[::-1]
                    root = {x: new if r == old else r for x, r in root.items()}
        want |= set(root.values())
    assert 30 < len(want) < 120
    df = docs(*texts)
    got = simhash.keep_one(df)
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == want
    monkeypatch.setattr(similar, "DENSE", 2)  # through pivots
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == want


def test_rows_of_one_id_count_by_their_own_text(docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    df = docs((1, a), (2, b), (2, a), (3, c), (3, b), (3, c), (None, a))
    got = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(df).collect())
    assert got == [(0, a), (1, a), (2, b), (3, c)]


def test_second_keys_find_what_pivots_of_a_crowded_key_leave(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    # many texts that share half of their words, and among them pairs of near copies
    texts = [" ".join(base[:110] + [f"x{rng.randrange(10**6)}" for _ in range(90)]) for _ in range(60)]
    texts += [" ".join(near(t.split(), rng, 2)) for t in texts[:20]]
    rows = spark.createDataFrame(list(enumerate(texts)), "whole bigint, text string")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    found = {(r["a"], r["b"]) for r in similar.verified(similar.further(rows, roots).distinct(), rows).collect()}
    assert found == {(k, k + 60) for k in range(20)} == {(i, j) for i in range(80) for j in range(i + 1, 80) if jaccard(texts[i], texts[j]) >= 0.8}
    proposed = similar.further(rows, roots).distinct().collect()
    assert len(proposed) < 60  # of 1,900 that share a passage
    linked = spark.createDataFrame([(k, 0) for k in range(60)], "node bigint, root bigint")  # one group holds most of each key
    assert {tuple(sorted((r["a"], r["b"]))) for r in similar.further(rows, linked).distinct().collect()} >= found


def test_keys_miss_few_pairs_of_the_least_similarity():
    rng = np.random.default_rng(1)
    for depth in similar.DEPTHS:
        bands, flip, _ = similar.permutations(depth)
        assert len(flip) == depth * bands and (1 - 0.8**depth) ** bands <= similar.MISSED
        for _ in range(20):
            both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (80, 10, 10))
            x, y = (np.unique(np.concatenate([both, own])) for own in (a, b))
            lows = [similar.minima(own, depth) for own in (x, y)]
            assert set(similar.keys(lows[0])) & set(similar.keys(lows[1]))
            apart = sum(int(v).bit_count() for v in (similar.bits(lows[0]) ^ similar.bits(lows[1])).view(np.uint64))
            assert apart <= similar.differing(similar.BITS if depth * bands > similar.BITS else depth * bands)
            apart = sum(int(v).bit_count() for v in (similar.bitmap(x) ^ similar.bitmap(y)).view(np.uint64))
            assert apart <= len(np.setxor1d(x, y))


def test_bits_leave_out_as_few_pairs():
    for size, least in ((560, 0.8), (64, 0.5), (8, 1.0)):
        most, odds = similar.differing(size, least), (1 - least) / 2
        share = lambda k: sum(math.comb(size, j) * odds**j * (1 - odds) ** (size - j) for j in range(k + 1, size + 1))  # noqa: B023, E731
        assert share(most) <= similar.MISSED * 1.001 and (most == 0 or share(most - 1) > similar.MISSED)


def test_odd_rows(docs):
    from conftest_llm import ODD

    got = simhash.keep_one(docs(*ODD, (7, " "), (9, "one two")))
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 4, 6, 9] and got.columns == docs(*ODD).columns
    assert simhash.keep_one(docs(*ODD).limit(0)).count() == 0


def test_keys_and_texts_are_not_broadcast(spark, monkeypatch):
    """Files hold texts packed, and Spark takes exploded keys for few: neither may go to the driver."""
    plans, write = [], similar.table
    monkeypatch.setattr(similar, "table", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), write(df, name))[1])
    texts = [" ".join(f"w{(k // 3 * 31 + j) % 997}" for j in range(30)) + f" x{k}" for k in range(60)]
    rows = write(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "documents")
    assert len(similar.keep_one(rows).collect()) < 60
    assert {"shared", "pairs", "texts", "links"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if "Broadcast" in plan]


def test_crowded_keys_need_second_keys_only_beyond_many(spark, monkeypatch):
    rng, made, write = random.Random(9), [], similar.table
    monkeypatch.setattr(similar, "table", lambda df, name: (out := write(df, name), made.append((name, out.count())))[0])
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(base[:110] + [f"x{rng.randrange(10**6)}" for _ in range(90)]) for _ in range(40)]
    texts += [" ".join(near(t.split(), rng, 2)) for t in texts[:10]]
    rows = spark.createDataFrame(list(enumerate(texts)), "whole bigint, text string")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    crowded = spark.createDataFrame([(7, k, 50) for k in range(50)], "key bigint, whole bigint, n bigint")
    want = {(k, k + 40) for k in range(10)}
    for many, most in ((50, 50), (49, 50 * 70)):
        monkeypatch.setattr(similar, "MANY", many)
        made.clear()
        found = similar.verified(similar.further(rows, roots, crowded=crowded).distinct(), rows).collect()
        assert {(r["a"], r["b"]) for r in found} == want
        assert sum(n for name, n in made if name == "named") == most  # a row a set and key, where 70 second keys a set were exploded


def test_first_keys_give_texts_only_to_pairs_that_sizes_and_bitmaps_allow(docs, monkeypatch):
    """A passage that many texts share gives them first keys, but no pair to verify."""
    rng, made, write = random.Random(12), [], similar.table
    monkeypatch.setattr(similar, "table", lambda df, name: (out := write(df, name), made.append((name, out.count())))[0])
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(base[:150] + [f"x{rng.randrange(10**6)}" for _ in range(50)]) for _ in range(40)]
    texts += [" ".join(near(t.split(), rng, 2)) for t in texts[:10]]
    for dense in (similar.DENSE, 2):  # pairs within keys, and pivots
        monkeypatch.setattr(similar, "DENSE", dense)
        made.clear()
        assert {r["doc_id"] for r in simhash.keep_one(docs(*enumerate(texts))).collect()} == set(range(40))
        count = {name: n for name, n in made[::-1]}  # of each table, as first made
        assert count["met"] > 200 and count["links"] <= count["pairs"] <= 20


def test_no_similar_pair_is_ruled_out(spark):
    rng, least = np.random.default_rng(3), 0.55
    sets = [rng.integers(0, 1 << 63, 100, dtype=np.uint64)]
    sets += [sets[0][:55], sets[0][:54], np.concatenate([sets[0][:71], rng.integers(0, 1 << 63, 29, dtype=np.uint64)]), np.empty(0, np.uint64)]
    sets = list(map(np.unique, sets))
    rows = [(k, len(x), *map(int, similar.bitmap(x))) for k, x in enumerate(sets)]
    marks = spark.createDataFrame(rows, ", ".join(["whole bigint, n bigint", *(f"{x} bigint" for x in similar.MARKS)]))
    pairs = [(a, b) for b in range(5) for a in range(b)]
    got = {(r["a"], r["b"]) for r in similar.possible(spark.createDataFrame(pairs, "a bigint, b bigint"), marks, least).collect()}
    want = {(a, b) for a, b in pairs if similar.similarity(sets[a], sets[b]) >= least}
    assert (0, 1) in want and (0, 3) in want and got >= want  # 0.55 * 100 is over 55 in floating point
    assert (0, 2) not in got and not [x for x in got if 4 in x]


def test_pivots_are_joined_before_a_text_has_a_row_for_each(spark):
    shared = similar.table(spark.range(200).selectExpr("id % 2 AS key", "id AS whole", "100L AS n"), "shared")
    got = similar.candidates(shared)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    pairs = {(r["a"], r["b"]) for r in got.collect()}
    assert {x for p in pairs for x in p} == set(range(200)) and all((a - b) % 2 == 0 for a, b in pairs)
    assert len(pairs) <= 200 * similar.PIVOTS
