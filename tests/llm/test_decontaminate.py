import random
import time

from conftest_llm import ODD

from panelworks.llm import decontaminate as D

WORDS = [f"w{k}" for k in range(200)]


def distance(item, text):
    """The least edit distance of item to any run of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(rng, item, n):
    out = list(item)
    for _ in range(n):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.pop(at), lambda: out.insert(at, rng.choice(WORDS)), lambda: out.__setitem__(at, rng.choice(WORDS))])()
    return out


def test_all_matches_within_budget_and_no_others():
    rng = random.Random(5)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.randint(2, 40)))) for k in range(20)]
    finder = D.Finder(items, D.RATE)
    for trial in range(120):
        k = trial % 20
        item = items[k][1].split()
        text = rng.choices(WORDS, k=30) * rng.choice((1, 1, 3)) + edited(rng, item, rng.randint(0, len(item) // 3)) + rng.choices(WORDS, k=30)
        found = {x[0]: x[1] for x in finder.find(" ".join(text).upper().replace(" ", ",  "))}
        want = {i: d for i, t in items if (d := distance(t.split(), text)) <= int(D.RATE * len(t.split()))}
        assert found == want


def test_short_items_are_found_inside_texts():
    finder = D.Finder([(1, "The cat sat."), (2, "!!"), (3, "zebra")], D.RATE)
    assert finder.find("We saw that THE CAT sat down") == [(1, 0, 0, 3, 5)] and finder.find("the cat has sat") == [] and finder.find("") == []
    assert finder.find("zebra, zebras; the cat sat the cat sat") == [(3, 0, 0, 0, 0), (1, 0, 0, 2, 4)]


def test_scripts_without_blanks_are_words_by_the_character():
    item = "\u6211\u4eec\u4eca\u5929\u53bb\u5b66\u6821\u8bfb\u4e66\u5427"
    finder = D.Finder([(1, item)], D.RATE)
    assert len(D.words(item)) == 10 and D.words("ab \u6211\u4eeccd") == ["ab", "\u6211", "\u4eec", "cd"]
    assert finder.find(f"x{item[:4]}\u4e0d{item[4:]}\u3002y")[0][:3] == (1, 1, 2) and finder.find(item[:6]) == []


def test_repetitive_texts_take_time_in_proportion():
    finder = D.Finder([(1, "a b " * 160)], D.RATE)
    began = time.process_time()
    assert finder.find("b a " * 80_000)[0][:2] == (1, 0)
    assert finder.find("a b c " * 50_000)[0:1] == []
    assert time.process_time() - began < 8


def test_odd_rows(spark, docs):
    bench = spark.createDataFrame([(1, "One two three, four five SIX."), (1, "two three"), (2, None), (None, "a"), (3, "")], "item_id bigint, text string")
    df = docs(*ODD)
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in D.leaks(df, bench).collect()) == [(4, 1, 0)] * 4 + [(5, 1, 0)] * 2
    kept = D.clean(df, bench)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 6] and kept.columns == df.columns
    assert D.leaks(df, bench.limit(0)).count() == 0 and D.leaks(df.limit(0), bench).count() == 0


def test_blocks_of_items_find_the_same(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(k, f"alpha beta gamma delta item{k}") for k in range(4)], "item_id bigint, text string")
    df = docs((1, "alpha beta gamma delta item1"), (2, "nothing of the kind is here"))
    one = sorted(D.leaks(df, bench).collect())
    monkeypatch.setattr(D, "BLOCK", 30)
    assert sorted(D.leaks(df, bench).collect()) == one and len(one) == 4
