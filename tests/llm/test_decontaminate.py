"""Leaks in hot, repeated and long inputs, and the choice of repeats."""

import random
import time

import pytest

from evispark.llm import decontaminate

VOCABULARY = [f"v{j}" for j in range(500)]


def brute(index_items, text, share=0.2):
    from tests.llm.test_llm_operators import brute_leaks

    return brute_leaks(index_items, text, share)


def test_a_gram_that_all_items_share_costs_little():
    rng = random.Random(1)
    items = [(i, "what is the " + " ".join(rng.choices(VOCABULARY, k=12))) for i in range(1000)]
    texts = ["what is the " * 1500, "what is the " * 250 + items[3][1], " ".join(rng.choices(VOCABULARY, k=50))]
    index = decontaminate.LeakIndex(items, 0.2, 64)
    began = time.perf_counter()
    assert [[x["item_id"] for x in row] for row in index.leaks(texts)] == [[], [3], []]
    assert time.perf_counter() - began < 10


def test_slices_of_the_gate_change_nothing(monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 20)))) for i in range(30)]
    texts = [" ".join([*rng.choices(words, k=20), *rng.choice(items)[1].split(), *rng.choices(words, k=10)]) for _ in range(40)]
    whole = decontaminate.LeakIndex(items, 0.2, 32).leaks(texts)
    assert any(whole)
    monkeypatch.setattr(decontaminate, "ROWS_AT_ONCE", 7)
    assert decontaminate.LeakIndex(items, 0.2, 32).leaks(texts) == whole


def test_without_repeats_every_window_is_verified():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 16)))) for i in range(10)]
    texts = []
    for n in range(40):
        leak = rng.choice(items)[1].split()
        for _ in range(int(len(leak) * 0.2)):
            leak[rng.randrange(len(leak))] = rng.choice(words)
        texts.append(" ".join([*rng.choices(words, k=8), *leak]))
    found = [{x["item_id"] for x in row} for row in decontaminate.LeakIndex(items, 0.2, 0).leaks(texts)]
    assert found == [brute(items, t) for t in texts]


def test_repeats_are_chosen_by_size_and_given_up_where_they_miss():
    rng = random.Random(4)
    drawn = {decontaminate.size_class(m): [(i, " ".join(rng.choices(VOCABULARY, k=m))) for i in range(20)] for m in (4, 12, 60, 200)}
    chosen = decontaminate.choose_repeats(drawn, 0.2, 0.99)
    for of, items in drawn.items():
        assert decontaminate.simulated_recall(items, 0.2, chosen[of], tries=400, seed=77) >= 0.97
    assert decontaminate.choose_repeats(drawn, 0.2, 0.99, most=0) == dict.fromkeys(drawn, 0)
    assert decontaminate.simulated_recall(drawn[decontaminate.size_class(60)], 0.2, 0) == 1.0


def test_repeated_items_documents_and_empty_tables(spark):
    item = "one two three four five six seven eight"
    items = spark.createDataFrame([(1, item), (2, item.upper()), (3, None), (4, " "), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, f"x {item} y"), (2, None), (None, item)], "doc_id long, text string")
    rows = decontaminate.find_leaks(docs, items).collect()
    assert sorted((r.doc_id or 0, sorted(x.item_id for x in r.leaks)) for r in rows) == [(0, [1, 2]), (1, [1, 2]), (1, [1, 2]), (2, [])]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == 4
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0
    assert all(r.leaks == [] for r in decontaminate.find_leaks(docs, none).collect())


@pytest.mark.parametrize("words", [5000, 60000])
def test_long_texts(words):
    rng = random.Random(words)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=40))) for i in range(50)]
    text = " ".join(rng.choices(VOCABULARY, k=words)) + " " + items[7][1] + " end"
    assert [x["item_id"] for x in decontaminate.LeakIndex(items, 0.2, 32).leaks([text])[0]] == [7]
