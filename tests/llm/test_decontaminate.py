import random

from momentloom.llm import decontaminate as D


def made():
    rand = random.Random(9)
    common = [f"c{k}" for k in range(40)]
    word = lambda: rand.choice(common) if rand.random() < 0.5 else f"r{rand.randrange(5000)}"
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, sentence(rand.randrange(8, 25)) + " " + sentence(rand.randrange(3, 9))) for i in range(60)]
    docs = []
    for d in range(120):
        text = " ".join(sentence(rand.randrange(5, 20)) for _ in range(rand.randrange(1, 30)))
        if d % 3 == 0:
            item = items[d % 60][1]
            cut = rand.randrange(len(text))
            text = f"{text[:cut]} {item.upper() if d % 2 else item} {text[cut:]}"
        elif d % 3 == 1:
            text += " " + items[d % 60][1].split(". ")[0][:25]
        docs.append((d, text))
    return items, docs


def test_search_finds_all_above_the_threshold():
    items, docs = made()
    index = D.ItemIndex([(i, *D.split_item(t)) for i, t in items])
    index.prepare()
    whole = lambda q, a: set(q if q == a else q + a)
    for _, text in docs[:40]:
        terms = sorted({index.vocabulary[t] for t in D.tokens(text) if t in index.vocabulary})
        want = {}
        for i, (_, q, a) in enumerate(index.items):
            score = sum(s for t in terms for j, s in zip(*index.postings[t]) if j == i)
            if score >= 0.4:
                want[i] = score
        got = dict(x for b in range(index.bounds.shape[1]) for x in index.search(terms, b, 0.4))
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_leaks_and_clean_documents(spark):
    items, docs = made()
    rows = docs + [(900, None), (901, ""), (902, " \n"), (903, "nothing of it " * 5000), (904, "pad " * 9999 + items[3][1]), (904, docs[0][1])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame(items + [(77, None), (78, ""), (79, items[6][1])], "item_id long, text string")
    got = {(r.doc_id, x.item_id) for r in D.with_leaks(table, bench).collect() for x in r.leaks}
    want = {(d, d % 60) for d in range(0, 120, 3)} | {(904, 3), (904, 0)} | {(d, 79) for d in range(120) if d % 60 == 6}
    assert got == want
    clean = D.decontaminate(table.drop("leaks"), bench).collect()
    assert sorted(r.doc_id for r in clean) == sorted([d for d in range(120) if d % 3] + [900, 901, 902, 903])


def test_scores_do_not_depend_on_the_size_of_an_index(spark, monkeypatch):
    items, docs = made()
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for size in (1024, 7):
        monkeypatch.setattr(D, "INDEX_ITEMS", size)
        found.append(sorted((r.doc_id, x.item_id, x.at, round(x.score, 9), x.question_share, x.answer_share) for r in D.with_leaks(table, bench, threshold=0.3, question=0.1, answer=0.1).collect() for x in r.leaks))
    assert found[0] == found[1] and len(found[0]) >= 40


def test_empty_tables_and_answers(spark):
    docs = spark.createDataFrame([(1, "the question words are these and the reply is forty two")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.with_leaks(docs, none).collect()[0].leaks == [] and D.with_leaks(docs.limit(0), none).count() == 0
    told = spark.createDataFrame([(1, "the question words are these", "forty two"), (2, "the question words are these", "forty three")],
                                 "item_id long, text string, answer string")
    assert [x.item_id for x in D.with_leaks(docs, told).collect()[0].leaks] == [1]
