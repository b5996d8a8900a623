"""Questions answered from the index against the literal search of each."""

import random

from caselens.operators import cardindex, retrieval
from caselens.queries import QUERIES


def test_questions_against_retrieve(spark):
    r = random.Random(4)
    vocabulary = ["cac", "ltv", "渠道策略", "market", "mark", "ark", "aaa", "it's", "go-to-market", "über", "x1", "a", "the", "the", "the"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", ",", "."]) for _ in range(n))
    cards = [(k, text(r.randint(0, 3)), text(r.randint(0, 40))) for k in range(120)] + [(200, None, None), (201, "aaaa", "aaaaaaa aaaa")]
    cards = spark.createDataFrame(cards, "card_id long, title string, text string")
    words = ["cac", "CAC", "market", "go to market", "to the", "a", "aa", "aaa", "道策", "it's", "s", " ", "nothing", "the", "über", "Mark  The", "略"]
    questions = {q: [r.choice(words) for _ in range(r.randint(1, 6))] for q in range(25)}
    rows = [(q, place, w) for q, ws in questions.items() for place, w in enumerate(ws)]
    asked = spark.createDataFrame(rows, "question long, place int, keyword string")
    index = cardindex.build(cards)
    got = {}
    for x in cardindex.retrieve_all(index, asked, 3).orderBy("question", "place").collect():
        got.setdefault(x.question, []).append((x.card_id, x.score, x.matched))
    for q, ws in questions.items():
        want = [(x.card_id, x.score, x.matched) for x in retrieval.retrieve(cards, ws, 3).collect()]
        assert got.get(q, []) == want, (q, ws)


def test_no_cards_and_no_questions(spark):
    cards = spark.createDataFrame([(1, "t", "x y")], "card_id long, title string, text string")
    asked = spark.createDataFrame([(1, 0, "x")], "question long, place int, keyword string")
    assert cardindex.retrieve_all(cardindex.build(cards.limit(0)), asked).collect() == []
    assert cardindex.retrieve_all(cardindex.build(cards), asked.limit(0)).collect() == []


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    """Equal scores in many blocks: the best of all blocks go by title and card, whatever the sizes."""
    cards = spark.createDataFrame([(k, f"t{k % 7}", "common words " + "rare " * (k % 5)) for k in range(300)], "card_id long, title string, text string")
    asked = spark.createDataFrame([(q, p, w) for q in range(20) for p, w in enumerate(["common", "words", "rare", "t3"][q % 3 :])], "question long, place int, keyword string")
    index = cardindex.build(cards)
    rows = lambda: sorted(map(tuple, cardindex.retrieve_all(index, asked, 3).collect()))
    want = rows()
    assert len(want) == 60 and {r[2] for r in want if r[0] == 0} == {24, 59, 94}
    monkeypatch.setattr(cardindex, "CARDS", 16)
    monkeypatch.setattr(cardindex, "QUESTIONS", 3)
    assert rows() == want


def test_questions_are_each_fiftieth_row(spark, sf_dir):
    """A search takes as questions every row whose id is divisible by 50, against all rows."""
    got = QUERIES["r9_questions"](spark, sf_dir).collect()
    assert got and all(r.question % 50 == 0 for r in got) and any(r.card_id % 50 for r in got)


def test_every_document_is_a_question(spark, sf_dir):
    """The whole job: the keywords of all documents, not of those with some ids."""
    got = {r.question for r in QUERIES["r9_questions"](spark, sf_dir).select("question").collect()}
    documents = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 100").select("doc_id").collect()}
    assert len(documents & got) > 0.95 * len(documents) and {k % 50 for k in got} == set(range(50))


def _shuffled(spark, after: int) -> tuple[int, int]:
    """The rows that stages behind number ``after`` shuffled, and the last stage."""
    context = spark.sparkContext
    none = context._jvm.java.util.ArrayList
    stages = context._jsc.sc().statusStore().stageList(none(), False, False, context._gateway.new_array(context._jvm.double, 0), none())
    stages = [stages.apply(k) for k in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in stages if s.stageId() > after), max((s.stageId() for s in stages), default=-1)


def test_rows_shuffled_do_not_grow_with_questions_times_cards(spark, monkeypatch):
    """Many blocks and slices: neither the postings nor the questions are shuffled for each pair of them."""
    monkeypatch.setattr(cardindex, "CARDS", 16)
    monkeypatch.setattr(cardindex, "QUESTIONS", 4)
    cards = spark.createDataFrame([(k, f"t{k % 7}", f"common words {k % 11}th") for k in range(400)], "card_id long, title string, text string")
    rows = [(q, p, w) for q in range(200) for p, w in enumerate(["common", "words", "th", f"{q % 11}th"])]
    asked = spark.createDataFrame(rows, "question long, place int, keyword string")
    _, last = _shuffled(spark, -1)
    got = cardindex.retrieve_all(cardindex.build(cards), asked, 3).collect()
    assert len(got) == 600 and all(r.card_id % 11 == r.question % 11 for r in got if r.question % 11 > 1)
    assert _shuffled(spark, last)[0] < 4 * (len(rows) + 400)


def test_a_keyword_in_a_word_that_repeats_it(spark):
    """Occurrences do not overlap, in a word and over words, in texts beyond the basic plane too."""
    texts = ["anana banana ana", "\U00020000ana\U00020000 ana na ana na", "ana nana na na", "an a"]
    cards = spark.createDataFrame([(k, "t", x) for k, x in enumerate(texts)], "card_id long, title string, text string")
    words = ["ana", "ana na", "\U00020000", "na na", "n"]
    asked = spark.createDataFrame([(q, 0, w) for q, w in enumerate(words)], "question long, place int, keyword string")
    got = cardindex.retrieve_all(cardindex.build(cards), asked, 4).collect()
    for q, w in enumerate(words):
        want = [(r.card_id, r.score) for r in retrieval.retrieve(cards, [w], 4).collect()]
        assert [(r.card_id, r.score) for r in sorted(got, key=lambda r: r.place) if r.question == q] == want, w
