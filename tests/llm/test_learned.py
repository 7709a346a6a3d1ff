"""Toxicity and page extraction: held-out accuracy, defined results for awkward input."""

import random

import pytest

from inquest.llm.extraction import Crf, block_features, extract, leaf_blocks, main_text, train_crf, training_set
from inquest.llm.toxicity import fit_ftrl, is_held_out, score, train
from tests.llm.cases import empty, frame, prose, rows


def test_toxicity_on_planted_words(spark):
    r = random.Random(4)
    bad = ["nasty", "awful", "rotten"]
    data, labels = [], []
    for i in range(400):
        words = prose(r, r.randint(20, 200)).split()
        toxic = int(i % 4 == 0)
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(bad))
            words.insert(r.randrange(len(words)), r.choice(bad).upper() + "!")
        data.append((i, " ".join(words), 0, "x"))
        labels.append((i, toxic, 1))
    docs = spark.createDataFrame([*data, (900, None, 0, "x"), (901, "", 0, "x"), (None, "nasty rotten thing", 0, "x"), (0, data[0][1], 0, "x")], "doc_id long, text string, y int, places string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (1, None, 1), (5, 7, 0), (77_777, 1, 1)], "doc_id long, toxic int, quality int")
    model = train(docs, known)
    got = score(docs, model, prefix="s_").collect()
    assert len(got) == 404 and len(model.places) < 3000
    right = [r.s_predicted == dict((a, b) for a, b, _ in labels)[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.s_score <= 1 and r.s_predicted == (r.s_score >= 0.5) for r in got)
    assert {r.s_predicted for r in got if not r.text} == {0}
    again = score(docs.repartition(5), train(docs.repartition(5), known), prefix="s_").collect()
    assert sorted((str(r.doc_id), r.s_score) for r in got) == sorted((str(r.doc_id), r.s_score) for r in again)


def test_toxicity_without_labels(spark):
    docs = frame(spark, rows())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(docs, none)
    assert {r.score for r in score(docs, model).collect()} == {0.5}
    assert score(empty(spark), model).count() == 0
    with pytest.raises(ValueError):
        score(docs.withColumnRenamed("w", "score"), model)


def test_held_out_rows_are_not_learned_from(spark):
    ids = spark.range(500).withColumnRenamed("id", "doc_id")
    held = {r.doc_id for r in ids.filter(is_held_out(ids.doc_id)).collect()}
    assert 50 < len(held) < 150
    docs = spark.createDataFrame([(i, "secret" if i in held else "plain words") for i in range(500)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i in held)) for i in range(500)], "doc_id long, toxic int")
    assert max(r.score for r in score(docs, train(docs, known)).collect()) < 0.5


def test_ftrl_weights_are_sparse():
    import numpy as np

    r = random.Random(1)
    data = [(np.unique([*(r.randrange(5000) for _ in range(30)), *([9999] if i % 2 else [])]), i % 2) for i in range(300)]
    model = fit_ftrl(data)
    assert 9999 in model.places and len(model.places) < 1500


@pytest.fixture(scope="module")
def model():
    return train_crf(training_set())


def test_crf_on_held_out_layouts(model):
    held = training_set(150, seed=77)
    wrong = sum(a != b for rows_, labels in held for a, b in zip(model.label(rows_), labels))
    assert wrong / sum(len(labels) for _, labels in held) < 0.01


def test_viterbi_is_the_best_of_all_labellings():
    import itertools

    r = random.Random(6)
    for _ in range(30):
        crf = Crf({f"f{i}": r.uniform(-2, 2) for i in range(8)}, ((r.uniform(-1, 1), r.uniform(-1, 1)), (r.uniform(-1, 1), r.uniform(-1, 1))))
        rows_ = [[f"f{r.randrange(10)}" for _ in range(2)] for _ in range(6)]
        value = lambda ys: sum(sum(crf.weights.get(f, 0) for f in row) * y for row, y in zip(rows_, ys)) + sum(crf.moves[a][b] for a, b in zip(ys, ys[1:]))
        assert value(crf.label(rows_)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=6))))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="ad">Buy now cheap</div>
<article><h1>A  title &amp; more</h1><p>First   paragraph with <b>bold</b> words,
and a new line.<p>Second&nbsp;one &lt;tag&gt; here.<ul><li>An item in the text.</li></ul><!-- <p>hidden</p> --></article>
<div id="comments"><div class="comment"><p>I like this page very much, thank you.</p></div></div><form><label>Mail</label><button>Go</button></form>
<footer>&copy; example</footer>"""


def test_page(model):
    assert main_text(PAGE, model) == "A title & more\nFirst paragraph with bold words, and a new line.\nSecond one <tag> here.\nAn item in the text."
    cut = PAGE[: PAGE.index("here.")]
    assert main_text(cut, model).endswith("Second one <tag>")


def test_awkward_pages(spark, model):
    assert main_text(None, model) == main_text("", model) == main_text("<p></p>", model) == ""
    assert [b.text for b in leaf_blocks("a < b <p>c<script>x")] == ["a < b", "c"]
    deep = "<div>" * 3000 + "<p>deep text</p>"
    assert [b.text for b in leaf_blocks(deep)] == ["deep text"]
    long = "<article>" + "".join(f"<p>Paragraph {i} of a very long text goes on.</p>" for i in range(20_000)) + "</article>"
    assert main_text(long, model).count("\n") == 19_999
    data = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    got = extract(pages, model, prefix="m_").collect()
    assert sorted(len(r.m_text) for r in got) == sorted(len(main_text(x[2], model)) for x in data)
    assert got[0].text in ("x", "y", None)
    assert extract(pages.limit(0), model, prefix="m_").count() == 0
    with pytest.raises(ValueError):
        extract(pages, model)


def test_features_name_what_is_around():
    block = leaf_blocks('<div class="post-body main"><p>Text.</p></div>')[0]
    assert {"in=div", "name=post", "name=body", "name=main", "in=p"} <= set(block_features([block])[0])
