"""Quality rules, URL filters and benchmark decontamination against plain loops."""

import hashlib
import random
import re
from collections import Counter

import pytest

from inquest.llm.decontam import contamination, drop_contaminated
from inquest.llm.quality import quality_filter, quality_report
from inquest.llm.queries import QUERIES
from inquest.llm.urlrules import judge_urls
from tests.llm.cases import empty, frame, prose, rows, split_words


def plain_quality(text):
    w = split_words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_counts(spark):
    data = rows()
    got = quality_report(frame(spark, data), prefix="r_").collect()
    names = ("r_n_words", "r_word_chars", "r_n_symbols", "r_n_dup_lines", "r_n_repeat_words", "r_base_failed")
    assert sorted((str(r.text), *(r[n] for n in names)) for r in got) == sorted((str(x[1]), *plain_quality(x[1])) for x in data)
    assert all(not (r.r_kept and r.r_base_failed) for r in got)
    assert [r.q_kept for r in got] == ["no"] * len(data)


def test_quality_names_and_empty(spark):
    with pytest.raises(ValueError):
        quality_report(frame(spark, rows()))
    assert quality_filter(empty(spark)).count() == 0
    assert quality_filter(frame(spark, rows())).columns == empty(spark).columns


def test_quality_keeps_good_prose_of_any_length(spark):
    import random

    r = random.Random(1)
    data = [(i, " ".join(f"{w}{r.randint(0, 10**6)} the" for w in prose(r, n // 2).split())) for i, n in enumerate((60, 500, 20_000))]
    assert quality_filter(spark.createDataFrame(data, "doc_id long, text string")).count() == 3


RULES = [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", None, "block"), ("org", "/a", "allow"), ("org", "/a", "block"), (None, "/", "block"), ("org", "/x", None)]


def plain_verdict(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = []
    for h, p, v in RULES:
        if h is None or v is None:
            continue
        h, p = h.lower(), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v == "block", h + p, v))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_rules(spark):
    urls = [
        "https://www.example.com/en/1", "http://EXAMPLE.com/en/", "http://a.b.example.com/en/x?y=1#z", "http://example.com", "http://example.com?q", "notaurl", None, "",
        "http://a.net/es/1", "http://a.net/esx", "http://net/es/", "x://b.org/abc", "x://b.org/ab://c.com/en/", "http://xcom/", "http://./", "http://a..com/", "http://user@x.com:80/p", "http://h.com/" + "p" * 5000,
        "http://a.net\n/es/", "http://example.com/en/\nb",
    ] * 2
    pages = spark.createDataFrame([(i, u, "digest", "host") for i, u in enumerate(urls)], "page_id long, url string, digest string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.u_host, r.u_path, r.u_rule, r.u_verdict) for r in judge_urls(pages, rules).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(urls)}
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.u_verdict for r in judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def plain_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def plain_contamination(text, items):
    w, hit, ids = plain_words(text), set(), set()
    for item_id, item in items:
        v = plain_words(item)
        k = min(10, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1 if v else 0):
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                ids.add("" if item_id is None else str(item_id))
    return len(w), len(hit), ",".join(sorted(ids))


def test_contamination(spark):
    data = rows()
    passage = data[10][1].split("\n")[0]
    cut = plain_words(passage)
    items = [(1, passage), (2, " ".join(cut[20:31])), (30, "the THE the"), (4, None), (5, " .,"), (6, " ".join(cut[5:20]) + " zzz " + " ".join(cut[30:60])), (7, "Übung, ñandú"), (7, "unheard of words"), (None, "paper house"), (2, " ".join(cut[20:31]))]
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, tid int")
    found = contamination(frame(spark, data), bench).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r.item_ids)) for r in found)
    assert got == sorted((str(x[0]), *plain_contamination(x[1], items)) for x in data)
    assert any(r.n_hit for r in found) and any(not r.n_hit for r in found)
    assert len({r.row for r in found}) == len(data)
    kept = drop_contaminated(frame(spark, data), bench)
    assert kept.columns == empty(spark).columns
    # Each row by its own text: of the rows without an id some go and some stay.
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((x[0], x[1])) for x in data if not plain_contamination(x[1], items)[1])
    assert any(x[0] is None for x in data)


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "the garden")], "item_id long, text string")
    assert contamination(empty(spark), bench).count() == 0
    none = contamination(frame(spark, rows()), bench.limit(0)).collect()
    assert len(none) == len(rows()) and all(r.n_hit == 0 and r.item_ids == [] for r in none)


def plain_near(text, items, window=10, span=20):
    """Ids of items of which some window has four fifths of its distinct words in a span of the text."""
    w, out = plain_words(text), set()
    for item, body in items:
        t = plain_words(body)
        for i in range(max(1, len(t) - window + 1)):
            terms = set(t[i : i + window])
            if len(terms) > 1 and any(5 * len(terms & set(w[p : p + span])) >= 4 * len(terms) for p in range(len(w))):
                out.add("" if item is None else str(item))
    return out


def test_proximity_against_every_span(spark):
    """Passages reordered, spread out, with words replaced, beyond the span, and unrelated texts with many of the words."""
    r = random.Random(12)
    words = [f"t{i}" for i in range(60)] + ["the", "of", "and"] * 3
    passages = [[r.choice(words) for _ in range(k)] for k in (10, 14, 25, 3, 2, 1, 40)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice((5, 30, 200)))) for _ in range(40)]
    for p in passages:
        for lost, filler in ((0, 0), (1, 1), (2, 0), (3, 0), (0, 1), (0, 2)):
            some = r.sample(p, max(1, min(10, len(p)) - lost))
            mixed = [x for y in some for x in [y] + ["f%d" % r.randrange(10**6)] * filler]
            texts.append(" ".join(["lead"] * r.randint(0, 30) + mixed + ["tail"] * r.randint(0, 30)))
    texts += [None, "", " ".join(passages[0]), " ".join(passages[2])]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(2, "another the of t1 t2 t3"), (None, "t5 t6 t7 nowhere t8"), (9, None)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.n_near for x in contamination(docs, spark.createDataFrame(items, "item_id long, text string"), proximity=True).collect()}
    want = {i: len(plain_near(t, items)) for i, t in enumerate(texts)}
    assert got == want and sum(n > 0 for n in want.values()) > 20 and 0 in want.values()


def test_digest_of_no_items_is_that_of_the_empty_string(spark, tmp_path):
    frame(spark, rows()).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nowhere to be found")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES["op10_benchmark_decontamination"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows()) and {r.items_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}


def test_stop_words_judge_only_languages_with_a_list(spark):
    text = " ".join(f"kata{i} {'di' if i % 3 else 'yang'}" for i in range(60))
    data = [(i, text, lang, "s", 0, 0, "", 0.5, "") for i, lang in enumerate(("id", "en", None, "fr", "xx"))]
    kept = {r.doc_id: r.q_kept for r in quality_report(frame(spark, data).drop("q_kept")).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: True}
    assert not any(r.q_kept for r in quality_report(frame(spark, data).drop("q_kept", "lang")).collect())
