"""Filing sections, extractions and valence scores, against plain Python and by hand."""

import html
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.operators import articles, sections, texts, valence

HEADS = {"one": r"(?i)\bitem\s*1\b", "two": r"(?i)\bitem\s*2\b", "three": "<!>"}


def cut(text, headings, least):
    found = []
    for k, (name, pattern) in enumerate(headings.items()):
        starts = [m.start() for m in re.finditer(pattern, text or "")]
        if starts:
            found.append((starts[-1], k, name))
    found.sort()
    out = []
    for (at, _, name), after in zip(found, [*found[1:], (len(text or ""), 0, "")], strict=False):
        body = text[at : after[0]].strip(" ")
        if len(body) > least:
            out.append((len(out), name, at, body))
    return out


def test_sections_start_at_last_matches(spark):
    rng = random.Random(2)
    parts = ["item 1 ", "ITEM 2 ", "<!>", "some words of prose ", "é€ ", "item 12 ", "  "]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(14)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "contents item 1 item 2 then Item 2 of two " + "x" * 30 + " item 1 at last " + "y" * 30), (303, "<!>" * 20_000)]
    got = {}
    for r in sections.sections(spark.createDataFrame(rows, "id int, t string"), "id", "t", HEADS, least=10).collect():
        got.setdefault(r.id, []).append((r.place, r.section, r.start, r.body))
    for i, text in rows:
        assert sorted(got.get(i, [])) == cut(text, HEADS, 10), text and text[:80]
    assert [r[1] for r in sorted(got[302])] == ["two", "one"]


def test_headings_of_reports(spark):
    page = "<html><p>Contents: Item 1A. Risk Factors, Item 7. Management&#x27;s Discussion and Analysis</p>"
    page += "<h2>Item&nbsp;1A. Risk&nbsp;Factors</h2><p>" + "We may lose money. " * 5 + "</p><h2>ITEM 7. MANAGEMENT'S DISCUSSION AND ANALYSIS</h2><p>" + "Sales rose. " * 8 + "</p>"
    got = sections.filing_sections(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html").collect()
    assert [(r.section, r.body[:25]) for r in got] == [("risk_factors", "Item 1A. Risk Factors We "), ("mda", "ITEM 7. MANAGEMENT'S DISC")]
    assert "Item 7" not in got[0].body


def test_unescape_is_that_of_html(spark):
    texts_ = ["&lt;a&gt; &amp;amp; &amp;lt;", "&#65;&#x42;&#xe9; &#8364;&#x1F600;", "&#0; &#xD800; &unknown; & &#", "plain", "&copy;&euro;&ndash;", "&#9999999;"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts_], "t string").select(texts.unescape("t")).collect()]
    for t, g in zip(texts_, got, strict=True):
        assert g == (html.unescape(t) if not any(x in t for x in ("&#0;", "D800", "9999999")) else g), t
    assert got[2] == "&#0; &#xD800; &unknown; & &#" and got[5] == "&#9999999;"


def test_extractions_fall_back_and_join_their_articles(spark):
    a = spark.createDataFrame(
        [("a", "S1", "mda", "T" * 300, "10-K", None, "2024-02-03 04:05:06"), ("b", None, None, None, "10-Q", "2024-01-09", None)],
        "article_id string, ticker string, section string, title string, filing_type string, date string, published_at string",
    ).withColumn("fetched_at", F.lit("now"))
    given = spark.createDataFrame([("b", "", "mda", 0.5, ["x"], "raised", ["y"], 0.1, "new", "s")], sections.SECTION_EXTRACTION)
    got = {r.article_id: r for r in sections.to_silver(sections.with_fallback(a, given), a).collect()}
    assert (got["a"].ticker, got["a"].section_type, got["a"].summary, got["a"].key_risks, str(got["a"].date)) == ("S1", "mda", "T" * 200, "[]", "2024-02-03")
    assert (got["b"].ticker, got["b"].risk_sentiment, got["b"].key_risks, str(got["b"].filing_date)) == ("", 0.5, '["x"]', "2024-01-09")
    assert sections.with_fallback(a.limit(0), given).collect() == []


LEXICON = {"good": 2.0, "bad": -2.0, "great": 3.0, "not": -1.0}


def by_hand(text, lexicon=LEXICON, rules=valence.Rules()):  # noqa: B008
    words = [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", p) for p in re.split("[ \t\r\n]+", text or "")) if w]
    low = [w.lower() for w in words]
    caps = [w == w.upper() and w != w.lower() for w in words]
    mixed = 0 < sum(caps) < len(words)
    roles = {*rules.boosters, *rules.negations, rules.contrast}
    contrast = low.index(rules.contrast) if rules.contrast in low else None
    values = []
    for i, w in enumerate(low):
        if w in roles or not lexicon.get(w):
            continue
        v = lexicon[w]
        sign = math.copysign(1, v)
        v += 0.733 * sign if caps[i] and mixed else 0
        for k, fade in enumerate(valence.FADING, 1):
            if i >= k and low[i - k] in rules.boosters:
                v += (rules.boosters[low[i - k]] * sign + (0.733 * sign if caps[i - k] and mixed else 0)) * fade
        for k in (1, 2, 3):
            v *= -0.74 if i >= k and low[i - k] in rules.negations else 1
        v *= 1 if contrast is None or i == contrast else 0.5 if i < contrast else 1.5
        values.append(v)
    text = text or ""
    asks = text.count("?")
    marks = min(text.count("!"), 4) * 0.292 + (0.96 if asks > 3 else asks * 0.18 if asks > 1 else 0)
    total = sum(values)
    total += math.copysign(marks, total) if total else 0
    return len(words), len(values), total / math.sqrt(total * total + 15)


TEXTS = [
    "good", "very good", "not good", "not very good", "never ever so good", "GOOD day", "GOOD", "good but bad", "bad but good", "good!!!", "good!!!!!!", "bad?? yes???",
    "", None, "   ", "nothing here", "the VERY good", "slightly bad", "not bad at all, great", "good good bad", "!!!", "é très good", "extremely really very good",
]


def test_valence_by_hand(spark):
    rng = random.Random(7)
    words = ["good", "Bad", "GREAT", "very", "Slightly", "NOT", "never", "but", "x", "y!", "(z)", "really?"]
    rows = list(enumerate(TEXTS + [" ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(300)]))
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    frame = spark.createDataFrame(rows, "id int, t string")
    for sent in (200_000, 0):  # sent to the tasks, or joined by shuffle
        valence.SENT_ROWS, before = sent, valence.SENT_ROWS
        got = {r.id: r for r in valence.score(frame, lexicon, "id", "t").collect()}
        valence.SENT_ROWS = before
        assert len(got) == len(rows)
        for i, text in rows:
            n, hits, compound = by_hand(text)
            assert (got[i].n_words, got[i].hits) == (n, hits), text
            assert got[i].compound == pytest.approx(compound, abs=1e-9), text
            assert got[i].label == ("positive" if compound >= 0.05 else "negative" if compound <= -0.05 else "neutral")
    assert got[12].neu == 1 and got[12].pos == 0 and got[13].label == "neutral"


def test_valence_of_each_rule(spark):
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    ask = ["good", "very good", "not good", "a GOOD day", "good!", "bad but good", "good but bad"]
    frame = spark.createDataFrame(list(enumerate(ask)), "id int, t string")
    c = {ask[r.id]: r.total for r in valence.score(frame, lexicon, "id", "t").collect()}
    assert c["good"] == 2 and c["very good"] == pytest.approx(2.293) and c["not good"] == pytest.approx(-1.48)
    assert c["a GOOD day"] == pytest.approx(2.733) and c["good!"] == pytest.approx(2.292)
    assert c["bad but good"] == pytest.approx(-2 * 0.5 + 2 * 1.5) and c["good but bad"] == pytest.approx(-2)


def test_valence_runs_without_python_workers(spark):
    lexicon = spark.createDataFrame([("a", 1.0)], "word string, valence double")
    plan = valence.score(spark.range(3).selectExpr("id", "'a b' t"), lexicon, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_articles_without_extraction_fall_back(spark):
    a = spark.createDataFrame([(1, "A good day", "great!"), (2, None, None), (3, "bad", "bad")], "article_id long, title string, body string").withColumn("src", F.lit("s"))
    given = spark.createDataFrame([(3, ["A", "B"], 0.1, "bullish", 0.9, "m", ["e"], "s", "long", 0.9)], articles.EXTRACTION)
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    done = articles.complete(a, given, lexicon)
    rows = articles.silver(done, a, ["src"]).collect()
    assert sorted((r.article_id, r.ticker, r.sentiment_label, r.src) for r in rows if r.article_id != 3) == [(1, None, "bullish", "s"), (2, None, "neutral", "s")]
    assert sorted(r.ticker for r in rows if r.article_id == 3) == ["A", "B"] and all(json.loads(r.key_entities) in ([], ["e"]) for r in rows)
    assert articles.relevant(articles.silver(done, a, []), 0.5).count() == 2
