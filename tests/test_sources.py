"""Pages by tokenizer against generated trees, feeds in document order, and models whose answers are kept."""

import html
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.html import DROPPED, LONGER, VOID, page_text, page_texts
from tidewatch.operators import classify
from tidewatch.sources import connectors


def generated(r, depth=0, dropped=False, paragraphs=None, outer=()):
    """A random page body as HTML; fills paragraphs with the texts that a reader of the tree would see, in order of their starts."""
    out = []
    for _ in range(r.randrange(1, 5)):
        kind = r.choice(["text", "text", "p", "div", "b", "void", "comment", "dropped", "stray"])
        if kind == "text" or depth > 4:
            text = r.choice(["plain words and more of them ", "a < b & c ", "é 😀 ", "x" * r.randrange(40), "5 &quot; "])
            out.append(html.escape(text) if r.random() < 0.8 else text.replace("<", "").replace("&", "and"))
            shown = html.unescape(out[-1])
            for p in () if dropped else outer:
                p.append(shown)
        elif kind == "comment":
            out.append("<!-- <p>not a paragraph, however long it may be in the page</p> -->")
        elif kind == "void":
            out.append(r.choice(["<br>", "<hr/>", '<img alt="<p>">']))
        elif kind == "stray":
            out.append(r.choice(["</section>", "</i>"]))
        elif kind == "dropped":
            tag = r.choice(["nav", "header", "footer", "aside"])
            out.append(f"<{tag} class='x'>" + generated(r, depth + 1, True, paragraphs, outer) + f"</{tag.upper()}>")
        elif kind == "p":
            mine = []
            if not dropped:
                paragraphs.append(mine)
            body = generated(r, depth + 1, dropped, paragraphs, (*outer, mine))
            # A p that isn't closed ends with the element around it.
            out.append(f"<div><p>{body}</div>" if r.random() < 0.3 else f"<P id=1>{body}</p>")
        else:
            out.append(f"<{kind}>" + generated(r, depth + 1, dropped, paragraphs, outer) + f"</{kind}>")
    return "".join(out)


def test_pages(spark):
    r, rows, want = random.Random(6), [], {}
    for i in range(300):
        paragraphs = []
        body = generated(r, paragraphs=paragraphs)
        rows.append((i, f"<!doctype html><html><head><title> T {i} &amp; é </title><script>var x = '<p>no';</script><style>p {{}}</style></head><body>{body}</body></html>"))
        texts = [t for t in ("".join(p).strip() for p in paragraphs) if len(t) > LONGER]
        whole = "\n\n".join(texts)
        want[i] = (f"T {i} & é", texts, whole) if len(whole) > 150 else ("", texts, "")
    got = {x["id"]: (x["title"], x["paragraphs"], x["full_text"]) for x in page_texts(spark.createDataFrame([*rows, (900, None), (901, "")], "id bigint, html string"), "id", "html").collect()}
    assert got == want | {900: ("", [], ""), 901: ("", [], "")}
    assert sum(bool(w[2]) for w in want.values()) > 15


def test_broken_and_long_pages():
    assert page_text("<p>" + "y" * 40 + "<p>" + "z" * 40)[1] == ["y" * 40 + "z" * 40, "z" * 40]
    assert page_text("<nav><p>" + "y" * 50)[1] == []
    assert page_text("</p></nav><p>" + "y" * 50 + "</p> <title>late</title><title>later</title>") == ("late", ["y" * 50])
    assert page_text("<p>" + "é" * 600_000)[1] == ["é" * ((512_000 - 3) // 2)]
    began = time.perf_counter()
    page_text("<p>some words of a paragraph</p><div>" * 12_000)
    assert time.perf_counter() - began < 20
    assert not DROPPED & VOID


def test_feeds(spark, tmp_path):
    item = lambda f, i: f"<item><title><![CDATA[F{f} & T{i}]]> - Pub</title><link>l{f}-{i}</link><pubDate>Thu, 13 Aug 2026 07:00:00 GMT</pubDate><description>&lt;b&gt;d</description></item>"
    for f in range(5):
        (tmp_path / f"f{f}.xml").write_text("<rss><channel><title>whole</title>" + "".join(item(f, i) for i in range(6)) + "</channel></rss>")
    (tmp_path / "f5.xml").write_text("<rss><channel>" + item(5, 0) + "<item><title>cut")
    (tmp_path / "f6.xml").write_text("")
    got = connectors.feed_items(spark, str(tmp_path)).repartition(4).orderBy("file", "position").collect()
    assert [r["link"] for r in got] == [f"l{f}-{i}" for f in range(5) for i in range(6)] + ["l5-0"]
    first = connectors.read_feed(spark, str(tmp_path), 8).collect()
    assert [(r["title"], r["link"]) for r in first] == [(f"F{f} & T{i}", f"l{f}-{i}") for f, i in [(0, i) for i in range(6)] + [(1, 0), (1, 1)]]
    assert first[0]["description"] == "<b>d" and str(first[0]["pub_date_clean"]) == "2026-08-13"


@pytest.mark.parametrize("wrong", ["raises", "too few"])
def test_answers_are_kept(spark, tmp_path, wrong):
    """A model that fails for some at first: two runs give all answers, what has been answered isn't asked again, equal contents are asked once."""
    log = str(tmp_path / "asked")

    def model(batch):
        with open(log, "a") as f:
            f.writelines(f"{x['shown_title']}\n" for x in batch)
        if any(x["shown_title"].endswith("7") for x in batch) and not (tmp_path / "second").exists():
            if wrong == "raises":
                raise ValueError("429 quota exceeded")
            return []
        return [{"is_ai_incident": x["shown_title"].endswith(("1", "7")), "confidence": 0.5, "rejection_reason": ""} for x in batch]

    df = spark.range(60).select("id", F.concat(F.lit("title "), (F.col("id") % 40).cast("string")).alias("title"), F.lit("same").alias("text"))
    store = str(tmp_path / "store")
    first = classify.gate(df, model, store).collect()
    failed = {r["title"] for r in first if r["error"] is not None}
    assert {f"title {i}" for i in (7, 17, 27, 37)} <= failed and all(r["is_ai_incident"] is None for r in first if r["error"] is not None)
    assert len(first) == 60 and all(r["is_ai_incident"] == (r["title"][-1] == "1") for r in first if r["error"] is None)
    (tmp_path / "second").touch()
    second = classify.gate(df, model, store).collect()
    assert all(r["error"] is None and r["is_ai_incident"] == (r["title"][-1] in "17") for r in second)
    asked = Counter(open(log).read().splitlines())
    assert asked == {f"title {i}": 2 if f"title {i}" in failed else 1 for i in range(40)}
    assert sorted(map(str, classify.gate(df, model, store).collect())) == sorted(map(str, second))
    assert Counter(open(log).read().splitlines()) == asked


def test_kept_extractions(spark, tmp_path):
    model = lambda batch: [{"harm_domain": "property", "confidence_scores": {"a": 0.5}, "geographic_scope": ["UK"], "unknown": 1} for _ in batch]
    df = spark.createDataFrame([(1, "t", "x", "old"), (2, None, None, None)], "id bigint, title string, text string, harm_domain string")
    got = classify.extract(df.select("id", F.col("title").alias("headline"), "text", "harm_domain"), model, str(tmp_path / "s")).orderBy("id").collect()
    assert [(r["harm_domain"], r["confidence_scores"], r["geographic_scope"], r["severity"]) for r in got] == [("property", {"a": 0.5}, ["UK"], None)] * 2
    same = lambda batch: [{"is_same_incident": True, "confidence": x["similarity"]} for x in batch]
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.2)], "id1 bigint, id2 bigint, similarity double")
    assert sorted((r["id2"], r["matched"]) for r in classify.verdicts(pairs, same, store=str(tmp_path / "v")).collect()) == [(2, True), (3, False)]


def test_jdbc(spark):
    url = "jdbc:derby:memory:reports;create=true"
    rows = spark.range(1000).selectExpr("cast(id as int) as id", "concat('t', id) as title", "id % 7 as n")
    rows.repartition(2).write.mode("overwrite").jdbc(url, "reports")
    whole = connectors.read_jdbc(spark, url, "reports", ["ID", "TITLE"], "ID", (0, 1000, 4))
    assert whole.columns == ["ID", "TITLE"] and whole.rdd.getNumPartitions() == 4
    assert {tuple(r) for r in whole.collect()} == {(i, f"t{i}") for i in range(1000)}
    assert connectors.read_jdbc(spark, url, "reports").count() == 1000
