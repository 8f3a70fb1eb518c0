"""Decontamination, URL filters, HTML, chat and personal data."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.llm import chat, decontaminate, html_text, pii, url_filter
from tracemill.llm.decontaminate import SuffixAutomaton, cut_spans, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


# ------------------------------------------------------------ decontamination


def brute_hits(words, items, window):
    hit, found = set(), set()
    for item_id, ws in items:
        k = min(window, len(ws))
        grams = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()
        for i in range(len(words) - k + 1) if k else ():
            if tuple(words[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(item_id)
    return hit, found


def test_automaton_against_brute_force():
    rng = random.Random(5)
    for window in (1, 2, 3, 4):
        for _ in range(150):
            items = [(str(i), [rng.choice("abcd").encode() for _ in range(rng.randint(0, 9))]) for i in range(rng.randint(0, 5))]
            words = [rng.choice("abcde").encode() for _ in range(rng.randint(0, 30))]
            a = SuffixAutomaton([(i, b" ".join(w)) for i, w in items], window)
            spans, found = a.scan(words)
            hit, want = brute_hits(words, items, window)
            assert {p for x, y in spans for p in range(x, y)} == hit
            assert found == want
            assert all(y < x2 for (_, y), (x2, _) in zip(spans, spans[1:], strict=False))


def test_report_of_odd_texts(spark):
    long = "x " * 5000 + "one two three four five six seven eight nine ten" + " y" * 5000
    docs = docs_of(spark, [None, "", "ONE two, three four-five six seven eight nine ten!", long, "a b c", "short ITEM here", "été 1"])
    items = spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten"), (2, "short item"), (3, None), (4, ""), (None, "été"), (1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(docs, items).collect()}
    assert [(got[i].n_words, got[i].n_hit, got[i].n_items) for i in range(7)] == [(0, 0, 0), (0, 0, 0), (10, 10, 1), (10010, 10, 1), (3, 0, 0), (3, 2, 1), (2, 1, 0)]
    assert got[6].contaminated and not got[4].contaminated
    assert got[2].items_sha256 == decontaminate.items_digest(["1"])
    # the same in chunks that each hold one item
    chunked = {r.doc_id: r for r in decontaminate.report(docs, items, max_chunk_words=1).collect()}
    assert chunked == got


def test_long_items_in_parts_and_repeated_rows(spark):
    words = [f"w{i % 97}x{i % 89}" for i in range(400)]
    docs = docs_of(spark, [" ".join(words[i : i + 9 + i % 4]) for i in range(0, 380, 7)] + ["q " + " ".join(words) + " q"] * 2 + [None])
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") < 20, F.col("doc_id")).otherwise(7)).withColumn("spans", F.lit("clash"))
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[100:130]))], "item_id long, text string")
    whole, parts = (Counter(map(tuple, decontaminate.report(docs, items, max_chunk_words=n).collect())) for n in (1000, 13))
    assert whole == parts and sum(whole.values()) == docs.count()
    odd = docs.withColumns({"_tm_x": F.lit(1), "row": F.lit(2), "_3": F.lit(3)})
    a, b = (decontaminate.remove(odd, items, max_chunk_words=n) for n in (1000, 13))
    assert a.columns == odd.columns and Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def test_empty_tables_and_removal(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    none = items.limit(0)
    docs = docs_of(spark, ["x1 x2 x3 x4 x5 x6 x7 x8 x9 y1 y2 y3 A b, c d e f g h i j k; tail", None, "clean text", "a b c d e f g h i j k"])
    assert decontaminate.report(docs.limit(0), items).count() == 0
    assert decontaminate.report(docs, none).filter("contaminated").count() == 0
    kept = {r.doc_id: r for r in decontaminate.remove(docs.withColumn("_extra", F.lit(1)), items).collect()}
    assert set(kept) == {0, 1, 2} and kept[1].text is None and kept[2].n_chars == 10
    assert "c d e" not in kept[0].text and kept[0].text.endswith("; tail") and kept[0].n_chars == len(kept[0].text)


def test_cut_spans():
    assert cut_spans("The a b c end", [1, 4], 1) == ("The  end", 3)
    assert cut_spans("aa a aa", [1, 2], 1)[0] == "aa  aa"
    assert cut_spans("a b", [0, 2], 3) == ("a b", 0)
    assert words_of("Éa-B_1".encode()) == ["Éa".encode(), b"b", b"1"]


# ------------------------------------------------------------ URLs


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme porn": ("", "", None, "block"),
        "http://A.Example.com/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://x.www.example.com/en/a": ("x.www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "http://myexample.com/en/": ("myexample.com", "/en/", "com/", "allow"), "http://example.com": ("example.com", "", None, "allow"),
        "https://casino-win.example.com/de/": ("casino-win.example.com", "/de/", "com/", "allow"), "https://cheap-pills.example.org/en/": ("cheap-pills.example.org", "/en/", None, "block"),
        "http://a.net/fr/": ("a.net", "/fr/", "net/fr/", "block"), "http://a.net/fr": ("a.net", "/fr", None, "allow"),
        "http://free.example.org/bets": ("free.example.org", "/bets", None, "block"), "http://free.example.org/alphabets": ("free.example.org", "/alphabets", None, "allow"),
        "http://free.org/free/free": ("free.org", "/free/free", None, "allow"), "http://essex.org/xxxl": ("essex.org", "/xxxl", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"), "http://h?x/y": ("h", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert url_filter.judge(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://a.org/" + "x" * 500_000 + "/porn"), (1, "http://a.org/" + "x/" * 100_000)], "page_id long, url string")
    assert sorted(r.verdict for r in url_filter.judge(long.union(long)).collect()) == ["allow", "allow", "block", "block"]
    assert {r.verdict for r in url_filter.judge(df, rules=()).collect()} == {"allow", "block"}


def test_longest_terms_and_weights():
    v = url_filter.Vocabulary(["bad"], {"a": 1.0, "a-b": 2.5, "b": 1.0, "c": 0.5, "b-bad-c": 1.0})
    assert v.count("x/a-b/c") == (0, {"a-b": 2.5, "c": 0.5}) and v.count("a/b/a-b") == (0, {"a": 1.0, "b": 1.0, "a-b": 2.5})
    assert v.count("b-bad-c") == (0, {"b-bad-c": 1.0}) and v.count("b.bad.BAD.cc") == (2, {"b": 1.0}) and v.count("") == v.count(None) == (0, {})


# ------------------------------------------------------------ HTML


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<div>a</div><div>b</div>", "a\nb"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
        ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a  | bbb\ncc | d"), ("<table><caption>T</caption><tr><th colspan=2>wide<tr><td>1<td>2</table>", "T\nwide\n1 | 2"),
        ("<pre>  x\n\n  y</pre>z", "  x\n\n  y\n\nz"), ("a<script>if (a<b) '</p>'</script>b", "ab"), ("a<!-- <b>x --> b", "a b"), ("a<!-- never closed", "a"),
        ("<div hidden>x</div><p style='display: NONE'>y</p><span style='visibility:hidden'>z<b style='visibility:visible'>w</b></span>", "w"),
        ("<head><title>t</title></head><body>b", "b"), ("1 < 2 <b>x</b", "1 < 2 x"), ("<a title='a>b'>x</a>", "x"), ("<dl><dt>k<dd>v</dl>", "k\n  v"), ("<b><p>x</b>y", "xy"),
        ("<select><option>a<option>b</select>", "a\nb"), ("<blockquote>q</blockquote>", "  q"), ("<a href=\"x>y", "y"), ("</p>x</div>", "x"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A | b\n  | c"), ("<p STYLE='VISIBILITY:hidden'>x<i style='Visibility : Visible'>y", "y"),
        ("<table><tr><td>a<td rowspan=0>bb<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a | bb | c\nd |    | e\nf |    | g".replace(" |    | ", "      | ")),
        ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c</table>", "a | b\nc"), ("<table><tr><td>a<br>b<td>c<br>d</table>", "a | c\nb | d"),
        ("<table><tr><td>x<table><tr><td>1<td>2</table><td>y</table>", "x\n\n1 | 2\n\ny"), ("<table><tr><td><td>b</table>", " | b"),
        ("<ul><li><p>a</p><p>b</p><li></ul>c", "- a\n\n  b\n\nc"), ("<blockquote><ul><li>x<pre>  y\n z</pre></ul></blockquote>", "  - x\n      y\n     z"),
        ("<div><div hidden>" + "<div>" * 200 + "</div>" * 200 + "secret</div>seen</div>", "seen"),
        ("<div>" * 130 + "<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a  | bbb\ncc | d"),
    ],
)
def test_html(html, text):
    assert html_text.render(html) == text


def test_html_deep_long_and_table(spark):
    deep = "<div>" * 20_000 + "core" + "</div>" * 20_000
    assert html_text.render(deep) == "core"
    assert len(html_text.render("<p>" + "word " * 100_000)) == 499_999
    assert html_text.render("<ul><li>" * 3000 + "x").strip("- ") == "x"
    for page in (
        "<table><tr><td>" + "w" * 24_000 + "".join(f"<tr><td>{i}<td>b" for i in range(2000)) + "</table>", "<ul><li>a" * 5000, "<table><tr><td>a" * 3000,
        "<table><tr>" + "<td rowspan=9999>a" * 2000 + "<tr><td>x" * 2000, "<table><tr>" + "<td colspan=999>a" * 2500, "<blockquote>a" * 4000,
        "<table><tr>" + "<td>a" * 4000 + "<td>" + "<br>b" * 4000, "<b>" * 8000 + "<div>" * 4000 + "</b>" * 8000, "<span>" * 9000 + "</i>" * 9000, "<pre>" * 4000 + "\n" * 20_000 + "x",
    ):
        assert len(html_text.render(page)) < 40 * len(page)
    df = spark.createDataFrame([(1, "<p>x", "clash"), (2, None, "clash")], "page_id long, html string, text string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {1: "x", 2: ""}
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_emits_all_text_of_random_trees():
    rng = random.Random(3)
    for _ in range(200):
        words, parts = [], []
        for i in range(rng.randint(1, 30)):
            tag = rng.choice("p div span b li ul ol table tr td h1 pre blockquote dd em".split())
            word = f"w{i}"
            words.append(word)
            parts.append(rng.choice((f"<{tag}> {word} ", f"<{tag}> {word} </{tag}>", f" {word} </{tag}>")))
        assert sorted(re.findall(r"w\d+", html_text.render("".join(parts)))) == sorted(words)


# ------------------------------------------------------------ chat


CALLS = "conv_id long, call_id string, seq long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, seq long, content string"


def test_linking_order_and_validation(spark):
    schema = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "maximum": 9}, "t": {"enum": ["x"]}}, "additionalProperties": False}}
    calls = spark.createDataFrame(
        [
            (1, "c1", 1, "add", '{"a": 1}', ["c3"]), (1, "c2", 2, "add", '{"a": 10}', ["c1"]), (1, "c3", 3, "add", '{"t":"x","a":2}', []), (1, "c4", 4, "add", "[1]", None),
            (1, "c5", 5, "nope", "{}", ["missing"]), (1, "c6", 6, "add", "{oops", []), (2, "c1", 1, "add", '{"b":1}', ["c2"]), (2, "c2", 2, "add", '{"a":1,"z":2}', ["c1"]),
            (1, "c1", 9, "add", '{"a": 5}', []), (None, "c1", 1, "add", "{}", []), (3, None, 1, "add", "{}", []), (2, "c9", 3, "add", None, []),
        ],
        CALLS,
    )
    results = spark.createDataFrame([(1, "c1", 2, "ü\n"), (1, "c1", 8, "later"), (1, "c9", 2, "orphan"), (2, "c2", 1, None)], RESULTS)
    rows = chat.link(calls, results, schema).collect()
    one = sorted((r for r in rows if r.conv_id == 1), key=lambda r: (r.ready, r.wait, r.seq))
    assert [r.call_id for r in one] == ["c3", "c1", "c2", "c4", "c5", "c6"] and all(r.ordered for r in one)
    by = {(r.conv_id, r.call_id): r for r in rows}
    assert len(rows) == len(by) == 9
    assert {k: r.error for k, r in by.items()} == {
        (1, "c1"): None, (1, "c2"): "$.a: out of bounds", (1, "c3"): None, (1, "c4"): "$: not object", (1, "c5"): "unknown tool", (1, "c6"): "not JSON",
        (2, "c1"): "$.a: missing", (2, "c2"): "$.z: unknown", (2, "c9"): "$: not object",
    }
    assert by[1, "c1"].record == '{"arguments":{"a":1},"id":"c1","name":"add","result":"ü\\n"}' and by[1, "c1"].linked
    assert not by[1, "c2"].linked and by[2, "c2"].linked and not by[2, "c1"].ordered and not by[2, "c2"].ordered and by[2, "c9"].ordered
    assert chat.link(calls.limit(0), results, schema).count() == 0
    assert {r.linked for r in chat.link(calls.withColumn("ready", F.lit("clash")), results.limit(0), schema).collect()} == {False}


def plain_order(calls):
    """ready, wait, ordered of (id, seq, needs) by relaxation; what a cycle feeds is not ordered."""
    seq = {i: s for i, s, _ in calls}
    needs = {i: {d for d in ds if d in seq} for i, _, ds in calls}
    done, left = {}, set(seq)
    while free := {i for i in left if needs[i] <= done.keys()}:
        for i in free:
            done[i] = max([(seq[i], 0), *((done[d][0], done[d][1] + 1) for d in needs[i])])
        left -= free
    return {i: (*done[i], True) if i in done else (seq[i], 0, False) for i in seq}


def test_order_against_brute_force(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for conv in range(25):
        n = rng.randint(1, 14)
        calls = [(f"c{i}", rng.randint(1, n), [f"c{j}" for j in rng.sample(range(n + 1), min(n, rng.choice((0, 0, 1, 1, 2)))) if conv % 3 or j > i]) for i in range(n)]
        rows += [(conv, i, s, "t", "{}", d) for i, s, d in calls]
        want |= {(conv, i): v for i, v in plain_order(calls).items()}
    # a log in reverse order
    chain = [(f"c{i}", i, [f"c{i + 1}"]) for i in range(150)]
    rows += [(99, i, s, "t", "{}", d) for i, s, d in chain]
    want |= {(99, i): v for i, v in plain_order(chain).items()}
    got = chat._ordered(spark.createDataFrame(rows, CALLS)).collect()
    assert {(r.conv_id, r.call_id): (r.ready, r.wait, r.ordered) for r in got} == want
    assert {r.ordered for r in got} == {True, False}


def test_odd_arguments(spark):
    deep, long = "[" * 101 + "]" * 101, json.dumps({"a": "é " * 100_000}, ensure_ascii=False)
    texts = ['{"a":"\\ud800"}', '{"a":NaN}', '{"a":1e999}', f'{{"a":{deep}}}', '{"a":[1.0,1e21,-0.0,1.5e-5,1e-7,"[[["]}', long, "", '{"a":1,"a":2}', "{" * 50_000]
    calls = spark.createDataFrame([(1, f"c{i}", i, "t", t, None) for i, t in enumerate(texts)], CALLS)
    got = {r.seq: r for r in chat.link(calls, spark.createDataFrame([], RESULTS), {"t": {}}).collect()}
    assert [got[i].error for i in range(len(texts))] == [None, "not JSON", "not JSON", "not JSON", None, None, "not JSON", None, "not JSON"]
    assert '{"a":"\\ud800"}' in got[0].record and '{"a":[1,1e+21,0,0.000015,1e-7,"[[["]}' in got[4].record and '{"a":2}' in got[7].record
    assert all(json.loads(r.record)["id"] == r.call_id for r in got.values()) and json.loads(got[5].record)["arguments"] == json.loads(long)


def test_canonical_is_stable():
    value = {"b": [1, {"z": None, "a": "é"}], "a": 1.5}
    assert json.loads(chat.canonical(value)) == value
    assert chat.canonical(value) == '{"a":1.5,"b":[1,{"a":"é","z":null}]}'


# ------------------------------------------------------------ personal data


def plain_spans(text):
    """The fixed patterns, as they are written."""
    digits = pii._digits
    ok = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if check(m[0])] for k, (p, check) in ok.items()}


def test_base_spans_against_plain_patterns():
    rng = random.Random(9)
    alphabet = ["a", "é", "@", ".", "-", " ", "+", "(", ")", "1", "4", "23", "255", "x.y", "4111111111111111", "%", "_", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_spans_of_the_tables(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert pii.base_spans(r.text) == plain_spans(r.text)


def test_pii_report_and_redaction(spark):
    texts = [None, "", "mail bob@example.com now", "server 10.0.0.256 and 192.168.10.20", "card 4111 1111 1111 1111 paid", "call +1 (269) 555-3296 4524132264652876 now", "Version 2.0. page 12", "x" * 50_000 + " a@b.co"]
    docs = docs_of(spark, texts * 3).withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert [(got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) for i in range(8)] == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0)]
    assert got[2].spans == "email:5:20" and "ip:22:35" in got[3].spans and got[7].spans == "email:50001:50007" and got[6].spans == ""
    masked = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert masked[2].text == "mail <EMAIL> now" and masked[2].n_chars == 16 and masked[0].text is None and masked[6].text == texts[6]
    assert pii.report(docs.limit(0)).count() == 0
    odd = docs.withColumns({"_1": F.lit(1), "new": F.lit(2)}).withColumn("doc_id", F.lit(None).cast("long"))
    assert pii.redact(odd).columns == odd.columns and Counter(r.text for r in pii.redact(odd.union(odd)).collect()) == Counter([m.text for m in masked.values()] * 2)


def test_work_on_a_text_grows_with_its_spans():
    import time

    model = pii.Model({k: [5.0] + [0.0] * 15 + [3.0] for k in pii.KINDS}, {})
    model.weights = {k: pii.np.array(w + [0.0] * (len(pii._row((0,) * 6, 0)) - len(w))) for k, w in model.weights.items()}

    def took(n):
        text = " ".join(f"user{i}@host{i}.com 192.168.{i % 256}.7 visit a{i} (at) b.org call 555-{i:04d}-1234" for i in range(n)).encode()
        begun = time.process_time()
        _, _, every = pii.spans_of(text, model)
        assert len(every) > 2 * n
        return time.process_time() - begun

    took(100)
    assert took(8000) < 30 * took(800)


def test_added_spans_overlap_nothing():
    rng = random.Random(3)
    for _ in range(300):
        spans, taken, held = [], pii._Taken(), []
        for _ in range(60):
            a = rng.randint(0, 3000)
            b = a + rng.randint(1, 700)
            meets = any(x < b and a < y for x, y in held)
            assert taken.meets(a, b) == meets
            if not meets:
                taken.add(a, b)
                held.append((a, b))
            spans.append((a, b))
        fixed = pii._Spans(spans[:10])
        assert all(fixed.meets(a, b) == any(x < b and a < y for x, y in spans[:10]) for a, b in spans)


def test_em_finds_the_good_labelers():
    import numpy as np

    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.9, truth, ~truth)
    also = np.where(rng.random(4000) < 0.8, truth, ~truth)
    noise = rng.random(4000) < 0.5
    votes = np.stack([good, also, good ^ (rng.random(4000) < 0.1), noise], axis=1) * 2 - 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, table = pii.em(patterns, counts.astype(float))
    found = {tuple(p): q for p, q in zip(patterns, post, strict=True)}
    assert np.mean([(found[tuple(v)] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.85
    assert table[1, 0, 2] > 0.8 and abs(table[1, 3, 2] - 0.5) < 0.1
