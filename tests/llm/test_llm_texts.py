"""Toxicity, secrets, main text and chat formatting."""

import hashlib
import random
import re

import numpy as np
import pytest
from rankmill.llm import chat, main_text, secrets, toxicity
from rankmill.session import scratch_path

EXTRA = "lang string, score double, spans string, id bigint, label int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, "x", 1, 2) for i, t in rows], f"doc_id bigint, text string, {EXTRA}")


def toxic_rows(seed=1, count=400):
    draw = random.Random(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    bad = ["vilex", "grubby", "scorn"]
    rows = []
    for i in range(count):
        lines = [[draw.choice(words) for _ in range(draw.randint(3, 9))] for _ in range(draw.randint(1, 12))]
        label = int(draw.random() < 0.25)
        if label:
            line = draw.choice(lines)
            line.insert(draw.randint(0, len(line)), draw.choice(bad))
        rows.append((i, ". ".join(" ".join(x) for x in lines) + ".", label))
    return rows, bad


def test_toxicity_finds_documents_and_sentences(spark):
    rows, bad = toxic_rows()
    docs = docs_of(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id bigint, toxic int")
    model = toxicity.trained(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    for i, text, label in rows:
        assert (got[i].score >= 0.5) == bool(label)
        spans = [text[s.start : s.end] for s in got[i].offending]
        assert bool(spans) == bool(label) and all(any(b in s for b in bad) for s in spans)
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == sum(1 - y for _, _, y in rows)


def test_toxicity_noisy_or():
    model = toxicity.Model(-2.0, {"bad": 3.0, "ba-": 0.5})
    p = [model.sentence(x) for x in ((), ("bad",), ("ba-", "bad"))]
    score, found = toxicity.score(model, "Fine here. A BAD one! Badly bad.\nFine")
    assert [(a, b) for a, b, _ in found] == [(10, 21), (21, 33)]
    one, two = found[0][2], found[1][2]
    assert one == pytest.approx(p[1]) and two == pytest.approx(model.sentence(["bad", "bad-", "ba-"]) if "bad-" in model.weights else p[1])
    assert score == pytest.approx(1 - (1 - p[0]) * (1 - one) * (1 - two))  # one leak, whatever says nothing
    assert toxicity.score(model, None)[0] == toxicity.score(model, "")[0] == pytest.approx(p[0])
    assert 0 <= toxicity.score(model, "bad. " * 50_000)[0] <= 1


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)], [(1, None), (None, 1), (99, 1)]])
def test_toxicity_without_both_labels(spark, labels):
    docs = docs_of(spark, [(1, "a b"), (2, None), (None, "c"), (1, "a b")])
    model = toxicity.trained(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1


def test_toxicity_gradient():
    """The slope used for fitting is that of the likelihood."""
    bags = [(1, [([0], 1), ([1, 2], 2)]), (0, [([2], 1)]), (0, []), (1, [([1], 3)])]
    words = ["a", "b", "c"]
    model = toxicity.fitted(bags * 20, words, rounds=400)

    def loss(w, bias, leak):
        total = 0.0
        for y, held in bags:
            sigma = lambda z: 1 / (1 + np.exp(-z))
            q = (1 - sigma(leak)) * np.prod([(1 - sigma(bias + sum(w[i] for i in s))) ** n for s, n in held])
            total += np.log(1 - q) if y else np.log(q)
        return -20 * total + toxicity.PENALTY / 2 * sum(x * x for x in w)

    best = [*(model.weights.get(x, 0.0) for x in words), model.bias, model.leak]
    here = loss(best[:3], *best[3:])
    for k in range(5):
        for step in (-0.2, 0.2):
            other = list(best)
            other[k] = min(-0.5, best[k] + step) if k > 2 else best[k] + step
            assert loss(other[:3], *other[3:]) >= here - 0.05


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows, bad = toxic_rows()
    docs = docs_of(spark, [(i, t) for i, t, _ in rows])
    return rows, bad, toxicity.trained(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))


def test_toxicity_does_not_grow_with_length(toxic_model):
    """Clean sentences by the hundred thousand stay below one half; one offending sentence among them is found."""
    rows, bad, model = toxic_model
    clean = " ".join(t for _, t, y in rows if not y)
    long = (clean + " ") * (100_000 // clean.count(".") + 1)
    assert long.count(".") >= 100_000 and toxicity.score(model, long)[0] < 0.5
    assert toxicity.score(model, "The committee met on Tuesday. " * 100_000)[0] < 0.5
    at = len(long) // 2
    score, found = toxicity.score(model, f"{long[:at]}. wab {bad[0]} wcd. {long[at:]}")
    assert score >= 0.5 and [bad[0] in f"{long[:at]}. wab {bad[0]} wcd. {long[at:]}"[a:b] for a, b, p in found if p >= 0.5] == [True]


def test_toxicity_score_against_plain_sentences(toxic_model):
    """The score as its definition says it, without the finder and its memory."""
    rows, _, model = toxic_model
    for _, text, _ in rows:
        left = 1 - model.base()
        for part in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", text):
            words = set(re.findall(r"[^\W\d_]+", part.lower()))
            logits = [model.weights[f] for f in {*words, *(f"{w[:n]}-" for w in words for n in range(3, 10) if n < len(w))} if f in model.weights]
            p = 1 / (1 + np.exp(-(model.bias + sum(logits))))
            if logits and p >= toxicity.FAINT:
                left *= 1 - p
        assert toxicity.score(model, text)[0] == pytest.approx(1 - left)


def plain_findings(text):
    kinds = {
        "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    }
    found = []
    for n, (kind, (pattern, keep)) in enumerate(kinds.items()):
        found += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text) if keep(m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def secret_texts():
    draw = random.Random(9)
    parts = ["password", "PassWD", "tokeN", "api_key", "apikey", "secret", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "abc", "abcdefgh",
             "0123456789abcdef", "0123456789abcdef" * 2, "AKIA", "AKIAABCDEFGHIJ", "ABCDEFGH12", "é", "\n", "-", "."]
    return ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(1500)]


def test_base_secrets_equal_plain_patterns():
    kinds = ("assign", "access", "hex")
    for text in [*secret_texts(), "password: token: abcdefgh123", "x" * 10**6 + " token = abcdefghi"]:
        got = [s for s in secrets.findings(text, secrets.RULES) if s[0] in kinds]
        assert got == plain_findings(text)


def test_ledger_scans_each_blob_and_rule_once(spark):
    ledger = scratch_path(spark, "ledger")
    texts = ["token = abcdefgh1", None, "", "plain", "https://u:p4ss@host/x", "token = abcdefgh1"]
    first = docs_of(spark, list(enumerate(texts)))
    rules = secrets.RULES[:3]
    got = {r.doc_id: r for r in secrets.scanned(first, ledger, ["doc_id", "lang"], rules=rules).collect()}
    assert {i for i, r in got.items() if r.spans} == {0, 5} and got[1].sha256 == got[2].sha256
    assert spark.read.parquet(ledger).count() == 4
    secrets.scan_new(first, ledger, rules=rules)
    assert spark.read.parquet(ledger).count() == 4
    # A new rule runs alone; a new version of a rule replaces what the old one found.
    more = (*rules[1:], secrets.Rule("assign", 2, r"token = \w+"), secrets.RULES[4])
    again = {r.doc_id: r for r in secrets.scanned(first, ledger, ["doc_id"], rules=more).collect()}
    assert [tuple(s) for s in again[5].spans] == [("assign", 0, 17)]
    assert [s.kind for s in again[4].spans] == ["url_login"]
    added = [sorted(r.scanned) for r in spark.read.parquet(ledger).collect() if "assign@2" in r.scanned]
    assert added == [["assign@2", "url_login@2"]] * 4
    empty = scratch_path(spark, "ledger")
    assert secrets.scanned(first.limit(0), empty, ["doc_id"]).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies, as everybody does, and this text is rather long, longer than the article.</p></div>
<div class="layout"><aside><p>Popular, other, things, that are here, and long enough to earn points.</p></aside>
<div class="content"><h1>Head &amp; tail</h1><p>First,&nbsp; text
   here<br>and <b>there.<p>Second <a href="x">link</a> &#233; &lt;b&gt;.</p><!-- <p>no</p> -->
<div class="share"><a href="t">Tweet</a></div><ul><li>One</li><li>Two</li></ul><ul><li><a href="1">More like this</a></li></ul>
<form><p>Sign up</p></form></div></div>
<section id="comments"><article class="comment"><p>Great, really, a long comment, with, many, commas, so, that it scores well.</p></article></section>
<footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert main_text.main_text(PAGE) == "Head & tail\nFirst, text here and there.\nSecond link é <b>.\nOne\nTwo"
    for page in (None, "", "<script>x</script>", "<nav>menu</nav>", "<p> </p>"):
        assert main_text.main_text(page) == ""
    assert main_text.main_text("<p>a<p>b") == "a\nb"
    assert main_text.main_text("plain &lt; text") == "plain < text"
    assert main_text.main_text("<div>" * 5000 + "<p>deep</p>") == "deep"
    long = "<article>" + "".join(f"<p>para {i}, words</p>" for i in range(5000)) + "</article>"
    assert main_text.main_text(long).count("\n") == 4999


def test_main_text_rows(spark):
    rows = [(1, "<p>a, b</p>", "x"), (1, "<p>a, b</p>", "x"), (None, None, None)]
    got = main_text.extracted(spark.createDataFrame(rows, "page_id bigint, html string, url string")).collect()
    assert sorted(r.text for r in got) == ["", "a, b", "a, b"]
    assert main_text.extracted(spark.createDataFrame([], "page_id bigint, html string")).count() == 0


PIECES = ["\\", "#", "##", "###", "### ", "</turn>", "<", "/turn>", "\n", ":", "a", "Assistant:", "\n</turn>\n", "", "ü", "\\#", "😀"]


def test_chat_round_trip():
    draw = random.Random(1)
    for _ in range(3000):
        pick = lambda most: "".join(draw.choices(PIECES, k=draw.randint(0, most)))
        turns = [(pick(3), pick(8)) for _ in range(draw.randint(1, 6))]
        whole = chat.turn_template(turns)
        assert chat.read_back(whole) == turns
        renderer, out = chat.Renderer(chat.turn_template, 3), ""
        for turn in turns:
            piece = renderer.add(*turn)
            assert not piece.rewrites and chat.unescaped(piece.added[piece.text_start : piece.text_end]) == turn[1]
            out += piece.added
        assert out == whole


def forgetful(turns):
    """Drops what is in brackets from all turns but the last."""
    return "".join(f"<{r}>{t if i == len(turns) - 1 else re.sub(r'\[.*?\]', '', t)}" for i, (r, t) in enumerate(turns))


def counting(turns):
    return "".join(f"{i}:{r}:{t};" for i, (r, t) in enumerate(turns))


def test_chat_detects_rewriting():
    def flags(template, turns, window=chat.WINDOW):
        renderer = chat.Renderer(template, window)
        return [renderer.add(*t).rewrites for t in turns]

    assert flags(forgetful, [("a", "x"), ("b", "[y] z"), ("a", "u"), ("b", "v")]) == [False, False, True, False]
    assert flags(counting, [("a", "x")] * 4) == [False] * 4
    assert any(flags(counting, [("a", "x")] * 6, 3))


def headed(turns):
    """Append-only behind a leading marker."""
    return "<s>" + "".join(f"[{r}]{t}" for r, t in turns)


def last_forty(turns):
    return "".join(f"[{r}]{t}" for r, t in turns[-40:])


def test_chat_renders_true_prefixes():
    """A hundred turns: a marker at the start is no rewriting, and dropping the first of more than forty turns is."""
    turns = [("ab"[i % 2], f"t{i}") for i in range(100)]
    for template, want in ((headed, []), (last_forty, list(range(40, 100)))):
        renderer = chat.Renderer(template)
        assert [i for i, t in enumerate(turns) if renderer.add(*t).rewrites] == want


def test_long_secrets_are_found_whole():
    login = "see x9-9https://" + "u" * 300 + ":" + "p" * 5000 + "@host"
    key = "-----BEGIN " + "VERY LONG " * 20 + "PRIVATE KEY-----"
    found = {k: login[a:b] for k, a, b in secrets.findings(login, secrets.RULES)}
    assert found["url_login"] == login[len("see ") : -len("host")]
    assert secrets.findings(key, secrets.RULES) == [("private_key", 0, len(key))]
    assert secrets.findings("a1" * 500_000 + "://" + "x" * 500_000, secrets.RULES[3:]) == []


def test_chat_rows(spark):
    hostile = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", hostile), (1, 0, "user", hostile), (2, 0, "user", None), (2, 0, "user", None), (None, 5, None, "x"),
            (None, None, "assistant", "first"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i} " * 3) for i in range(100)] + [(8, 0, "assistant", "long " * 100_000)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, id int, piece string")
    pieces = chat.formatted(frame)
    got = {r.conv_id: r for r in chat.digests(pieces).collect()}
    groups = {}
    for row in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        groups.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    assert set(got) == set(groups)
    for own, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[own].n_turns == len(turns) and not got[own].rewrites
        assert got[own].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[own].loss_chars, got[own].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[own].formatted_chars == len(chat.turn_template(turns))
    assert chat.digests(chat.formatted(frame.limit(0))).count() == 0


def test_main_text_of_deep_pages():
    for tag in ("div", "blockquote", "div class='ad'", "section", "figcaption"):
        assert main_text.main_text(f"<{tag}>" * 50_000 + "some text, here") == ("" if "ad" in tag else "some text, here")


def test_main_text_keeps_the_article_whole():
    page = """<article><p>A long first paragraph, with commas, and words enough to be the article of this page.</p>
    <ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul><div><a href=3>A linked sentence.</a></div>
    <p class="popular-quote">So it is.</p><div class="notice-period">Three months.</div><div class="cookie-bar">We use cookies.</div></article>"""
    assert main_text.main_text(page).split("\n")[1:] == ["First source", "Second source", "A linked sentence.", "So it is.", "Three months."]
    split = "<div><div><p>" + "Many words, and commas, in the long part of the text. " * 9 + "</p></div><div><p>Short end.</p></div><div><a href=1>More</a></div></div>"
    assert main_text.main_text(split).split("\n")[1:] == ["Short end."]


def test_main_text_points_equal_naive_sums():
    """Lengths, links and points of random trees, each summed anew from its definition."""
    draw = random.Random(7)
    tags = ["div", "p", "a", "b", "li", "td", "section", "blockquote", "span"]

    def markup(depth):
        if depth == 0 or draw.random() < 0.3:
            return draw.choice(["one, two", "three", " ", "four, five, six"])
        tag = draw.choice(tags)
        return f"<{tag}>" + "".join(markup(depth - 1) for _ in range(draw.randint(0, 4))) + f"</{tag}>"

    for _ in range(200):
        order = main_text._pruned(main_text.parsed("".join(markup(6) for _ in range(3))))
        main_text._measured(order)
        inside = lambda n: [y for x in n.parts if not isinstance(x, str) for y in [x, *inside(x)]]
        strings = lambda n: [x for m in [n, *inside(n)] for x in m.parts if isinstance(x, str)]
        size = lambda n: sum(len(" ".join(x.split())) for x in strings(n))
        points = dict.fromkeys(map(id, order), 0.0)
        for node in order:
            anchors = [x for x in [node, *inside(node)] if x.tag == "a"]
            linked = sum(size(x) for x in anchors if not any(x in inside(y) for y in anchors))
            assert (node.length, node.linked) == (size(node), linked)
            own = [x for x in node.parts if isinstance(x, str)]
            loose = node.tag in ("div", "section") and any(x.strip() for x in own)
            boxed = node.tag in ("td", "li", "blockquote") and any(not isinstance(x, str) and x.tag in main_text.BLOCKS for x in node.parts)
            if not size(node) or boxed or not (loose or node.tag in main_text.PARAGRAPHS):
                continue
            text = "".join(own) if loose else "".join(strings(node))
            earned = (1 + text.count(",") + (len(text) if loose else size(node)) / 100) * (1 - linked / size(node))
            above = node if loose else node.parent
            for weight in [1, 1 / 2, *(1 / (3 * k) for k in range(2, main_text.REACH))]:
                if above is not None:
                    points[id(above)] += earned * weight
                    above = above.parent
        assert [n.points for n in order] == pytest.approx([points[id(n)] for n in order])


def test_toxicity_bags_reach_the_driver_packed(spark):
    words = ["bad", "worse"]
    rows = spark.createDataFrame([("A bad day. Worse, bad! A bad one. Fine.", 1), ("", 0)], "text string, label int")
    got = {r["label"]: bytes(r["bag"]) for r in toxicity._bags(rows, words).collect()}
    assert got == dict(toxicity.packed([(1, [([0], 2), ([0, 1], 1)]), (0, [])]))
