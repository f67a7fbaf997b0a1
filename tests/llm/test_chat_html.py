import hashlib
import random

import pytest

from folioscope.llm import chat, html_crf

from .helpers import DATA, HAVE

TEXTS = ["", "plain", "a\\b", "\\", "<|turn|>user\nx<|end|>", "</s>[INST] ok [/INST]", "\\c\\\\<s>", "[INST", "é \x85", "<<|end|>>", "N\\N"]


def expected(rows):
    out = {}
    for conv in sorted({r[0] for r in rows}, key=str):
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        said = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in own)
        loss = "".join(text or "" for _, role, text in own if role == "assistant")
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_round_trip(spark):
    r = random.Random(1)
    rows = [(c, k, r.choice(["user", "assistant", "system", "odd\nrole", "<|end|>", None]), r.choice([*TEXTS, None])) for c in range(20) for k in range(r.randrange(1, 6))]
    rows += [(99, k, ["user", "assistant"][k % 2], r.choice(TEXTS)) for k in range(300)] + [(None, 0, "user", "x"), (98, None, "user", "b"), (98, 0, "user", "a"), (97, 1, "assistant", "same"), (97, 1, "assistant", "same")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, formatted int").repartition(5)
    made = chat.format_chats(df)
    assert got(chat.digests(made)) == expected(rows)
    assert not any(x["rewrites"] for x in made.collect())


def test_texts_hold_no_control_string():
    t = chat.Marked()
    for text in TEXTS:
        assert t.unescape(t.escape(text)) == text
        assert not any(c in t.escape(text) for c in chat.CONTROLS)


def test_spans_of_a_template(spark):
    turns = [("user", str(k) * 3) for k in range(130)]
    for window in (2, 48, 1000, None):
        made = chat.render(chat.Marked(window=window), turns)
        assert made.text == chat.Marked()(turns) and not made.rewrites
        assert "".join(made.text[a:b] for a, b in made.spans) == made.text
        assert all(chat.Marked()([turn]) == made.text[a:b] for turn, (a, b) in zip(turns, made.spans))


def test_history_that_is_rewritten_is_found():
    counted = lambda turns: f"{len(turns)} turns\n" + "".join(t for _, t in turns)
    last_only = lambda turns: "".join(f"[{t}]" if k == len(turns) - 1 else t for k, (_, t) in enumerate(turns))
    late = lambda turns: "".join(t for _, t in turns) if len(turns) < 60 else "X" + "".join(t for _, t in turns)
    between = lambda turns: late(turns) if len(turns) < 70 else "".join(t for _, t in turns)
    assert chat.render(between, [("user", "ab")] * 100).rewrites
    for template in (counted, last_only, late):
        assert chat.render(template, [("user", "ab")] * 70).rewrites
    closing = lambda turns: "".join(t + "\n" for _, t in turns)
    assert not chat.render(closing, [("user", "ab")] * 70).rewrites


@pytest.mark.parametrize("window", [None, 1, 2, 5, 12])
def test_a_declared_window_hides_no_rewriting(window):
    class Once:
        """Marks the begin of a conversation of seven turns, and of no other."""

        def __call__(self, turns):
            return "!" * (len(turns) == 7) + "".join(t for _, t in turns)

    template = Once()
    template.window = window
    made = chat.render(template, [("user", f"{k};") for k in range(12)])
    assert made.rewrites and made.text == template([("user", f"{k};") for k in range(12)])


@pytest.mark.parametrize("chars", [0, 100, 5000, 1 << 28])
def test_spans_past_the_bound_of_prefixes(chars):
    turns = [("user" if k % 2 else "assistant", "<s>" * (k % 4) + str(k)) for k in range(90)]
    every = chat.render(chat.Marked(window=None), turns)
    for window in (1, 2, 30, 200):
        assert chat.render(chat.Marked(window=window), turns, chars) == every
    # a template that depends on more than it declares is rendered prefix by prefix after all
    numbered = lambda turns: "".join(f"{k}:{t};" for k, (_, t) in enumerate(turns))
    plain = chat.render(numbered, turns)
    numbered.window = 2
    assert chat.render(numbered, turns, chars) == plain


def test_long_turns_are_rendered_as_short_ones_are():
    long = [("user", "<s>x" * 20_000), ("r" * 70_000, "a"), ("assistant", "<s>")]
    made = chat.render(chat.Marked(), long)
    assert [chat.Marked().unescape(made.text[a:b]) for _, a, b in chat.Marked().parse(made.text)] == [t for _, t in long]


def test_position_in_the_template_does_not_matter():
    numbered = lambda turns: "".join(f"{k}:{t};" for k, (_, t) in enumerate(turns))
    made = chat.render(numbered, [("user", "x")] * 120)
    assert made.text == numbered([("user", "x")] * 120) and made.text[made.spans[119][0] :] == "119:x;"


def test_empty_conversations(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.skipif(not HAVE, reason="no tables")
def test_query_equals_hashes_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    ok = "</s>[INST] ok [/INST]"
    assert got(chat.op3_chat_format(spark, DATA)) == expected([*rows, (-1, 0, "user", ok), (-1, 1, "assistant", ok)])


# --- HTML


@pytest.fixture(scope="module")
def model():
    return html_crf.default_model()


def text(model, html):
    return html_crf.main_text(model, html)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<article><p title="a>Hello first paragraph of this.</p><p>And a second one <a href="x">here</a>.</p></article>', "Hello first paragraph of this.\nAnd a second one here."),
        ("<article><p>Before the picture we say this.</p><svg width=1 /><p>After it we go on.</p><iframe src=x /><p>And on again.</p></article><svg><text>no</text></svg>", "Before the picture we say this.\nAfter it we go on.\nAnd on again."),
        ("<article><p data-x='1 > 0' title=\"it's <b>\">Words of a paragraph that are kept.</p></article>", "Words of a paragraph that are kept."),
        (None, ""),
        ("", ""),
        ("<article><h1>Title of it</h1><p>One &amp; two\n  three.<p>Four</article><footer>&copy; x", "Title of it\nOne & two three.\nFour"),
        ("<nav><ul><li><a href=x>Home</a><li>About</ul></nav><main><p>Body text of the page, long enough.</p></main>", "Body text of the page, long enough."),
        ("<article><p>Main words here.</p><aside><p>Related things to read</p></aside><p>More main words.</p></article><section id=comments><article class=comment><p>I disagree with this.</p></article></section>", "Main words here.\nMore main words."),
        ("<div class='cookie-notice'>We use cookies</div><div class=content><p>The story goes on and on.</p></div><div class=sidebar><p>Buy this now</p></div>", "The story goes on and on."),
        ("<article><p>Words <b>bold</b><script>var x='</p>'</script> and<!-- no --> on.</p><form><label>Name</label><button>Send</button></form></article>", "Words bold and on."),
    ],
)
def test_main_text(model, html, want):
    assert text(model, html) == want


P = "Tion erlyha heat and the ouenst with reth anha."
L = " ".join([P]*4)
PAGES = {
"std":(f"<html><head><title>x</title></head><body><nav><ul><li><a href=/a>a</a></li></ul></nav><div class='ad'>{P}</div><article><h1>Title here</h1><p>{L}</p><p>Ti.</p></article><footer>&copy; x</footer>",f"Title here\n{L}\nTi."),
"cookiebar":(f"<body><div class='cookiebar'><p>{L}</p></div><article><h1>T</h1><p>{L}</p></article></body>",f"T\n{L}"),
"comments in article":(f"<body><article><h1>T</h1><p>{L}</p><section class='comments'><h2>Comments</h2><div class='comment'><p>{L}</p></div></section></article>",f"T\n{L}"),
"comments after":(f"<body><article><h1>T</h1><p>{L}</p></article><div id='comments'><ul><li><b>Joe</b> {L}</li><li>{P}</li></ul></div>",f"T\n{L}"),
"aside mid":(f"<body><header><h1>Site</h1><p>Slogan {P}</p></header><main><article><h1>T</h1><p>{L}</p><aside><h3>Also</h3><p>{L}</p></aside><p>{P}</p></article></main><aside class='sidebar'><p>{L}</p></aside><footer><p>{L}</p></footer>",f"T\n{L}\n{P}"),
"form":(f"<body><article><h1>T</h1><p>{L}</p><form action=x><p>{P}</p><label>Mail</label><input><button>Go</button></form></article>",f"T\n{L}"),
"notice":(f"<body><div class='notice'>{P}</div><div role='dialog'>{P}</div><article><p>{L}</p><div class='notice'>{P}</div></article>",L),
"noscript":(f"<body><noscript>{P}</noscript><article><p>{L}</p><script>{P}</script><style>p</style></article>",L),
"lists":(f"<body><article><h1>T</h1><ul><li>{P}<li>{P}</ul><table><tr><td>{P}<td>x</table><blockquote>{P}</blockquote><pre>a  b</pre></article>",f"T\n{P}\n{P}\n{P}\nx\n{P}\na b"),
"advert inside":(f"<body><article><p>{L}</p><div class='advert'>{L}</div><p>{L}</p></article>",f"{L}\n{L}"),
"social":(f"<body><article><h1>T</h1><div class='share-buttons'><a href=x>Share</a></div><p>{L}</p></article><div class='related'><h2>{P}</h2><p>{L}</p></div>",f"T\n{L}"),
"div content":(f"<body><div id='header'><p>{P}</p></div><div id='menu'><ul><li>{P}</li></ul></div><div id='content'><h1>T</h1><p>{L}</p></div><div id='footer'>{L}</div>",f"T\n{L}"),
"short":(f"<body><nav><a href=x>a</a></nav><article><h1>x</h1><p>y</p></article>","x\ny"),
"no p":(f"<body><nav>n</nav><article>{L}</article>",L),
"reader":(f"<body><article><h1>T</h1><p>{L}</p></article><section id='reader-comments'><article><p>{L}</p></article></section>",f"T\n{L}"),
"article comment":(f"<body><article><h1>T</h1><p>{L}</p></article><article class='comment'><p>{L}</p></article>",f"T\n{L}"),
"section header":(f"<body><header class='top'><nav>{P}</nav></header><section><h2>T</h2><p>{L}</p></section><footer>{P}</footer>",f"T\n{L}"),
"ads2":(f"<body><div class='ad-slot'>{L}</div><aside class='ads'>{L}</aside><article><p>{L}</p></article>",L),
"popups":(f"<body><div id='newsletter-popup' class='modal'><p>{L}</p><form><input></form></div><article><p>{L}</p></article>",L),
"header in article":(f"<body><article><header><h1>T</h1></header><p>{L}</p><footer><p>{P}</p></footer></article>",f"T\n{L}"),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_layouts(model, name):
    html, want = PAGES[name]
    assert text(model, html) == want


def test_broken_markup_is_read(model):
    for html in ("<p", "<article><p>abc def ghi jkl.", "</p></div>text of the page", "<a <b>>x", "<!-- open", "<script>never", "<p>" * 3000 + "x", "&#xZZ; &amp &lt;b&gt;", "<p title='a>b'>quoted</p>"):
        assert isinstance(text(model, html), str)
    assert [b.text for b in html_crf.blocks_of("<p title='a>b'>quoted &amp x</p>")] == ["quoted & x"]


def test_held_out_pages(model):
    wrong = total = 0
    for page in html_crf.training_pages(60, seed=1234):
        blocks = html_crf.blocks_of(page)
        wrong += sum(b.main != bool(label) for b, label in zip(blocks, model.decode(blocks)))
        total += len(blocks)
    assert total > 500 and wrong <= 0.01 * total


def test_viterbi_is_the_best_path(model):
    import itertools

    blocks = html_crf.blocks_of(html_crf.training_pages(1, seed=3)[0])[:9]
    emit = model.scores(blocks)
    value = lambda path: model.first[path[0]] + sum(emit[k, y] for k, y in enumerate(path)) + sum(model.steps[a, b] for a, b in zip(path, path[1:]))
    assert abs(value(model.decode(blocks)) - max(map(value, itertools.product((0, 1), repeat=len(blocks))))) < 1e-9


def test_odd_pages(spark, model):
    rows = [(1, None, None, 1), (1, "u", "<p>same words in here.</p>", 1), (1, "u", "<p>same words in here.</p>", 1), (None, "u", "x" * 200_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    made = html_crf.extract(df, model).collect()
    assert len(made) == 4 and all(r["n_chars"] == len(r["text"]) for r in made)
    assert html_crf.extract(df.limit(0), model).count() == 0


@pytest.mark.skipif(not HAVE, reason="no tables")
def test_query_extracts_articles(spark):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    made = {r["page_id"]: r["text"] for r in html_crf.op4_html_main_text(spark, DATA).collect()}
    for p in pages:
        inside = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1].replace("<br>", " ")
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", "", s)).split()) for s in re.split(r"</?(?:p|h1)>", inside)]
        assert made[p["page_id"]] == "\n".join(x for x in parts if x)


def test_elements_without_their_end_tags_hide_nothing():
    article = "<div class=article><p>First part of the story.</p><p>Second part of it.</p></div>"
    want = ["First part of the story.", "Second part of it."]
    texts = lambda page: [b.text for b in html_crf.blocks_of(page)]
    assert texts(f"<html><head><title>t</title><script>'<p>no</p>'</script><body>{article}</body></html>") == want
    assert texts(f"<html><head><title>t</title><meta name=x>{article}") == want
    whole = f"<html><head><title>t</title><noscript><p>no</p></noscript></head><body>{article}</body></html>"
    assert texts(whole) == want and html_crf.blocks_of(whole) == html_crf.blocks_of(whole.replace("</head>", ""))
    for tag in ("noscript", "svg", "object", "iframe", "template"):
        assert texts(f"<body><{tag} class='a'>{article}</body>") == want, tag
        assert texts(f"<body><{tag}><p>no</p></{tag}>{article}<{tag.upper()}></body>") == want, tag
