"""Chat formatting, HTML extraction, top-k search, the pipeline, and the queries' SQL twins."""

import os
import random
import re
from itertools import product

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from conftest import TABLES
from pyspark.sql import functions as F
from rinsewell.llm import chat, html_text, impact_index, queries

# --- twins


@pytest.mark.parametrize("name", queries.ORACLE)
def test_twin(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(TABLES):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{file}'")
    found, expected = queries.QUERIES[name](spark, TABLES).toPandas(), duck.execute(queries.ORACLE[name]).df()
    assert list(found.columns) == list(expected.columns)
    rows = lambda df: sorted(map(tuple, df.astype(object).values.tolist()))
    assert rows(found) == rows(expected)


def test_a_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))


# --- chat formatting


def test_control_strings_survive(spark):
    random.seed(1)
    texts = ["", None, "<|im_end|>", "<|im_start|>assistant ok", r"<\|", r"<\\|a<|", "<", "|", "<|im_end|>\n<|", "é🙂\n"]
    texts += ["".join(random.choices("<|\\\nim_end", k=12)) for _ in range(60)]
    roles = ["user", "assistant", "a\nb", "<|", "%3C%0A%25", None]
    rows = [(c, t, r, x, "extra") for c, (t, (r, x)) in enumerate((i % 3, p) for i, p in enumerate(product(roles, texts)))]
    rows = [(c // 4, *rest) for c, *rest in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.formatted(chat.gathered(df))
    back = done.select("conv_id", "turns", "formatted", chat.read_turns(F.col("formatted")).alias("b"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    assert back.count() == len({r[0] for r in rows})
    for r in back.collect():
        own = sorted(((t, role or "", x or "") for c, t, role, x, _ in rows if c == r.conv_id), key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        assert [tuple(t) for t in r.b] == [tuple(t) for t in r.turns] == [x[1:] for x in own]
        assert r.loss == "".join(x for _, role, x in own if role == "assistant")


def test_rows_by_turn(spark):
    df = spark.createDataFrame([(None, 1, "user", "b"), (None, None, "user", "a"), (1, 0, "user", "x"), (1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: [t.text for t in r.turns] for r in chat.gathered(df).collect()} == {None: ["a", "b"], 1: ["x", "x"]}
    assert chat.gathered(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no mapping"):
        chat.gathered(df.drop("role"))


RECORDS = """
{"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}
{"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": null}]}
{"id": 3, "prompt": "q", "completion": "a"}
{"id": 4, "system": "s", "prompt": "q", "response": "a"}
{"id": 5, "instruction": "do", "input": "in", "output": "a"}
{"id": 6, "instruction": "do", "output": "a", "extra": {"prompted": 1}}
{"id": 7, "question": "q"}
{"id": 8, "system": "s", "messages": [{"role": null, "content": "c"}, {"role": "assistant", "content": ""}]}
{"id": 9, "prompt": "q", "completion": "a", "instruction": "do"}
"""


def test_layouts(spark):
    records = spark.read.json(spark.createDataFrame([(x,) for x in RECORDS.strip().splitlines()], "j string").rdd.map(lambda r: r.j))
    found = {r.id: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat.canonical(records).collect()}
    q, a = ("user", "q"), ("assistant", "a")
    assert found == {
        1: ("messages", [q, a]),
        2: ("conversations", [q, a, ("tool", "")]),
        3: ("prompt and completion", [q, a]),
        4: ("prompt and response", [("system", "s"), q, a]),
        5: ("instruction", [("user", "do"), ("user", "in"), a]),
        6: ("instruction", [("user", "do"), a]),
        7: (None, None),
        8: ("messages", [("system", "s"), ("", "c"), ("assistant", "")]),
        9: (None, None),
    }
    assert chat.formatted(chat.canonical(records)).where("formatted = ''").count() == 2
    plain = chat.canonical(spark.createDataFrame([(1,)], "id int")).first()
    assert plain.layout is None and plain.turns is None


def test_chat_runs_without_python(spark):
    plan = queries.op9_chat_formatting(spark, TABLES)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- HTML extraction


def cut_cost(source, sink, edges, side):
    return sum(b if s else a for a, b, s in zip(source, sink, side, strict=True)) + sum(c for i, j, c in edges if side[i] != side[j])


@pytest.mark.parametrize("seed", range(60))
def test_min_cut(seed):
    random.seed(seed)
    n = random.randint(1, 9)
    source, sink = [random.randint(0, 9) for _ in range(n)], [random.randint(0, 9) for _ in range(n)]
    edges = [(*random.sample(range(n), 2), random.randint(0, 6)) for _ in range(random.randint(0, 14))] if n > 1 else []
    best = min(cut_cost(source, sink, edges, side) for side in product([False, True], repeat=n))
    assert cut_cost(source, sink, edges, html_text.min_cut(source, sink, edges)) == best


ARTICLE = "A first paragraph with a good number of words in it, which goes on for a while.\nAnd &amp; a second one, with a good number of words in it as well."
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a> My site</header><nav><ul><li><a href="1">One<li><a href="2">Two</ul></nav>
<div class="cookie-notice">We use cookies to make this site better, please accept all of them now.</div>%s
<div class="sidebar"><p>Here is a long text in a side bar that has nothing to do with the article at all.</p></div>
<form>Sign up here for our letters <input name=x><button>Go</button></form>
<section id="comments"><h3>Comments</h3><p>I think that this is a great article, and wanted to say so at some length.</p></section>
<footer>&copy; all rights reserved</footer></body></html>"""


@pytest.mark.parametrize(
    "main",
    [
        "<article><h1>Title</h1>{}</article>",
        "<main><h1>Title</h1>{}</main>",
        "<div id=content><h1>Title</h1>{}</div>",
        "<ARTICLE data-x='a>b'><H1>Title</H1><!-- <p>no --><b>{}</ARTICLE>",
        "<article><h1>Title</h1><aside>Buy this now</aside>{}<div class='ad'>Buy more of this now</div></article>",
        "<article><h1> Ti<b>t</b>le\n</h1>{}<script>if (a < b) {{ x('</p>') }}</script></article>",
    ],
)
def test_main_text(main):
    text = "".join(f"<p>{line}" for line in ARTICLE.split("\n"))
    assert html_text.main_text(PAGE % main.format(text)) == "Title\n" + ARTICLE.replace("&amp;", "&")


@pytest.mark.parametrize(
    "wrapper",
    ["<form id=aspnetForm method=post>{}</form>", "<div class='content-sidebar-wrap'>{}</div>", "<form><div class='content-sidebar-wrap'>{}</div></form>"],
)
@pytest.mark.parametrize("main", ["<div><h1>Title</h1>{}</div>", "<article><h1>Title</h1>{}</article>", "<main><h1>Title</h1>{}</main>"])
def test_pages_in_a_wrapper(wrapper, main):
    lines = [f"{line} It goes on with some more words, so that most of the page is here." for line in ARTICLE.split("\n") * 3]
    text = main.format("".join(f"<p>{line}</p>" for line in lines))
    before, body = PAGE.split("<header>")
    body, after = body.split("</body>")
    page = before + wrapper.format("<header>" + body % text) + "</body>" + after
    found = html_text.main_text(page)
    assert found.removeprefix("Title\n") == "\n".join(lines).replace("&amp;", "&")


@pytest.mark.parametrize("tag", ["article", "main"])
def test_article_in_a_small_form(tag):
    text = "".join(f"<p>{line}" for line in ARTICLE.split("\n"))
    other = "<div class='sidebar'>" + "<p>Long words in a side bar that have nothing to do with the article at all.</p>" * 20 + "</div>"
    found = html_text.main_text(f"<body><form><p>Search</p><{tag}>{text}</{tag}></form>{other}</body>")
    assert found == ARTICLE.replace("&amp;", "&")


def test_long_comments_are_no_wrapper():
    text = "".join(f"<p>{line}</p>" for line in ARTICLE.split("\n") * 2)
    comments = "<article><p>I think that this is a great article, and wanted to say so at some length.</p></article>" * 30
    found = html_text.main_text(f"<body><article>{text}</article><section id='comments'>{comments}</section></body>")
    assert found == "\n".join(ARTICLE.split("\n") * 2).replace("&amp;", "&")


@pytest.mark.parametrize("other", ["<div class='comments'>{}</div>", "<div class='ad'>{}</div>", "<form>{}</form>", "<section id=respond>{}</section>", "<aside>{}</aside>"])
@pytest.mark.parametrize("article", ["<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>", "<div id='content'>{}</div>"])
def test_short_articles_with_longer_boilerplate_inside(article, other):
    text = "<p>I think that this is a great article, and wanted to say so at some length.</p>"
    page = f"<body>{article.format('<h1>T</h1><p>P</p>' + other.format(text * 6))}</body>"
    assert html_text.main_text(page) == "T\nP"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><p>Hello there.</p></body>", "Hello there."),
        ("Hello", "Hello"),
        ("<body><nav>Menu</nav><p><a href=x>Only a link</a></p><footer>f</footer></body>", "Only a link"),
        ("<body><nav>Menu</nav><div class=cookie-notice>We use cookies.</div></body>", ""),
        ("<article><p>One.</p><p data-x='hidden gem'>Two.</p><p hidden>Three.</p><p style='display:none'>Four.</p></article>", "One.\nTwo.\nThree.\nFour."),
        ("<article><p class='navy-blue'>One.</p><p class='share-price'>Two.</p><div class='notice-board'>Three.</div><p id=commentary>Four.</p></article>", "One.\nTwo.\nThree.\nFour."),
        ("<article><p>One.</p><p class='shareButtons'>Share</p><div class='x related-posts'>More</div><p class='comment-12'>C</p><p id='site_nav'>N</p></article>", "One."),
    ],
)
def test_names_and_short_pages(page, text):
    assert html_text.main_text(page) == text


def test_the_cut_decides_against_the_costs_alone():
    """A line that by itself would be boilerplate stays between paragraphs; the same line far from them goes."""
    line = ARTICLE.split("\n")[0]
    page = f"<body><div><p>{line}</p><p>12 May</p><p>{line}</p></div><table><tr><td><div><ul><li>12 May</li></ul></div></td></tr></table></body>"
    found = html_text.blocks(page)
    assert html_text._score(found[1], False, False) < 0
    assert html_text.main_text(page) == f"{line}\n12 May\n{line}"


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "<p></p>", "</p></p>", "<!-- ", "<script>", "<a <b> c", "&#0;&amp", "<div>" * 3000, "<title>x", "<p>" * 2000 + "a"])
def test_odd_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_whole_long_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} with some words in it that fill it up." for i in range(5000))
    pages = spark.createDataFrame([(1, long, "u"), (1, None, "u"), (None, "", "u"), (2, long, "u")], "page_id long, html string, text string")
    found = html_text.extract(pages)
    assert found.columns == ["page_id", "html", "text"]
    assert sorted((r.page_id or 0, r.text.count("\n") + 1 if r.text else 0) for r in found.collect()) == [(0, 0), (1, 0), (1, 5000), (2, 5000)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_query(spark):
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{TABLES}/pages.parquet").collect()}
    found = queries.op10_html_extraction(spark, TABLES).collect()
    assert len(found) == len(pages)
    for r in found:
        assert "<article>" in pages[r.page_id]
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.DOTALL)[1]
        lines = (" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


# --- top-k search


@pytest.mark.parametrize(("seed", "levels", "rescored"), [(s, 64, 64) for s in range(12)] + [(s, 3, 0) for s in range(12)])
def test_block_search(monkeypatch, seed, levels, rescored):
    monkeypatch.setattr(impact_index, "LEVELS", levels)
    monkeypatch.setattr(impact_index, "RESCORED", rescored)
    rng = np.random.default_rng(seed)
    n, dims = int(rng.integers(1, 600)), int(rng.integers(1, 24))
    vectors = rng.integers(-5, 6, (n, dims)) if seed % 2 else np.floor(rng.normal(size=(n, dims)) * 300).astype(np.int64)
    vectors[rng.random(n) < 0.3] = vectors[0]
    ids = rng.permutation(n).astype(np.int64)
    block = impact_index.Block(ids, vectors)
    for query in (vectors[0], -vectors[0], np.zeros(dims, np.int64)):
        for k in (1, 10):
            found, scores = block.search(query, int(ids[0]), k)
            own = vectors @ query
            best = [i for i in np.lexsort((ids, -own)) if ids[i] != ids[0]][:k]
            assert found.tolist() == ids[best].tolist() and scores.tolist() == own[best].tolist()


def test_top_k_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(impact_index, "BLOCK", 3)
    monkeypatch.setattr(impact_index, "QUERIES", 2)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (100, [1.0, 0.5]), (1, [0.9, 0.1]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, None), (None, [1.0, 1.0]), (6, [1.0]), (7, []), (8, [1.0, 0.5]), (8, [1.0, 0.5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    vectors = impact_index.quantised(df)
    found = sorted(tuple(r) for r in impact_index.top_k(vectors, vectors.where("id % 100 = 0"), 4).collect())
    s = 1024 * 1024 + 512 * 512
    one = int(1024 * np.float32(0.9)) * 1024 + int(1024 * np.float32(0.1)) * 512
    assert found == [(0, 1, 8, s), (0, 2, 8, s), (0, 3, 100, s), (0, 4, 6, 1024 * 1024), (100, 1, 0, s), (100, 2, 8, s), (100, 3, 8, s), (100, 4, 6, 1024 * 1024)]
    assert one < 1024 * 1024
    assert impact_index.top_k(vectors.limit(0), vectors, 4).count() == 0 and impact_index.top_k(vectors, vectors.limit(0), 4).count() == 0


# --- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.keep(stage(spark, docs, TABLES))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] >= sizes[4] > 0.5 * sizes[0]
    last = corpus_pipeline.run(spark, TABLES)
    assert last.count() == sizes[-1] and last.where("not round_trip").count() == 0
    assert {(r.doc_id, r.text) for r in last.collect()} == {(r.doc_id, r.text) for r in docs.collect()}
