import pickle
import random
import time
import tracemalloc
from collections import Counter

import numpy as np

from furrow.llm.html_blocks import PATH, _slot, blocks_of, extract, extract_main_text, features, fit_labeller, label, label_long, made_up, marked
from furrow.llm.quote_links import link_quotes, parsed
from furrow.llm.queries import op8_quote_links, op9_html_extraction


def test_blocks():
    page = '<html><head><title>T</title><script>var a="</p><p>no"</script></head><body><p>a &amp; b<br>c<p>d <b>e</b>f</div><!-- x --><ul><li>1<li>2</ul><div class="Ad-box" title="a>b">q</div>tail &lt;p&gt; < 3'
    got = blocks_of(page)
    assert [b.text for b in got] == ["T", "a & b c", "d ef", "1", "2", "q", "tail <p> < 3"]
    assert all(got[5].path[_slot(n, PATH)] for n in ("div", "ad", "box")) and got[0].title and blocks_of("") == []
    assert blocks_of("<script>never closed") == [] and blocks_of("<!-- open")== []


def test_pages_against_markup_and_made_up(spark, small):
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = {r.page_id: r for r in op9_html_extraction(spark, small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        b = blocks_of(r.html)
        text = "\n".join(x.text for x, y in zip(b, marked(b)) if y)
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text) and got[r.page_id].url == r.url
    model = fit_labeller(spark.read.parquet(f"{small}/pages.parquet"))
    rng, wrong, total = random.Random(5), 0, 0
    for _ in range(200):
        page, main = made_up(rng, "walk river stone light the of and in green house".split())
        b = blocks_of(page)
        y = np.array([x.text in main and not x.title for x in b])
        wrong, total = wrong + (label(model, [features(b)])[0] != y).sum(), total + len(y)
    assert wrong < 0.04 * total


def words_f1(got, want):
    both = sum((Counter(got.split()) & Counter(want.split())).values())
    return 2 * both / max(1, len(got.split()) + len(want.split()))


#: Written by hand, in layouts that the made-up pages don't have; no part bears a name that training knows.
HAND = [
    (
        "<html><head><title>Ice</title></head><body><table><tr><td><a href=/>Home</a></td><td><a href=/n>News</a></td></tr></table>"
        "<div class='kolo'><h1>Ice on the lake holds until March</h1><p>The keeper of the lake walked over the ice at noon and drilled nine holes, each a hand deep.</p>"
        "<p>Skaters may come at dawn, she said, as long as the wind stays in the north and the nights stay cold.</p></div>"
        "<div class='zuro'><ul><li><a href=/1>More ice</a></li><li><a href=/2>More snow</a></li></ul></div><footer>Lake office, all rights reserved</footer></body></html>",
        "Ice on the lake holds until March The keeper of the lake walked over the ice at noon and drilled nine holes, each a hand deep. "
        "Skaters may come at dawn, she said, as long as the wind stays in the north and the nights stay cold.",
    ),
    (
        "<body><nav><a href=a>Start</a> <a href=b>Maps</a></nav><section><h2>How to mend a net</h2><p>Lay the net flat on a dry board and find the torn meshes before you cut any thread.</p>"
        "<blockquote>A net forgets nothing, my uncle used to say while he knotted.</blockquote><p>Knot from the left to the right, keep the same gauge, and wet the twine first.</p></section>"
        "<form action=/s><label>Your mail</label><input><button>Send</button></form><footer><p>Imprint</p></footer></body>",
        "How to mend a net Lay the net flat on a dry board and find the torn meshes before you cut any thread. A net forgets nothing, my uncle used to say while he knotted. "
        "Knot from the left to the right, keep the same gauge, and wet the twine first.",
    ),
    (
        "<body><header><a href=/>The Daily Field</a></header><main><h1>Rain at last</h1><p>After nine dry weeks the first rain fell on the eastern farms on Sunday night.</p>"
        "<p>Farmers opened the gates of the old canals and let the water run to the lower rows.</p><aside><a href=/x>Read about hail</a></aside></main>"
        "<section class='comments'><h3>Comments</h3><p>I saw it too, what a night that was for all of us!</p></section></body>",
        "Rain at last After nine dry weeks the first rain fell on the eastern farms on Sunday night. Farmers opened the gates of the old canals and let the water run to the lower rows.",
    ),
]


def test_pages_written_by_hand(spark, small):
    model = fit_labeller(spark.read.parquet(f"{small}/pages.parquet"))
    scores = [words_f1(t, want) for t, (_, want) in zip(extract(model, [h for h, _ in HAND]), HAND)]
    assert np.mean(scores) >= 0.85, scores


def test_pages_that_are_long(spark, small):
    start = time.time()
    for page in ("<div>x" * 60_000, '<a "' * 200_000, "<!" * 200_000, "<li><a>x" * 40_000, "<a ='" * 100_000 + ">", "<p><b>" * 60_000, "<p>" + "word " * 200_000):
        blocks_of(page)
    assert time.time() - start < 20
    model = fit_labeller(spark.read.parquet(f"{small}/pages.parquet"))
    assert len(extract(model, ["<article>" + "<p>some words of a page.</p>" * 20_000 + "</article>"])[0]) > 400_000


def test_windows_label_like_whole_pages(spark, small):
    """Windows of any size agree with the page as a whole, and memory follows the window."""
    model = fit_labeller(spark.read.parquet(f"{small}/pages.parquet"))
    blocks = blocks_of("<body><nav><li>Menu</nav>" + "<p>rain fell on the rows.</p><div class='ad'>buy now</div>" * 9_000 + "<footer>imprint</footer></body>")
    whole = label(model, [features(blocks)])[0]
    assert all((label_long(model, blocks, w) == whole).mean() > 0.9999 for w in (1_000, 4_096, 10**6))
    tracemalloc.start()
    label_long(model, blocks, 1_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6_000_000


def test_pages_edge_rows(spark, small):
    model = fit_labeller(spark.read.parquet(f"{small}/pages.parquet"))
    df = spark.createDataFrame([(1, None, "m"), (2, "", "m"), (3, "<article><p>hello world of words.</p></article>", "m")], "page_id long, html string, main_text string")
    assert {r.page_id: r.main_text for r in extract_main_text(df, model).collect()} == {1: "", 2: "", 3: "hello world of words."}
    assert extract_main_text(df.limit(0), model).count() == 0 and extract(model, []) == []
    assert extract_main_text(df, fit_labeller(df.limit(0))).count() == 3


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I plant maize?\n\nThe soil is wet."),
        (1, 1, "assistant", "> The soil is WET.\nWait for dry days."),
        (1, 2, "user", "> > the soil is wet\n> Wait for dry days.\nHow long?"),
        (1, 3, "user", ">How long\n> > Wait for dry days.\n\nAlso, thanks."),
        (2, 0, "user", "> wait for dry days\nI read this."),
        (2, 1, "user", "> never said\nOh"),
        (2, 2, "user", None),
        (3, 0, "user", ""),
        (None, 1, "user", "> How long?\nx"),
        (3, 1, None, "> !!\n>>>\nplain"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): tuple(r)[3:] for r in link_quotes(df).collect()}
    assert got[1, 1] == ("Wait for dry days.", 1, 1, 1, 0, 0)
    assert got[1, 2] == ("How long?", 2, 2, 1, 1, 0)
    assert got[1, 3] == ("Also, thanks.", 2, 2, 1, 2, 0)
    assert got[2, 0] == ("I read this.", 1, 1, 1, 1, 0)
    assert got[2, 1] == ("Oh", 1, 0, None, None, 1)
    assert got[2, 2] == ("", 0, 0, None, None, 2) and got[3, 1] == ("plain", 2, 0, None, None, 1)
    assert got[None, 1] == ("x", 1, 0, None, None, 1)
    assert link_quotes(df.limit(0)).count() == 0
    twice = link_quotes(df.union(df)).groupBy("conv_id", "turn", "text", "n_quotes", "n_linked").count().collect()
    assert {r["count"] for r in twice} == {2}


def test_partial_quotes(spark):
    rows = [
        (1, 0, "Plant in May.\nUse short rows.\nKeep the soil wet.\n\nCall me. Bring the long map! We meet at noon.\n\nGood luck."),
        (1, 1, "> Use short rows.\n> Keep the soil wet.\nYes."),
        (1, 2, "> Call me. Bring the long map! We meet at noon.\n>\n> Good luck.\nFine."),
        (1, 3, "> bring the long map\nWhich?"),
        (1, 4, "> Plant in May.\n> Keep the soil wet.\nNot one after the other."),
        (1, 5, "> Use short rows.\n> Never said.\nNo."),
        (2, 0, "> Only here later.\nWho?"),
        (2, 1, "Only here later."),
        (3, 0, "Only here later."),
        (4, 0, "> Only here later.\nMe too."),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_linked, r.reply_conv, r.reply_turn) for r in link_quotes(df).collect()}
    assert got[1, 1] == got[1, 2] == got[1, 3] == (1, 1, 0)
    assert got[1, 4] == got[1, 5] == (0, None, None)
    assert got[2, 0] == (1, 3, 0) and got[4, 0] == (1, 2, 1)


def test_quotes_on_the_table(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").collect()
    got = {(r.conv_id, r.turn): r for r in op8_quote_links(spark, small).collect()}
    assert len(got) == len(rows) and all(got[r.conv_id, r.turn].text == "\n".join(x.strip(" ") for x in r.text.split("\n")).strip() for r in rows)


def brute_links(rows):
    """Origins of quotations of one line: an earlier turn of the own conversation, else the least other message."""
    norm = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())
    said = {(c, t): {norm(x) for x in text.split("\n") if not x.startswith(">")} for c, t, text in rows}
    out = {}
    for c, t, text in rows:
        for line in text.split("\n"):
            if line.startswith(">"):
                holds = [k for k in said if norm(line[1:]) in said[k]]
                own = sorted(k for k in holds if k[0] == c and k[1] < t)
                others = sorted(k for k in holds if k[0] != c)
                out[c, t] = (own or others or [(None, None)])[0]
    return out


def test_quotes_against_brute_force(spark):
    """Generated quotations: a third of all messages quote one hot line, others quote lines of any message."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    lines, rows = ["the line that all of them quote"], []
    for c in range(150):
        for t in range(8):
            own = [" ".join(word() for _ in range(5)) for _ in range(2)]
            quote = [] if rng.random() < 0.3 else ["> " + (lines[0] if rng.random() < 0.5 else rng.choice(lines))]
            lines += own
            rows.append((c, t, "\n".join([*quote, *own, *([lines[0]] if rng.random() < 0.02 else [])])))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in link_quotes(df).collect()}
    truth = brute_links(rows)
    assert len(truth) > 700 and all(got[k] == truth.get(k, (None, None)) for k in got)


def test_long_message(spark):
    text = "\n".join(("> " * (i % 3) + f"line {i}") for i in range(60_000))
    start = time.time()
    said, quotes = parsed(text)
    assert time.time() - start < 5 and len(said.split("\n")) == 20_000 and len(quotes) == 40_000
    df = spark.createDataFrame([(1, 0, "user", "line 4000"), (1, 1, "user", text)], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.n_quotes, r.reply_turn) for r in link_quotes(df).collect()}
    assert got[1] == (40_000, 0)


def test_comments_end_where_browsers_end_them():
    for page in ("<p>a<!-->b</p><p>c</p>", "<p>a<!--->b</p><p>c</p>", "<p>a<!-- x --!>b</p><p>c</p>", "<p>a<!-- x > - -- y -->b</p><p>c</p>"):
        assert [b.text for b in blocks_of(page)] == ["ab", "c"], page
    assert [b.text for b in blocks_of("<p>a<!-- never closed <p>b</p>")] == ["a"]


def test_greetings_with_lines_that_nobody_wrote(spark):
    """A common line and an edited one: no quotation looks for messages, so candidates stay few and nothing is linked."""
    n = 300
    rows = [(k, 0, "u", f"Hello there.\nmessage number {k}") for k in range(n)] + [(n + k, 0, "u", f"> Hello there.\n> text nobody wrote {k}\nanswer") for k in range(n)]
    rows += [(3 * n, 0, "u", "> Hello there.\n> message number 7\nyes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in link_quotes(df).collect()}
    assert sum(r.n_linked for r in got.values()) == 1 and (got[3 * n].reply_conv, got[3 * n].reply_turn) == (7, 0)


def test_labeller_is_the_same_in_any_order(spark):
    page = "<html><body><nav>menu of the site</nav><article><p>words of number {}</p></article></body></html>"
    pages = [(k, page.format(k % 9)) for k in range(60)]
    models = [fit_labeller(spark.createDataFrame(rows, "page_id long, html string").repartition(p), fit_pages=6) for rows, p in ((pages, 1), (pages[::-1], 5))]
    assert pickle.dumps(models[0]) == pickle.dumps(models[1])
