import random
import time

from conftest_llm import ODD
from oracle import same

from panelworks.llm import html_text, language
from panelworks.llm.queries import oracle_sql, queries

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><title>no</title><style>p{}</style><script>var t="</p><article>";</script></head><body><nav><a>Home</a></nav><div class="ad">Buy</div>'
    "<header>Site</header><article><h1>A &amp; B</h1><p>One\n  two<br><p>Three <b>bold</b>er &eacute;&#33;<aside>no</aside><div class='comments'><p>bad</p></div><form>no</form><p>Last</article>"
    "<div id=footer>f</div><footer>&copy;</footer></body></html>"
)


def test_markup():
    kept = lambda page: "\n".join(x for x, kind in html_text.blocks(page) if kind == 0)
    assert kept(PAGE) == "A & B\nOne two\nThree bolder é!\nLast"
    assert kept("<nav>menu<article>text") == "text"
    assert kept('<main><p>x</p><div class="share-bar">no</div></main>') == "x"
    assert html_text.blocks("") == [] and html_text.blocks("a < b")[0] == ("a < b", 2)
    assert len(html_text.blocks("<" * 3000)) == 1 and html_text.blocks("<div" * 3000) is not None


def test_repeats_of_a_host_go_and_unique_runs_stay(spark):
    menu = "<div>home news sport weather travel culture food contact imprint</div>"
    rows = [(k, f"http://h.org/{k}", f"{menu}<p>{' '.join(f'word{k}x{j}' for j in range(12))}</p>") for k in range(3)]
    rows += [(9, "http://other.org/", menu), (10, None, None), (11, "http://h.org/x", ""), (12, "http://h.org/12", "<article>home news sport weather travel culture food contact imprint</article>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, blocks string, key int")
    got = {r["page_id"]: r for r in html_text.main_text(df).collect()}
    assert len(got) == 7 and got[1]["text"] == " ".join(f"word1x{j}" for j in range(12)) and got[1]["n_repeated"] == 9
    assert got[9]["text"].startswith("home") and got[10]["text"] == got[11]["text"] == "" and got[12]["text"].startswith("home")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and html_text.main_text(df.limit(0)).count() == 0


def test_copies_without_an_article_element_keep_their_text(spark):
    menu = "<div>home news sport weather travel culture food contact imprint</div>"
    text = [" ".join(f"word{k}x{j}" for j in range(120)) for k in range(3)]
    rows = [(k, "http://h.org/", f"{menu}<p>{t}</p>") for k, t in enumerate([text[0], text[0], text[1]])]
    rows += [(10, "x", f"<p>{text[2]}</p>"), (11, "y", f"<p>{text[2]}</p>"), (12, "http://n.org/1", f"<p>{text[0]}</p>"), (13, "http://n.org/2", f"<p>{text[0]} changed</p>")]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0]["text"] == got[1]["text"] == text[0] and got[2]["text"] == text[1] and got[0]["n_repeated"] == 9
    assert got[10]["text"] == got[11]["text"] == text[2] and got[12]["text"] == text[0] and got[13]["text"] == f"{text[0]} changed"


def naive(rows):
    """Per page without an article, how many tokens lie in a run of RUN tokens that a page of other content holds too, by comparing all runs."""
    parts = []
    for url, page in rows:
        found = html_text.blocks(page or "")
        settled = any(kind == 0 for _, kind in found)
        tokens = [t for text, kind in found if kind for t in text.split()]
        own = " ".join(text for text, kind in found if kind == 0 or not settled and kind == 2)
        parts.append((html_text.host(url), tokens, own, settled))
    out = []
    for name, tokens, own, settled in parts:
        covered = [False] * len(tokens)
        for other, theirs, text, _ in parts:
            if not settled and other == name and text != own:
                for i in range(len(tokens)):
                    for j in range(len(theirs)):
                        n = 0
                        while i + n < len(tokens) and j + n < len(theirs) and tokens[i + n] == theirs[j + n]:
                            n += 1
                        if n >= html_text.RUN:
                            covered[i : i + n] = [True] * n
        out.append(sum(covered))
    return out


def test_runs_by_comparing_all_substrings(spark):
    rng = random.Random(5)
    phrase = lambda n: " ".join(rng.choice("abcdefgh") * rng.choice((1, 2)) for _ in range(n))
    shared = [phrase(n) for n in (6, 8, 9, 15, 30)]
    rows = []
    for k in range(30):
        parts = [f"<{tag}>{text}</{tag}>" for tag, text in ((rng.choice(("div", "nav", "p")), rng.choice(shared) if rng.random() < 0.5 else phrase(rng.randrange(20))) for _ in range(6))]
        article = f"<article><p>{phrase(12)} {k}</p></article>" if k % 3 else ""
        rows.append((k, f"http://{rng.choice('ab')}.org/", "".join(parts[:3]) + article + "".join(parts[3:])))
    rows += [(40, *rows[0][1:]), (0, *rows[3][1:]), (41, None, "<div>" + shared[4]), (42, "", shared[4] + "</p> x")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, row int")
    got = sorted((r["page_id"], r["n_repeated"]) for r in html_text.main_text(df.repartition(3), 1.0).collect())
    assert got == sorted(zip((r[0] for r in rows), naive([r[1:] for r in rows]))) and any(n for _, n in got)


def test_a_line_on_most_pages_of_a_host_leaves_articles_and_copies_stay(spark):
    line = "<p>Read our letter each week</p>"
    text = lambda k, n=3: "".join(f"<p>own{k} words{j} of the article</p>" for j in range(n))
    rows = [(k, "http://a.org/", f"<article>{text(k)}{line if k < 7 else ''}</article>") for k in range(10)]
    rows += [(20 + k, "http://b.org/", f"<article>{text('b', 9)}<p>changed {k}</p></article>") for k in range(6)]
    rows += [(30 + k, "http://c.org/", f"<article>{text('c')}{line}</article>") for k in range(6)] + [(40 + k, "http://d.org/", f"<main>{text(40 + k)}{line}</main>") for k in range(3)]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("letter" not in got[k]["text"] and got[k]["n_repeated"] == (5 if k < 7 else 0) and got[k]["text"].count("\n") == 2 for k in range(10))
    assert all(got[20 + k]["text"].endswith(f"article\nchanged {k}") for k in range(6)) and all(got[k]["text"].endswith("each week") for k in (30, 35, 40, 42))


def test_hidden_text_and_reviews():
    kept = lambda page: "\n".join(x for x, kind in html_text.blocks(f"<article>{page}</article>") if kind == 0)
    assert kept('<p>a</p><div class="user-reviews"><p>no</p></div><section class=reviews>no</section><p>b') == "a\nb"
    assert kept("<p hidden>no</p><div style='color:red; display: none'>no<p>no</div><p>a<span hidden>no</span>b</p><p>c") == "ab\nc"
    assert kept('<p>one <span class="ad">no</span>two</p><p title=" hidden ">three</p><p data-x="a hidden b" class="x-hidden-y">four</p>') == "one two\nthree\nfour"
    assert kept("<p>a<span hidden>no</p><p>b</p>") == "a\nb" and kept("<span hidden><p>no</span>yes") == "yes"


def test_long_page():
    assert len(html_text.blocks("<article>" + "<p>x y" * 50_000)) == 50_000


def test_deep_pages_take_time_in_proportion():
    began = time.process_time()
    assert html_text.blocks("<div>" * 80_000 + "x" + "</span></b>" * 80_000 + "</div>" * 80_000) == [("x", 2)]
    assert len(html_text.blocks("<article><nav>" * 40_000 + "x")) == 1
    assert time.process_time() - began < 10


def test_language_uses_all_evidence(spark):
    text = {"en": "the cat and the dog were in this house with that man", "de": "der hund und die katze sind nicht in dem haus gewesen"}
    docs = spark.createDataFrame([(k, text[x], x) for k, x in enumerate(["en", "de"] * 20)], "doc_id bigint, text string, lang string")
    rows = [(k, f"http://deutsch.example.de/{k}", f"<article>{text['de']}</article>") for k in range(20)] + [(50 + k, f"http://english.example.com/{k}", f"<article>{text['en']}</article>") for k in range(20)]
    rows += [(100, "http://deutsch.example.de/empty", ""), (101, None, None), (102, "http://english.example.com/q", '<html lang="de-AT"><article>xyz</article>'), (103, "http://new.org/", f"<p>{text['de']}</p>"), (103, "http://new.org/", f"<p>{text['de']}</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, prior string")
    got = {r["page_id"]: r for r in language.identify(df, docs).collect()}
    assert all(got[k]["lang"] == ("de" if k < 50 else "en") for k in got if k < 100)
    assert got[100]["lang"] == "de" and got[103]["lang"] == "de" and 0 < got[101]["score"] <= 1 and language.identify(df, docs).count() == len(rows)
    assert language.identify(df.limit(0), docs).count() == 0
    assert {r["lang"] for r in language.identify(df, docs.limit(0)).collect()} == {"und"}


def test_every_labelled_language_is_known(spark, monkeypatch):
    text = lambda k: " ".join(f"{chr(97 + k // 10)}{chr(107 + k % 10)}{x}" for x in ("ab", "cd", "ef", "gh", "ij"))
    codes = [f"{chr(97 + k // 10)}{chr(97 + k % 10)}" for k in range(56)]
    docs = spark.createDataFrame([(k * 100 + j, text(k), x) for k, x in enumerate(codes) for j in range(30 if k == 0 else 1)], "doc_id bigint, text string, lang string")
    monkeypatch.setattr(language, "GRAMS", 40)
    model = language.train(docs, 10)
    assert model.languages == codes
    for k, code in enumerate(codes):
        found = model.likelihood(text(k))
        assert codes[found.index(max(found))] == code
    pages = spark.createDataFrame([(k, f"http://h{k}.org/", f'<html lang="{x}"><article>{text(k)}</article>') for k, x in enumerate(codes[-3:], 53)], "page_id bigint, url string, html string")
    assert sorted((r["text_lang"], r["declared"]) for r in language.identify(pages, docs).collect()) == [(x, x) for x in codes[-3:]]


def test_topk_equals_its_sql(spark, sf):
    same(spark, sf, queries()["op5_topk"], oracle_sql()["op5_topk"])


def test_every_operator_has_a_query():
    assert sorted(int(x[2:].split("_")[0]) for x in queries()) == list(range(1, 11)) and len(ODD) == 8
