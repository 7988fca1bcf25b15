from momentloom.llm import html_extract as H


def text(html):
    return [b[0] for b in H.parse(html)[0]]


def test_blocks_of_broken_and_whole_pages():
    assert text("<html><body><p>A &amp; b<br>c <b>d</b>  e<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>") == ["A & b c d e", "x", "y", "1", "2", "3"]
    assert text("<article><h1>T</h1><p><b>One.<br><p>Two &eacute;&#233;&nbsp;z</article>") == ["T", "One.", "Two éé z"]
    assert text("plain") == ["plain"] and text("") == [] and text("<p>cut &am") == ["cut &am"] and text("<p>a</p><di") == ["a"]
    assert text('<p title="a>b">x<!-- <p>no --> y<![CDATA[z]]></p><script>var t="</p>";</script><style>p{}</style><textarea>q</textarea>') == ["x yz"]
    assert text("<p>a<script>never closed") == ["a"] and text("a < b <3") == ["a < b <3"]


def test_quotes_open_a_value_only_behind_an_equals_sign():
    assert text("<p data-x=it's>Hello</p><p>don't go</p>") == ["Hello", "don't go"]
    assert text('<p title="5" tall">Hello</p>') == ["Hello"] and text("<p title='a>b' x = \"c>d\">Hello</p>") == ["Hello"]
    assert text('<p title="never closed>Hello</p>') == ["Hello"]


def test_titles_and_parts_of_articles():
    levels = [b[0] for b in H.parse("<main><h1>Title</h1><article><p>story</p></article></main>")[0] if b[2] == 2]
    assert levels == ["Title", "story"]
    assert text('<article><p class="social">a</p><section id="search"><p>b</p></section><div class="related-work">c</div><div class="social">no</div>'
                '<div class="reader-responses"><p>troll</p></div></article>') == ["a", "b", "c"]


def test_noise_by_element_class_and_role():
    noise = ("<header>H</header><nav><ul><li>m</ul></nav><aside>s</aside><div class='ad'>buy</div><form>f<input></form><div id=cookie-notice>c</div>"
             "<section class='comments'><article><p>troll</p></article></section><div role=banner>b</div><div hidden>h</div><footer>&copy;</footer>"
             "<div class=userComments>u</div><button>go</button>")
    assert text(f"<body class=has-sidebar>{noise}<article><header><h1>T</h1></header><p>body <span class=ad>spot</span> on</p><footer>tags</footer></article>") == ["T", "body on"]
    assert text("<div class=loader-adapter>kept</div>") == ["kept"]
    assert text("<p>a <span class=ad>never closed<p>b") == ["a", "b"]


def pages_of_a_site(n, host="site.example.org"):
    return [(i, f"http://{host}/{i}", f"<body><div class=top>Welcome to the site</div><div class=body><p>Story {i} begins</p><p>and goes on {i}</p></div>"
             f"<div class=bottom>All rights</div></body>") for i in range(n)]


def test_template_goes_where_a_site_shows_it(spark):
    rows = pages_of_a_site(30) + [(100, "http://lone.example.org/", "<div class=top>Welcome to the site</div><p>lone</p>"), (101, None, None), (102, "http://[x", ""),
                                  (103, "http://site.example.org/x", "<div class=top>Welcome to the site</div>"), (0, "http://site.example.org/0", rows0())]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    out = H.extract_text(docs).collect()
    got = {(r.page_id, r.text) for r in out}
    assert len(out) == len(rows)
    assert all((i, f"Story {i} begins\nand goes on {i}") in got for i in range(30))
    assert {(100, "Welcome to the site\nlone"), (101, ""), (102, ""), (103, "Welcome to the site"), (0, "again")} <= got


def test_the_tree_finds_template_that_no_class_names(spark):
    """Navigation and adverts change from page to page, but less than the articles do."""
    import random

    rand = random.Random(2)
    words = [f"w{k}" for k in range(4_000)]
    said = lambda n: " ".join(rand.sample(words, n))
    rows, want = [], {}
    for i in range(200):
        story = [f"Title {i}", *(said(20) for _ in range(4))]
        nav = "".join(f"<div class=x-item>Topic {rand.randrange(12)}</div>" for _ in range(5))
        rows.append((i, f"http://{'ab'[i % 2]}.org/{i}", f"<body><div class=x-top>{nav}</div><div class=x-spot>Offer {rand.randrange(9)}</div>"
                     f"<div class=x-story><h1>{story[0]}</h1>{''.join(f'<p>{x}</p>' for x in story[1:])}</div><div class=x-end>All rights</div></body>"))
        want[i] = "\n".join(story)
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def rows0():
    return "<nav>n</nav><article><p>again</p></article>"


def test_marked_articles_stay_whole(spark):
    rows = [(i, f"http://copies.org/{i}", f"<div class=top>Welcome</div><article><h1>Title {i}</h1><p>The same story</p></article>") for i in range(12)]
    rows += [(100 + i, f"http://heads.org/{i}", f"<main itemprop=articleBody><h2>Summary</h2><p>Story {i}</p></main>") for i in range(12)]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Title {i}\nThe same story" for i in range(12)}, **{100 + i: f"Summary\nStory {i}" for i in range(12)}}


def test_copies_count_as_one_page(spark):
    story = lambda k: "".join(f"<p>Part {j} of {k}</p>" for j in range(10))
    rows = [(i, f"http://copies.org/{i}", story(i % 2)) for i in range(80)] + [(100, "http://copies.org/x", "<p>Only here</p><ul><li>once</ul>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.text for r in H.extract_text(docs).filter("page_id = 100").collect()] == ["Only here\nonce"]
    assert {r.n_pages for r in H.node_importance(H.parse_pages(docs)).collect()} == {1, 3}


def test_importance_of_nodes(spark):
    parsed = H.parse_pages(spark.createDataFrame(pages_of_a_site(30), "page_id long, url string, html string"))
    importance = sorted(r.content for r in H.node_importance(parsed).collect())
    assert [round(x, 6) for x in importance] == [0, 0, 1]
    assert H.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
