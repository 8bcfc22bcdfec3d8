from inferweave.llm import html_extract as X

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/">Home</a></ul></nav><!-- ad --><div class="ad-box">Buy</div><article><header><h1>A &amp; B</h1></header><p>One <b>two<br>
three</p><p>Four&nbsp;&lt;5&gt;<p>Six<div class="comments"><p>nice</p></div><form>mail</form><aside>more</aside></article><footer>&copy;</footer></body></html>"""


def text(page, known=None):
    return X.main_text(page, known or {})


def test_meaning():
    assert text(PAGE) == "A & B\n\nOne two three\n\nFour <5>\n\nSix"


def test_odd_markup():
    assert text(None) == text("") == text("<p") == ""
    assert text("just text &eacute;") == "just text é"
    assert text("<p>a<p>b</p></p>c") == "a\n\nb\n\nc"
    assert text("<div>a <span>b</span>c<ul><li>d<li>e</ul></div>") == "a bc\n\nd\n\ne"
    assert text("<p>open <script>never closed <p>x") == "open"
    assert text('<p title="a > b">x</p><!-- no end <p>y') == "x"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n\n2\n\n3"


def site(n, landmark=False):
    words = "red green blue gray pink gold teal navy".split()
    rows = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(words[(i * 7 + j * k) % 8] for k in range(9))} {i}{j}</p>" for j in range(1 + i % 3))
        main = f"<article>{body}<p>shared line</p></article>" if landmark else f"<div>{body}</div>"
        rows.append((i, "http://a.example/x" if i % 2 else "https://A.example:80/y", f"<html><body><div><p>Welcome to the site</p><p>Follow us today</p></div>{main}<div><p>All rights kept</p></div></body></html>"))
    return rows


SCHEMA = "page_id long, url string, html string"


def test_style_tree_removes_what_pages_share(spark):
    rows = site(60)
    got = {r.page_id: r for r in X.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 60
    for i, r in got.items():
        assert "Welcome" not in r.text and "rights" not in r.text and f"{i}0" in r.text
        assert r.text.count("\n\n") == i % 3 and r.n_chars == len(r.text)


def test_landmarks_keep_what_is_repeated(spark):
    got = X.extract(spark.createDataFrame(site(30, True), SCHEMA)).collect()
    assert all(r.text.endswith("shared line") and "Welcome" not in r.text for r in got)


def test_the_tree_judges_inside_landmarks(spark):
    notice = "<div><p>Members of the club read this first</p><p>Ask at the desk</p></div>"
    rows = [(i, f, r.replace("<article>", f"<article>{notice}<section>").replace("</article>", "</section></article>")) for i, f, r in site(90, True)]
    got = X.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 90 and all("Members" not in r.text and "desk" not in r.text and f"{r.page_id}0" in r.text for r in got)


def test_what_a_small_part_of_a_large_site_shares(spark, monkeypatch):
    notice = "<section><p>Ask at the desk</p></section>"
    text = lambda i: f"<p>text {i} of its own</p>"
    rows = [(i, "http://d/", f"<body><ul><li>{'<b>x</b>' * 3}</li></ul><div>{text(i)}</div>{notice}</body>") for i in range(12)]
    rows += [(i, "http://d/", f"<body><div>{text(i)}</div></body>") for i in range(12, 400)]
    for heavy in (X.HEAVY, 3):
        monkeypatch.setattr(X, "HEAVY", heavy)
        got = {r.page_id: r.text for r in X.extract(spark.createDataFrame(rows + rows[:1] * 5, SCHEMA)).collect()}
        assert got == {i: f"text {i} of its own" for i in range(400)}


def test_one_page_sites_and_odd_rows(spark):
    rows = [(1, "http://b/", "<p>alone</p>"), (2, None, "<p>no url</p>"), (3, "x", None), (None, "http://b/", "<p>no id</p>"), (1, "http://b/", "<p>alone</p>")]
    got = X.extract(spark.createDataFrame([(*r, "e") for r in rows], SCHEMA + ", host string")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "alone", 5), ("1", "alone", 5), ("2", "no url", 6), ("3", "", 0), ("None", "no id", 5)]
    assert X.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(i, "http://c/", "<body><p>the same on all</p></body>") for i in range(20)]
    assert {r.text for r in X.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {"the same on all"}


def test_any_depth(spark):
    deep = "<div>" * 100_000 + "<p>far down</p>" + "</div>" * 100_000
    rows = [(1, "http://n/", deep), (2, "http://n/", "<b>" * 50_000 + "x" + "</u>" * 50_000)]
    assert {r.page_id: r.text for r in X.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: "far down", 2: "x"}


def slow_texts(pages):
    """The definition, page by page: a site's tree with every style and text that stands at a place, entropies of their shares, marks as the operator takes them."""
    from collections import Counter, defaultdict
    from math import log

    def block_kids(n):
        def holds(k):
            return any(isinstance(x, X.Node) and (x.tag in X.BLOCK or holds(x)) for x in k.kids)

        return [k for k in n.kids if isinstance(k, X.Node) and (k.tag in X.BLOCK or holds(k))]

    def branch(n, path, inside):
        kids = block_kids(n)
        style = tuple((k.tag, k.attrs) for k in kids) if kids else X.clean(X.inner_text(n))
        below = [branch(k, (*path, style, i, k.tag, inside or X.is_landmark(k)), inside or X.is_landmark(k)) for i, k in enumerate(kids) if not X.is_noise(k, inside)]
        return n, path, not kids, inside, style, below

    seen, roots = defaultdict(Counter), []
    for host, source in pages:
        root = X.parse(source)
        top = branch(root, (host,), False)
        roots.append((root, top))
        todo = [top]
        while todo:
            _, path, leaf, _, style, below = b = todo.pop()
            seen[path, leaf][style] += 1
            todo += below

    def entropy_importance(path, inside, leaf):
        n, prior = seen[path, leaf], X.PRIOR if inside else 0
        m = sum(n.values())
        if m < X.LEAST:
            return None
        shares = [c / (m + prior) for c in n.values()] + [1 / (m + prior)] * prior
        return -sum(p * log(p) for p in shares) / log(m + prior)

    def importance(b, low):
        n, path, leaf, inside, style, below = b
        m, prior = sum(seen[path, leaf].values()), X.PRIOR if inside else 0
        if leaf:
            shared = seen[path, leaf][style]
            out = 1.0 if m < X.LEAST or shared < 2 else 1 - log(shared) / log(m + prior)
            out = out if out < X.KEEP else 1.0
        elif not below:
            out = 1.0
        else:
            under = [importance(k, low) for k in below]
            own = entropy_importance(path, inside, leaf)
            share = X.GAMMA ** (1 if own is None else len(seen[path, leaf]))
            out = (1 - share) * (1.0 if own is None else own) + share * sum(under) / len(under)
        if out < X.KEEP and all(id(k[0]) in low for k in below):
            low.add(id(n))
        return out

    out = []
    for root, top in roots:
        low = set()
        importance(top, low)
        out.append("\n\n".join(X.blocks(root, low) or X.blocks(root, set())))
    return out


def test_against_a_slow_style_tree(spark):
    import random

    r = random.Random(11)
    shared = [f"<p>shared {i} on many pages</p>" for i in range(6)]

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(shared) if r.random() < 0.6 else f"<p>own {r.randint(0, 10**6)}</p>"
        tag = r.choice(["div", "section", "ul><li", "div class=x", "article", "footer", "div class=menu"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(r.randint(1, 3))) + f"</{tag.split()[0].split('>')[0]}>"

    sites = [(f"h{i}", [tree(3) if r.random() < 0.15 else None for _ in range(n)]) for i, n in enumerate((40, 25, 3))]
    pages = []
    for host, parts in sites:
        fixed = f"<div><p>Top of {host}</p>{shared[0]}</div>", f"<div>{shared[1]}<p>Made by {host}</p></div>"
        pages += [(host, f"<html><body>{fixed[0]}<div>{part or '<p>only %d</p>' % r.randint(0, 10**6)}</div>{fixed[1]}</body></html>") for part in parts]
    rows = [(i, f"http://{host}/{i}", source) for i, (host, source) in enumerate(pages)]
    got = {x.page_id: x.text for x in X.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = slow_texts(pages)
    assert [got[i] for i in range(len(rows))] == want
    assert sum(w != X.main_text(source, {}) for w, (_, source) in zip(want, pages, strict=True)) > len(pages) // 2  # the tree decides
