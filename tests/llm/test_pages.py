import pytest

from stratavane.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p><article>no";</script></head>
<body><header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <article>no --><div class="ad">Buy {n}</div>
<article><h1>Head &amp; line {n}</h1><p><b>First   para{n}<br>broken{n} <i>in</i>line<p>Second&nbsp;one {n}</p>
<p class="house-style">The same words on every page.</p><div class="newsletter">Join</div>
<ul><li>one{n}<li>two</ul><form><input>Name</form></article><section id="comments"><article>Reader {n}</article></section>
<aside>More</aside><footer>&copy; us</footer></body></html>"""


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", 5) for i, u, h in rows], "page_id long, url string, html string, text string, low int")


def test_main_text_of_a_page():
    assert pages.main_text(PAGE.format(n=7)) == "Head & line 7 First para7 broken7 inline Second one 7 The same words on every page. one7 two"


def test_branches_of_low_importance_go(spark):
    rows = [(i, f"http://user@h.example:80/{i}", PAGE.format(n=i)) for i in range(12)] + [(99, "http://other.example/", PAGE.format(n=99).replace("house-style", "own-style"))]
    got = {r["page_id"]: r for r in pages.extract(frame(spark, rows).repartition(3)).collect()}
    assert got[3]["text"] == "Head & line 3 First para3 broken3 inline Second one 3 one3"
    assert "same words" in got[99]["text"] and got[99]["n_chars"] == len(got[99]["text"])


def test_copies_of_a_page_keep_their_article(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=1)) for i in range(30)]
    assert all("First para1" in r["text"] for r in pages.extract(frame(spark, rows)).collect())


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("no markup, 1 < 2 & 3 > 2", "no markup, 1 < 2 & 3 > 2"),
        ("<p>open <b>bold<p>next", "open bold next"),
        ("<div>a<span>b</span>c</div><div>d</div>", "abc d"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article>", "T x"),
        ("<p title='a > b' data-x=\"<p>\">x</p>", "x"),
        ("<script>never ends <p>x", ""),
        ("<!-- never ends <p>x", ""),
        ("&lt;p&gt; &#233;&eacute; &bogus; a&nbsp; b", "<p> éé &bogus; a b"),
        ("<main><p>m</p></main><p>outside</p>", "m"),
        ("<div role=navigation>n</div><div class=sideBar>s</div><p>x</p>", "x"),
        ("<p>" * 3000 + "deep", "deep"),
    ],
)
def test_markup(html, text):
    assert pages.main_text(html) == text


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, "<p>x</p>"), (2, "nonsense", None), (None, "http://a.example", ""), (3, "", "<p>y"), (3, "", "<p>y")]
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in pages.extract(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, None, "x", 1), (2, "nonsense", "", 0), (None, "http://a.example", "", 0), (3, "", "y", 1), (3, "", "y", 1)], key=str)
    assert pages.extract(frame(spark, [])).collect() == []


def brute(rows):
    """Importances and texts of the site from the definition, host by host, over plain dictionaries."""
    import collections
    import math

    host = lambda u: (u or "").split("//")[1].split("/")[0] if "//" in (u or "") else None
    seen = {}
    for _, u, h in rows:
        p = pages.Page(h or "")
        if host(u) is not None:
            seen[host(u), "\n".join(t for _, t, dropped, _ in p.texts if not dropped)] = p
    layouts, texts, label = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), {}
    for (where, _), p in seen.items():
        for path in set(p.path):
            label[path] = p.label[p.path.index(path)]
            layouts[where, path]["|".join(" ".join(x) for q, x in zip(p.path, p.layout) if q == path)] += 1
        for path, t in {(p.path[n], t) for n, t, *_ in p.texts}:
            texts[where, path][t] += 1
    plain = {}
    for key, own in layouts.items():
        m = sum(own.values())
        entropy = -sum(k / m * math.log(k / m) for k in own.values()) / math.log(m + 2)
        held = texts.get(key)
        mean = sum(math.log(k) for k in held.values()) / len(held) / math.log(m + 2) if held else None
        plain[key] = m, len(own), 1.0 if m == 1 else entropy, None if mean is None else 1 - mean
    out = []
    for i, u, h in rows:
        p = pages.Page(h or "")
        stats, shared = {}, set()
        for path in set(p.path) if host(u) is not None else ():
            m, styles, *own = plain[host(u), path]
            for c in (0, 1):
                others = [(v[0] - 1, v[2 + c]) for (_, q), v in plain.items() if label[q] == label[path] and v[2 + c] is not None]
                total = sum(w for w, _ in others)
                if own[c] is not None:
                    wide = sum(w * x for w, x in others) / total if total else own[c]
                    own[c] = (m * own[c] + pages.LEAN * wide) / (m + pages.LEAN)
            stats[path] = styles, own[0], 1.0 if own[1] is None else own[1]
            shared |= {(path, t) for t, k in texts[host(u), path].items() if k > 1 and math.log(k) / math.log(m + 2) >= pages.ENTROPY}
        out.append((i, " ".join(pages.keep_texts(p, p.path, [(p.path[n], t) for n, t, *_ in p.texts], stats, shared))))
    return sorted(out, key=str)


def test_a_small_web_against_plain_dictionaries(spark):
    import random

    rng, rows = random.Random(4), []
    for i in range(60):
        site = rng.choice(["a", "a", "b", "c", "d"])
        boxes = "".join(f"<div class='box{rng.randrange(2)}'><p>{rng.choice(['more to read', 'all rights', f'story {i}'])}</p></div>" for _ in range(rng.randrange(4)))
        body = "".join(f"<p>word {rng.randrange(1000)} of {i}</p>" for _ in range(rng.randrange(1, 5)))
        rows.append((i, f"http://{site}.example/{i}", f"<div class=top><ul><li>home<li>news {site}</ul></div><div class=story><h1>title {i}</h1>{body}</div>{boxes}<div class=end>since 1999</div>"))
    rows += [(100, rows[0][1], rows[0][2]), (101, None, rows[1][2])]
    got = sorted(((r["page_id"], r["text"]) for r in pages.extract(frame(spark, rows).repartition(4)).collect()), key=str)
    assert got == brute(rows)
    kept = dict(got)
    assert all("home" not in t and "since 1999" not in t and f"title {i}" in t for i, t in kept.items() if i < 60)


def test_a_class_counts_only_if_all_its_words_say_so():
    assert pages.main_text("<article><p>a</p><div class='related-work'>b</div><div class='ad-box'>c</div><p class='siteFooter'>d</p></article>") == "a b"
