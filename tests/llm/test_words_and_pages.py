"""Main text of pages, spelling variants and collocations: against the SQL, plain versions and pages made by hand."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tessaro.llm import collocations, html_text, queries, spelling_variants

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, word string, n long, h long, part int, m0 int, band int, rank long"


def extras(rows):
    return [(*r, "w", 1, 2, 3, 4, 5, 6) for r in rows]


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def near(a, b):
    """One insertion, deletion or replacement apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best is not None and n[best] >= 5 * n[w] else None, len(others))
    rows = []
    for w, (form, count) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n[w], count, None if form is None else n[form]))
    return sorted(rows)


def plain_phrases(docs, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in candidates.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        rows = []
        for p, a in candidates.items():
            if len(p) == 2 and 100 * longer[p] >= 50 * a:
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = queries.queries()[name](spark, SF).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))


def spelled():
    """A word with variants by each kind of edit, chains of forms, ties, Latin-1 letters, long and short words."""
    rng = random.Random(5)
    docs = []
    for word, n in {"received": 400, "recieved": 9, "receved": 60, "recived": 6, "receivedd": 12, "xreceived": 5, "RECEIVED": 7, "Éclair": 30, "éclair": 150, "éclairs": 150, "clairs": 6, "short": 90, "anagram": 8, "nagaram": 8, "naïvely": 40, "naively": 8, "a" * 900: 5, "a" * 901: 30}.items():
        docs += [word] * n
    docs += [w for i in range(60) for w in [f"bucket{chr(97 + i % 26)}{chr(97 + i // 26)}"] * (5 + i % 7)]
    rng.shuffle(docs)
    rows = [(i, " ".join(docs[i * 10 : i * 10 + 10]) + ("; 123\n" if i % 3 else "-×÷-")) for i in range(len(docs) // 10 + 1)]
    return [*rows, (7, rows[7][1]), (None, rows[3][1]), (None, None), (9999, ""), (10000, "x" * 200_000 + " received")]


@pytest.mark.parametrize("bucket", [2048, 3, 0])
def test_variants_against_a_plain_version(spark, bucket):
    rows = spelled()
    docs = spark.createDataFrame(extras([(i, t, "en") for i, t in rows]), CLASHING).repartition(3)
    got = [tuple(r) for r in spelling_variants.spelling_variants(docs, bucket).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert sorted(got) == plain_variants(rows)


def test_hot_buckets_lose_no_pair(spark):
    """Many words of equal bits in a band: split or whole, the pairs are the same."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdéf") for _ in range(rng.randint(6, 8))) for _ in range(400)})
    frame = spelling_variants.with_masks(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
    for bucket in (10**6, 20):
        got = [tuple(sorted((r["a"], r["b"]))) for r in spelling_variants.near_pairs(frame, bucket).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def phrases():
    rng = random.Random(2)
    names = ["new", "york", "city", "of", "the", "House", "café", "\x00odd", "ß", "end"]
    rows = [(rng.choice(["en", "fr", None]), " ".join(rng.choice(names) for _ in range(rng.randint(0, 60))) + rng.choice([".", "!\n", "\t;"])) for _ in range(120)]
    rows += [("en", "New York City. " * 40), ("en", "the the the the the " * 30), ("und", "new york new york"), ("fr", None), (None, ""), ("xx", "only here")]
    return [*rows, rows[0], rows[0], ("de", "sehr lang " * 50_000)]


@pytest.mark.parametrize("part_rows,top", [(1 << 19, 2000), (7, 5)])
def test_collocations_against_a_plain_version(spark, part_rows, top):
    rows = phrases()
    docs = spark.createDataFrame(extras([(1, t, g) for g, t in rows]), CLASHING).repartition(3)
    got = collocations.collocations(docs, part_rows=part_rows, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, top=top)


def test_sums_in_a_tree():
    import numpy as np

    assert [int(collocations.tree_sum(iter([np.array([i]) for i in range(n)]))[0]) for n in (1, 2, 7, 8, 100)] == [0, 1, 21, 28, 4950]


def test_empty_tables(spark):
    none = spark.createDataFrame([], CLASHING)
    assert spelling_variants.spelling_variants(none).count() == 0
    assert collocations.collocations(none).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train(spark)


def test_tree_learns_its_table(tree):
    import numpy as np

    rows = html_text.labelled()
    assert len(rows) < 200
    assert (tree.main(np.array([x for _, x in rows])) == np.array([y > 0 for y, _ in rows])).mean() > 0.97


MADE = [
    (
        '<html><body><div class="site-header"><a href=/>Home</a> My site</div><div id="cookie-bar">We use cookies to give you the best of this site, so please accept.</div><div class="wrapper has-sidebar">'
        '<aside>About me: I write things about other things, every day.</aside><div class="post-content"><h1>Title &amp; more</h1><p>First with a <a href=x>link</a>.<p>Second   one<br>broken<br><br>new block<ul><li>One<li>Two</ul>'
        '<div class="ad">Buy now</div><blockquote>Quote</blockquote><form>Subscribe <input name=a><button>Go</button></form></div><section id="comments"><h3>2 comments</h3><article><p>I liked this post and say so with many words here.</p></article></section></div><footer>2020</footer>',
        "Title & more\n\nFirst with a link.\n\nSecond one broken\n\nnew block\n\nOne\n\nTwo\n\nQuote",
    ),
    ("<article><header><h1>T</h1></header><p title=\"a > b\">x &lt; y &copy; 1 < 2&nbsp;</p><pre>code\n  here</pre><footer>posted</footer></article>", "T\n\nx < y © 1 < 2\n\ncode here"),
    ('<form id="all"><div class="nav">a b</div><div class="content"><p>Hello there my text.</p><form>sub</form><p>End</p></div></form>', "Hello there my text.\n\nEnd"),
    ('<nav><article><p>x y</p></article></nav><main><p>a<b>b</b>c<!-- no <p> --></p><script>if (a < b) "</p>"</script><p hidden>h</p></main>', "abc"),
    ('<div class="ad">never closed<article><p>hello</p></article>', "hello"),
    ("plain text only, without any tags at all, but with quite a few words", "plain text only, without any tags at all, but with quite a few words"),
    ("<table><tr><td><a href=a>Home</a><td><a href=b>News</a></tr></table><h2>Headline of the day</h2><p>" + "word " * 60 + "</p><p>Short one.</p><p>" + "more " * 40 + "</p><p><a href=x>Next</a> | <a href=y>Prev</a></p><p>All rights reserved.</p>", "Headline of the day\n\n" + ("word " * 60).strip() + "\n\nShort one.\n\n" + ("more " * 40).strip()),
    ("<article><p>cut of", "cut of"),
    ("", ""),
    (None, ""),
    ("<article><p>" + "long " * 300_000 + "</p></article>", ("long " * 300_000).strip()),
]


def test_pages_made_by_hand(spark):
    rows = [(i, f"u{i}", html, "clash", 5, "x") for i, (html, _) in enumerate(MADE)]
    rows += [(None, None, MADE[0][0], "clash", 5, "x"), rows[1]]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, region string")).collect()
    want = [(i, f"u{i}", text, len(text)) for i, (_, text) in enumerate(MADE)]
    want += [(None, None, MADE[0][1], len(MADE[0][1])), want[1]]
    assert Counter(tuple(r)[:4] for r in got) == Counter(want)


def test_given_pages_have_their_articles(spark):
    """The article's blocks, by a plain reading of the given pages."""
    from html import unescape

    for page in queries.op11_html_text(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*?)</article>", page["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert page["text"] == "\n\n".join(x for x in parts if x)


@pytest.mark.parametrize("piece", ['<a "', "<", "<div>", '<p x="' + ">" * 50, "<!--", "<script>", "&", "<p a='\"", "<li>", "<b x='", "<p " + "class " * 9 + ">", "<br>", "x<a>"])
def test_broken_pages_take_linear_time(tree, piece):
    html_text.main_text(piece * 20_000, tree)
