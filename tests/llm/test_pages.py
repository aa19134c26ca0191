import math
import random

import numpy as np
import pytest

from vigil.llm import pages as P

ROWS = "page_id long, url string, html string, text int, host int"


def text_of(html):
    found = P.blocks(html)
    return P.main_text(found, [(0.0, 0.0, 0.0)] * sum(not none for _, _, none in found))


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href=/x>Menu</a></ul></nav>
    <!-- ad --><div class="ad">Buy</div><article class=post><header><h1>A &amp; B&nbsp;c</h1></header><p><b>Bold
      text<br>more<p>x &lt;y&gt; &am<ul><li>one<li>two</ul><aside>no</aside><form>no<input value=">">no</form>tail<p>last</article>
    <section id="comments">said</section><div role="complementary">r</div><footer>&copy; F</footer></body>"""
    assert text_of(page) == "A & B c\nBold text more\nx <y> &am\none\ntwo\ntail\nlast"
    assert text_of("") == "" and text_of("<p>") == "" and text_of("plain < text <b>b</b") == "plain < text b"
    assert text_of("<article><p>cut off in <b>the mid") == "cut off in the mid"
    assert text_of("<div>a<span>b</span> c<div>d</div>e</div><script>x<p>y") == "ab c\nd\ne"
    assert text_of("<main><p>in</p><p hidden>no</p></main><p>out</p>") == "in"
    assert text_of("<article><![CDATA[a<b]]><svg><text>no</text></svg></article>") == "a<b"


def test_repeated_against_brute_force():
    rng = random.Random(1)
    for least in (2, 3, 5):
        for _ in range(20):
            pages = [[rng.randrange(4) for _ in range(rng.randint(0, 30))] for _ in range(4)]
            tokens, page = [], []
            for i, p in enumerate(pages):
                tokens += [*p, -1 - i]
                page += [i] * (len(p) + 1)
            want = np.zeros(len(tokens), bool)
            spots = {}
            for i in range(len(tokens) - least + 1):
                part = tokens[i : i + least]
                if min(part) >= 0:
                    spots.setdefault(tuple(part), []).append(i)
            for places in spots.values():
                if len({page[i] for i in places}) > 1:
                    for i in places:
                        want[i : i + least] = True
            assert (P.repeated(np.array(tokens), np.array(page), least) == want).all()


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 200):
        x = rng.integers(0, 3, n)
        assert P.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_extract(spark):
    words = [f"w{i}" for i in range(500)]
    rng = random.Random(3)
    line = " ".join(rng.choices(words, k=20))
    own = {i: " ".join(rng.choices(words, k=30)) for i in range(200)}
    plain = [(i, f"http://u@A.example:80/{i}", f"<div>{line}</div><div>{own[i]}</div><div>All of us</div>", 0, 0) for i in range(150)]
    named = [(i, "https://b.example/x?y", f"<p>{line}<article><p>{own[1]}<p>{line}</article>", 0, 0) for i in range(150, 200)]
    odd = [(900, None, None, 0, 0), (901, "http://c.example", "", 0, 0), (902, "c.example", f"<p>{line}", 0, 0), (None, "http://c.example", "<p>x y", 0, 0), (3, "http://a.example/3", plain[3][2], 0, 0), (903, "http://c.example", "<p>z " + "q " * 200_000, 0, 0)]
    rows = plain + named + odd
    got = P.extract(spark.createDataFrame(rows, ROWS).repartition(3)).collect()
    assert len(got) == len(rows)
    want = {i: own[i] for i in range(150)} | {i: f"{own[1]}\n{line}" for i in range(150, 200)} | {900: "", 901: "", 902: line, None: "x y", 903: "z " + " ".join(["q"] * 200_000)}
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)
    assert {r.url for r in got} == {r[1] for r in rows}
    assert P.extract(spark.createDataFrame([], ROWS)).count() == 0


def test_neither_groups_nor_pieces_hide_what_recurs(spark):
    rng = random.Random(5)
    line = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(20))
    shared, own = [line() for _ in range(100)], [line() for _ in range(200)]
    many = [(i, "http://d.example/", f"<div>{shared[i // 2]}</div><div>{own[i]}</div>", 0, 0) for i in range(200)]
    many += [(i, "http://e.example/", f"<div>{shared[i % 100]}</div>", 0, 0) for i in range(300, 301)]  # another host
    numbers = {i: " ".join(f"{i}.{k}" for k in range(P.TOKENS + 1)) for i in (400, 401)}
    long = [(i, "http://f.example/", f"<p>{shared[0]}<p>{numbers[i]}", 0, 0) for i in numbers]
    got = P.extract(spark.createDataFrame(many + long, ROWS).repartition(3)).collect()
    want = dict(enumerate(own)) | {300: shared[0]} | numbers
    assert len(got) == len(want) and all(r.text == want[r.page_id] for r in got)


def test_markup_that_is_not_quite_right():
    assert text_of("<html><head><title>t</title><body><article><p>here</article>") == "here"
    assert text_of("<head><meta charset=x><title>t</title><p>said<p>more") == "said\nmore"
    assert text_of("<article><p title=don't>hello</p><p>world</p></article>") == "hello\nworld"
    assert text_of("<article><a title='it>x</a> and <b class=\"c>y</b> it's</article>") == "x and y it's"
    assert text_of('<article><a title="x > y" b=\'<p>\'>z</a></article>') == "z"
    assert text_of("<article><section id='notice-of-change'><p>body</p></section><div class='related-posts x'>no</div><div class=ad>no</div><p class='legal-history'>yes</p></article>") == "body\nyes"


def test_what_nearly_all_pages_of_a_host_repeat_goes_from_articles_too(spark):
    rng = random.Random(8)
    line = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(12))
    notice, shared = line(), line()
    rows = [(i, f"http://{h}.example/{i}", f"<article><p>{line()}<p>{shared if i % 2 else line()}<p>{notice}</article>", 0, 0) for h, n in (("g", 40), ("h", 200)) for i in range(1000 * (h == "h"), 1000 * (h == "h") + n)]
    rows += [(5000 + i, "http://few.example/", f"<article><p>{line()}<p>{notice}</article>", 0, 0) for i in range(10)]
    for r in P.extract(spark.createDataFrame(rows, ROWS).repartition(3)).collect():
        assert notice not in r.text and (shared in r.text) == (r.page_id < 5000 and r.page_id % 2 == 1)


def test_the_size_of_a_host_changes_nothing(spark):
    rng = random.Random(9)
    line = lambda: " ".join(f"s{rng.randrange(10**6)}" for _ in range(15))
    both, own = line(), [line(), line()]
    rows, n = [], 0
    for size in (60, 640, 3000):
        for i in range(size):
            rows.append((n, f"http://n{size}.example/{i}", f"<p>{both}<p>{own[i]}" if i < 2 else f"<p>{line()}", 0, 0))
            n += 1
    got = {r.url: r.text for r in P.extract(spark.createDataFrame(rows, ROWS).repartition(4)).collect()}
    assert all(got[f"http://n{size}.example/{i}"] == own[i] for size in (60, 640, 3000) for i in (0, 1)) and len(got) == n


def wilson(k, n, z=1.96):
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def test_least_pages():
    for n in (1, 2, 3, 8, 9, 10, 19, 20, 64, 65, 640, 3000):
        for share in (P.WIDE_SHARE, P.LIKELY_SHARE):
            k = P.least_pages(n, share)
            assert all((wilson(x, n) >= share and x > 1) == (x >= k) for x in range(1, n + 1)), (n, share)


@pytest.mark.parametrize("times", [1, 2, 3])
def test_hosts_of_any_size_and_repeated_rows(spark, times):
    """A notice on all pages of a host goes, one on half of them stays, and so does the article: however large the host and however often its rows come."""
    rng = random.Random(12)
    line = lambda: " ".join(f"z{rng.randrange(10**6)}" for _ in range(16))
    notice, half, rows, want = line(), line(), [], {}
    for size in (10, 19, 20, 64, 65, 640, 3000):
        for i in range(size):
            own = line()
            url = f"http://size{size}.example/{i}"
            rows += [(len(want), url, f"<article><p>{own}<p>{notice}" + (f"<p>{half}" if i % 2 else "") + "</article>", 0, 0)] * times
            want[url] = own + (f"\n{half}" if i % 2 else "")
    got = P.extract(spark.createDataFrame(rows, ROWS).repartition(4)).select("url", "text").collect()
    assert len(got) == len(rows) and all(r.text == want[r.url] for r in got)


def test_names_in_an_article():
    """What a name says outright goes; what it only makes likely stays, unless the host repeats it."""
    assert text_of("<article><div class='site-notice'>We moved</div><div class='msg alert'>Cookies!</div><p>text</article>") == "text"
    assert text_of("<article><section class=header><p>intro</section><div class=legal><p>about law</div><p>text</article>") == "intro\nabout law\ntext"
    assert P.blocks("<article><div class=legal><p>about law</div><p>text</article>") == [("about law", True, None), ("text", True, False)]


def test_what_a_name_makes_likely_goes_where_the_host_repeats_it(spark):
    rng = random.Random(13)
    line = lambda: " ".join(f"y{rng.randrange(10**6)}" for _ in range(14))
    terms, said = line(), line()
    rows = [(i, f"http://l.example/{i}", f"<article><p>{i} {line()}" + (f"<div class=legal>{terms}</div><p>{said}" if i % 2 else "") + "<div class=legal>" + line() + "</div></article>", 0, 0) for i in range(30)]
    for r in P.extract(spark.createDataFrame(rows, ROWS).repartition(3)).collect():
        assert terms not in r.text and (said in r.text) == (r.page_id % 2 == 1) and len(r.text.split("\n")) == 2 + r.page_id % 2


def brute(rows, least=8):
    """The texts that extract() returns, by all substrings of a host as tuples of words."""
    hosts = {}
    for k, (i, url, html, *_) in enumerate(rows):
        hosts.setdefault((url or "").lower().split("//")[-1].split("/")[0], []).append((k, i if i is not None else f"row {k}", P.blocks(html or "")))
    out = {}
    for pages in hosts.values():
        padded = lambda b: b.split(" ") + [""] * (least - len(b.split(" ")))
        on = {}
        for _, i, found in pages:
            for b, _, none in found:
                w = padded(b)
                if not none:
                    for k in range(len(w) - least + 1):
                        on.setdefault(tuple(w[k : k + least]), set()).add(i)
        for k, _, found in pages:
            left = []
            for b, inside, none in found:
                if not none:
                    w, hit, wide = padded(b), set(), set()
                    share = P.WIDE_SHARE if none is False else P.LIKELY_SHARE
                    for j in range(len(w) - least + 1):
                        many = len(on[tuple(w[j : j + least])])
                        hit |= set(range(j, j + least)) if many > 1 else set()
                        wide |= set(range(j, j + least)) if many > 1 and wilson(many, len({i for _, i, _ in pages})) >= share else set()
                    left.append((b, inside, len(hit) / len(w), len(wide) / len(w)))
            if any(x[1] for x in left):
                whole = [x for x in left if x[1]]
                out[k] = "\n".join(x[0] for x in [x for x in whole if x[3] < 0.5] or whole)
            else:
                out[k] = "\n".join(x[0] for x in left if x[2] < 0.5)
    return out


def test_the_query_against_brute_force(spark, monkeypatch):
    rng = random.Random(10)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 25))) for _ in range(60)]
    rows = []
    for n, h in ((25, "p"), (150, "q"), (1, "r")):
        for i in range(n):
            tag = rng.choice(["div", "div", "article"])
            body = "".join(f"<p>{x}</p>" for x in [*rng.choices(lines, k=rng.randint(0, 4)), lines[0] if i % 12 else " ".join(rng.choices("xyzuvw", k=14))])
            rows.append((rng.choice([len(rows), len(rows), None, 7]), f"http://{h}.example/{i}", f"<nav>menu</nav><{tag}>{body}</{tag}><footer>end</footer>", 0, len(rows)))
    want = brute(rows)
    for group in (64, 4):
        monkeypatch.setattr(P, "GROUP", group)
        got = P.extract(spark.createDataFrame(rows, ROWS).repartition(3)).select("page_id", "url", "text").collect()
        assert sorted((r.url, r.text) for r in got) == sorted((rows[k][1], t) for k, t in want.items())


def test_numbers_in_ascending_order_are_coded_in_few_bits():
    rng = np.random.default_rng(14)
    for n, bits in ((0, 10), (1, 1), (2, 1), (5, 48), (1000, 10), (1000, 28), (1000, 47), (70_000, 48)):
        x = np.sort(rng.choice(1 << min(bits, 20), n, replace=False).astype(np.uint64) << np.uint64(bits - min(bits, 20)))
        data = P.coded(x, bits)
        assert P.decoded(data, bits).tolist() == x.tolist()
        assert len(data) <= 6 + n * (max(1, bits - math.log2(max(1, n))) + 2) / 8


def test_bins_and_buckets_against_brute_force(spark, monkeypatch):
    """Ids of several rows in several bins, and cells that unlike substrings share, change no count."""
    rng = random.Random(15)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 20))) for _ in range(50)]
    rows = []
    for i in range(150):
        body = "".join(f"<p>{x}" for x in [*rng.choices(lines, k=rng.randint(0, 3)), lines[0] if i % 12 else lines[1], " ".join(rng.choices("stuvw", k=12))])
        tag = rng.choice(["div", "article", "article"])
        rows.append((rng.choice([i, i, None, 7, 8]), f"http://q.example/{i}", f"<{tag}>{body}</{tag}>", 0, i))
    want = sorted((rows[k][1], t) for k, t in brute(rows).items())
    for name, value in (("GROUP", 4), ("LEAST_BIN_CHARS", 500), ("BUCKET_CHARS", 5000)):
        monkeypatch.setattr(P, name, value)
    for spare in (32, 0):
        monkeypatch.setattr(P, "SPARE", spare)
        got = P.extract(spark.createDataFrame(rows, ROWS).repartition(3)).select("url", "text").collect()
        assert sorted(map(tuple, got)) == want


def shuffled(spark):
    """Bytes written to shuffles so far."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_what_is_exchanged_is_little_more_than_the_pages(spark, tmp_path):
    """Not six bytes for each substring: pages and all that is told about them stay below 1.6 times the compressed pages."""
    rng = random.Random(16)
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 9))) for _ in range(3000)]
    rows = [(i, f"http://s.example/{i}", f"<nav>{' '.join(rng.choices(words, k=60))}</nav><article><p>{' '.join(rng.choices(words, k=500))}</article>", 0, 0) for i in range(1500)]
    pages = spark.createDataFrame(rows, ROWS).repartition(2)
    pages.write.parquet(f"{tmp_path}/pages")
    size = sum(f.stat().st_size for f in (tmp_path / "pages").iterdir())
    before = shuffled(spark)
    assert P.extract(spark.read.parquet(f"{tmp_path}/pages")).where("text = ''").count() == 0
    assert shuffled(spark) - before < 1.6 * size
