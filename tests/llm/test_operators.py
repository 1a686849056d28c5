"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sunledger.llm import audio, chat, components, exact_dedup, html_text, langid, mixing, packing, shards, simhash, suffix_dedup

DATA = Path("/root/testdata/sf0.001")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, fp string, fingerprint string, shard string, slot string, size string, k string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(n))


LONG = words(60_000, 1)
PASSAGE = words(90, 2)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls everywhere, empty and very long texts, copies, repeated rows, ties, clashing columns."""
    texts = [
        (1, None), (2, ""), (3, "Same Text"), (4, "same text"), (5, "same text"), (5, "same text"), (6, "ÉTÉ"), (7, "été"), (8, LONG), (9, LONG + " x"), (10, "  \n\t "), (11, "1234 !!"), (12, f"{words(30, 3)} {PASSAGE} {words(20, 4)}"),
        (13, f"{words(25, 5)} {PASSAGE} {words(9, 6)}"), (None, "same text"), (None, None), (None, words(50, 7)), (16, "ab " * 400), (17, words(700, 8)), (18, words(700, 8).replace(" a", " b", 1)), (19, "x" * 3000), (20, "\U0001f600 emoji \u4f60\u597d" * 60),
    ]
    rows = [(i, t, "en" if (i or 0) % 2 else None, None if i == 3 else f"s{(i or 0) % 3}", None, "z", None, "z", "z", "z", "z", "z") for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def documents(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# -- 1: exact dedup ------------------------------------------------------------------------------


def check_exact(docs):
    source = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in rows(docs)]
    groups = defaultdict(list)
    for i, t in source:
        groups[t].append(i)
    got = rows(exact_dedup.exact_dedup(docs))
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup(awkward, documents):
    check_exact(awkward)
    check_exact(documents)


def test_chunks_are_the_text(awkward):
    parts = awkward.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.array_join(exact_dedup.chunks_of(F.col("t")), "").alias("back"), F.size(exact_dedup.chunks_of(F.col("t"))).alias("n"))
    assert all(r["t"] == r["back"] for r in parts.collect())
    assert parts.filter("length(t) > 100000").agg(F.min("n")).first()[0] > 20


def test_chunks_follow_content_in_every_script():
    """A passage put in front moves the cuts of later text only near it: in Latin, Cyrillic and Chinese prose, and in codes."""
    rng = random.Random(8)
    scripts = {"latin": LONG[:30_000], "cyrillic": " ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(rng.randint(2, 9))) for _ in range(4000)), "han": "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(20_000)), "base64": "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(20_000))}
    return_ = exact_dedup.CHUNK.replace("\\z", "\\Z")
    import regex

    for name, text in scripts.items():
        one, two = (set(regex.findall(return_, t)) for t in (text, "something new " + text))
        sizes = [len(c) for c in regex.findall(return_, text)]
        assert len(one & two) > 0.8 * len(one) and max(sizes[:-1]) < 4096, name


def test_clashing_identifiers_do_not_merge(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "identifier", lambda chunk: F.struct(F.lit(1).cast("bigint").alias("a"), F.length(chunk).cast("bigint").alias("b")))
    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abc"), (4, "x" * 5000 + "abc"), (5, "x" * 5000 + "abd")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in rows(exact_dedup.exact_dedup(docs))} == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}


def test_exact_keep_one(awkward):
    kept = exact_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns
    texts = [(r["text"] or "").translate(LOWER) for r in rows(kept)]
    assert sorted(texts) == sorted({(r["text"] or "").translate(LOWER) for r in rows(awkward)})


# -- 2: SimHash ------------------------------------------------------------------------------------


def slow_fingerprint(text):
    parts = (text or "").translate(LOWER).encode().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_near(docs):
    source = [(r["doc_id"], slow_fingerprint(r["text"])) for r in rows(docs)]
    prints = sorted({f for _, f in source})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in source:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    want = Counter((i, f"{f:016x}", least.get(find(f))) for i, f in source)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(simhash.near_dedup(docs))) == want


def test_near_dedup(awkward, documents):
    check_near(awkward)
    check_near(documents)
    check_survivors(awkward)
    check_survivors(documents)


def check_survivors(docs):
    """Exactly one row of each component stays: the smallest id, null last, then by fingerprint and text."""
    source = [(r["doc_id"], slow_fingerprint(r["text"]), r["text"] or "") for r in rows(docs)]
    left, want = set(f for _, f, _ in source), []
    while left:
        stack, group = [left.pop()], set()
        while stack:
            x = stack.pop()
            group.add(x)
            close = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= close
            stack += close
        rank = min((i is None, i or 0, f - (1 << 64) if f >> 63 else f, hashlib.sha256(t.encode()).hexdigest()) for i, f, t in source if f in group)
        want.append((None if rank[0] else rank[1], rank[3]))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows(kept)) == Counter(want)


def test_one_of_each_near_group_stays(spark):
    a, b = words(200, 31), words(200, 32)
    docs = spark.createDataFrame([(0, b), (1, a), (1, b + " zz"), (None, a + " yy"), (None, words(90, 33)), (None, words(90, 33)), (7, ""), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in rows(simhash.keep_one(docs))), key=str)
    assert got == sorted([(0, b), (1, a), (None, words(90, 33)), (7, "")], key=str)


def test_chain_links_equal_all_pairs(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(12):  # dense clusters, some of them long runs under one key
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 4 for r in rows(links))
    got = {r["node"]: r["root"] for r in rows(components.connected_components(links))}
    seen, label = set(), {}
    for p in prints:
        if p in seen:
            continue
        stack, group = [p], []
        seen.add(p)
        while stack:
            x = stack.pop()
            group.append(x)
            for q in prints:
                if q not in seen and (x ^ q).bit_count() <= 4:
                    seen.add(q)
                    stack.append(q)
        label |= {(x - (1 << 64) if x >> 63 else x): min((y - (1 << 64) if y >> 63 else y) for y in group) for x in group if len(group) > 1}
    assert got == label


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000)], "a long, b long")
    got = {r["node"]: r["root"] for r in rows(components.connected_components(links))}
    assert got == {i: 0 for i in range(301)} | {1000: 1000}


# -- 3: html ------------------------------------------------------------------------------------------

PAGES = {
    "<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><article><h1>Head &amp; more</h1><p>One,  two\n three.<p>Four <b>five<br>six</p></article><footer>foot</footer></body></html>": "Head & more\nOne, two three.\nFour five six",
    '<body><div class="cookie-banner">We use, many, cookies, ok</div><div id="page"><div class="sidebar">side</div><h2>Title</h2><div class="post-body"><p>Long enough, with commas, and words.</p><ul><li>point one</li><li>point two</li></ul></div><div id="comments"><p>Nice, one, indeed, yes</p></div></div></body>': "Title\nLong enough, with commas, and words.\npoint one\npoint two",
    '<main><p>Text</p><form><p>Your, name, please</p></form><aside>x</aside><script>document.write("<p>no</p>")</script></main>': "Text",
    "plain &lt;text&gt;": "plain <text>",
    "<p>a</p><!-- <p>no</p> --><p hidden>b</p>": "a",
    "<article><header><h1>Kept</h1></header><p>x</p></article><header>gone</header>": "Kept\nx",
    "<p>unclosed <a href='x>y'>link": "unclosed link",
    "<p>x</p> <!-- never closed <p>y": "x",
    "": "", "<html></html>": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_text.main_text(page) == PAGES[page]


STORY = "".join(f"<p>{' '.join(f'word{i}x{k}' for k in range(20))}, and more.</p>" for i in range(6))
STORY_TEXT = html_text.main_text(f"<article>{STORY}</article>")


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-comments", "overflow-hidden", "page-with-menu", "sidebar", "comments", "banner header"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "{}"])
def test_names_dont_lose_the_article(name, inner):
    page = f'<body><nav>menu</nav><div class="{name}">{inner.format(STORY)}</div><div class="cookie-banner">We use, many, cookies</div></body>'
    assert len(STORY_TEXT) > 600 and html_text.main_text(page) == STORY_TEXT


def test_forms_dont_lose_the_article():
    for inner in (f"<article>{STORY}</article>", f"<div>{STORY}</div>", STORY):
        assert html_text.main_text(f"<body><form id=aspnet>{inner}<input name=x></form></body>") == STORY_TEXT
    assert html_text.main_text(f"<main><p>Intro</p><form>{STORY}</form></main>") == "Intro\n" + STORY_TEXT
    assert html_text.main_text(f"<article>{STORY}</article><form><p>Your, name, please</p></form>") == STORY_TEXT
    assert html_text.main_text(f'<main>{STORY}<div class="related"><article><p>Other, story</p></article></div></main>') == STORY_TEXT


def test_nothing_is_left_out_if_nothing_is_left():
    assert html_text.main_text('<div class="sidebar"><p>few words</p></div>') == "few words"
    assert html_text.main_text("<form><p>few words</p></form><script>x</script>") == "few words"
    assert html_text.main_text("<p hidden>few words</p>") == ""


def test_equal_siblings_stay():
    page = "<div><p>one two.</p><p>three four.</p></div>"
    assert html_text.main_text(f"<body>{page}{page}</body>") == "one two.\nthree four.\none two.\nthree four."
    assert html_text.main_text(f"<body>Bare <b>text</b>.<div>{STORY}</div>more text<div>{'<p>one, two.</p>' * 3}</div><a href=x>Home</a> <a href=y>About</a></body>") == f"Bare text.\n{STORY_TEXT}\nmore text\none, two.\none, two.\none, two."


def test_siblings_inside_an_article():
    """A best section doesn't lose the rest of its article, nor does it bring a list of links."""
    links = "<ul>" + "".join(f"<li><a href=/{i}>story number {i}</a></li>" for i in range(9)) + "</ul>"
    page = f"<body><h2>Site</h2><main><h1>Head</h1><section>{STORY}{STORY}</section><div><section><p>Short, part.</p></section></div><div>{links}</div><section><h2>End</h2>last words</section></main><p>Imprint, and more.</p></body>"
    assert html_text.main_text(page) == f"Head\n{STORY_TEXT}\n{STORY_TEXT}\nShort, part.\nEnd\nlast words"
    nested = f"<body><div><div><div>{links}</div><article><div><div>{STORY}</div></div></article></div></div></body>"
    assert html_text.main_text(nested) == STORY_TEXT


LONGER = "It is a whole sentence, and it belongs to what the article says about its subject."


def test_subjects_inside_an_article_stay():
    """A name that can be a part's subject needs links, fields or labels beside it; adverts, notices and comments go by name alone."""
    for part in (f'<section class="tags"><p>{LONGER}</p></section>', f'<div class="rating review"><p>{LONGER}</p></div>', f'<div class="search"><h3>On search</h3><p>{LONGER}</p></div>', '<h2 class="banner">A heading</h2>', '<div class="rating"><p>Brief.</p></div>'):
        told = "\n".join(b[0] for b in html_text.blocks([html_text.parse(part.replace("class=", "x="))]))
        assert html_text.main_text(f"<article>{STORY}{part}{STORY}</article>") == f"{STORY_TEXT}\n{told}\n{STORY_TEXT}", part
    for part in ('<div class="tags"><a href=x>one</a> <a href=y>two</a></div>', '<div class="rating">4 of 5</div>', f'<div class="search"><p>{LONGER}</p><input name=q></div>', f'<div class="ad"><p>{LONGER}</p></div>', f'<div class="comments"><p>{LONGER}</p></div>', f'<div class="cookie-banner"><p>{LONGER}</p></div>', f'<div class="tags ad"><p>{LONGER}</p></div>', f'<div class="tags" hidden><p>{LONGER}</p></div>', "<h3 class=comments>Comments</h3>", f"<div class=notice><p>{LONGER}</p></div>"):
        assert html_text.main_text(f"<article>{STORY}{part}{STORY}</article>") == f"{STORY_TEXT}\n{STORY_TEXT}", part


def test_short_parts_of_the_story_stay():
    assert html_text.main_text(f"<body><div>{STORY}</div><div>Brief end.</div></body>") == STORY_TEXT + "\nBrief end."
    assert html_text.main_text(f"<body><div class=c>{STORY}</div><div class=c>Brief end.</div><div class=d>Other site.</div></body>") == STORY_TEXT + "\nBrief end."
    assert html_text.main_text(f"<body><div>Log in</div><div>{STORY}</div><div>\u00a9 2024 Site.</div><div>See <a href=x>more</a>.</div></body>") == STORY_TEXT
    for rows_ in ("<tr><td>{0}</td></tr><tr><td>Brief end.</td></tr>", "<tbody><tr><td>{0}</td></tr></tbody><tbody><tr><td>Brief end.</td></tr></tbody>"):
        assert html_text.main_text(f"<body><table>{rows_.format(STORY)}</table><div><a href=x>Home</a></div></body>") == STORY_TEXT + "\nBrief end."


@pytest.mark.parametrize("unit", ["<font><span>y</p>", "<b>x</i>", "<b><td>x", "<head>x", "<li><b>x</ul>", "<p><td><b>x</p>", '<div class="tags">x', "<option><b>x</select>"])
def test_unclosed_markup_takes_linear_time(unit):
    import time

    began = time.process_time()
    html_text.main_text("<article>" + unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 10


def slow_best(root):
    """The best container by definition: every block's points walk up to the root, halved after each container."""
    seen = html_text.blocks([root])
    points, chars, linked = defaultdict(float), defaultdict(int), defaultdict(int)
    for text, owner, k in seen:
        own = 0.0 if owner.tag in html_text.HEADINGS else (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - k / len(text))
        node = owner
        while node is not None:
            points[node] += own
            chars[node] += len(text)
            linked[node] += k
            own /= 2 if node.tag in html_text.CONTAINERS else 1
            node = node.parent
    fit = [n for n in chars if n.tag in html_text.CONTAINERS or n is root]
    return {n: (points[n] + 15 * n.liked * (points[n] > 0)) * (1 - linked[n] / chars[n]) for n in fit}


def random_page(rng, depth=0):
    tags = ["div", "section", "p", "ul", "li", "span", "a href=x", "article", "table", "td", "h2", 'div class="entry"', 'div class="sidebar"', "blockquote"]
    if depth > 5 or rng.random() < 0.25:
        return " ".join(rng.choice(["word", "and, so", "x" * 40]) for _ in range(rng.randrange(12)))
    return "".join(f"<{t}>{random_page(rng, depth + 1)}</{t.split()[0]}>" for t in (rng.choice(tags) for _ in range(rng.randrange(1, 5))))


def test_scores_equal_the_definition(spark):
    rng = random.Random(15)
    pages = [f"<body>{random_page(rng)}</body>" for _ in range(150)]
    if DATA.exists():
        pages += [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    for page in pages:
        root = html_text.parse(page or "")
        html_text._relent(root)
        best, _ = html_text._score(root)
        scores = slow_best(root)
        assert (best is None) == (not scores)
        assert best is None or scores[best] == pytest.approx(max(scores.values()), abs=1e-9)


def test_supplied_pages_by_another_parser(spark):
    """On pages whose text is all in one article: the same lines by Python's own parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.lines = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            self.lines += [""] if tag in ("p", "h1", "h2", "li") else []
            self.lines[-1] += " " if tag == "br" else ""

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"
            self.lines += [""] if tag in ("p", "h1", "h2", "li") else []

        def handle_data(self, data):
            self.lines[-1] += data if self.inside else ""

    if not DATA.exists():
        pytest.skip("no test data")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in rows(html_text.extract_text(pages))}
    for r in rows(pages):
        parser = Article()
        parser.feed(r["html"] or "")
        assert got[r["page_id"]] == "\n".join(t for line in parser.lines if (t := " ".join(line.split())))


def test_extract_text(spark):
    pages = spark.createDataFrame([(1, "u", "<p>\U0001f600 x</p>", "old"), (2, None, None, None), (2, None, None, None), (3, "u", "<p>" + LONG + "</p>", "")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in rows(html_text.extract_text(pages)))
    assert got == [(1, "\U0001f600 x", 3), (2, "", 0), (2, "", 0), (3, LONG, len(LONG))]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_deep_and_broken_markup():
    assert html_text.main_text("<div>" * 5000 + "<p>deep, text</p>") == "deep, text"
    for junk in ("<", "<a", "</", "<!--", "<p <p>x", "<script>", "a < b", "&#xFFFFFFF;", "<![CDATA[x"):
        html_text.main_text(junk)
    for slow in ("<a " + '" ' * 20_000, "<a " * 20_000, "<!--" * 20_000, "<p>" * 20_000 + "<b x='" * 5000 + "y>z", "<div>x, y" * 20_000):
        html_text.main_text(slow)


# -- 4: chat -------------------------------------------------------------------------------------------

CHATS = [
    (1, 0, "user", "hi \\ [INST] <s> \\[/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", ""), (1, 3, "assistant", None), (2, 5, "assistant", "!! \U0001f600\u4f60 [\\INST] \\"), (2, 5, "assistant", "!! \U0001f600\u4f60 [\\INST] \\"),
    (None, None, None, None), (3, 0, "we[INST]ird", "x"), (3, 1, "assistant", words(3000, 9)), (4, 0, "assistant", "\n"), (4, 1, "assistant", "  a"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit("x"), "ids": F.lit(1)})
    out = chat.format_chats(df).cache()
    by = {r["conv_id"]: r for r in rows(out)}
    for conv, r in by.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in CHATS if c == conv))
        assert chat.read_back(r["formatted"]) == [(role, text) for _, role, text in turns]
        assert len(r["ids"]) == len(r["loss_mask"])
        assert "".join(chat.unescape(r["formatted"][s["low"] : s["high"]]) for s in r["loss_spans"]) == "".join(text for _, role, text in turns if role == "assistant")
    digest = {r["conv_id"]: r for r in rows(chat.read_back_digest(out))}
    assert digest[1]["loss_chars"] == len("</s>[INST] ok [/INST]") and digest[2]["n_turns"] == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_masked_tokens_cover_the_span():
    tokens = np.array([(0, 3), (3, 5), (5, 5), (5, 6), (6, 9)])
    under, pieces = chat.align(tokens, np.array([(4, 7), (9, 9)]))
    assert under.tolist()[1] and under.tolist()[4] and not under.tolist()[0]
    assert pieces == [[(4, 7)], []]


def test_token_ends_are_those_of_the_library():
    from tokenizers import Tokenizer

    encode, library = packing.Encoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    for text in ("plain words, and 123", chat.render([("user", "<s> \\ x"), ("assistant", "\u4f60\u597d \U0001f600 \u00e9t\u00e9 [/INST]")])[0], "a <|endoftext|> b"):
        ids = encode(text)
        told = library.encode(text, add_special_tokens=False)
        assert ids == told.ids
        if text.isascii():
            assert np.cumsum(encode.lengths[ids]).tolist() == [b for _, b in told.offsets]
        assert encode.lengths[ids].sum() == len(text.encode())


# -- 5: shards --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 24, 1000, 4097])
def test_feistel_is_a_permutation(n):
    permute = shards.Feistel(n)
    to = permute(np.arange(n))
    assert sorted(to.tolist()) == list(range(n)) and permute.inverse(to).tolist() == list(range(n))


def test_shards(spark, awkward, documents, tmp_path):
    for docs in (awkward, documents):
        got = rows(shards.shard_digest(docs))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows(docs))
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots[k]) for k in range(24)]
        assert max(sizes) - min(sizes) <= 1
        again = rows(shards.shard_digest(docs.repartition(5)))
        assert Counter(map(str, got)) == Counter(map(str, again))
    assert shards.shard_digest(awkward.limit(0)).count() == 0
    again = shards.assign_shards(awkward.select("doc_id", "text", "slot", "shard", F.lit("z").alias("row_number")), ["doc_id", "text"], 5)
    assert again.columns == ["doc_id", "text", "row_number", "shard", "slot"] and sorted(r["row_number"] for r in rows(again)) == list(range(awkward.count()))
    with pytest.raises(ValueError, match="slot"):
        shards.assign_shards(awkward, ["slot"])
    shards.write_shards(awkward.select("doc_id", "text"), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == awkward.count()


# -- 6: language ------------------------------------------------------------------------------------------


def test_language(awkward, documents):
    got = documents.select("doc_id", "lang").join(langid.identify(documents), "doc_id")
    judged = [r for r in rows(got) if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in judged) >= 0.95 * len(judged) > 0
    assert all(0 <= r["score"] <= 1 for r in rows(got))
    out = rows(langid.identify(awkward))
    assert len(out) == awkward.count()
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 10, 11)} == {"und"}
    assert {r["lang_pred"] for r in rows(langid.identify(awkward.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}
    assert langid.identify(awkward.limit(0)).count() == 0
    some = documents.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    kept = langid.keep_identified(some)
    assert kept.columns == documents.columns and kept.filter("lang IS NULL").count() == 0
    lettered = documents.filter(r"text rlike '\\p{L}'")
    assert lettered.count() - 3 <= kept.count() <= lettered.count()
    truth = {r["doc_id"]: r["lang"] for r in rows(documents)}
    filled = [r for r in rows(kept) if r["doc_id"] % 4 == 0]
    assert sum(truth[r["doc_id"]] == r["lang"] for r in filled) >= 0.95 * len(filled) > 0
    unlabelled = documents.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(unlabelled).count() == lettered.count()


def test_junk_goes_and_clean_texts_stay(spark):
    """Random signs, random letters and shuffled texts go, at least 95 % of them; of clean held-out texts next to none does."""
    path = DATA.parent / "sf0.01/documents.parquet"
    if not path.exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(str(path))
    rng = random.Random(11)
    texts = [r["text"] for r in docs.filter("length(text) BETWEEN 300 AND 3000").limit(200).collect()]
    made = []
    for i in range(1000):
        text = rng.choice(texts)[:400]
        kinds = (
            lambda: "".join(rng.sample(text, len(text))),
            lambda: " ".join("".join(rng.sample(w, len(w))) for w in text.split(" ")),
            lambda: "".join(rng.choice("!#$%&()*+,-./:;<=>?@[]^_{|}~0123456789abcxyz ") for _ in range(300)),
            lambda: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9))) for _ in range(60)),
        )
        made.append((10**7 + i, kinds[i % 4](), None, "junk", None))
    both = docs.unionByName(spark.createDataFrame(made, docs.schema))
    kept = {r["doc_id"] for r in langid.keep_identified(both).select("doc_id").collect()}
    assert sum(i >= 10**7 for i in kept) <= 50
    labels = spark.read.parquet(str(path.parent / "labels.parquet")).filter("quality = 1 AND toxic = 0")
    clean = {r["doc_id"] for r in docs.filter("text rlike '[A-Za-z]'").join(labels, "doc_id").select("doc_id").collect()}
    assert len(clean) > 250 and len(clean - kept) <= 1


def test_columns_of_any_name_stay(spark):
    """Names that operators use inside, and odd ones: rows come back as they went in."""
    names = ["__score", "__lang_pred", "lang_pred", "score", "junk", "row", "__size", "size", "__copies", "__copy", "__target", "__source_size", "__source", "__id", "__sha", "__turn", "id", "sha", "turn", "fp", "root", "a.b", "it`s"]
    texts = ["Same text here", "same text here", "another text altogether", words(80, 21), None]
    rows = [(i, t, "en", f"s{i % 2}", *(f"{n}-{i}" for n in names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    for stage in (langid.keep_identified, exact_dedup.keep_one, simhash.keep_one, mixing.mix):
        out = stage(docs)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= set(rows), stage


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(i * 3 + k, f"{chr(0x4e00 + i)} " * 9 + words(3, i), f"l{i:03d}") for i in range(230) for k in range(3)], "doc_id long, text string, lang string")
    assert len({lang for lang, _ in langid.training_pieces(docs, 3, 3)}) == 230


def test_pieces_are_the_text():
    for text in ("", "a" * 500, "\u00e9" * 301, "\U0001f600 " * 99, LONG[:5000], "x" + "\u4f60" * 200):
        parts = langid.cut_pieces(text.encode())
        assert b"".join(parts) == text.encode() and all(0 < len(p) <= langid.PIECE for p in parts)
        assert "".join(p.decode() for p in parts) == text


def test_stored_model(spark, tmp_path):
    model = langid.ByteGru(["a", "b"], hidden=5)
    langid.save_model(spark, model, str(tmp_path / "m"))
    again = langid.load_model(spark, str(tmp_path / "m"))
    assert again.languages == ["a", "b"] and np.array_equal(model.label([b"some text", b"x"]), again.label([b"some text", b"x"]))


def test_gradients():
    model = langid.ByteGru(["a", "b"], hidden=3, seed=1)
    segments, labels = [b"hello", b"abc", b"z"], np.array([0, 1, 1])
    laid = model.layout(segments)

    def loss():
        logs, inside, *_ = model._run(laid)
        return -sum(float(logs[t, i, labels[i]]) for i in range(3) for t in range(len(segments[i]))) / 9

    grads, told = {}, {}
    logs, inside, hf, kf, hb, kb = model._run(laid)
    miss = np.exp(logs)
    miss[:, np.arange(3), labels] -= 1
    miss *= (inside / 9)[:, :, None]
    model._back("f", laid[0], laid[3], kf, (miss @ model.w["vf"].T), grads)
    for name in ("xf", "uf"):
        for at in ((0, 0), (1, 4), (2, 8)) if name == "uf" else ((ord("l"), 1), (ord("a"), 7)):
            model.w[name][at] += 1e-2
            up = loss()
            model.w[name][at] -= 2e-2
            told[name, at] = (up - loss()) / 2e-2
            model.w[name][at] += 1e-2
            assert grads[name][at] == pytest.approx(told[name, at], abs=2e-4)
    before = {k: v.copy() for k, v in model.w.items()}
    first = loss()
    model.train(segments, labels, steps=60, batch=8, rate=0.05)
    assert loss() < first / 2 and any((before[k] != v).any() for k, v in model.w.items())


def test_labels_do_not_depend_on_company():
    model = langid.ByteGru(["a", "b", "c"], seed=2)
    many = [b"alpha", b"be", b"gamma-delta", b"x" * 40, b"be"]
    together = model.label(many)
    assert np.allclose(together, np.concatenate([model.label([s]) for s in many]), atol=1e-4)


# -- 7: repeats --------------------------------------------------------------------------------------------


def check_repeats(docs):
    source = [(r["doc_id"], (r["text"] or "").encode()) for r in rows(docs)]
    starts = Counter(t[i : i + 400] for _, t in source for i in range(len(t) - 399))
    want = Counter()
    for key, t in source:
        spans = []
        for i in range(len(t) - 399):
            if starts[t[i : i + 400]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 400
                else:
                    spans.append([i, i + 400])
        kept, at = b"", 0
        for a, b in spans:
            kept += t[at:a]
            at = b
        kept += t[at:]
        want[(key, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffix_dedup.remove_repeats(docs)))
    assert got == want


def test_repeats(awkward, documents):
    check_repeats(awkward.filter("doc_id IS NULL OR doc_id NOT IN (8, 9)"))
    check_repeats(documents.limit(120))
    assert suffix_dedup.remove_repeats(awkward.limit(0)).count() == 0


def local_spans(texts, rows_a_batch):
    """What the steps of repeated_spans find, run in this process, so that their limits can be set."""
    table = pa.table({"tkey": [str(i).encode() for i in range(len(texts))], "text": texts, "copies": [1] * len(texts)})
    found = pa.Table.from_batches(suffix_dedup._segments_udf(table.to_batches())).sort_by("least")
    shared = pa.Table.from_batches(suffix_dedup._shared_udf(found.to_batches(rows_a_batch))).to_pylist()
    wanted = [[{k: r[k] for k in ("low", "high", "least", "hot")} for r in shared if r["tkey"] == key] for key in table["tkey"].to_pylist()]
    own = [i for i, w in enumerate(wanted) if w]
    asked = table.take(own).append_column("wanted", pa.array([wanted[i] for i in own])).to_batches()
    bits = pa.Table.from_batches(suffix_dedup._cut(asked, 5)).sort_by("low").to_batches(rows_a_batch) if own else []
    spans = defaultdict(list)
    for r in (r for b in suffix_dedup._family_udf(bits) for r in b.to_pylist()):
        spans[int(r["tkey"])] += range(r["low"], r["high"])
    return {k: set(v) for k, v in spans.items()}, any(r["hot"] for r in shared)


@pytest.mark.parametrize(("limits", "rows_a_batch", "hot"), [({"SLICE": 900, "BATCH": 1200}, 5, False), ({"HOT": 1, "BATCH": 3000}, 3, True), ({"HOT": 2}, 1, True), ({"HOT": 5}, 1000, True), ({"HOT": 7, "BATCH": 500}, 2, True), ({"HOT": 8}, 4, True), ({"HOT": 9}, 4, None)])
def test_repeats_over_slices_batches_and_hot_minima(monkeypatch, limits, rows_a_batch, hot):
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    base = words(500, 11)
    texts = [base, base[200:2500] + words(40, 12), "abc" * 500, words(50, 13) + "abc" * 200, words(400, 14)] + [f"{words(70 + i, 100 + i)} {PASSAGE} {words(60, 200 + i // 3)}" for i in range(9)]
    starts = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = {k: {j for i in range(len(t) - 399) if starts[t[i : i + 400]] > 1 for j in range(i, i + 400)} for k, t in enumerate(texts)}
    got, was_hot = local_spans(texts, rows_a_batch)
    assert got == {k: v for k, v in want.items() if v}
    assert hot is None or was_hot == hot


def test_digest_levels_stay_logarithmic():
    family, rng = suffix_dedup.DigestFamily(), np.random.default_rng(1)
    for k in range(64):
        x = rng.integers(0, 2**63, 100).astype(np.uint64)
        family.add(x, x, np.full(100, k), np.arange(100))
        assert len(family.levels) <= 8
    assert sum(len(level[0]) for level in family.levels) == 6400


def test_suffix_arrays_are_alphabetical():
    rng = np.random.default_rng(2)
    for letters in (2, 200):
        data = rng.integers(0, letters, 3000).astype(np.uint8)
        data[1000:1700] = data[:700]
        data[2100:2600] = 7
        at = np.arange(len(data) - 399)
        order, same = suffix_dedup.suffix_order(data, at)
        told = [data[i : i + 400].tobytes() for i in at[order]]
        assert told == sorted(told) and sorted(order.tolist()) == at.tolist()
        assert same.tolist() == [False, *(a == b for a, b in zip(told, told[1:]))]


def test_family_of_suffix_arrays():
    """Batches against levels: what is told is what occurs twice, once each; levels are distinct, alphabetical and few."""
    rng, family, told, texts = random.Random(12), suffix_dedup.IndexFamily(), [], []
    for k in range(24):
        base = texts[rng.randrange(len(texts))] if texts and rng.random() < 0.6 else ""
        text = (words(90, 300 + k)[: rng.randrange(400, 520)] + base[rng.randrange(50) :][: rng.randrange(300, 900)]).ljust(400, "x")
        texts.append(text)
        data = np.frombuffer(text.encode(), np.uint8)
        at = np.arange(len(data) - 399)
        told += zip(*(x.tolist() for x in family.add(data, at, np.full(len(at), k), at)))
        assert len(family.levels) <= 6 and all(len(a) > 2 * len(b) for a, b in zip(family.levels, family.levels[1:]))
    starts = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    assert sorted(told) == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 399) if starts[t[i : i + 400]] > 1]
    held = [[level.data[i : i + 400].tobytes() for i in level.at] for level in family.levels]
    assert all(h == sorted(h) for h in held) and sorted(x for h in held for x in h) == sorted(x.encode() for x in starts)


def test_family_sorts_only_what_is_new(monkeypatch):
    """Over 64 batches each batch sorts its own bytes, whatever the levels hold, and moves each suffix logarithmically often."""
    family, rng, sorted_bytes, moved = suffix_dedup.IndexFamily(), np.random.default_rng(3), [], []
    order, merge = suffix_dedup.suffix_order, suffix_dedup.Level.merge
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda data, at: sorted_bytes.append(len(data)) or order(data, at))
    monkeypatch.setattr(suffix_dedup.Level, "merge", lambda self, other: moved.append(len(self) + len(other)) or merge(self, other))
    for k in range(64):
        data = rng.integers(97, 123, 3000).astype(np.uint8)
        at = np.arange(len(data) - 399)
        family.add(data, at, np.full(len(at), k), at)
    assert sorted_bytes == [3000] * 64
    assert sum(moved) <= 64 * 2601 * 8 and len(family.levels) <= 7
    assert sum(len(level) for level in family.levels) == 64 * 2601


def test_search_in_levels():
    """Few letters and long common beginnings: places and equality are those of plain byte strings."""
    import bisect

    rng = np.random.default_rng(4)
    parts = [rng.integers(97, 99, 1500), np.full(900, 97), np.tile(rng.integers(97, 99, 7), 150)]
    data = np.concatenate(parts).astype(np.uint8)
    at = np.arange(len(data) - 399)
    order, same = suffix_dedup.suffix_order(data, at)
    at = at[order][~same]
    level = suffix_dedup.Level(data, at, at, at, np.zeros(len(at), bool))
    held = [data[i : i + 400].tobytes() for i in at]
    asked = np.concatenate([parts[2][3:], rng.integers(97, 99, 500), np.full(600, 97), parts[0][100:1200]]).astype(np.uint8)
    places = np.arange(len(asked) - 399)
    low, equal = level.find(asked, places, suffix_dedup._words(asked, places))
    told = [asked[i : i + 400].tobytes() for i in places]
    assert low.tolist() == [bisect.bisect_left(held, x) for x in told]
    assert equal.tolist() == [x in set(held) for x in told] and equal.any() and not equal.all()


def test_batches_on_disk(spark, tmp_path):
    """Each batch is judged against those before it; levels stay few; a level left over from a loss changes nothing."""
    import shutil

    folder, texts, before = str(tmp_path / "index"), [(i, f"{words(70 + i, 400 + i)} {PASSAGE} {words(60, 500 + i // 3)}") for i in range(10)], []
    texts[7] = (7, texts[1][1])
    for k, part in enumerate((texts[:3], [*texts[3:5], (90, None), (91, "short")], texts[5:8], texts[8:])):
        got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in rows(suffix_dedup.add_batch(spark.createDataFrame(part, "doc_id long, text string"), folder))}
        if k == 1:  # as if the merge had not come to deleting
            level = next((tmp_path / "index").iterdir())
            shutil.copytree(level, level.with_name("level-again"))
        starts = Counter(t[i : i + 400] for _, t in [*before, *part] for i in range(len(t or "") - 399))
        for i, t in part:
            hit = {j for a in range(len(t or "") - 399) if starts[t[a : a + 400]] > 1 for j in range(a, a + 400)}
            assert got[i] == (len(hit), sum(j - 1 not in hit for j in hit)), (k, i)
        before += part
    assert 1 <= len(list((tmp_path / "index").iterdir())) <= 3


# -- 8: packing ----------------------------------------------------------------------------------------------


def check_packing(docs, least_fill):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(packing.default_tokenizer())
    encoder.encode_special_tokens = True
    got = rows(packing.pack_documents(docs, with_ids=True))
    lines = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        lines[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in lines.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(lines) == list(range(len(lines)))
    assert sum(r["length"] for r in got) >= least_fill * 2048 * len(lines)
    want = Counter()
    for r in rows(docs):
        ids = [*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            want[(r["doc_id"], at, len(ids), np.array(ids[at : at + 2048], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["doc_tokens"], bytes(r["ids"])) for r in got) == want


def test_packing(awkward, documents):
    check_packing(awkward, 0.9)
    check_packing(documents, 0.97)
    assert packing.pack_documents(awkward.limit(0)).count() == 0
    packed = packing.pack_documents(awkward, with_ids=True).cache()
    whole = rows(packing.sequences(packed))
    assert sum(len(r["ids"]) for r in whole) == 4 * packed.agg(F.sum("length")).first()[0]


def check_ids(spark, texts):
    """The ids are those of the tokenizers library as it comes, added tokens included."""
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(packing.default_tokenizer())
    got = defaultdict(dict)
    for r in rows(packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True)):
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        got[r["doc_id"]][r["start"]] = r["ids"]
    for i, text in enumerate(texts):
        want = np.array([*encoder.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert b"".join(part for _, part in sorted(got[i].items())) == want.tobytes(), text[:50]


def test_packing_of_added_tokens(spark):
    end = "<|endoftext|>"
    check_ids(spark, [f"a {end} b", end, end * 3, f" {end}\n\n", f"x{end}y  {end}  z", f"<|{end}|>", "<|endoftext|", "<|endoftext |>", f"{words(3000, 9)} {end} {words(30, 10)}"])
    assert packing.Encoder(packing.default_tokenizer())(f"a {end} b") == [64, 220, 50256, 275]


def test_packing_of_long_white_space(spark):
    n = packing.LONG_RUN
    check_ids(spark, [" " * 2_000_000 + "a", "a" + "\n" * 2_000_000, "it's" + "\u3000 \t" * n + "'s", f"a{' ' * n}b {' ' * (n - 1)}c{' ' * (n - 2)}<|endoftext|>" + " " * n, "\x1c" * 2 * n + " 1", " " * n, " " * (n - 1) + "\x85\xa0x", "\r\n" * n + "\n!"])


def test_packs_hold_every_piece_once():
    rng = random.Random(3)
    for _ in range(20):
        histogram = Counter(rng.randint(1, 64) for _ in range(500))
        packs = packing.shortest_pack_first(histogram.items(), 64)
        found = Counter()
        for count, pattern in packs:
            assert sum(pattern) <= 64
            for length in pattern:
                found[length] += count
        assert found == histogram
        table = packing.slots(packs)
        for length, n in histogram.items():
            own = table[table[:, 0] == length]
            assert own[0, 1] == 0 and (np.diff(own[:, 1]) > 0).all() and own[-1, 1] < n


# -- 9: mixing -------------------------------------------------------------------------------------------------


def test_mixing(awkward, documents):
    for docs in (awkward, documents):
        planned = rows(mixing.with_copies(docs))
        sizes = defaultdict(int)
        for r in planned:
            assert r["__size"] == len((r["text"] or "").encode().split())
            sizes[r["source"]] += r["__size"]
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        total, target, left = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
        while left:  # shares by weight, the excess shared again
            level = (total - sum(target[s] for s in names if s not in left)) / sum(weights[s] for s in left)
            full = {s for s in left if weights[s] * level >= 2 * sizes[s]}
            for s in full or left:
                target[s] = 2.0 * sizes[s] if full else weights[s] * level
            left -= full or left
        for r in planned:
            assert r["__target"] == pytest.approx(target[r["source"]]) and 0 <= r["__copies"] <= 2
        assert sum(target.values()) == pytest.approx(total)
        mixed = mixing.mix(docs)
        assert mixed.columns == docs.columns and mixed.count() == sum(r["__copies"] for r in planned)
    assert mixing.mix(awkward.limit(0)).count() == 0


def test_many_sources_are_joined_by_a_shuffle(documents, monkeypatch):
    want = Counter(r["doc_id"] for r in rows(mixing.mix(documents)))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert Counter(r["doc_id"] for r in rows(mixing.mix(documents))) == want


def test_targets_by_ranges_are_the_same(spark, monkeypatch):
    source = F.when(F.col("id") % 97 != 5, F.concat(F.lit("s"), (F.col("id") % 97).cast("string")))
    sizes = spark.range(3000).select(source.alias("source"), (F.col("id") % 97 * (F.col("id") % 11) % 40).alias("size"))
    want = sorted(map(str, rows(mixing.source_targets(sizes))))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert len(want) == 97 and sorted(map(str, rows(mixing.source_targets(sizes)))) == want


def test_taken_words_come_near(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"))
    planned = mixing.with_copies(docs).groupBy("source").agg(F.sum(F.col("__copies") * F.col("__size")).alias("taken"), F.first("__target").alias("target"))
    assert all(r["taken"] == pytest.approx(r["target"], rel=0.08) for r in rows(planned))


# -- 10: audio ---------------------------------------------------------------------------------------------------


def test_audio_round_trip(spark, awkward, documents, tmp_path):
    for docs in (awkward, documents):
        got = rows(audio.audio_digest(docs))
        want = Counter()
        for r in rows(docs):
            raw = (r["text"] or "").encode()
            padded = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
            want[(r["doc_id"], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))] += 1
        assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
        features = defaultdict(set)
        for r in got:
            features[r["payload_sha256"]].add((r["feature"], r["media_sha256"]))
        assert all(len(f) == 1 for f in features.values())
    assert audio.audio_digest(awkward.limit(0)).count() == 0
    audio.store_audio(awkward, str(tmp_path / "media"))
    for r in rows(spark.read.parquet(str(tmp_path / "media"))):
        codec, payload = audio.from_wav(bytes(r["media"]))
        assert bytes(r["pcm"]) == audio.resample(audio.decode(codec, np.frombuffer(payload, np.uint8))).tobytes()


def test_g711_tables():
    # Fixed values of the standard: the largest steps, the smallest, and silence.
    assert (audio.MULAW[0x00], audio.MULAW[0x80], audio.MULAW[0xFF], audio.MULAW[0x7F], audio.MULAW[0xFE]) == (-32124, 32124, 0, 0, 8)
    assert (audio.ALAW[0x2A], audio.ALAW[0xAA], audio.ALAW[0xD5], audio.ALAW[0x55]) == (-32256, 32256, 8, -8)
    assert len(set(audio.ALAW.tolist())) == 256


def test_adpcm_against_the_loop():
    rng = np.random.default_rng(4)
    blocks = rng.integers(0, 256, (7, 192), np.uint8)
    got = audio.decode_adpcm(blocks)
    for block, out in zip(blocks, got, strict=True):
        value, index = int(block[:2].view("<i2")[0]), min(int(block[2]), 88)
        want = [value]
        for byte in block[4:].tolist():
            for nibble in (byte & 15, byte >> 4):
                step = int(audio.IMA_STEPS[index])
                move = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                value = max(-32768, min(32767, value - move if nibble & 8 else value + move))
                index = max(0, min(88, index + int(audio.IMA_MOVES[nibble & 7])))
                want.append(value)
        assert out.tolist() == want


def test_resample_keeps_the_samples():
    pcm = np.array([0, 1000, -32768, 32767, 5], np.int16)
    out = audio.resample(pcm)
    assert out[::2].tolist() == pcm.tolist() and len(out) == 10
    assert audio.resample(np.full(9, 123, np.int16)).tolist() == [123] * 18


def test_wav_round_trip():
    for codec in audio.CODECS:
        payload = bytes(range(192)) * 3
        name, back = audio.from_wav(audio.to_wav(codec, payload))
        assert name == codec and bytes(back) == payload
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFFxxxxWAVE")
