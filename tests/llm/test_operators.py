"""Each operator against brute force, round trips or held-out accuracy, on small fixtures and the smallest tables."""

import base64
import hashlib
import html
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from flowkit.llm import byte_bpe, exact_dedup, html_text, jaccard_join, language_id, media_sequences, mixing, pii, substring_dedup, url_reputation

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, block long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and names that clash with inner ones."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["wind", "rain", "sun", "Schnee", "neige"]) + str(rng.randrange(900)) for _ in range(30_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, base, "en", "a"), (2, base, "en", "b"), (2, base, "en", "b"), (3, base.replace(" ", "\t\n"), None, None), (4, None, "en", "a"), (5, "", None, None), (6, "   ", "en", "a"), (7, long, "en", "a"), (8, long + " end", "en", None), (None, base + " x", "en", "a"), (None, None, None, None), (9, "12345 67890", "en", "a"), (10, "ſ²³ 中文\x1c_a__b 'S don't\u2028", "zh", "b")]
    return spark.createDataFrame([(*r, 0, "d", 1, 2) for r in rows], COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


# 1 ---------------------------------------------------------------------------------------------------------------------


def targets_by_hand(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        rest = total - sum(capped.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def check_mix(df, texts_by_row):
    found = df.collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(i), len(WORD.findall(t or ""))) for i, t, _ in texts_by_row)
    sizes = {}
    for _, t, s in texts_by_row:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = targets_by_hand(sizes)
    assert {round(r.target, 6) for r in found} == {round(x, 6) for x in want.values()}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
    assert abs(sum(r.taken for r in found) - sum(sizes.values())) <= 64 * len(sizes)


def test_mix(documents, texts):
    once = mixing.mix_sizes(documents)
    check_mix(once, [(r.doc_id, r.text, r.source) for r in documents.collect()])
    again = mixing.mix_sizes(documents.repartition(7))
    assert rows_of(once, "doc_id", "taken") == rows_of(again, "doc_id", "taken")


def test_mix_odd(odd, empty):
    check_mix(mixing.mix_sizes(odd), [(r.doc_id, r.text, r.source) for r in odd.collect()])
    assert mixing.mix_sizes(empty).count() == 0
    assert mixing.mix_documents(odd).columns == odd.columns


def test_draws_of_the_mix(spark):
    """Counts drawn per shard follow the multinomial law; the totals are then the plan's, and blocks are taken evenly."""
    share = {0: 0.5, 1: 0.3, 2: 0.19, 3: 0.01}
    targets = spark.createDataFrame([(s, 64 * 40_000, 64.0 * 40_000 * p) for s, p in share.items()], "s int, source_size long, target double")
    plan = mixing.slot_plan(targets)
    drawn = mixing.draw_counts(plan, 400)
    rows = drawn.collect()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, {})[r.s] = r.drawn
    assert len(by_shard) == 100 and all(sum(x.values()) == 400 for x in by_shard.values())
    for s, p in share.items():
        x = [c.get(s, 0) for c in by_shard.values()]
        mean, want = sum(x) / 100, 400 * p
        spread = sum((v - mean) ** 2 for v in x) / 99 / (want * (1 - p))
        assert abs(mean - want) < 4 * (want * (1 - p) / 100) ** 0.5 and 0.5 < spread < 1.7
    counts = mixing.shard_counts(plan, drawn).collect()
    assert {r.s: r.slots for r in plan.collect()} == {s: sum(r.taken for r in counts if r.s == s) for s in share}
    shards = {}
    for r in counts:
        shards[r.shard] = shards.get(r.shard, 0) + r.taken
    assert set(shards.values()) == {400}
    slots = mixing.draw_slots(spark.createDataFrame([(0, 6400, 16000.0), (1, 640, 64.0)], "s int, source_size long, target double"), shard_blocks=16).collect()
    times = [sum((r.s, r.block) == (0, b) for r in slots) for b in range(100)]
    assert sum(times) == 250 and set(times) == {2, 3} and [r.block for r in slots if r.s == 1].__len__() == 1


def test_sources_near_targets(documents):
    """Each source's taken words are within a block per pass of its target."""
    taken, target, sizes = {}, {}, {}
    source = {r.doc_id: r.source for r in documents.collect()}
    for r in mixing.mix_sizes(documents).collect():
        s = source[r.doc_id]
        taken[s], target[s], sizes[s] = taken.get(s, 0) + r.taken, r.target, r.source_size
    for s, words in taken.items():
        assert abs(words - target[s]) <= 2 * mixing.BLOCK_WORDS * (1 + target[s] // max(1, sizes[s])), s


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), [F.lit(5)]).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(n))


def test_mixed_texts_hold_the_taken_words(documents):
    taken = {r.doc_id: r.taken for r in mixing.mix_sizes(documents).collect()}
    words = {}
    for r in mixing.mix_documents(documents).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert words == {k: v for k, v in taken.items() if v}


# 2 ---------------------------------------------------------------------------------------------------------------------


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    wanted = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (html.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"</?p>|</?h1>|<br>", article))
        wanted[r.page_id] = "\n\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in blocks) if x)
    found = html_text.extract_text(pages).collect()
    assert {r.page_id: r.text for r in found} == wanted
    assert all(r.n_chars == len(r.text) for r in found)


def test_boilerplate(spark):
    page = """<html><head><title>T</title></head><body><header>Site</header><nav>Menu</nav><div class="cookie-notice">We use</div>
    <main><article><h1>Head &amp; line</h1><p>One <b>two</b>&nbsp;three<br>four<p>Five</p><aside>Side</aside><form><input></form><script>var a="</p>";</script>
    <ul><li>Six<li>Seven</ul></article></main><section class="comments"><p>First!</p></section><footer>F</footer>"""
    assert html_text.main_text(page) == "Head & line\n\nOne two three four\n\nFive\n\nSix\n\nSeven"
    assert html_text.main_text("") == ""
    deep = "<div>" * 20_000 + "x"
    assert html_text.main_text(deep) == "x"


def test_templates_go_but_copies_stay(spark):
    rows = [(k, f"http://h.org/{k}", f"<article><p>Read also our letter</p><p>own {k}</p></article>") for k in range(30)]
    rows += [(100 + k, f"http://c.org/{k}", "<article><p>the same story</p></article>") for k in range(30)] + [(200, None, None)]
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "own 3" and found[105] == "the same story" and found[200] == ""


def texts_of(spark, pages, **more):
    rows = spark.createDataFrame([(k, f"http://h.org/{k}", x) for k, x in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_text.extract_text(rows, **more).orderBy("page_id").collect()]


def test_shapes_of_a_site(spark):
    """A box whose words differ by page goes by its shape; with the step off it stays. The content's shape recurs too."""
    body = "every page of this host has a long text of its own which says something else " * 3
    pages = [f'<body><div class="zq7"><b>Buy {k * 7919}</b> now</div><div class="content"><h1>Page {k}</h1><p>{k} {body}</p><p>more of {k}</p></div></body>' for k in range(20)]
    want = [f"Page {k}\n\n{k} {body.strip()}\n\nmore of {k}" for k in range(20)]
    assert texts_of(spark, pages) == want
    off = texts_of(spark, pages, min_pages=1000)
    assert off[3] == f"Buy {3 * 7919} now\n\n{want[3]}"


def test_near_copies_keep_their_text(spark):
    pages = [f"<article><h1>Report {k}</h1><p>The first paragraph that all have in common.</p><p>The second one of them, as long.</p></article>" for k in range(12)]
    assert all("The second one" in x and x.startswith(f"Report {k}") for k, x in enumerate(texts_of(spark, pages)))


def test_names_inside_an_article():
    assert html_text.main_text('<article><header class="entry-header"><h1>Title</h1></header><p>Body</p></article>') == "Title\n\nBody"
    assert html_text.main_text('<article><h2 id="search">Search trees</h2><p>Body</p></article>') == "Search trees\n\nBody"
    assert html_text.main_text('<div class="page-header-wrapper"><h1>T</h1><p>All text</p></div>') == "T\n\nAll text"
    assert html_text.main_text("<main><h1>Title</h1><article><p>Body</p></article></main>") == "Title\n\nBody"
    assert html_text.main_text('<article><p>A long body of words.</p><div class="comments"><p>First!</p></div></article>') == "A long body of words."


def page_rows(spark, pages, hosts="h.org"):
    hosts = [hosts] * len(pages) if isinstance(hosts, str) else hosts
    rows = [(k, f"http://{h}/{k}", x) for k, (h, x) in enumerate(zip(hosts, pages, strict=True))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_what_articles_share_stays(spark):
    """A sentence that ten of twelve articles quote, at any place, and a line that closes half of them."""
    quote, licence = "<p>Who has time has all, said the old man.</p>", "<p>This text may be copied by anyone.</p>"
    parts = [[f"<p>{word} {k} is told here at some length.</p>" for word in ("One", "Two", "Three")] for k in range(12)]
    for k in range(12):
        if k < 10:
            parts[k].insert(k % 4, quote)
        if k % 2:
            parts[k].append(licence)
    pages = ["<html><body><nav>Menu</nav><article>" + "".join(p) + "</article></body></html>" for p in parts]
    assert texts_of(spark, pages) == ["\n\n".join(re.findall("<p>(.*?)</p>", "".join(p))) for p in parts]


def test_neutral_boxes_of_few_pages(spark):
    """A menu and a closing line without names on nine pages; a notice in a plain div on a quarter of 48 pages."""
    menu, line = "<ul><li><a>Home</a></li><li><a>Shop</a></li></ul>", "<p>Copyright by us, all rights kept</p>"
    body = [f"<h1>Page {k}</h1><p>The story of number {k} begins here and goes on.</p><p>It ends here, {k}.</p>" for k in range(48)]
    want = [f"Page {k}\n\nThe story of number {k} begins here and goes on.\n\nIt ends here, {k}." for k in range(48)]
    assert texts_of(spark, [f"<body>{menu}<div>{x}</div>{line}</body>" for x in body[:9]]) == want[:9]
    off = html_text.extract_text(page_rows(spark, [f"<body>{menu}<div>{x}</div>{line}</body>" for x in body[:9]]), min_pages=1000).orderBy("page_id").collect()
    assert off[2].text == f"Home\n\nShop\n\n{want[2]}\n\nCopyright by us, all rights kept"
    notice = "<div>Our office is closed on Monday</div>"
    with_notice = [f"<body><div>{x.replace('<p>It', notice + '<p>It') if k % 4 == 0 else x}</div></body>" for k, x in enumerate(body)]
    assert texts_of(spark, with_notice) == want
    joined = html_text.extract_text(page_rows(spark, with_notice), broadcast_hashes=0).orderBy("page_id").collect()
    assert [r.text for r in joined] == want
    few = page_rows(spark, [f"<body>{menu}<div>{x}</div>{line}</body>" for x in body[:6]], [f"s{k}.wide.org" for k in range(6)])
    assert [r.text for r in html_text.extract_text(few).orderBy("page_id").collect()] == want[:6]  # one page a host, one domain


def test_comments_and_adverts_inside(spark):
    page = '<main><h1>T</h1><p>A body of some words that is long enough.</p><div class="comments-section"><p>First!</p></div></main>'
    assert html_text.main_text(page) == "T\n\nA body of some words that is long enough."
    for name in ("user-comments", "promo", "promoBox", "article__ad", "newsletter_form"):
        assert html_text.main_text(f'<article><p>A body of some words.</p><div class="{name}"><p>Buy</p></div><p>More of it.</p></article>') == "A body of some words.\n\nMore of it.", name
    assert html_text.main_text('<article><p class="lead-ad-lib">Kept</p><div class="shadow">Kept too</div><p>And this.</p></article>') == "Kept\n\nKept too\n\nAnd this."
    boxes = [f"<article><h1>A {k}</h1><p>Words of {k} that say a thing.</p><p>And {k} again.</p><div><b>Read us</b> every day</div></article>" for k in range(6)]
    assert texts_of(spark, boxes)[4] == "A 4\n\nWords of 4 that say a thing.\n\nAnd 4 again."


def test_templates_are_found(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = html_text.site_templates(pages)
    assert found.count() > 0.5 * pages.select(url_reputation.host_of("url")).distinct().count()


def test_odd_pages(spark):
    rows = [(None, "http://h.org/1", "<p>x</p>", "t"), (2, None, None, "t"), (2, None, None, "t"), (3, "no url", "", None)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, template string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract_text(odd).collect()) == [("2", "", 0), ("2", "", 0), ("3", "", 0), ("None", "x", 1)]
    assert html_text.extract_text(odd.limit(0)).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------------


def repeats_by_hand(rows):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] != i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


NAMES3 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("limit", [20_000, 3])
def test_substrings(documents, texts, limit):
    assert rows_of(substring_dedup.remove_repeats(documents, group_limit=limit, block_bytes=100_000, bucket_bytes=50_000), *NAMES3) == repeats_by_hand(list(texts.items()))


def test_substrings_odd(odd, empty):
    assert rows_of(substring_dedup.remove_repeats(odd), *NAMES3) == repeats_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_deep_shallow_sorts():
    import numpy as np

    rng = np.random.default_rng(1)
    s = rng.integers(0, 2, (4000, 30)).astype(np.uint8)
    s[:, :14] = s[:1, :14]
    s[500:900] = s[:400]
    group = np.sort(rng.integers(0, 9, 4000))
    order = substring_dedup.deep_shallow(group, s)
    assert [(group[k], s[k].tobytes()) for k in order] == sorted((group[k], s[k].tobytes()) for k in range(4000))


# 4 ---------------------------------------------------------------------------------------------------------------------


def test_media(documents, texts, odd, empty):
    for rows, df in ((list(texts.items()), documents), ([(r.doc_id, r.text) for r in odd.collect()], odd)):
        want = []
        for i, t in rows:
            b = (t or "").encode()
            p = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
            want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
        got = rows_of(media_sequences.document_media(df), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
        assert got == sorted(want, key=lambda r: tuple((x is None, x) for x in r))
    assert media_sequences.document_media(empty).count() == 0


def test_sequences_stay_aligned(spark):
    page = '<p>A<img src="sha256:aa" alt="x">B<figure><img src="sha256:bb"><figcaption>cap</figcaption></figure><p>C'
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    s = media_sequences.parse_sequences(pages, "page_id", "html")
    store = spark.createDataFrame([("aa", b"1"), ("bb", b"2")], "digest string, media binary")
    found = media_sequences.put_together(s, media_sequences.resolve(media_sequences.media_references(s, "page_id"), store), "page_id", "media")
    items = {r.page_id: [(i.kind, i.text, i.caption, i.media and bytes(i.media)) for i in r["items"]] for r in found.collect()}
    assert items[2] == []
    assert items[1] == [("text", "A", None, None), ("media", None, "x", b"1"), ("text", "B", None, None), ("media", None, "cap", b"2"), ("text", "C", None, None)]


# 5 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [48 << 20, 2000])
def test_copies(documents, odd, empty, limit):
    for df in (documents, odd):
        groups = {}
        for r in df.collect():
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
        want = sorted((str(i), str(min((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
        found = exact_dedup.label_copies(df, limit).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == want
        assert sum(r.kept for r in found) == len(groups)
        kept = exact_dedup.drop_copies(df, limit)
        assert kept.count() == len(groups) and kept.columns == df.columns
    assert exact_dedup.label_copies(empty).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------------

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    out = []
    for k, (name, p) in enumerate(BASE):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[name]:
                out.append((m.start(), k, m.end()))
    return [f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(out)]


def test_personal_data(spark, documents, odd, empty):
    hard = ["😀 a@b.c.d_e@f.gh x..y@z.co a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 00000000000000000000", "+1 (826) 555-4081 190.137.2.1 +49 30 1234567 +1", "9" * 50_000 + "@x.y", "a@" + ".b" * 9000 + ".c", "mail to jo at example.org or jo(at)example(dot)org"]
    extra = spark.createDataFrame([(100 + k, t, None, None, 0, "", 1, 2) for k, t in enumerate(hard)], COLUMNS)
    for df in (documents, odd.unionByName(extra)):
        found = pii.find_personal_data(df).collect()
        want = sorted((str(r.doc_id), hashlib.sha256(",".join(base_spans(r.text or "")).encode()).hexdigest()) for r in df.collect())
        assert sorted((str(r.doc_id), r.base_sha256) for r in found) == want
        text = {r.doc_id: r.text for r in df.collect()}
        for r in found:
            own = base_spans(text[r.doc_id] or "") if r.doc_id is not None else []
            assert set(own) <= set(r.spans.split(",")) | {""}
    assert pii.find_personal_data(empty).count() == 0


def test_boosting_learns(spark):
    from pyspark.sql import functions as F

    df = spark.range(2000).select(F.lit("card").alias("kind"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("match"), F.lit("").alias("before"), (F.col("id") % 3 == 0).alias("valid"), *[(F.xxhash64("id", F.lit(k)) % 2 == 0).alias(f"f{k}") for k in range(len(pii.FEATURES))])
    df = df.withColumn("f5", F.col("valid"))
    model = pii.fit(df)
    assert set(model.thresholds) == {"card"}
    assert df.withColumn("score", model.score()).where(model.accepts() == F.col("valid")).count() == 2000
    assert pii.fit(df.limit(0)).thresholds == {}


#: Loose forms by kind, and spans of like shape that are none.
LOOSE = {
    "email": ["anna.meier (at) posta.example.org", "jo[at]mail7.example.com", "li.wei {at} mail3 [dot] example [dot] net", "sam.33 at mail2.example.com"],
    "ip": ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80:0:0:0:200:f8ff:fe21:67cf", "2001:db8:0:1:a0:b:c:17"],
    "card": ["4111.1111.1111.1111", "5500/0000/0000/0004", "4012_8888_8888_1881"],
    "phone": ["0049 (301) 555-7713", "(487) 555-7209", "017-555-1352"],
    "secret": ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "api_key: Zx81kQ0pLw93nVb72RtYu5", "password=9fQ2xLm0Zk7Wc4Rt8Yp1"],
}
PLAIN = ["4111.1111.1111.1112", "08:00:2b:01:02:03", "we met at noon. it was fine", "4736 4525 980", "1234-5678-90"]


def test_added_spans(spark):
    """Loose forms planted in clean documents of the given table are found, 0.9 of each kind at least, and their like are not."""
    clean = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").orderBy("doc_id").limit(900).collect()]
    rows, want, k = [(i, t) for i, t in enumerate(clean)], {}, 0
    filler = [t for t in clean if not re.search("[0-9@]", t) and len(t) > 200]
    for kind, forms in LOOSE.items():
        for form in forms:
            for n in range(4):
                t = filler[k % len(filler)]
                cut = t.index(" ", 40 + 10 * n)
                rows.append((10_000 + k, f"{t[:cut]} {form}{t[cut:]}"))
                value = re.search(r"[\w]{20,}", form)[0] if kind == "secret" else form
                want[10_000 + k] = (kind, cut + 1 + form.index(value), cut + 1 + form.index(value) + len(value))
                k += 1
    for n, form in enumerate(PLAIN * 3):
        t = filler[n]
        rows.append((20_000 + n, f"{t[:t.index(' ', 60)]} {form}{t[t.index(' ', 60):]}"))
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in LOOSE:
        own = {i: w for i, w in want.items() if w[0] == kind}
        hit = sum(f"{k}:{a}:{b}" in found[i].spans.split(",") for i, (k, a, b) in own.items())
        assert hit >= 0.9 * len(own), (kind, hit, len(own), [(i, rows[i - 10_000 + len(clean)][1][w[1] - 12 : w[2] + 5], found[i].spans) for i, w in own.items()][:12])
    added = {i: r.spans for i, r in found.items() if r.n_spans > r.n_email + r.n_ip + r.n_card + r.n_phone}
    assert not {i for i in added if i >= 20_000}
    few = [i for i in added if i < 10_000 and not re.search(r"token = |key|password", clean[i])]
    assert len(few) <= 9, [(i, added[i]) for i in few]
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in found.values())


# 7 ---------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "nope", "http://A.example.ORG/en/12?x", "https://example.org/es/", "http://org/x", "x://b.com/fr/1#y", "x://c.com/de/", "x://myexample.org", "x://d.net/p?q", "x://e.net?y/z"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(8, 0, 0), (9, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_urls(pages, labels).collect()}
    assert found[0][:3] == ("", "", None) and found[1][:3] == ("", "", None)
    assert found[2] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert found[3] == ("example.org", "/es/", "example.org/es/", "block")
    assert found[4] == ("org", "/x", "org/", "allow")
    assert found[5] == ("b.com", "/fr/1", "com/fr/", "allow") and found[6] == ("c.com", "/de/", "com/de/", "block")
    assert found[7][:3] == ("myexample.org", "", None) and found[8][:3] == ("d.net", "/p", None) and found[9][:3] == ("e.net", "", None)
    assert url_reputation.judge_urls(pages.limit(0), labels).count() == 0


def test_url_levels(spark):
    hosts = {
        "a.example.com": ("example.com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "x.y.co.uk:8080": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "y.uk.": ("y.uk", "uk"),
        "me@w.net:1": ("w.net", "net"), "w.net.:1": ("w.net", "net"), "1.2.3.4:80": ("1.2.3.4", "1.2.3.4"), "[::1]:80": ("[::1]", "[::1]"), "local": ("local", "local"), "": ("", ""),
    }
    df = spark.createDataFrame([(h,) for h in hosts], ["host"])
    found = {r.host: (r.d, r.s) for r in df.select("host", url_reputation.domain_of(F.col("host")).alias("d"), url_reputation.suffix_of(F.col("host")).alias("s")).collect()}
    assert found == hosts
    # unrelated sites of one public suffix don't share a reputation: y.co.uk's bad pages leave its own hosts below z's
    rows = [(f"h{k}.y.co.uk", 0) for k in range(40)] + [(f"h{k}.z.co.uk", 1) for k in range(40)] + [("new.y.co.uk", None), ("new.z.co.uk", None)]
    mean = {r.host: r["mean"] for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert mean["new.y.co.uk"] + 0.3 < mean["new.z.co.uk"]


# 8 ---------------------------------------------------------------------------------------------------------------------


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = language_id.identify(docs).collect()
    held = [r for r in found if r.held_out]
    assert {r.held_out for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0} == {True}
    assert len(found) == len(truth) and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    weird = {(r.doc_id, r.lang_pred == "und") for r in language_id.identify(odd).collect()}
    assert {(4, True), (5, True), (6, True), (9, True), (7, False)} <= weird
    assert language_id.identify(empty).count() == 0


# 9 ---------------------------------------------------------------------------------------------------------------------


def components_by_hand(rows, n=4, share=(85, 100)):
    def grams(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and share[1] * both >= share[0] * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), len(sets[k]), str(least.get(root(k)))) for k, (i, _) in enumerate(rows))


def test_near_copies(spark, documents, odd, empty):
    rng = random.Random(5)
    vocabulary = ["w%d" % k for k in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    made = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(120)] = rng.choice(vocabulary)
        made.append((k, " ".join(w)))
    made += [(200 + k, line + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30)))) for k in range(80)]
    near = spark.createDataFrame(made, "doc_id long, text string")
    for df in (documents, odd, near):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        found = jaccard_join.components(df, sketch_bits=10)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == components_by_hand(rows)
    assert jaccard_join.components(empty).count() == 0
    kept = {r.doc_id for r in jaccard_join.keep_one(near).collect()}
    assert kept == {int(c) for _, _, c in components_by_hand(made, 5, (80, 100))}


# 10 --------------------------------------------------------------------------------------------------------------------


def test_bpe(documents, odd, empty):
    import tiktoken

    with open(byte_bpe.vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=ranks, special_tokens={})
    for df in (documents, odd):
        want = []
        for r in df.collect():
            ids = coder.encode_ordinary(r.text or "")
            want.append((str(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        found = byte_bpe.encode_documents(df, block_bytes=200_000, bucket_bytes=100_000).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(want)
    assert byte_bpe.encode_documents(empty).count() == 0
    whole = byte_bpe.decode_ids(byte_bpe.encode_documents(odd, whole=True).drop("decoded"))
    assert sorted(bytes(r.decoded) for r in whole.collect()) == sorted((r.text or "").encode() for r in odd.collect())


@pytest.mark.parametrize("word", ["a" * 5000, "ab" * 3000, "été" * 700])
def test_long_words(word):
    import tiktoken

    ranks = byte_bpe.load_ranks(byte_bpe.vocabulary())
    coder = tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=ranks, special_tokens={})
    assert byte_bpe.encode_word(word.encode(), ranks) == coder.encode_ordinary(word)


def test_near_copies_without_ids(spark):
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [(None, text(x)) for x in "abc"] + [(None, text("a") + " more"), (7, text("d")), (7, text("e")), (None, text("f")), (9, text("f")), (8, text("f") + " more"), (None, text("g")), (3, text("g"))]
    rows += [(None, ""), (None, " "), (None, text("b"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(df).collect()]
    either = [r for r in kept if (r[1] or "").startswith("a0")]
    assert len(either) == 1 and either[0] in rows
    wanted = [(None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (8, text("f") + " more"), (3, text("g")), (None, ""), (None, " ")]
    assert sorted(map(str, kept)) == sorted(map(str, wanted + either))
    named = {(r.doc_id, r.component_id) for r in jaccard_join.components(df).where("n_shingles > 0").collect()}
    assert {c for i, c in named if i == 3} == {3} and {c for _, c in named} == {None, 7, 8, 3}
    assert jaccard_join.components(df).where("component_id = 3").count() == 2


def grams_by_hand(text):
    run = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    raw = f" {run} ".encode() if run else b""
    return [int.from_bytes(raw[k : k + 4], "little") for k in range(len(raw) - 3)]


def test_language_sets_by_hand(spark):
    """The filter's masks and the counts of a text's n-grams by language, from sets and whole numbers in plain Python."""
    rng = random.Random(11)
    words = {"aa": ["der", "Haus", "über", "geht"], "bb": ["the", "house", "over", "goes"], "cc": ["maison", "sur", "été", "va"]}
    docs = [(k, " ".join(rng.choice(w) for _ in range(rng.randrange(1, 30))), lang) for k, (lang, w) in enumerate(list(words.items()) * 12)]
    docs += [(90, "the Haus 12 été_x", "aa"), (91, None, "aa"), (92, "", "bb"), (93, "rare", None), (94, "12 - 3", "cc")]
    counts = {}
    for _, text, lang in docs:
        for g in grams_by_hand(text or "") if lang else ():
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    languages = sorted(totals, key=lambda x: (-totals[x], x))
    multipliers = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    slots = lambda g: [((g + 1) * m % (1 << 64)) >> (64 - 9) for m in multipliers]
    masks = [0] * 512
    for bit, lang in enumerate(languages):
        for g, n in counts[lang].items():
            if n >= 0.01 * totals[lang]:
                for s in slots(g):
                    masks[s] |= 1 << bit
    model = language_id.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), min_share=0.01, slot_bits=9)
    assert model.languages == tuple(languages) and model.masks.tolist() == masks
    assert all(abs(r - (sum(m >> b & 1 for m in masks) / 512) ** 2) < 1e-12 for b, r in enumerate(model.rates))
    texts = [t or "" for _, t, _ in docs]
    found, n = language_id.popcounts(model, texts)
    for row, size, text in zip(found.tolist(), n.tolist(), texts, strict=True):
        own = grams_by_hand(text)
        assert size == len(own) and row == [sum(all(masks[s] >> b & 1 for s in slots(g)) for g in own) for b in range(len(languages))]


def test_odd_urls(spark):
    """Repeated rows, names that clash with inner ones, null urls and labels, and a very long url."""
    long = "http://example.org/en/1" + "x" * 300_000
    rows = [(1, long, "h"), (2, "HTTP://A.Example.com/fr/x", "h"), (2, "HTTP://A.Example.com/fr/x", "h"), (None, None, None), (3, "no scheme", "h"), (4, "http://b.net/?q", "h"), (5, "x://" + "a." * 5000 + "org/", "h")]
    kind = "page_id long, url string, host string, rule string, domain string, n long, bad long"
    pages = spark.createDataFrame([(i, u, h, "r", "d", 1, 2) for i, u, h in rows], kind)
    labels = spark.createDataFrame([(4, 0, 1), (4, 0, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    found = url_reputation.judge_urls(pages, labels).collect()
    assert sorted(str(r.page_id) for r in found) == sorted(str(r[0]) for r in rows)
    by = {r.page_id: r for r in found}
    assert (by[1].rule, by[1].verdict, len(by[1].path)) == ("example.org/en/1", "block", len(long) - len("http://example.org"))
    assert (by[2].host, by[2].path, by[2].rule, by[2].verdict) == ("a.example.com", "/fr/x", "com/fr/", "allow")
    assert (by[None].host, by[None].path, by[3].host, by[3].path) == ("", "", "", "") and by[5].rule == "org/"
    assert all(r.verdict in ("allow", "block") for r in found) and url_reputation.judge_urls(pages, labels.limit(0)).count() == len(rows)


def test_training_reads_all_documents(spark):
    """A form that only one of many documents tells of counts: no share of the documents is left out."""
    from pyspark.sql import functions as F

    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("card "), F.col("id") % 7, F.lit("111 2222 3333 4444")).alias("text"))
    seen = []
    fit, pii.fit = pii.fit, lambda rows: (seen.append(rows.where("before = 'card '").count()), fit(rows, 1))[1]
    try:
        assert pii.find_personal_data(docs).count() == 9000
    finally:
        pii.fit = fit
    assert seen[0] >= 9000
