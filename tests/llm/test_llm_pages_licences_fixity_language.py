import hashlib
import re
from html import unescape

import duckdb
import numpy as np
from pyspark.sql import functions as F

from thematrail.llm.density import extract_text, main_text
from thematrail.llm.fixity import archive_index, audit, audit_replicas, record_table
from thematrail.llm.language import fit_trigrams, identify_documents, in_known_language, trigram_slots
from thematrail.llm.licences import LICENCES, scan_licences

FOLDER = "/root/testdata/sf0.01"


def article(html):
    """The blocks of the one article that the given pages have, by splitting at its tags."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>|<br>", inner)]
    return "\n".join(b for b in blocks if b)


def test_given_pages_give_their_articles(spark):
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{FOLDER}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in extract_text(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()}
    for i, url, html in rows:
        assert got[i].text == article(html) and got[i].url == url and got[i].n_chars == len(got[i].text)


def test_boilerplate_without_an_article_element():
    html = """<body class="has-sidebar"><div id="site-header">Logo <a href=/>home</a></div><div class=wrap><div class="post"><h2>Tit&nbsp;le</h2>
    <p>One  <b>two</b> three.<p>Four <a href=x>five</a><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>x<br>y</div><div id=comments><p>bad bad bad
    </div><div class="side"><ul><li><a href=1>x y</a><li><a>z</a></ul></div></div><script>if(a<b)"</div>"</script><aside>no</aside><form>no<p>no</form>
    <div class=cookie-notice>We use cookies</div><div role="search">no</div><style>p{}</style><!-- no <p>no -->"""
    assert main_text(html) == "Tit le\nOne two three.\nFour five\na\nb\nc\nd\nx\ny"


def test_names_are_weak_evidence():
    long = "Some words of the main text. " * 20
    text = f"<p>{long}</p><p>{long}</p>"
    want = "\n".join([long.strip()] * 2)
    for attributes in ("class=content-with-sidebar", "class='elementor-widget-text-editor x'", "class=et_pb_widget", "id=right-sidebar", "class=widget", "class='social-science'", "role=form"):
        for page in (f"<div {attributes}>{text}</div>", f"<div {attributes}><article>{text}</article></div>", f"<main><div {attributes}>{text}</div></main>"):
            assert main_text(f"<body class=nav-open>{page}</body>") == want, page
    for page in (f"<form><div>{text}</div><label>Name</label><input></form>", f"<form><article>{text}</article></form>", f"<aside><main>{text}</main></aside>",
                 f"<div class=widget><p>{long}</div><div class=widget><p>{long}</div><div class=widget><a href=1>one link</a></div>"):
        assert main_text(page).startswith(want), page
    assert main_text(f"<article><h1 class=page-header>Title</h1>{text}<div class=share><a>Share</a></div><form>Mail <input></form></article>") == "Title\n" + want
    assert main_text(f"<article>{text}</article><div class=ad>{'Buy it. ' * 20}</div><div class=sidebar><p>More words</div><nav>x</nav>") == want
    assert main_text(f"<article><p>Few words</article><div class=ad>{'Buy it. ' * 4}</div>") == "Few words"


def test_density_selects_inside_main_and_article():
    long = "Some words of the main text. " * 20
    text, want = f"<p>{long}</p>" * 3, "\n".join([long.strip()] * 3)
    lists = "<ul>" + "<li><a href=1>Some other page</a></li>" * 12 + "</ul>"
    teasers = "".join(f"<div><h3><a href={i}>Another page</a></h3><p>Few words <a href={i}>more</a></p></div>" for i in range(5))
    for page in (f"<main><div>{lists}</div><article><h1>Title</h1>{text}</article><div>{teasers}</div></main>",
                 f"<main><h1>Title</h1><div>{lists}</div><div>{text}</div><div>{teasers}</div></main>",
                 f"<article><h1>Title</h1><div>{lists}</div><div>{text}</div><div>{teasers}</div></article>",
                 f"<div><header><h1>Title</h1></header><main><div>{lists}</div><article><h1>Title</h1><div>{text}</div><div>{teasers}</div></article></main></div>"):
        assert main_text(page) == "Title\n" + want, page
    assert main_text(f"<main><div>{lists}</div><article><p>{long}</p></article><div>{teasers}</div></main>") == long.strip()
    short = f"<article><h1>Title</h1><p>Lead.</p><section>{text}</section><section><h2>End</h2><p>Few words.</p></section></article>"
    assert main_text(short) == f"Title\nLead.\n{want}\nEnd\nFew words."
    assert main_text(f"<main><article>{text}</article><article>{text}</article></main>") == want + "\n" + want


def paragraphs(name, n):
    return "".join(f"<p>{name}{i} {'some words of the text. ' * 8}</p>" for i in range(n))


def first_words(html):
    return [line.split()[0] for line in main_text(html).split("\n")]


def test_every_section_and_part_of_a_text_stays():
    page = f"<main><h1>T</h1><section><h2>One</h2>{paragraphs('a', 1)}</section><section><h2>Two</h2>{paragraphs('b', 4)}</section></main>"
    assert first_words(page) == ["T", "One", "a0", "Two", "b0", "b1", "b2", "b3"]
    page = f"<body><div>{paragraphs('a', 2)}</div><div>{paragraphs('b', 4)}</div><div><p>End.</p></div><div>Imprint</div><div><p>© 2020 X</p></div></body>"
    assert first_words(page) == ["a0", "a1", "b0", "b1", "b2", "b3", "End."]
    page = f"<div><article>{paragraphs('a', 4)}</article><article>{paragraphs('b', 1)}</article><article><h2><a href=1>Other</a></h2>{paragraphs('t', 1)}</article></div>"
    assert first_words(page) == ["a0", "a1", "a2", "a3", "b0"]
    assert first_words(f"<body><header><h1>Title</h1></header><main>{paragraphs('a', 2)}</main></body>") == ["Title", "a0", "a1"]
    assert first_words(f"<body><header><h1><a href=/>Site</a></h1></header><main>{paragraphs('a', 2)}</main></body>") == ["a0", "a1"]


def test_inline_elements_leave_their_block_whole():
    assert main_text("<p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>tex</annotation></math> be a number, <svg><title>t</title></svg>and <button>b</button>so <label>l</label>on.") == "Let x+1 be a number, and so on."
    assert main_text(f"<article><p>One <span class=ad>buy</span>two <script>x</script>three.</p>{paragraphs('a', 3)}</article>").split("\n")[0] == "One two three."
    assert main_text("<p>One <select><option>a<option>b</select>two.") == "One two."


def test_comments_and_adverts_inside_an_article():
    added = "".join(f"<div class={c}><p>Not this one.</p></div>" for c in ("comment-section", "post-comments", "ad-slot", "advert-box", "newsletter-form", "sponsored_post-2"))
    nested = "<section class=comments><article class=comment><p>Nor this.</p></article><article><p>Nor that.</p></article></section>"
    assert first_words(f"<article>{paragraphs('a', 2)}{added}{paragraphs('b', 1)}{nested}</article>") == ["a0", "a1", "b0"]
    for name in ("content-with-comments-off", "no-ads", "post-text", "ad-hoc-analysis", "page-block"):
        assert first_words(f"<article>{paragraphs('a', 3)}<div class={name}><p>Kept.</p></div></article>")[-1] == "Kept."


def test_densities_equal_a_plain_recursion_over_the_tree():
    """Trees of random elements, measured again from their definition node by node."""
    from math import e, log
    from random import Random

    from thematrail.llm.density import _Page

    def grown(rng, depth):
        children = [grown(rng, depth - 1) for _ in range(rng.randint(0, 4))] if depth else []
        return rng.choice(["div", "section", "a", "span"]), "word " * rng.randint(0, 9), children

    def shown(node):
        return f"<{node[0]}>{node[1]}{''.join(map(shown, node[2]))}</{node[0]}>"

    def measured(node, linked):
        """(characters, in links, tags below, of these in links) and those of all nodes in page order"""
        own = len("".join(node[1].split()))
        total, below = [own, own * linked, 0, 0], []
        for child in node[2]:
            link = linked or child[0] == "a"
            got = measured(child, link)
            below += got
            total = [total[0] + got[0][0], total[1] + got[0][1], total[2] + got[0][2] + 1, total[3] + got[0][3] + link]
        return [tuple(total), *below]

    for seed in range(40):
        root = ("body", "some text ", [grown(Random(seed), 4) for _ in range(3)])
        nodes = measured(root, False)
        c0, l0 = nodes[0][:2]
        want = []
        for c, lc, t, lt in nodes:
            base = log(c / max(c - lc, 1) * max(lc, 1) + l0 / max(c0, 1) * c + e)
            want.append(c / max(t, 1) * max(log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / log(base), 0) if c else 0)
        got = _Page(root[1] + "".join(map(shown, root[2]))).densities()
        assert np.allclose(got, want)


def test_quoted_values_of_any_length():
    for size in (4000, 9000, 300_000):
        value = "x" * size + " a > b leaked <p class=sidebar> </div>"
        for quote in "\"'":
            assert main_text(f"<div><p data-state={quote}{value}{quote} class='a'>one<p>two</div>") == "one\ntwo"
    assert main_text("""<p data-html=' class="sidebar" '>one<p title = "a>b">two<p x="y"">three<p a"b>four<p href=a?b="c>five""") == "one\ntwo\nthree\nfour\nfive"
    assert main_text("<p>one<p title=\"never closed>two<p>it's") == "one\ntwo\nit's"
    assert main_text("<p>one</p>" + "<p title='a\"'>two" * 3 + '<p title="' + "y" * 20000) == "one\ntwo\ntwo\ntwo"


def test_odd_pages(spark):
    pages = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "just text &amp; more", "t"), (None, "u", "<p>a<p>b", "t"), (5, "u", "<nav>x</nav>", "t"),
             (6, "u", "<div>" * 3000 + "deep" + "</div>" * 3000, "t"), (7, "u", "<article><header><h1>H</h1></header><p>" + "long text " * 20000 + "</article><footer>f</footer>", "t"),
             (8, "u", "<p title='a>b'>x &lt;y&gt; &#233; &unknown; &am", "t"), (9, "u", "<script>never closed <p>x", "t"), (9, "u", "</p></div><p>twice", "t")]
    got = [(r.page_id, r.text) for r in extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string, text string")).collect()]
    texts = dict(got)
    assert len(got) == len(pages) and texts[1] == texts[2] == texts[5] == "" and texts[3] == "just text & more" and texts[None] == "a\nb" and texts[6] == "deep"
    assert texts[7].startswith("H\nlong text long") and len(texts[7]) == 2 + len("long text " * 20000) - 1
    assert texts[8] == "x <y> é &unknown; &am" and {t for i, t in got if i == 9} == {"", "twice"}
    assert extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string, text string").limit(0)).count() == 0


def test_licences_by_whole_text_and_by_line(spark):
    mit = "Copyright (c) 2020 A. Author\n\n" + LICENCES["MIT"].replace("sublicense", "sub-licence").upper().replace("\n", "\r\n  ") + "\nAll rights reserved."
    rows = [(1, mit), (2, "Some text\nReleased under the  M.I.T. license!\nReleased under the MIT Licence.\nLicensed under CC BY-NC 4.0"), (3, None), (4, ""),
            (5, "text released under the MIT License."), (None, "Released under the MIT License."), (2, "Released under the MIT License."), (6, LICENCES["MIT"] + " more")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, licence string, known string")
    got = sorted(((r.doc_id or 0, r.licence or "", r.notices, r.n_notices) for r in scan_licences(docs).collect()))
    assert got == sorted([(1, "MIT", "", 0), (2, "", "CC-BY-NC-4.0,MIT", 2), (3, "", "", 0), (4, "", "", 0), (5, "", "", 0), (0, "MIT", "MIT", 1), (2, "MIT", "MIT", 1), (6, "", "", 0)])
    assert scan_licences(docs.limit(0)).count() == 0
    own = spark.createDataFrame([("OWN", "text released under the mit license")], "licence string, text string")
    assert {r.doc_id: r.licence for r in scan_licences(docs, own).collect()}[5] == "OWN"


def test_licence_files_with_titles_and_statements(spark):
    from thematrail.llm.licences import FILES, TITLES, licence_texts

    rows = [(f"{title}\n\nCopyright (c) 2020 X\n\n{LICENCES[name]}", name) for name in LICENCES for title in TITLES[name]]
    rows += [(text, name) for name, text in licence_texts()]
    assert {name for _, name in rows} == {*LICENCES, *FILES} and {"BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= {n for _, n in rows}
    for line in ("Copyright (c) 2020 X. Licensed under the MIT License.", "© 2015-2020, Foo Inc., all rights reserved. Licensed under the MIT License.",
                 " * Copyright 2020 J. R. Smith and Co. Licensed under the MIT License.", "Copyright Foo Bar, 2020. Licensed under the MIT License.",
                 "(c) 2019, 2020 Foo <a@foo.com>. All rights reserved. Licensed under the MIT License.", "Copyright (c) 2020 X. Copyright (c) 2021 Y Z. Licensed under the MIT License."):
        rows.append((line, "MIT"))
    for line in ("Copyright law of 1976 has four digits.", "Copyright (c) 2020 Foo Bar. See the file for what is allowed."):
        rows.append((line, None))
    blank = ["Copyright (c) 2020 A. Author", "Copyright 2020 Foo Inc. All rights reserved.", "© Foo Bar", "(c) 1999-2003 by Foo", "Copyright (C) Foo Bar 2020"]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)] + [(1000 + i, x) for i, x in enumerate(blank)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in scan_licences(docs).collect()}
    assert [(i, got[i].licence) for i in range(len(rows))] == [(i, name) for i, (_, name) in enumerate(rows)]
    empty = hashlib.sha256(b"").hexdigest()
    assert {got[1000 + i].text_digest for i in range(len(blank))} == {empty}
    assert all(got[i].text_digest != empty for i in range(len(rows)))


def test_audit_finds_all_damage_and_nothing_else(spark):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 40).alias("html"), F.lit(1).alias("file"))
    n = F.col("page_id")
    damaged = F.when(n.isin(3, 999, 1000), F.concat("html", F.lit("x"))).when(n.isin(4, 4999), F.lit(None)).otherwise(F.col("html"))
    got = {r.page_id: r.status for r in audit(archive_index(pages, damaged)).collect()}
    assert len(got) == 5000 and {i for i, s in got.items() if s == "corrupt"} == {3, 999, 1000} and {i for i, s in got.items() if s == "missing"} == {4, 4999}
    assert {r.status for r in audit(archive_index(pages)).collect()} == {"intact"}


def test_audit_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (None, None, ""), (None, "u", "x"), (7, "u", "y" * 200000), (7, "u", "z"), (7, "u", "z"), (10**9, "u", "far")], "page_id bigint, url string, html string")
    got = audit(archive_index(pages, F.when(F.col("html") == "far", "fat").otherwise(F.col("html")))).collect()
    assert len(got) == 7 and [(r.page_id, r.status) for r in got if r.status != "intact"] == [(10**9, "corrupt")]
    spans = sorted((r.file, r.offset, r.length) for r in got)
    assert all(b[1] == a[1] + a[2] for a, b in zip(spans, spans[1:]) if a[0] == b[0])
    assert audit(archive_index(pages.limit(0))).count() == 0


def brute_audit(ours, theirs):
    """What differs between two sets of (file, offset, digest), record by record."""
    out = []
    for file in {f for f, _, _ in ours | theirs}:
        a, b = ([(o, d) for f, o, d in sorted(x - y) if f == file] for x, y in ((ours, theirs), (theirs, ours)))
        for digest in {d for _, d in a} & {d for _, d in b}:
            pairs = list(zip([r for r in a if r[1] == digest], [r for r in b if r[1] == digest]))
            out += [(file, "moved", x[0], y[0], digest, digest) for x, y in pairs]
            a, b = ([r for r in side if r not in {p[k] for p in pairs}] for k, side in enumerate((a, b)))
        a, b = dict(a), dict(b)
        for offset in a.keys() | b.keys():
            status = "surplus" if offset not in a else "missing" if offset not in b else "corrupt"
            out.append((file, status, offset if offset in a else None, offset if offset in b else None, a.get(offset), b.get(offset)))
    return sorted(out, key=str)


def test_two_replicas_with_offsets_of_their_own(spark):
    kind = "page_id bigint, url string, html string, offset string"
    pages = [(i, "u", f"{i % 11} " * (i % 300), "x") for i in range(2500)] + [(None, "u", "y", "x")] * 5 + [(40, "u", "z" * 90_000, "x")]
    lost = [p for p in pages if p[0] not in (3, 1999, 2400)] + [(2400, "u", "other", "x"), (2700, "u", "new", "x"), (9999, "u", "far", "x")]
    lost = [(i, u, h + "!" if i in (100, 1500) else h, o) for i, u, h, o in lost]
    a, b = (record_table(spark.createDataFrame(x, kind), file_records=200) for x in (pages, lost))
    sides = [{(r.file, r.offset, r.digest) for r in x.collect()} for x in (a, b)]
    for one, two, left, right in ((a, b, 0, 1), (b, a, 1, 0), (a, a.limit(0), 0, None)):
        got = sorted(((r.file, r.status, r.offset, r.replica_offset, r.digest, r.replica_digest) for r in audit_replicas(one, two).collect()), key=str)
        assert got == brute_audit(sides[left], sides[right] if right is not None else set())
        assert right is None or {g[1] for g in got} == {"moved", "missing", "surplus"} or "corrupt" in {g[1] for g in got}
    assert audit_replicas(a, a).count() == 0 and audit_replicas(a.limit(0), a.limit(0)).count() == 0


def test_only_the_replica_has_a_range(spark):
    kind = "file bigint, offset bigint, digest string"
    ours = [(0, 0, "a"), (0, 10, "b"), (5, 0, "c")]
    theirs = [*ours, (0, 10**7, "d"), (77, 0, "e"), (None, 0, "f"), (3, None, "f")]
    got = audit_replicas(spark.createDataFrame(ours, kind), spark.createDataFrame(theirs, kind)).collect()
    assert sorted((r.file, r.status, r.offset, r.replica_offset) for r in got) == [(0, "surplus", None, 10**7), (77, "surplus", None, 0)]


def test_records_without_an_id_are_dealt_to_files_of_bounded_size(spark):
    pages = spark.range(3000).select(F.lit(None).cast("bigint").alias("page_id"), F.col("id").cast("string").alias("url"), F.lit("x").alias("html"))
    sizes = [r["count"] for r in archive_index(pages, file_records=100).groupBy("file").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 200


def test_languages_of_held_out_documents(spark):
    docs, pages = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "pages"))
    held_out = F.col("doc_id") % 2 == 0
    blind = docs.withColumn("lang", F.when(~held_out, F.col("lang")))
    got = {r.doc_id: r for r in identify_documents(blind, pages.limit(0)).collect()}
    truth = {r.doc_id: r.lang for r in docs.filter(held_out).collect()}
    assert np.mean([got[i].identified == lang for i, lang in truth.items()]) > 0.97
    with_pages = {r.doc_id: r for r in identify_documents(blind, pages).collect()}
    assert np.mean([with_pages[i].identified == lang for i, lang in truth.items()]) >= np.mean([got[i].identified == lang for i, lang in truth.items()])


def brute_model(rows, languages):
    from thematrail.llm.language import SLOT_COUNT, SLOTS

    table = np.full((len(languages), SLOTS), SLOT_COUNT)
    for text, lang in rows:
        for slot in trigram_slots(text):
            table[languages.index(lang), slot] += 1
    return np.log(table / table.sum(axis=1, keepdims=True))


def test_model_equals_counting(spark):
    rows = [("the cat and THE hat", "en"), ("le chat et la", "fr"), ("", "fr"), (None, "en"), ("der Hund", "xx")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    np.testing.assert_allclose(fit_trigrams(docs, ["en", "fr"]), brute_model([r for r in rows if r[0] and r[1] != "xx"], ["en", "fr"]))


def test_language_rejects_what_has_no_language_and_keeps_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", F.lit("x").alias("host"), F.lit(0).alias("own"))
    odd = [(10**6, None, "en", None, "x", 0), (10**6 + 1, "", None, "s", "x", 0), (10**6 + 2, "12345 !!! 678", "en", "s", "x", 0), (None, "zqxv kjwq xzqj vvqk " * 30, None, None, "x", 0), (10**6 + 3, "one the of and " * 20000, None, "s", "x", 0)]
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.b/en/1000000", "<html lang=en>"), (3, "no url", "")], "page_id bigint, url string, html string")
    both = docs.union(spark.createDataFrame(odd, docs.schema))
    kept = in_known_language(both, pages)
    assert kept.columns == both.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 10**6 + 3 in ids and not {10**6, 10**6 + 1, 10**6 + 2, None} & set(ids)
    assert len(ids) == docs.count() + 1
    assert in_known_language(both.limit(0), pages).count() == 0


def test_lines_of_very_many_statements_and_years_do_not_overflow(spark):
    from pyspark.sql import functions as F

    from thematrail.llm.licences import canonical_lines

    hard = ["© 2020 Aa Bb; " * 20000, "© " + ", ".join(["2020"] * 20000) + " Foo", "copyright (c) 2020 " + "." * 100000, "© 2020 " + " " * 100000 + "x", "© 2020 foo. Licensed under the MIT License. " * 3]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(hard)], "i int, text string").select("i", canonical_lines(F.col("text")).alias("lines"))
    found = {r.i: r.lines for r in rows.collect()}
    assert [found[i] for i in range(4)] == [[]] * 4 and found[4][0].startswith("licensed under the mit license")


def test_fusion_equals_a_plain_loop_over_rows(spark):
    """``identify`` against sums and products of one row at a time, worked out from the definition."""
    import math

    from thematrail.llm.language import ACCEPTED, FACTOR_COUNT, PRIOR_COUNT, UNKNOWN_SHARE, identify

    languages, rng = ("de", "en"), np.random.default_rng(8)
    names, start = ["de", "en", "und"], [(1 - UNKNOWN_SHARE) / 2] * 2 + [UNKNOWN_SHARE]
    hosts = ["a.x.de", "b.x.de", "x.de", "www.y.en", "z.en", "plain", "", None]
    rows = []
    for at in range(240):
        host = hosts[0] if at % 3 == 0 else hosts[rng.integers(len(hosts))]  # one host holds a third of all rows
        likelihood = [float(v) for v in rng.normal(scale=1 + at % 4, size=3)]
        trigrams = int(at % 17 > 0) * 5
        rows.append((at, trigrams, likelihood if trigrams else [0.0] * 3, [None, "de", "en", "fr"][rng.integers(4)], host))
    rows.append(rows[5])  # repeated rows count each
    table = spark.createDataFrame(rows, "doc_id bigint, trigrams bigint, likelihood array<double>, declared string, host string")
    found = sorted((r.doc_id, r.identified, round(r.confidence, 9), r.accepted) for r in identify(table, languages).collect())

    def shares(logs):
        weights = [math.exp(v - max(logs)) for v in logs]
        return [w / sum(weights) for w in weights]

    def domain(host):
        return ".".join(host.split(".")[-2:]) if host is not None else None

    def suffix(host):
        return host.split(".")[-1] if host and "." in host else None

    keys = [{"domain": domain(h), "host": h, "declared": d, "suffix": suffix(h)} for _, _, _, d, h in rows]
    alone = [shares([v + math.log(s) for v, s in zip(x, start)]) if n else [0.0] * 3 for _, n, x, _, _ in rows]

    def others(at, key=None):
        """Text posteriors of all other rows that agree in the key."""
        held = [o for i, o in enumerate(alone) if i != at and (key is None or keys[i][key] == keys[at][key])]
        return [sum(o[c] for o in held) for c in range(3)]

    expected = []
    for at, (doc_id, n, likelihood, _, _) in enumerate(rows):
        whole = others(at)
        prior = [(h + PRIOR_COUNT * s) / (sum(whole) + PRIOR_COUNT) for h, s in zip(whole, start)]
        for key in ("domain", "host"):
            held = others(at, key) if keys[at][key] is not None else [0.0] * 3
            prior = [(h + PRIOR_COUNT * p) / (sum(held) + PRIOR_COUNT) for h, p in zip(held, prior)]
        logs = [math.log(p) + v for p, v in zip(prior, likelihood)]
        for key in ("declared", "suffix"):
            if keys[at][key] is not None:
                kinds = len({k[key] for k in keys} - {None})
                logs = [v + math.log((h + FACTOR_COUNT) / (w + FACTOR_COUNT * (kinds + 1))) for v, h, w in zip(logs, others(at, key), whole)]
        chances = shares(logs)
        best = names[chances.index(max(chances))]
        expected.append((doc_id, best if n else "und", round(max(chances), 9), bool(n) and best != "und" and max(chances) >= ACCEPTED))
    assert [f[:2] + f[3:] for f in found] == [e[:2] + e[3:] for e in sorted(expected)]
    assert np.allclose([f[2] for f in found], [e[2] for e in sorted(expected)], atol=1e-8)
