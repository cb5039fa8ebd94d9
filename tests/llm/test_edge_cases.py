"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from ledgerline.llm import decontaminate, html, langid, lines, packing, quality, simhash, tokens, toxicity, warc
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "alpha beta, gamma delta.\n" * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with everything that may be odd about them, and columns named like the operators' own."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, LONG, "en", "a", len(LONG)),
        (5, "one two", "en", "b", 7), (5, "one two", "en", "b", 7), (6, "one two", None, "b", 7), (None, "alpha beta", "en", None, 10),
        (7, "é ü 日本語 \U0001f600", "fr", "c", 9), (8, "12 34 !!", "de", "c", 8),
    ]
    rows = [(*r, 1.0, "x", 2, "y", "z", "w", 9) for r in rows]
    return spark.createDataFrame(
        rows, SCHEMA + ", score double, _lines string, n_lines int, fp string, _h string, TEXT_KEY string, unit int"
    )


def fresh(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.collect()), key=lambda v: (v is None, v))


ALL = [1, 2, 3, 4, 5, 5, 6, 7, 8, None]


# language ID


def toy_languages(spark):
    rng = random.Random(1)
    make = lambda words: " ".join(rng.choice(words) for _ in range(40))
    rows = [(i, make(["the", "house", "and", "water"]), "en", "s", 1) for i in range(20)]
    rows += [(100 + i, make(["der", "wasser", "und", "haus"]), "de", "s", 1) for i in range(20)]
    rows += [(200, "rare", "xx", "s", 1), (201, None, "en", "s", 1), (202, "the", None, "s", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_language_forward_sums_all_segmentations():
    pieces = {"▁": 0, "▁a": 1, "a": 2, "ab": 3, "b": 4, "▁ab": 5}
    probability = [0.3, 0.2, 0.1, 0.15, 0.05, 0.12, 1e-9]

    def brute(rest):
        if not rest:
            return 1.0
        known = sum(probability[pieces[rest[:n]]] * brute(rest[n:]) for n in range(1, len(rest) + 1) if rest[:n] in pieces)
        return known + (probability[-1] * brute(rest[1:]) if rest[0] not in pieces else 0)

    models = np.array([probability, probability[::-1]]).T.copy()
    words = ["a", "ab", "abab", "abba", "xaab", "b"]
    fast = langid.forward_words(words, langid.Trie(pieces), models)
    for word, row in zip(words, fast):
        want = brute("▁" + word)
        assert np.isclose(np.exp(langid.log_probability(word, pieces, [probability], 3)[0]), want)
        assert np.isclose(np.exp(row[0]), want)
    counts = langid.expected_counts("abab", pieces, probability, 3)
    assert np.isclose(sum(n * len(p) for p, i in pieces.items() for n in [counts.get(i, 0)]), 5)  # they cover the word


def test_language_odd_rows(spark, odd):
    model = langid.fit_languages(toy_languages(spark))
    assert model["languages"] == ["de", "en"]  # 'xx' has too few rows
    got = langid.predict_language(odd, model).collect()
    assert ids(langid.predict_language(odd, model)) == ALL
    by = {r.doc_id: r for r in got}
    for doc in (1, 2, 3, 8):
        assert (by[doc].lang_pred, by[doc].score) == ("und", 0.0)
    assert by[4].lang_pred in ("de", "en") and 0.5 <= by[4].score <= 1
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and set(ids(kept)) >= {4, 5} and not set(ids(kept)) & {1, 2, 3, 8}
    assert langid.predict_language(fresh(spark), model).count() == 0
    nothing = langid.fit_languages(fresh(spark))
    assert nothing["languages"] == []
    assert {r.lang_pred for r in langid.predict_language(odd, nothing).collect()} == {"und"}


def test_language_words_of_any_length():
    pieces = langid.load_pieces(langid.vocabulary_path())
    models = [[1e-4] * len(pieces) + [1e-7], [2e-4] * len(pieces) + [1e-7]]
    found, words = langid.WordScores(pieces, models).texts(["q" * 30_000 + " the"])[0]
    assert words == 2 and np.isfinite(found).all() and found[1] > found[0]


# packing


def places(spark, lengths, **how):
    units = spark.createDataFrame(list(enumerate(lengths)), "unit bigint, length bigint")
    rounds = []
    found = packing.best_fit(units, on_round=lambda *a: rounds.append(a), **how).collect()
    assert sorted(r.unit for r in found) == list(range(len(lengths)))
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, lengths[r.unit]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= how.get("capacity", 1024)
    return len(sequences), len(rounds)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= length]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - length)
    return len(gaps)


@pytest.mark.parametrize("low, high", [(1, 8), (1, 99), (20, 50), (30, 30), (51, 99)])
def test_packing_rounds_match_best_fit(spark, low, high):
    rng = random.Random(low)
    lengths = [rng.randint(low, high) for _ in range(500)]
    n, rounds = places(spark, lengths, capacity=100, block_rows=60)
    assert n <= 1.03 * best_fit_decreasing(lengths, 100) + 1 and rounds <= 12


def test_packing_one_block_and_none(spark):
    lengths = [7, 3, 3, 5, 5, 2]
    assert places(spark, lengths, capacity=10)[0] == best_fit_decreasing(lengths, 10)
    assert places(spark, [], capacity=10) == (0, 0)


def test_packing_odd_rows(spark, odd):
    got = packing.pack_documents(odd).collect()
    assert {r.doc_id for r in got} == set(ALL) and sum(r.piece == 0 for r in got) == len(ALL)
    null = [r for r in got if r.doc_id == 1]
    assert [(r.start, r.length, r.ids_crc32) for r in null] == [(0, 1, zlib.crc32((2).to_bytes(4, "little")))]
    long = sorted((r for r in got if r.doc_id == 4), key=lambda r: r.piece)
    assert all(r.length == 1024 for r in long[1:]) and [r.start for r in long] == list(np.cumsum([0, *[r.length for r in long[:-1]]]))
    assert packing.pack_documents(fresh(spark)).count() == 0


# line dedup


def test_lines_keep_first_and_spread(spark):
    line, near = "Shared  LINE", "on four"
    rows = [(i, f"own {i}\n{line if i % 2 else line.lower()}\n{near if i < 4 else 'x' + str(i)}", "en", f"s{i}", 0) for i in range(7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 1 and line.lower() not in got[i].text.lower() for i in range(1, 7))
    assert got[3].text == "own 3\non four"
    everywhere = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs, keep_first=False).collect()}
    assert everywhere == dict.fromkeys(range(7), 1)
    assert sum(r.n_removed for r in lines.dedup_lines(docs, min_sites=8).collect()) == 0
    exact = lines.dedup_lines(docs, min_sites=7, near=0.9)  # all counts are exact
    assert sum(r.n_removed for r in exact.collect()) == 6


def test_lines_odd_rows(spark, odd):
    got = lines.dedup_lines(odd, min_sites=1)
    assert set(odd.columns) <= {*got.columns, "n_lines"} and got.count() == len(ALL)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text is None and by[1][0].n_lines == 0 and by[2][0].text == "" and by[3][0].text == " \n\t "
    assert [r.text for r in by[5]] == ["one two"] * 2 and by[6][0].text == ""  # 5 is the first to have it
    assert by[4][0].text == LONG
    assert lines.dedup_lines(fresh(spark)).count() == 0


# near duplicates


def trie_brute(x, budget):
    label = list(range(len(x)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(x)):
        for j in range(i):
            if int(x[i] ^ x[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def test_trie_equals_brute_force():
    rng = np.random.default_rng(2)
    for budget in (0, 1, 4):
        for flips in range(5):
            x = rng.integers(0, 2**63, 5, dtype=np.uint64)[rng.integers(0, 5, 90)]
            for _ in range(flips):
                x = x ^ (np.uint64(1) << rng.integers(0, 64, 90, dtype=np.uint64))
            x = np.unique(np.concatenate([x, np.array([0, 2**64 - 1], np.uint64)]))
            assert simhash.trie_classes(x, np.array([0]), budget).tolist() == trie_brute(x, budget)


def test_fingerprints_link_across_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 40)
    prints = {int(v) for v in base}
    for v in base.tolist():
        for _ in range(6):
            for bit in rng.integers(0, 64, int(rng.integers(1, 7))):
                v ^= (1 << int(bit)) if bit < 63 else -(1 << 63)
            prints.add(int(v))
    x = np.sort(np.array(sorted(p % 2**64 for p in prints), np.uint64))
    want = trie_brute(x, 4)
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.linked_fingerprints(df).collect()]
    parent = {int(v): int(v) for v in x}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert [find(int(v)) for v in x] == [int(x[i]) for i in want]


def test_hot_subtree_is_dealt_to_several_tasks(spark):
    """10^5 fingerprints below one 12-bit prefix, cut into parts of 30,000: the same components as in one task, from several tasks."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 52, 21_000, dtype=np.uint64)
    prints = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 52, len(base), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 52, len(base), dtype=np.uint64)) for _ in range(4)]))
    prints = (prints | np.uint64(0xABC << 52)).view(np.int64)
    assert len(prints) > 100_000
    df = spark.createDataFrame([(int(p),) for p in prints], "fp bigint")

    def components(run_rows):
        parent = {}

        def find(v):
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        links = simhash.linked_fingerprints(df, run_rows=run_rows)
        tasks = links.withColumn("t", F.spark_partition_id()).select("t").distinct().count()
        for r in links.collect():
            a, b = find(r.a), find(r.b)
            parent[max(a, b)] = min(a, b)
        return {v: find(v) for v in list(parent) if find(v) != v}, tasks

    whole, parts = components(simhash.RUN_ROWS), components(30_000)
    assert whole[0] == parts[0] and len(whole[0]) > 60_000 and parts[1] >= 4


def test_simhash_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd)
    assert ids(got) == ALL
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[2].component_id == by[3].component_id == 1
    assert by[5].component_id == by[6].component_id == 5 and by[None].component_id is None
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and ids(kept) == [1, 4, 5, 7, 8, None]
    assert simhash.near_duplicates(fresh(spark)).count() == 0


def test_keep_one_judges_rows_not_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one), (2, one), (2, two), (3, two), (4, three), (4, three), (4, one), (5, three)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == [(1, one), (2, two), (4, three)]
    pair = spark.createDataFrame([(7, one), (7, two), (8, one), (9, two)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(pair).collect()) == [(7, one), (7, two)]


# token counts


@pytest.mark.parametrize("rule, want", [("start", [2, 0, 1]), ("majority", [1, 1, 1]), ("split", [1 + 1 / 4, 3 / 4, 1])])
def test_tokens_crossing_rule(rule, want):
    first, after = np.array([0, 3, 7]), np.array([3, 7, 9])  # the second token holds the border at 4
    counts, crossing = tokens.attribute(first, after, np.array([0, 4, 7]), 9, rule)
    assert counts.tolist() == want and crossing.tolist() == [1, 0, 0]


def test_tokens_odd_rows(spark, odd):
    got = tokens.section_tokens(odd).collect()
    assert {r.doc_id for r in got} == set(ALL)
    encoder = tokens.Encoder()
    assert [(r.section, r.n_bytes, r.n_tokens) for r in got if r.doc_id == 1] == [(0, 0, 0.0)]
    long = [r for r in got if r.doc_id == 4]
    assert len(long) == 20_000 and sum(r.n_tokens for r in long) == len(encoder.ids(LONG))
    assert sum(r.n_tokens for r in got if r.doc_id == 7) == len(encoder.ids("é ü 日本語 \U0001f600"))
    assert sum(r.n_bytes for r in got if r.doc_id == 5) == 14
    assert tokens.section_tokens(fresh(spark)).count() == 0
    with pytest.raises(ValueError):
        tokens.section_tokens(odd, rule="other")


# quality


def test_quality_odd_rows(spark, odd):
    rows = {r.doc_id: r for r in quality.quality_rules(odd).collect()}
    assert ids(quality.quality_rules(odd)) == ALL
    assert rows[1].n_words == rows[2].n_words == rows[3].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[4].n_words == 80_000 and rows[4].n_repeat_words == 80_000 and rows[4].n_dup_lines == 19_999 and rows[4].base_failed
    assert quality.quality_rules(fresh(spark)).count() == 0


def test_quality_frequent_lines(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, f"{body(i)}\nMenu home about", "en", "h", 0) for i in range(12)] + [(20, body(0), "en", "other", 0)]
    rows += [(100 + i, " ".join(f"same{j}" for j in range(60)), "en", "h", 0) for i in range(11)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].n_line_words_removed == 3 and got[i].kept for i in range(12)) and got[20].kept
    assert all(not got[100 + i].kept and not got[100 + i].base_failed for i in range(11))


# pages


def test_html_parts():
    page = """<html><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
    <div class="cookie-notice"><p>We use cookies, ok, fine, and more text here, for length.</p></div>
    <div id="wrap"><div class="content"><h2>Title</h2><p>First para, with commas, and some length to score well, indeed.
    <p>Second para &eacute; &lt;x&gt; here, long enough to be scored, yes.</p><div class="share"><a>tweet</a></div>
    <ul><li>one item<li>two item</ul></div><aside><p>aside text, long, long, long, and much more of this text to be scored</p></aside>
    <div class="comments"><p>Comment, bla, bla, bla, bla, bla, bla, bla, bla and a long one at that.</p></div></div>
    <form>in<input></form><script>if (a<b) {}</script><footer>foot</footer>"""
    want = ["Title", "First para, with commas, and some length to score well, indeed.", "Second para é <x> here, long enough to be scored, yes."]
    assert html.main_text(page) == "\n\n".join([*want, "one item", "two item"])


def test_html_names():
    text = "Some words, with commas, that are long enough to be a paragraph of their own."
    page = f"""<body><div class="page has-sidebar"><div id="ad-wrap"><article><div class="article-header"><h1>Top</h1></div><p title="a hidden gem">{text}
    <div class="article-comments"><p>{text} {text}</div><p hidden>{text}<aside>{text}</aside></article></div>
    <section id="user_comments"><p>{text} {text} {text}</p></section></div>"""
    assert html.main_text(page) == f"Top\n\n{text}"


def test_html_article_parts_with_telling_names():
    text = "Some words, with commas, that are long enough to be a paragraph of their own."
    links = "<a href=x>Another page of this site</a> <a href=y>And one more page of it</a>"
    page = f"""<body><article><h1 id="related-work">One</h1><p>{text}</p><section id="discussion"><h2 id="search-results">Two</h2><p>{text}</p></section>
    <p class="warning">{text}</p><div id="feedback-loop"><p>{text}</p></div><div class="related">{links}</div><div id="replies">{links}</div>
    <div class="article-comments"><p>{text} {text}</p></div><div id="sidebar"><p>{text}</p></div></article></body>"""
    assert html.main_text(page) == "\n\n".join(["One", text, "Two", text, text, text])


@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div class='content'>{}</div>"])
def test_html_form_around_the_page(inner):
    text = "Some words, with commas, that are long enough to be a paragraph of their own."
    body = inner.format(f"<h1>Top</h1><p>{text}</p><p>{text}</p>")
    page = f"<body><form id='aspnetForm' action=x><input value=q><select><option>o</select>{body}</form><p>Rest</p></body>"
    assert html.main_text(page) == f"Top\n\n{text}\n\n{text}"
    assert html.main_text(f"<body>{body}<form>{text}<input></form></body>") == f"Top\n\n{text}\n\n{text}"


def test_html_odd_rows(spark):
    pages = ["", None, "plain text only", "<p>a<p>b", "<", "<div", "</p></div>x", "<!-- open", "<b>" * 5000 + "deep", "<p title='>'>q</p>"]
    rows = [(i, None, p, "clash") for i, p in enumerate(pages)] + [(None, "u", "<p>z</p>", "clash")] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html.extract_main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[0] == by[1] == "" and by[2] == "plain text only" and by[3] == "a\n\nb" and by[8] == "deep" and by[9] == "q" and by[None] == "z"
    assert html.extract_main_text(spark.createDataFrame([], df.schema)).count() == 0


# toxicity


def test_toxicity_folding_and_exceptions():
    matcher = toxicity.Matcher({"moron": 3.0, "trash": 2.0}, ["trash can"])
    count = lambda text: matcher.features(text)[0]
    assert count("you m0r0n") == count("MORONS!") == count("mоrоn") == count("mórоn") == 1  # Cyrillic letters, accents
    assert count("the trash can is full") == 0 and count("trash talk") == 1 and count("oxymoron") == 0 and count(None) == count("") == 0
    short, long = matcher.features("moron"), matcher.features("moron " + "fine " * 500)
    assert short[1] == long[1] and short[2] > long[2]


def test_toxicity_odd_rows(spark, odd):
    rng = random.Random(4)
    clean = [" ".join(rng.choice(["sun", "tree", "river", "stone"]) for _ in range(30)) for _ in range(30)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(clean)] + [(100 + i, f"{t} dreadfulx", "en", "s", 0) for i, t in enumerate(clean)]
    labels = spark.createDataFrame([(i, 0) for i in range(30)] + [(100 + i, 1) for i in range(30)] + [(None, 1), (5000, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_lexicon(spark.createDataFrame(rows, SCHEMA), labels)
    assert list(model["weights"]) == ["dreadfulx"]
    got = toxicity.score_toxicity(odd, model)
    assert ids(got) == ALL and all(0 <= r.score < 0.7 for r in got.collect())
    bad = spark.createDataFrame([(1, "a dreadfu1x day", None, None, None)], SCHEMA)
    assert toxicity.score_toxicity(bad, model).first().n_hits == 0  # 1 stands for i
    nothing = toxicity.fit_lexicon(fresh(spark), labels.limit(0))
    assert nothing["weights"] == {} and toxicity.score_toxicity(odd, nothing).count() == len(ALL)


# decontamination


def test_items_odd_rows(spark, odd):
    words = [f"w{i}" for i in range(400)]
    item = " ".join(words[100:130])
    rows = [(50, " ".join(words), 0), (51, " ".join(words[:104]), 0), (52, " ".join(words[:128]), 0), (53, "Alpha BETA", 0), (54, None, 0)]
    extra = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows], "doc_id bigint, text string, score double")
    docs = odd.select("doc_id", "text", "score").unionByName(extra)
    asked = [(1, item, "x"), (2, "alpha  beta", "x"), (3, None, "x"), (4, " ", "x"), (1, item, "x"), (None, "one two", "x")]
    items = spark.createDataFrame(asked, "item_id bigint, text string, containment string")
    want = {(50, 1): 1.0, (52, 1): 24 / 26, (53, 2): 1.0, (None, 2): 1.0, (5, None): 1.0, (6, None): 1.0}
    for block in (20_000, 2):
        got = decontaminate.find_items(docs, items, block=block).collect()
        assert {(r.doc_id, r.item_id): r.containment for r in got} == want
        kept = decontaminate.without_items(docs, items, block=block)
        assert kept.columns == docs.columns and ids(kept) == [1, 2, 3, 4, 7, 8, 51, 54]
    assert decontaminate.find_items(fresh(spark), items).count() == 0
    assert decontaminate.find_items(docs, items.limit(0)).count() == 0 and decontaminate.without_items(docs, items.limit(0)).count() == docs.count()


# revisits


CAPTURE = "record_id bigint, url string, ts bigint, is_revisit boolean, headers map<string,string>, digest string, body string"


def test_revisits(spark):
    tag = {"ETag": '"a"', "Content-Type": "text/html", "X-Own": "1", "Date": "d1"}
    rows = [
        (1, "http://e.org/a/", 10, False, tag, "h1", "body1"), (2, "https://WWW.e.org/a#f", 20, True, {"etag": 'W/"a"', "DATE": "d2", "X-Own": "2"}, None, None),
        (3, "e.org/a?utm_source=z", 30, True, {"ETag": '"b"'}, None, None), (4, "http://e.org/a", 5, True, {"ETag": '"a"'}, None, None),
        (5, "http://e.org/a", 10, True, {"ETag": '"a"'}, None, None), (6, "http://e.org/a", 40, True, {}, "h1", None),
        (7, "http://e.org/a", 41, True, None, None, None), (8, None, 50, True, {"ETag": '"a"'}, None, None), (9, None, 1, False, tag, "h", "b"),
        (10, "http://e.org/a", None, True, {"ETag": '"a"'}, None, None), (11, "http://e.org/b?y=2&x=1", 1, None, {"Last-Modified": "m"}, "h2", "body2"),
        (12, "http://e.org/b?x=1&y=2&gclid=3", 2, True, {"last-modified": "m", "Vary": "v"}, None, None), (12, "http://e.org/b?x=1&y=2&gclid=3", 2, True, {"last-modified": "m", "Vary": "v"}, None, None),
        (13, "http://e.org/b?y=2&x=1", 1, False, {"Last-Modified": "n"}, "h3", "body3"),
    ]
    rows = [(*r, "clash") for r in rows]
    got = warc.resolve_revisits(spark.createDataFrame(rows, CAPTURE + ", status string"), payload="body").collect()
    by = {r.record_id: r for r in got}
    assert len(got) == 10
    status = {k: (r.status, r.response_id) for k, r in by.items()}
    assert status == {
        2: ("resolved", 1), 3: ("mismatch", 1), 4: ("no_response", None), 5: ("no_response", None), 6: ("resolved", 1), 7: ("no_validator", 1),
        8: ("no_response", None), 10: ("no_response", None), 12: ("mismatch", 13),
    }
    assert by[2].headers == {"etag": 'W/"a"', "content-type": "text/html", "x-own": "1", "date": "d2"}
    assert (by[2].payload, by[2].digest, by[3].payload, by[3].digest) == ("body1", "h1", None, None)
    assert warc.resolve_revisits(spark.createDataFrame([], CAPTURE)).count() == 0


def test_revisits_odd_rows(spark):
    """A null record id with a payload, a very long URL and header, repeated rows, clashing columns."""
    long = "http://e.org/" + "x" * 100_000
    rows = [
        (None, "http://e.org/n", 1, False, {"ETag": '"n"'}, "h", "body of none"), (20, "http://e.org/n", 2, True, {"ETag": '"n"'}, None, None),
        (21, long, 1, False, {"ETag": '"l"', "X-Long": "y" * 100_000}, "h", "z" * 100_000), (22, long + "#top", 2, True, {"ETag": '"l"'}, None, None),
        (22, long + "#top", 2, True, {"ETag": '"l"'}, None, None), (None, long, 3, True, {"ETag": '"l"'}, None, None),
    ]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], CAPTURE + ", blk string, _of string")
    got = warc.resolve_revisits(df, payload="body").collect()
    shown = sorted((str(r.record_id), str(r.response_id), r.status, len(r.payload or ""), len(r.headers.get("x-long", ""))) for r in got)
    assert shown == [("20", "None", "resolved", 0, 0), ("22", "21", "resolved", 100_000, 100_000)] + [("22", "21", "resolved", 100_000, 100_000), ("None", "21", "resolved", 100_000, 100_000)]


def test_revisits_of_one_hot_url(spark):
    rng = random.Random(6)
    rows = [(i, "http://hot.org/", rng.randint(0, 300), rng.random() < 0.6, {"ETag": f'"{rng.randint(0, 2)}"'}, None, None) for i in range(600)]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, CAPTURE)).collect()}
    for i, _, ts, revisit, headers, *_ in rows:
        if revisit:
            earlier = max(((t, j, h) for j, _, t, v, h, *_ in rows if not v and t < ts), default=None, key=lambda e: e[:2])
            assert got[i].response_id == (earlier and earlier[1])
            assert got[i].status == ("no_response" if earlier is None else "resolved" if earlier[2] == headers else "mismatch")


def test_pipeline_odd_rows(spark, odd, tmp_path):
    spark.createDataFrame([(1, "zz yy xx ww vv uu")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = toy_languages(spark).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, fresh(spark), str(tmp_path)).count() == 0, name
