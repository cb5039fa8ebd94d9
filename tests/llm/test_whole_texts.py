"""No caps, prefixes or switches: rare languages, long words, short items, special tokens, small blocks, odd page layouts."""

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from ledgerline.llm import ORACLES, QUERIES, decontaminate, html, langid, packing, tokens, toxicity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


# language ID


def test_every_language_is_learned(spark):
    """201 languages, each with five rows about words of its own."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[(k * 7 + j * (k % 5 + 1)) % 26] for j in range(6))
    rows = [(k * 5 + i, f"{word(k)} {word(k)} {word(k + 300)}", f"l{k:03}", "s", 0) for k in range(201) for i in range(5)]
    model = langid.fit_languages(spark.createDataFrame(rows, SCHEMA))
    assert len(model["languages"]) == len(model["models"]) == 201


def test_long_words_teach(spark):
    """Two languages without spaces: only words of 60 letters tell them apart."""
    rng = random.Random(3)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(60))
    rows = [(i, make("aeioulmn"), "xa", "s", 0) for i in range(30)] + [(100 + i, make("zkwrtpxs"), "xb", "s", 0) for i in range(30)]
    model = langid.fit_languages(spark.createDataFrame(rows, SCHEMA))
    new = spark.createDataFrame([(1, make("aeioulmn") * 3, None, None, 0), (2, make("zkwrtpxs") * 3, None, None, 0)], SCHEMA)
    got = {r.doc_id: r for r in langid.predict_language(new, model).collect()}
    assert got[1].lang_pred == "xa" and got[2].lang_pred == "xb" and min(r.score for r in got.values()) > 0.9


def test_parts_of_words():
    assert langid.parts_of("abc") == ["▁abc"]
    assert langid.parts_of("a" * 81) == ["▁" + "a" * 40, "a" * 40, "a"]


# tokens and packing


def test_added_tokens_stand_for_themselves(encoder):
    own = tokens.Encoder()
    for text in (SPECIAL, f"a{SPECIAL}b", f"{SPECIAL}{SPECIAL} x", "<|endoftext|", f"é{SPECIAL}\n日本", f"one {SPECIAL} two"):
        ids, first, after = own.spans(text)
        assert ids.tolist() == encoder.encode(text, add_special_tokens=False).ids
        assert after[-1] == len(text.encode()) and (first[1:] == after[:-1]).all()
    assert own.ids(f"x{SPECIAL}").tolist().count(50256) == 1


@pytest.mark.parametrize("block_rows", [40, 5000])
def test_packing_of_documents_in_blocks(spark, encoder, block_rows):
    """The query's form, dealt to many blocks and to one: a gapless partition in about as few sequences as can be."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    special = spark.createDataFrame([(900, f"a {SPECIAL} b"), (901, None), (902, "long " * 3000)], "doc_id bigint, text string")
    docs = docs.select("doc_id", "text").unionByName(special)
    rounds, pieces, sequences = [], defaultdict(dict), defaultdict(list)
    for r in packing.pack_documents(docs, block_rows=block_rows, on_round=lambda *a: rounds.append(a)).collect():
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for r in docs.collect():
        ids = encoder.encode(r.text or "", add_special_tokens=False).ids + [2]
        own, at = pieces.pop(r.doc_id), 0
        for i in range(len(own)):
            part = ids[at : at + own[i].length]
            assert own[i].start == at and own[i].ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += own[i].length
        assert at == len(ids)
        total += at
    assert not pieces and len(sequences) <= 1.02 * -(-total // 1024) + 1 and len(rounds) <= 16
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


# decontamination


def test_short_items_inside_texts(spark, tmp_path):
    docs = [(1, "x y alpha beta gamma z t u v"), (2, "alpha x beta gamma"), (3, "Alpha  Beta\tgamma"), (4, "gamma"), (5, "delta epsilon zeta eta"), (6, None), (7, "")]
    items = [(1, "alpha beta gamma"), (2, "gamma"), (3, "beta gamma"), (4, "delta epsilon zeta eta"), (5, "u v w"), (6, None), (3, "beta gamma")]
    docs = spark.createDataFrame([(*d, "en", "s", 1) for d in docs], SCHEMA)
    items = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.containment, r.n_shingles) for r in decontaminate.find_items(docs, items).collect())
    assert sorted(set(got)) == [(d, i, 1.0, 1) for d, i in [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 2), (5, 4)]]
    assert sum(r[1] == 3 for r in got) == 6  # the repeated item repeats its matches
    docs.write.parquet(str(tmp_path / "documents"))
    items.dropDuplicates().write.parquet(str(tmp_path / "benchmark"))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    assert sorted(db.execute(ORACLES["op10_decontamination"]).fetchall()) == sorted(set(got))


def test_items_cut_in_two_are_found(spark):
    """Containment 0.8 and more with up to 1,000 foreign words between the halves."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    docs, items = [], []
    for i in range(120):
        item = words(rng.randint(30, 120))
        cut = rng.randint(1, len(item) - 1)
        text = words(200) + item[:cut] + words(rng.randint(0, 1000)) + item[cut:] + words(200)
        own = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
        held = {tuple(text[k : k + 5]) for k in range(len(text) - 4)}
        if len(own & held) >= 0.8 * len(own):
            docs.append((i, " ".join(text)))
            items.append((i, " ".join(item)))
    got = decontaminate.find_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert len(docs) > 80 and sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i, _ in docs]


# pages


TEXT = "Some words, with commas, that are long enough to be a paragraph of their own."
OTHER = "Other words, as many commas, and quite as long as what the first paragraph has."


def joined(*blocks):
    return "\n\n".join(blocks)


def test_html_equal_paragraphs_in_parts_of_their_own():
    assert html.main_text(f"<body><div><p>{TEXT}</p></div><div><p>{OTHER}</p></div></body>") == joined(TEXT, OTHER)
    page = f"<body><div><p>{TEXT}</p></div><ul><li>one</li><li>two</li></ul><div><p>{OTHER}</p></div></body>"
    assert html.main_text(page) == joined(TEXT, "one", "two", OTHER)


def test_html_short_last_part():
    page = f"<body><div class=post><h1>T</h1><div class=chunk><p>{TEXT}</p><p>{OTHER}</p></div><div class=chunk><p>short one.</p></div></div></body>"
    assert html.main_text(page) == joined("T", TEXT, OTHER, "short one.")


@pytest.mark.parametrize(
    "part",
    [
        "<div class='notice'>Cookie notice: we use cookies</div>", f"<div class='related'><p>{OTHER}</p></div>", f"<div id='comments'><p>{OTHER}</p></div>",
        f"<section id='comments'><article class='comment-body'><p>{OTHER}</p></article></section>", f"<ol class='comment-list'><li>{OTHER}</li></ol>",
    ],
)
def test_html_side_parts_inside_an_article(part):
    for whole in ("article", "main"):
        assert html.main_text(f"<body><{whole}><h1>T</h1><p>{TEXT}</p>{part}<p>{TEXT}</p></{whole}></body>") == joined("T", TEXT, TEXT)


def test_html_many_equal_sections_and_short_blocks():
    sections = "".join(f"<div><div><p>{TEXT} {i}</p></div></div>" for i in range(12))
    page = f"<body><div>{sections}</div><div class=sidebar><p>{TEXT}</p></div></body>"
    assert html.main_text(page) == joined(*[f"{TEXT} {i}" for i in range(12)])
    short = "".join(f"<div><h3>Part {i}</h3><p>Short {i}.</p></div>" for i in range(9))
    assert html.main_text(f"<body><nav>a b c</nav><div>{short}</div></body>") == joined(*[t for i in range(9) for t in (f"Part {i}", f"Short {i}.")])


def test_html_code_keeps_its_comments():
    page = f"<body><article><p>{TEXT}</p><pre>x = 1 <span class='comment'># why</span></pre><p>{TEXT}</p></article></body>"
    assert html.main_text(page) == joined(TEXT, "x = 1 # why", TEXT)


# toxicity


def test_toxicity_matcher_equals_brute_force(spark):
    """Hits of whole texts, word by word: the longest entry that begins the word, unless an exception phrase covers it."""
    rng = random.Random(5)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    folding = toxicity.Folding()
    folded = [toxicity.fold(r.text or "", folding) for r in docs]
    every = sorted({w for f in folded for w in f.split()})
    entries = {w[: rng.randint(4, 8)]: rng.random() for w in rng.sample([w for w in every if len(w) >= 4], 150)}
    firsts = [f.split() for f in folded if len(f.split()) > 3]
    phrases = [" ".join(ws[k : k + 2]) for ws in firsts for k in [rng.randrange(len(ws) - 1)]][:60]
    matcher = toxicity.Matcher(entries, phrases)
    for r, text in zip(docs, folded):
        words, want = text.split(), []
        covered = {k + j for p in phrases for k in range(len(words) - 1) if words[k : k + 2] == p.split() for j in range(2)}
        at = 0
        for k, word in enumerate(words):
            own = [e for e in entries if word.startswith(e)]
            if own and k not in covered:
                want.append((at, max(own, key=len), entries[max(own, key=len)]))
            at += len(word) + 1
        assert matcher.hits(text) == want, r.doc_id


def test_toxicity_finds_held_out_labels(spark):
    """sf 0.01 has 51 toxic labels, of which two thirds teach: most words they share are learned, and no clean document is named."""
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, folder).collect()}
    held = [rows[d] for d, toxic in labels.items() if toxic and rows[d].held_out]
    assert len(held) >= 15 and sum(r.predicted for r in held) >= 0.75 * len(held)
    assert not any(rows[d].predicted for d, toxic in labels.items() if toxic == 0)


# the pipeline's stages on odd rows


def test_each_stage_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts and repeated rows: what each stage keeps, by its own rule."""
    spark.createDataFrame([(1, "zz yy xx ww vv uu"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n ", "en", "a", 3), (4, "one two three", "en", None, 13), (4, "one two three", "en", None, 13),
        (5, "head zz yy xx ww vv uu tail", None, "b", 27), (None, "four five six", "en", "b", 13), (None, "one two three", "en", "b", 13),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    stages, folder = dict(corpus_pipeline.STAGES), str(tmp_path)
    key = lambda r: tuple(map(str, r))
    got = lambda name: sorted(map(tuple, stages[name](spark, docs, folder).collect()), key=key)
    expect = lambda kept: sorted(kept, key=key)
    assert got("language_id") == expect(rows[3:])  # en is learned from six rows; texts without a letter go
    assert got("line_dedup") == expect(rows)
    # 2 and 3 hold no word like 1; rows without an id stay; of the equal rows one stays
    assert got("near_dedup") == expect([rows[0], rows[3], rows[5], rows[6], rows[7]])
    assert got("decontamination") == expect([r for r in rows if r[0] != 5])
    packed = stages["packing"](spark, docs, folder).collect()
    assert sorted(str(r.doc_id) for r in packed) == sorted(str(r[0]) for r in rows)
