"""Registered training-data queries against SQL or brute force on the small tables."""

import inspect
import random
import re
import zlib
from collections import defaultdict
from itertools import accumulate

import corpus_pipeline
import duckdb
import pytest
from ledgerline.llm import ORACLES, QUERIES
from ledgerline.llm.simhash import near_duplicates
from tools.compare import TABLES, _agree, normal

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    cursor = db.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(got.columns) == sorted(types)
    assert all(_agree(t, types[c]) for c, t in got.dtypes)
    assert normal(got.toPandas()) == normal(cursor.df())


def test_signatures():
    for name, query in QUERIES.items():
        assert list(inspect.signature(query).parameters) == ["spark", "sf_dir"], name


def test_language_id_held_out(spark, db):
    truth = dict(db.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op2_language_id"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_packing_is_a_partition(spark, texts):
    from tokenizers import Tokenizer
    import public_tokenizers

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in QUERIES["op3_packing"](spark, FOLDER).collect():
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(pieces) == sorted(texts)
    total = 0
    for doc, own in pieces.items():
        ids = encoder.encode(texts[doc] or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        at = 0
        for i in range(len(own)):
            r = own[i]
            assert r.start == at and (i == 0 or r.length == 1024) and (len(own) > 1 or len(ids) <= 1024)
            part = ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * -(-total // 1024) + 1


def simhash(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, texts):
    prints = {doc: simhash(text) for doc, text in texts.items()}
    parent = {d: d for d in texts}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, FOLDER).collect()}
    assert got == {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def test_token_counts(spark, texts):
    """All columns of all texts; ids, and so spans in code points, from the tokenizer file."""
    from tokenizers import Tokenizer
    import public_tokenizers

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(dict)
    for r in QUERIES["op6_token_counts"](spark, FOLDER).collect():
        got[r.doc_id][r.section] = (r.start_byte, r.n_bytes, r.n_tokens, r.n_crossing)
    assert sorted(got) == sorted(texts)
    for doc, text in texts.items():
        tokens, crossing = defaultdict(int), defaultdict(int)
        line_of = list(accumulate((c == "\n" for c in text), initial=0))
        for first, after in encoder.encode(text, add_special_tokens=False).offsets:
            tokens[line_of[first]] += 1
            crossing[line_of[first]] += line_of[first] != line_of[after - 1]
        want, at = {}, 0
        for i, line in enumerate(text.encode().splitlines(keepends=True) if "\r" not in text else text.encode().replace(b"\r", b"x").splitlines(keepends=True)):
            want[i] = (at, len(line), tokens[i], crossing[i])
            at += len(line)
        assert got[doc] == (want or {0: (0, 0, 0, 0)}), doc


def test_html_extraction(spark, db):
    import html

    pages = db.execute("SELECT page_id, html FROM pages").fetchall()
    got = {r.page_id: r.text for r in QUERIES["op8_html_extraction"](spark, FOLDER).collect()}
    for page_id, page in pages:  # these pages have one article of headings and paragraphs
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert got[page_id] == "\n\n".join(b for b in blocks if b)


def test_toxicity_finds_labelled_words(spark, db, texts):
    rows = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, FOLDER).collect()}
    assert sorted(rows) == sorted(texts)
    for doc, toxic in db.execute("SELECT doc_id, toxic FROM labels").fetchall():
        held = zlib.crc32(str(doc).encode()) % 3 == 1
        assert rows[doc].held_out == held and rows[doc].predicted == int(rows[doc].score >= 0.7)
        if not toxic:
            assert rows[doc].predicted == 0


def test_pipeline_stages(spark, db, texts):
    """Every stage against brute force on its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    kept = stages["language_id"](spark, docs, FOLDER)
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {d for d, t in texts.items() if re.search(r"[^\W\d_]", t)}

    lines = stages["line_dedup"](spark, docs, FOLDER)
    want = {d: t for d, t, *_ in db.execute(ORACLES["op4_line_dedup"]).fetchall()}
    assert lines.columns == columns and {r.doc_id: r.text for r in lines.collect()} == want

    single = stages["near_dedup"](spark, docs, FOLDER)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(least_of_copies(texts))

    clean = stages["decontamination"](spark, docs, FOLDER)
    leaks = {r[0] for r in db.execute(f"SELECT doc_id FROM ({ORACLES['op10_decontamination']})").fetchall()}
    assert leaks and clean.columns == columns and {r.doc_id for r in clean.collect()} == set(texts) - leaks

    packed = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "sequence_id", "offset"} <= set(packed.columns)
    assert {r.doc_id for r in packed.select("doc_id").collect()} <= set(texts) - leaks


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def least_of_copies(texts):
    """Smallest id of each component of texts with five-word Jaccard similarity >= 0.8, by brute force."""
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in texts:
        for b in texts:
            common, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and (not either or common / either >= 0.8):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {find(d) for d in texts}


def test_near_dedup_stage_equals_brute_force(spark, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    single = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, FOLDER)
    assert {r.doc_id for r in single.collect()} == least_of_copies(texts)


def test_near_copies_far_beyond_the_fingerprints(spark):
    """Chains of edited copies from 0.5 to 1, some of few words, also when stars are cut into small parts."""
    from ledgerline.llm.copies import near_copies

    rng = random.Random(8)
    texts = {}
    for family in range(12):
        words = [f"f{family}w{rng.randint(0, 900)}" for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(12):
            texts[len(texts)] = " ".join(words)
            words = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = least_of_copies(texts)
    assert 12 < len(want) < len({r.component_id for r in near_duplicates(docs).collect()})
    for part_shingles in (1_000_000, 300):
        assert {r.component_id for r in near_copies(docs, part_shingles=part_shingles).collect()} == want
