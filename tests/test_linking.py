import hashlib
import random

from ledgerline.functions.similarity import indel_ratio
from ledgerline.operators.continuation import resolve_continued
from ledgerline.operators.linking import link_pages
from ledgerline.operators.ordering import order_rows
from ledgerline.storage import materialize

NAMES = ["Carrivcashel", "Carrycashel", "CARRYCASHEL.", "Carrycastle", "Tully", "tully", "", "", None]
SCOPE = ["c", "b", "p"]


def fold(v):
    text = "".join(ch for ch in (v or "").lower() if ch not in "'`.,;:-")
    return " ".join(text.split())


def corpus(seed, pages=12):
    rng = random.Random(seed)
    rows, n = [], 0
    for page in range(pages):
        for _ in range(rng.randint(1, 4)):
            scope = ("C", "B", "P" if rng.random() < 0.85 else "Q")
            name = rng.choice(NAMES) if rng.random() < 0.4 or not rows else rows[-1][2]
            rows.append((n, f"pg{page:03d}", name, *scope, rng.randint(0, 1)))
            n += 1
    return rows


def model_links(rows, threshold):
    """Sequential model: page pairs in order, names read after earlier links."""
    names = [r[2] for r in rows]
    pages = sorted({r[1] for r in rows})
    for a, b in zip(pages, pages[1:]):
        left = [i for i, r in enumerate(rows) if r[1] == a and (names[i] or "").strip()]
        right = [i for i, r in enumerate(rows) if r[1] == b]
        first = next((i for i in right if (names[i] or "").strip()), None)
        if not left or first is None or rows[left[-1]][3:6] != rows[first][3:6]:
            continue
        name, target = names[left[-1]], fold(names[first])
        if indel_ratio(fold(name), target) < threshold:
            continue
        for i in right:
            if fold(names[i]) != target or rows[i][3:6] != rows[first][3:6]:
                break
            names[i] = name
    return dict(zip((r[0] for r in rows), names))


def test_link_pages_equals_sequential_model(spark):
    schema = "i int, page_name string, v string, c string, b string, p string, cont int"
    for seed in range(4):
        # many small corpora side by side in one table: a page-free scope change keeps them apart
        rows = corpus(seed, pages=40)
        df = order_rows(spark.createDataFrame(rows, schema), ["page_name", "i"], blocks=5)
        for page_block, summary_block in ((3, 256), (2, 3), (1, 2), (100_000, 256)):
            got = link_pages(df, 0.77, label="v", scope=SCOPE, page_block=page_block, summary_block=summary_block).collect()
            want = model_links(rows, 0.77)
            assert {r.i: (r.townland_linked or "").strip() for r in got} == {i: (v or "").strip() for i, v in want.items()}


def test_long_chain_crosses_page_blocks(spark):
    # every page holds one spelling only; the first name has to travel over all of them
    rows = [(i, f"pg{i:03d}", "Carrivcashel" if i == 0 else ("Carrycashel" if i % 2 else "Carivcashel"), "C", "B", "P", 0) for i in range(30)]
    df = order_rows(spark.createDataFrame(rows, "i int, page_name string, v string, c string, b string, p string, cont int"), ["i"], 4)
    got = link_pages(df, 0.77, label="v", scope=SCOPE, page_block=4).collect()
    assert {r.townland_linked for r in got} == {"Carrivcashel"}
    assert {r.i: r.townland_linked for r in got} == model_links(rows, 0.77)


def test_chain_of_many_spellings(spark):
    """No page ends the chain: names pass, fail against a spelling further on and give way, over three levels of blocks."""
    rng = random.Random(9)
    spellings = ["Carrivcashel", "Carrycashel", "Carycashel", "Carricashe", "Corrycastle", "Karrivcashel", "Carrivcashil"]
    rows = [(i, f"pg{i:03d}", rng.choice(spellings), "C", "B", "P", 0) for i in range(150)]
    df = order_rows(spark.createDataFrame(rows, "i int, page_name string, v string, c string, b string, p string, cont int"), ["i"], 4)
    for threshold in (0.77, 0.9):
        want = model_links(rows, threshold)
        assert len(set(want.values())) > 1
        for page_block, summary_block in ((7, 4), (2, 3)):
            got = link_pages(df, threshold, label="v", scope=SCOPE, page_block=page_block, summary_block=summary_block).collect()
            assert {r.i: r.townland_linked for r in got} == want


def test_long_chains_take_no_more_jobs(spark):
    """A chain over 100 blocks of 100 pages takes as many jobs as pages that have nothing in common."""
    schema = "i int, page_name string, v string, c string, b string, p string, cont int"
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for name in (lambda i: "Carrivcashel" if i == 0 else "Carrycashel", lambda i: hashlib.md5(str(i).encode()).hexdigest()):
        rows = [(i, f"pg{i:05d}", name(i), "C", "B", "P", 0) for i in range(10_000)]
        df = materialize(order_rows(spark.createDataFrame(rows, schema), ["i"], 4))
        group = f"links {len(jobs)}"
        spark.sparkContext.setJobGroup(group, group)
        got = {r.townland_linked for r in link_pages(df, 0.77, label="v", scope=SCOPE, page_block=100).collect()}
        assert got == ({"Carrivcashel"} if not jobs else {r[2] for r in rows})
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    assert abs(jobs[0] - jobs[1]) <= 3 and jobs[0] < 60  # adaptive plans differ by a broadcast or two


def test_continuation_equals_sequential_model(spark):
    schema = "i int, page_name string, v string, c string, b string, p string, cont int"
    for seed in range(3):
        rows = corpus(seed + 50, pages=25)
        got = resolve_continued(
            spark.createDataFrame(rows, schema), ["i"], 0.77, label="v", scope=SCOPE, continued="cont", blocks=6
        ).collect()
        want = {r[0]: r[2] for r in rows}
        last = {}
        for page in sorted({r[1] for r in rows}):
            fresh = {}
            for scope in sorted({r[3:6] for r in rows if r[1] == page}):
                group = [r for r in rows if r[1] == page and r[3:6] == scope]
                run, runs = [], []
                for r in group + [None]:
                    name = (r[2] or "").strip() if r else None
                    if run and (name is None or name != run[0][2].strip()):
                        runs.append(run)
                        run = []
                    if name:
                        run.append(r)
                prior = last.get(scope)
                for run in runs:
                    if run[0][6] > 0 and prior and indel_ratio(fold(run[0][2]), fold(prior)) >= 0.77:
                        want.update({r[0]: prior for r in run})
                if runs:
                    fresh[scope] = runs[-1][0][2]
            last.update(fresh)
        assert {r.i: r.v for r in got} == want


def test_adjacent_numbers_only(spark):
    names = ["Carrivcashel", "Carrycashel", "Carycashel"]
    rows = [(i, f"EV_LOG_001_{n:03d}.jpg", names[i], "C", "B", "P", 0) for i, n in enumerate((9, 10, 12))]
    df = order_rows(spark.createDataFrame(rows, "i int, page_name string, v string, c string, b string, p string, cont int"), ["i"], 2)
    got = {r.i: r.townland_linked for r in link_pages(df, 0.77, label="v", scope=SCOPE, adjacent_only=True).collect()}
    assert got == {0: "Carrivcashel", 1: "Carrivcashel", 2: "Carycashel"}
    anyway = {r.townland_linked for r in link_pages(df, 0.77, label="v", scope=SCOPE).collect()}
    assert anyway == {"Carrivcashel"}
