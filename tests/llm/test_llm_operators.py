"""Corpus operators next to brute force, on the smallest tables and on odd rows."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomenlink.llm import attention_quality, decontaminate, doubling_windows, exact_copies, html_templates, packing
from nomenlink.llm import queries, radix_windows, secret_scan, sketch_join, units, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts():
    """Random texts with copies, edits, shared passages, repeats, nulls, blanks and a very long one."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.randint(1, 260))) for _ in range(40)]
    passage = " ".join(word() for _ in range(120))
    texts = base + base[:6] + [base[0].upper()] + [f"{x}\n{passage}\t{y}" for x, y in zip(base[:8], base[8:16])]
    for text in [x for x in base if len(x) > 600][:6]:
        parts = text.split(" ")
        for times in (1, 2, 4, 9):
            copy = list(parts)
            for _ in range(times):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [None, "", " \n\t ", None, "a", "a", "one two", "ab " * 500, "x" * 1500, passage * 3, (passage + " z ") * 60]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(number, text, "en", 1, "clash") for number, text in enumerate(_texts())]
    rows += [rows[3], rows[3], (None, rows[5][1], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, core long, score string").repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return [(row["doc_id"], row["text"] or "") for row in docs.collect()]


def _windows(units_of, window):
    """Marks of units covered by windows that start twice, per row."""
    seen = collections.Counter()
    for values in units_of:
        seen.update(values[s : s + window] for s in range(len(values) - window + 1))
    marks = []
    for values in units_of:
        mark = [False] * len(values)
        for s in range(len(values) - window + 1):
            if seen[values[s : s + window]] > 1:
                mark[s : s + window] = [True] * window
        marks.append(mark)
    return marks


def _same(got, expected):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, expected))


@pytest.mark.parametrize("threshold", [400, 60])
def test_bytes_against_brute_force(docs, rows, threshold):
    texts = [text.encode() for _, text in rows]
    expected = []
    for (doc_id, _), data, mark in zip(rows, texts, _windows(texts, threshold)):
        runs = "".join("x" if m else " " for m in mark).split()
        kept = bytes(b for b, m in zip(data, mark) if not m)
        expected.append((doc_id, len(data), sum(mark), len(runs), kept))
    found = radix_windows.remove_repeated_bytes(docs, threshold).collect()
    got = [
        (r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"]))
        for r in found
    ]
    _same(got, expected)


@pytest.mark.parametrize("window", [35, 10])
def test_words_against_brute_force(docs, rows, window):
    lists = [tuple(WORD.findall(text)) for _, text in rows]
    expected = []
    for (doc_id, _), words, mark in zip(rows, lists, _windows(lists, window)):
        kept = " ".join(w for w, m in zip(words, mark) if not m)
        expected.append((doc_id, len(words), sum(mark), kept))
    _same(doubling_windows.remove_repeated_words(docs, window).collect(), expected)


def _groups(rows, words, least):
    sets = []
    for _, text in rows:
        found = WORD.findall(text.translate(LOWER))
        short = {tuple(found)} if found else set()
        sets.append({tuple(found[i : i + words]) for i in range(len(found) - words + 1)} or short)
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if common and 100 * common >= least * (len(x) + len(sets[j]) - common):
                parent[top(i)] = top(j)
    members = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        members[top(i)].append(doc_id)
    name = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return [(doc_id, len(x), name[top(i)]) for i, ((doc_id, _), x) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("words, least", [(4, 85), (5, 80), (2, 60)])
def test_sketch_join_against_brute_force(docs, rows, words, least):
    _same(sketch_join.link_documents(docs, sketch_join.Rule(words, least, 100)).collect(), _groups(rows, words, least))


def test_sketch_join_of_a_large_group_of_edited_copies(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(140)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = _groups(rows, 4, 85)
    assert len({name for _, _, name in expected}) > 1  # some copies stay apart
    _same(sketch_join.link_documents(docs, sketch_join.Rule(4, 85, 100)).collect(), expected)


def test_exact_copies(docs, rows):
    best = collections.defaultdict(list)
    for doc_id, text in rows:
        best[text].append(doc_id)
    expected = []
    for doc_id, text in rows:
        keep = max((x for x in best[text] if x is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        expected.append((doc_id, keep, len(best[text]), doc_id == keep, digest))
    _same(exact_copies.label_copies(docs).collect(), expected)
    left = exact_copies.drop_copies(docs)
    assert left.columns == docs.columns
    _same([(r["doc_id"], r["text"] or "") for r in left.collect()], {(e[1], t) for e, (_, t) in zip(expected, rows)})


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    tokenizer = Tokenizer.from_file(path)
    odd = [(900, "It's Σίσυφος ÇA İstanbul <|endoftext|> á ﬁne x y don't!'s\x01 \r\n½ 12,5% ét日本語 ÀB's"), (901, "%%%,,,")]
    spark = docs.sparkSession
    both = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    found = packing.pack_documents(both, path, 64, keep_ids=True).collect()
    expected = []
    for doc_id, text in [*rows, *odd]:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            cut = ids[start : start + 64]
            crc = zlib.crc32(np.array(cut, dtype="<u4").tobytes())
            expected.append((doc_id, piece, start, len(cut), crc, tuple(cut)))
    _same([(*r[:5], tuple(r["ids"])) for r in found], expected)
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        place = 0
        for offset, length in sorted(spans):
            assert offset == place
            place += length
        assert place <= 64
    assert len(sequences) == _plain_best_fit([r["length"] for r in found], 64)


def _plain_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        room = min(fitting) if fitting else capacity
        if fitting:
            rooms.remove(room)
        rooms.append(room - length)
    return len(rooms)


def test_best_fit_plan_equals_the_plain_method():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.randint(1, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
        plan = packing.best_fit(collections.Counter(lengths), capacity)
        used = collections.Counter()
        for length, count in collections.Counter(lengths).items():
            runs = sorted(tuple(map(int, r)) for r in plan if r[0] == length)
            for number, (_, rank, first, each, _) in enumerate(runs):
                stop = runs[number + 1][1] if number + 1 < len(runs) else count
                for j in range(rank, stop):
                    used[first + (j - rank) // each] += length
        assert max(used.values()) <= capacity and sum(used.values()) == sum(lengths)
        assert len(used) == _plain_best_fit(lengths, capacity)


def test_secrets():
    body = "a1B2" * 7 + "zz"
    good = f"ghp_{body}{secret_scan.checksum(body)}"
    text = f"İK toKen='abc' TOKEN = abcdef! api_key:\"x\" AKIA{'Q' * 16} AKIAshort {good} ghp_{body}000000 {'0f' * 12} apikey=1/2+3="
    found = [(k, text[a:b]) for a, k, b in secret_scan.find_secrets(text)]
    assert found == [
        ("assign", "TOKEN = abcdef"), ("access", "AKIA" + "Q" * 16), ("checked", good), ("hex", "0f" * 12),
        ("assign", "apikey=1/2+3="),
    ]
    assert secret_scan.find_secrets("") == []


def test_secrets_query(spark, sf):
    assign = re.compile(
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
    )
    got = {r["doc_id"]: r for r in secret_scan.op10_secret_scan(spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = row["text"] or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        assert got[row["doc_id"]]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()


def test_url_rules(spark):
    link = '<html><head><link href="{}" rel=canonical></head></html>'
    pages = [
        (1, "https://a.example.net/x?u#f", ""), (2, "https://EXAMPLE.net/en/x", None), (3, "http://example.com/de/1", ""),
        (4, "https://b.example.com/fr/", link.format("http://example.com/de/1")), (5, "https://free.org/de/", ""),
        (6, "https://c.example.com/q", link.format("/r")), (7, "https://c.example.com/r", link.format("//free.org/fr/z")),
        (8, "https://c.example.com/r2", '<meta http-equiv="Refresh" content="0; URL=http://example.com/de/9">'),
        (9, None, None), (10, "no scheme", "x"), (8, "https://c.example.com/r3", link.format("https://c.example.com/r2")),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, rule string")
    got = {(r["page_id"], r["path"]): (r["host"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(df).collect()}
    assert got[1, "/x"] == ("a.example.net", "net/", "block")
    assert got[2, "/en/x"] == ("example.net", "example.net/en/", "allow")
    assert got[3, "/de/1"][1:] == ("example.com/de/", "block")
    assert got[4, "/fr/"][1:] == (None, "block")
    assert got[6, "/q"][2] == got[7, "/r"][2] == "allow" and got[5, "/de/"] == ("free.org", None, "allow")
    assert got[8, "/r2"][2] == got[8, "/r3"][2] == "block"
    assert got[9, ""] == got[10, ""] == ("", None, "allow")


def test_extraction_equals_the_article(spark, sf):
    got = {r["page_id"]: r for r in html_templates.op1_template_extraction(spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", row["html"] or "", re.DOTALL)
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", article.group(1).replace("<br>", " ") if article else "")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", part)).split()) for part in parts]
        expected = "\n".join(block for block in blocks if block)
        assert (got[row["page_id"]]["text"], got[row["page_id"]]["n_chars"]) == (expected, len(expected))


def test_extraction_without_semantic_tags(spark):
    page = (
        "<body><div class='top-menu'>Home</div><div id=c{0}><div class=story><h2>T{0}</h2><p>{1}<b>{2}</b>&lt;</p>"
        "<script>x='<p>'</script><div class=comments><p>no</p></div></div><div class='cookie notice'>ok</div></div>"
    )
    rows = [(n, "https://x.example/" + str(n), page.format(n, "long text " * (n + 3), n), 1) for n in range(5)]
    rows += [(9, None, None, 2), (10, "https://x.example/odd", "plain &amp; text <b", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r["page_id"]: r["text"] for r in html_templates.extract_pages(df).collect()}
    assert got[2] == "T2\n" + ("long text " * 5) + "2<"
    assert got[9] == "" and got[10] == "plain & text"


def test_the_host_s_pages_decide_and_not_the_names(spark):
    shapes = {
        "side": "<body><div class='content has-sidebar'><p>{0}</p></div><div class=x>same</div></body>",
        "open": "<body><article class='post comments-open'><header class=entry-header><h1>H{1}</h1></header><p>{0}</p>"
        "</article></body>",
        "form": "<body><form><div id=a><p>{0}</p></div><div id=b>same</div></form></body>",
        "plain": "<body><div class=teaser><p>All rights</p></div><div class=text><p>{0}</p><p>Write to us</p></div></body>",
    }
    rows = []
    for host, shape in shapes.items():
        # Many pages, and hosts of one page where the names are a hint.
        for n in range(7):
            where = host if n < 6 else f"{host}-alone"
            rows.append((len(rows), f"https://{where}.example/{n}", shape.format(f"long text {n} " * 9, n)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["url"]: r["text"] for r in html_templates.extract_pages(df).collect()}
    for n in range(6):
        body = (f"long text {n} " * 9).strip()
        assert got[f"https://side.example/{n}"] == got[f"https://form.example/{n}"] == body
        assert got[f"https://open.example/{n}"] == f"H{n}\n{body}"
        assert got[f"https://plain.example/{n}"] == body
    body = ("long text 6 " * 9).strip()
    assert got["https://open-alone.example/6"] == f"H6\n{body}"
    assert body in got["https://side-alone.example/6"] and body in got["https://form-alone.example/6"]


def test_tokens_of_a_host_do_not_meet_in_one_window(spark):
    rows = [("h", n, f"<body><div id={'abcdef'[n]}x><p>t{n}</p></div></body>") for n in range(6)]
    pages = spark.createDataFrame(rows, "host string, page long, html string")
    pages = pages.withColumn("texts", F.lit(None).cast("array<binary>"))
    templates = html_templates.host_templates(pages, html_templates.Scratch(spark, "test-templates"))
    assert "Window" not in templates._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in templates.collect()] == [("h", [">body"], ">body")]


def test_quality_learns_and_scores_every_row(spark, sf, docs):
    got = attention_quality.op7_attention_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    model = attention_quality.quality_model(spark, documents, sf)
    scored = attention_quality.score_quality(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    empty = spark.createDataFrame([], "doc_id long, label int")
    assert attention_quality.fit_quality(documents, empty) is None


def test_attention_gradients():
    rng = np.random.default_rng(1)
    first = np.array([0, 3, 4, 9])
    x, labels = rng.normal(size=(9, 5)), np.array([1.0, 0.0, 1.0])
    model = attention_quality.train(x, first, labels, hidden=4, steps=400)
    assert np.abs(model.scores(x, first) - labels).max() < 0.1


def test_leaks_with_edits(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(14, 50))) for _ in range(12)] + ["too short", None, ""]
    rows, expected = [], set()
    for number in range(300):
        body = [word() for _ in range(rng.randint(0, 200))]
        if number % 3 == 0:
            item = rng.randrange(12)
            copy = items[item].split(" ")
            for _ in range(int(len(copy) * 0.15)):
                place = rng.randrange(len(copy))
                copy[place : place + 1] = rng.choice([[word()], [], [copy[place], word()]])
            at = rng.randint(0, len(body))
            body[at:at] = [w.title() + "***" for w in copy]
            expected.add((number, item))
        rows.append((number, " ".join(body)))
    rows += [(None, items[0]), (1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, items[1])], "item_id long, text string")
    found = decontaminate.find_leaks(docs, bench, 0.7).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected | {(None, 0)}
    exact = next(r for r in found if r["doc_id"] is None)
    assert (exact["matched"], exact["start"], exact["similarity"]) == (exact["item_words"], 0, 1.0)
    assert exact["stop"] == exact["item_words"]
    left = decontaminate.drop_leaking(docs, bench, 0.7)
    assert left.count() == len(rows) - len(expected)
    assert decontaminate.find_leaks(docs, bench.limit(0)).isEmpty()


def test_every_copy_of_the_stated_similarity_is_found(spark):
    words = lambda name, many: [f"{name}{k}" for k in range(many)]
    items = {1: words("a", 5), 2: words("b", 6), 3: words("c", 16), 4: words("d", 3), 5: ["e"], 6: words("f", 10)}
    change = lambda copy, *at: [f"x{k}" if k in at else word for k, word in enumerate(copy)]
    bodies = [
        (1, change(items[1], 2)), (2, change(items[2], 2)), (3, change(items[3], 3, 7, 11)), (4, items[4]), (5, ["e"]),
        (6, [y for k, word in enumerate(items[6]) for y in (word, f"y{k}")]),
        (3, items[3][:12] + ["z"] * 20 + change(items[3], 2, 5, 8)),  # an exact part scores above the edited copy
        (None, change(items[1], 1, 3)), (None, change(items[3], 1, 5, 9, 13)), (None, items[4][:2]),
    ]
    rows = [(n, " ".join(["pad"] * 40 + body + ["pad"] * 40)) for n, (_, body) in enumerate(bodies)]
    # Some parts of an item are frequent, which must not cost its other seeds.
    rows += [(100 + n, " ".join(items[3][4:7] + ["q"] * 60 + items[3][12:15])) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(0, 1): 4, (1, 2): 5, (2, 3): 13, (3, 4): 3, (4, 5): 1, (5, 6): 10, (6, 3): 13}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert radix_windows.remove_repeated_bytes(docs).isEmpty()
    assert doubling_windows.remove_repeated_words(docs).isEmpty()
    assert sketch_join.link_documents(docs, sketch_join.Rule()).isEmpty()
    assert exact_copies.label_copies(docs).isEmpty() and exact_copies.drop_copies(docs).isEmpty()
    assert secret_scan.scan_secrets(docs).isEmpty()
    assert attention_quality.score_quality(docs, None).isEmpty()
    import public_tokenizers

    assert packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY)).isEmpty()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_templates.extract_pages(pages).isEmpty() and url_rules.judge_urls(pages).isEmpty()


def test_hashes_do_not_depend_on_the_block():
    import pyarrow as pa

    texts = ["one two", "", "two one two", "x" * 50, "é two"]
    whole = [units.words(d, b)[2].tolist() for _, d, b in units.blocks(pa.array(texts))]
    alone = [units.words(d, b)[2].tolist() for t in texts for _, d, b in units.blocks(pa.array([t]), 1)]
    assert sum(whole, []) == sum(alone, [])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    result = con.execute(queries.ORACLES[name])
    names = [column[0] for column in result.description]
    _same([tuple(r) for r in queries.QUERIES[name](spark, sf).select(*names).collect()], result.fetchall())


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = pipeline.quality_classifier(spark, docs, sf)
    assert scored.columns == docs.columns
    copies = pipeline.exact_dedup(spark, scored, sf)
    assert copies.count() == scored.select(F.coalesce("text", F.lit(""))).distinct().count()
    near = pipeline.ngram_jaccard_join(spark, copies, sf)
    rows = [(r["doc_id"], r["text"] or "") for r in copies.collect()]
    names = {(doc_id, name) for doc_id, _, name in _groups(rows, 5, 80)}
    assert {r["doc_id"] for r in near.collect()} == {doc_id for doc_id, name in names if doc_id == name}
    clean = pipeline.benchmark_decontamination(spark, near, sf)
    assert clean.columns == docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not [r for r in clean.collect() if any(item in (r["text"] or "") for item in items)]
    packed = pipeline.best_fit_packing(spark, clean, sf)
    assert packed.select("doc_id").distinct().count() == clean.count()
    assert pipeline.run(spark, sf).count() == packed.count()
