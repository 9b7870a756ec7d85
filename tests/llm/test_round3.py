"""Language identification, fill-in-middle and the filter audit against plain versions."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cairn.llm import decontaminate, embed_dedup, fill_middle, filter_audit, html_text, language, url_rules
from cairn.llm.folds import fold
from cairn.llm.scratch import Scratch
from cairn.llm.wordvec import word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score double, form string, output string, n long, mask int, b0 long, cls long, `a.b` string, part string"
TAIL = (0.5, "f", "o", 7, 3, 4, 5, "x", "p")
ODD = [None, "", "   \n", "One", "12 34!", "été \U0001f600\U0001f600 é   x", "a<P>b<S>c<M>d", "<P", "<<S>> ok", "ends with <M>", "\U0001f600a" * 700, "ab\r\n" * 900]


def rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéAB") for _ in range(rnd.randint(1, 6)))
    texts = [*ODD, *[" ".join(word() for _ in range(rnd.randint(1, 300))) for _ in range(60)], "long words " * 200_000, "x" * 1_500_000, "# one"]
    base = " ".join(word() for _ in range(400))
    texts += [base] * 20 + [base[:-1] + c for c in "xyzx"] + ["Q" + base[1:]] * 2  # near copies that share length and blocks
    out = [(i, t, rnd.choice(["en", "de", None]), *TAIL) for i, t in enumerate(texts)]
    return [*out, (20, base, "en", *TAIL), (None, base, "de", *TAIL), (None, None, None, *TAIL), (None, "nobody else", "en", *TAIL), (3, "One", "de", *TAIL)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


def plain_arranged(doc_id, text, seed="1:"):
    t = text or ""
    n = len(t)
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@pytest.mark.parametrize("size", [1, 7, fill_middle.BLOCK])
def test_arranged(spark, docs, size):
    small = docs.where(F.length("text") < 3000) if size < 512 else docs
    got = fill_middle.arrange(small, size=size).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == small.count()
    forms = set()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_arranged(r.doc.doc_id, r.doc.text)
        assert r.back == (r.doc.text or "") and r.doc["a.b"] == "x"
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}
    assert fill_middle.arrange(docs.limit(0)).count() == 0


def test_every_cut(spark):
    """Each pair of places of a short text is cut as told, with parts that look like pieces of sentinels."""
    texts = ["<P<S<M", ">S>P>M>", "a<", "\U0001f600é<\n>"]
    df = spark.createDataFrame([(i, t) for t in texts for i in range(120)], "doc_id long, text string")
    got = fill_middle.arrange(df, plain=100, size=2).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert {(r.prefix_chars, r.middle_chars) for r in got if r.doc.text == "a<"} == {(a, b - a) for a in range(3) for b in range(a, 3)}
    assert all(r.back == r.doc.text for r in got)


def plain_counts(docs, labels):
    """The audit, row by row."""
    texts = [r[1] or "" for r in docs]
    key = lambda i: (i is None, i or 0)
    least = {}
    for r, t in zip(docs, texts):
        least[t] = min(least.get(t, (True, 1)), key(r[0]))
    masks = []
    for r, t in zip(docs, texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), key(r[0]) > least[t]]
        masks.append({f for f, x in zip("ABCDE", fails) if x})
    good = {i for i, q, x in labels if q == 1}
    toxic = {i for i, q, x in labels if x == 1}
    out = {}
    for part in {r[2] or "" for r in docs}:
        mine = [(m, r[0]) for r, m in zip(docs, masks) if (r[2] or "") == part]
        shapley = {f: sum(next((x for x in p if x in m), None) == f for p in permutations("ABCDE") for m, _ in mine) for f in "ABCDE"}
        for p in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(p, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                failing = sum(f in m for m, _ in mine)
                out[part, "".join(p), step] = (
                    len(left), len(gone), failing - len(gone), sum(m == {f} for m, _ in mine), sum(i in good for _, i in gone if i is not None),
                    sum(i in toxic for _, i in gone if i is not None), shapley[f],
                )
    return out


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.lit(0).cast("long"), lambda c: F.pmod(F.xxhash64(c), F.lit(2))])
def test_audit(spark, docs, hashed):
    """Hashes that tell nothing apart leave the work to the comparison of texts: the figures stay."""
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 90, 2)] + [(None, 1, 1), (4, None, 1), (6, 0, None), (5, None, None)]
    counts = filter_audit.mask_counts(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), hashed=hashed)
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIGURES) for r in filter_audit.interactions(counts).collect()}
    assert got == plain_counts(rows(), labels)


def test_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(filter_audit.mask_counts(docs.limit(0), labels)).count() == 0
    one = filter_audit.interactions(filter_audit.mask_counts(docs.where("doc_id = 1"), labels))
    assert one.count() == 600 and one.where("good_lost + toxic_lost > 0").count() == 0


def test_word_counts():
    data = "a bb\x0bA a a ü\x1fx  \x0c".encode() * 50
    want = re.findall(rb"[^\x20\x09-\x0D]+", data)
    for piece in (1, 3, 64, 1 << 20):
        assert filter_audit.word_counts(data, piece) == (len(want), len(set(want)))


def test_refinement_drops_single_rows(spark):
    texts = ["a" * 64 + x for x in ("b", "b", "c", "dd")] + ["q" * 65, "zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    facts = df.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), *filter_audit._block_hashes(F.col("text"), F.xxhash64))
    assert {r.doc_id for r in filter_audit.refine(facts, Scratch(spark, "t")).collect()} == {0, 1}


@pytest.fixture(scope="module")
def net():
    rnd = np.random.default_rng(1)
    return language.Network(
        ["a", "b", "c"], [rnd.normal(size=(12, 256)).astype(np.float32) for _ in "lr"], [rnd.normal(size=(12, 4)).astype(np.float32) for _ in "lr"],
        [rnd.normal(size=(3, 4)).astype(np.float32) for _ in "lr"], rnd.normal(size=(3, 1)).astype(np.float32),
    )


def test_gradients(net):
    """Backpropagation through time against differences of the loss."""
    rnd = np.random.default_rng(0)
    exact = language.Network(net.labels, *[[w.astype(float) for w in ws] for ws in (net.table, net.state, net.out)], net.bias.astype(float))
    data, target = rnd.integers(0, 256, (7, 5)), rnd.integers(0, 3, 5)
    _, grads = language.gradients(exact, data, target)
    for w, g in zip(exact.weights, grads):
        for k in range(20):
            at = (rnd.integers(w.shape[0]), data[rnd.integers(7), rnd.integers(5)] if w.shape[1] == 256 else rnd.integers(w.shape[1]))
            old, e = w[at], 1e-6
            w[at] = old + e
            up, _ = language.gradients(exact, data, target)
            w[at] = old - e
            down, _ = language.gradients(exact, data, target)
            w[at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 1e-7


def plain_positions(net, data):
    """Probabilities of each position of one segment, byte by byte."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    seen = []
    for way, order in ((0, range(len(data))), (1, range(len(data) - 1, -1, -1))):
        n = net.state[way].shape[1]
        h, out = np.zeros(n), {}
        for t in order:
            x, u = net.table[way][:, data[t]].astype(float), net.state[way].astype(float) @ h
            z, r = sig(x[:n] + u[:n]), sig(x[n : 2 * n] + u[n : 2 * n])
            h = (1 - z) * h + z * np.tanh(x[2 * n :] + r * u[2 * n :])
            out[t] = h
        seen.append(out)
    logits = np.array([net.out[0] @ seen[0][t] + net.out[1] @ seen[1][t] + net.bias[:, 0] for t in range(len(data))])
    p = np.exp(logits)
    return p / p.sum(1, keepdims=True)


def test_reader(net):
    """Segments of all sizes read side by side, as each alone."""
    rnd = np.random.default_rng(2)
    texts = [bytes(rnd.integers(97, 123, n)).decode() for n in (0, 1, 2, 5, 127, 128, 129, 300, 1000, 0, 7)]
    got = language.read_texts(language.Reader(net), pa.array(texts))
    for t, p in zip(texts, got):
        data = t.encode()
        _, starts, sizes = language.segments_of(np.array([0, len(data)]))
        assert sizes.sum() == len(data) and (sizes <= language.SEGMENT).all()
        want = [plain_positions(net, data[s : s + n]) for s, n in zip(starts, sizes)]
        assert np.allclose(p, np.concatenate(want).mean(0) if data else 0, atol=1e-5)


def test_label_runs(spark, net, docs):
    rows = {(r.doc_id): r.text for r in docs.where("length(text) < 3000 and doc_id != 3 and doc_id != 20").collect()}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    runs = {}
    for r in language.label_runs(df, net).orderBy("doc_id", "start").collect():
        runs.setdefault(r.doc_id, []).append((r.start, r.end, r.lang))
    for i, text in rows.items():
        data = text.encode() if re.search(r"[^\W\d_]", text) else b""
        mine = runs.get(i, [])
        assert [a for a, _, _ in mine] == [0, *[b for _, b, _ in mine]][: len(mine)] and (mine[-1][1] if mine else 0) == len(data)
        assert all(x[2] != y[2] for x, y in zip(mine, mine[1:]))
        if 0 < len(data) < 128:
            assert [net.labels[k] for k in plain_positions(net, data).argmax(1)] == [lang for a, b, lang in mine for _ in range(a, b)]
    assert language.label_runs(df, language.initial([])).count() == 0


def test_predict(spark, net, docs):
    got = language.predict(docs, net, ["doc_id", "text", "score"], ("pred", "p")).collect()
    assert len(got) == docs.count()
    for r in got:
        known = bool(re.search(r"[^\W\d_]", r.text or ""))
        assert (r.pred != "und") == known and (0 < r.p <= 1 if known else r.p == 0) and r.score == 0.5
    assert len({(r.pred, r.p) for r in got if r.text == "One"}) == 1
    assert language.predict(docs.limit(0), net).count() == 0
    none = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}


def test_language_held_out(spark):
    """Accuracy on the fold that nothing was learned from, and on text of two languages."""
    df = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    net = language.fit(df.where(fold("doc_id", 4) != 2))
    held = [r for r in language.predict(df, net, ["doc_id", "lang"]).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    de, fr = (max(r.text for r in df.where(f"lang = '{x}' and length(text) < 3000").orderBy(F.desc("n_chars")).limit(1).collect()) for x in ("de", "fr"))
    both = spark.createDataFrame([(1, de + " " + fr)], "doc_id long, text string")
    share = {"de": 0, "fr": 0}
    for r in language.label_runs(both, net).collect():
        turn = len(de.encode())
        share["de"] += max(0, min(r.end, turn) - r.start) * (r.lang == "de")
        share["fr"] += max(0, r.end - max(r.start, turn)) * (r.lang == "fr")
    assert share["de"] > 0.8 * len(de.encode()) and share["fr"] > 0.8 * len(fr.encode())


@pytest.mark.parametrize("query, sql", [(fill_middle.op12_fill_middle, fill_middle.OP12_SQL), (filter_audit.op13_filter_audit, filter_audit.OP13_SQL)])
def test_sql(spark, query, sql):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = query(spark, SF)
    want = c.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


ARTICLE = [f"Paragraph {k} of the article, with commas, is long enough to count as prose, and goes on for a while." for k in range(4)]


@pytest.mark.parametrize("odd", ["<svg><path d=x>", "<select><option>one<option>two", "<math><mi>x", "<template>", "<noscript>", "<title>", "<textarea>", "<svg viewBox='0>1'><g>", "<iframe src=x>", "<svg/>",
                                 "<noscript>no<p>script</p></noscript>", "<template><p>a<template>b</template></p></template>", "<select><option>x</select>", "<svg><text>shape</text></svg>"])
@pytest.mark.parametrize("later", ["", "<svg><g/></svg>", "<noscript><p>Please switch it on.</p></noscript>", "<template>t</template>"])
def test_html_unclosed(odd, later):
    """What is never closed ends at the next block, whatever comes later; what is closed goes whole."""
    a, b, *rest = (f"<p>{x}</p>" for x in ARTICLE)
    page = f"<html><body><article>{a}{b}{odd}{''.join(rest)}</article>{later}</body></html>"
    assert html_text.main_text(page) == " ".join(ARTICLE)


@pytest.mark.parametrize("noise", ['<div class="alert alert-info">Mind, all readers, that this site, moves soon, to another place.</div>', '<section id="respond"><div class="response"><p>I think, as a reader, that this is, all in all, wrong.</p></div></section>',
                                   '<div class="snackbar"><p>Saved, for later, on this device, and others.</p></div>', '<ul class="responses"><li>A reader, says, at length, that it, is good.</li></ul>'])
def test_html_notices_and_comments(noise):
    page = f"<html><body><main>{''.join(f'<p>{x}</p>' for x in ARTICLE)}{noise}</main></body></html>"
    assert html_text.main_text(page) == " ".join(ARTICLE)


def test_html_references_end_at_tags(spark):
    text = "AT&<b>amp;</b>T and R&amp;D, &#x41;&copy, " + ARTICLE[0]
    assert html_text.main_text(f"<article><p>{text}</p></article>") == "AT&amp;T and R&D, A©, " + ARTICLE[0]
    df = spark.createDataFrame([(1, f"<p>{ARTICLE[0]}", 5, "old", "N")], "page_id long, html string, __html int, `Text` string, `N_CHARS` string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "__html", "text", "n_chars"] and out.first().text == ARTICLE[0]


def test_urls_clashing(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "x", "y", 3, "z")], "page_id long, url string, `Verdict` string, `RULE` string, `won` int, `a.b` string")
    out = url_rules.judge_urls(df, spark.createDataFrame(url_rules.RULES, url_rules.RULE_SCHEMA))
    assert sorted(out.columns) == sorted(["page_id", "url", "won", "a.b", "host", "path", "rule", "verdict"]) and out.first().rule == "net/"
    long = spark.createDataFrame([(1, "http://" + "a." * 500 + "net/" + "x" * 10_000)], "page_id long, url string")
    assert url_rules.judge_urls(long, spark.createDataFrame(url_rules.RULES, url_rules.RULE_SCHEMA)).first().rule == "net/"


def test_embeddings_of_all_lengths(spark):
    """Vectors of several lengths and code widths: each links with those of its own only."""
    rnd = np.random.default_rng(3)
    vectors = []
    for dim in (1, 3, 4, 48, 300, 9000):
        base = rnd.normal(size=(4, dim))
        vectors += [*base, base[0] * 2, base[1] + 0.01 * rnd.normal(size=dim)]
    df = spark.createDataFrame([(i, [float(x) for x in v], "a", 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, code string, node int")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, Scratch(spark, "t")).collect()}
    unit = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for v in vectors]
    want = {i: sum(len(u) == len(v) and u @ v >= 0.9 for j, v in enumerate(unit) if j != i) for i, u in enumerate(unit)}
    assert got == want


def test_overlaps_joined_and_local(spark, monkeypatch):
    """Joined hashes find what one index of all items finds, whichever side is sent, and with a table of bits that says yes to all."""
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(60)]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [words(rnd.choice([2, 4, 5, 7, 9, 12, 20, 40, 60])) for _ in range(30)] + [["ha"] * 30]
    texts = []
    for _ in range(80):
        w = words(rnd.randint(0, 60))
        for item in rnd.sample(items, rnd.randint(0, 3)):
            w += [x if rnd.random() > 0.12 else rnd.choice(vocab) for x in item] + words(rnd.randint(0, 20))
        texts.append(" ".join(w))
    texts += texts[:5] + ["ha " * 20_000, None, ""]
    index = decontaminate.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    h, first = word_hashes(pa.array(texts), decontaminate.ALNUM_SPLIT)
    want = [sorted(x) for x in index.overlaps(h, first)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")

    def found():
        got = {r.doc_id: sorted(tuple(o) for o in r.overlaps) for r in decontaminate.find_overlaps(docs, bench, ["doc_id"]).collect()}
        return [got[i] for i in range(len(texts))]

    assert sum(map(bool, want)) > 30 and found() == want
    monkeypatch.setattr(decontaminate, "SENT", 0)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(decontaminate, "BITS_A_SEED", 0)
    assert found() == want


def test_seed_recall():
    """Of passages with up to a fifth of their words replaced at random, at least nine in ten are found for every length of item."""
    rnd = random.Random(5)
    for n in (10, 12, 15, 20, 40):
        item = [f"i{k}" for k in range(n)]
        index, texts = decontaminate.Index([(1, " ".join(item))]), []
        for _ in range(300):
            lost = rnd.sample(range(n), rnd.randint(1, n // 5))
            texts.append(" ".join(f"z{rnd.random()}"[2:] if k in lost else x for k, x in enumerate(item)))
        h, first = word_hashes(pa.array(texts), decontaminate.ALNUM_SPLIT)
        assert sum(map(bool, index.overlaps(h, first))) >= 0.9 * 300


def _plain_fingerprint(text):
    w = text.lower().encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = np.array([xxh64_intdigest(x, 42) for x in shingles], np.uint64)
    return sum(1 << k for k in range(64) if len(h) and 2 * int((h >> np.uint64(k) & np.uint64(1)).sum()) > len(h))


def test_very_long_texts(spark):
    """Texts of 400,000 words, and of one word of two million letters, are taken whole by the operators that read tokens."""
    from tokenizers import Tokenizer

    import public_tokenizers
    from cairn.llm import lm_score, near_copies, packing, simhash, token_files

    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    long = " ".join(rnd.choice(vocab) for _ in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 2_000_000), (4, "short"), (5, None)], "doc_id long, text string")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    prints = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.classes(docs, Scratch(spark, "t")).collect()}
    assert prints == {i: _plain_fingerprint(t) for i, t in texts.items()}
    copies = {r.doc_id: r.component_id for r in near_copies.classes(docs, Scratch(spark, "t")).collect()}
    assert copies == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    scored = {r.doc_id: r for r in lm_score.score(docs, F.col("doc_id") == 2, Scratch(spark, "t")).collect()}
    assert [scored[i].n_tokens for i in (1, 2, 3, 4, 5)] == [400_001, 400_002, 2, 2, 1] and scored[1].train_tokens == 400_001 + 2 + 2 + 1
    assert scored[2].n_known == 400_001 and scored[2].score > scored[2].base_score
    want = {name: Tokenizer.from_file(public_tokenizers.path(name)).encode(long, add_special_tokens=False).ids for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}
    words = docs.where("doc_id in (1, 4, 5)")
    root = Scratch(spark, "t").path("files")
    files = Scratch(spark, "t").table(token_files.write_token_files(words, root), "m")
    got = {r.doc_id: r for r in token_files.read_token_files(files, root).collect()}
    assert got[1].ids_crc32 == zlib.crc32(np.array([*want["byte_bpe_50k.json"], 2], "<u4").tobytes()) and got[5].n_tokens == 1
    pieces = sorted((r.start, r.ids_crc32) for r in packing.pack_documents(words).where("doc_id = 1").collect())
    ids = np.array([*want["word_bpe_49k.json"], 0], "<u4")
    assert pieces == [(k, zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
