"""Addresses, references, playbooks, windows, sources and sinks in their odd cases."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as TX
from cairn.functions import urls as U
from cairn.operators import assist, chunking, parsing
from cairn.sources import readers, repository, sinks
from cairn.sources.repository import Repository, hash_embedding


def said(spark, values, made):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", made(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_normalized(spark):
    urls = {"HTTP://User:Pw@Example.COM:80/A/../b/./c/?q#f": "http://User:Pw@example.com/b/c", "https://x.org:443": "https://x.org", "https://x.org:80/": "https://x.org:80", "http://x.org:443/a//": "http://x.org:443/a/",
            "  no url ": "no url", "ftp://Y:80/q/..": "ftp://y:80", "http://x/%2e%2E/a/.": "http://x/a", "http://x/a.b/..c": "http://x/a.b/..c"}
    assert dict(zip(urls, said(spark, list(urls), U.normalize_url))) == urls


def test_resolved(spark):
    base = "https://Host.org/dir/sub/index.json?x#y"
    files = {"a.md": "https://host.org/dir/sub/a.md", "./a.md": "https://host.org/dir/sub/a.md", "../b/../c.md?q=../x": "https://host.org/dir/c.md?q=../x", "/r.md": "https://host.org/r.md", "../../../../up.md": "https://host.org/up.md",
             "//other.org/x": "https://other.org/x", "http://z.org/y": "http://z.org/y", "": None}
    assert dict(zip(files, said(spark, list(files), lambda x: parsing.resolve_url(x, F.lit(base))))) == files
    assert said(spark, ["a.md", "http://z/y"], lambda x: parsing.resolve_url(x, F.lit("none"))) == [None, "http://z/y"]
    assert said(spark, ["a.md"], lambda x: parsing.resolve_url(x, F.lit("http://h"))) == ["http://h/a.md"]


GUID = "0123abcd-0000-1111-2222-333344445555"


def test_documents(spark):
    site = "https://t.example.com/sites/a"
    by_id = f"{site}/_api/web/GetFileById('{GUID}')/$value"
    urls = {
        "https://a.b/x.PDF?y": ("https://a.b/x.PDF?y", None), f"chrome-extension://{U.PDF_VIEWER}/index.html?a=1&src=https%3A%2F%2Fa.b%2Fq%3Fz": ("https://a.b/q?z", None),
        f"chrome-extension://{U.PDF_VIEWER}/index.html?src=chrome://x": (None, None), "chrome-extension://other/index.html?src=https://a.b/c": (None, None),
        "https://T.example.com/:w:/r/sites/a/My.docx?web=1": (None, "https://t.example.com/sites/a/My.docx"), "https://a.b/x.xlsx?d=1": (None, "https://a.b/x.xlsx?d=1"),
        f"{site}/_layouts/15/Doc.aspx?sourcedoc=%7B{GUID}%7D&x=1": (None, by_id), f"{site}/_layouts/15/WopiFrame.aspx?a&sourcedoc={GUID}": (None, by_id), f"{site}/_layouts/15/Doc.aspx?sourcedoc=abc": (None, None),
        f"https://word.example.com/edit?wopisrc={site.replace('/', '%2F').replace(':', '%3A')}%2F_vti_bin%2Fwopi.ashx%2Ffiles%2F{GUID}&y": (None, by_id), "https://a.b/page": (None, None), "no url.docx": (None, None),
    }
    got = said(spark, list(urls), lambda x: F.struct(U.pdf_url(x), U.office_url(x)))
    assert {u: tuple(r) for u, r in zip(urls, got)} == urls
    assert said(spark, list(urls)[:6], U.document_kind) == ["pdf", "pdf", None, None, "office", "office"]


def test_references(spark):
    texts = {"a&#65;&#228;&#8364;&#128512;b": "aAä€\U0001f600b", "&#0;&#55296;&#9999999;&#99999999;x": "\ufffd\ufffd\ufffd x", "&lt;b&gt; &AMP;lt; &hellip;y": "<b> &lt; y", "<p>a</p><blockquote>q</blockquote>&apos;": "a\nq\n'"}
    assert dict(zip(texts, said(spark, list(texts), lambda x: TX.strip_html(x, "", numbered=True)))) == texts
    assert said(spark, ["<b>a</b>&#39;&apos;&#65;"], lambda x: TX.strip_html(x, "")) == ["a''&#65;"]


def test_playbook(spark):
    events = spark.createDataFrame([("r", i, f"line {i // 2}", f"s{i // 2}", "u1" if i < 4 else "u2", "" if i < 4 else "Two", "h") for i in range(6)],
                                   "recording string, seq int, line string, signature string, page_url string, page_title string, page_host string")
    recs = spark.createDataFrame([("r", "a.b.org", "Title"), ("e", "x", None)], "recording string, host string, title string")
    got = {r.recording: r for r in parsing.learned_playbook(events, recs).collect()}
    assert got["r"].name == "learn-a-b-org" and got["r"].description == "Recorded workflow for a.b.org"
    assert got["r"].body.startswith("# Recorded workflow for a.b.org\n\nRecorded from Title.\n\n## Flow\n1. line 0 (h)\n2. line 1\n3. line 2 (Two)\n\n## Notes\n- ")
    assert "Recorded from x.\n\n## Flow\n1. No interactions were captured.\n\n" in got["e"].body


def test_capabilities_and_skills(spark):
    sites = spark.createDataFrame([(1, "a", "d", "u", "http://m", "tok", "s"), (2, "b", None, "", None, "", None)], "id int, name string, description string, url string, mcp_url string, mcp_token string, search_url string")
    got = {r.name: r for r in parsing.capabilities_of_sites(sites, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert (got["a"].kind, got["a"].auth_method, got["a"].auth_token, got["a"].tags) == ("mcp", "token", "tok", ["mcp"])
    assert (got["b"].kind, got["b"].auth_method, got["b"].url, got["b"].tags) == ("bookmark", "browser-session", None, [])
    skills = spark.createDataFrame([("Read", "first", 0), ("read", "second", 1)], "name string, body string, seq int")
    found = {r.name: r.skill and r.skill.body for r in assist.find_skill(skills, spark.createDataFrame([("READ",), ("none",)], "name string")).collect()}
    assert found == {"READ": "first", "none": None}
    assert said(spark, ["see #repo-1 now #x", "a#b", ""], assist.repo_mention) == ["repo-1", None, None]


def test_windows(spark):
    rnd = random.Random(2)
    rows = [(d, c, s, "x" * rnd.randint(1, 40), f"{d}:{c}:{s}") for d in range(3) for c in range(30) for s in range(rnd.randint(0, 5))]
    df = spark.createDataFrame(rows, "doc_id long, chunk_idx int, sentence_idx int, text string, sentence_id string")

    def plain(gap, budget):
        out, state = {}, {}
        for d, c, s, t, _ in sorted(rows):
            w, used = state.get(d, (0, 0))
            if used and used + gap + len(t) > budget:
                w, used = w + 1, 0
            start = used + gap if used else 0
            state[d] = w, start + len(t)
            out[d, c, s] = w, start
        return out

    got = {(r.doc_id, r.chunk_idx, r.sentence_idx): r.window_idx for r in chunking.pack_windows(df, 90).collect()}
    assert got == {k: w for k, (w, _) in plain(0, 90).items()}
    every = {(r.doc_id, r.chunk_idx, r.sentence_idx): (r.window_idx, r.start) for r in chunking.recogniser_windows(df, 90).collect()}
    assert every == plain(1, 90)
    some = chunking.recogniser_windows(df, 90, 5).collect()
    for d in range(3):
        n = 1 + max(w for (x, _, _), (w, _) in every.items() if x == d)
        assert {r.window_idx for r in some if r.doc_id == d} == set(chunking.evenly(n, 5))
    assert all(r.end - r.start == len(next(t for *_, t, i in rows if i == r.sentence_id)) for r in some)
    w = spark.createDataFrame([("[[a]] One.\n[[b]] Two.", 7), ("", 0)], "text string, n int")
    assert [tuple(r)[2:] for r in assist.window_preview(w).collect()] == [(21, 2), (0, 0)]


def test_sources(spark, tmp_path):
    schema = "a long, b string"
    (tmp_path / "j").mkdir()
    for name, body in (("good", '{"a": 1, "b": "x"}'), ("bad", "{nope"), ("empty", "")):
        (tmp_path / "j" / name).write_text(body)
    read = lambda name, *more: tuple(readers.json_file(spark, f"{tmp_path}/j/{name}", schema, *more).first() or ())
    assert read("good", '{"a": 5}') == (1, "x") and read("bad", '{"a": 5}') == (5, None) and read("missing", '{"a": 5}') == (5, None) and read("bad") == read("missing") == (None, None)
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "sub" / "x.md").write_text("hi")
    (tmp_path / "d" / "y.zzz").write_text("hi")
    assert [r.path for r in readers.directory(spark, str(tmp_path / "d")).collect()] == ["sub/x.md"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, "line\nbreak"), (3, None)], "n int, t string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert text == b'n,t\r\n1,"a ""q"", b"\r\n2,"line\nbreak"\r\n3,\r\n'
    packed = spark.createDataFrame([(1, [0, 1, -1, 127, -128]), (2, []), (3, None)], "id int, q array<tinyint>")
    sinks.backup(packed, str(tmp_path / "bk"))
    assert spark.read.json(str(tmp_path / "bk")).where("id = 1").first().q == "AAH/f4A="
    assert sorted(map(tuple, sinks.restore(spark, str(tmp_path / "bk"), packed.schema).collect())) == [(1, [0, 1, -1, 127, -128]), (2, []), (3, None)]


def test_all_repositories(spark, tmp_path):
    embed = hash_embedding(4)
    docs = lambda t: spark.createDataFrame([(1, "a", "u", t)], "doc_id long, name string, url string, text string")
    for name in ("one", "two"):
        Repository(spark, f"{tmp_path}/a", name).add(docs(f"text of {name}. More!"), embed)
    Repository(spark, f"{tmp_path}/b", "two").add(docs("old"), embed)
    Repository(spark, f"{tmp_path}/b", "three").add(docs("stays"), embed)
    assert repository.export_all(spark, f"{tmp_path}/a", f"{tmp_path}/out") == ["one", "two"]
    assert repository.import_all(spark, f"{tmp_path}/b", f"{tmp_path}/out") == ["one", "two"]
    assert {n: Repository(spark, f"{tmp_path}/b", n).chunks().first().text for n in ("one", "two", "three")} == {"one": "text of one. More!", "two": "text of two. More!", "three": "stays"}
    chunks = Repository(spark, f"{tmp_path}/b", "one").chunks().select("doc_id", "chunk_idx", "text")
    made = repository.attached(chunks).first()
    assert made.chunk_id == "1:c0" and [s.text for s in made.sentences] == ["text of one.", "More!"]
    assert [s.sentence_id for s in made.sentences] == [r.sentence_id for r in Repository(spark, f"{tmp_path}/b", "one").sentences().orderBy("sentence_idx").collect()]
    again = repository.attached(repository.attached(chunks)).first()
    assert again.sentences == made.sentences


@pytest.mark.parametrize("k", [1, 3, 10])
def test_rerank(spark, k):
    hits = spark.createDataFrame([(i, i + 1) for i in range(6)], "item int, rank int")
    order = spark.createDataFrame([(4, 0), (9, 1), (2, 2), (4, 3)], "item int, pos int")
    assert [r.item for r in assist.rerank(hits, order, k).orderBy("new_rank").collect()] == [4, 2, 0, 1, 3, 5][:k]


def test_index_buckets_and_merging(spark, tmp_path, monkeypatch):
    """Segments of different numbers of buckets, merged or not, rank like one index of all chunks."""
    from cairn.operators import keyword_index
    from cairn.operators.keyword_index import KeywordIndex

    assert [keyword_index.buckets_for(n) for n in (0, 1 << 29, 1 << 30, 1 << 40)] == [16, 32, 64, 65536]
    rnd = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(["alpha", "beta", "gamma", f"w{i}"]) for _ in range(rnd.randint(0, 30)))) for i in range(60)], "id long, text string")
    ranks = lambda x: {r.item: round(r.score, 9) for r in x.search("alpha w7 gamma none").collect()}
    whole = KeywordIndex(spark, str(tmp_path / "whole")).build(docs, "id", "text")
    monkeypatch.setattr(keyword_index, "BUCKET_BYTES", 100)
    monkeypatch.setattr(keyword_index, "BUCKETS", (2, 64))
    grown = KeywordIndex(spark, str(tmp_path / "grown"))
    for a, b in ((0, 2), (2, 30), (30, 60)):
        grown.extend(docs.where(f"id >= {a} and id < {b}"), "id", "text")
    assert len({s["buckets"] for s in grown.segments()}) > 1 and ranks(grown) == ranks(whole)
    assert len(grown.merge().segments()) == 1 and ranks(grown) == ranks(whole)
    monkeypatch.setattr(keyword_index, "MANY", 2)
    for a in range(60, 64):
        grown.extend(spark.createDataFrame([(a, "alpha delta")], "id long, text string"), "id", "text")
    assert len(grown.segments()) <= 3 and grown.search("delta").count() == 4
    assert sorted(map(tuple, grown.statistics().where("term = 'delta'").collect())) == [("delta", 4, 4)]


def test_index_shares(spark, tmp_path, monkeypatch):
    """A term that every text holds is written by several tasks; what is stored is counted without a shuffle of items by buckets; equal texts tie."""
    from cairn.operators import keyword_index
    from cairn.operators.keyword_index import KeywordIndex

    assert [keyword_index.shares_for(*x) for x in ((0, 0, 16), (1 << 30, 500_000, 64), (6 << 30, 3_000_000, 256))] == [1, 2, 12]
    docs = spark.createDataFrame([(i, f"every w{i % 3} w{i % 7} x{i % 2}") for i in range(84)] + [(84, None)], "id long, text string")
    whole = KeywordIndex(spark, str(tmp_path / "whole")).build(docs, "id", "text")
    monkeypatch.setattr(keyword_index, "SHARE_ITEMS", 10)
    dealt = KeywordIndex(spark, str(tmp_path / "dealt")).build(docs, "id", "text")
    files = lambda x: {r.name for r in x.postings(["every"]).select(F.input_file_name().alias("name")).distinct().collect()}
    assert len(files(whole)) == 1 and len(files(dealt)) > 3
    assert [(s["n"], s["tokens"]) for s in dealt.segments()] == [(85, 336)]
    got = {r.item: r.score for r in dealt.search("every w1 w2 x0 x1").collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {r.item: round(r.score, 9) for r in whole.search("every w1 w2 x0 x1").collect()}
    assert all(got[i] == got[i + 42] for i in range(42))
    assert len(dealt.merge().segments()) == 1 and len(files(dealt)) > 3


def test_truncated(spark):
    texts = {'{"a": [1, 2]}': False, '{"a": [1, 2': True, '{"a": "b': True, '{"a": "}"}': False, '{"a": "\\"}': True, '{"a": "\\\\"}': False, "": False, "plain": False, '"' + "x" * 200_000 + '"': False, '["' + "\\n" * 100_000: True}
    assert dict(zip(texts, said(spark, list(texts), assist.looks_truncated))) == texts
