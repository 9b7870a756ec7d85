"""Overviews and documents step by step: what is done is not done again."""

import json

import pytest
from pyspark.sql import functions as F

from cairn.operators import notebook
from cairn.operators.notebook import Products, StepFailed


class Model:
    """Replies in turn; what was asked is counted in a file, since calls run in tasks."""

    def __init__(self, path, replies):
        self.path, self.replies = str(path), replies

    def asked(self):
        try:
            with open(self.path) as f:
                return f.read().split("\0")[:-1]
        except FileNotFoundError:
            return []

    def call(self):
        path, replies = self.path, self.replies

        def reply(prompt):
            try:
                with open(path) as f:
                    n = f.read().count("\0")
            except FileNotFoundError:
                n = 0
            with open(path, "a") as f:
                f.write(prompt + "\0")
            said = replies[min(n, len(replies) - 1)]
            if said is None:
                raise OSError("away")
            return said

        return reply


GOOD = 'Here it is: {"title": " T ", "overview": "All of it.", "keyTopics": ["a", " ", "b"], "suggestedQuestions": ["q?"]}'


def test_overview_goes_on(spark, tmp_path):
    chunks = spark.createDataFrame([(d, c, f"text {d}.{c} " + "x" * 900) for d in range(3) for c in range(30)], "doc_id long, chunk_idx int, text string")
    docs = spark.createDataFrame([(d, f"name{d}") for d in range(3)], "doc_id long, name string")
    store, model = Products(spark, str(tmp_path / "p")), Model(tmp_path / "asked", [None, "no json", GOOD])
    run = lambda revision=4: notebook.overview(store, chunks, docs, revision, model.call())
    with pytest.raises(StepFailed, match="reply"):
        run()
    with pytest.raises(StepFailed, match="parsed"):
        run()
    assert len(model.asked()) == 2 and model.asked()[0] == model.asked()[1]
    prompt = model.asked()[0]
    assert prompt.startswith("Documents (3):\n- name0\n- name1\n- name2\n\nSample passages:\n[name0] text 0.0 x") and prompt.endswith("x")
    assert prompt.count("[name") == 26 and len(prompt) < 17_000  # of 600 characters each, within the budget
    # a reply that was read but says nothing stays as it is; what it is made of has changed, so it is asked again
    got = json.loads(run(5))
    assert got == {"overview": {"title": "T", "overview": "All of it.", "topics": ["a", "b"], "questions": ["q?"]}, "made_of": {"docs": 3, "chunks": 90}}
    assert len(model.asked()) == 3 and json.loads(run(5)) == got and len(model.asked()) == 3
    assert json.loads(store.product("overview")) == got
    with pytest.raises(StepFailed, match="sample"):
        notebook.overview(store, chunks.limit(0), docs, 6, model.call())


@pytest.mark.parametrize("dies_at", ["context", "reply", "cited", "saved"])
def test_studio_goes_on_after_each_step(spark, tmp_path, monkeypatch, dies_at):
    nodes = spark.createDataFrame([(f"n{i}", f"Node {i}", "person", f"about {i}", [f"s{i}"], i) for i in range(35)], "id string, label string, type string, summary string, evidence array<string>, seq int")
    edges = spark.createDataFrame([("n1", "n2", "knows", ["s1"]), ("n1", "n3", "meets", []), ("n34", "n1", "x", None)], "src string, dst string, relation string, evidence array<string>")
    com = spark.createDataFrame([("c", 0, "Theme", "All", ["s2"])], "id string, seq int, title string, summary string, evidence array<string>")
    sentences = spark.createDataFrame([("s1", 1, "One."), ("s2", 2, "Two.")], "sentence_id string, doc_id long, text string")
    store, model = Products(spark, str(tmp_path / "p")), Model(tmp_path / "asked", [" It is so [[s1, fake]] and [[none]] so [[s2]]. "])
    run = lambda: notebook.studio(store, "faq", "Repo", nodes, edges, com, sentences, 7, model.call())
    put = Products.put

    def dying(self, product, made_of, step, value):
        if step == dies_at:
            raise RuntimeError("lost")
        return put(self, product, made_of, step, value)

    monkeypatch.setattr(Products, "put", dying)
    with pytest.raises(RuntimeError):
        run()
    monkeypatch.undo()
    got = json.loads(run())
    assert got["title"] == "FAQ — Repo" and got["markdown"] == "It is so [[s1]] and  so [[s2]]." and [c["sentence_id"] for c in got["citations"]] == ["s1", "s2"]
    assert len(model.asked()) == (2 if dies_at == "reply" else 1) and json.loads(store.product("faq")) == got
    prompt = model.asked()[-1]
    assert prompt.startswith("Themes:\n- Theme: All [[s2]]\n\nEntities:\n- Node 1 (person) about 1 [[s1]]\n") and "- Node 1 -[knows]-> Node 2 [[s1]]" in prompt
    assert prompt.count("(person)") == 30 and "Node 34" in prompt
    assert run() and len(model.asked()) == (2 if dies_at == "reply" else 1)
    with pytest.raises(StepFailed, match="context"):
        notebook.studio(store, "briefing", "Repo", nodes.limit(0), edges, None, sentences, 7, model.call())


def test_context_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, label string, type string, summary string, evidence array<string>, seq int")
    assert notebook.graph_context(empty, empty.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("label").alias("relation"), "evidence")) is None
