"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: accents and homoglyphs of either case to plain letters, digits and signs that
stand for letters in a word likewise; invisible characters go, numbers and all else become spaces. The lexicon holds words and word beginnings that mark toxic
documents among labelled ones, weighted by their log odds, beside a few common insults for where
labels are too few to say. Matches inside exception phrases do not count. The sum of the weights, as
such and over the length, gives the score by a logistic curve fitted on other labelled documents than
the lexicon comes from.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import fit_logistic, fold, logits, sample_ids
from .scratch import fresh
from .wordvec import split_batches

SAMPLE = 30_000
THRESHOLD = 0.3
#: Lexicon entries, at most (the strongest), and the least weight of one. They bound the model, as the
#: sample of labelled rows does; every text is matched whole against all of them.
ENTRIES, LEAST_WEIGHT = 5_000, 2.0
#: Letters of a learned word: shorter ones say too little, longer ones are no words.
WORD_LETTERS = (3, 39)
#: Share of the toxic training texts that must hold a pattern, and texts at least.
SUPPORT, SUPPORT_TEXTS = 0.004, 3
PREFIXES = (4, 5, 6)
#: words that count where the labels have nothing on them
INSULTS = "idiot moron stupid scum loser worthless pathetic disgusting imbecile bastard asshole bitch retard slut whore".split()
INSULT_WEIGHT = 3.0
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "rodeo clown", "pond scum", "sore loser", "bitch of the litter")
#: letters that look like Latin ones, and the letters that they stand for
HOMOGLYPHS = (
    "аАαΑɑ", "a", "вВβΒ", "b", "сСϲ", "c", "ԁđĐ", "d", "еЕєЄεΕ", "e", "ɡ", "g", "нНΗһħĦ", "h", "іІїιΙı", "i", "јЈ", "j",
    "кКκΚ", "k", "ӏłŁ", "l", "мМΜ", "m", "ոΝ", "n", "оОοΟσøØ", "o", "рРρΡ", "p", "ԛ", "q", "г", "r", "ѕЅ", "s",
    "тТτΤŧŦ", "t", "υμ", "u", "νѵ", "v", "ԝω", "w", "хХχΧ", "x", "уУγΥ", "y", "ΖᴢᏃ", "z",
)
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
#: runs of signs, which are letters beside a letter; an exclamation mark between letters; words of single letters parted by signs, and what they all hold
_SIGNS = re.compile(r"[@$]+")
_BANG = re.compile(r"!(?<=[^\W\d_]!)(?=[^\W\d_])")
_PARTED = re.compile(r"(?<![^\W_])[^\W_](?:[.\-_*][^\W_]){2,}(?![^\W_])")
_PARTED_HINT = re.compile(r"[.\-_*][^\W_][.\-_*]")
_SIGN_LETTERS = str.maketrans("@$", "as")
_NO_SIGNS = dict.fromkeys(map(ord, ".-_*"))
_NUMBER = re.compile(r"(?<![^\W_])\d[\d.,:]*(?![^\W_])")


class _Fold(dict):
    """Code point to its folded text, made on first use."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        made = "".join(self.get(ord(x), x) for x in base) if base != c else base
        if not made.isalpha():
            made = "" if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else " "
        self[code] = made
        return made


_FOLD = _Fold({ord(c): to for chars, to in zip(HOMOGLYPHS[::2], HOMOGLYPHS[1::2]) for c in chars})
_FOLD.update({ord(c): to for c, to in DIGITS.items()})


def _letters(m: re.Match) -> str:
    text, a, b = m.string, m.start(), m.end()
    beside = a and text[a - 1].isalpha() or b < len(text) and text[b].isalpha()
    return m[0].translate(_SIGN_LETTERS) if beside else m[0]


def folded(text: str | None) -> str:
    """Lower-case words between single or repeated spaces, with a space at either end."""
    if not text:
        return " "
    if "@" in text or "$" in text:
        text = _SIGNS.sub(_letters, text)
    if "!" in text:
        text = _BANG.sub("i", text)
    if _PARTED_HINT.search(text):
        text = _PARTED.sub(lambda m: m[0] if m[0].translate(_NO_SIGNS).isdigit() else m[0].translate(_NO_SIGNS), text)
    return f" {_NUMBER.sub(' ', text).translate(_FOLD)} "


def patterns(text: str) -> set[str]:
    """The words of a folded text and their beginnings, as patterns."""
    words = set(text.split())
    out = {f" {w} " for w in words if WORD_LETTERS[0] <= len(w) <= WORD_LETTERS[1]}
    for n in PREFIXES:
        out |= {f" {w[:n]}" for w in words if len(w) > n}
    return out


_NONE = (0.0, "")


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions=EXCEPTIONS):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for p, w in lexicon.items():
            self.machine.add_word(p, (len(p), w))
        for p in exceptions:
            p = " " + " ".join(folded(p).split()) + " "
            self.machine.add_word(p, (len(p), 0.0 if p not in lexicon else lexicon[p]) if p in lexicon else (len(p), None))
        self.any = len(self.machine) > 0
        if self.any:
            self.machine.make_automaton()

    def measure(self, text: str) -> tuple[float, int, float, int]:
        """Sum of weights, number of distinct patterns, largest weight and number of words of a folded text."""
        best: dict[int, tuple[float, str]] = {}
        masked: list[tuple[int, int]] = []
        if self.any:
            for end, (n, w) in self.machine.iter(text):
                start = end - n + 1
                if w is None:
                    masked.append((start, end))
                elif w > best.get(start, _NONE)[0]:
                    best[start] = w, text[start : end + 1]
        for a, b in masked:
            for s in [s for s in best if a <= s <= b - 1]:
                del best[s]
        often = Counter(best.values())  # a pattern counts twice at most: repetition alone is not abuse
        total = sum(w * min(n, 2) for (w, _), n in often.items())
        return total, len(often), max((w for w, _ in often), default=0.0), len(text.split())


def _features(measured: list[tuple[float, int, float, int]]) -> np.ndarray:
    m = np.array(measured, float).reshape(-1, 4)
    total, words = m[:, 0], np.maximum(m[:, 3], 1)
    return np.column_stack([np.log1p(total), np.log1p(100 * total / words), np.minimum(m[:, 1], 4), m[:, 2]])


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Weights of patterns from (target, text): log odds of a document's having it, toxic against clean."""
    spark = train.sparkSession

    def per_class(wanted):
        def run(batches):
            seen: Counter = Counter()
            texts = 0
            for b in split_batches(batches, 0):
                for t in b.column(0).to_pylist():
                    p = patterns(folded(t))
                    seen.update(p if wanted is None else p & wanted.value)
                    texts += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(["", *seen], pa.string()), pa.array([texts, *seen.values()], pa.int64())], names=["pattern", "n"]
            )

        return run

    toxic = train.where("target = 1").select("text").distinct()
    clean = train.where("target = 0").select("text").distinct()
    counts = toxic.mapInArrow(per_class(None), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    n_toxic = counts.where("pattern = ''").select("n").first()
    n_toxic = n_toxic.n if n_toxic else 0
    enough = max(SUPPORT_TEXTS, SUPPORT * n_toxic)
    # of a bounded sample, and only what is frequent in it
    found = {r.pattern: r.n for r in counts.where((F.col("pattern") != "") & (F.col("n") >= enough)).collect()}
    wanted = spark.sparkContext.broadcast(frozenset(found) | {f" {w} " for w in INSULTS})
    counts = clean.mapInArrow(per_class(wanted), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    against = {r.pattern: r.n for r in counts.collect()}
    n_clean = against.get("", 0)
    weight = {
        p: float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((against.get(p, 0) + 0.5) / (n_clean + 1))) for p, n in found.items()
    }
    # a pattern that only comes with a stronger shorter one adds nothing
    chosen = sorted((p for p, w in weight.items() if w >= LEAST_WEIGHT), key=lambda p: (-weight[p] * np.log(found[p]), p))
    lexicon = {p: weight[p] for p in chosen[:ENTRIES]}
    for w in INSULTS:
        if f" {w} " not in found and not against.get(f" {w} "):
            lexicon[f" {w} "] = INSULT_WEIGHT
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Lexicon and curve from at most ``sample`` labelled documents; every fourth fits the curve.

    The lexicon has at most ENTRIES patterns, of words of WORD_LETTERS letters, each in SUPPORT of the toxic
    texts. Rows with null ids, labels or texts teach nothing; without labels the common insults are left.
    """
    ids = sample_ids(labels, "toxic", sample).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = rows.join(F.broadcast(ids), "doc_id").select("target", "part", "text").where("text is not null")
    lexicon = learn_lexicon(train.where("part > 0"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches):
        match = Matcher(shared.value)
        for b in split_batches(batches, 1):
            m = [match.measure(folded(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([list(map(float, x)) for x in m], pa.list_(pa.float64()))], names=["target", "m"]
            )

    got = train.where("part = 0").select("target", "text").mapInArrow(run, "target int, m array<double>").toArrow()
    y = got.column("target").to_numpy().astype(float)
    x = _features([tuple(v) for v in got.column("m").to_pylist()])
    # a few made rows hold the curve where labels are few: none of the lexicon is clean, three strong words are not
    x = np.concatenate([x, _features([(0.0, 0, 0.0, 100)] * 4 + [(12.0, 3, 5.0, 100)] * 2)])
    y = np.concatenate([y, [0.0] * 4 + [1.0] * 2])
    return shared, fit_logistic(x, y, ridge=0.3)


def score(
    docs: DataFrame, model, threshold: float = THRESHOLD, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """Add score (0 to 1) and predicted (0 or 1), by these ``names``, to the columns ``keep`` (default doc_id).

    Null and empty texts score as texts without matches; very long ones are matched whole. Every row is
    scored alone, so ties and repeated rows get equal scores. An empty table gives no rows.
    """
    shared, curve = model
    keep = keep or ["doc_id"]
    n = len(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(fresh("text", keep)))
    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema.add(names[0], "double").add(names[1], "integer")

    def run(batches):
        match = Matcher(shared.value)
        for b in split_batches(batches, n):
            m = [match.measure(folded(t)) for t in b.column(n).to_pylist()]
            s = 1 / (1 + np.exp(-np.clip(logits(_features(m), curve), -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, *names]
            )

    return rows.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; learns from labelled rows outside fold 2 of 4."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(fold("doc_id", 4) != 2))
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
