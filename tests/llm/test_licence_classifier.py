"""The licence classifier: what it decides alone, held-out accuracy, the unknown class, and the odds against a plain computation."""

import dataclasses
import math
import random

import pytest
from pyspark.sql import functions as F

from feedops.llm import licence

PROSE = "the river rises early in spring and towns along its banks keep boats ready while children walk to school over a wooden bridge and old people talk about years of high water".split()
STRANGE = ["This licence of the Harbour Board permits one boat and no more", "redistribution of seats follows the last count of the votes", "our free software evening takes place on Monday at the town library",
           "General public transport is free of charge for pupils", "the board will licence three more fishing boats this year", "source code form number seven is to be handed in at the desk"]


@pytest.fixture(scope="module")
def docs(spark):
    """Strange paragraphs with notice words, each as many times as the next."""
    draw = random.Random(3)
    texts = [" ".join(draw.sample(PROSE, 12)) + ".\n\n" + s + " " + " ".join(draw.sample(PROSE, 9)) for s in STRANGE for _ in range(30)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def model(docs):
    return licence.train(docs)


def notices(spark):
    """Every template with a word changed, between prose that the fit has not seen."""
    draw, rows = random.Random(11), []
    for family, texts in licence.TEMPLATES.items():
        for text in texts:
            words = text.split()
            if len(words) > 8:
                words[1] = "zzz"
            rows.append((len(rows), " ".join(draw.sample(PROSE, 15) + words + draw.sample(PROSE, 15)), family))
    return spark.createDataFrame(rows, "doc_id long, text string, wanted string")


def paragraphs(spark, docs, *keep):
    reach = licence._Templates(spark).reach
    return licence.paragraphs(docs, reach, *keep).select(*keep, F.explode("regions").alias("r")).select(*keep, F.col("r.grams").alias("grams"))


def test_classifier_alone_names_held_out_notices(spark, model):
    """The best family of a paragraph is the right one, before any template is compared."""
    found = paragraphs(spark, notices(spark), "doc_id", "wanted").select("wanted", model.probabilities(F.col("grams")).alias("p"), model.named(F.col("grams"))["family"].alias("named")).collect()
    best = [model.families[max(range(len(x.p)), key=lambda i: x.p[i])] == x.wanted for x in found]
    assert len(found) >= 21 and sum(best) >= 0.95 * len(best) and all(x.wanted in x.named for x in found)


def test_strange_paragraphs_are_unknown(spark, docs, model):
    named = paragraphs(spark, docs, "doc_id").where(F.size(model.named(F.col("grams"))) > 0)
    assert paragraphs(spark, docs, "doc_id").count() >= 180 and named.count() <= 9
    assert licence.licences(docs, model).isEmpty()


def test_classifier_decides_rows(spark, model):
    """A notice that fits a template goes if the classifier does not name its family."""
    rows = notices(spark)
    every = {x.doc_id: x.family for x in licence.licences(rows, model).collect()}
    assert every == {x.doc_id: x.wanted for x in rows.collect()}
    without = dataclasses.replace(model, cuts=tuple(2.0 if f == "mit" else c for f, c in zip(model.families, model.cuts)))
    assert {x.doc_id: x.family for x in licence.licences(rows, without).collect()} == {k: f for k, f in every.items() if f != "mit"}
    assert licence.licences(rows, dataclasses.replace(model, cuts=(2.0,) * len(model.families))).isEmpty()


def test_odds_equal_a_plain_computation(spark, model):
    for x in paragraphs(spark, notices(spark), "doc_id").select("grams", model.probabilities(F.col("grams")).alias("p")).collect():
        scores = [s + sum(w[i] for g, w in zip(model.vocabulary, model.weights) if g in set(x.grams)) for i, s in enumerate(model.start)]
        assert x.p == pytest.approx([1 / (1 + math.exp(scores[-1] - s)) for s in scores[:-1]], rel=1e-9)


def test_copies_count_once_among_the_unknown(spark, docs):
    """A text that fills a third of the rows is one unknown paragraph, and template notices are none."""
    copies = docs.limit(0).unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a licence for boats of " + " ".join(PROSE)).alias("text")))
    held = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    rows = licence.training_rows(docs.unionByName(copies).unionByName(held), 60).where("family = 'unknown'").where(F.size("grams") > 1)
    assert 1 < rows.count() <= 60
    assert rows.where(F.array_contains("grams", "for boats")).count() <= 1 and rows.where(F.array_contains("grams", "mit license")).isEmpty()
