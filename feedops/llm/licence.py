"""Licence scan: a trained classifier over sparse word n-grams names the licence families of a paragraph, with a calibrated unknown class; templates confirm.

A paragraph is a run of words around a word that makes a notice, wherever it begins and however its lines are wrapped. A multinomial logistic regression over the words and word
pairs of the templates scores it. A family is named if its odds against unknown reach the family's cut: the one that keeps nearly all held-out notices of that family. Where no family
reaches its cut the paragraph is unknown and goes no further. Several families may be named, as some texts offer a choice.

Only templates of named families are then compared. A notice is a window of words of the paragraph about as long as a template; only a blank line (or one of comment marks) ends it. It
is confirmed if it holds enough of the template: a changed word is tolerated, the name of the licence is not. Of windows of one family that overlap or begin on one line the best
counts, so every family and every notice of a text is reported.

The fit sees the templates (whole, shortened, and inside paragraphs of the corpus) and, as unknown, distinct paragraphs of the corpus that pass the same test for notice words but hold
enough of no template: what the classifier has to tell apart when it judges. Their number is bounded by ``UNKNOWN_ROWS``, a documented parameter; every text is searched whole.

Only DataFrame functions and Spark's own estimators; no code of ours runs on the executors. Results by case: null and empty texts have no paragraph and no licence; a
notice is named by the line on which it begins, from 0; repeated rows are judged each; an empty table gives no rows; ids may be null; further columns are not read; a corpus without
unknown paragraphs leaves single words of the templates as the unknown class.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedops.llm.registry import Tables, query
from feedops.llm.urlfilter import ascii_lower
from feedops.session import pinned

# Notices by which texts name their licence, by family.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
             "This work is licensed under the GNU Affero General Public License, version 3."),
    "apache": ("Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Released under the BSD 3-Clause License."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.",),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "Licensed under the MIT License."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "This work is dedicated to the public domain under CC0 1.0 Universal."),
}
# A template that holds one of these names is only found with a name of its family, and without the words that make it another licence.
NAMES: Mapping[str, tuple[str, ...]] = {
    "agpl": ("affero general",), "apache": ("apache license",), "bsd": ("bsd",), "cc-by": ("cc by", "commons attribution"), "cc-by-nc": ("by nc", "attribution noncommercial"),
    "cc-by-sa": ("by sa", "attribution sharealike"), "gpl": ("gnu general",), "lgpl": ("lesser general",), "mit": ("mit license",), "mpl": ("mozilla public",), "public-domain": ("public domain", "cc0"),
}
_NC, _SA, _ND = ("nc", "noncommercial"), ("sa", "sharealike"), ("nd", "noderivs", "noderivatives")
OTHERS: Mapping[str, tuple[str, ...]] = {"cc-by": (*_NC, *_SA, *_ND), "cc-by-nc": (*_SA, *_ND), "cc-by-sa": (*_NC, *_ND)}
# A text has a notice only if it holds one of these words, with anything between them but words; every template does.
NEEDED = (r"(?i)licen[sc]e|redistribut|unencumbered|public domain|permission is hereby|creative commons|free software|general public|modify it under"
          r"|compliance with|binary forms|following conditions|free of charge|associated documentation|source code form").replace(" ", "[^a-z0-9]+")
BLANK = r"^[\s#*/;%!-]*$"
UNKNOWN = "unknown"
# A window holds so much of its template, or lacks what one changed word takes away: itself and a pair on either side.
CONTAINED, CHANGED = 0.8, 3
# Windows begin in cells of so many words.
CELL = 64
UNKNOWN_ROWS = 2000
# So many of the unknown paragraphs also surround the templates in the fit.
AROUND = 24
WORD = r"[^a-z0-9.]+"
# The share of a family's held-out notices that its cut keeps.
KEPT = 0.99


def tokens(text: Column) -> Column:
    """Lower-cased words, without the full stops around them."""
    parts = F.split(F.regexp_replace(F.regexp_replace(ascii_lower(text), "licenc", "licens"), r"\.+(?=[^a-z0-9]|$)", " "), WORD)
    return F.filter(parts, lambda w: w != "")


def grams(words: Column) -> Column:
    """Words and pairs of neighbouring words."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def _held(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """``keep`` and the column ``name``, behind a generator: the planner would move it into the lambdas that use it, once per element."""
    return df.select(*keep, F.inline(F.array(F.struct(value.alias(name)))))


def _longest(words: Column) -> Column:
    """Words a window of a template may have: some may have been put in."""
    return F.size(words) + 2 + F.floor(F.size(words) / 8).cast("int")


def _enough(wanted: Column, grams_: Column, t: Column) -> Column:
    missing = F.size(wanted) - F.size(F.array_intersect(wanted, grams_))
    named = (F.size(t["names"]) == 0) | F.arrays_overlap(t["names"], grams_)
    return ((missing <= CHANGED) | (missing <= (1 - CONTAINED) * F.size(wanted))) & named


def _windows(x: Column) -> Column:
    """The windows of a region that hold enough of a template: they begin and end with words of it."""
    t, size = x["t"], F.size(x["words"])
    at = F.filter(F.sequence(F.lit(1), F.least(F.lit(CELL), size)), lambda p: F.array_contains(t["words"], F.get(x["words"], p - 1)))
    lengths = F.sequence(F.greatest(F.size(t["words"]) - 1, F.lit(1)), _longest(t["words"]))

    def window(p: Column, n: Column) -> Column:
        words = F.slice(x["words"], p, n)
        return F.struct(p.alias("p"), n.alias("n"), words.alias("words"), grams(words).alias("grams"))

    fits = F.flatten(F.transform(at, lambda p: F.transform(F.filter(lengths, lambda n: (p + n - 1 <= size) & F.array_contains(t["words"], F.get(x["words"], p + n - 2))), lambda n: window(p, n))))
    good = F.filter(fits, lambda w: ~F.array_contains(w["words"], "\n") & _enough(t["grams"], w["grams"], t) & ~F.arrays_overlap(t["others"], F.slice(x["words"], w["p"], w["n"] + 2)))

    def result(w: Column) -> Column:
        share = F.size(F.array_intersect(t["grams"], w["grams"])) / F.size(t["grams"])
        return F.struct((-share).alias("order"), w["n"].alias("size"), (x["at"] + w["p"]).alias("begin"), t["family"].alias("family"), F.get(x["lines"], w["p"] - 1).alias("line"), x["probability"].alias("probability"))

    return F.transform(good, result)


def paragraphs(docs: DataFrame, reach: int, *keep: str) -> DataFrame:
    """(keep, regions): the paragraphs of every text that hold a word which makes a notice; struct(at, words, lines, grams), one per cell of words and ``reach`` long."""
    some = docs.where(F.col("text").rlike(NEEDED))
    # Words with the number of their line; a blank line is a word of its own, which no window may hold.
    line = lambda content, i: F.transform(F.when(content.rlike(BLANK), F.array(F.lit("\n"))).otherwise(tokens(content)), lambda w: F.struct(w.alias("w"), i.alias("line")))
    worded = _held(some, "all", F.flatten(F.transform(F.split("text", "\n", -1), line)), *keep).where(F.size("all") > 0)

    def region(c: Column) -> Column:
        part = F.slice(F.col("all"), c + 1, reach)
        return F.struct(c.alias("at"), part["w"].alias("words"), part["line"].alias("lines"))

    near = F.filter(F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(CELL)), region), lambda r: F.concat_ws(" ", r["words"]).rlike(NEEDED))
    regions = _held(worded, "regions", near, *keep).where(F.size("regions") > 0)
    return _held(regions, "regions", F.transform("regions", lambda r: F.struct(r["at"], r["words"], r["lines"], F.array_distinct(grams(r["words"])).alias("grams"))), *keep)


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, content string").withColumn("words", tokens(F.col("content"))).withColumn("grams", F.array_distinct(grams(F.col("words"))))


def _array(values, type_: str = "string") -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{type_}>")


class _Templates:
    """All templates as one literal array, and how long a paragraph must be to hold the longest of them wherever it begins."""

    def __init__(self, spark: SparkSession) -> None:
        self.rows = _templates(spark).collect()  # as many as there are
        self.each = F.array(*[F.struct(F.lit(r["family"]).alias("family"), _array(r["words"]).alias("words"), _array(r["grams"]).alias("grams"),
                                       _array([n for n in NAMES[r["family"]] if set(NAMES[r["family"]]) & set(r["grams"])]).alias("names"), _array(OTHERS.get(r["family"], ())).alias("others")) for r in self.rows])
        self.reach = CELL + max(len(r["words"]) for r in self.rows) * 9 // 8 + 2


def training_rows(docs: DataFrame, unknown_rows: int = UNKNOWN_ROWS) -> DataFrame:
    """(family, grams, fold): variants of the templates, alone and inside corpus paragraphs, and a bounded number of corpus paragraphs that fit no template, as unknown."""
    spark, known = docs.sparkSession, _Templates(docs.sparkSession)
    # So many different texts with a notice word, by hash, then so many of their different paragraphs: copies of one text count once.
    key = F.xxhash64("text")
    texts = docs.where(F.col("text").rlike(NEEDED)).select(key.alias("_key")).distinct().orderBy("_key").limit(unknown_rows)
    chosen = docs.select("text", key.alias("_key")).join(F.broadcast(pinned(texts)), "_key", "left_semi").dropDuplicates(["_key"])
    strange = paragraphs(chosen, known.reach, "_key").select(F.explode("regions").alias("r")).where(~F.exists(known.each, lambda t: _enough(t["grams"], F.col("r.grams"), t)))
    strange = strange.groupBy(F.xxhash64("r.words").alias("_hash")).agg(F.min("r.words").alias("words"))
    unknown = pinned(strange.orderBy("_hash").limit(unknown_rows))

    templates = _templates(spark).select("family", "words")
    cut = templates.select("family", "words", F.explode(F.array(*[F.struct(F.lit(a).alias("front"), F.lit(b).alias("back")) for a in range(3) for b in range(3)])).alias("c"))
    short = cut.where(F.size("words") > F.col("c.front") + F.col("c.back") + 2).select("family", F.slice("words", F.col("c.front") + 1, F.size("words") - F.col("c.front") - F.col("c.back")).alias("words"))
    # A template in the middle of a strange paragraph; another place of its hash, so that those around are not the same for all folds.
    around = unknown.orderBy(F.xxhash64("_hash")).limit(AROUND).select("words", F.explode(known.each).alias("t"))
    half = F.floor(F.size("words") / 2).cast("int")
    inside = around.select("t.family", F.concat(F.slice("words", F.lit(1), half), F.col("t.words"), F.slice("words", half + 1, F.size("words"))).alias("words"))
    loose = templates.select(F.lit(UNKNOWN).alias("family"), F.explode("words").alias("w")).select("family", F.array("w").alias("words")).distinct()
    every = short.unionByName(inside).unionByName(unknown.select(F.lit(UNKNOWN).alias("family"), "words")).unionByName(loose)
    return every.select("family", F.array_distinct(grams(F.col("words"))).alias("grams"), F.pmod(F.xxhash64("words"), F.lit(5)).alias("fold"))


@dataclass(frozen=True)
class LicenceModel:
    """The fitted regression (per n-gram the weights of all families, unknown last) and the probability that each family needs."""

    families: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    start: tuple[float, ...]
    cuts: tuple[float, ...]

    def probabilities(self, found: Column) -> Column:
        """Per family the probability that distinct n-grams are of it rather than unknown. Words of the vocabulary hold only letters, digits, full stops and blanks."""
        numbers = lambda values: "array(" + ", ".join(f"{v!r}D" for v in values) + ")"
        table = F.expr("map(" + ", ".join(f"'{g}', {numbers(w)}" for g, w in zip(self.vocabulary, self.weights)) + ")")
        words = F.expr("array(" + ", ".join(f"'{g}'" for g in self.vocabulary) + ")")
        scores = F.aggregate(F.array_intersect(words, found), F.expr(numbers(self.start)), lambda total, g: F.zip_with(total, F.element_at(table, g), lambda x, y: x + y))
        return F.get(F.transform(F.array(scores), lambda v: F.transform(F.slice(v, 1, len(self.families)), lambda x: 1 / (1 + F.exp(F.element_at(v, -1) - x)))), 0)

    def named(self, found: Column) -> Column:
        """The families whose cut is reached, with their probability; an empty array is unknown."""
        fixed = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(c).alias("cut")) for f, c in zip(self.families, self.cuts)])
        judged = F.zip_with(fixed, self.probabilities(found), lambda f, p: F.struct(f["family"].alias("family"), f["cut"].alias("cut"), p.alias("probability")))
        return F.filter(judged, lambda f: f["probability"] >= f["cut"])


def train(docs: DataFrame, unknown_rows: int = UNKNOWN_ROWS) -> LicenceModel:
    """Fit on bounded rows (``training_rows``); each family's cut keeps ``KEPT`` of its notices in folds that the calibrating fit has not seen."""
    rows = pinned(training_rows(docs, unknown_rows))
    families = tuple(sorted(TEMPLATES))
    words = tuple(r[0] for r in _templates(docs.sparkSession).select(F.explode("grams")).distinct().orderBy("col").collect())  # as many as the templates have
    vectors = CountVectorizerModel.from_vocabulary(list(words), inputCol="grams", outputCol="features").setBinary(True)
    number = F.array_position(_array([*families, UNKNOWN]), F.col("family")) - 1
    featured = vectors.transform(rows).withColumn("label", number.cast("double"))
    regression = LogisticRegression(family="multinomial", regParam=0.001, maxIter=60)

    def fitted(part: DataFrame, cuts: tuple[float, ...]) -> LicenceModel:
        model = regression.fit(part)
        return LicenceModel(families, words, tuple(map(tuple, model.coefficientMatrix.toArray().T.tolist())), tuple(model.interceptVector.toArray().tolist()), cuts)

    # Two folds in five are held out; a family's shortest variants may all lie in them, so its cut is never above even odds.
    part = fitted(featured.where("fold > 1"), (0.0,) * len(families))
    own = F.element_at(part.probabilities(F.col("grams")), (F.col("label") + 1).cast("int"))
    held = rows.where("fold <= 1").withColumn("label", number).where(F.col("family") != UNKNOWN).select("family", own.alias("p"))
    kept = {r["family"]: r["cut"] for r in held.groupBy("family").agg(F.percentile("p", F.lit(1 - KEPT)).alias("cut")).collect()}
    return fitted(featured, tuple(min(kept.get(f, 0.5), 0.5) for f in families))


def licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, paragraph, family, probability, contained): the confirmed notices of all documents."""
    known = _Templates(docs.sparkSession)
    judged = lambda r: F.struct(r["at"], r["words"], r["lines"], r["grams"], model.named(r["grams"]).alias("named"))
    regions = _held(paragraphs(docs, known.reach, "doc_id"), "regions", F.transform("regions", judged), "doc_id")
    regions = _held(regions, "regions", F.filter("regions", lambda r: F.size(r["named"]) > 0), "doc_id").where(F.size("regions") > 0)

    def tries(r: Column) -> Column:
        """The templates of the families that the classifier named, where the whole paragraph holds enough of them."""
        of = lambda t: F.filter(r["named"], lambda f: f["family"] == t["family"])
        wanted = F.filter(known.each, lambda t: (F.size(of(t)) > 0) & _enough(t["grams"], r["grams"], t))
        return F.transform(wanted, lambda t: F.struct(r["at"].alias("at"), r["words"].alias("words"), r["lines"].alias("lines"), t.alias("t"), F.get(of(t), 0)["probability"].alias("probability")))

    tried = _held(regions, "tries", F.flatten(F.transform("regions", tries)), "doc_id").where(F.size("tries") > 0)
    found = _held(tried, "found", F.array_sort(F.flatten(F.transform("tries", _windows))), "doc_id").where(F.size("found") > 0)
    # From the best on (largest share, then shortest, then first), each takes its place from those of its family after it.
    meets = lambda a, b: (a["family"] == b["family"]) & ((a["line"] == b["line"]) | (a["begin"] < b["begin"] + b["size"]) & (b["begin"] < a["begin"] + a["size"]))
    nothing = F.slice("found", 1, 0)
    best = F.aggregate("found", nothing, lambda kept, w: F.when(F.exists(kept, lambda k: meets(k, w)), kept).otherwise(F.concat(kept, F.array(w))))
    return found.select("doc_id", F.explode(best).alias("b")).select("doc_id", F.col("b.line").alias("paragraph"), "b.family", "b.probability", (-F.col("b.order")).alias("contained"))


@query("op6_licence")
def _query(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    found = licences(docs, train(docs))
    return found.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.round("probability", 6).alias("probability"), F.round("contained", 6).alias("contained"))
