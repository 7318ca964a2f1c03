"""Licence scan by DataFrame functions alone.

A paragraph is a line of a text, and also a block of lines up to the next line without a letter or
digit, so that a notice wrapped over lines is seen whole. Its features are word n-grams of one to
three words that are not all function words; a multinomial logistic regression over them, trained
on the templates, their variants and all unknown paragraphs of the corpus, names the family or
`unknown`. A family is taken from a probability that unknown paragraphs do not reach, and is
confirmed if at least 0.8 of the five-word shingles of one of its templates stand in the paragraph.

Every feature and shingle consists of words of the templates, and every feature holds one that is
no function word. So a paragraph is reduced to its runs of template words: that loses nothing that
the model or the templates can see. Equal runs are taken apart once, whatever the number of
paragraphs that have them; vocabulary and shingles travel whole, their size is that of the templates.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.common import keep

# Usual notices of common licences.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the Apache License, "
                   "Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "You can redistribute it and/or modify it under the terms of the GNU General "
                "Public License, either version 3 of the License, or any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Use of this source code is governed by a BSD-style license."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
                  "License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial "
                     "4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright under "
                "CC0 1.0."),
    ("isc", "Licensed under the ISC License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("gpl-3.0", "Distributed under the GPLv3."),
    ("gpl-2.0", "Distributed under the GPLv2."),
    ("cc-by-4.0", "Available under CC BY 4.0."),
    ("cc-by-sa-4.0", "Available under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Available under CC BY-NC 4.0."),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0."),
    # the paragraphs of the standard texts and headers
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
            "and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies "
            "or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
            "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
            "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
            "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
            "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
            "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
                   "use this file except in compliance with the License. You may obtain a copy of "
                   "the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed "
                   "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                   "specific language governing permissions and limitations under the License."),
    *[(f"{name}gpl-{v}.0",
       f"This program is free software{end} you can redistribute it and/or modify it under the "
       f"terms of the GNU {kind}General Public License as published by the Free Software "
       f"Foundation{sep} either version {v} of the License, or (at your option) any later version.")
      for name, kind, v, end, sep in [("", "", 3, ":", ","), ("", "", 2, ";", ";"),
                                      ("l", "Lesser ", 3, ":", ","), ("a", "Affero ", 3, ":", ",")]],
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met: 1. Redistributions of source "
            "code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
            "notice, this list of conditions and the following disclaimer in the documentation "
            "and/or other materials provided with the distribution."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of "
            "conditions and the following disclaimer in the documentation and/or other materials "
            "provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used "
            "to endorse or promote products derived from this software without specific prior "
            "written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
            "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
            "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
            "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
            "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
            "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
            "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
            "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
            "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
            "DAMAGE."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
                "one at https://mozilla.org/MPL/2.0/."),
    *[(f"cc-by{tag}-4.0",
       f"This work is licensed under the Creative Commons Attribution{kind} 4.0 International "
       f"License. To view a copy of this license, visit "
       f"http://creativecommons.org/licenses/by{tag}/4.0/ or send a letter to Creative Commons, PO "
       f"Box 1866, Mountain View, CA 94042, USA.")
      for tag, kind in [("", ""), ("-sa", "-ShareAlike"), ("-nc", "-NonCommercial")]],
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and "
                "related and neighboring rights to this work to the public domain worldwide. This "
                "work is distributed without any warranty. You should have received a copy of the "
                "CC0 Public Domain Dedication along with this work."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
            "or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
            "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN "
            "NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
            "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
            "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
            "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
                  "software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means."),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this "
                  "software dedicate any and all copyright interest in the software to the public "
                  "domain."),
]
# Sentences that use such words without granting anything.
DECOYS = ["He lost his driving license.", "The general public may visit the park.",
          "You may use this version of the file.", "It was released under a new name.",
          "A copy of the work is free of charge.", "The law grants rights to any person.",
          "The apache helicopter is a later version.", "The source is subject to modification.",
          "International conditions are met by the public.", "They study at the MIT in Boston."]
FUNCTION_WORDS = ("a all and any are at be by can either except for free has he his in into is it "
                  "later may met new not of on or possible provided subject terms that the they "
                  "this to under use was with without work you extent following person an but from if "
                  "no nor one other out see should so such whom way").split()
# possessive: a long word takes no stack
WORDS = r"[a-z0-9]++(?:[.+-][a-z0-9]++)*+"
UNKNOWN = "unknown"
SHINGLE, SIMILAR = 5, 0.8
VARIED = 24        # words of the longest template that is learned without each word in turn, too
BINS = 1000        # of one step to a quantile
STRANGE = "\u0001"   # stands for words between runs of template words; texts lose it first
SIGN = "*"           # of a template word that is no function word


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def grams(tokens: Column, n: int) -> Column:
    """Runs of n words; fewer words make none."""
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(
        at, lambda k: F.array_join(F.slice(tokens, k, n), " "))).otherwise(
        F.array().cast("array<string>"))


def shingles(tokens: Column) -> Column:
    """Five-word shingles; fewer words are one shingle, no words none."""
    few = F.when(F.size(tokens) > 0, F.array(F.array_join(tokens, " "))).otherwise(
        F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.size(tokens) >= SHINGLE, grams(tokens, SHINGLE))
                            .otherwise(few))


def features(tokens: Column) -> Column:
    """Distinct n-grams of one to three words that are not all function words."""
    plain = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    every = F.concat(*[grams(tokens, n) for n in (1, 2, 3)])
    return F.array_distinct(F.filter(every, lambda g: F.size(
        F.array_except(F.split(g, " "), plain)) > 0))


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, t, k) for k, (f, t) in enumerate(TEMPLATES)],
                                 "family string, text string, template int")


TEMPLATE_WORDS = sorted({w for _, t in TEMPLATES for w in re.findall(WORDS, t.lower())})
CORE_WORDS = sorted(set(TEMPLATE_WORDS) - set(FUNCTION_WORDS))
OTHER_WORDS = sorted(set(TEMPLATE_WORDS) & set(FUNCTION_WORDS))
RUN = f"[^ {STRANGE}][^{STRANGE}]*"
LONG = rf"(?:[^ ]+ ){{{SHINGLE - 1}}}[^ ]"  # a run that has a shingle


def marks(text: Column) -> Column:
    """Words of a text in lower case and its line ends, parted by blanks.

    A template word that is no function word has SIGN ahead, a word of no template is STRANGE.
    """
    found = F.regexp_extract_all(text, F.lit(rf"\n|{WORDS}"), F.lit(0))
    return F.array_join(F.transform(found, lambda w: F.when(
        w.isin(CORE_WORDS), F.concat(F.lit(SIGN), w)).when(w.isin(["\n", *OTHER_WORDS]), w)
        .otherwise(STRANGE)), " ")


def core(marked: Column) -> Column:
    """Runs of template words of marks without line ends, parted by `|`, words by blanks.

    Runs that can hold no feature and no shingle are left out; empty if there is no feature.
    """
    runs = F.transform(F.regexp_extract_all(marked, F.lit(RUN), F.lit(0)), lambda r: F.trim(r))
    kept = F.filter(runs, lambda r: r.contains(SIGN) | r.rlike(LONG))
    return F.when(marked.contains(SIGN), F.translate(F.array_join(kept, "|"), SIGN, "")
                  ).otherwise("")


def known_examples(spark: SparkSession) -> DataFrame:
    """(family, features): templates, each without one word in turn, and decoys."""
    base = templates(spark).withColumn("tokens", words(F.col("text")))
    lacking = base.where(F.size("tokens") <= VARIED).select("family", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("tokens")),
        lambda k: F.concat(F.slice("tokens", F.lit(1), k - 1),
                           F.slice("tokens", k + 1, F.size("tokens"))))).alias("tokens"))
    # a variant that lost its only telling word teaches nothing about a family
    known = base.select("family", "tokens").unionAll(lacking).where(
        F.size(features(F.col("tokens"))) >= 3)
    decoys = spark.createDataFrame([(t,) for t in DECOYS], "text string").select(
        F.lit(UNKNOWN).alias("family"), words(F.col("text")).alias("tokens"))
    return known.unionAll(decoys).select("family",
                                         F.array_sort(features(F.col("tokens"))).alias("features"))


def read(cores: DataFrame, known: DataFrame) -> DataFrame:
    """`cores` with `features`, those of the families' examples, and `told`, shingles of templates.

    Both lists are distinct and no longer than the vocabulary of the templates. Every core holds a
    word of the templates that is no function word, and so a feature of the model.
    """
    vocabulary = _listed(known.where(F.col("family") != UNKNOWN).select(F.explode("features")))
    own = _listed(_shingled(cores.sparkSession).select("shingle"))
    rows = cores.withColumn("runs", F.transform(F.split("core", r"\|"), lambda r: F.split(r, " ")))

    def held(sizes: tuple[int, ...], wanted: list[str]) -> Column:
        every = F.flatten(F.transform("runs", lambda t: F.concat(*[grams(t, n) for n in sizes])))
        return F.array_sort(F.array_distinct(F.filter(every, lambda g: g.isin(wanted))))

    # templates of three and four words are shorter than a shingle: they are looked for as they are
    return rows.select(*cores.columns, held((1, 2, 3), vocabulary).alias("features"),
                       held((3, 4, SHINGLE), own).alias("told"))


def _listed(rows: DataFrame) -> list[str]:
    return sorted(r[0] for r in rows.distinct().collect())


def _shingled(spark: SparkSession) -> DataFrame:
    """family, template, n, shingle: the n shingles of each template."""
    own = templates(spark).select("family", "template", shingles(words(F.col("text"))).alias("s"))
    return own.select("family", "template", F.size("s").alias("n"), F.explode("s").alias("shingle"))


class Model:
    """Counts of features, the regression over them, families by label, the least probability."""

    def __init__(self, counter: CountVectorizerModel, regression: LogisticRegressionModel,
                 families: list[str], least: float):
        self.counter, self.regression = counter, regression
        self.families, self.least = families, least

    def score(self, rows: DataFrame) -> DataFrame:
        """`rows`, which have `features`, with the likeliest family but unknown and its p."""
        found = self.regression.transform(self.counter.transform(rows))
        pairs = F.transform(vector_to_array("probability"), lambda x, k: F.struct(
            x.alias("p"), F.element_at(F.array(*[F.lit(f) for f in self.families]), k + 1)
            .alias("family")))
        best = F.array_max(F.filter(pairs, lambda x: x["family"] != UNKNOWN))
        found = found.select(*rows.columns, best.alias("best"))
        return found.select(*rows.columns, "best.family", "best.p")


def train(known: DataFrame, cores: DataFrame) -> Model:
    """Multinomial logistic regression with ridge penalty; the least probability is calibrated on
    the unknown examples, and is a half at least.

    `cores` are those of all paragraphs, with `features`, `told` and n, the number of distinct
    paragraphs. A paragraph that holds a shingle of a template is no example of the unknown, every
    other one is; equal ones are one row of their joint weight, which the regression takes as it
    takes that many rows.
    """
    unknown = cores.where(F.size("told") == 0).groupBy("features").agg(F.sum("n").alias("n"))
    rows = keep(known.withColumn("n", F.lit(1).cast("long")).unionByName(
        unknown.withColumn("family", F.lit(UNKNOWN))), "licence-examples")
    total = {r["family"]: r["n"] for r in rows.groupBy("family").agg(F.sum("n").alias("n"))
             .collect()}
    families = sorted(total)
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family"))
    share = F.element_at(F.array(*[F.lit(float(total[f])) for f in families]), label.cast("int"))
    labelled = rows.withColumns({"label": (label - 1).cast("double"), "weight": F.col("n") / share})
    # the vocabulary is that of the templates, so it is bounded by them
    counter = CountVectorizer(inputCol="features", outputCol="vector", binary=True,
                              vocabSize=1 << 18).fit(known.where(F.col("family") != UNKNOWN))
    fitted = LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight",
                                family="multinomial", regParam=0.001, maxIter=60,
                                predictionCol="", rawPredictionCol="").fit(
                                    counter.transform(labelled))
    model = Model(counter, fitted, families, 0.5)
    scored = model.score(rows.where((F.col("family") == UNKNOWN) & (F.size("features") > 0))
                         .select("features", "n"))
    model.least = _quantile(keep(scored.select("p", "n"), "licence-unknown"), 0.99, 0.5, 0.95)
    return model


def _quantile(rows: DataFrame, share: float, low: float, high: float) -> float:
    """The least p between `low` and `high` that is reached by a share of the rows (p, n), n times
    each: the bin of that rank is cut again and again, until it holds one value. No row: `low`."""
    rows = rows.select(F.greatest(F.lit(low), F.least(F.lit(high), "p")).alias("p"), "n")
    wanted = math.ceil(share * (rows.agg(F.sum("n")).first()[0] or 0))
    below = 0
    while wanted and low < high:
        bins = rows.where(F.col("p").between(low, high)).groupBy(F.least(F.floor(
            (F.col("p") - low) / (high - low) * BINS), F.lit(BINS - 1)).alias("bin")).agg(
            F.sum("n").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))
        for r in sorted(bins.collect(), key=lambda r: r["bin"]):  # at most BINS
            low, high = r["low"], r["high"]
            if below + r["n"] >= wanted:
                break
            below += r["n"]
    return low


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_paragraphs, licences (paragraph, family, p, similarity, confirmed).

    Paragraphs are lines with a character that is no white space, numbered from 0 among all lines.
    A block of several lines is listed under the number of its first line, unless one of its lines
    has its family already; n_paragraphs counts lines only. Null and empty texts have none. A
    paragraph of a family whose template it does not match is listed unconfirmed; unknown paragraphs
    are not listed. Repeated rows stay rows of their own.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    text = F.translate(F.lower(F.coalesce("text", F.lit(""))), STRANGE, " ")
    rows = rows.select("id", F.split(text, "\n").alias("lines"), F.transform(
        F.split(marks(text), "\n"), lambda x: F.trim(x)).alias("marked"))
    count = F.size(F.filter("lines", lambda x: F.length(F.trim(x)) > 0)).cast("long")
    none = F.array().cast(LICENCES)
    # the key is fixed once it is written; of the texts only the runs of template words are
    held = keep(_blocks(rows).select("id", count.alias("n_paragraphs"), "found",
                                     F.monotonically_increasing_id().alias("key")), "licence-rows")
    without = held.where(F.size("found") == 0).select("id", "n_paragraphs", none.alias("licences"))
    held = held.where(F.size("found") > 0)
    found = held.select("key", F.inline("found"))
    cores = found.select("h", "core").distinct().groupBy("core").agg(F.count("*").alias("n"))
    known = keep(known_examples(spark), "licence-templates")
    cores = keep(read(cores, known), "licence-cores")
    named = keep(_named(cores, train(known, cores)), "licence-named")
    sure = F.col("similarity") >= SIMILAR
    listed = found.join(named, "core").groupBy("key", "block", "family").agg(
        F.collect_list(F.struct("paragraph", "whole", "p", "similarity",
                                sure.alias("confirmed"))).alias("all"))
    line = F.exists("all", lambda x: ~x["whole"])
    sure_line = F.exists("all", lambda x: ~x["whole"] & x["confirmed"])
    sure_block = F.exists("all", lambda x: x["whole"] & x["confirmed"])
    chosen = listed.select("key", "family", line.alias("line"), sure_line.alias("sure_line"),
                           sure_block.alias("sure_block"), F.explode("all").alias("x"))
    # a block stands for lines that are not sure, a sure line for its block
    stays = F.when(F.col("sure_line"), ~F.col("x.whole")).when(
        F.col("sure_block"), F.col("x.whole")).otherwise(~F.col("x.whole") | ~F.col("line"))
    chosen = chosen.where(stays).select("key", F.struct(
        "x.paragraph", "family", "x.p", "x.similarity", "x.confirmed").alias("found"))
    # a text has as many as it has lines that name a licence: no more than the row itself holds
    lists = chosen.groupBy("key").agg(F.sort_array(F.collect_list("found")).alias("licences"))
    having = held.select("id", "n_paragraphs", "key").join(lists, "key", "left").select(
        "id", "n_paragraphs", F.coalesce("licences", none).alias("licences"))
    return having.unionByName(without)


def _blocks(rows: DataFrame) -> DataFrame:
    """`found`: (block, paragraph, whole, h, core) of lines and blocks with a core.

    Each step is a column of its own: an expression inside a lambda would run for every element.
    """
    rows = rows.withColumn("worded", F.transform("lines", lambda x: x.rlike(r"[\p{L}\p{N}]")))
    at = F.sequence(F.lit(0), F.size("worded") - 1)
    here, last = F.col("worded"), F.size("worded") - 1
    rows = rows.withColumns({
        "firsts": F.filter(at, lambda k: here[k] & ((k == 0) | ~here[F.greatest(k - 1, F.lit(0))])),
        "lasts": F.filter(at, lambda k: here[k] & ((k == last) | ~here[F.least(k + 1, last)]))})
    line, marked = F.col("lines"), F.col("marked")

    def one(first: Column, end: Column) -> Column:
        n = end - first + 1
        lines = F.transform(F.sequence(first, end), lambda k: _found(
            first, k, False, line[k], marked[k]))
        whole = F.array(_found(
            first, first, True, F.array_join(F.slice(line, first + 1, n), " "),
            F.array_join(F.filter(F.slice(marked, first + 1, n), lambda x: x != ""), " ")))
        return F.when(end > first, F.concat(lines, whole)).otherwise(lines)

    every = F.flatten(F.zip_with("firsts", "lasts", one))
    return rows.withColumn("found", F.filter(every, lambda x: x["core"] != ""))


def _found(block: Column, paragraph: Column, whole: bool, text: Column, marked: Column) -> Column:
    return F.struct(block.alias("block"), paragraph.alias("paragraph"), F.lit(whole).alias("whole"),
                    F.xxhash64(text).alias("h"), core(marked).alias("core"))


def _named(cores: DataFrame, model: Model) -> DataFrame:
    """core, family, p, similarity of the cores that are not unknown."""
    named = model.score(cores.where(F.size("features") > 0).select("core", "features")).where(
        F.col("p") >= model.least)
    alike = (cores.select("core", F.explode("told").alias("shingle"))
             .join(F.broadcast(_shingled(cores.sparkSession)), "shingle")
             .groupBy("core", "family", "template").agg((F.count("*") / F.first("n")).alias("s"))
             .groupBy("core", "family").agg(F.max("s").alias("similarity")))
    return named.join(alike, ["core", "family"], "left").select(
        "core", "family", "p", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


LICENCES = ("array<struct<paragraph:int,family:string,p:double,similarity:double,"
            "confirmed:boolean>>")
