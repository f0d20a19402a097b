"""Licence scan: trained paragraph classifier with template confirmation.

A paragraph (lines up to a blank one) is scored over overlapping windows of ``SPAN`` words that
cover all of it, and each family keeps its best window.  A window is read as
lower-cased word uni- and bigrams hashed into ``DIM`` features, averaged over it.  A logistic regression tells
licence statements from everything else (the unknown class) and is calibrated
by Platt scaling on held-out rows; a second, multinomial one names the family.
A prediction is confirmed when the window holds most words of one of the
family's names, or when most of its word trigrams are in the family's text; a
text confirms its family also where the regression named another.  A statement
that denies a licence ("not released under ...") confirms none.

Training rows are at most ``max_rows`` (default 4,000): statements framed from
the templates, and paragraphs of ``max_docs`` (default 1,000) documents of the
least text hashes as unknown (those with licence words in them are left out), so
that the sample does not depend on the order of files.  Frames and sentences of
the calibration rows are not among the training rows.  Scoring uses only column functions, in
one pass without a shuffle, over every paragraph of every document.

Defined cases: a null text has no paragraphs; repeated rows are scanned each;
very long texts and lines are scanned whole; of families with equal scores the
last by name is taken; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.llm._shared import table

DIM = 1 << 14
#: family -> names by which statements call it (fixed values).
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "three-clause BSD license", "BSD-3-Clause"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "CC0-1.0": ("CC0 1.0 Universal public domain dedication", "CC0 1.0", "CC0-1.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"),
    "MIT": ("MIT License", "MIT licence", "MIT/X11 license"),
    "All-rights-reserved": ("All rights reserved", "Proprietary and confidential"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
}
_GNU = (
    "{program} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software "
    "Foundation; either version {n} of the License, or (at your option) any later version. {program} is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more details. "
    "You should have received a copy of the GNU {kind} General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_CC = (
    "This work is licensed under the Creative Commons {kind} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{short}/4.0/ "
    "or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
)
#: family -> standard notice, header or body.
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
    "in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
    "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
    "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under "
    "the License.",
    "GPL-2.0": _GNU.format(program="This program", kind="", n="2"),
    "GPL-3.0": _GNU.format(program="This program", kind="", n="3"),
    "LGPL-3.0": _GNU.format(program="This library", kind="Lesser", n="3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
    "http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": _CC.format(kind="Attribution", short="by"),
    "CC-BY-NC-4.0": _CC.format(kind="Attribution-NonCommercial", short="by-nc"),
    "CC-BY-SA-4.0": _CC.format(kind="Attribution-ShareAlike", short="by-sa"),
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, "
    "recording, or other electronic or mechanical methods, without the prior written permission of the publisher.",
}
#: words of a window, and how far the next one starts: any SPAN - STRIDE + 1 words in a row lie in one window.
SPAN, STRIDE = 12, 6
PARAGRAPH = r"\n(?:[ \t\x0B\f\r]*\n)+"
#: A statement that denies a licence.
DENIED = r"\b(?:not|never|nor|cannot|isn t|longer) (?:\S+ ){0,2}(?:licen[cs]ed|released|distributed|covered|available|published|under)\b"
FAMILIES = tuple(NAMES)
FRAMES = (
    "Licensed under {the}{name}.", "Released under {the}{name}.", "This work is licensed under {the}{name}.",
    "This software is distributed under the terms of {the}{name}.", "This program is free software under {the}{name}.",
    "Available under {the}{name}", "SPDX-License-Identifier: {name}", "The content is made available under {the}{name}, see the LICENSE file.",
    "You may use this file under {the}{name}; all rights not granted are reserved.", "License: {name}", "Distributed under {the}{name}.",
)
#: ordinary sentences that share words with licence statements.
DECOYS = (
    "The public was in general free to use the work under the new version.", "He released the album under a new name in version two.",
    "This program is distributed to the public every year.", "The terms of the creative work are under review.",
    "A driving license is available under the usual terms.", "The apache people lived under the open sky.", "He went to MIT in the new year.",
    "Attribution of the commons is a general problem.", "The lesser of two evils is free.", "Mozilla released version 2.0 of the program.",
)


def tokens(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), r"[^a-z0-9.+]+"), lambda w: ~w.isin("", "."))


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9.+]+", text.lower()) if w not in ("", ".")]


def _starts(n: int) -> range:
    return range(0, max(n - SPAN + STRIDE, 1), STRIDE)


def windows(words: Column) -> Column:
    """Overlapping runs of at most ``SPAN`` words that cover an array of words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - SPAN + STRIDE - 1, F.lit(0)), F.lit(STRIDE))
    return F.transform(starts, lambda a: F.slice(words, a + 1, SPAN))


def features(words: Column) -> Column:
    """Hashed uni- and bigrams of an array of words."""
    one = F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(DIM)))
    two = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.pmod(F.hash(a, F.coalesce(b, F.lit("$"))), F.lit(DIM)))
    return F.concat(one, two)


def training_rows(seed: int = 7) -> list[tuple[str, int, int]]:
    """(paragraph, family number; -1 for unknown, number of its frame or sentence) framed from the fixed names."""
    rng = random.Random(seed)
    fill = "the of and to in it on for with as by at from this that was is are be or an".split()
    rows = []
    for k, names in enumerate(NAMES.values()):
        for name in names:
            for at, frame in enumerate(FRAMES):
                text = frame.format(name=name, the=rng.choice(("the ", "")))
                rows.append((text, k, at))
                rows.append((" ".join([*rng.sample(fill, 2), text]), k, at))
    seen = set()
    for k, family in enumerate(FAMILIES):
        words = _words(TEXTS[family])
        for a in _starts(len(words)):
            text = " ".join(words[a : a + SPAN])
            if text not in seen:  # notices share sentences: the trigrams decide there
                seen.add(text)
                rows.append((text, k, a // STRIDE + 1))
    for k, names in enumerate(NAMES.values()):
        for name in names:
            text = _words(FRAMES[0].format(name=name, the="the "))[:SPAN]
            left = rng.randint(0, SPAN - len(text))
            rows.append((" ".join([*rng.choices(fill, k=left), *text, *rng.choices(fill, k=SPAN - len(text) - left)]), k, 1))
    for at, text in enumerate(DECOYS):
        for _ in range(20):
            rows.append((" ".join([*rng.sample(fill, 2), text, *rng.sample(fill, 2)]), -1, at))
    for at in range(400):
        rows.append((" ".join(rng.choices(fill, k=rng.randint(3, 30))), -1, at))
    rng.shuffle(rows)
    return rows


def _fit(x: list[np.ndarray], y: np.ndarray, classes: int, l2: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression on sparse averaged features, by full-batch Adam."""
    who = np.repeat(np.arange(len(x)), [len(r) for r in x])
    what = np.concatenate(x)
    value = 1.0 / np.maximum(np.array([len(r) for r in x]), 1)[who]
    w, b = np.zeros((DIM, classes)), np.zeros(classes)
    target = np.eye(classes)[y]
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = np.stack([np.bincount(who, weights=w[what, c] * value, minlength=len(x)) for c in range(classes)], 1) + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - target) / len(x)
        gw = np.stack([np.bincount(what, weights=d[who, c] * value, minlength=DIM) for c in range(classes)], 1) + l2 * w / len(x)
        for k, (par, g) in enumerate(((w, gw), (b, d.sum(0)))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            par -= 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w, b


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, c = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        d = p - y
        a, c = a - 0.5 * (float((d * z).mean()) / (float((z * z).mean()) + 1e-9) + 1e-3 * (a - 1)), c - 0.5 * float(d.mean())
    return a, c


def fit(docs: DataFrame, text: str = "text", max_rows: int = 4000, max_docs: int = 1000) -> dict:
    """Train both regressions on at most ``max_rows`` labelled paragraphs."""
    spark = docs.sparkSession
    rows = training_rows()
    known = "|".join(["licen[cs]e", "spdx", "copyright", "warrant", "public domain", "rights reserved", "proprietary", "permission", "redistribut", "merchantab", "liab(le|ility)"])
    # a hash range of about twice as many texts as wanted, so that no task meets rows in line with the corpus; copies count once
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("t")).where("t is not null").select("t", F.xxhash64("t").alias("h"))
    share = min(1.0, 2 * max_docs / max(docs.count(), 1))
    some = texts.where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
    some = some.groupBy("h").agg(F.min("t").alias("t")).orderBy(F.pmod("h", F.lit(1 << 40))).limit(max_docs)
    sample = (
        some.select(F.explode(F.split("t", "\n")).alias("p"))
        .where(~F.col("p").rlike("(?i)" + known) & ~F.col("p").rlike("(?i)(cc.by|cc0|gpl|mpl.2|bsd|apache)"))
        .orderBy(F.xxhash64("p")).limit(max(max_rows - len(rows), 0))
    )
    labelled = spark.createDataFrame(rows, "p string, y int, g int").unionByName(sample.select("p", F.lit(-1).alias("y"), F.pmod(F.xxhash64("p"), F.lit(1000)).cast("int").alias("g")))
    got = sorted((r.g, r.y, r.x) for r in labelled.select(features(tokens(F.col("p"))).alias("x"), "y", "g").collect() if r.x)
    x, y = [np.array(g[2], dtype=np.int64) for g in got], np.array([g[1] for g in got])
    held = np.array([g[0] for g in got]) % 5 == 0
    train = np.flatnonzero(~held)
    wb, bb = _fit([x[i] for i in train], (y[train] >= 0).astype(int), 2)
    weight, bias = wb[:, 1] - wb[:, 0], float(bb[1] - bb[0])
    z = np.array([weight[r].mean() + bias for r in x])
    a, c = _platt(z[held], (y[held] >= 0).astype(float))
    some = [i for i in train if y[i] >= 0]
    wf, bf = _fit([x[i] for i in some], y[some], len(FAMILIES))
    pred = np.array([int(np.argmax(wf[r].mean(0) + bf)) for r in x])
    positive = a * z + c > 0
    return {
        "weight": a * weight, "bias": a * bias + c, "family": wf, "family_bias": bf,
        "held_out_unknown": float((positive[held] == (y[held] >= 0)).mean()),
        "held_out_family": float((pred[held & (y >= 0)] == y[held & (y >= 0)]).mean()),
    }


def _vector(values: np.ndarray) -> Column:
    """A constant array column (folded to one literal)."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def _mean_score(x: Column, weights: Column, bias: float) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda acc, i: acc + F.get(weights, i))
    return total / F.greatest(F.size(x), F.lit(1)) + F.lit(float(bias))


def _template_share(words: Column, family: str) -> Column:
    """Largest share of a name's words that the paragraph holds."""
    shares = []
    for name in NAMES[family]:
        need = sorted({w for w in re.split(r"[^a-z0-9.+]+", name.lower()) if w not in ("", ".")})
        plain = F.transform(words, lambda w: F.regexp_replace(w, r"\.+$", ""))
        shares.append(F.size(F.array_intersect(plain, F.array(*[F.lit(w) for w in need]))) / F.lit(float(len(need))))
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


def _text_share(words: Column, family: str) -> Column:
    """Share of the window's word trigrams that the family's text holds; 0 for windows under six words."""
    held = _words(TEXTS[family])
    grams = sorted({" ".join(held[i : i + 3]) for i in range(len(held) - 2)})
    mine = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 3), " "))
    known = F.array_intersect(mine, F.split(F.lit("\n".join(grams)), "\n"))
    return F.when(F.size(words) >= 6, F.size(known) / F.size(F.array_distinct(mine))).otherwise(F.lit(0.0))


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text", min_probability: float = 0.5, min_share: float = 0.75) -> DataFrame:
    """Per row: ``doc_id, n_paragraphs, licences`` (array of paragraph, family, probability, confirmed), the best window of each family in a paragraph."""
    lines = F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), PARAGRAPH)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), lines.alias("lines"))
    gate = _vector(model["weight"])
    # one select for each step: a lambda argument is evaluated once, an inlined expression at every use
    rows = rows.select("doc_id", "lines", F.transform("lines", tokens).alias("words"))
    parts = F.flatten(F.transform("words", lambda w, i: F.transform(windows(w), lambda x: F.struct(i.alias("line"), x.alias("words")))))
    count = F.size(F.filter("lines", lambda p: p.rlike(r"\S"))).cast("long").alias("n_paragraphs")
    rows = rows.select("doc_id", count, parts.alias("parts"))
    rows = rows.select("*", F.transform("parts", lambda s: features(s["words"])).alias("x"))
    rows = rows.select("*", F.transform("x", lambda x: _mean_score(x, gate, model["bias"])).alias("z"))
    floor = float(np.log(min_probability / (1 - min_probability)))
    rows = rows.select(
        "doc_id",
        "n_paragraphs",
        F.filter(
            F.transform(F.arrays_zip("parts", "x", "z"), lambda s: F.struct(s["parts"]["line"].alias("line"), s["parts"]["words"].alias("words"), s["x"].alias("x"), s["z"].alias("z"))),
            lambda s: s["z"] >= floor,
        ).alias("hits"),
    )
    family = [_vector(model["family"][:, k]) for k in range(len(FAMILIES))]

    def named(s: Column) -> Column:
        best = F.array_max(F.array(*[F.struct(_mean_score(s["x"], family[k], model["family_bias"][k]).alias("z"), F.lit(f).alias("family")) for k, f in enumerate(FAMILIES)]))
        held = F.array_max(F.array(*[F.struct(_text_share(s["words"], f).alias("share"), F.lit(f).alias("family")) for f in FAMILIES]))
        return F.struct(s["line"].alias("line"), (1 / (1 + F.exp(-s["z"]))).alias("probability"), best["family"].alias("family"), held.alias("held"), s["words"].alias("words"), F.array_join(s["words"], " ").rlike(DENIED).alias("denied"))

    def confirmed(s: Column) -> Column:
        share = F.coalesce(*[F.when(s["family"] == f, F.greatest(F.when(s["denied"], F.lit(0.0)).otherwise(_template_share(s["words"], f)), _text_share(s["words"], f))) for f in FAMILIES])
        return F.struct(
            s["line"].alias("line"), F.when((share < min_share) & (s["held"]["share"] >= min_share), s["held"]["family"]).otherwise(s["family"]).alias("family"),
            s["probability"].alias("probability"), ((share >= min_share) | (s["held"]["share"] >= min_share)).alias("confirmed"),
        )

    rows = rows.select("doc_id", "n_paragraphs", F.transform("hits", named).alias("hits"))
    rows = rows.select("doc_id", "n_paragraphs", F.transform("hits", confirmed).alias("hits"))
    kinds = F.array_sort(F.array_distinct(F.transform("hits", lambda s: F.struct(s["line"].alias("line"), s["family"].alias("family")))))
    rows = rows.select("doc_id", "n_paragraphs", "hits", kinds.alias("kinds"))

    def top(k: Column) -> Column:
        mine = F.filter("hits", lambda s: (s["line"] == k["line"]) & (s["family"] == k["family"]))
        best = F.array_max(F.transform(mine, lambda s: F.struct(s["confirmed"].alias("confirmed"), s["probability"].alias("probability"))))
        return F.struct(k["line"].alias("line"), k["family"].alias("family"), best["probability"].alias("probability"), best["confirmed"].alias("confirmed"))

    return rows.select("doc_id", "n_paragraphs", F.transform("kinds", top).alias("licences"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_rows: int = 4000) -> DataFrame:
    return scan(docs, fit(docs, text, max_rows), id_col, text)


def query(spark, sf_dir):
    found = scan_licences(table(spark, sf_dir, "documents"))
    sure = F.filter("licences", lambda s: s["confirmed"])
    return found.select(
        "doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda s: s["family"]))), ",").alias("families"),
    )
