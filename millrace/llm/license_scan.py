"""Licence scans: sparse TF-IDF cosine of lines, header blocks and whole files to licence templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: By name the short notice, the file header and the text of usual licences; a name may have several.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("Licensed under the Creative Commons Attribution 4.0 International License.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "proprietary": ("All rights reserved.", "Copyright (c) All rights reserved."),
}


def tokens(text: str) -> list[str]:
    return [x for x in re.split("[^a-z0-9]+", text.lower()) if x]


def _tokens(text):
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def idf(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' words over all documents, and that of any other word (as if in no document)."""
    v = F.array(*[F.lit(x) for x in vocabulary])
    held = docs.select(F.explode_outer(F.array_intersect(_tokens(F.coalesce(F.col("text"), F.lit(""))), v)).alias("t"))
    df = {r[0]: r[1] for r in held.where("t is not null").groupBy("t").count().collect()}  # at most a row per template word
    n = docs.count()
    return {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}, math.log(1 + n) + 1


def cue_words(templates: list[dict[str, float]], threshold: float) -> list[str]:
    """Words of which a candidate must hold one to reach the threshold: by Cauchy-Schwarz one that shares only the others with a
    template, whose weights there have a norm under the threshold, has a smaller cosine."""
    cues = set()
    for w in templates:
        rest = dict(w)
        for t in sorted(w, key=lambda t: (-w[t], t)):
            if math.sqrt(sum(x * x for x in rest.values())) < threshold * 0.999:
                break
            cues.add(t)
            del rest[t]
    return sorted(cues)


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.6, file_share: float = 0.25, keep_text: bool = False) -> DataFrame:
    """files (doc_id, path, text, ...), text dropped unless kept, with lic_*: own (template's name or null), score, is_file, directory, license, inherited_from.

    Candidates are every line of the whole text, every block (a run of lines that hold a cue word each, blank ones aside) and the whole text; only those that hold
    a cue word are looked at, and only in texts whose words together allow the threshold for a template; the others cannot reach it. A candidate's sparse vector has tf x idf for each word of the templates in it, and each other
    word is a dimension of its own with the highest idf. The best template of the best candidate with a cosine of at least the threshold is
    the file's own licence (ties: the earliest template). A file is a licence file of its directory if its whole text reaches the threshold or its lines that do
    hold at least file_share of its words. A file without an own licence takes that of the nearest ancestor directory that has a licence file; of
    several there, the best scored, then the smallest path. Null text or path: no own licence, and no directory to inherit
    from; repeated rows get the same result; an empty table an empty one. Columns named lic_* are ours, others are kept.
    """
    each = [(k, t) for k, ts in templates.items() for t in ts]
    vocab = sorted({t for _, x in each for t in tokens(x)})
    weight, other = idf(files, vocab)
    vectors = []
    for _, text in each:
        toks = tokens(text)
        v = {t: toks.count(t) * weight[t] for t in toks}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()})
    cues = cue_words(vectors, threshold)
    lits = lambda xs: F.split(F.lit(",".join(repr(float(x)) for x in xs)), ",").cast("array<double>")  # noqa: E731  folded into one literal
    vs, idfs = F.split(F.lit(",".join(vocab)), ","), lits(weight[t] for t in vocab)
    weights = [lits(v.get(t, 0.0) for t in vocab) for v in vectors]

    def sparse(ts):
        """(place in the vocabulary, tf x idf) of the words of a candidate that templates have; counts by what is left without the word."""
        held = F.transform(F.array_intersect(ts, vs), lambda t: F.struct((F.array_position(vs, t).cast("int") - 1).alias("i"), (F.size(ts) - F.size(F.array_remove(ts, t))).alias("tf")))
        return F.transform(held, lambda x: F.struct(x["i"].alias("i"), x["tf"].alias("tf"), (x["tf"] * F.get(idfs, x["i"])).alias("w")))

    def scored(c):
        """A candidate's best template (score, -place), its number of words, and whether it is the whole text."""
        total = lambda v, f: F.aggregate(v, F.lit(0.0), lambda u, x: u + f(x))
        vectors_ = F.transform(F.array(_tokens(c["s"])), lambda ts: F.struct(sparse(ts).alias("v"), F.size(ts).alias("n")))
        sized = F.transform(vectors_, lambda y: F.struct(y["v"].alias("v"), y["n"].alias("n"), F.sqrt(total(y["v"], lambda x: x["w"] * x["w"]) + (y["n"] - total(y["v"], lambda x: x["tf"].cast("double"))) * F.lit(other * other)).alias("norm")))
        best = lambda y: F.array_max(F.array(*[F.struct((total(y["v"], lambda x, m=m: x["w"] * F.get(m, x["i"])) / y["norm"]).alias("score"), F.lit(-k).alias("k")) for k, m in enumerate(weights)]))
        return F.get(F.transform(sized, lambda y: F.struct(best(y).alias("best"), y["n"].alias("n"), c["kind"].alias("kind"))), F.lit(0))

    cue = "(?i)(^|[^a-z0-9])(" + "|".join(cues) + ")([^a-z0-9]|$)"
    text = F.coalesce(F.col("text"), F.lit(""))
    # a cosine is at most the norm of the template's weights on the words that the text has at all
    held = F.transform(F.array_intersect(_tokens(text), vs), lambda t: F.array_position(vs, t).cast("int") - 1)
    squares = [lits(v.get(t, 0.0) ** 2 for t in vocab) for v in vectors]
    mass = lambda xs, m: F.aggregate(xs, F.lit(0.0), lambda u, i: u + F.get(m, i))
    masses = lambda xs: F.greatest(*[mass(xs, m) for m in squares])
    able = F.get(F.transform(F.array(held), masses), F.lit(0)) >= threshold * threshold * 0.999
    rows = F.split(text, "\n")
    lines = F.filter(rows, lambda l: l.rlike(cue))
    blocks = F.split(F.array_join(F.transform(rows, lambda l: F.when(l.rlike(cue) | (F.trim(l) == ""), l).otherwise(F.lit("\x00"))), "\n"), "\x00")
    blocks = F.filter(blocks, lambda b: F.trim(b).contains("\n") & b.rlike(cue))
    tagged = lambda xs, kind: F.transform(xs, lambda x: F.struct(x.alias("s"), F.lit(kind).alias("kind")))
    none = F.array().cast("array<struct<s:string,kind:int>>")
    df = files.withColumn("lic_c", F.when(text.rlike(cue) & able, F.concat(tagged(lines, 0), tagged(blocks, 1), tagged(F.array(text), 2))).otherwise(none))
    df = df.withColumn("lic_s", F.filter(F.transform("lic_c", scored), lambda x: x["best"]["score"] >= threshold))
    df = df.withColumn("lic_best", F.array_max(F.transform("lic_s", lambda x: x["best"])))
    lined = F.aggregate("lic_s", F.lit(0), lambda u, x: u + F.when(x["kind"] == 0, x["n"]).otherwise(F.lit(0)))
    df = df.withColumns({
        "lic_own": F.when(F.col("lic_best").isNotNull(), F.get(F.array(*[F.lit(k) for k, _ in each]), -F.coalesce(F.col("lic_best.k"), F.lit(0)))),
        "lic_score": F.round("lic_best.score", 9),
        "lic_is_file": F.coalesce((F.size("lic_s") > 0) & (F.exists("lic_s", lambda x: x["kind"] == 2) | (lined >= file_share * F.size(_tokens(text)))), F.lit(False)),
        "lic_directory": F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")),
    }).drop("lic_c", "lic_s", "lic_best", *([] if keep_text else ["text"]))
    df = common.stored(df, "licence-scores")  # read for the directories and for the result
    narrow = common.stored(df.select("path", "lic_own", "lic_score", "lic_is_file", "lic_directory").where("lic_directory is not null").groupBy("lic_directory").agg(
        F.min(F.when(F.col("lic_is_file"), F.struct((-F.col("lic_score")).alias("s"), F.col("path").alias("path"), F.col("lic_own").alias("own")))).alias("best")), "licence-directories")
    # distinct directories, not files, meet their ancestors: a row for each level of depth
    parts = F.split("lic_directory", "/")
    ups = F.when(F.col("lic_directory") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    up = narrow.select("lic_directory", F.explode(ups).alias("at"))
    own = narrow.where("best is not null").select(F.col("lic_directory").alias("at"), F.col("best.own").alias("of"))
    near = up.join(own, "at").groupBy("lic_directory").agg(F.max(F.struct(F.when(F.col("at") == "", 0).otherwise(F.size(F.split("at", "/"))).alias("depth"), "at", "of")).alias("near"))
    near = common.stored(near.select("lic_directory", F.col("near.at").alias("lic_at"), F.col("near.of").alias("lic_of")), "licence-near")
    # directories below a licence; their number grows with the input, so their measured width decides whether they are broadcast
    width = near.agg(F.max(F.octet_length("lic_directory") + F.octet_length("lic_at") + F.octet_length("lic_of"))).first()[0] or 0
    out = df.join(common.checked_broadcast(near, width + 100), "lic_directory", "left")
    common.discard(narrow)
    return out.select(*[F.col(f"`{x}`") for x in files.columns if keep_text or x != "text"], "lic_own", "lic_score", "lic_is_file", "lic_directory", F.coalesce("lic_own", "lic_of").alias("lic_license"), F.when(F.col("lic_own").isNull(), F.col("lic_at")).alias("lic_inherited_from"))
