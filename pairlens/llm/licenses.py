"""Licence scan: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance by path."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts of each licence (whole, its notice, and how it is named in a line), and what marks a header line,
# a blank line of any comment style, and a licence file.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more details.
You should have received a copy of the GNU {kind} General Public License along with this {what}."""


def _gnu(name: str, kind: str, n: str, what: str = "program") -> list[str]:
    return [_GNU.format(kind=kind, n=n, what=what), f"This work is licensed under the GNU {kind} General Public License, version {n}", f"This {what} is free software under the GNU {kind} General Public License, {name} version {n}", f"GNU {kind.upper()} GENERAL PUBLIC LICENSE Version {n}"]


TEXTS = {
    "AGPL-3.0": _gnu("AGPL", "Affero", "3"),
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0",
    ],
    "BSD-2-Clause": [f"{_BSD_2}\n{_BSD_END}", _BSD_2, "Released under the BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": [f"{_BSD_2}\n{_BSD_3}\n{_BSD_END}", "Released under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "CC-BY-4.0": ["This work is licensed under the Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, which is released under CC0 1.0 Universal", "Licensed under CC0 1.0"],
    "GPL-2.0": _gnu("GPL", "", "2"),
    "GPL-3.0": _gnu("GPL", "", "3"),
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License",
    ],
    "LGPL-2.1": _gnu("LGPL", "Lesser", "2.1", "library"),
    "LGPL-3.0": _gnu("LGPL", "Lesser", "3", "library") + _gnu("LGPL", "Lesser", "3")[:1],
    "MIT": [
        f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_AS_IS}""",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Released under the MIT License",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Released under the Mozilla Public License 2.0"],
    "Proprietary": ["Proprietary and confidential. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Released under the Unlicense"],
}
TEMPLATES = {k: [*texts, f"SPDX-License-Identifier: {k}"] for k, texts in TEXTS.items()}
BLANK = r"\n(?:[^A-Za-z0-9\n]*\n)+"
HEADER = r"(?i)licen[cs]e|copyright|all rights reserved|creative commons|\bspdx\b|permission to use"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"


def _tokens(text):
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z0-9]+"), F.lit(0))


def weights(templates: dict[str, list[str]] = TEMPLATES) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """(licence, text's number, token, unit weight) rows, idf of the templates' tokens by licences, and the idf of any other token."""
    import re
    from collections import Counter

    tf = {(k, i): Counter(re.findall("[a-z0-9]+", t.lower())) for k, texts in templates.items() for i, t in enumerate(texts)}
    df = Counter(t for k in templates for t in {t for (of, _), c in tf.items() if of == k for t in c})
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for (k, i), c in tf.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(k, i, t, n * idf[t] / norm) for t, n in c.items()]
    return rows, idf, math.log(1 + len(templates)) + 1


def best_template(texts: DataFrame, text: str, least: float, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``k, licence, score`` of the distinct texts that reach ``least``, k the MD5 of the text; of equal scores the first name.

    The templates' weights are a fixed table of some thousand rows, the only thing broadcast.
    """
    spark = texts.sparkSession
    rows, idf, other = weights(templates)
    table = F.broadcast(spark.createDataFrame(rows, "licence string, v int, t string, w double"))
    words = F.broadcast(spark.createDataFrame(sorted(idf.items()), "t string, idf double"))
    # a text travels once, to be made distinct; its tokens carry its 128 bits alone, so the work grows with its length
    one = texts.select(F.unhex(F.md5(text)).alias("k"), F.col(text).alias("__text")).dropDuplicates(["k"])
    tf = one.select("k", F.explode(_tokens(F.col("__text"))).alias("t")).groupBy("k", "t").agg(F.count(F.lit(1)).alias("n"))
    weighed = tf.join(words, "t", "left").select("k", "t", (F.col("n") * F.coalesce("idf", F.lit(other))).alias("x"))
    norm = weighed.groupBy("k").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(table, "t").groupBy("k", "licence", "v").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(norm, "k").select("k", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= least)
    return scored.groupBy("k").agg(F.min_by("licence", F.struct(-F.col("score"), "licence")).alias("licence"), F.max("score").alias("score"))


def licence_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """``id, path, licence, score, via`` of every file.

    A file's own licence (via ``header``) is the best template of its header lines, the lines that HEADER finds, and of
    the paragraphs that hold one (to the next line without a letter or digit), by the cosine of TF-IDF vectors. Files named like LICENCE_FILE are compared whole too (via ``file``) and give their
    directory that licence. Files without one inherit from the nearest directory above (via the directory's path);
    else all three are null. Lines and directories are made distinct before anything is computed or joined for them.

    Null text is empty, a null path is in no directory. Repeated rows give repeated results. Empty tables
    give empty results. Other columns are ignored. Of several licence files of a directory the best score
    wins, then the first name.
    """
    f = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    f = f.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.length("path").cast("string"), F.lit("-")), F.coalesce("path", F.lit("")), "text")))
    is_file = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    blocks = F.concat(F.split("text", "\n"), F.split("text", BLANK))
    lines = f.filter(F.col("text").rlike(HEADER)).select("key", F.explode(blocks).alias("line")).filter(F.col("line").rlike(HEADER)).distinct()
    whole = f.filter(is_file).select("key", F.col("text").alias("line")).distinct()
    scored = best_template(lines.select("line").unionByName(whole.select("line")), "line", least)
    of = lambda x, via: x.select("key", F.unhex(F.md5("line")).alias("k")).join(scored, "k").select("key", "licence", "score", F.lit(via).alias("via"))
    best = F.struct(-F.col("score"), "licence")
    own = of(lines, "header").unionByName(of(whole, "file")).groupBy("key").agg(F.min_by(F.struct("licence", "score", "via"), F.struct(-F.col("score"), F.col("via"), F.col("licence"))).alias("own"))
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.when(F.col("path").isNotNull(), ""))
    f = f.withColumn("folder", folder).join(own, "key", "left")
    given = f.filter(is_file & F.col("own").isNotNull()).select(F.col("folder").alias("above"), "own.licence", "own.score").groupBy("above").agg(F.min_by(F.struct("licence", "score"), best).alias("given"))
    folders = f.filter(F.col("folder").isNotNull() & F.col("own").isNull()).select("folder").distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    steps = folders.select("folder", F.posexplode(F.array_distinct(above)).alias("depth", "above"))
    nearest = steps.join(given, "above").groupBy("folder").agg(F.max_by(F.struct("above", "given"), "depth").alias("near"))
    out = f.join(nearest, "folder", "left")
    return out.select(
        F.col("id").alias(id_col), "path", F.coalesce("own.licence", "near.given.licence").alias("licence"), F.coalesce("own.score", "near.given.score").alias("score"),
        F.when(F.col("own").isNotNull(), F.col("own.via")).otherwise(F.col("near.above")).alias("via"),
    )


