"""Licences of files: their own notices, else those of the nearest directory above.

Each line with a licence word is compared to the templates by the cosine of TF-IDF vectors
of its distinct words; weights come from the templates, and words that none has weigh most.  A
file that consists of notices by half of its words or more is a licence file and speaks for
its directory and all below.  Other files without a notice inherit from the nearest directory
above them that has a licence file, by joins of paths.  DataFrame functions only.

Defined results: a null text is an empty one and has no notice; a null part of a path is an
empty name; of several notices in one file the most alike counts, ties go by name of the
licence; of several licence files in one directory the most alike, then the least name;
repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.tables import text_of, written

#: Notices by licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use is governed by a BSD-style license, three clause."),
    ("CC-BY-4.0", "This text is available under the Creative Commons Attribution 4.0 license."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons Zero license."),
    ("proprietary", "Copyright, all rights reserved; no license is granted."),
)
#: Lines without any of these are no notices.
ANCHOR = r"(?i)licen[sc]e|copyright|public domain|rights reserved|spdx"


def line_words(line: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}.-]+|[.](?:\s|$)"), lambda w: w != ""))


def _words(text: str) -> list[str]:
    return sorted({w for w in re.split(r"[^\w.-]+|[.](?:\s|$)", text.lower()) if w})


def cosines(words: Column, templates: Sequence[tuple[str, str]] = TEMPLATES) -> Column:
    """Array of (cosine, name) of one line to each template."""
    bags = [(name, _words(text)) for name, text in templates]
    vocabulary = sorted({w for _, bag in bags for w in bag})
    weight = {w: 1 + math.log((1 + len(bags)) / (1 + sum(w in bag for _, bag in bags))) for w in vocabulary}
    unseen = 1 + math.log(1 + len(bags))
    table = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, weight[w] ** 2)])
    squares = lambda a: F.aggregate(a, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(table, w), F.lit(unseen**2)))
    out = []
    for name, bag in bags:
        size = sum(weight[w] ** 2 for w in bag)
        both = squares(F.array_intersect(words, F.array(*map(F.lit, bag))))
        out.append(F.struct(F.round(both / F.sqrt(F.greatest(squares(words), F.lit(1e-9)) * size), 9).alias("cosine"), F.lit(name).alias("license")))
    return F.array(*out)


def scan(files: DataFrame, path: Column, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = 0.6, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, path, own_license, cosine, is_license_file, license, inherited_from) of each file."""
    body = text_of(text)
    count = lambda x: F.size(F.array_remove(F.split(x, r"\s+"), ""))
    slim = files.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), path.alias("path"), count(body).alias("n"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(ANCHOR)).alias("lines"),
    )
    slim = written(slim, "license-lines")
    lines = slim.select("row", "n", F.explode("lines").alias("line"))
    # Distinct lines are compared once, however many files carry them.
    kinds = lines.select("line").distinct().withColumn("words", line_words(F.col("line")))
    best = F.array_max(F.transform(cosines(F.col("words"), templates), lambda c: F.struct(c["cosine"].alias("c"), c["license"].alias("l"))))
    kinds = written(kinds.select("line", best.alias("best")).where(F.col("best")["c"] >= least), "license-kinds")
    own = lines.join(kinds, "line").groupBy("row").agg(F.max("best").alias("best"), F.sum(count(F.col("line"))).alias("said"))
    known = written(slim.select("row", "id", "path", "n").join(own, "row", "left"), "license-own")
    folder = F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)
    known = known.withColumn("folder", folder).withColumn("is_license_file", F.coalesce(2 * F.col("said") >= F.col("n"), F.lit(False)))
    speaks = known.where("is_license_file").groupBy("folder").agg(
        F.min(F.struct((-F.col("best")["c"]).alias("c"), F.col("best")["l"].alias("l"))).getField("l").alias("says")
    )
    # Directories, not files, look for the nearest one above; a path has few of them.
    parts = F.split("folder", "/")
    up = known.select("folder").distinct().select("folder", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    up = up.withColumn("above", F.array_join(F.slice(F.split("folder", "/"), 1, F.col("depth")), "/"))
    nearest = up.join(speaks.withColumnRenamed("folder", "above"), "above").groupBy("folder").agg(
        F.max(F.struct("depth", "says", "above")).alias("near")
    )
    joined = known.join(nearest, "folder", "left")
    given = F.col("best")["l"]
    return joined.select(
        "id", "path", given.alias("own_license"), F.col("best")["c"].alias("cosine"), "is_license_file",
        F.coalesce(given, F.col("near")["says"]).alias("license"),
        F.when(given.isNull(), F.col("near")["above"]).alias("inherited_from"),
    )
