r"""License scan: an exact set-similarity join of text blocks with licence templates.
Built-in functions only.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. Templates are of two
kinds, and so are blocks, whose tokens are their distinct words:

* notices are compared with lines, and, since a notice may wrap, with each two
  neighbouring lines joined of which the first does not end a sentence;
* passages, the paragraphs that licences consist of, are compared with paragraphs, which
  end at lines without a word.

A template is met by a block of its kind that holds at least CONTAINED of the template's
tokens, with all of its telling words (those that tell it from its kin: `nc`, `lesser`, a
version) and none of the words that tell its kin from it. Tokens are ordered by how many
documents of the whole corpus hold them, rarest first, and then

* length filter: a block needs need = ceil(CONTAINED * tokens) of the template's tokens;
* prefix filter: so it shares one of the template's first tokens - need + 1 tokens, and
  the template one of the first that many of the block's;
* positional filter: with p and q tokens before the shared one on either side, no more
  than min(tokens - p, tokens of the block - q) can be shared.

Blocks are joined with the prefixes on the token; survivors are verified in full. The
templates and their tokens (a few hundred) are fixed here, so they are broadcast.

Besides, the places of three phrases are counted, whose labels every scan reports.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import words
from .shared import barrier, table

CONTAINED = 0.8
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICE, PASSAGE = 0, 1
#: A line without a word, with both of its ends.
BLANK = r"\n[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n"
#: The end of a line that ends a sentence.
ENDED = r"[.!?:;][\"')\]]*[ \t\r]*\z"
#: Label, kind, text, telling words, words that it must not have.
TEMPLATES = [
    ("apache-2.0", NOTICE, "Licensed under the Apache License, Version 2.0", "apache license 2", ""),
    ("mit", NOTICE, "Released under the MIT License", "mit license", ""),
    ("mit", NOTICE, "Licensed under the MIT License", "mit license", ""),
    ("cc-by-4.0", NOTICE, "Licensed under CC BY 4.0", "cc by 4", "nc sa nd"),
    ("cc-by-nc", NOTICE, "Licensed under CC BY-NC 4.0", "cc by nc", "sa nd"),
    ("cc-by-sa", NOTICE, "Licensed under CC BY-SA 4.0", "cc by sa", "nc nd"),
    ("cc-by-nd", NOTICE, "Licensed under CC BY-ND 4.0", "cc by nd", "nc sa"),
    ("cc-by-nc-sa", NOTICE, "Licensed under CC BY-NC-SA 4.0", "cc by nc sa", "nd"),
    ("cc-by-nc-nd", NOTICE, "Licensed under CC BY-NC-ND 4.0", "cc by nc nd", "sa"),
    ("cc-by-4.0", NOTICE, "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4", "noncommercial sharealike noderivatives"),
    ("cc-by-nc", NOTICE, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "commons attribution noncommercial", "sharealike noderivatives"),
    ("cc-by-sa", NOTICE, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "commons attribution sharealike", "noncommercial noderivatives"),
    ("gpl-2.0", NOTICE, "This work is licensed under the GNU General Public License, version 2", "general public license 2", "lesser library affero"),
    ("gpl-3.0", NOTICE, "This work is licensed under the GNU General Public License, version 3", "general public license 3", "lesser library affero"),
    ("lgpl", NOTICE, "Licensed under the GNU Lesser General Public License", "lesser general public license", "affero"),
    ("agpl", NOTICE, "Licensed under the GNU Affero General Public License", "affero general public license", "lesser"),
    ("mpl-2.0", NOTICE, "Subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license 2", ""),
    ("reserved", NOTICE, "Copyright. All rights reserved.", "rights reserved", ""),
    ("apache-2.0", PASSAGE, """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""", "apache compliance 2", ""),
    ("apache-2.0", PASSAGE, """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""", "applicable writing governing", ""),
    ("mit", PASSAGE, """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions:""", "granted charge sublicense", ""),
    ("bsd", PASSAGE, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "redistribution binary modification", ""),
    ("bsd", PASSAGE, """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not
        limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or
        contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement
        of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in
        contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the
        possibility of such damage.""", "contributors merchantability exemplary", ""),
    ("isc", PASSAGE, """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""", "permission fee granted appear", ""),
    ("zlib", PASSAGE, """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions:""", "permission alter freely restrictions", ""),
    ("gpl-2.0", PASSAGE, """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""", "general public license 2", "lesser library affero"),
    ("gpl-3.0", PASSAGE, """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", "general public license 3", "lesser library affero"),
    ("lgpl", PASSAGE, """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""", "lesser general public license", "affero"),
    ("agpl", PASSAGE, """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", "affero general public license", "lesser"),
    ("mpl-2.0", PASSAGE, """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/.""", "mozilla public license 2", ""),
    ("unlicense", PASSAGE, """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", "unencumbered public domain", ""),
]


def tokens_of(text: str) -> set[str]:
    """The distinct words of a template."""
    return set(re.findall("[0-9a-z]+", text.lower()))


def needed(tokens: int) -> int:
    return math.ceil(CONTAINED * tokens - 1e-9)


def vocabulary() -> list[str]:
    return sorted({w for _, _, *texts in TEMPLATES for text in texts for w in tokens_of(text)})


def frequency_order(docs: DataFrame) -> list[str]:
    """The templates' tokens, rarest in docs first: counted over all documents, in a
    result of as many rows as there are template tokens."""
    held = docs.select(F.explode(F.array_intersect(F.lit(vocabulary()), words(F.col("text")))).alias("token"))
    counts = {r.token: r["count"] for r in held.groupBy("token").count().collect()}
    return sorted(vocabulary(), key=lambda w: (counts.get(w, 0), w))


def template_rows(order: list[str]) -> list[tuple]:
    """(template, label, kind, tokens, need, telling, without) with tokens in the global order."""
    rank = {w: k for k, w in enumerate(order)}
    out = []
    for k, (label, kind, text, telling, without) in enumerate(TEMPLATES):
        tokens = sorted(tokens_of(text), key=rank.get)
        out.append((k, label, kind, tokens, needed(len(tokens)), sorted(tokens_of(telling)), sorted(tokens_of(without))))
    return out


def blocks_of(text, order: list[str], least: dict[int, int]):
    """(kind, tokens in the global order) of the blocks with least tokens of templates."""
    held = lambda part: F.array_intersect(F.lit(order), words(part))
    lines = F.split(text, "\n")
    pairs = F.zip_with(lines, F.slice(lines, 2, F.size(lines)), lambda a, b: F.when(b.isNotNull() & ~a.rlike(ENDED), F.concat(a, F.lit("\n"), b)))  # the last line has no next
    block = lambda kind: lambda parts: F.filter(F.transform(parts, lambda p: F.struct(F.lit(kind).alias("of"), held(p).alias("tokens"))), lambda b: F.size(b["tokens"]) >= least[kind])
    return F.array_distinct(F.concat(block(NOTICE)(F.concat(lines, F.array_compact(pairs))), block(PASSAGE)(F.split(text, BLANK))))


def places(found, n, phrase: str):
    """The positions at which the words of phrase stand; looked for only in texts that
    hold its last word."""
    parts = phrase.split()
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: _all(found, i, parts))
    return F.when(F.array_contains(found, parts[-1]), at).otherwise(F.array().cast("array<int>"))


def _all(found, i, parts):
    out = F.get(found, i) == parts[0]
    for k, w in enumerate(parts[1:], 1):
        out = out & F.coalesce(F.get(found, i + k) == w, F.lit(False))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each
    row of docs, which needs doc_id and text (other columns are ignored). score is 1 with
    a base phrase, else the largest containment met, else 0. A null text is empty; all
    rows of repeated documents are returned; an empty table gives an empty result."""
    order = frequency_order(docs)
    rules = template_rows(order)
    spark = docs.sparkSession
    prefix = [(token, k, label, kind, tokens, need, telling, without, p) for k, label, kind, tokens, need, telling, without in rules for p, token in enumerate(tokens[: len(tokens) - need + 1])]
    prefixes = spark.createDataFrame(prefix, "token string, template int, label string, kind int, tokens array<string>, need int, telling array<string>, without array<string>, p int")
    starts = sorted({p[0] for p in prefix})
    least = {kind: min(r[4] for r in rules if r[2] == kind) for kind in (NOTICE, PASSAGE)}

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = barrier(rows, found=words(F.col("text")))
    rows = barrier(rows, n=F.size("found"))
    spots = [places(F.col("found"), F.col("n"), phrase) for phrase in PHRASES]
    rows = barrier(rows, **{f"at{k}": s for k, s in enumerate(spots)})
    every = F.concat(*[F.col(f"at{k}") for k in range(len(PHRASES))])
    named = F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))
    # length filter: blocks with fewer template tokens than the smallest need are left out
    blocks = F.when(F.arrays_overlap("found", F.lit(starts)), blocks_of(F.col("text"), order, least))
    rows = rows.select("row", "doc_id", F.col("n").alias("n_words"), F.size(every).alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"), named.alias("base"), F.explode_outer(blocks).alias("block"))
    # a block's tokens stand in the global order; its own prefix for the smallest need
    rows = rows.select("*", F.col("block.of").alias("of"), F.col("block.tokens").alias("held")).drop("block")
    short = F.when(F.col("of") == NOTICE, least[NOTICE]).otherwise(least[PASSAGE])
    spread = rows.select("*", F.posexplode_outer(F.slice("held", 1, F.greatest(F.size("held") - short + 1, F.lit(0)))).alias("q", "token"))
    joined = spread.join(F.broadcast(prefixes), (spread["token"] == prefixes["token"]) & (spread["of"] == prefixes["kind"]), "left")
    can = F.least(F.size("tokens") - F.col("p"), F.size("held") - F.col("q")) >= F.col("need")
    both = F.size(F.array_intersect("tokens", "held"))
    told = (F.size(F.array_intersect("telling", "held")) == F.size("telling")) & ~F.arrays_overlap("without", "held")
    meets = F.when(can, F.when((both >= F.col("need")) & told, both / F.size("tokens")))
    kept = joined.withColumn("met", meets)
    each = kept.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base")],
        F.collect_set(F.when(F.col("met").isNotNull(), F.col("label"))).alias("more"), F.max("met").alias("met"),
    )
    text = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return each.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_base").cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        text(F.col("base")).alias("base_labels"), text(F.concat("base", "more")).alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("met", F.lit(0.0))).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
ENDED_SQL = ENDED.replace("'", "''")
_WORDS_OF = lambda text: sorted(tokens_of(text))
_RULES = ", ".join(f"({k}, '{label}', {kind}, {_WORDS_OF(text)!r}, {needed(len(tokens_of(text)))}, {_WORDS_OF(telling)!r}, {_WORDS_OF(without)!r}::VARCHAR[])" for k, (label, kind, text, telling, without) in enumerate(TEMPLATES))
OP6_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text, {_WORDS.format('text')} AS w FROM documents),
spots AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
base AS (
  SELECT rid, i - 1 AS i, CASE WHEN a = 'cc' AND b = 'by' THEN 'cc-by' WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' WHEN a = 'all' AND b = 'rights' AND c = 'reserved' THEN 'reserved' END AS label
  FROM spots WHERE label IS NOT NULL),
rules(template, label, kind, tokens, need, telling, without) AS (VALUES {_RULES}),
lines AS (SELECT rid, line, lead(line) OVER (PARTITION BY rid ORDER BY i) AS next FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)),
blocks AS (
  SELECT rid, {NOTICE} AS kind, {_WORDS.format('line')} AS w FROM lines
  UNION ALL SELECT rid, {NOTICE}, {_WORDS.format("line || chr(10) || next")} FROM lines WHERE next IS NOT NULL AND NOT regexp_matches(line, '{ENDED_SQL}')
  UNION ALL SELECT rid, {PASSAGE}, {_WORDS.format('part')} FROM (SELECT rid, unnest(regexp_split_to_array(text, '{BLANK}')) AS part FROM docs)),
met AS (
  SELECT rid, label, len(list_intersect(tokens, w)) / len(tokens) AS share
  FROM blocks b JOIN rules r ON b.kind = r.kind AND list_has_all(w, telling) WHERE len(list_intersect(tokens, w)) >= need AND NOT list_has_any(w, without)),
base_of AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
all_of AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM met) GROUP BY rid),
met_of AS (SELECT rid, max(share) AS share FROM met GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM docs LEFT JOIN base_of b USING (rid) LEFT JOIN all_of a USING (rid) LEFT JOIN met_of USING (rid)
"""
